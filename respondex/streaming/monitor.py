"""Live view of fielding: starts per minute and odd-hour starts on a stream.

The reference works on finished exports only; this is the batch operator
(``timing.minute_bursts`` and ``timing.fielding_start_stats``) kept up to date
while answers arrive. A finished stream gives the same counts as the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(events: DataFrame, id_col: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """One event per id within the watermark; a re-delivered event is dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def minute_counts(events: DataFrame, ts: str, delay: str | None = "10 minutes") -> DataFrame:
    """Starts and odd-hour starts (22 to 4 o'clock) per minute, closed when the watermark passes.

    ``delay=None`` keeps the watermark that ``first_seen`` has set.
    """
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if delay else events
    odd = (F.hour(ts) >= 22) | (F.hour(ts) <= 4)
    return (
        e.groupBy(F.window(ts, "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_starts"), F.sum(F.when(odd, 1).otherwise(0)).alias("odd_hour_starts"))
        .select(F.col("w.start").alias("minute"), "n_starts", "odd_hour_starts")
    )


def run_to_end(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there and stops; the checkpoint lets a restart go on exactly once."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def fielding_counts(events: DataFrame, id_col: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Starts per minute, each event counted once: state of ids and minutes is given up as the watermark passes them."""
    return minute_counts(first_seen(events, id_col, ts, delay), ts, None)
