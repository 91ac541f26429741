"""The streaming query, run over the whole events table and compared with its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from respondex.plans.catalog import query
from respondex.session import ensure_checkpoint_dir
from respondex.sources.tables import table
from respondex.streaming import monitor


@query(
    "st1_fielding_monitor",
    """SELECT date_trunc('hour', ts) AS hour, count(*) AS n_starts, count(*) FILTER (hour(ts) >= 22 OR hour(ts) <= 4) AS odd_hour_starts FROM events GROUP BY 1""",
)
def st1(spark, sf):
    """Events arrive in three deliveries; the monitor stops after each and goes on from its checkpoint.

    The second delivery brings the later half and the whole first half again:
    what the watermark has passed is late, the rest is known by its id. The last
    one is a closing event, which lets the watermark pass all real minutes; its
    own minute never closes. Minutes are appended once they are final.
    """
    root = f"{ensure_checkpoint_dir(spark)}/monitor_{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return events.select(F.col("ts").cast("timestamp_ntz").alias("hour"), F.lit(0).cast("long").alias("n_starts"), F.lit(0).cast("long").alias("odd_hour_starts"))
    half = low + (high - low) / 2
    closing = events.agg((F.max("event_id") + 1).alias("event_id"), (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    for delivery in (events.where(F.col("ts") <= F.lit(half)), events, closing):
        delivery.write.mode("append").parquet(f"{root}/landing")
        arriving = spark.readStream.schema(events.schema).parquet(f"{root}/landing")
        monitor.run_to_end(monitor.fielding_counts(arriving, "event_id", "ts"), f"{root}/minutes", f"{root}/checkpoint")
    minutes = spark.read.parquet(f"{root}/minutes")
    return minutes.groupBy(F.date_trunc("hour", "minute").cast("timestamp_ntz").alias("hour")).agg(F.sum("n_starts").alias("n_starts"), F.sum("odd_hour_starts").alias("odd_hour_starts"))
