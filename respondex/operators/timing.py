"""Signals from durations and time stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from respondex.functions import ranking as R


def timing_bands(df: DataFrame, dataset: str, qtime: str) -> DataFrame:
    """Four bands cut at p10, p25 and median of the positive durations of the data set."""
    cuts = R.quantiles(df.where(F.col(qtime) > 0), [dataset], qtime, {"p10": 0.10, "p25": 0.25, "p50": 0.50}).drop("n_rows")
    t = F.col(qtime)
    band = (
        F.when(t.isNull() | (t <= 0), "unknown")
        .when(t <= F.col("p10"), "bottom_10")
        .when(t <= F.col("p25"), "bottom_25")
        .when(t <= F.col("p50"), "below_median")
        .otherwise("above_median")
    )
    return R.attach_groups(df, cuts, [dataset]).withColumn("timing_band", band).drop("p10", "p25", "p50")


def timing_bands6(df: DataFrame, dataset: str, qtime: str) -> DataFrame:
    """Six bands with quantile positions p*(n+1), as statistics.quantiles has them."""
    probs = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
    cuts = R.quantiles(df.where(F.col(qtime) > 0), [dataset], qtime, probs, method="exclusive").drop("n_rows")
    t = F.col(qtime)
    band = (
        F.when(t.isNull() | (t <= 0), None)
        .when(t < F.col("p10"), "bottom_10").when(t < F.col("p25"), "bottom_25").when(t < F.col("p50"), "below_median")
        .when(t < F.col("p75"), "above_median").when(t < F.col("p90"), "top_25").otherwise("top_10")
    )
    return R.attach_groups(df, cuts, [dataset]).withColumn("timing_band6", band).drop(*probs)


def fast_flags(df: DataFrame, dataset: str, qtime: str, fast: float = 240.0, brisk: float = 300.0, short: float = 600.0, per_unit: float = 60.0) -> DataFrame:
    """Speed class; a median of 30 or less means the column is in minutes, so limits shrink by ``per_unit``."""
    med = R.quantiles(df, [dataset], qtime, {"_med": 0.5}).drop("n_rows")
    out = R.attach_groups(df, med, [dataset]).withColumn("_unit", F.when(F.col("_med") > 30, F.lit(1.0)).otherwise(F.lit(per_unit)))
    t = F.col(qtime)
    cls = (
        F.when(t.isNull() | (t <= 0), "unknown")
        .when(t < fast / F.col("_unit"), "fast").when(t < brisk / F.col("_unit"), "brisk").when(t < short / F.col("_unit"), "short")
        .otherwise("normal")
    )
    return out.withColumn("speed_class", cls).withColumn("fast_flag", (cls == "fast").cast("int")).drop("_med", "_unit")


def robust_z(df: DataFrame, dataset: str, qtime: str, rejected: str) -> DataFrame:
    """Distance from the accepted median in units of the accepted MAD; fast = below the accepted p10."""
    accepted = df.where((F.col(rejected) == 0) & F.col(qtime).isNotNull())
    base = R.quantiles(accepted, [dataset], qtime, {"med": 0.5, "p10": 0.1}).drop("n_rows")
    dev = R.attach_groups(accepted, base, [dataset], "inner").withColumn("dev", F.abs(F.col(qtime) - F.col("med")))
    mad = R.quantiles(dev, [dataset], "dev", {"mad": 0.5}).drop("n_rows")
    out = R.attach_groups(df, base.join(mad, dataset, "left"), [dataset])
    scale = F.when(F.coalesce("mad", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("mad"))
    return out.withColumn("robust_z", (F.col(qtime) - F.col("med")) / scale).withColumn(
        "fast_route_adjusted", F.coalesce((F.col(qtime) < F.col("p10")).cast("int"), F.lit(0))
    ).drop("med", "p10", "mad")


def zscores(df: DataFrame, dataset: str, value: str, row_id: str) -> DataFrame:
    """(x - mean) / sample std per data set, 0 where the spread is 0."""
    out = R.with_group_stats(df, [dataset], row_id, _m=F.avg(value), _sd=F.stddev_samp(value))
    z = F.when(F.coalesce("_sd", F.lit(0.0)) > 0, (F.col(value) - F.col("_m")) / F.col("_sd")).otherwise(F.lit(0.0))
    return out.withColumn("zscore", z).drop("_m", "_sd")


def quantile_bucket(df: DataFrame, dataset: str, value: str, parts: int, out: str) -> DataFrame:
    """Bin number by equal-frequency edges; equal edges are merged, so ties share a bin."""
    names = {f"_e{i}": i / parts for i in range(parts + 1)}
    edges = R.quantiles(df, [dataset], value, names).select(dataset, F.array_distinct(F.array(*names)).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return R.attach_groups(df, edges, [dataset]).withColumn(out, F.greatest(below - 1, F.lit(0))).drop("_edges")


def time_text_flags(df: DataFrame, dataset: str, qtime: str, words: str) -> DataFrame:
    """Low and high durations, and long answers in little time; a missing duration counts as the median."""
    med = R.quantiles(df, [dataset], qtime, {"_med": 0.5}).drop("n_rows")
    filled = R.attach_groups(df, med, [dataset]).withColumn("qtime_filled", F.coalesce(F.col(qtime), F.col("_med"), F.lit(0.0))).drop("_med")
    tq = R.quantiles(filled, [dataset], "qtime_filled", {"_t10": 0.10, "_t20": 0.20, "_t95": 0.95}).drop("n_rows")
    wq = R.quantiles(filled, [dataset], words, {"_w80": 0.80}).drop("n_rows")
    out = R.attach_groups(filled, tq.join(wq, dataset), [dataset], "inner")
    t = F.col("qtime_filled")
    return (
        out.withColumn("qtime_low", (t <= F.col("_t10")).cast("int"))
        .withColumn("qtime_high", (t >= F.col("_t95")).cast("int"))
        .withColumn("answer_time_text_mismatch", ((F.col(words) >= F.col("_w80")) & (t <= F.col("_t20"))).cast("int"))
        .drop("_t10", "_t20", "_t95", "_w80")
    )


def fielding_start_stats(df: DataFrame, ts_text: str) -> DataFrame:
    """Share of readable start stamps and starts between 22 and 4 o'clock."""
    t = df.select(F.col(ts_text).try_cast("timestamp_ntz").alias("t"))
    odd = (F.hour("t") >= 22) | (F.hour("t") <= 4)
    return t.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("t").alias("n_parsed"),
        F.sum(F.when(odd, 1).otherwise(0)).alias("odd_hour_starts"),
    ).withColumn("parse_rate", F.round(F.try_divide(F.col("n_parsed"), F.col("n_rows")), 6))


def minute_bursts(df: DataFrame, ts: str, top: int = 5) -> DataFrame:
    """The ``top`` minutes with more than one start."""
    return (
        df.groupBy(F.date_trunc("minute", ts).cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("n_starts"))
        .where("n_starts > 1").orderBy(F.col("n_starts").desc(), "minute").limit(top)
    )


def temporal_features(df: DataFrame, id_col: str, ts: str) -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.groupBy(id_col).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("range_seconds"),
        F.count(F.lit(1)).alias("n_stamps"),
    )


def fielding_trend(df: DataFrame, ts: str, review: Column, discard: Column) -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(review, 1).otherwise(0)).alias("review"),
        F.sum(F.when(discard, 1).otherwise(0)).alias("discard"),
    )


def time_interactions(df: DataFrame, qtime: str, counts: dict[str, str], quality: Sequence[str]) -> DataFrame:
    """Time per unit of every count and products of time with quality measures."""
    out = df
    for name, c in counts.items():
        out = out.withColumn(f"qtime_per_{name}", F.col(qtime) / (F.col(c) + 1))
    for c in quality:
        out = out.withColumn(f"{c}_x_qtime", F.col(c) * F.col(qtime) / 1000)
    return out


def percentile_rank(df: DataFrame, dataset: str, value: str) -> DataFrame:
    """Share of the data set's rows with a value not above the row's own."""
    rv = R.ranked_values(df, [dataset], value).select(dataset, value, ((F.col("n_before") + F.col("n")) / F.col("n_total")).alias("pct_rank"))
    return R.attach_groups(df, rv, [dataset, value])
