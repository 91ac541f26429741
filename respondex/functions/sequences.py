"""Ordered answers of a respondent: position, neighbours and runs, safe for giant respondents.

A window per respondent is one shuffle and right for normal respondents. A
respondent that holds a large share of all rows would be sorted in one task, so
such respondents (at most 999, see ``HOT_SHARE``) take another way with the same
result: ranks from ranges, neighbours by joining on position + 1, runs from
prefix sums over blocks of positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from respondex.functions.ranking import HOT_SHARE, attach_row, positions

BLOCK = 65_536


def hot_keys(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Keys with more than ``min_rows`` rows and more than 1/1000 of all rows: 999 keys at most."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return attach_row(counts, total).where((F.col("_n") > min_rows) & (F.col("_n") * HOT_SHARE > F.col("_total"))).select(key, "_n")


def ordered(df: DataFrame, key: str, order: str, tie: str, value: str, hot_rows: int = 100_000) -> DataFrame:
    """Adds ``pos`` (from 1), ``n``, ``prev1``, ``prev2`` and ``run_id`` in (order, tie) order."""
    src = df.select(key, order, tie, value)
    hot = hot_keys(src, key, hot_rows)
    if hot.isEmpty():  # no giant: one window, and no plan for the other way
        return _by_window(src, key, order, tie, value)
    normal = src.join(F.broadcast(hot.select(key)), key, "left_anti")
    giant = src.join(F.broadcast(hot), key)
    return _by_window(normal, key, order, tie, value).unionByName(_by_blocks(giant, key, order, tie, value))


def _by_window(df: DataFrame, key: str, order: str, tie: str, value: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order, tie)
    out = df.select(
        key, value,
        F.row_number().over(w).cast("long").alias("pos"),
        F.count(F.lit(1)).over(W.partitionBy(key)).alias("n"),
        F.lag(value, 1).over(w).alias("prev1"),
        F.lag(value, 2).over(w).alias("prev2"),
    )
    change = F.when(F.col("prev1").eqNullSafe(F.col(value)) & (F.col("pos") > 1), 0).otherwise(1)
    runs = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("run_id", F.sum(change).over(runs).cast("long"))


def _by_blocks(df: DataFrame, key: str, order: str, tie: str, value: str) -> DataFrame:
    # Rows without an order value come first, as in a window; at most 999 giant keys have a count of them.
    bare = df.where(F.col(order).isNull())
    shift = F.broadcast(bare.groupBy(key).agg(F.count(F.lit(1)).alias("_bare")))
    filled = positions(df, [key], order, tie, out="pos", narrow=True).join(shift, key, "left").withColumn("pos", F.col("pos") + F.coalesce("_bare", F.lit(0))).drop("_bare")
    p = filled.unionByName(positions(bare, [key], tie, tie, out="pos")).select(key, value, "pos", F.col("_n").alias("n"))
    back1 = p.select(key, (F.col("pos") + 1).alias("pos"), F.col(value).alias("prev1"))
    back2 = p.select(key, (F.col("pos") + 2).alias("pos"), F.col(value).alias("prev2"))
    out = p.join(back1, [key, "pos"], "left").join(back2, [key, "pos"], "left")
    change = F.when(F.col("prev1").eqNullSafe(F.col(value)) & (F.col("pos") > 1), 0).otherwise(1)
    out = out.withColumn("_change", change).withColumn("_block", F.floor((F.col("pos") - 1) / BLOCK))
    blocks = out.groupBy(key, "_block").agg(F.sum("_change").alias("_c"))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(key, "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(key, "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return (
        out.join(blocks, [key, "_block"])
        .withColumn("run_id", (F.col("_off") + F.sum("_change").over(inside)).cast("long"))
        .select(key, value, "pos", "n", "prev1", "prev2", "run_id")
    )
