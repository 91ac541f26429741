"""Order statistics that never put one group's rows into one task.

A window over ``partitionBy(dataset)`` sorts a whole data set in one task, and
the built-in exact ``percentile`` keeps every distinct value of a group in one
hash map. Both fail when one data set holds a third of all rows. Here the work
goes in three steps instead:

1. count rows per (group, value): partial aggregation collapses ties;
2. give each value a bucket that grows with the value (power-of-two range cut
   into 1,024 steps, so at most a few ten thousand buckets per group) and run
   the only group-wide window over the *bucket counts*;
3. rank inside (group, bucket), which spreads a group over many tasks.

The result is exact, whatever the distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from respondex.session import ensure_checkpoint_dir

_STEPS = 1024
_FLOOR_EXP = -30


def order_bucket(value: Column) -> Column:
    """A bucket number that never decreases as ``value`` grows."""
    v = value.cast("double")
    a = F.greatest(F.abs(v), F.lit(2.0**_FLOOR_EXP))
    e = F.floor(F.log2(a))
    step = F.floor((a / F.pow(F.lit(2.0), e) - 1) * _STEPS)
    b = (e - _FLOOR_EXP) * _STEPS + step
    return F.when(v < 0, -b).otherwise(b).cast("long")


#: Different values of a bucket from which on it is cut again, and about how many a cut leaves.
CELL_VALUES = 20_000


def cell_of(value: Column, values: Column, low: Column, high: Column, limit: int = CELL_VALUES) -> Column:
    """The cut of a bucket that ``value`` lies in: its range in as many equal steps as its number of different values asks for."""
    v, a, b = (c.cast("double") for c in (value, low, high))
    cuts = F.ceil(values / limit)
    return F.when((cuts > 1) & (b > a), F.least(F.floor((v - a) / (b - a) * cuts), cuts - 1)).otherwise(F.lit(0)).cast("long")


def ranked_values(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    sums: dict[str, Column] | None = None,
    count: Column | None = None,
    narrow: bool = False,
    limit: int = CELL_VALUES,
) -> DataFrame:
    """One row per (group, distinct value) with running totals in value order.

    ``count`` says for how many rows a row stands (default one). ``narrow`` is
    for values like time stamps, of which very many lie in one narrow range and
    so in few buckets: buckets of more than ``limit`` different values are then
    cut once more by their own range, at the price of another pass.

    Output: groups, value, ``n``, ``n_before`` (rows with a smaller value),
    ``n_total`` (rows of the group), and for every entry of ``sums`` the columns
    ``x``, ``x_before``, ``x_total``.
    """
    g = list(groups)
    measures = {"n": F.count(F.lit(1)) if count is None else F.sum(count), **{k: F.sum(c) for k, c in (sums or {}).items()}}
    names = list(measures)
    per_value = (
        df.where(F.col(value).isNotNull())
        .groupBy(*g, value)
        .agg(*[m.alias(k) for k, m in measures.items()])
        .withColumn("_bucket", order_bucket(F.col(value)))
    )
    per_bucket = per_value.groupBy(*g, "_bucket").agg(*[F.sum(k).alias(k) for k in names])
    w_all = W.partitionBy(*g)
    w_before = w_all.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *g,
        "_bucket",
        *[F.coalesce(F.sum(k).over(w_before), F.lit(0)).alias(f"_{k}_off") for k in names],
        *[F.sum(k).over(w_all).alias(f"{k}_total") for k in names],
    )
    placed, cell = per_value.join(offsets, [*g, "_bucket"]), ["_bucket"]
    if narrow:
        ranges = per_value.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_values"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        cell = ["_bucket", "_cell"]
        placed = placed.join(ranges, [*g, "_bucket"]).withColumn("_cell", cell_of(F.col(value), F.col("_values"), F.col("_low"), F.col("_high"), limit)).drop("_values", "_low", "_high")
        w_cells = W.partitionBy(*g, "_bucket").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        cells = placed.groupBy(*g, *cell).agg(*[F.sum(k).alias(f"_{k}_in") for k in names])
        cells = cells.select(*g, *cell, *[F.coalesce(F.sum(f"_{k}_in").over(w_cells), F.lit(0)).alias(f"_{k}_add") for k in names])
        placed = placed.join(cells, [*g, *cell]).withColumns({f"_{k}_off": F.col(f"_{k}_off") + F.col(f"_{k}_add") for k in names})
    w_in = W.partitionBy(*g, *cell).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        *g,
        value,
        *names,
        *[(F.col(f"_{k}_off") + F.coalesce(F.sum(k).over(w_in), F.lit(0))).alias(f"{k}_before") for k in names],
        *[f"{k}_total" for k in names],
    )


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], method: str = "linear") -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``probs``.

    ``linear`` puts the smallest value at 0 and the largest at 1; ``exclusive``
    uses positions p*(n+1), clipped to the data.
    """
    return quantiles_of(ranked_values(df, groups, value), groups, value, probs, method)


def quantiles_of(rv: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], method: str = "linear") -> DataFrame:
    """Quantiles from the result of ``ranked_values``."""
    parts, finished = quantile_parts(value, probs, method)
    return rv.groupBy(*groups).agg(F.max("n_total").alias("n_rows"), *parts).select(*groups, "n_rows", *finished)


def quantile_parts(value: str, probs: dict[str, float], method: str = "linear") -> tuple[list[Column], list[Column]]:
    """Aggregates over the rows of ``ranked_values`` and, of their results, the quantiles: so other aggregates can ride along."""
    n, before, v = F.col("n_total"), F.col("n_before"), F.col(value).cast("double")
    after = before + F.col("n")
    aggs = []
    for name, p in probs.items():
        if method == "linear":
            pos = F.lit(float(p)) * (n - 1)
        else:
            pos = F.least(F.greatest(F.lit(float(p)) * (n + 1) - 1, F.lit(0.0)), n - F.lit(1.0))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((before <= lo) & (lo < after), v)).alias(f"_{name}_lo"),
            F.max(F.when((before <= hi) & (hi < after), v)).alias(f"_{name}_hi"),
            F.max(pos - lo).alias(f"_{name}_f"),
        ]
    return aggs, [(F.col(f"_{k}_lo") + (F.col(f"_{k}_hi") - F.col(f"_{k}_lo")) * F.col(f"_{k}_f")).alias(k) for k in probs]


def positions(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    tie: str,
    descending: bool = False,
    out: str = "position",
    narrow: bool = False,
) -> DataFrame:
    """``row_number`` per group ordered by (value, tie), spread over many tasks (``narrow`` as in ``ranked_values``).

    ``tie`` must be a numeric column that is unique within the group. Rows that
    share a value are split again by ranges of ``tie``, so a value held by a
    third of all rows is ranked by many tasks.
    """
    g = list(groups)
    src = df.where(F.col(value).isNotNull())
    if descending:
        src = src.withColumn("_ord", -F.col(value))
    else:
        src = src.withColumn("_ord", F.col(value))
    src = src.withColumn("_tb", order_bucket(F.col(tie)))
    rv = ranked_values(src, g, "_ord", narrow=narrow).select(*g, "_ord", F.col("n_before").alias("_base"))
    cells = src.groupBy(*g, "_ord", "_tb").agg(F.count(F.lit(1)).alias("_c"))
    w_cell = W.partitionBy(*g, "_ord").orderBy("_tb").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_cell", F.coalesce(F.sum("_c").over(w_cell), F.lit(0)))
    offsets = cells.join(rv, [*g, "_ord"]).select(*g, "_ord", "_tb", (F.col("_base") + F.col("_cell")).alias("_off"))
    w_in = W.partitionBy(*g, "_ord", "_tb").orderBy(tie)
    return (
        src.join(offsets, [*g, "_ord", "_tb"])
        .withColumn(out, (F.col("_off") + F.row_number().over(w_in)).cast("long"))
        .drop("_ord", "_tb", "_off")
    )


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row.

    ``one_row`` must come from an ungrouped ``agg``: it has exactly one row, so
    the broadcast has a fixed size.
    """
    return df.crossJoin(F.broadcast(one_row))


HOT_SHARE = 1000
#: Groups whose statistics are sent to every task; more are matched through a shuffle.
BROADCAST_GROUPS = 50_000


def attach_groups(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Put the one row that ``stats`` has for a group next to every row of the group.

    Groups are counted first. Up to ``BROADCAST_GROUPS`` are broadcast, so rows
    stay where they are and a data set with a third of all rows is no hot key.
    Beyond that, groups of more than 1/1000 of all rows (999 at most) are
    broadcast and all others meet through the shuffle. Null keys match nothing;
    ``how`` is ``left`` or ``inner``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    k = list(keys)
    names = [c for c in stats.columns if c not in k]
    stats = stats.select(*k, *names).checkpoint()
    if stats.count() <= BROADCAST_GROUPS:
        return df.join(F.broadcast(stats), k, how)
    sizes = df.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    hot = attach_row(sizes, sizes.agg(F.sum("_n").alias("_total"))).where(F.col("_n") * HOT_SHARE > F.col("_total")).select(*k).checkpoint()
    few, rest = df.join(F.broadcast(hot), k, "left_semi"), df.join(F.broadcast(hot), k, "left_anti")
    cols = [*df.columns, *names]
    return few.join(F.broadcast(stats.join(F.broadcast(hot), k, "left_semi")), k, how).select(*cols).unionByName(rest.join(stats, k, how).select(*cols))



def with_group_stats(df: DataFrame, keys: Sequence[str], row_id: str, **aggs: Column) -> DataFrame:
    """Attach aggregates of the row's key group, safe against giant groups.

    A window ``over(partitionBy(key))`` or a plain join back would bring a giant
    group into one task. Keys that hold more than 1/1000 of all rows are at most
    999, so their statistics are broadcast; rows of those keys then carry a
    spread-out join key and only the rest is matched through the shuffle.
    """
    k = list(keys)
    names = list(aggs)
    stats = df.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_s_{a}") for a, c in aggs.items()])
    total = stats.agg(F.sum("_n").alias("_total"))
    payload = F.struct(*[F.col(f"_s_{a}").alias(a) for a in names])
    hot = (
        attach_row(stats, total)
        .where(F.col("_n") * HOT_SHARE > F.col("_total"))
        .select(*[F.col(c).alias(f"_h_{c}") for c in k], payload.alias("_hot"))
    )
    digest = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in k]))
    cold = stats.select(digest.alias("_jk"), payload.alias("_cold"))
    cond = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in k]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64(row_id), F.lit(4096)).cast("string"))
    marked = df.join(F.broadcast(hot), on, "left").withColumn("_jk", F.when(F.col("_hot").isNull(), digest).otherwise(spread))
    joined = marked.join(cold, "_jk", "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(F.col(f"_hot.{a}"), F.col(f"_cold.{a}")).alias(a) for a in names],
    )
