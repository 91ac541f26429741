"""Signals from grid and coded answers, on the long relation (respondent, grid, value).

Every measure starts from counts per (respondent, grid, value), which combine on
the map side; only order-based measures look at single rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from respondex.functions import ranking as R
from respondex.functions import sequences as Q


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))


def share_stats(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Answered, different and modal answers from counts per value."""
    return counts.groupBy(*keys).agg(
        F.sum("c").alias("n_items"), F.count(F.lit(1)).alias("n_unique"), F.max("c").alias("modal_count"), (F.max("c") / F.sum("c")).alias("modal_share")
    )


def straightline(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 0.95, min_items: int = 5) -> DataFrame:
    s = share_stats(value_counts(df, keys, value), keys)
    return s.withColumn("straightline", ((F.col("n_items") >= min_items) & (F.col("modal_share") >= threshold)).cast("int"))


def matrix_features(df: DataFrame, id_col: str, value: str) -> DataFrame:
    s = share_stats(value_counts(df, [id_col], value), [id_col])
    ratio = F.col("n_unique") / F.col("n_items")
    enough = F.col("n_items") >= 5
    return s.select(
        id_col,
        F.round(ratio, 6).alias("matrix_unique_ratio"),
        (enough & (ratio <= 0.2)).cast("int").alias("matrix_straightline"),
        (enough & (ratio <= 0.4)).cast("int").alias("matrix_near_straightline"),
        F.col("n_items").alias("matrix_count"),
        F.col("n_unique").alias("matrix_unique_count"),
        F.round("modal_share", 6).alias("matrix_most_common_freq"),
    )


def modal_max(df: DataFrame, id_col: str, grid: str, value: str, min_items: int = 4, uniform: float = 0.92) -> DataFrame:
    """Largest modal share over the grids with enough answers, and whether some grid is uniform."""
    s = share_stats(value_counts(df, [id_col, grid], value), [id_col, grid])
    ok = F.col("n_items") >= min_items
    return s.groupBy(id_col).agg(
        F.coalesce(F.max(F.when(ok, F.col("modal_share"))), F.lit(0.0)).alias("matrix_modal_max"),
        F.max(F.when(ok & (F.col("modal_share") >= uniform) & (F.col("n_unique") <= 2), 1).otherwise(0)).alias("matrix_uniform"),
    )


def per_grid_straightlining(df: DataFrame, id_col: str, grid: str, value: str, max_ratio: float = 0.2, min_items: int = 3) -> DataFrame:
    s = share_stats(value_counts(df, [id_col, grid], value), [id_col, grid])
    flag = ((F.col("n_unique") / F.col("n_items") <= max_ratio) & (F.col("n_items") >= min_items)).cast("int")
    return s.withColumn("grid_straightline", flag).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_grids"),
        F.sum("grid_straightline").alias("n_straightlined"),
        F.round(F.avg(F.col("n_unique") / F.col("n_items")), 6).alias("mean_unique_ratio"),
        F.round(F.min(F.col("n_unique") / F.col("n_items")), 6).alias("min_unique_ratio"),
    )


def group_stats(df: DataFrame, id_col: str, grid: str, value: str) -> DataFrame:
    """Location and spread per grid (population std) with the number of different values."""
    counts = value_counts(df, [id_col, grid], value)
    v, c = F.col(value).cast("double"), F.col("c")
    s = counts.groupBy(id_col, grid).agg(
        F.sum("c").alias("n_items"), F.sum(v * c).alias("_s1"), F.sum(v * v * c).alias("_s2"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count(F.lit(1)).alias("unique"),
    )
    mean = F.col("_s1") / F.col("n_items")
    var = F.greatest(F.col("_s2") / F.col("n_items") - mean * mean, F.lit(0.0))
    return s.select(
        id_col, grid, "n_items", mean.alias("mean"), F.sqrt(var).alias("std"), "min", "max", (F.col("max") - F.col("min")).alias("range"), "unique",
        (F.col("unique") <= 1).cast("int").alias("is_straightline"),
    )


def group_consistency(stats: DataFrame, id_col: str) -> DataFrame:
    """How far the grid means of a respondent lie apart."""
    return stats.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_grids"), F.var_pop("mean").alias("mean_variance"), F.avg("std").alias("avg_std"), (F.max("mean") - F.min("mean")).alias("mean_range")
    )


def run_lengths(df: DataFrame, id_col: str, order: str, tie: str, value: str, hot_rows: int = 100_000) -> DataFrame:
    """Longest, mean and number of runs of equal answers, and how often the answer changes."""
    seq = Q.ordered(df, id_col, order, tie, value, hot_rows)
    runs = seq.groupBy(id_col, "run_id").agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy(id_col).agg(
        F.max("len").alias("longest_run"), F.avg("len").alias("mean_run"), F.count(F.lit(1)).alias("n_runs"), F.sum("len").alias("n_items"),
    ).withColumn("transitions", F.col("n_runs") - 1).withColumn(
        "transition_rate", F.col("transitions") / F.greatest(F.col("n_items") - 1, F.lit(1))
    )


def half_variance_ratio(df: DataFrame, id_col: str, order: str, tie: str, value: str, hot_rows: int = 100_000) -> DataFrame:
    """(variance of the second half + 0.01) / (variance of the first half + 0.01)."""
    seq = Q.ordered(df, id_col, order, tie, value, hot_rows)
    first = F.col("pos") <= F.floor(F.col("n") / 2)
    out = seq.groupBy(id_col).agg(
        F.coalesce(F.var_pop(F.when(first, F.col(value))), F.lit(0.0)).alias("var_first_half"),
        F.coalesce(F.var_pop(F.when(~first, F.col(value))), F.lit(0.0)).alias("var_second_half"),
    )
    return out.withColumn("var_ratio", (F.col("var_second_half") + 0.01) / (F.col("var_first_half") + 0.01))


def answer_entropy(df: DataFrame, id_col: str, value: str, epsilon: float = 0.0) -> DataFrame:
    """Entropy in bits, share of the modal answer, share of different answers."""
    counts = value_counts(df, [id_col], value)
    totals = counts.groupBy(id_col).agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    return counts.join(totals, id_col).groupBy(id_col).agg(
        (-F.sum(p * F.log2(p + epsilon))).alias("answer_entropy"), F.max(p).alias("answer_max_freq"), (F.count(F.lit(1)) / F.max("n")).alias("answer_unique_ratio")
    )


def value_shares(df: DataFrame, id_col: str, value: str, scale: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    v = F.col(value)
    lo, hi = scale[1], scale[-2]
    n = F.count(value)
    return df.groupBy(id_col).agg(
        n.alias("n_items"),
        *[(F.sum((v == s).cast("int")) / n).alias(f"pct_{s}") for s in scale],
        (F.sum((v <= lo).cast("int")) / n).alias("pct_low_box"),
        (F.sum((v >= hi).cast("int")) / n).alias("pct_high_box"),
    )


def ngram_diversity(df: DataFrame, id_col: str, order: str, tie: str, value: str, hot_rows: int = 100_000) -> DataFrame:
    """Different pairs and triples of consecutive answers, and how often answers repeat."""
    seq = Q.ordered(df, id_col, order, tie, value, hot_rows).where("n > 2")
    two = seq.where("prev1 IS NOT NULL").groupBy(id_col, "prev1", value).agg(F.count(F.lit(1)).alias("c"))
    three = seq.where("prev2 IS NOT NULL").groupBy(id_col, "prev2", "prev1", value).agg(F.count(F.lit(1)).alias("c"))
    one = seq.groupBy(id_col, value).agg(F.count(F.lit(1)).alias("c"))
    b = two.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("bigram_unique"), (F.count(F.lit(1)) / F.sum("c")).alias("bigram_diversity"), F.max("c").alias("bigram_top_freq")
    )
    t = three.groupBy(id_col).agg(F.count(F.lit(1)).alias("trigram_unique"), (F.count(F.lit(1)) / F.sum("c")).alias("trigram_diversity"))
    s = one.groupBy(id_col).agg(
        F.max("c").alias("max_repeat"), (F.max("c") / F.sum("c")).alias("max_repeat_pct"),
        F.sum((F.col("c") == 1).cast("int")).alias("single_answers"), (F.sum((F.col("c") == 1).cast("int")) / F.count(F.lit(1))).alias("single_pct"),
    )
    return s.join(b, id_col).join(t, id_col)


def coded_diversity(df: DataFrame, id_col: str, value: str, dont_know: Sequence[str], none: Sequence[str]) -> DataFrame:
    counts = value_counts(df, [id_col], value)
    v = F.lower(F.trim(F.col(value)))
    n = F.sum("c")
    return counts.groupBy(id_col).agg(
        n.alias("coded_count"), (F.count(F.lit(1)) / n).alias("coded_unique_ratio"),
        F.sum(F.when(v.isin(*dont_know), F.col("c")).otherwise(0)).alias("coded_dk_count"),
        (F.sum(F.when(v.isin(*dont_know), F.col("c")).otherwise(0)) / n).alias("coded_dk_ratio"),
        (F.sum(F.when(v.isin(*none), F.col("c")).otherwise(0)) / n).alias("coded_none_pct"),
    )


# --- fixed values: amounts that mark a mechanical allocation --------------------------------------
ROUND_AMOUNTS = (0, 10, 20, 25, 33, 34, 50, 90, 95, 100)


def round_allocation(df: DataFrame, id_col: str, value: str, min_values: int = 12, min_share: float = 0.75, amounts: Sequence[int] = ROUND_AMOUNTS) -> DataFrame:
    share = F.avg(F.col(value).isin(*amounts).cast("int"))
    out = df.where(F.col(value).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n_values"), share.alias("round_share"))
    return out.withColumn("round_allocation", ((F.col("n_values") >= min_values) & (F.col("round_share") >= min_share)).cast("int"))


def question_outliers(df: DataFrame, id_col: str, field: str, value: str, min_answers: int = 10) -> DataFrame:
    """Per respondent: distance of its answers from the distribution of each question.

    The question statistics have one row per questionnaire field, so they are broadcast.
    """
    d = df.where(F.col(value).isNotNull())
    moments = d.groupBy(field).agg(F.count(F.lit(1)).alias("qn"), F.avg(value).alias("qm"), F.stddev_pop(value).alias("qs"))
    box = R.quantiles(d, [field], value, {"q25": 0.25, "q75": 0.75}).drop("n_rows")
    stats = moments.where(F.col("qn") > min_answers).join(box, field)
    v, iqr = F.col(value), F.col("q75") - F.col("q25")
    z = F.abs(v - F.col("qm")) / (F.col("qs") + 1e-6)
    out_of_box = ((v < F.col("q25") - 1.5 * iqr) | (v > F.col("q75") + 1.5 * iqr)).cast("int")
    scored = d.join(F.broadcast(stats), field).select(id_col, z.alias("z"), out_of_box.alias("o"))
    return scored.groupBy(id_col).agg(
        F.avg("z").alias("mean_z"), F.max("z").alias("max_z"), F.stddev_pop("z").alias("std_z"),
        F.sum("o").alias("iqr_outlier_count"), F.avg("o").alias("iqr_outlier_pct"), F.avg((F.col("z") > 3).cast("int")).alias("extreme_z_pct"),
    )


def prevalence_gate(df: DataFrame, id_col: str, signals: Sequence[str], score_off: float = 0.8, context: float = 0.85, sparse: float = 0.01) -> DataFrame:
    """How common each signal is and what it may still be used for."""
    long_ = df.select(id_col, *[F.col(s).cast("int").alias(s) for s in signals]).unpivot([id_col], list(signals), "signal", "v")
    return long_.groupBy("signal").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("n_present"), F.avg("v").alias("prevalence")).withColumn(
        "gate",
        F.when(F.col("prevalence") > context, "context_only").when(F.col("prevalence") > score_off, "not_scored")
        .when(F.col("prevalence") < sparse, "sparse").otherwise("active"),
    )


def missingness(df: DataFrame, fields: Sequence[str], limits: Sequence[float] = (0.55, 0.60)) -> DataFrame:
    """Share of blank or absent fields per row and flags at the given limits."""
    blank = sum(((F.col(f).isNull()) | (F.trim(F.col(f).cast("string")) == "")).cast("int") for f in fields)
    out = df.withColumn("missing_rate", blank / F.lit(len(fields)))
    for x in limits:
        out = out.withColumn(f"high_missing_{int(round(x * 100))}", (F.col("missing_rate") > x).cast("int"))
    return out


def severity(modal: Column, unique_ratio: Column, n_items: Column, transition_rate: Column) -> Column:
    """Composite risk of a grid in 0..1: repetition, lack of variety and lack of change, damped for short grids."""
    raw = 0.5 * modal + 0.3 * (1 - unique_ratio) + 0.2 * (1 - transition_rate)
    return F.least(F.lit(1.0), raw * F.least(F.lit(1.0), n_items / 5.0))
