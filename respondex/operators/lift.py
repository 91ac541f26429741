"""Rates, lifts, interactions, effect sizes and summaries over labelled respondents.

Respondents come in as one row each with ``signals`` as an array. Pairs and
triples of signals are built inside the row, never by joining rows, so the
shuffle carries counts per (data set, signal set) only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from respondex.functions import ranking as R
from respondex.session import ensure_checkpoint_dir


def rate(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def n_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def labelled(df: DataFrame, rejected: str = "rejected") -> DataFrame:
    return df.where(F.col(rejected).isNotNull())


def supplier_stats(df: DataFrame, supplier: str, rejected: str = "rejected") -> DataFrame:
    name = F.coalesce(F.nullif(F.trim(F.col(supplier)), F.lit("")), F.lit("MISSING"))
    out = df.groupBy(name.alias("supplier")).agg(
        F.count(F.lit(1)).alias("total"), n_if(F.col(rejected) == 1).alias("reject"), n_if(F.col(rejected) == 0).alias("accept")
    )
    r = F.col("reject") / F.col("total") * 100
    risk = F.when(r >= 40, "high").when(r >= 20, "medium").when(r < 10, "low").otherwise("moderate")
    return out.withColumn("reject_rate", F.round(r, 1)).withColumn("risk_level", risk)


def smoothed_rates(df: DataFrame, key: str, rejected: str, is_train: Column, prior: float = 20.0) -> DataFrame:
    """(n * rate + prior * global) / (n + prior) per key, learned on training rows only.

    Applied to all rows: a key that training never saw gets the global rate.
    """
    train = df.where(is_train & F.col(rejected).isNotNull())
    overall = train.agg(F.avg(rejected).alias("_g"))
    keys = train.groupBy(key).agg(F.count(F.lit(1)).alias("train_n"), F.sum(rejected).alias("_s"))
    keys = R.attach_row(keys, overall).select(key, "train_n", ((F.col("_s") + prior * F.col("_g")) / (F.col("train_n") + prior)).alias("_r"))
    out = R.attach_row(R.attach_groups(df, keys, [key]), overall)
    return out.withColumn("smoothed_rate", F.coalesce("_r", "_g")).withColumn("train_n", F.coalesce("train_n", F.lit(0))).drop("_r", "_g")


def hierarchical_rates(df: DataFrame, outer: str, inner: str, rejected: str = "rejected") -> DataFrame:
    """Rates per supplier and per supplier x class from one pass."""
    out = labelled(df, rejected).groupingSets([[F.col(outer)], [F.col(outer), F.col(inner)]], F.col(outer), F.col(inner)).agg(
        F.grouping(inner).alias("is_total"), F.count(F.lit(1)).alias("n"), F.sum(rejected).alias("rejects")
    )
    return out.withColumn("reject_rate", F.col("rejects") / F.col("n"))


def target_encoding(long_: DataFrame, field: str, value: str, rejected: str, is_train: Column, smoothing: float = 10.0) -> DataFrame:
    """Smoothed rejection rate and count of every (field, value), from training rows only."""
    train = long_.where(is_train & F.col(rejected).isNotNull())
    overall = train.agg(F.avg(rejected).alias("_g"))
    out = R.attach_row(train.groupBy(field, value).agg(F.count(F.lit(1)).alias("train_n"), F.sum(rejected).alias("_s")), overall)
    return out.select(field, value, "train_n", ((F.col("_s") + smoothing * F.col("_g")) / (F.col("train_n") + smoothing)).alias("encoded"))


def signal_prevalence(df: DataFrame, dataset: str, signals: str = "signals", rejected: str = "rejected") -> DataFrame:
    """Hits by label, rate when present, lift over the data set's rate, share of accepted rows hit."""
    d = labelled(df, rejected)
    hits = d.select(dataset, rejected, F.explode(signals).alias("signal")).groupBy(dataset, "signal").agg(
        n_if(F.col(rejected) == 0).alias("accepted_hits"), n_if(F.col(rejected) == 1).alias("rejected_hits")
    )
    base = d.groupBy(dataset).agg(F.avg(rejected).alias("dataset_reject_rate"), n_if(F.col(rejected) == 0).alias("_acc"))
    out = hits.join(base, dataset).withColumn("support", F.col("accepted_hits") + F.col("rejected_hits"))
    out = out.withColumn("reject_rate_when_present", rate(F.col("rejected_hits"), F.col("support")))
    return out.withColumn("lift", rate(F.col("reject_rate_when_present"), F.col("dataset_reject_rate"))).withColumn(
        "false_positive_burden", rate(F.col("accepted_hits"), F.greatest(F.col("_acc"), F.lit(1)))
    ).drop("_acc")


def signal_stats(df: DataFrame, dataset: str, signals: str = "signals", rejected: str = "rejected", min_support: int = 25) -> DataFrame:
    d = labelled(df, rejected)
    base = d.agg(F.avg(rejected).alias("base_reject_rate"), n_if(F.col(rejected) == 0).alias("_acc"))
    per = d.select(dataset, rejected, F.explode(signals).alias("signal")).groupBy("signal", dataset).agg(
        F.count(F.lit(1)).alias("c"), n_if(F.col(rejected) == 1).alias("r")
    )
    out = per.groupBy("signal").agg(F.sum("c").alias("support"), F.sum("r").alias("rejected_hits"), F.count(F.lit(1)).alias("datasets_present"))
    out = R.attach_row(out, base).withColumn("accepted_hits", F.col("support") - F.col("rejected_hits"))
    r = F.col("rejected_hits") / F.col("support")
    promoted = (F.col("support") >= min_support) & (r > F.col("base_reject_rate") * 1.1)
    return out.select(
        "signal", "support", "rejected_hits", "accepted_hits", F.round(r, 4).alias("reject_rate_when_present"), F.round("base_reject_rate", 4).alias("base_reject_rate"),
        F.round(rate(r, F.col("base_reject_rate")), 4).alias("lift"), F.round(rate(F.col("accepted_hits"), F.greatest(F.col("_acc"), F.lit(1))), 4).alias("accepted_counterexample_rate"),
        "datasets_present", F.when(promoted, "promote_to_agent_instruction").otherwise("hold_for_more_evidence").alias("promotion_decision"),
        signal_role(r, F.col("base_reject_rate"), F.col("support")).alias("signal_role"),
    )


def signal_role(r: Column, base: Column, support: Column) -> Column:
    return (
        F.when(support < 10, "needs_more_examples")
        .when(r >= F.greatest(F.lit(0.6), base * 1.75), "candidate_rejection_signal")
        .when(r <= F.least(F.lit(0.2), base * 0.55), "accepted_row_guardrail")
        .otherwise("context_signal")
    )


def top_signals(prevalence: DataFrame, k: int) -> DataFrame:
    """The ``k`` signals with the highest mean lift over data sets, as one row with an array: k bounds its size."""
    top = (
        prevalence.groupBy("signal").agg(F.avg("lift").alias("mean_lift"), F.sum("support").alias("support"))
        .where("support > 0").orderBy(F.round("mean_lift", 9).desc(), F.col("support").desc(), "signal").limit(k)
    )
    return top.agg(F.array_sort(F.collect_list("signal")).alias("_top"))


def _kept(df: DataFrame, dataset: str, signals: str, rejected: str, top: DataFrame) -> DataFrame:
    d = R.attach_row(labelled(df, rejected).select(dataset, rejected, signals), top)
    return d.select(dataset, rejected, F.array_sort(F.array_intersect(signals, "_top")).alias("s"))


def _combinations(s: str, size: int) -> Column:
    """All sorted combinations of 2 or 3 elements of a short array."""
    n = F.size(s)
    upto = lambda i: F.when(n > i, F.slice(F.col(s), i + 1, n)).otherwise(F.array().cast("array<string>"))
    if size == 2:
        return F.flatten(F.transform(F.col(s), lambda a, i: F.transform(upto(i + 1), lambda b: F.array(a, b))))
    return F.flatten(
        F.flatten(
            F.transform(
                F.col(s),
                lambda a, i: F.transform(F.sequence(i + 1, F.greatest(n - 1, i + 1)), lambda j: F.when(
                    n > j, F.transform(upto(j + 1), lambda c: F.array(a, F.get(F.col(s), j), c))
                ).otherwise(F.array().cast("array<array<string>>"))),
            )
        )
    )


def pair_interactions(df: DataFrame, dataset: str, signals: str = "signals", rejected: str = "rejected", top: int = 14, min_support: int = 5) -> DataFrame:
    """Signal pairs per data set with lift and gain over the better of the two signals."""
    prevalence = signal_prevalence(df, dataset, signals, rejected)
    kept = _kept(df, dataset, signals, rejected, top_signals(prevalence, top))
    pairs = kept.select(dataset, rejected, F.explode(_combinations("s", 2)).alias("p")).groupBy(dataset, F.col("p")[0].alias("signal_a"), F.col("p")[1].alias("signal_b")).agg(
        F.count(F.lit(1)).alias("support"), n_if(F.col(rejected) == 1).alias("rejected_hits")
    ).where(F.col("support") >= min_support)
    single = prevalence.select(dataset, "signal", "reject_rate_when_present")
    a = single.select(dataset, F.col("signal").alias("signal_a"), F.col("reject_rate_when_present").alias("_ra"))
    b = single.select(dataset, F.col("signal").alias("signal_b"), F.col("reject_rate_when_present").alias("_rb"))
    base = labelled(df, rejected).groupBy(dataset).agg(F.avg(rejected).alias("_base"), n_if(F.col(rejected) == 0).alias("_acc"))
    out = pairs.join(a, [dataset, "signal_a"]).join(b, [dataset, "signal_b"]).join(base, dataset)
    r = F.col("rejected_hits") / F.col("support")
    accepted = F.col("support") - F.col("rejected_hits")
    return out.select(
        dataset, "signal_a", "signal_b", "support", "rejected_hits", accepted.alias("accepted_hits"), F.round(r, 4).alias("reject_rate"), F.round(rate(r, F.col("_base")), 4).alias("lift"),
        F.round(r - F.greatest("_ra", "_rb"), 4).alias("incremental_value"), F.round(rate(accepted, F.greatest(F.col("_acc"), F.lit(1))), 4).alias("false_positive_burden"),
    )


def pair_summary(pairs: DataFrame, dataset: str) -> DataFrame:
    return pairs.groupBy("signal_a", "signal_b").agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("support").alias("support"), F.sum("rejected_hits").alias("rejected_hits"),
        F.avg("lift").alias("mean_lift"), F.avg("incremental_value").alias("mean_incremental_value"),
    )


def triple_interactions(df: DataFrame, dataset: str, signals: str = "signals", rejected: str = "rejected", min_support: int = 12) -> DataFrame:
    """Signal triples over all signals; a row has as many as its own signals form."""
    kept = labelled(df, rejected).select(dataset, rejected, F.array_sort(signals).alias("s"))
    triples = F.transform(_combinations("s", 3), lambda c: F.array_join(c, "|"))
    per = kept.select(dataset, rejected, F.explode(triples).alias("pattern")).groupBy("pattern", dataset).agg(
        F.count(F.lit(1)).alias("c"), n_if(F.col(rejected) == 1).alias("r")
    )
    out = per.groupBy("pattern").agg(F.sum("c").alias("support"), F.sum("r").alias("rejected_hits"), F.count(F.lit(1)).alias("datasets")).where(F.col("support") >= min_support)
    out = R.attach_row(out, labelled(df, rejected).agg(F.avg(rejected).alias("_base")))
    r = F.col("rejected_hits") / F.col("support")
    candidate = (F.col("rejected_hits") >= 10) & ((F.col("support") - F.col("rejected_hits")) / F.col("support") <= 0.7)
    return out.select(
        "pattern", "support", "rejected_hits", "datasets", F.round(r, 4).alias("reject_rate"), F.round(rate(r, F.col("_base")), 4).alias("lift"),
        F.when(candidate, "candidate").otherwise("hold_for_residual_review").alias("promotion_status"),
    )


def archetypes(df: DataFrame, signals: str = "signals", rejected: str = "rejected") -> DataFrame:
    """Exact signal sets with support, rejection rate and lift."""
    d = labelled(df, rejected)
    out = d.groupBy(F.array_join(F.array_sort(signals), " + ").alias("archetype")).agg(F.count(F.lit(1)).alias("support"), n_if(F.col(rejected) == 1).alias("rejects"))
    out = R.attach_row(out, d.agg(F.avg(rejected).alias("_base")))
    r = F.col("rejects") / F.col("support")
    return out.select("archetype", "support", "rejects", F.round(r, 4).alias("reject_rate"), F.round(rate(r, F.col("_base")), 4).alias("lift"))


def count_thresholds(df: DataFrame, signals: str = "signals", rejected: str = "rejected", top: int = 14) -> DataFrame:
    """Precision, recall and accuracy of "discard when at least N signals fire", for N = 1..top.

    The histogram of counts is small; thresholds are exploded from it, not from the rows.
    """
    hist = labelled(df, rejected).groupBy(F.size(signals).alias("k")).agg(n_if(F.col(rejected) == 1).alias("r"), n_if(F.col(rejected) == 0).alias("a"))
    e = hist.withColumn("threshold", F.explode(F.sequence(F.lit(1), F.lit(top))))
    hit = F.col("k") >= F.col("threshold")
    out = e.groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("r")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("a")).otherwise(0)).alias("fp"), F.sum("r").alias("_r"), F.sum("a").alias("_a")
    )
    return out.select(
        "threshold", "tp", "fp", F.round(rate(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(rate(F.col("tp"), F.col("_r")), 6).alias("recall"),
        F.round((F.col("tp") + F.col("_a") - F.col("fp")) / (F.col("_r") + F.col("_a")), 6).alias("accuracy"),
    )


_PROBS = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def numeric_summary(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Moments, quantiles, MAD, trimmed and winsorised mean per group, exact for groups of any size.

    Two aggregates over the distinct values: one for all that needs only their
    ranks, one, with its results beside every value, for spread and winsorised
    mean; the MAD ranks the distances from the median.
    """
    g = list(groups)
    ensure_checkpoint_dir(df.sparkSession)
    rv = R.ranked_values(df, g, value).checkpoint()  # one row per distinct value; everything below reads this
    n, v = F.col("n"), F.col(value)
    lo = F.floor(F.col("n_total") * 0.05)
    hi = F.greatest(F.floor(F.col("n_total") * 0.95), lo + 1)
    inside = F.greatest(F.least(F.col("n_before") + n, hi) - F.greatest(F.col("n_before"), lo), F.lit(0))
    parts, finished = R.quantile_parts(value, _PROBS)
    first = rv.groupBy(*g).agg(
        F.sum("n").alias("count"), (F.sum(v * n) / F.sum("n")).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.sum(v * inside) / F.sum(inside)).alias("trimmed_mean"), *parts,
    ).select(*g, "count", "mean", "min", "max", "trimmed_mean", *finished).checkpoint()
    both = R.attach_groups(rv.select(*g, value, "n"), first.select(*g, "median", "p05", "p95", "mean"), g, "inner")
    spread = both.groupBy(*g).agg(
        F.when(F.sum("n") > 1, F.sqrt(F.sum((v - F.col("mean")) * (v - F.col("mean")) * n) / (F.sum("n") - 1))).otherwise(0.0).alias("std"),
        (F.sum(F.least(F.greatest(v, F.col("p05")), F.col("p95")) * n) / F.sum("n")).alias("winsorized_mean"),
    )
    mad = R.quantiles_of(R.ranked_values(both.select(*g, F.abs(v - F.col("median")).alias("_dev"), "n"), g, "_dev", count=F.col("n")), g, "_dev", {"mad": 0.5}).drop("n_rows")
    out = first.join(spread, g).join(mad, g)
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def cohen_d(df: DataFrame, groups: Sequence[str], value: str, rejected: str) -> DataFrame:
    """Standardised mean difference, rejected minus accepted, with the mean of both variances."""
    a, b = F.when(F.col(rejected) == 0, F.col(value)), F.when(F.col(rejected) == 1, F.col(value))
    out = df.groupBy(*groups).agg(
        F.avg(a).alias("accepted_mean"), F.avg(b).alias("rejected_mean"), F.coalesce(F.var_samp(a), F.lit(0.0)).alias("_va"), F.coalesce(F.var_samp(b), F.lit(0.0)).alias("_vb")
    )
    pooled = F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    return out.withColumn("cohen_d", F.when(pooled > 0, (F.col("rejected_mean") - F.col("accepted_mean")) / pooled).otherwise(0.0)).drop("_va", "_vb")


def cohen_h(a: Column, b: Column) -> Column:
    clipped = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return 2 * (F.asin(F.sqrt(clipped(a))) - F.asin(F.sqrt(clipped(b))))


def top_values(df: DataFrame, groups: Sequence[str], value: str, k: int = 12) -> DataFrame:
    """The ``k`` most frequent values per group as JSON, and the modal share."""
    g = list(groups)
    counts = df.where(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != "")).groupBy(*g, F.col(value).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy(*g).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct"), (F.max("c") / F.sum("c")).alias("modal_share"))
    w = W.partitionBy(*g).orderBy(F.col("c").desc(), "v")
    top = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*g).agg(
        F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_r", "v", "c"))), lambda x: F.struct(x["v"], x["c"])))).alias("top_values")
    )
    return totals.join(top, g)


def demographic_summary(long_: DataFrame, field: str, value: str, k: int = 8) -> DataFrame:
    """Per field: answered and missing rows, numeric summary where the values are numbers, top values."""
    d = long_.withColumn("_num", F.col(value).try_cast("double"))
    has = F.col(value).isNotNull() & (F.trim(F.col(value)) != "")
    base = d.groupBy(field).agg(
        F.count(F.lit(1)).alias("respondents"), n_if(has).alias("nonempty_rows"), F.avg("_num").alias("mean"), F.min("_num").alias("min"), F.max("_num").alias("max")
    ).withColumn("missing_rows", F.col("respondents") - F.col("nonempty_rows"))
    med = R.quantiles(d, [field], "_num", {"median": 0.5}).drop("n_rows")
    return base.join(med, field, "left").join(top_values(long_, [field], value, k).select(field, "n_distinct", "top_values"), field, "left")


def crosstab(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` x ``col`` with one column per given value, 0 where none."""
    out = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return out.na.fill(0)


def meta_over_datasets(profile: DataFrame, column: str) -> DataFrame:
    """How a column's separation holds over data sets; needs one row per (data set, column)."""
    out = profile.groupBy(column).agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("accepted_n").alias("support"), F.sum("rejected_n").alias("rejected_support"),
        F.avg("univariate_auroc").alias("mean_auroc"), F.max("univariate_auroc").alias("max_auroc"), F.avg("effect_size").alias("mean_effect"), F.stddev_samp("effect_size").alias("heterogeneity"),
    )
    return out.withColumn(
        "transfer_class", F.when(F.col("datasets") >= 5, "cross_dataset").when(F.col("datasets") >= 2, "survey_family_specific").otherwise("survey_specific")
    )


def signal_generalisation(df: DataFrame, dataset: str, signals: str = "signals", rejected: str = "rejected") -> DataFrame:
    """In how many data sets a signal is more frequent among rejected than accepted rows."""
    d = labelled(df, rejected)
    sizes = d.groupBy(dataset).agg(n_if(F.col(rejected) == 1).alias("nr"), n_if(F.col(rejected) == 0).alias("na"))
    hits = d.select(dataset, rejected, F.explode(signals).alias("signal")).groupBy(dataset, "signal").agg(n_if(F.col(rejected) == 1).alias("r"), n_if(F.col(rejected) == 0).alias("a"))
    lift = rate(F.col("r"), F.col("nr")) / F.greatest(rate(F.col("a"), F.col("na")), F.lit(0.001))
    per = hits.join(sizes, dataset).withColumn("lift", lift)
    return per.groupBy("signal").agg(
        F.count(F.lit(1)).alias("appears_in"), F.round(F.avg("lift"), 2).alias("avg_lift"), n_if(F.col("lift") > 2).alias("datasets_with_lift_gt_2"), n_if(F.col("lift") > 5).alias("datasets_with_lift_gt_5")
    )


def family_scores(df: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """Largest member flag per family, and the means over families used as proxies."""
    out = df
    for name, members in families.items():
        cols = [F.col(f"f_{m}") for m in members]
        out = out.withColumn(name, F.greatest(*cols) if len(cols) > 1 else cols[0])
    total = sum(F.col(f) for f in families)
    return out.withColumn("families_fired", total).withColumn("client_reject_proxy", total / F.lit(float(len(families))))


def family_correlation(df: DataFrame, dataset: str, families: dict[str, Sequence[str]], rejected: str = "rejected", min_rows: int = 10) -> DataFrame:
    """Correlation of a family's mean flag with the label per data set, summarised over data sets."""
    d = labelled(df, rejected)
    means = F.array(*[F.struct(F.lit(n).alias("family"), (sum(F.col(f"f_{m}") for m in ms) / F.lit(float(len(ms)))).alias("v")) for n, ms in families.items()])
    long_ = d.select(dataset, rejected, F.explode(means).alias("x")).select(dataset, rejected, "x.family", "x.v")
    y = F.col(rejected).cast("double")
    n = F.count(F.lit(1)).cast("double")
    # correlation from sums: NULL-safe when one side does not vary
    cov = n * F.sum(F.col("v") * y) - F.sum("v") * F.sum(y)
    vx, vy = n * F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.sum("v"), n * F.sum(y * y) - F.sum(y) * F.sum(y)
    per = long_.groupBy(dataset, "family").agg(
        F.sum(y).alias("_r"), F.count(F.lit(1)).alias("_n"), F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy)).otherwise(0.0).alias("c")
    ).where((F.col("_r") >= min_rows) & (F.col("_n") - F.col("_r") >= min_rows))
    # one value per data set and family
    return per.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_datasets"), F.avg("c").alias("mean_correlation"), F.percentile("c", 0.5).alias("median_correlation"), F.stddev_pop("c").alias("std_correlation"),
        F.when(F.avg("c") > 0, "positive").otherwise("negative").alias("direction"),
    )


# --- discard rulebook -----------------------------------------------------------------------------


def rule_hits(df: DataFrame, rules: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """Adds ``rules``: the sorted ids of all rules (id, family, role, condition) that fire."""
    found = F.array_compact(F.array(*[F.when(c, rid) for rid, _, _, c in rules]))
    return df.withColumn("rules", F.array_sort(found))


def rule_evidence(hits: DataFrame, rules: Sequence[tuple[str, str, str, Column]], id_col: str, dataset: str, rejected: str = "rejected", examples: int = 3) -> DataFrame:
    """Per data set and rule: hits by label, rate, observed role and the first examples of each label."""
    d = labelled(hits, rejected)
    e = d.select(dataset, id_col, rejected, F.explode("rules").alias("rule_id"))
    stats = e.groupBy(dataset, "rule_id").agg(n_if(F.col(rejected) == 0).alias("accepted_hits"), n_if(F.col(rejected) == 1).alias("rejected_hits"))
    w = W.partitionBy(dataset, "rule_id", rejected).orderBy(id_col)
    firsts = e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= examples)
    ex = firsts.groupBy(dataset, "rule_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col(rejected) == 1, F.col(id_col)))), ",").alias("rejected_examples"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col(rejected) == 0, F.col(id_col)))), ",").alias("accepted_examples"),
    )
    base = d.groupBy(dataset).agg(F.avg(rejected).alias("dataset_reject_rate"))
    catalog = hits.sparkSession.createDataFrame([(r, f, t) for r, f, t, _ in rules], "rule_id string, family string, rulebook_role string")
    # rules and data sets of a rulebook: the grid below has one row per rule and data set
    grid = base.join(F.broadcast(catalog), F.lit(True))
    out = grid.join(stats, [dataset, "rule_id"], "left").join(ex, [dataset, "rule_id"], "left").na.fill(0, ["accepted_hits", "rejected_hits"]).na.fill("", ["rejected_examples", "accepted_examples"])
    support = F.col("accepted_hits") + F.col("rejected_hits")
    r = rate(F.col("rejected_hits"), support)
    role = (
        F.when(support == 0, "not_observed").when(support < 10, "needs_more_examples")
        .when(r >= F.greatest(F.lit(0.6), F.col("dataset_reject_rate") * 1.75), "candidate_discard_signal")
        .when(r <= F.least(F.lit(0.2), F.col("dataset_reject_rate") * 0.55), "false_positive_guardrail")
        .otherwise(F.col("rulebook_role"))
    )
    return out.select(
        dataset, "rule_id", "family", "rulebook_role", "accepted_hits", "rejected_hits", support.alias("support_rows"), F.round(r, 4).alias("reject_rate_when_rule_fires"),
        F.round("dataset_reject_rate", 4).alias("dataset_reject_rate"), role.alias("observed_role"), "rejected_examples", "accepted_examples",
    )


def quota_cells(df: DataFrame, id_col: str, dims: dict[str, str], row_cells: Sequence[str] = ()) -> DataFrame:
    """Cell membership (quota, value) of every respondent, with the size of the cell."""
    cells = F.array(*[F.struct(F.lit(q).alias("quota"), F.col(c).cast("string").alias("value")) for q, c in dims.items()])
    return df.select(id_col, F.explode(cells).alias("x")).select(id_col, "x.quota", "x.value")


def cell_totals(membership: DataFrame, target_share: float) -> DataFrame:
    """Respondents per cell and whether the cell holds more than ``target_share`` of its quota."""
    counts = membership.groupBy("quota", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("quota").agg(F.sum("n").alias("quota_total"))
    return counts.join(totals, "quota").withColumn("share", F.col("n") / F.col("quota_total")).withColumn("over_filled", (F.col("share") > target_share).cast("int"))


def promotion_specs(evidence: DataFrame) -> DataFrame:
    """Disposition of each rule over all data sets; the base rate is weighted by the rule's support."""
    per = evidence.groupBy("rule_id", "family", "rulebook_role").agg(
        F.sum("accepted_hits").alias("accepted"), F.sum("rejected_hits").alias("rejected"),
        rate(F.sum(F.col("dataset_reject_rate") * F.col("support_rows")), F.sum("support_rows")).alias("base_rate"),
    )
    out = R.attach_row(per, evidence.agg(F.sum("accepted_hits").alias("_all")))
    support = F.col("accepted") + F.col("rejected")
    r = rate(F.col("rejected"), support)
    lift = rate(r, F.col("base_rate"))
    disposition = (
        F.when(support == 0, "unobserved_runtime_question")
        .when((F.col("rulebook_role") == "candidate_discard_signal") & (F.col("rejected") >= 10) & (lift >= 1.5), "promote_to_review_routing_with_tier5_audit")
        .when(F.col("rulebook_role").isin("review_routing", "agent_semantic_rule") | (lift >= 1.1), "hold_for_agent_review")
        .when(F.col("accepted") > F.col("rejected"), "guardrail_or_report_only")
        .otherwise("demote_until_more_evidence")
    )
    return out.select(
        "rule_id", "family", support.alias("support_rows"), "rejected", "accepted", F.round(r, 4).alias("reject_rate_when_present"), F.round(lift, 3).alias("lift_vs_base"),
        F.round(rate(F.col("accepted"), F.greatest(F.col("_all"), F.lit(1))), 4).alias("accepted_exposure"), disposition.alias("disposition"),
    )


def theme_inventory(df: DataFrame, theme: str, id_col: str, merged: str, examples: int = 8) -> DataFrame:
    """One row per theme and different value of ``merged``: rows of the value, and support, share and first example ids of the theme."""
    counts = df.groupBy(theme).agg(F.count(F.lit(1)).alias("support_rows"))
    total = counts.agg(F.greatest(F.sum("support_rows"), F.lit(1)).alias("_t"))
    w = W.partitionBy(theme).orderBy(id_col)
    ids = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= examples).groupBy(theme).agg(F.array_join(F.array_sort(F.collect_list(id_col)), ", ").alias("example_ids"))
    values = df.groupBy(theme, merged).agg(F.count(F.lit(1)).alias("value_rows"))
    per_theme = R.attach_row(counts, total).join(ids, theme).withColumn("support_rate", F.round(F.col("support_rows") / F.col("_t"), 6)).drop("_t")
    return values.join(per_theme, theme)


def criterion_table(df: DataFrame, criteria: str, decision: str, id_col: str) -> DataFrame:
    """Rows per criterion, split by decision, and one sample respondent."""
    e = df.select(id_col, decision, F.explode(criteria).alias("criterion"))
    return e.groupBy("criterion").agg(
        F.count(F.lit(1)).alias("n_rows"), n_if(F.col(decision) == "DISCARD").alias("discards"), n_if(F.col(decision) == "REVIEW").alias("reviews"),
        n_if(F.col(decision) == "KEEP").alias("keeps"), F.min(id_col).alias("sample_id"),
    )


def supplier_dashboard(df: DataFrame, supplier: str, score: str, decision: str, k: int = 15) -> DataFrame:
    return df.groupBy(supplier).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_score"), n_if(F.col(decision) == "DISCARD").alias("discards"), n_if(F.col(decision) == "REVIEW").alias("reviews")
    ).orderBy(F.col("n").desc(), supplier).limit(k)


def score_histogram(df: DataFrame, score: str, lo: float, hi: float, bins: int) -> DataFrame:
    b = F.least(F.greatest(F.floor((F.col(score) - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def historical_priors(profile: DataFrame, dataset: str, measures: Sequence[str], k: int = 2) -> DataFrame:
    """For every data set the ``k`` labelled data sets with the most similar aggregate profile.

    ``profile`` has one row per data set, so comparing all of them is small.
    """
    stats = profile.agg(*[F.stddev_samp(m).alias(f"_s_{m}") for m in measures])
    p = R.attach_row(profile, stats)
    a = p.select(F.col(dataset).alias("target"), *[F.col(m).alias(f"a_{m}") for m in measures], *[f"_s_{m}" for m in measures])
    b = p.where("reject_rate IS NOT NULL").select(F.col(dataset).alias("closest"), F.col("reject_rate").alias("historical_reject_rate"), *[F.col(m).alias(f"b_{m}") for m in measures])
    d2 = sum(F.coalesce(F.try_divide(F.pow(F.col(f"a_{m}") - F.col(f"b_{m}"), F.lit(2)), F.pow(F.col(f"_s_{m}"), F.lit(2))), F.lit(0.0)) for m in measures)
    near = a.join(b, F.col("target") != F.col("closest")).withColumn("distance", F.round(F.sqrt(d2), 6))
    w = W.partitionBy("target").orderBy("distance", "closest")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("target", "closest", "rank", "distance", F.round("historical_reject_rate", 6).alias("historical_reject_rate"))


def reason_tally(df: DataFrame, text: str, families: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """How many texts mention each keyword family."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(*[F.when(t.rlike(p), name) for name, p in families.items()]))
    return df.select(*by, F.explode(found).alias("reason")).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


# --- contrast between rejected rows and their controls --------------------------------------------


def contrastive_pairs(pairs: DataFrame, features: DataFrame, id_col: str) -> DataFrame:
    """Signals only the rejected row has, signals both have, and what protects the control."""
    r = features.select(F.col(id_col).alias("query"), F.col("signals").alias("_rs"), F.col("dataset_id"))
    a = features.select(F.col(id_col).alias("neighbour"), F.col("signals").alias("_as"), F.col("guards").alias("_ag"))
    out = pairs.join(r, "query").join(a, "neighbour")
    return out.select(
        "dataset_id", F.col("query").alias("rejected_id"), F.col("neighbour").alias("accepted_id"), F.col("rank").alias("control_rank"),
        F.array_join(F.array_sort(F.array_except("_rs", "_as")), "|").alias("distinguishing_signals"),
        F.array_join(F.array_sort(F.array_intersect("_rs", "_as")), "|").alias("shared_signals"),
        F.array_join(F.array_sort("_ag"), "|").alias("accepted_guards"),
    )


def guardrail_casebook(contrast: DataFrame) -> DataFrame:
    return contrast.where("accepted_guards <> ''").select("dataset_id", "accepted_id", "shared_signals", "accepted_guards").distinct()


def coordination_clusters(df: DataFrame, dataset: str, signals: str = "signals", rejected: str = "rejected") -> DataFrame:
    e = df.select(dataset, rejected, F.explode(signals).alias("cluster_type"))
    return e.groupBy(dataset, "cluster_type").agg(
        F.count(F.lit(1)).alias("n_rows"), n_if(F.col(rejected) == 1).alias("rejected_rows"), n_if(F.col(rejected) == 0).alias("accepted_rows")
    ).where("n_rows >= 2")
