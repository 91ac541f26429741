"""Metrics of scores and decisions against labels.

Rank-based metrics never sort raw rows in one task: scores are first counted per
distinct value (``ranking.ranked_values``). All curves treat tied scores as one
threshold, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from respondex.functions import lexicons as L
from respondex.functions import ranking as R
from respondex.operators.resampling import DRAW_BITS, DRAW_ROWS, poisson_rows, resampled_sums  # noqa: F401


def div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def status_label(c: Column) -> Column:
    """Client status to label: 5 and reject words -> 1, 3 and accept words -> 0, else NULL; ``5.0`` is 5."""
    t = F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"\.0$", "")
    return F.when((t == "5") | t.isin(*L.REJECT_WORDS), 1).when((t == "3") | t.isin(*L.ACCEPT_WORDS), 0)


def _cells(y: Column, p: Column) -> list[Column]:
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return [n((y == 1) & (p == 1)).alias("tp"), n((y == 0) & (p == 1)).alias("fp"), n((y == 0) & (p == 0)).alias("tn"), n((y == 1) & (p == 0)).alias("fn")]


def from_cells(df: DataFrame) -> DataFrame:
    """All confusion metrics from the columns tp, fp, tn, fn; 0 where a ratio has no base."""
    c = F.col
    tp, fp, tn, fn = c("tp"), c("fp"), c("tn"), c("fn")
    n = tp + fp + tn + fn
    out = df.withColumn("rows", n).withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn)).withColumn("specificity", div(tn, tn + fp)).withColumn("npv", div(tn, tn + fn))
    p, r, s, v = c("precision"), c("recall"), c("specificity"), c("npv")
    out = out.withColumn("f1", div(2 * p * r, p + r)).withColumn("f2", div(5 * p * r, 4 * p + r)).withColumn("keep_f1", div(2 * v * s, v + s))
    d = [x.cast("double") for x in (tp, fp, tn, fn)]
    den = F.sqrt((d[0] + d[1]) * (d[0] + d[3]) * (d[2] + d[1]) * (d[2] + d[3]))
    acc = div(tp + tn, n)
    expected = div(d[0] + d[1], n) * div(d[0] + d[3], n) + div(d[3] + d[2], n) * div(d[1] + d[2], n)
    return (
        out.withColumn("false_positive_rate", div(fp, fp + tn)).withColumn("false_negative_rate", div(fn, fn + tp))
        .withColumn("accuracy", acc).withColumn("balanced_accuracy", (r + s) / 2).withColumn("macro_f1", (c("f1") + c("keep_f1")) / 2)
        .withColumn("mcc", div(d[0] * d[2] - d[1] * d[3], den)).withColumn("cohens_kappa", div(acc - expected, 1 - expected))
    )


METRICS = (
    "precision", "recall", "specificity", "npv", "false_positive_rate", "false_negative_rate", "f1", "f2", "keep_f1", "macro_f1", "balanced_accuracy", "mcc", "cohens_kappa", "accuracy",
)


def confusion(df: DataFrame, label: str, pred: str, by: str | None = None) -> DataFrame:
    """Metrics per group and pooled (group ``POOLED``) from one pass."""
    d = df.where(F.col(label).isNotNull())
    cells = _cells(F.col(label), F.col(pred))
    if by is None:
        return from_cells(d.agg(*cells))
    g = d.rollup(by).agg(F.grouping(by).alias("_g"), *cells)
    g = g.withColumn(by, F.when(F.col("_g") == 1, "POOLED").otherwise(F.col(by))).drop("_g")
    return from_cells(g)


def soft_metrics(df: DataFrame, label: str, judgment: str) -> DataFrame:
    """REVIEW counted as not caught (hard) and as caught (soft, flagged)."""
    y, j = F.col(label), F.col(judgment)
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    out = df.where(y.isNotNull()).agg(
        n((y == 1) & (j == "DISCARD")).alias("tp"), n((y == 0) & (j == "DISCARD")).alias("fp"), n((y == 1) & (j != "DISCARD")).alias("fn"), n((y == 0) & (j != "DISCARD")).alias("tn"),
        n((y == 1) & (j != "KEEP")).alias("soft_tp"), n((y == 1) & (j == "KEEP")).alias("soft_fn"), n((y == 0) & (j != "KEEP")).alias("flagged_fp"), n(j == "REVIEW").alias("reviews"),
    )
    c = F.col
    p, r = div(c("soft_tp"), c("soft_tp") + c("flagged_fp")), div(c("soft_tp"), c("soft_tp") + c("soft_fn"))
    hp, hr = div(c("tp"), c("tp") + c("fp")), div(c("tp"), c("tp") + c("fn"))
    return out.select(
        "*", hp.alias("precision"), hr.alias("recall"), div(2 * hp * hr, hp + hr).alias("f1"), r.alias("soft_recall"), p.alias("flagged_precision"), div(2 * p * r, p + r).alias("flagged_f1"),
    )


def _scored(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    y = F.col(label).cast("long")
    return R.ranked_values(d, groups, score, {"pos": y, "neg": 1 - y})


def auroc(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Probability that a rejected row scores above an accepted one, ties counted half."""
    won = F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg"))).cast("double")
    p, n = F.max("pos_total"), F.max("neg_total")
    return _scored(df, groups, score, label).groupBy(*groups).agg(
        p.alias("n_pos"), n.alias("n_neg"), F.when((p > 0) & (n > 0), won / 2 / (p.cast("double") * n.cast("double"))).alias("auroc")
    )


def average_precision(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Sum over thresholds of recall gained x precision there."""
    tp = F.col("pos_total") - F.col("pos_before")
    flagged = tp + F.col("neg_total") - F.col("neg_before")
    gain = F.col("pos") / F.col("pos_total") * tp / flagged
    return _scored(df, groups, score, label).groupBy(*groups).agg(F.max("pos_total").alias("n_pos"), F.when(F.max("pos_total") > 0, F.sum(gain)).alias("average_precision"))


def curves(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Precision, recall, tpr and fpr when everything at or above a score is flagged, per distinct score."""
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return _scored(df, groups, score, label).select(
        *groups, F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"), div(tp, tp + fp).alias("precision"), div(tp, F.greatest("pos_total", F.lit(1))).alias("recall"),
        div(fp, F.greatest("neg_total", F.lit(1))).alias("fpr"),
    )


def calibration_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate per equal-width bin; empty bins are kept."""
    d = df.where(F.col(label).isNotNull())
    b = (F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)) + 1).cast("int")
    per = d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"), F.avg(label).alias("observed_rate"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(per, "bin", "left").na.fill(0, ["n"]).withColumn("abs_error", F.abs(F.col("mean_predicted") - F.col("observed_rate")))


def calibration_summary(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Brier score, log loss, calibration slope and intercept, expected and largest calibration error."""
    d = df.where(F.col(label).isNotNull())
    y = F.col(label).cast("double")
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.log(p / (1 - p))
    one = d.agg(
        F.avg((p - y) * (p - y)).alias("brier_score"), (-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        F.regr_slope(y, logit).alias("calibration_slope"), F.regr_intercept(y, logit).alias("calibration_intercept"),
    )
    b = calibration_bins(df, score, label, bins)
    err = b.agg(F.sum(F.coalesce(F.col("abs_error"), F.lit(0.0)) * F.col("n")).alias("_e"), F.sum("n").alias("_n"), F.max("abs_error").alias("maximum_calibration_error"))
    return one.crossJoin(F.broadcast(err)).withColumn("expected_calibration_error", F.col("_e") / F.col("_n")).drop("_e", "_n")


COVERAGE = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.25, 0.33, 0.50)


def coverage_curve(df: DataFrame, score: str, label: str, uncertainty: str, id_col: str, shares: Sequence[float] = COVERAGE) -> DataFrame:
    """What is caught when the top share of rows is reviewed; ties in score go by id.

    Positions come from ``ranking.positions``; each row is then counted once, at
    the smallest share that reaches it, and shares are summed up over nine rows.
    """
    d = df.where(F.col(label).isNotNull()).select(id_col, score, label, uncertainty)
    ranked = R.positions(d, [], score, id_col, descending=True, out="_pos")
    total = d.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))
    ranked = R.attach_row(ranked, total)
    cut = [F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(s))) for s in shares]
    level = None
    for i, k in enumerate(cut):
        level = F.when(F.col("_pos") <= k, i) if level is None else level.when(F.col("_pos") <= k, i)
    per = ranked.withColumn("_l", level).where("_l IS NOT NULL").groupBy("_l").agg(
        F.count(F.lit(1)).alias("c"), F.sum(label).alias("tp"), F.sum(1 - F.col(uncertainty)).alias("conf")
    )
    grid = per.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "_l int, review_coverage double")
    w = W.orderBy("_l").rowsBetween(W.unboundedPreceding, 0)  # as many rows as there are shares
    cum = grid.join(per, "_l", "left").na.fill(0, ["c", "tp", "conf"]).select("review_coverage", F.sum("c").over(w).alias("reviewed_rows"), F.sum("tp").over(w).alias("tp"), F.sum("conf").over(w).alias("conf"))
    cum = R.attach_row(cum, total)
    prec = div(F.col("tp"), F.col("reviewed_rows"))
    return cum.select(
        "review_coverage", "reviewed_rows", prec.alias("reject_precision"), div(F.col("tp"), F.greatest("_p", F.lit(1))).alias("reject_recall"),
        div(prec, div(F.col("_p"), F.col("_n"))).alias("lift_over_prevalence"), (F.col("reviewed_rows") - F.col("tp")).alias("accepted_review_burden"), div(F.col("conf"), F.col("reviewed_rows")).alias("mean_confidence"),
    )


def tier_cutoffs(df: DataFrame, tier_n: str, label: str, cutoffs: dict[str, int]) -> DataFrame:
    """Metrics of "flag tier k and above", from the counts per tier."""
    per = df.where(F.col(label).isNotNull()).groupBy(F.col(tier_n).alias("t")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    cells = F.array(*[F.struct(F.lit(name).alias("cutoff"), F.lit(k).alias("k")) for name, k in cutoffs.items()])
    e = per.withColumn("x", F.explode(cells))
    hit = F.col("t") >= F.col("x.k")
    out = e.groupBy(F.col("x.cutoff").alias("cutoff")).agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("tn"), F.sum(F.when(~hit, F.col("p")).otherwise(0)).alias("fn")
    )
    out = from_cells(out)
    vol = F.col("tp") + F.col("fp")
    return out.withColumn("review_volume", vol).withColumn("review_share", div(vol, F.col("rows"))).withColumn("reject_capture_per_100_reviewed", 100 * div(F.col("tp"), F.greatest(vol, F.lit(1))))


def signal_accuracy(df: DataFrame, signals: str, label: str) -> DataFrame:
    d = df.where(F.col(label).isNotNull())
    total = d.agg(F.sum(label).alias("_p"))
    e = d.select(label, F.explode(signals).alias("signal_family")).groupBy("signal_family").agg(F.count(F.lit(1)).alias("activation_count"), F.sum(label).alias("rejected_count"))
    return R.attach_row(e, total).select(
        "signal_family", "activation_count", (F.col("activation_count") - F.col("rejected_count")).alias("accepted_count"), "rejected_count",
        div(F.col("rejected_count"), F.col("activation_count")).alias("reject_precision_when_active"), div(F.col("rejected_count"), F.greatest("_p", F.lit(1))).alias("reject_recall_capture"),
    )


def subgroup_accuracy(df: DataFrame, label: str, score: str, uncertainty: str, coverage: str, open_signal: Column, min_rows: int = 25) -> DataFrame:
    """Cohorts split at the median (high uncertainty, low coverage) and rows with an open-text signal."""
    d = df.where(F.col(label).isNotNull()).withColumn("_o", open_signal)
    m = R.quantiles(d, [], uncertainty, {"_mu": 0.5}).drop("n_rows").crossJoin(F.broadcast(R.quantiles(d, [], coverage, {"_mc": 0.5}).drop("n_rows")))
    d = R.attach_row(d, m)
    cohorts = F.array_compact(
        F.array(
            F.when(F.col(uncertainty) >= F.col("_mu"), "uncertainty_high"), F.when(F.col(coverage) < F.col("_mc"), "question_contract_coverage_low"), F.when(F.col("_o"), "open_signal_active"),
        )
    )
    return d.select(label, score, F.explode(cohorts).alias("cohort")).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("reject_rate"), F.avg(score).alias("mean_score")).where(F.col("n") >= min_rows)


def error_ledger(df: DataFrame, label: str, tier_n: str) -> DataFrame:
    y, t = F.col(label), F.col(tier_n)
    cat = F.when((t >= 5) & (y == 0), "false_positive_tier5").when((t < 5) & (y == 1), "false_negative_tier5").otherwise("agreement_or_lower_priority")
    kind = (
        F.when((y == 1) & (t <= 2), "blind_miss").when((y == 0) & (t >= 4), "false_exclude_risk").when((y == 1) & (t >= 4), "aligned_high_risk").when((y == 0) & (t <= 2), "aligned_keep").otherwise("review_band")
    )
    return df.where(y.isNotNull()).withColumn("error_category", cat).withColumn("disagreement_type", kind).where((t >= 4) | (y == 1))


def hash_score(id_col: str, salt: str) -> Column:
    """A reproducible uniform number in [0, 1) from the id: the baseline that knows nothing."""
    return F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def baselines(df: DataFrame, label: str, scores: dict[str, Column]) -> DataFrame:
    """AUROC, average precision and Brier score of several scores side by side."""
    cells = F.array(*[F.struct(F.lit(n).alias("baseline"), c.cast("double").alias("s")) for n, c in scores.items()])
    long_ = df.where(F.col(label).isNotNull()).select(label, F.explode(cells).alias("x")).select(label, "x.baseline", "x.s")
    brier = long_.groupBy("baseline").agg(F.avg(F.pow(F.least(F.greatest(F.col("s"), F.lit(0.0)), F.lit(1.0)) - F.col(label), F.lit(2))).alias("brier_score"))
    a = auroc(long_, ["baseline"], "s", label).select("baseline", "auroc")
    p = average_precision(long_, ["baseline"], "s", label).select("baseline", F.col("average_precision").alias("auprc"))
    return a.join(p, "baseline").join(brier, "baseline")


def agreement(df: DataFrame, left: str, right: str, order: dict[str, int]) -> DataFrame:
    """Exact agreement, Cohen's kappa over any number of classes, ordinal distance and direction of escalation."""
    d = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    counts = d.groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count(F.lit(1)).alias("c"))
    lm = counts.groupBy(F.col("l").alias("k")).agg(F.sum("c").alias("cl"))
    rm = counts.groupBy(F.col("r").alias("k")).agg(F.sum("c").alias("cr"))
    chance = lm.join(rm, "k").agg(F.sum(F.col("cl").cast("double") * F.col("cr")).alias("_x"))
    rank = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in order.items()])
    diff = rank(F.col("l")) - rank(F.col("r"))
    one = counts.agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("l") == F.col("r"), F.col("c")).otherwise(0)).alias("_same"), F.sum(F.when(diff.isNotNull(), F.col("c")).otherwise(0)).alias("comparable_rows"),
        F.sum(F.abs(diff) * F.col("c")).alias("_dist"), F.max(F.abs(diff)).alias("max_action_distance"), F.sum(F.when(diff > 0, F.col("c")).otherwise(0)).alias("over_escalation_rows"), F.sum(F.when(diff < 0, F.col("c")).otherwise(0)).alias("under_escalation_rows"),
    )
    out = R.attach_row(one, chance)
    po, pe = F.col("_same") / F.col("n"), F.col("_x") / (F.col("n").cast("double") * F.col("n"))
    return out.select(
        "n", po.alias("exact_agreement"), F.when(pe == 1, F.when(po == 1, 1.0)).otherwise((po - pe) / (1 - pe)).alias("cohen_kappa"), "comparable_rows",
        (F.col("_dist") / F.col("comparable_rows")).alias("mean_action_distance"), "max_action_distance", "over_escalation_rows", "under_escalation_rows",
    )


def version_deltas(df: DataFrame, version: str, metrics: Sequence[str], targets: dict[str, float]) -> DataFrame:
    """Change of every metric from one version to the next, and the gap to its target; one row per version."""
    w = W.orderBy(version)
    out = df
    for m in metrics:
        out = out.withColumn(f"{m}_delta", F.col(m) - F.lag(m).over(w)).withColumn(f"{m}_gap", F.lit(targets[m]) - F.col(m))
    return out


def poisson_table(spark: SparkSession, most: int = DRAW_ROWS) -> DataFrame:
    """The rows of ``poisson_rows`` as a table."""
    return spark.createDataFrame(poisson_rows(most), "m int, cdf array<double>")


def bootstrap(df: DataFrame, score: str, label: str, pred: str, resamples: int = 400, seed: int = 2607) -> DataFrame:
    """95 % intervals of the metrics from Poisson resampling.

    Giving every row a Poisson(1) weight gives a group of n equal rows a
    Poisson(n) weight, so rows are counted per (score, label, prediction) first
    and only those cells are resampled. A draw inverts the Poisson distribution
    at a number that is the digest of (cell, part of the cell, resample, seed):
    it depends on nothing else, and any engine with MD5 draws the same.
    """
    sums = resampled_sums(df.where(F.col(label).isNotNull()), F.round(score, 6), F.col(label).cast("int"), F.col(pred).cast("int"), resamples, seed)
    pairs = F.col("pos").cast("double") * F.col("neg")
    ranks = sums.withColumn("auroc", F.try_divide(F.col("won").cast("double") / 2, pairs)).withColumn("auprc", F.when(F.col("pos") > 0, F.col("gain")))
    names = ["accuracy", "balanced_accuracy", "precision", "recall", "macro_f1", "mcc", "auroc", "auprc"]
    m = from_cells(ranks).unpivot(["rep"], names, "metric", "v")
    # one value per resample and metric
    return m.groupBy("metric").agg(F.percentile("v", 0.025).alias("ci_low"), F.percentile("v", 0.975).alias("ci_high"), F.avg("v").alias("mean"))


def ablation(df: DataFrame, label: str, score: str, parts: dict[str, Column]) -> DataFrame:
    """AUROC and average precision after adding ``parts[name]`` to the score (removing a signal or guard)."""
    cells = F.array(F.struct(F.lit("none").alias("removed"), F.col(score).alias("s")), *[F.struct(F.lit(n).alias("removed"), F.round(F.col(score) + c, 9).alias("s")) for n, c in parts.items()])
    long_ = df.where(F.col(label).isNotNull()).select(label, F.explode(cells).alias("x")).select(label, "x.removed", "x.s")
    a = auroc(long_, ["removed"], "s", label).select("removed", "auroc")
    return a.join(average_precision(long_, ["removed"], "s", label).select("removed", "average_precision"), "removed")


def counterexample_matrix(df: DataFrame, signals: str, guards: str, label: str) -> DataFrame:
    """Accepted and rejected rows where a signal and a guardrail hold together."""
    d = df.where(F.col(label).isNotNull())
    e = d.select(label, F.explode(signals).alias("signal"), guards).select(label, "signal", F.explode(guards).alias("guardrail"))
    return e.groupBy("signal", "guardrail").agg(F.sum(1 - F.col(label)).alias("accepted_counterexamples"), F.sum(label).alias("rejected_examples"))


def error_contrast(df: DataFrame, outcome: str, fields: Sequence[str]) -> DataFrame:
    """Value shares of each field among missed rejects (FN) and correct keeps (TN)."""
    d = df.where(F.col(outcome).isin("FN", "TN"))
    long_ = d.select(outcome, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([outcome], list(fields), "field", "value")
    c = long_.groupBy("field", "value").pivot(outcome, ["FN", "TN"]).agg(F.count(F.lit(1))).na.fill(0)
    sizes = c.groupBy("field").agg(F.sum("FN").alias("nf"), F.sum("TN").alias("nt"))
    out = c.join(sizes, "field").withColumn("fn_share", div(F.col("FN"), F.col("nf"))).withColumn("tn_share", div(F.col("TN"), F.col("nt")))
    return out.select("field", "value", F.col("FN").alias("fn_rows"), F.col("TN").alias("tn_rows"), "fn_share", "tn_share", (F.col("fn_share") - F.col("tn_share")).alias("difference"))


def threshold_sweep(df: DataFrame, score: str, label: str, grid: Sequence[float], by: str | None = None) -> DataFrame:
    """F1, balanced accuracy and macro F1 at every threshold of a grid, for the score and its inverse.

    Scores are reduced to the number of grid points they reach before anything
    is multiplied by the grid. Use a validation frame only.
    """
    d = df.where(F.col(label).isNotNull())
    g = F.array(*[F.lit(float(x)) for x in grid])
    keys = [by] if by else []
    both = F.array(F.struct(F.lit(0).alias("inverted"), F.col(score).alias("s")), F.struct(F.lit(1).alias("inverted"), F.round(1 - F.col(score), 9).alias("s")))
    hist = (
        d.select(*keys, label, F.explode(both).alias("x")).select(*keys, label, "x.inverted", F.size(F.filter(g, lambda t: t <= F.col("x.s"))).alias("reached"))
        .groupBy(*keys, "inverted", "reached").agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    )
    e = hist.select("*", F.posexplode(g).alias("i", "threshold"))
    hit = F.col("reached") > F.col("i")
    cells = e.groupBy(*keys, "inverted", "threshold").agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("tn"), F.sum(F.when(~hit, F.col("p")).otherwise(0)).alias("fn")
    )
    return from_cells(cells)


def best_threshold(sweep: DataFrame, metric: str, by: str | None = None) -> DataFrame:
    """Best grid point by ``metric``; ties go to the threshold nearest 0.5, then to the lower one, then not inverted."""
    keys = [by] if by else []
    pick = F.struct(F.round(metric, 9).alias("m"), F.round(-F.abs(F.col("threshold") - 0.5), 9).alias("d"), (-F.col("threshold")).alias("t"), (1 - F.col("inverted")).alias("i"))
    out = sweep.groupBy(*keys).agg(F.max_by(F.struct("threshold", "inverted", metric), pick).alias("b"))
    return out.select(*keys, "b.threshold", "b.inverted", F.col(f"b.{metric}").alias(metric))


def selective_thresholds(df: DataFrame, score: str, label: str, discard_grid: Sequence[float], keep_grid: Sequence[float], penalty: float = 0.15, min_accuracy: float = 0.0) -> DataFrame:
    """Best pair (discard at or above, keep at or below) by F1 minus ``penalty`` x review rate.

    Rows between the two are guessed at 0.5. The grid pairs meet the score
    histogram, not the rows.
    """
    d = df.where(F.col(label).isNotNull()).groupBy(F.round(score, 6).alias("s")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    pairs = [(float(a), float(b)) for a in discard_grid for b in keep_grid if b < a]
    e = d.withColumn("x", F.explode(F.array(*[F.struct(F.lit(a).alias("dt"), F.lit(b).alias("kt")) for a, b in pairs])))
    s, dt, kt = F.col("s"), F.col("x.dt"), F.col("x.kt")
    review = (s > kt) & (s < dt)
    flag = (s >= dt) | (review & (s >= 0.5))
    cells = e.groupBy(dt.alias("discard_threshold"), kt.alias("keep_threshold")).agg(
        F.sum(F.when(flag, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(flag, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~flag, F.col("n")).otherwise(0)).alias("tn"), F.sum(F.when(~flag, F.col("p")).otherwise(0)).alias("fn"),
        F.sum(F.when(review, F.col("p") + F.col("n")).otherwise(0)).alias("review_rows"),
    )
    m = from_cells(cells).withColumn("review_rate", div(F.col("review_rows"), F.col("rows")))
    m = m.where(F.col("accuracy") >= min_accuracy).withColumn("objective", F.round(F.col("f1") - penalty * F.col("review_rate"), 9))
    return m.select("discard_threshold", "keep_threshold", "objective", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"), F.round("review_rate", 6).alias("review_rate")).orderBy(
        F.col("objective").desc(), "discard_threshold", "keep_threshold"
    ).limit(1)


# fixed values: what every gate must reach before a run counts as finished
GATES = (("accuracy", 0.99, True), ("balanced_accuracy", 0.98, False), ("macro_f1", 0.98, False), ("recall", 0.97, False), ("precision", 0.97, False), ("mcc", 0.95, False))


def terminal_state(metrics: DataFrame, dataset: str) -> DataFrame:
    """TARGET_MET only when the pooled metrics and the worst data set pass every gate."""
    pooled = metrics.where(F.col(dataset) == "POOLED").select(*[F.col(m).alias(f"pooled_{m}") for m, _, _ in GATES])
    worst = metrics.where(F.col(dataset) != "POOLED").agg(F.min("accuracy").alias("worst_accuracy"), F.min("recall").alias("worst_recall"))
    ok = (F.col("worst_accuracy") >= 0.97) & (F.col("worst_recall") >= 0.90)
    for m, v, strict in GATES:
        ok = ok & ((F.col(f"pooled_{m}") > v) if strict else (F.col(f"pooled_{m}") >= v))
    return R.attach_row(pooled, worst).withColumn("terminal_state", F.when(ok, "TARGET_MET").otherwise("IMPROVING_NOT_MET"))


def annotation_validation(clients: DataFrame, reviewed: DataFrame, discarded: DataFrame, id_col: str, families: str, sample: int = 12) -> DataFrame:
    """Per client flag family: rows, reviewed, discarded, coverage, and the first missed ids."""
    d = clients.join(reviewed.select(id_col).withColumn("_r", F.lit(1)), id_col, "left").join(discarded.select(id_col).withColumn("_d", F.lit(1)), id_col, "left")
    e = d.select(id_col, "_r", "_d", F.explode(families).alias("family"))
    stats = e.groupBy("family").agg(F.count(F.lit(1)).alias("client_rows"), F.count("_r").alias("reviewed"), F.count("_d").alias("discarded"))
    w = W.partitionBy("family").orderBy(id_col)
    missed = (
        e.where("_r IS NULL").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sample)
        .groupBy("family").agg(F.array_join(F.array_sort(F.collect_list(id_col)), ",").alias("missed_sample"))
    )
    return stats.join(missed, "family", "left").withColumn("review_coverage", div(F.col("reviewed"), F.col("client_rows"))).withColumn("missed_sample", F.coalesce("missed_sample", F.lit("")))


def validation_notes(action: Column, flagged: Column, rejected: Column, reviewed: Column, discarded: Column) -> Column:
    return (
        F.when(discarded & (action == "Keep"), "discard conflicts with client keep")
        .when(rejected & ~reviewed & ~discarded, "client rejected, not reviewed")
        .when(action.isin("Light review", "Review closely") & ~reviewed, "client routed to review, not reviewed")
        .when(flagged & ~reviewed, "client flagged, not reviewed")
        .when((action == "Keep") & reviewed, "reviewed although client accepted")
        .when(reviewed, "reviewed")
        .otherwise("no discrepancy")
    )


def distribution_shift(df: DataFrame, dataset: str, score: str, tier: str, coverage: str) -> DataFrame:
    """Means, tier mix and population stability index of each data set against all others together."""
    means = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(coverage).alias("mean_coverage"))
    mix = df.groupBy(dataset, tier).agg(F.count(F.lit(1)).alias("c"))
    allmix = mix.groupBy(tier).agg(F.sum("c").alias("ct"))
    total = mix.agg(F.sum("c").alias("nt"))
    sets = means.select(dataset, "n")
    # (data sets x tiers) rows: every data set meets every tier, also one it never has
    grid = R.attach_row(sets.join(F.broadcast(allmix), F.lit(True)), total).join(mix, [dataset, tier], "left").na.fill(0, ["c"])
    p = F.greatest(F.col("c") / F.col("n"), F.lit(1e-4))
    q = F.greatest(F.try_divide(F.col("ct") - F.col("c"), F.col("nt") - F.col("n")), F.lit(1e-4))
    psi = grid.groupBy(dataset).agg(F.sum((p - q) * F.log(p / q)).alias("psi"))
    return means.join(psi, dataset)
