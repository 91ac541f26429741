"""Queries over metrics of scores and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.operators import evaluation as E
from respondex.operators import lift as D
from respondex.operators import scoring as S
from respondex.operators import signals as G
from respondex.plans.catalog import query
from respondex.plans.lift_queries import DEC, with_decision
from respondex.plans.scoring_queries import CONV, reassessed
from respondex.plans.study import SCORED, client_labels, scored_frame

LAB = f"WITH {SCORED}, lab AS (SELECT *, CAST(score >= 0.3 AS INTEGER) AS pred FROM scored WHERE rejected IS NOT NULL)"


def labelled(spark, sf):
    s = D.labelled(scored_frame(spark, sf))
    return s.withColumn("pred", (F.col("score") >= 0.3).cast("int")).withColumn("tier_n", G.tier_number(F.col("operational_tier")))


def rounded(df, names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


def dv(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


def cells_sql(src: str, by: str, pred: str = "pred") -> str:
    return f"SELECT {by}, count(*) FILTER (rejected = 1 AND {pred} = 1) AS tp, count(*) FILTER (rejected = 0 AND {pred} = 1) AS fp, count(*) FILTER (rejected = 0 AND {pred} = 0) AS tn, count(*) FILTER (rejected = 1 AND {pred} = 0) AS fn FROM {src}"


def metrics_sql(cells: str, keys: str) -> str:
    """From a relation with tp, fp, tn, fn to all metrics, unrounded."""
    return f"""m1_{cells} AS (SELECT *, tp + fp + tn + fn AS rows, {dv('tp', 'tp + fp')} AS p, {dv('tp', 'tp + fn')} AS r, {dv('tn', 'tn + fp')} AS s, {dv('tn', 'tn + fn')} AS v, {dv('fp', 'fp + tn')} AS fpr, {dv('fn', 'fn + tp')} AS fnr,
      sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE) AS den, {dv('tp + tn', 'tp + fp + tn + fn')} AS acc FROM {cells}),
    m2_{cells} AS (SELECT *, {dv('2 * p * r', 'p + r')} AS f1, {dv('5 * p * r', '4 * p + r')} AS f2, {dv('2 * v * s', 'v + s')} AS kf1, CASE WHEN rows = 0 THEN 0 ELSE ((tp + fp)::DOUBLE / rows) * ((tp + fn)::DOUBLE / rows) + ((fn + tn)::DOUBLE / rows) * ((fp + tn)::DOUBLE / rows) END AS pe FROM m1_{cells}),
    m_{cells} AS (SELECT {keys}, tp, fp, tn, fn, rows, p AS precision, r AS recall, s AS specificity, v AS npv, fpr AS false_positive_rate, fnr AS false_negative_rate, f1, f2, kf1 AS keep_f1, (f1 + kf1) / 2 AS macro_f1, (r + s) / 2 AS balanced_accuracy,
      {dv('tp::DOUBLE * tn - fp::DOUBLE * fn', 'den')} AS mcc, {dv('acc - pe', '1 - pe')} AS cohens_kappa, acc AS accuracy FROM m2_{cells})"""


ROUND = ", ".join(f"round({m}, 6) AS {m}" for m in E.METRICS)


@query(
    "e01_confusion_metrics",
    f"""{LAB}, c AS ({cells_sql('lab', "CASE WHEN grouping(dataset_id) = 1 THEN 'POOLED' ELSE dataset_id END AS dataset_id")} GROUP BY ROLLUP (lab.dataset_id)), {metrics_sql('c', 'dataset_id')} SELECT dataset_id, tp, fp, tn, fn, rows, {ROUND} FROM m_c""",
)
def e01(spark, sf):
    return rounded(E.confusion(labelled(spark, sf), "rejected", "pred", "dataset_id"), E.METRICS)


@query(
    "e02_soft_metrics",
    f"""WITH {CONV}, l AS (SELECT * FROM ra WHERE rejected IS NOT NULL), n AS (SELECT count(*) FILTER (rejected = 1 AND judgment = 'DISCARD') AS tp, count(*) FILTER (rejected = 0 AND judgment = 'DISCARD') AS fp, count(*) FILTER (rejected = 1 AND judgment <> 'DISCARD') AS fn, count(*) FILTER (rejected = 0 AND judgment <> 'DISCARD') AS tn,
      count(*) FILTER (rejected = 1 AND judgment <> 'KEEP') AS soft_tp, count(*) FILTER (rejected = 1 AND judgment = 'KEEP') AS soft_fn, count(*) FILTER (rejected = 0 AND judgment <> 'KEEP') AS flagged_fp, count(*) FILTER (judgment = 'REVIEW') AS reviews FROM l),
    m AS (SELECT *, {dv('tp', 'tp + fp')} AS hp, {dv('tp', 'tp + fn')} AS hr, {dv('soft_tp', 'soft_tp + soft_fn')} AS sr, {dv('soft_tp', 'soft_tp + flagged_fp')} AS sp FROM n)
    SELECT tp, fp, fn, tn, soft_tp, soft_fn, flagged_fp, reviews, round(hp, 6) AS precision, round(hr, 6) AS recall, round({dv('2 * hp * hr', 'hp + hr')}, 6) AS f1, round(sr, 6) AS soft_recall, round(sp, 6) AS flagged_precision, round({dv('2 * sp * sr', 'sp + sr')}, 6) AS flagged_f1 FROM m""",
)
def e02(spark, sf):
    out = E.soft_metrics(reassessed(spark, sf), "rejected", "judgment")
    return rounded(out, ("precision", "recall", "f1", "soft_recall", "flagged_precision", "flagged_f1"))


PAIR_AUC = "sum(CASE WHEN x.score > y.score THEN 1.0::DOUBLE WHEN x.score = y.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*)"


@query(
    "e03_auroc",
    f"""{LAB}, n AS (SELECT dataset_id, count(*) FILTER (rejected = 1) AS n_pos, count(*) FILTER (rejected = 0) AS n_neg FROM lab GROUP BY 1), a AS (SELECT x.dataset_id, {PAIR_AUC} AS auc FROM lab x JOIN lab y ON x.dataset_id = y.dataset_id AND x.rejected = 1 AND y.rejected = 0 GROUP BY 1)
    SELECT dataset_id, n_pos, n_neg, round(auc, 6) AS auroc FROM n LEFT JOIN a USING (dataset_id)""",
)
def e03(spark, sf):
    return rounded(E.auroc(labelled(spark, sf), ["dataset_id"], "score", "rejected"), ["auroc"])


CURVE = """cu AS (SELECT score AS threshold, sum(sum(rejected)) OVER (ORDER BY score DESC) AS tp, sum(sum(1 - rejected)) OVER (ORDER BY score DESC) AS fp, sum(rejected) AS pos FROM lab GROUP BY score), tt AS (SELECT sum(rejected) AS p, sum(1 - rejected) AS n FROM lab)"""


@query("e04_average_precision", f"{LAB}, {CURVE} SELECT CAST(p AS BIGINT) AS n_pos, round(sum(pos / p::DOUBLE * (tp / (tp + fp)::DOUBLE)), 6) AS average_precision FROM cu, tt GROUP BY p")
def e04(spark, sf):
    return rounded(E.average_precision(labelled(spark, sf), [], "score", "rejected"), ["average_precision"])


@query("e05_pr_and_roc_points", f"{LAB}, {CURVE} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / p::DOUBLE, 6) AS recall, round(fp / n::DOUBLE, 6) AS fpr FROM cu, tt")
def e05(spark, sf):
    return rounded(E.curves(labelled(spark, sf), [], "score", "rejected"), ["precision", "recall", "fpr"])


BINS = "b AS (SELECT CAST(least(floor(score * 10), 9) + 1 AS INTEGER) AS bin, count(*) AS n, avg(score) AS mp, avg(rejected) AS o FROM lab GROUP BY 1)"


@query("e06_calibration_bins", f"{LAB}, {BINS} SELECT CAST(g.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_predicted, round(o, 6) AS observed_rate, round(abs(mp - o), 6) AS abs_error FROM (SELECT unnest(range(1, 11)) AS bin) g LEFT JOIN b ON b.bin = g.bin")
def e06(spark, sf):
    return rounded(E.calibration_bins(labelled(spark, sf), "score", "rejected"), ["mean_predicted", "observed_rate", "abs_error"])


@query(
    "e06_calibration_summary",
    f"""{LAB}, {BINS}, c AS (SELECT least(greatest(score, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p, rejected::DOUBLE AS y FROM lab), o AS (SELECT avg((p - y) * (p - y)) AS br, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS ll, regr_slope(y, ln(p / (1 - p))) AS sl, regr_intercept(y, ln(p / (1 - p))) AS ic FROM c), e AS (SELECT sum(abs(mp - o) * n) / sum(n) AS ece, max(abs(mp - o)) AS mce FROM b)
    SELECT round(br, 6) AS brier_score, round(ll, 6) AS log_loss, round(sl, 6) AS calibration_slope, round(ic, 6) AS calibration_intercept, round(mce, 6) AS maximum_calibration_error, round(ece, 6) AS expected_calibration_error FROM o, e""",
)
def e06b(spark, sf):
    out = E.calibration_summary(labelled(spark, sf), "score", "rejected")
    return rounded(out, out.columns)


@query(
    "e07_review_coverage_curve",
    f"""{LAB}, r AS (SELECT rejected, model_uncertainty AS u, row_number() OVER (ORDER BY score DESC, respondent_id) AS pos, count(*) OVER () AS n, sum(rejected) OVER () AS p FROM lab), s AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.33, 0.5])::DOUBLE AS pct),
    g AS (SELECT pct, count(*) AS k, sum(rejected) AS tp, avg(1 - u) AS c, max(n) AS n, max(p) AS p FROM r, s WHERE pos <= greatest(1, ceil(n * pct)) GROUP BY 1)
    SELECT pct AS review_coverage, k AS reviewed_rows, round(tp / k::DOUBLE, 6) AS reject_precision, round(tp / p::DOUBLE, 6) AS reject_recall, round((tp / k::DOUBLE) / (p / n::DOUBLE), 6) AS lift_over_prevalence, CAST(k - tp AS BIGINT) AS accepted_review_burden, round(c, 6) AS mean_confidence FROM g""",
)
def e07(spark, sf):
    out = E.coverage_curve(labelled(spark, sf), "score", "rejected", "model_uncertainty", "respondent_id")
    return rounded(out, ["reject_precision", "reject_recall", "lift_over_prevalence", "mean_confidence"])


CUTS = {"Tier 5": 5, "Tiers 4-5": 4, "Tiers 3-5": 3, "Tiers 2-5": 2}


@query(
    "e08_tier_cutoffs",
    f"""{LAB}, k AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {v})" for n, v in CUTS.items())}) v(cutoff, k)), x AS (SELECT cutoff, rejected, CAST(tier_n >= k AS INTEGER) AS pr FROM lab, k), c AS ({cells_sql('x', 'cutoff', 'pr')} GROUP BY cutoff), {metrics_sql('c', 'cutoff')}
    SELECT cutoff, tp, fp, tn, fn, rows, {ROUND}, tp + fp AS review_volume, round((tp + fp) / rows::DOUBLE, 6) AS review_share, round(100 * tp / greatest(tp + fp, 1)::DOUBLE, 6) AS reject_capture_per_100_reviewed FROM m_c""",
)
def e08(spark, sf):
    out = E.tier_cutoffs(labelled(spark, sf), "tier_n", "rejected", CUTS)
    return rounded(out, [*E.METRICS, "review_share", "reject_capture_per_100_reviewed"])


@query(
    "e09_signal_family_accuracy",
    f"""{LAB}, e AS (SELECT rejected, unnest(signals) AS signal_family FROM lab) SELECT signal_family, count(*) AS activation_count, count(*) FILTER (rejected = 0) AS accepted_count, count(*) FILTER (rejected = 1) AS rejected_count, round(avg(rejected), 6) AS reject_precision_when_active, round(sum(rejected) / (SELECT sum(rejected) FROM lab)::DOUBLE, 6) AS reject_recall_capture FROM e GROUP BY 1""",
)
def e09(spark, sf):
    out = E.signal_accuracy(labelled(spark, sf), "signals", "rejected").withColumn("accepted_count", F.col("accepted_count").cast("long")).withColumn("rejected_count", F.col("rejected_count").cast("long"))
    return rounded(out, ["reject_precision_when_active", "reject_recall_capture"])


@query(
    "e10_subgroup_accuracy",
    f"""{LAB}, m AS (SELECT quantile_cont(model_uncertainty, 0.5) AS mu, quantile_cont(unique_token_ratio, 0.5) AS mc FROM lab), u AS (SELECT 'uncertainty_high' AS cohort, rejected, score FROM lab, m WHERE model_uncertainty >= mu UNION ALL SELECT 'question_contract_coverage_low', rejected, score FROM lab, m WHERE unique_token_ratio < mc
      UNION ALL SELECT 'open_signal_active', rejected, score FROM lab WHERE f_open_generic = 1 OR f_template_cluster = 1) SELECT cohort, count(*) AS n, round(avg(rejected), 6) AS reject_rate, round(avg(score), 6) AS mean_score FROM u GROUP BY 1 HAVING count(*) >= 25""",
)
def e10(spark, sf):
    signal = (F.col("f_open_generic") == 1) | (F.col("f_template_cluster") == 1)
    return rounded(E.subgroup_accuracy(labelled(spark, sf), "rejected", "score", "model_uncertainty", "unique_token_ratio", signal), ["reject_rate", "mean_score"])


@query(
    "e11_error_ledger",
    f"""{LAB} SELECT respondent_id, rejected, score, operational_tier, array_to_string(signals, '|') AS signals, CASE WHEN tier_n >= 5 AND rejected = 0 THEN 'false_positive_tier5' WHEN tier_n < 5 AND rejected = 1 THEN 'false_negative_tier5' ELSE 'agreement_or_lower_priority' END AS error_category,
    CASE WHEN rejected = 1 AND tier_n <= 2 THEN 'blind_miss' WHEN rejected = 0 AND tier_n >= 4 THEN 'false_exclude_risk' WHEN rejected = 1 AND tier_n >= 4 THEN 'aligned_high_risk' WHEN rejected = 0 AND tier_n <= 2 THEN 'aligned_keep' ELSE 'review_band' END AS disagreement_type FROM lab WHERE tier_n >= 4 OR rejected = 1""",
)
def e11(spark, sf):
    out = E.error_ledger(labelled(spark, sf), "rejected", "tier_n")
    return out.select("respondent_id", "rejected", "score", "operational_tier", F.array_join("signals", "|").alias("signals"), "error_category", "disagreement_type")


HASH = "('0x' || substr(md5(respondent_id || '2607'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(
    "e12_baseline_comparison",
    f"""{LAB}, u AS (SELECT 'model' AS baseline, rejected, score FROM lab UNION ALL SELECT 'random_fixed_seed', rejected, {HASH} FROM lab UNION ALL SELECT 'always_accept', rejected, 0.0::DOUBLE FROM lab), a AS (SELECT x.baseline, {PAIR_AUC} AS auc FROM u x JOIN u y ON x.baseline = y.baseline AND x.rejected = 1 AND y.rejected = 0 GROUP BY 1),
    c AS (SELECT baseline, score, sum(rejected) AS pos, sum(sum(rejected)) OVER w AS tp, sum(count(*)) OVER w AS k FROM u GROUP BY 1, 2 WINDOW w AS (PARTITION BY baseline ORDER BY score DESC)), p AS (SELECT baseline, sum(pos / (SELECT sum(rejected) FROM lab)::DOUBLE * (tp / k::DOUBLE)) AS ap FROM c GROUP BY 1), b AS (SELECT baseline, avg(pow(least(greatest(score, 0.0), 1.0) - rejected, 2)) AS br FROM u GROUP BY 1)
    SELECT baseline, round(auc, 6) AS auroc, round(ap, 6) AS auprc, round(br, 6) AS brier_score FROM a JOIN p USING (baseline) JOIN b USING (baseline)""",
)
def e12(spark, sf):
    scores = {"model": F.col("score"), "random_fixed_seed": E.hash_score("respondent_id", "2607"), "always_accept": F.lit(0.0)}
    return rounded(E.baselines(labelled(spark, sf), "rejected", scores), ["auroc", "auprc", "brier_score"])


ORDER = {"KEEP": 0, "REVIEW": 1, "DISCARD": 2}
RANK = lambda c: f"CASE {c} WHEN 'KEEP' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'DISCARD' THEN 2 END"


@query(
    "e13_cohen_kappa",
    f"""WITH {CONV}, d AS (SELECT {DEC} AS l, judgment AS r FROM ra), z AS (SELECT count(*) AS n, avg(CAST(l = r AS INTEGER)) AS po FROM d), a AS (SELECT l AS k, count(*) AS c FROM d GROUP BY 1), b AS (SELECT r AS k, count(*) AS c FROM d GROUP BY 1), x AS (SELECT sum(a.c::DOUBLE * b.c) AS x FROM a JOIN b USING (k)),
    o AS (SELECT avg(abs({RANK('l')} - {RANK('r')})) AS m, max(abs({RANK('l')} - {RANK('r')})) AS mx, count(*) FILTER ({RANK('l')} > {RANK('r')}) AS ov, count(*) FILTER ({RANK('l')} < {RANK('r')}) AS un FROM d)
    SELECT n, round(po, 6) AS exact_agreement, round((po - x / (n::DOUBLE * n)) / (1 - x / (n::DOUBLE * n)), 6) AS cohen_kappa, n AS comparable_rows, round(m, 6) AS mean_action_distance, mx AS max_action_distance, ov AS over_escalation_rows, un AS under_escalation_rows FROM z, x, o""",
)
def e13(spark, sf):
    tier = G.tier_number(F.col("operational_tier"))
    d = reassessed(spark, sf).select(F.when(tier >= 5, "DISCARD").when(tier >= 3, "REVIEW").otherwise("KEEP").alias("l"), F.col("judgment").alias("r"))
    return rounded(E.agreement(d, "l", "r", ORDER), ["exact_agreement", "cohen_kappa", "mean_action_distance"])


@query(
    "e14_candidate_vs_adjudicated",
    f"""WITH {CONV} SELECT {DEC} AS candidate, CASE WHEN rejected = 1 THEN 'DISCARD' ELSE 'KEEP' END AS adjudicated, count(*) AS n_rows, CAST({DEC} <> CASE WHEN rejected = 1 THEN 'DISCARD' ELSE 'KEEP' END AS INTEGER) AS mismatch FROM ra WHERE rejected IS NOT NULL GROUP BY ALL""",
)
def e14(spark, sf):
    c = with_decision(spark, sf).select("respondent_id", F.col("decision").alias("candidate"))
    a = client_labels(spark, sf).select("respondent_id", F.when(F.col("rejected") == 1, "DISCARD").otherwise("KEEP").alias("adjudicated"))
    return c.join(a, "respondent_id").groupBy("candidate", "adjudicated").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("mismatch", (F.col("candidate") != F.col("adjudicated")).cast("int"))


VERSIONS = {"v1": 0.2, "v2": 0.3, "v3": 0.5}


@query(
    "e14_version_deltas",
    f"""{LAB}, x AS (SELECT version, rejected, CAST(score >= t AS INTEGER) AS pr FROM lab, (VALUES {', '.join(f"('{v}', {t}::DOUBLE)" for v, t in VERSIONS.items())}) v(version, t)), c AS ({cells_sql('x', 'version', 'pr')} GROUP BY version), {metrics_sql('c', 'version')}
    SELECT version, round(recall, 6) AS recall, round(precision, 6) AS precision, round(recall - lag(recall) OVER (ORDER BY version), 6) AS recall_delta, round(0.97::DOUBLE - recall, 6) AS recall_gap, round(precision - lag(precision) OVER (ORDER BY version), 6) AS precision_delta, round(0.97::DOUBLE - precision, 6) AS precision_gap FROM m_c""",
)
def e14b(spark, sf):
    d = labelled(spark, sf)
    cells = F.array(*[F.struct(F.lit(v).alias("version"), (F.col("score") >= t).cast("int").alias("pr")) for v, t in VERSIONS.items()])
    long_ = d.select("rejected", F.explode(cells).alias("x")).select("rejected", "x.version", "x.pr")
    m = E.confusion(long_, "rejected", "pr", "version").where("version <> 'POOLED'").select("version", "recall", "precision")
    out = E.version_deltas(m, "version", ("recall", "precision"), {"recall": 0.97, "precision": 0.97})
    return rounded(out, [c for c in out.columns if c != "version"])


@query(
    "e15_bootstrap_ci",
    f"""{LAB}, cell AS (SELECT round(score, 6) AS s, CAST(rejected AS INTEGER) AS y, pred AS p, count(*) AS c FROM lab GROUP BY 1, 2, 3),
    part AS (SELECT s, y, p, part, least({E.DRAW_ROWS}, c - part * {E.DRAW_ROWS}) AS m FROM (SELECT *, unnest(range(0, (c - 1) // {E.DRAW_ROWS} + 1)) AS part FROM cell)),
    pmf AS (SELECT m, k, exp(k * ln(m::DOUBLE) - m - lgamma(k + 1)) AS q FROM (SELECT m, unnest(range(0, CAST(floor(m + 12 * sqrt(m) + 12) AS BIGINT))) AS k FROM (SELECT unnest(range(1, {E.DRAW_ROWS} + 1)) AS m))),
    cdf AS (SELECT m, list(c ORDER BY k) AS l FROM (SELECT m, k, sum(q) OVER (PARTITION BY m ORDER BY k) AS c FROM pmf) GROUP BY m),
    u AS (SELECT part.*, rep, (CAST('0x' || substr(md5(concat_ws('|', CAST(round(s * 1000000) AS BIGINT), y, p, part, rep, 2607)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {float(1 << E.DRAW_BITS)!r}::DOUBLE AS u
      FROM part, (SELECT unnest(range(0, 400)) AS rep)),
    r AS (SELECT rep, s, y, p, CAST(sum(len(list_filter(l, lambda x: x < u))) AS BIGINT) AS w FROM u JOIN cdf USING (m) GROUP BY 1, 2, 3, 4 HAVING w > 0),
    c AS (SELECT rep, sum(CASE WHEN y = 1 AND p = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p = 1 THEN w ELSE 0 END) AS fp, sum(CASE WHEN y = 0 AND p = 0 THEN w ELSE 0 END) AS tn, sum(CASE WHEN y = 1 AND p = 0 THEN w ELSE 0 END) AS fn FROM r GROUP BY rep),
    {metrics_sql('c', 'rep')},
    v AS (SELECT rep, s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM r GROUP BY 1, 2),
    t AS (SELECT *, sum(pos) OVER (PARTITION BY rep ORDER BY s) - pos AS pb, sum(neg) OVER (PARTITION BY rep ORDER BY s) - neg AS nb, sum(pos) OVER (PARTITION BY rep) AS pt, sum(neg) OVER (PARTITION BY rep) AS nt FROM v),
    k AS (SELECT rep, sum(pos * (2 * nb + neg)) / 2 / nullif(max(pt)::DOUBLE * max(nt), 0) AS auroc, sum(pos / nullif(pt, 0)::DOUBLE * ((pt - pb) / nullif(pt - pb + nt - nb, 0)::DOUBLE)) AS auprc FROM t GROUP BY rep),
    long AS (SELECT metric, v FROM (SELECT m_c.rep, accuracy, balanced_accuracy, precision, recall, macro_f1, mcc, auroc, auprc FROM m_c JOIN k ON k.rep = m_c.rep) UNPIVOT (v FOR metric IN (accuracy, balanced_accuracy, precision, recall, macro_f1, mcc, auroc, auprc)))
    SELECT metric, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, round(avg(v), 6) AS mean FROM long GROUP BY metric""",
)
def e15(spark, sf):
    return rounded(E.bootstrap(labelled(spark, sf), "score", "rejected", "pred"), ["ci_low", "ci_high", "mean"])


PARTS = {"hostile": "-0.2 * f_hostile", "template_cluster": "-0.3 * f_template_cluster", "grounded_guard": "0.1 * g_grounded"}


@query(
    "e16_ablation",
    f"""{LAB}, u AS (SELECT 'none' AS removed, rejected, score FROM lab UNION ALL {' UNION ALL '.join(f"SELECT '{n}', rejected, round(score + {c.replace(' * ', '::DOUBLE * ')}, 9) FROM lab" for n, c in PARTS.items())}), a AS (SELECT x.removed, {PAIR_AUC} AS auc FROM u x JOIN u y ON x.removed = y.removed AND x.rejected = 1 AND y.rejected = 0 GROUP BY 1),
    c AS (SELECT removed, score, sum(rejected) AS pos, sum(sum(rejected)) OVER w AS tp, sum(count(*)) OVER w AS k FROM u GROUP BY 1, 2 WINDOW w AS (PARTITION BY removed ORDER BY score DESC)), p AS (SELECT removed, sum(pos / (SELECT sum(rejected) FROM lab)::DOUBLE * (tp / k::DOUBLE)) AS ap FROM c GROUP BY 1)
    SELECT removed, round(auc, 6) AS auroc, round(ap, 6) AS average_precision FROM a JOIN p USING (removed)""",
)
def e16(spark, sf):
    out = E.ablation(labelled(spark, sf), "rejected", "score", {n: F.expr(c.replace("0.2", "0.2D").replace("0.3", "0.3D").replace("0.1", "0.1D")) for n, c in PARTS.items()})
    return rounded(out, ["auroc", "average_precision"])


@query(
    "e17_counterexample_matrix",
    f"{LAB}, e AS (SELECT rejected, signal, unnest(guards) AS guardrail FROM (SELECT rejected, guards, unnest(signals) AS signal FROM lab)) SELECT signal, guardrail, count(*) FILTER (rejected = 0) AS accepted_counterexamples, count(*) FILTER (rejected = 1) AS rejected_examples FROM e GROUP BY 1, 2",
)
def e17(spark, sf):
    return E.counterexample_matrix(labelled(spark, sf), "signals", "guards", "rejected")


@query(
    "e18_fn_fp_field_contrast",
    f"""{LAB}, o AS (SELECT CASE WHEN rejected = 1 AND pred = 0 THEN 'FN' WHEN rejected = 0 AND pred = 0 THEN 'TN' END AS o, supplier, dataset_id, operational_tier FROM lab), u AS (SELECT o, 'supplier' AS field, supplier AS value FROM o UNION ALL SELECT o, 'dataset_id', dataset_id FROM o UNION ALL SELECT o, 'operational_tier', operational_tier FROM o),
    c AS (SELECT field, value, count(*) FILTER (o = 'FN') AS fn_rows, count(*) FILTER (o = 'TN') AS tn_rows FROM u WHERE o IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, sum(fn_rows) OVER (PARTITION BY field) AS nf, sum(tn_rows) OVER (PARTITION BY field) AS nt FROM c)
    SELECT field, value, fn_rows, tn_rows, round(fn_rows / nf::DOUBLE, 6) AS fn_share, round(tn_rows / nt::DOUBLE, 6) AS tn_share, round(fn_rows / nf::DOUBLE - tn_rows / nt::DOUBLE, 6) AS difference FROM s""",
)
def e18(spark, sf):
    y, p = F.col("rejected"), F.col("pred")
    d = labelled(spark, sf).withColumn("outcome", F.when((y == 1) & (p == 0), "FN").when((y == 0) & (p == 0), "TN").when(y == 1, "TP").otherwise("FP"))
    return rounded(E.error_contrast(d, "outcome", ["supplier", "dataset_id", "operational_tier"]), ["fn_share", "tn_share", "difference"])


GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
GRID_SQL = "(SELECT unnest([" + ", ".join(str(g) for g in GRID) + "])::DOUBLE AS threshold)"
SWEEP = f"""x AS (SELECT {{keys}}inverted, threshold, rejected, CAST(s >= threshold AS INTEGER) AS pr FROM (SELECT *, 0 AS inverted, score AS s FROM lab UNION ALL SELECT *, 1, round(1 - score, 9) FROM lab) b, {GRID_SQL} g)"""


@query(
    "e19_threshold_sweep",
    f"""{LAB}, {SWEEP.format(keys='')}, c AS ({cells_sql('x', 'inverted, threshold', 'pr')} GROUP BY inverted, threshold), {metrics_sql('c', 'inverted, threshold')} SELECT inverted, threshold, tp, fp, tn, fn, round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1 FROM m_c""",
)
def e19(spark, sf):
    out = E.threshold_sweep(labelled(spark, sf), "score", "rejected", GRID).select("inverted", "threshold", "tp", "fp", "tn", "fn", "f1", "balanced_accuracy", "macro_f1")
    return rounded(out, ["f1", "balanced_accuracy", "macro_f1"])


@query(
    "e19_best_threshold_by_cohort",
    f"""{LAB}, {SWEEP.format(keys='dataset_id, ')}, c AS ({cells_sql('x', 'dataset_id, inverted, threshold', 'pr')} GROUP BY dataset_id, inverted, threshold), {metrics_sql('c', 'dataset_id, inverted, threshold')},
    r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY round(macro_f1, 9) DESC, round(abs(threshold - 0.5::DOUBLE), 9), threshold, inverted) AS rn FROM m_c) SELECT dataset_id, threshold, inverted, round(macro_f1, 6) AS macro_f1 FROM r WHERE rn = 1""",
)
def e19b(spark, sf):
    sweep = E.threshold_sweep(labelled(spark, sf), "score", "rejected", GRID, "dataset_id")
    return rounded(E.best_threshold(sweep, "macro_f1", "dataset_id"), ["macro_f1"])


DG, KG = tuple(round(0.3 + 0.05 * i, 2) for i in range(14)), tuple(round(0.05 * i, 2) for i in range(1, 11))


@query(
    "e20_selective_thresholds",
    f"""{LAB}, g AS (SELECT d::DOUBLE AS dt, k::DOUBLE AS kt FROM (SELECT unnest({list(DG)}) AS d) a, (SELECT unnest({list(KG)}) AS k) b WHERE k < d), x AS (SELECT dt, kt, rejected, CAST(score >= dt OR (score > kt AND score < dt AND score >= 0.5) AS INTEGER) AS pr, CAST(score > kt AND score < dt AS INTEGER) AS rv FROM lab, g),
    c AS (SELECT b.*, rv FROM ({cells_sql('x', 'dt, kt', 'pr')} GROUP BY dt, kt) b JOIN (SELECT dt, kt, sum(rv) AS rv FROM x GROUP BY 1, 2) USING (dt, kt)), {metrics_sql('c', 'dt, kt, rv')},
    o AS (SELECT *, round(f1 - 0.15::DOUBLE * (rv / rows::DOUBLE), 9) AS objective FROM m_c WHERE accuracy >= 0.6) SELECT dt AS discard_threshold, kt AS keep_threshold, objective, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(rv / rows::DOUBLE, 6) AS review_rate FROM o ORDER BY objective DESC, dt, kt LIMIT 1""",
)
def e20(spark, sf):
    return E.selective_thresholds(labelled(spark, sf), "score", "rejected", DG, KG, min_accuracy=0.6)


@query(
    "e21_terminal_state",
    f"""{LAB}, c AS ({cells_sql('lab', "CASE WHEN grouping(dataset_id) = 1 THEN 'POOLED' ELSE dataset_id END AS dataset_id")} GROUP BY ROLLUP (lab.dataset_id)), {metrics_sql('c', 'dataset_id')}, p AS (SELECT * FROM m_c WHERE dataset_id = 'POOLED'), w AS (SELECT min(accuracy) AS wa, min(recall) AS wr FROM m_c WHERE dataset_id <> 'POOLED')
    SELECT {', '.join(f'round({m}, 6) AS pooled_{m}' for m, _, _ in E.GATES)}, round(wa, 6) AS worst_accuracy, round(wr, 6) AS worst_recall, CASE WHEN accuracy > 0.99 AND balanced_accuracy >= 0.98 AND macro_f1 >= 0.98 AND recall >= 0.97 AND precision >= 0.97 AND mcc >= 0.95 AND wa >= 0.97 AND wr >= 0.9 THEN 'TARGET_MET' ELSE 'IMPROVING_NOT_MET' END AS terminal_state FROM p, w""",
)
def e21(spark, sf):
    out = E.terminal_state(E.confusion(labelled(spark, sf), "rejected", "pred", "dataset_id"), "dataset_id")
    return rounded(out, [c for c in out.columns if c != "terminal_state"])


@query(
    "e22_client_annotation_validation",
    f"""WITH {CONV}, k AS (SELECT respondent_id, judgment, list_filter([CASE WHEN rejected = 1 THEN 'status_rejected' END, CASE WHEN toxic = 1 THEN 'toxic_flag' END, CASE WHEN rejected = 0 AND toxic = 0 THEN 'no_concern' END], lambda x: x IS NOT NULL) AS f FROM ra WHERE rejected IS NOT NULL), e AS (SELECT respondent_id, judgment, unnest(f) AS family FROM k),
    m AS (SELECT family, respondent_id, row_number() OVER (PARTITION BY family ORDER BY respondent_id) AS rn FROM e WHERE judgment = 'KEEP'), mm AS (SELECT family, string_agg(CAST(respondent_id AS VARCHAR), ',' ORDER BY respondent_id) FILTER (rn <= 12) AS missed_sample FROM m GROUP BY 1)
    SELECT family, count(*) AS client_rows, count(*) FILTER (judgment <> 'KEEP') AS reviewed, count(*) FILTER (judgment = 'DISCARD') AS discarded, coalesce(max(missed_sample), '') AS missed_sample, round(count(*) FILTER (judgment <> 'KEEP') / count(*)::DOUBLE, 6) AS review_coverage FROM e LEFT JOIN mm USING (family) GROUP BY 1""",
)
def e22(spark, sf):
    j = reassessed(spark, sf)
    fam = S.listed([("status_rejected", F.col("rejected") == 1), ("toxic_flag", F.col("toxic") == 1), ("no_concern", (F.col("rejected") == 0) & (F.col("toxic") == 0))])
    clients = client_labels(spark, sf).withColumn("families", fam)
    out = E.annotation_validation(clients, j.where("judgment <> 'KEEP'"), j.where("judgment = 'DISCARD'"), "respondent_id", "families")
    return rounded(out, ["review_coverage"])


@query(
    "e22_validation_notes",
    f"""WITH {CONV} SELECT CASE WHEN judgment = 'DISCARD' AND rejected = 0 AND toxic = 0 THEN 'discard conflicts with client keep' WHEN rejected = 1 AND judgment = 'KEEP' THEN 'client rejected, not reviewed' WHEN rejected = 0 AND toxic = 1 AND judgment = 'KEEP' THEN 'client routed to review, not reviewed' WHEN toxic = 1 AND judgment = 'KEEP' THEN 'client flagged, not reviewed'
      WHEN rejected = 0 AND toxic = 0 AND judgment <> 'KEEP' THEN 'reviewed although client accepted' WHEN judgment <> 'KEEP' THEN 'reviewed' ELSE 'no discrepancy' END AS note, count(*) AS n_rows FROM ra WHERE rejected IS NOT NULL GROUP BY 1""",
)
def e22b(spark, sf):
    j = reassessed(spark, sf).where("rejected IS NOT NULL")
    action = F.when(F.col("rejected") == 1, "Discard").when(F.col("toxic") == 1, "Light review").otherwise("Keep")
    note = E.validation_notes(action, F.col("toxic") == 1, F.col("rejected") == 1, F.col("judgment") != "KEEP", F.col("judgment") == "DISCARD")
    return j.groupBy(note.alias("note")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "e23_distribution_shift",
    f"""WITH {SCORED}, m AS (SELECT dataset_id, count(*) AS n, avg(score) AS ms, avg(1 - missing_rate) AS mc FROM scored GROUP BY 1), x AS (SELECT dataset_id, operational_tier, count(*) AS c FROM scored GROUP BY 1, 2), a AS (SELECT operational_tier, sum(c) AS ct FROM x GROUP BY 1), t AS (SELECT sum(n) AS nt FROM m),
    g AS (SELECT m.dataset_id, greatest(coalesce(c, 0) / n::DOUBLE, 1e-4::DOUBLE) AS p, greatest((ct - coalesce(c, 0)) / (nt - n)::DOUBLE, 1e-4::DOUBLE) AS q FROM m, a, t LEFT JOIN x ON x.dataset_id = m.dataset_id AND x.operational_tier = a.operational_tier)
    SELECT dataset_id, n, round(ms, 6) AS mean_score, round(mc, 6) AS mean_coverage, round(psi, 6) AS psi FROM m JOIN (SELECT dataset_id, sum((p - q) * ln(p / q)) AS psi FROM g GROUP BY 1) USING (dataset_id)""",
)
def e23(spark, sf):
    d = scored_frame(spark, sf).withColumn("coverage", 1 - F.col("missing_rate"))
    return rounded(E.distribution_shift(d, "dataset_id", "score", "operational_tier", "coverage"), ["mean_score", "mean_coverage", "psi"])
