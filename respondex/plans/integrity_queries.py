"""Queries over seals, joins, reconciliation, checks and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.operators import integrity as I
from respondex.operators import splits as P
from respondex.plans.catalog import query
from respondex.plans.scoring_queries import CONV, reassessed
from respondex.plans.study import SCORED, client_labels, norm_sql, respondents, scored_frame
from respondex.sources.tables import table

SEALED = ("respondent_id", "client_reject_probability", "operational_tier", "score")
DOC_COLUMNS = ("doc_id", "lang", "source", "n_chars", "text")
FP_SQL = "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in DOC_COLUMNS) + "))"
LANE = lambda i: f"CAST(sum(CAST(('0x' || substr(fp, {1 + 15 * i}, 15)) AS HUGEINT)) AS VARCHAR)"


@query("g01_row_fingerprint", f"SELECT doc_id AS respondent_id, {FP_SQL} AS fingerprint FROM documents")
def g01(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("respondent_id"), I.row_fingerprint(DOC_COLUMNS).alias("fingerprint"))


@query("g01_seal", f"WITH f AS (SELECT {FP_SQL} AS fp FROM documents) SELECT count(*) AS n_rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {', '.join(LANE(i) for i in range(4))})) AS digest FROM f")
def g01b(spark, sf):
    return I.seal(table(spark, sf, "documents"), DOC_COLUMNS)


@query(
    "g02_join_by_stable_id",
    """SELECT (SELECT count(*) FROM documents WHERE doc_id IS NULL) AS prediction_missing, (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM documents GROUP BY doc_id)) AS prediction_duplicates, (SELECT count(*) FROM labels WHERE doc_id IS NULL) AS label_missing,
    (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM labels GROUP BY doc_id)) AS label_duplicates, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS predictions_without_label, 0 AS passed""",
)
def g02(spark, sf):
    p = respondents(spark, sf).select("respondent_id")
    return I.stable_id_report(p, client_labels(spark, sf).select("respondent_id"), "respondent_id")


@query(
    "g03_reconcile_labels",
    """WITH p AS (SELECT CASE WHEN user_id % 40 = 0 THEN user_id + 1000000 ELSE user_id END AS id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'click') AND (user_id % 3 = 0 OR event_type = 'view')) GROUP BY 1), q AS (SELECT doc_id AS id, count(*) AS n, max(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1 - quality END) AS r FROM labels GROUP BY 1)
    SELECT coalesce(p.id, q.id) AS respondent_id, coalesce(p.n, 0) AS n_predictions, coalesce(q.n, 0) AS n_labels, CASE WHEN q.n IS NULL THEN 'prediction_only' WHEN p.n IS NULL THEN 'label_only' WHEN r IS NULL THEN 'unresolved_status' WHEN p.n > 1 OR q.n > 1 THEN 'duplicate_key' ELSE 'matched_one_to_one' END AS status FROM p FULL JOIN q ON p.id = q.id""",
)
def g03(spark, sf):
    """Predictions per user, some with foreign or repeated ids; some labels unresolved."""
    e = table(spark, sf, "events").where("event_type IN ('view', 'click') AND (user_id % 3 = 0 OR event_type = 'view')").select("user_id", "event_type").distinct()
    p = e.select(F.when(F.pmod("user_id", F.lit(40)) == 0, F.col("user_id") + 1000000).otherwise(F.col("user_id")).alias("respondent_id"))
    q = client_labels(spark, sf).withColumn("rejected", F.when(F.pmod("respondent_id", F.lit(7)) != 0, F.col("rejected")))
    return I.reconcile(p, q, "respondent_id", "rejected")


@query(
    "g04_decisions_unchanged",
    f"""WITH {SCORED}, a AS (SELECT respondent_id, CASE WHEN respondent_id % 97 = 0 THEN 'Exclude candidate' ELSE operational_tier END AS operational_tier, CASE WHEN respondent_id % 89 = 0 THEN NULL ELSE CAST(dup_count AS VARCHAR) END AS dup_count FROM scored WHERE respondent_id % 101 <> 0)
    SELECT s.respondent_id, 'row_missing' AS "column", NULL AS before, NULL AS after FROM scored s LEFT JOIN a USING (respondent_id) WHERE a.respondent_id IS NULL
    UNION ALL SELECT s.respondent_id, 'operational_tier', s.operational_tier, a.operational_tier FROM scored s JOIN a USING (respondent_id) WHERE s.operational_tier IS DISTINCT FROM a.operational_tier
    UNION ALL SELECT s.respondent_id, 'dup_count', CAST(s.dup_count AS VARCHAR), a.dup_count FROM scored s JOIN a USING (respondent_id) WHERE CAST(s.dup_count AS VARCHAR) IS DISTINCT FROM a.dup_count""",
)
def g04(spark, sf):
    """An evaluator that lost, rewrote and blanked decisions must be found out."""
    before = scored_frame(spark, sf).select("respondent_id", "operational_tier", "dup_count")
    i = F.col("respondent_id")
    after = before.where(i % 101 != 0).withColumn("operational_tier", F.when(i % 97 == 0, "Exclude candidate").otherwise(F.col("operational_tier"))).withColumn("dup_count", F.when(i % 89 != 0, F.col("dup_count")))
    return I.decision_changes(before, after, "respondent_id", ["operational_tier", "dup_count"])


@query(
    "g05_validate_judgments",
    f"""WITH {CONV}, j AS (SELECT respondent_id, CASE WHEN respondent_id % 50 = 0 THEN 'MAYBE' ELSE judgment END AS judgment, CASE WHEN respondent_id % 60 = 0 THEN 1.7::DOUBLE ELSE score END AS confidence, CASE WHEN respondent_id % 70 = 0 THEN ' ' ELSE array_to_string(reasons, ';') END AS reason,
      CASE judgment WHEN 'KEEP' THEN 'auto_keep_candidate' WHEN 'DISCARD' THEN CASE WHEN respondent_id % 3 = 0 THEN 'human_review' ELSE 'high_conf_discard_candidate' END ELSE 'human_review' END AS routing FROM ra)
    SELECT respondent_id, 'missing:reason' AS violation FROM j WHERE trim(reason) = '' UNION ALL SELECT respondent_id, 'invalid:judgment' FROM j WHERE judgment NOT IN ('KEEP', 'REVIEW', 'DISCARD') UNION ALL SELECT respondent_id, 'range:confidence' FROM j WHERE confidence < 0 OR confidence > 1
    UNION ALL SELECT respondent_id, 'discard_needs_high_confidence_route' FROM j WHERE judgment = 'DISCARD' AND routing <> 'high_conf_discard_candidate' UNION ALL SELECT respondent_id, 'keep_needs_auto_keep_route' FROM j WHERE judgment = 'KEEP' AND routing <> 'auto_keep_candidate'""",
)
def g05(spark, sf):
    i = F.col("respondent_id")
    route = (
        F.when(F.col("judgment") == "KEEP", "auto_keep_candidate")
        .when(F.col("judgment") == "DISCARD", F.when(i % 3 == 0, "human_review").otherwise("high_conf_discard_candidate")).otherwise("human_review")
    )
    j = reassessed(spark, sf).select(
        "respondent_id", F.when(i % 50 == 0, "MAYBE").otherwise(F.col("judgment")).alias("judgment"), F.when(i % 60 == 0, 1.7).otherwise(F.col("score")).alias("confidence"),
        F.when(i % 70 == 0, " ").otherwise(F.array_join("reasons", ";")).alias("reason"), route.alias("routing"),
    )
    rules = {
        **I.required(["reason"]), **I.one_of("judgment", ["KEEP", "REVIEW", "DISCARD"]), **I.in_range("confidence", 0.0, 1.0),
        "discard_needs_high_confidence_route": (F.col("judgment") == "DISCARD") & (F.col("routing") != "high_conf_discard_candidate"),
        "keep_needs_auto_keep_route": (F.col("judgment") == "KEEP") & (F.col("routing") != "auto_keep_candidate"),
    }
    return I.violations(j, "respondent_id", rules)


@query("g05_review_rate", f"WITH {CONV} SELECT count(*) AS n, count(*) FILTER (judgment = 'REVIEW') AS reviews, round(avg(CAST(judgment = 'REVIEW' AS INTEGER)), 6) AS review_rate, CAST(avg(CAST(judgment = 'REVIEW' AS INTEGER)) > 0.2 AS INTEGER) AS exceeds_limit FROM ra")
def g05b(spark, sf):
    return I.review_rate_check(reassessed(spark, sf), "judgment", 0.2)


@query("g06_completeness_audit", f"WITH {SCORED} SELECT (SELECT count(*) FROM documents) AS input_rows, count(*) AS prediction_rows, count(*) - count(DISTINCT respondent_id) AS duplicate_prediction_ids, count(*) FILTER (client_reject_probability IS NULL OR client_reject_probability < 0 OR client_reject_probability > 1) AS invalid_probability_rows, 1 AS passed FROM scored")
def g06(spark, sf):
    return I.completeness_audit(table(spark, sf, "documents").select("doc_id"), scored_frame(spark, sf), "respondent_id", "client_reject_probability")


def hash_sql(salt: str) -> str:
    return f"('0x' || substr(md5(respondent_id || '{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


SPLIT = f"""h AS (SELECT respondent_id, dataset_id, rejected, text_digest, {hash_sql('split')} AS h FROM lab0), pk AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, rejected ORDER BY h, respondent_id) - 1 AS pos, count(*) OVER (PARTITION BY dataset_id, rejected) AS n FROM h),
  sp AS (SELECT respondent_id, dataset_id, rejected, text_digest, CASE WHEN pos / n::DOUBLE < 0.7::DOUBLE THEN 'train' WHEN pos / n::DOUBLE < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM pk)"""
LAB0 = f"""WITH lab0 AS (SELECT d.doc_id AS respondent_id, d.lang AS dataset_id, 1 - quality AS rejected, CASE WHEN length({norm_sql('text')}) >= 16 THEN md5({norm_sql('text')}) END AS text_digest FROM documents d JOIN labels l USING (doc_id))"""


def split_frame(spark, sf):
    lab = scored_frame(spark, sf).where("rejected IS NOT NULL").select("respondent_id", "dataset_id", "rejected", "text_digest")
    return P.stratified_split(lab, ["dataset_id", "rejected"], "respondent_id", "split")


@query("p01_stratified_split", f"{LAB0}, {SPLIT} SELECT respondent_id, dataset_id, rejected, split FROM sp")
def p01(spark, sf):
    return split_frame(spark, sf).drop("text_digest")


@query("p01_folds", f"{LAB0} SELECT CAST(floor({hash_sql('fold')} * 5) AS INTEGER) AS fold, dataset_id, count(*) AS n FROM lab0 GROUP BY 1, 2")
def p01b(spark, sf):
    lab = scored_frame(spark, sf).where("rejected IS NOT NULL")
    return lab.groupBy(P.folds("respondent_id", "fold", 5).alias("fold"), "dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query("p02_duplicate_safe_split", f"{LAB0}, {SPLIT} SELECT respondent_id FROM sp WHERE split = 'train' AND (text_digest IS NULL OR text_digest NOT IN (SELECT text_digest FROM sp WHERE split = 'test' AND text_digest IS NOT NULL))")
def p02(spark, sf):
    s = split_frame(spark, sf)
    return P.duplicate_safe(s.where("split = 'train'"), s.where("split = 'test'"), "text_digest").select("respondent_id")


FEATS = ("f_hostile", "f_template_cluster", "f_polished", "f_repeated_phrase", "g_grounded", "supplier", "word_bin")


@query(
    "p08_feature_select",
    f"""WITH {SCORED}, b AS (SELECT *, CAST(least(greatest(floor(word_count / 100.0::DOUBLE), 0), 9) AS INTEGER) AS word_bin FROM scored WHERE rejected IS NOT NULL), u AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS v, rejected FROM b" for f in FEATS)}),
    j AS (SELECT feature, v, rejected, count(*) AS c FROM u GROUP BY 1, 2, 3), p AS (SELECT *, sum(c) OVER (PARTITION BY feature, v) AS cv, sum(c) OVER (PARTITION BY feature, rejected) AS cy, sum(c) OVER (PARTITION BY feature) AS n FROM j)
    SELECT feature, round(sum(c / n::DOUBLE * ln(c::DOUBLE * n / (cv::DOUBLE * cy))), 9) AS mutual_information FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def p08(spark, sf):
    b = scored_frame(spark, sf).withColumn("word_bin", P.equal_width_bin(F.col("word_count"), 0.0, 1000.0, 10))
    return P.mutual_information(b, "rejected", FEATS, 5)


@query(
    "p13_coverage_gated_features",
    """WITH j AS (SELECT d.doc_id AS respondent_id, l.toxic, b.item_id FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT item_id, 1 AS one FROM benchmark) b ON b.item_id = d.doc_id), c AS (SELECT count(toxic) / count(*)::DOUBLE AS ct, count(item_id) / count(*)::DOUBLE AS cb FROM j)
    SELECT respondent_id, CASE WHEN ct > 0.05 THEN toxic END AS toxic, CASE WHEN cb > 0.05 THEN item_id END AS item_id, CASE WHEN ct > 0.05 THEN CAST(toxic IS NOT NULL AS INTEGER) ELSE 0 END AS has_toxic, CASE WHEN cb > 0.05 THEN CAST(item_id IS NOT NULL AS INTEGER) ELSE 0 END AS has_item_id FROM j, c""",
)
def p13(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("respondent_id"))
    ev = client_labels(spark, sf).select("respondent_id", "toxic").join(
        table(spark, sf, "benchmark").select(F.col("item_id").alias("respondent_id"), "item_id"), "respondent_id", "full"
    )
    return P.coverage_gate(ids, "respondent_id", ev, ["toxic", "item_id"])
