"""Queries over fields: roles, types, leakage, contracts, profiles by label."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.functions import lexicons as L
from respondex.functions import text as X
from respondex.operators import profiling as P
from respondex.operators import text_signals as T
from respondex.plans.catalog import query
from respondex.plans.sources_queries import CANON
from respondex.plans.study import FRAME, STUDY, answers, chain, q, respondent_frame
from respondex.sources.tables import table

# fields of several tables in one long relation
SOURCES = {
    "customer": ("c_custkey", ("c_mktsegment", "c_nationkey", "c_acctbal")),
    "orders": ("o_orderkey", ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")),
    "events": ("event_id", ("event_type", "value", "ts", "props")),
    "documents": ("doc_id", ("lang", "source", "n_chars", "text")),
    "part": ("p_partkey", ("p_brand", "p_type", "p_size")),
    "labels": ("doc_id", ("quality", "toxic")),
}


def all_fields(spark, sf):
    out = None
    for name, (key, cols) in SOURCES.items():
        t = table(spark, sf, name).select(F.col(key).alias("id"), *cols)
        m = P.melt(t, ["id"], cols)
        out = m if out is None else out.unionByName(m)
    return out


FIELDS_SQL = "u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field_name, {CANON.format(c=f'CAST({c} AS VARCHAR)')} AS v FROM {t}" for t, (_, cols) in SOURCES.items() for c in cols
) + """), st AS (SELECT field_name, count(*) AS n_rows, count(v) AS n_answered, count(DISTINCT v) AS n_distinct, coalesce(avg(length(v)), 0) AS mean_length,
  coalesce(avg(CASE WHEN v IS NOT NULL THEN CAST(length(v) >= 12 AS INTEGER) END), 0) AS long_share,
  coalesce(avg(CASE WHEN v IS NOT NULL THEN CAST(try_cast(v AS DOUBLE) IS NOT NULL AS INTEGER) END), 0) AS numeric_share,
  coalesce(avg(CASE WHEN v IS NOT NULL THEN CAST(regexp_matches(v, '[A-Za-z]') AS INTEGER) END), 0) AS alpha_share FROM u GROUP BY 1)"""


def chain_sql(col: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {q(p)}) THEN '{n}'" for n, p in rules) + f" ELSE {default} END"


@query(
    "b01_field_roles",
    f"""WITH {FIELDS_SQL} SELECT field_name, n_rows, n_distinct, round(mean_length, 6) AS mean_length,
    {chain_sql('lower(field_name)', P.ROLE_RULES, "CASE WHEN mean_length >= 22 AND alpha_share >= 0.25 THEN 'open_end' ELSE 'coded_question' END")} AS field_role FROM st""",
)
def b01(spark, sf):
    return P.classify_field_roles(P.field_stats(all_fields(spark, sf))).select(
        "field_name", "n_rows", "n_distinct", F.round("mean_length", 6).alias("mean_length"), "field_role"
    )


TYPE_SQL = """CASE WHEN regexp_matches(lower(field_name), 'uuid|respondent|^rid$|record|case|(^|_)id$|key$') OR lower(field_name) IN ('record', 'markers') THEN 'identifier_or_metadata'
  WHEN regexp_matches(lower(field_name), 'qtime|time|duration|elapsed|date|timestamp|(^|_)ts$') THEN 'timing_or_timestamp'
  WHEN regexp_matches(lower(field_name), 'open|other|specify|explain|why|comment|oe$|outro') THEN 'open_end'
  WHEN numeric_share >= 0.8 AND n_distinct > 10 THEN 'numeric' WHEN numeric_share >= 0.8 THEN 'ordinal_or_numeric'
  WHEN regexp_matches(lower(field_name), '^(.+?)(_?r|row)\\d+(_?c\\d+)?$') THEN 'matrix_item'
  WHEN mean_length >= 20 OR long_share >= 0.25 THEN 'open_end_like' ELSE 'categorical' END"""


@query("b02_question_type", f"WITH {FIELDS_SQL} SELECT field_name, n_distinct, round(numeric_share, 6) AS numeric_share, round(long_share, 6) AS long_share, {TYPE_SQL} AS question_type FROM st")
def b02(spark, sf):
    return P.infer_question_type(P.field_stats(all_fields(spark, sf))).select(
        "field_name", "n_distinct", F.round("numeric_share", 6).alias("numeric_share"), F.round("long_share", 6).alias("long_share"), "question_type"
    )


@query("b03_leakage_columns", "SELECT doc_id AS respondent_id, lang AS dataset_id, source AS supplier, n_chars FROM documents")
def b03(spark, sf):
    """Outcome columns are put under typical export names and must be gone before features are built."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("respondent_id"), F.col("lang").alias("dataset_id"), F.col("source").alias("supplier"), "n_chars",
        F.col("quality").alias("status"), F.col("toxic").alias("client_decision"), F.col("quality").alias("TERMFLAGS"), F.col("toxic").alias("noanswerq5_r3"),
    )
    return P.refuse_outcomes(P.drop_leakage(d))


@query(
    "b05_open_text_columns",
    f"""WITH {FIELDS_SQL} SELECT field_name, round(mean_length, 6) AS mean_length, round(alpha_share, 6) AS alpha_share FROM st
    WHERE NOT regexp_matches(lower(field_name), '^(url|useragent|rid|session|source|list|vbrowser|vmobile|vos|vlist)$|token|fingerprint|device') AND NOT regexp_matches(field_name, {q(L.LEAKAGE_PATTERN)})
      AND (regexp_matches(lower(field_name), 'outro|open|oe$|other|specify|explain|why|comment') OR (mean_length >= 22 AND alpha_share >= 0.25))""",
)
def b05(spark, sf):
    out = P.open_text_columns(P.field_stats(all_fields(spark, sf)))
    return out.select("field_name", F.round("mean_length", 6).alias("mean_length"), F.round("alpha_share", 6).alias("alpha_share"))


def grid_fields(spark, sf):
    """Grid cells named ``<grid>_r<line>`` from the order lines."""
    a = answers(spark, sf)
    m = P.melt(a.select("respondent_id", "line", "flag", "linestatus", "discount", "quantity"), ["respondent_id", "line"], ["flag", "linestatus", "discount", "quantity"])
    name = F.concat(F.when(F.col("field_name") == "flag", "returned").when(F.col("field_name") == "linestatus", "shipped").otherwise(F.col("field_name")), F.lit("_r"), F.col("line").cast("string"))
    return m.withColumn("field_name", name)


@query(
    "b06_matrix_groups",
    f"""WITH g AS (SELECT 'returned' AS g, l_linenumber AS i, l_returnflag AS v FROM lineitem UNION ALL SELECT 'shipped', l_linenumber, l_linestatus FROM lineitem
      UNION ALL SELECT 'discount', l_linenumber, CAST(l_discount AS VARCHAR) FROM lineitem UNION ALL SELECT 'quantity', l_linenumber, CAST(l_quantity AS VARCHAR) FROM lineitem),
    f AS (SELECT g, i, count(DISTINCT v) AS nv, count(v) AS n FROM g GROUP BY 1, 2)
    SELECT g AS matrix_group, count(*) AS n_items, max(nv) AS max_values, CAST(sum(n) AS BIGINT) AS n_answers FROM f WHERE nv BETWEEN 2 AND 12 GROUP BY 1 HAVING count(*) >= 4""",
)
def b06(spark, sf):
    return P.matrix_groups(grid_fields(spark, sf))


# --- fixed values: analyses a data set may support, and what each needs --------------------------
ANALYSES = (
    ("timing_speed", "timing", "timing"),
    ("open_end_effort", "open_end", "open_end"),
    ("matrix_straightlining", "matrix_cell", "matrix"),
    ("supplier_risk", "supplier", "source"),
    ("demographic_mix", "demographic", "profile"),
    ("fielding_bursts", "timestamp", "fielding"),
    ("technical_duplicates", "ip", "duplicate"),
    ("brand_consistency", "product_attr", "brand"),
    ("platform_flags", "quality_flag", "platform"),
    ("coded_diversity", "coded_question", "coded"),
)


@query(
    "b07_discover_profile",
    f"""WITH {FIELDS_SQL}, r AS (SELECT *, {chain_sql('lower(field_name)', P.ROLE_RULES, "CASE WHEN mean_length >= 22 AND alpha_share >= 0.25 THEN 'open_end' ELSE 'coded_question' END")} AS role FROM st),
    a AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{r}', '{t}')" for a, r, t in ANALYSES)}) v(analysis, role, tag))
    SELECT analysis, tag, count(r.role) AS n_fields, CAST(coalesce(sum(n_answered), 0) AS BIGINT) AS n_answers,
      CASE WHEN count(r.role) = 0 THEN 'not_available' WHEN coalesce(sum(n_answered), 0) = 0 THEN 'needs_context' WHEN analysis = 'brand_consistency' THEN 'needs_mapping' ELSE 'scorable' END AS status
    FROM a LEFT JOIN r USING (role) GROUP BY analysis, tag""",
)
def b07(spark, sf):
    roles = P.classify_field_roles(P.field_stats(all_fields(spark, sf)))
    per_role = roles.groupBy("field_role").agg(F.count(F.lit(1)).alias("n_fields"), F.sum("n_answered").alias("n_answers"))
    needs = spark.createDataFrame(list(ANALYSES), "analysis string, field_role string, tag string")
    out = needs.join(per_role, "field_role", "left").na.fill(0, ["n_fields", "n_answers"])
    status = (
        F.when(F.col("n_fields") == 0, "not_available").when(F.col("n_answers") == 0, "needs_context")
        .when(F.col("analysis") == "brand_consistency", "needs_mapping").otherwise("scorable")
    )
    return out.select("analysis", "tag", "n_fields", "n_answers", status.alias("status"))


MEASURES = ("word_count", "char_count", "unique_token_ratio", "sentence_count", "qtime", "modal_share")


@query(
    "b08_profile_by_label",
    f"""WITH {FRAME}, s AS (SELECT *, trim(regexp_replace(open_text, '\\s+', ' ', 'g')) AS s FROM frame), w AS (SELECT *, regexp_extract_all(lower(s), '[A-Za-z'']+') AS w FROM s),
    m AS (SELECT dataset_id, rejected, len(w)::DOUBLE AS word_count, length(s)::DOUBLE AS char_count, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0.0 END AS unique_token_ratio,
      (len(regexp_extract_all(s, '[.!?]+')) + CASE WHEN s <> '' THEN 1 ELSE 0 END)::DOUBLE AS sentence_count, qtime, modal_share FROM w WHERE rejected IS NOT NULL),
    u AS ({' UNION ALL '.join(f"SELECT dataset_id, rejected, '{c}' AS col, {c}::DOUBLE AS v FROM m" for c in MEASURES)}),
    b AS (SELECT dataset_id, col, count(*) FILTER (rejected = 0) AS accepted_n, count(*) FILTER (rejected = 0 AND v IS NULL) AS accepted_missing, avg(v) FILTER (rejected = 0) AS am, coalesce(stddev_samp(v) FILTER (rejected = 0), 0) AS asd,
      count(*) FILTER (rejected = 1) AS rejected_n, count(*) FILTER (rejected = 1 AND v IS NULL) AS rejected_missing, avg(v) FILTER (rejected = 1) AS rm, coalesce(stddev_samp(v) FILTER (rejected = 1), 0) AS rsd FROM u GROUP BY 1, 2),
    a AS (SELECT x.dataset_id, x.col, sum(CASE WHEN x.v > y.v THEN 1.0::DOUBLE WHEN x.v = y.v THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS auc FROM u x JOIN u y ON x.dataset_id = y.dataset_id AND x.col = y.col AND x.rejected = 1 AND y.rejected = 0 AND x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY 1, 2),
    e AS (SELECT b.*, coalesce(auc, 0.5) AS auc, CASE WHEN sqrt((asd * asd + rsd * rsd) / 2) > 0 THEN (rm - am) / sqrt((asd * asd + rsd * rsd) / 2) ELSE 0 END AS eff FROM b LEFT JOIN a USING (dataset_id, col)),
    f AS (SELECT *, round(CASE WHEN auc < 0.5 THEN -eff ELSE eff END, 4) AS effect_size, round(CASE WHEN auc < 0.5 THEN 1 - auc ELSE auc END, 4) AS univariate_auroc FROM e),
    g AS (SELECT *, count(*) OVER (PARTITION BY col) AS datasets, CAST(dense_rank() OVER (PARTITION BY dataset_id ORDER BY univariate_auroc DESC) AS INTEGER) AS within_dataset_rank FROM f)
    SELECT dataset_id, col AS "column", accepted_n, accepted_missing, round(am, 6) AS accepted_mean, round(asd, 6) AS accepted_std, rejected_n, rejected_missing, round(rm, 6) AS rejected_mean, round(rsd, 6) AS rejected_std,
      effect_size, univariate_auroc, within_dataset_rank, datasets, CASE WHEN datasets >= 3 THEN 'cross_dataset' WHEN datasets = 2 THEN 'survey_family_specific' ELSE 'survey_specific' END AS cross_dataset_stability FROM g""",
)
def b08(spark, sf):
    f = T.text_metrics(respondent_frame(spark, sf), "open_text", STUDY)
    out = P.profile_by_label(f, "dataset_id", "rejected", "respondent_id", MEASURES)
    for c in ("accepted_mean", "accepted_std", "rejected_mean", "rejected_std"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "b09_canonical_question_key",
    """WITH e AS (SELECT event_type || '_' || regexp_extract(props, '"k": ([0-9]+)', 1) AS field FROM events)
    SELECT regexp_replace(regexp_replace(lower(field), '[^a-z0-9]+', '_', 'g'), '_[0-9]+$', '') AS canonical_key, count(*) AS n_rows, count(DISTINCT field) AS n_fields FROM e GROUP BY 1""",
)
def b09(spark, sf):
    k = F.get_json_object("props", "$.k")
    e = table(spark, sf, "events").select(F.concat("event_type", F.lit("_"), k).alias("field"))
    per = e.groupBy("field").agg(F.count(F.lit(1)).alias("c")).withColumn("canonical_key", P.canonical_key(F.col("field")))
    return per.groupBy("canonical_key").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_fields"))


PROMPTS = {
    "c_mktsegment": "What is your trade or market segment?",
    "o_orderpriority": "How important is fast delivery of the purchase to you?",
    "o_totalprice": "What did you spend on all products that you have purchased for your household or your company in the course of the last twelve months?",
    "text": "Why? Please explain in your own words",
}
HAY = "lower(field_name || ' ' || prompt)"


@query(
    "b10_question_contracts",
    f"""WITH {FIELDS_SQL}, p AS (SELECT *, {'CASE field_name ' + ' '.join(f"WHEN '{k}' THEN {q(v)}" for k, v in PROMPTS.items()) + " ELSE '' END"} AS prompt FROM st),
    r AS (SELECT *, {chain_sql(HAY, P.CONTRACT_ROLES, "'closed_or_categorical'")} AS role FROM p)
    SELECT field_name, prompt AS question_text, role AS field_role,
      CASE {' '.join(f"WHEN role = '{k}' THEN '{v}'" for k, v in P.CONTRACT_FAMILIES.items())} WHEN regexp_matches({HAY}, 'other|specify') THEN 'other-specify validation' ELSE 'survey response chain' END AS question_family,
      CASE WHEN role IN ('open_end', 'qualification_or_persona') THEN 'high' WHEN role = 'matrix_or_grid' THEN 'medium to high' WHEN len(regexp_extract_all(prompt, '[A-Za-z'']+')) > 18 THEN 'medium' ELSE 'low' END AS timing_burden,
      CASE {' '.join(f"WHEN role = '{k}' THEN '{v}'" for k, v in P.EXPECTED_EVIDENCE.items())} ELSE 'a selection that fits the route' END AS expected_evidence,
      round(n_answered / n_rows::DOUBLE, 6) AS answer_rate, CAST(prompt = '' AND role = 'closed_or_categorical' AS INTEGER) AS unresolved FROM r""",
)
def b10(spark, sf):
    return P.question_contracts(P.field_stats(all_fields(spark, sf)), PROMPTS)


EVENT_FAMILIES = {
    "view": "brand and product funnel", "click": "open-ended grounding", "signup": "qualification and respondent universe", "error": "matrix behavior",
}


@query(
    "b11_question_relation_edges",
    f"""WITH e AS (SELECT user_id AS respondent_id, event_id AS pos, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_FAMILIES.items())} ELSE 'survey response chain' END AS family FROM events),
    r AS (SELECT respondent_id, lag(pos) OVER (PARTITION BY respondent_id ORDER BY pos) AS source, pos AS target, '{P.SEQUENTIAL}' AS relationship FROM e
      UNION ALL SELECT respondent_id, lag(pos) OVER (PARTITION BY respondent_id, family ORDER BY pos), pos,
        CASE family {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.FAMILY_RELATIONS.items())} ELSE '{P.ANY_FAMILY}' END FROM e)
    SELECT * FROM r WHERE source IS NOT NULL""",
)
def b11(spark, sf):
    """A user's events are the questions, in the order of their numbers, which have gaps."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("respondent_id"), "event_id", P.lookup(F.col("event_type"), EVENT_FAMILIES, "survey response chain").alias("family"))
    return P.relation_edges(e, "respondent_id", "event_id", "family")


@query(
    "b12_routing_subset",
    """SELECT d.doc_id AS respondent_id, d.lang AS dataset_id FROM documents d WHERE d.lang IN ('en', 'de') AND (contains(lower(source), '1') OR contains(lower(source), '7')) AND trim(coalesce(text, '')) <> ''
      AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def b12(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("respondent_id"), F.col("lang").alias("dataset_id"), "source", "text")
    d = P.routing_subset(d, "dataset_id", isin=("en", "de"))
    d = P.routing_subset(d, "source", contains=("1", "7"))
    d = P.routing_subset(d, "text")
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("respondent_id"))
    return d.join(labelled, "respondent_id", "left_semi").select("respondent_id", "dataset_id")


@query(
    "b13_timing_burden",
    """WITH w AS (SELECT CASE WHEN role = 'user' THEN 'closed_or_categorical' WHEN turn % 3 = 0 THEN 'matrix_or_grid' ELSE 'open_end' END AS role, len(regexp_extract_all(text, '[A-Za-z'']+')) AS n FROM conversations),
    b AS (SELECT role, n, CASE WHEN role IN ('open_end', 'qualification_or_persona') THEN 'high' WHEN role = 'matrix_or_grid' THEN 'medium to high' WHEN n > 18 THEN 'medium' ELSE 'low' END AS timing_burden FROM w)
    SELECT role AS field_role, timing_burden, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_words FROM b GROUP BY 1, 2""",
)
def b13(spark, sf):
    role = F.when(F.col("role") == "user", "closed_or_categorical").when(F.col("turn") % 3 == 0, "matrix_or_grid").otherwise("open_end")
    c = chain(spark, sf).select(role.alias("field_role"), X.word_count(F.col("text"), X.LATIN_WORD).alias("n"))
    c = c.withColumn("timing_burden", P.timing_burden(F.col("field_role"), F.col("n")))
    return c.groupBy("field_role", "timing_burden").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_words"))
