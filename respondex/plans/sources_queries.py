"""Queries over scans, normalisation, melting, codebooks and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from respondex.functions import ranking as R
from respondex.functions import text as X
from respondex.operators import profiling as P
from respondex.plans.catalog import query
from respondex.plans.study import RESP, answers, chain, client_labels, profiles, respondents, sessions
from respondex.session import ensure_checkpoint_dir
from respondex.sources import tables as S


@query("a01_load_responses", "SELECT doc_id, lang, source, n_chars FROM documents")
def a01(spark, sf):
    return S.load_responses(spark, f"{sf}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


@query(
    "a02_latest_judgments",
    """SELECT conv_id AS respondent_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text, arg_max(length(text), turn) AS evidence_chars, count(*) AS n_versions
    FROM conversations GROUP BY 1""",
)
def a02(spark, sf):
    """The turns of each conversation are versions of a judgment, delivered as chunk files of both layouts and read back."""
    root = f"{ensure_checkpoint_dir(spark)}/judgments_{uuid.uuid4().hex}"
    evidence = F.to_json(F.struct(F.length("text").alias("chars"), F.array("role").alias("families"))).alias("evidence")
    given = chain(spark, sf).select("respondent_id", "turn", "role", "text", evidence)
    even = F.pmod("respondent_id", F.lit(2)) == 0
    given.where(even).write.json(f"{root}/lines")
    # one array of at most a hundred respondents a file
    odd = given.where(~even).groupBy(F.floor(F.col("respondent_id") / 100).alias("chunk")).agg(F.to_json(F.collect_list(F.struct(*given.columns)), {"pretty": "true"}).alias("value"))
    odd.write.partitionBy("chunk").text(f"{root}/arrays")
    read = S.load_judgments(
        spark, root, "respondent_id long, turn long, role string, text string, evidence string", "*.json", "*.txt", "evidence", "chars int, families array<string>"
    )
    latest = S.latest_per_id(read.where("corrupt_record IS NULL AND NOT evidence_bad").drop("corrupt_record", "evidence_bad", "chunk_file"), "respondent_id", ["turn"])
    return latest.select("respondent_id", "turn", "role", "text", F.col("evidence.chars").cast("long").alias("evidence_chars"), "n_versions")


CANON = "nullif(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '^(-?[0-9]+)\\.0+$', '\\1'), '')"


@query(
    "a03_normalize_values",
    f"""SELECT kind, value, count(*) AS n FROM (
      SELECT 'quantity' AS kind, {CANON.format(c='CAST(l_quantity AS VARCHAR)')} AS value FROM lineitem
      UNION ALL SELECT 'line', {CANON.format(c='line')} FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1, 2""",
)
def a03(spark, sf):
    numbers = S.table(spark, sf, "lineitem").select(F.lit("quantity").alias("kind"), X.canonical(F.col("l_quantity")).alias("value"))
    lines = S.table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select(F.lit("line").alias("kind"), X.canonical(F.col("line")).alias("value"))
    return numbers.unionByName(lines).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


FIELD_ROLES = {"segment": "demographic", "balance": "numeric", "nation": "demographic", "region": "demographic"}


@query(
    "a04_answers_long",
    f"""WITH p AS (SELECT c_custkey AS respondent_id, c_mktsegment AS segment, CAST(c_acctbal AS VARCHAR) AS balance, n_name AS nation, r_name AS region
      FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey),
    u AS ({' UNION ALL '.join(f"SELECT respondent_id, '{f}' AS field_name, {f} AS raw_value, '{r}' AS field_role FROM p" for f, r in FIELD_ROLES.items())})
    SELECT respondent_id, field_name, raw_value, {CANON.format(c='raw_value')} AS normalized_value, field_role FROM u""",
)
def a04(spark, sf):
    roles = spark.createDataFrame(list(FIELD_ROLES.items()), "field_name string, field_role string")
    return P.to_answers_long(profiles(spark, sf), ["respondent_id"], roles, list(FIELD_ROLES))


LINE_FIELDS = ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(
    "a04_reconciliation",
    f"""WITH u AS ({' UNION ALL '.join(f"SELECT '{c}' AS field_name, {CANON.format(c=f'CAST({c} AS VARCHAR)')} AS v FROM lineitem" for c in LINE_FIELDS)})
    SELECT field_name, count(*) AS n_rows, count(v) AS n_answered, count(DISTINCT v) AS n_distinct FROM u GROUP BY 1""",
)
def a04b(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_orderkey", *LINE_FIELDS)
    return P.reconcile_counts(P.melt(li, ["l_orderkey"], LINE_FIELDS))


@query(
    "a05_union_corpora",
    """WITH u AS (SELECT 'docs_' || lang AS dataset_id, doc_id AS respondent_id, text AS open_text, source AS supplier, NULL::BIGINT AS turn FROM documents
      UNION ALL SELECT 'bank', item_id, text, NULL, NULL FROM benchmark UNION ALL SELECT 'talk', conv_id, text, NULL, turn FROM conversations)
    SELECT dataset_id, respondent_id, supplier, turn, length(open_text) AS n_chars, row_number() OVER (PARTITION BY dataset_id ORDER BY respondent_id, turn) + 1 AS source_row_number FROM u""",
)
def a05(spark, sf):
    docs = respondents(spark, sf).select("respondent_id", "dataset_id", "open_text", "supplier")
    docs = docs.withColumn("dataset_id", F.concat(F.lit("docs_"), F.col("dataset_id")))
    bank = S.table(spark, sf, "benchmark").select(F.col("item_id").alias("respondent_id"), F.col("text").alias("open_text"))
    talk = chain(spark, sf).select("respondent_id", F.col("text").alias("open_text"), "turn")
    u = docs.unionByName(S.union_corpora({"bank": bank, "talk": talk}), allowMissingColumns=True)
    u = u.withColumn("n_chars", F.length("open_text")).drop("open_text")
    out = R.positions(u.withColumn("_turn", F.coalesce("turn", F.lit(0))), ["dataset_id"], "respondent_id", "_turn", out="source_row_number").drop("_turn")
    return out.withColumn("source_row_number", F.col("source_row_number") + 1)


CODEBOOK_SQL = """rows AS (
    SELECT n_name AS sheet, 0 AS ord, '[' || n_name || ']: Which segments live in ' || r_name || '?' AS a, NULL AS b, NULL AS c FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT n_name, 1, '[' || n_name || 'r1]: ', NULL, NULL FROM nation
    UNION ALL SELECT n_name, 2 + dense_rank() OVER (PARTITION BY n_name ORDER BY c_mktsegment), NULL, CAST(length(c_mktsegment) AS VARCHAR) || '.0', c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(
    "a06_build_codebook",
    f"""WITH {CODEBOOK_SQL}, l AS (SELECT sheet || 'r1' AS field_name, regexp_replace(b, '\\.0+$', '') AS value, arg_max(c, ord) AS label FROM rows WHERE b IS NOT NULL GROUP BY 1, 2),
    h AS (SELECT sheet AS field_name, trim(regexp_replace(a, '^\\[[^\\]]+\\][: ]*', '')) AS question_text FROM rows WHERE ord = 0)
    SELECT field_name, question_text, NULL AS labels FROM h
    UNION ALL SELECT field_name, question_text, string_agg(value || '=' || label, '; ' ORDER BY value) FROM l JOIN (SELECT field_name || 'r1' AS field_name, question_text FROM h) USING (field_name) GROUP BY 1, 2""",
)
def a06(spark, sf):
    """Codebook sheets, one per nation, written as stacked rows from the tables and read back."""
    n = S.table(spark, sf, "nation").join(S.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    head = n.select(
        F.col("n_name").alias("sheet"), F.lit(0).alias("ord"),
        F.concat(F.lit("["), "n_name", F.lit("]: Which segments live in "), "r_name", F.lit("?")).alias("a"), none.alias("b"), none.alias("c"),
    )
    child = n.select(F.col("n_name").alias("sheet"), F.lit(1).alias("ord"), F.concat(F.lit("["), "n_name", F.lit("r1]: ")).alias("a"), none.alias("b"), none.alias("c"))
    seg = (
        S.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("sheet"), "c_mktsegment").agg(F.lit(1).alias("one"))
    )
    label = seg.select(
        "sheet", (F.lit(2) + F.row_number().over(W.partitionBy("sheet").orderBy("c_mktsegment"))).alias("ord"), none.alias("a"),
        F.concat(F.length("c_mktsegment").cast("string"), F.lit(".0")).alias("b"), F.col("c_mktsegment").alias("c"),
    )
    heads, labels = P.build_codebook(head.unionByName(child).unionByName(label), "ord", "sheet")
    heads = P.inherit_prompts(heads, ["sheet"])
    per_field = labels.groupBy("sheet", "field_name").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("value", F.lit("="), "label"))), "; ").alias("labels")
    )
    return heads.join(per_field, ["sheet", "field_name"], "left").drop("sheet")


@query(
    "a07_decode_labels",
    """WITH k AS (SELECT DISTINCT split_part(o_orderpriority, '-', 1) AS value, split_part(o_orderpriority, '-', 2) AS label FROM orders WHERE o_orderpriority NOT LIKE '4%'),
    d AS (SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS value FROM orders)
    SELECT decoded, count(*) AS n FROM (SELECT CASE WHEN label IS NULL THEN d.value ELSE d.value || '=' || label END AS decoded FROM d LEFT JOIN k USING (value)) GROUP BY 1""",
)
def a07(spark, sf):
    pr = F.col("o_orderpriority")
    o = S.table(spark, sf, "orders").select(
        F.lit("priority").alias("field_name"), F.split_part(pr, F.lit("-"), F.lit(1)).alias("value"), F.split_part(pr, F.lit("-"), F.lit(2)).alias("label")
    )
    codebook = o.where("value <> '4'").dropDuplicates(["field_name", "value"])
    return P.decode_labels(o.drop("label"), codebook).groupBy("decoded").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a08_write_tables",
    "SELECT f.fmt, count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_segments FROM customer, (VALUES ('parquet'), ('csv'), ('json'), ('orc')) f(fmt) GROUP BY 1",
)
def a08(spark, sf):
    """Writes the profile in four formats into the shared checkpoint folder and reads it back."""
    root = f"{ensure_checkpoint_dir(spark)}/written_tables_{spark.sparkContext.applicationId}"
    p = profiles(spark, sf)
    out = None
    for fmt in ("parquet", "csv", "json", "orc"):
        path = S.write_tables({f"profile_{fmt}": p}, root, fmt)[0]
        back = S.load_responses(spark, path, fmt, schema=p.schema if fmt in ("csv", "json") else None)
        n = back.groupBy("segment").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_segments"))
        n = n.withColumn("fmt", F.lit(fmt))
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "a09_corpus_inventory",
    f"""WITH {RESP} SELECT dataset_id, count(*) AS n_rows, count(DISTINCT supplier) AS n_suppliers, count(rejected) AS n_labelled,
      count(*) FILTER (rejected = 0) AS n_accepted, count(*) FILTER (rejected = 1) AS n_rejected, 6 AS n_columns, 'respondent_id' AS id_columns, '' AS timing_columns, '' AS leakage_columns FROM resp GROUP BY 1""",
)
def a09(spark, sf):
    r = respondents(spark, sf)
    per = r.groupBy("dataset_id", "supplier").agg(
        F.count(F.lit(1)).alias("n"), F.count("rejected").alias("l"), F.sum(F.when(F.col("rejected") == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("rejected") == 1, 1).otherwise(0)).alias("x")
    )
    names = r.columns
    return per.groupBy("dataset_id").agg(
        F.sum("n").alias("n_rows"), F.count("supplier").alias("n_suppliers"), F.sum("l").alias("n_labelled"), F.sum("a").alias("n_accepted"), F.sum("x").alias("n_rejected")
    ).select(
        "*", F.lit(len(names)).alias("n_columns"),
        F.lit(";".join(c for c in names if c.endswith("_id") and c != "dataset_id")).alias("id_columns"),
        F.lit(";".join(c for c in names if "time" in c)).alias("timing_columns"),
        F.lit(";".join(P.leakage_columns(names))).alias("leakage_columns"),
    )


@query(
    "a10_import_report",
    """SELECT 'duplicate_answer_keys' AS issue, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n_rows
    UNION ALL SELECT 'impossible_labels', (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1))
    UNION ALL SELECT 'blank_required_text', (SELECT count(*) FROM documents WHERE text IS NULL OR trim(text) = '')
    UNION ALL SELECT 'extreme_timing', (SELECT count(*) FROM (SELECT date_diff('microseconds', min(ts), max(ts)) / 1e6 AS d FROM events GROUP BY user_id, CAST(ts AS DATE)) WHERE d > 80000 OR d = 0)
    UNION ALL SELECT 'labels_without_respondent', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
    UNION ALL SELECT 'rejected_labels', (SELECT count(*) FROM labels WHERE quality = 0)""",
)
def a10(spark, sf):
    def one(name, df):
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("issue"), "n_rows")

    a = answers(spark, sf).groupBy("respondent_id", "line").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    labels = S.table(spark, sf, "labels")
    docs = S.table(spark, sf, "documents")
    parts = [
        one("duplicate_answer_keys", a),
        one("impossible_labels", labels.where(~F.col("quality").isin(0, 1))),
        one("blank_required_text", docs.where(F.col("text").isNull() | (F.trim("text") == ""))),
        one("extreme_timing", sessions(spark, sf).where("qtime > 80000 OR qtime = 0")),
        one("labels_without_respondent", labels.join(docs.select("doc_id"), "doc_id", "left_anti")),
        one("rejected_labels", labels.where("quality = 0")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "a11_source_payload_json",
    """WITH j AS (SELECT o_orderkey AS respondent_id, '{' || array_to_string(list_filter([
        '"o_orderkey":"' || o_orderkey || '"', CASE WHEN o_orderstatus <> 'P' THEN '"o_orderstatus":"' || o_orderstatus || '"' END,
        '"o_orderpriority":"' || o_orderpriority || '"', '"o_custkey":"' || o_custkey || '"'], lambda x: x IS NOT NULL), ',') || '}' AS p FROM orders)
    SELECT respondent_id, p AS payload, CASE WHEN length(p) <= 80 THEN p ELSE substr(p, 1, 77) || '...' END AS payload_preview FROM j""",
)
def a11(spark, sf):
    o = S.table(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    whole = payload_json(("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"))
    return o.select(F.col("o_orderkey").alias("respondent_id"), whole.alias("payload")).withColumn("payload_preview", shortened(F.col("payload"), 80))


def payload_json(columns):
    """Non-blank cells as JSON."""
    entries = []
    for c in columns:
        entries += [F.lit(c), X.squash(F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.to_json(F.map_filter(F.create_map(*entries), lambda k, v: v != ""))


def shortened(text, max_chars: int):
    """The text for a list view, cut at ``max_chars`` characters with "..."."""
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.substring(text, 1, max_chars - 3), F.lit("...")))


@query(
    "a12_pair_registry",
    """SELECT d.lang AS dataset_id, count(*) AS row_count, count(l.doc_id) AS labelled, count(*) FILTER (l.quality = 1) AS accepted, count(*) FILTER (l.quality = 0) AS rejected,
      (SELECT count(*) FROM labels x WHERE x.doc_id NOT IN (SELECT doc_id FROM documents)) AS unreconciled_labels FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def a12(spark, sf):
    r = respondents(spark, sf)
    lost = client_labels(spark, sf).join(r.select("respondent_id"), "respondent_id", "left_anti").agg(F.count(F.lit(1)).alias("unreconciled_labels"))
    per = r.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("rejected").alias("labelled"),
        F.sum(F.when(F.col("rejected") == 0, 1).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("rejected") == 1, 1).otherwise(0)).alias("rejected"),
    )
    return R.attach_row(per, lost)
