"""Queries over exact copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.operators import duplicates as D
from respondex.plans.catalog import query
from respondex.plans.study import STUDY, client_labels, norm_sql, q
from respondex.plans.text_queries import SIG_SQL, lines_as_fields
from respondex.sources.tables import spread, table

COMPACT = "array_to_string(list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 3), ' ')"


def docs(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    return d.select(F.col("doc_id").alias("respondent_id"), F.col("lang").alias("dataset_id"), F.col("source").alias("supplier"), F.col("text").alias("open_text"))


@query(
    "s01_exact_duplicates",
    f"""WITH t AS (SELECT doc_id AS respondent_id, {norm_sql('text')} AS t FROM documents)
    SELECT respondent_id, CASE WHEN t = '' THEN 0 ELSE count(*) OVER (PARTITION BY t) END AS dup_count, CAST(t <> '' AND count(*) OVER (PARTITION BY t) > 1 AS INTEGER) AS is_duplicate FROM t""",
)
def s01(spark, sf):
    return D.exact_duplicates(docs(spark, sf).select("respondent_id", "open_text"), "respondent_id", "open_text").drop("open_text")


@query(
    "s02_duplicate_text_groups",
    f"""WITH t AS (SELECT doc_id AS id, lang AS field, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents), k AS (SELECT id, field, md5(lower(s)) AS text_hash, row_number() OVER (PARTITION BY field, lower(s) ORDER BY id) AS rn FROM t WHERE length(s) >= 16)
    SELECT field, text_hash, count(*) AS members, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (rn <= 10) AS first_ids FROM k GROUP BY 1, 2 HAVING count(*) > 1""",
)
def s02(spark, sf):
    g = D.duplicate_groups(docs(spark, sf).withColumnRenamed("dataset_id", "field"), "respondent_id", "field", "open_text")
    return g.withColumn("first_ids", F.array_join(F.transform("first_ids", lambda x: x.cast("string")), ","))


@query(
    "s03_duplicate_values",
    f"""WITH l AS (SELECT lang AS field, unnest(string_split(text, chr(10))) AS line FROM documents), v AS (SELECT field, {COMPACT.format(c='line')} AS value FROM l)
    SELECT field, value, count(*) AS n_rows FROM v WHERE length(value) >= 20 AND NOT regexp_matches(value, {q(STUDY.placeholder_pattern)}) GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def s03(spark, sf):
    lines = docs(spark, sf).select(F.col("dataset_id").alias("field"), F.explode(F.split("open_text", "\n")).alias("line"))
    return D.duplicate_values(lines, "field", "line", STUDY, 20)


@query(
    "s04_duplicate_cluster_type",
    f"""WITH t AS (SELECT md5({norm_sql('text')}) AS k, source, lang FROM documents WHERE {norm_sql('text')} <> '')
    , g AS (SELECT k, count(*) AS n_rows, count(DISTINCT source) AS supplier_n, count(DISTINCT lang) AS dataset_id_n FROM t GROUP BY 1)
    SELECT *, CASE WHEN n_rows <= 1 THEN 'single' WHEN supplier_n <= 1 AND dataset_id_n <= 1 THEN 'shared_response_chain' ELSE 'independent_duplicate_cluster' END AS cluster_type FROM g""",
)
def s04(spark, sf):
    d = docs(spark, sf).select(D.text_key("open_text").alias("k"), "supplier", "dataset_id")
    return D.cluster_types(d, "k", ["supplier", "dataset_id"])


@query(
    "s05_template_clusters",
    f"""WITH s AS (SELECT doc_id AS respondent_id, {SIG_SQL.format(c='text')} AS g FROM documents), n AS (SELECT respondent_id, CASE WHEN length(g) >= 24 THEN count(*) OVER (PARTITION BY g) ELSE 0 END AS cluster_size FROM s)
    SELECT respondent_id, cluster_size, CAST(cluster_size >= 2 AS INTEGER) AS template_cluster FROM n""",
)
def s05(spark, sf):
    return D.template_clusters(docs(spark, sf).select("respondent_id", "open_text"), "respondent_id", "open_text", STUDY).drop("open_text")


@query(
    "s06_rejected_only_duplicates",
    f"""WITH l AS (SELECT doc_id AS id, 1 - quality AS r, unnest(string_split(text, chr(10))) AS line FROM documents JOIN labels USING (doc_id)), v AS (SELECT DISTINCT id, r, {COMPACT.format(c='line')} AS value FROM l)
    SELECT value, count(*) FILTER (r = 1) AS rejected_rows, count(*) FILTER (r = 0) AS accepted_rows FROM v WHERE length(value) >= 10 GROUP BY 1 HAVING count(*) FILTER (r = 1) >= 2 AND count(*) FILTER (r = 0) = 0""",
)
def s06(spark, sf):
    lines = lines_as_fields(spark, sf).join(client_labels(spark, sf).select("respondent_id", "rejected"), "respondent_id")
    return D.rejected_only_duplicates(lines, "respondent_id", "line", "rejected")
