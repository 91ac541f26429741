"""Queries over grid and coded answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.operators import matrix as M
from respondex.plans.catalog import query
from respondex.plans.study import FRAME, answers, respondent_frame
from respondex.sources.tables import table

GRIDS = """g AS (SELECT l_orderkey AS id, 'returned' AS grid, l_returnflag AS v, l_linenumber AS line, l_partkey * 1000000 + l_suppkey AS tie FROM lineitem
  UNION ALL SELECT l_orderkey, 'shipped', l_linestatus, l_linenumber, l_partkey * 1000000 + l_suppkey FROM lineitem)"""
CELLS = f"{GRIDS}, c AS (SELECT id, grid, v, count(*) AS c FROM g GROUP BY 1, 2, 3), s AS (SELECT id, grid, CAST(sum(c) AS BIGINT) AS n_items, count(*) AS n_unique, max(c) AS modal_count, max(c) / sum(c)::DOUBLE AS modal_share FROM c GROUP BY 1, 2)"
ORDER = "(PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey * 1000000 + l_suppkey)"


def grids(spark, sf):
    a = answers(spark, sf)
    cells = F.explode(F.array(F.struct(F.lit("returned").alias("grid"), F.col("flag").alias("v")), F.struct(F.lit("shipped").alias("grid"), F.col("linestatus").alias("v"))))
    return a.select("respondent_id", cells.alias("x")).select("respondent_id", "x.grid", "x.v")


def numeric_grids(spark, sf):
    a = answers(spark, sf)
    cells = F.explode(F.array(
        F.struct(F.lit("quantity").alias("grid"), F.col("quantity").alias("v")), F.struct(F.lit("discount").alias("grid"), F.round(F.col("discount") * 100).alias("v"))
    ))
    return a.select("respondent_id", cells.alias("x")).select("respondent_id", "x.grid", "x.v")


def line_order(spark, sf):
    return answers(spark, sf).withColumn("tie", F.col("part") * 1000000 + F.col("supp"))


@query(
    "m01_straightline",
    f"WITH {CELLS} SELECT id AS respondent_id, grid, n_items, n_unique, modal_count, round(modal_share, 6) AS modal_share, CAST(n_items >= 5 AND modal_share >= 0.95 AS INTEGER) AS straightline FROM s",
)
def m01(spark, sf):
    return M.straightline(grids(spark, sf), ["respondent_id", "grid"], "v").withColumn("modal_share", F.round("modal_share", 6))


@query(
    "m02_matrix_features",
    f"""WITH {GRIDS}, c AS (SELECT id, v, count(*) AS c FROM g GROUP BY 1, 2), s AS (SELECT id, CAST(sum(c) AS BIGINT) AS n, count(*) AS u, max(c) AS m FROM c GROUP BY 1)
    SELECT id AS respondent_id, round(u / n::DOUBLE, 6) AS matrix_unique_ratio, CAST(u / n::DOUBLE <= 0.2 AND n >= 5 AS INTEGER) AS matrix_straightline, CAST(u / n::DOUBLE <= 0.4 AND n >= 5 AS INTEGER) AS matrix_near_straightline,
      n AS matrix_count, u AS matrix_unique_count, round(m / n::DOUBLE, 6) AS matrix_most_common_freq FROM s""",
)
def m02(spark, sf):
    return M.matrix_features(grids(spark, sf), "respondent_id", "v")


@query(
    "m03_matrix_modal_max",
    f"""WITH {CELLS} SELECT id AS respondent_id, round(coalesce(max(CASE WHEN n_items >= 4 THEN modal_share END), 0), 6) AS matrix_modal_max, max(CASE WHEN n_items >= 4 AND modal_share >= 0.92 AND n_unique <= 2 THEN 1 ELSE 0 END) AS matrix_uniform FROM s GROUP BY 1""",
)
def m03(spark, sf):
    return M.modal_max(grids(spark, sf), "respondent_id", "grid", "v").withColumn("matrix_modal_max", F.round("matrix_modal_max", 6))


@query(
    "m04_per_grid_straightlining",
    f"""WITH {CELLS} SELECT id AS respondent_id, count(*) AS n_grids, CAST(sum(CASE WHEN n_unique / n_items::DOUBLE <= 0.34 AND n_items >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_straightlined, round(avg(n_unique / n_items::DOUBLE), 6) AS mean_unique_ratio, round(min(n_unique / n_items::DOUBLE), 6) AS min_unique_ratio FROM s GROUP BY 1""",
)
def m04(spark, sf):
    return M.per_grid_straightlining(grids(spark, sf), "respondent_id", "grid", "v", max_ratio=0.34)


NUM = """n AS (SELECT l_orderkey AS id, 'quantity' AS grid, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, 'discount', round(l_discount * 100) FROM lineitem),
  st AS (SELECT id, grid, count(*) AS n_items, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, max(v) - min(v) AS range, count(DISTINCT v) AS "unique" FROM n GROUP BY 1, 2)"""


@query(
    "m05_matrix_group_stats",
    f"""WITH {NUM} SELECT id AS respondent_id, grid, n_items, round(mean, 5) AS mean, round(std, 5) AS std, min, max, range, "unique", CAST("unique" <= 1 AS INTEGER) AS is_straightline FROM st""",
)
def m05(spark, sf):
    s = M.group_stats(numeric_grids(spark, sf), "respondent_id", "grid", "v")
    return s.withColumn("mean", F.round("mean", 5)).withColumn("std", F.round("std", 5))


@query(
    "m05_group_consistency",
    f"WITH {NUM} SELECT id AS respondent_id, count(*) AS n_grids, round(var_pop(mean), 5) AS mean_variance, round(avg(std), 5) AS avg_std, round(max(mean) - min(mean), 5) AS mean_range FROM st GROUP BY 1",
)
def m05b(spark, sf):
    out = M.group_consistency(M.group_stats(numeric_grids(spark, sf), "respondent_id", "grid", "v"), "respondent_id")
    return out.select("respondent_id", "n_grids", *[F.round(c, 5).alias(c) for c in ("mean_variance", "avg_std", "mean_range")])


@query(
    "m06_run_lengths",
    f"""WITH a AS (SELECT l_orderkey AS id, row_number() OVER w AS rn, CASE WHEN lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS ch FROM lineitem WINDOW w AS {ORDER}),
    b AS (SELECT id, sum(ch) OVER (PARTITION BY id ORDER BY rn) AS run FROM a), r AS (SELECT id, run, count(*) AS len FROM b GROUP BY 1, 2)
    SELECT id AS respondent_id, max(len) AS longest_run, round(avg(len), 6) AS mean_run, count(*) AS n_runs, CAST(sum(len) AS BIGINT) AS n_items, count(*) - 1 AS transitions, round((count(*) - 1) / greatest(sum(len) - 1, 1)::DOUBLE, 6) AS transition_rate FROM r GROUP BY 1""",
)
def m06(spark, sf):
    out = M.run_lengths(line_order(spark, sf), "respondent_id", "line", "tie", "flag")
    return out.withColumn("mean_run", F.round("mean_run", 6)).withColumn("transition_rate", F.round("transition_rate", 6))


@query(
    "m07_half_variance_ratio",
    f"""WITH a AS (SELECT l_orderkey AS id, l_quantity AS v, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS {ORDER}),
    s AS (SELECT id, coalesce(var_pop(v) FILTER (rn <= n // 2), 0) AS v1, coalesce(var_pop(v) FILTER (rn > n // 2), 0) AS v2 FROM a GROUP BY 1)
    SELECT id AS respondent_id, round(v1, 5) AS var_first_half, round(v2, 5) AS var_second_half, round((v2 + 0.01::DOUBLE) / (v1 + 0.01::DOUBLE), 4) AS var_ratio FROM s""",
)
def m07(spark, sf):
    out = M.half_variance_ratio(line_order(spark, sf), "respondent_id", "line", "tie", "quantity")
    return out.select("respondent_id", F.round("var_first_half", 5).alias("var_first_half"), F.round("var_second_half", 5).alias("var_second_half"), F.round("var_ratio", 4).alias("var_ratio"))


@query(
    "m08_answer_entropy",
    f"""WITH {GRIDS}, c AS (SELECT id, v, count(*) AS c FROM g GROUP BY 1, 2), p AS (SELECT id, c / sum(c) OVER (PARTITION BY id)::DOUBLE AS p, sum(c) OVER (PARTITION BY id) AS n FROM c)
    SELECT id AS respondent_id, round(-sum(p * log2(p)), 6) + 0.0 AS answer_entropy, round(max(p), 6) AS answer_max_freq, round(count(*) / max(n)::DOUBLE, 6) AS answer_unique_ratio FROM p GROUP BY 1""",
)
def m08(spark, sf):
    out = M.answer_entropy(grids(spark, sf), "respondent_id", "v")
    return out.select("respondent_id", (F.round("answer_entropy", 6) + 0.0).alias("answer_entropy"), F.round("answer_max_freq", 6).alias("answer_max_freq"), F.round("answer_unique_ratio", 6).alias("answer_unique_ratio"))


@query(
    "m09_value_share",
    f"""WITH a AS (SELECT l_orderkey AS id, ceil(l_quantity / 10) AS v FROM lineitem) SELECT id AS respondent_id, count(v) AS n_items, {', '.join(f"round(count(*) FILTER (v = {i}) / count(v)::DOUBLE, 6) AS pct_{i}" for i in range(1, 6))},
      round(count(*) FILTER (v <= 2) / count(v)::DOUBLE, 6) AS pct_low_box, round(count(*) FILTER (v >= 4) / count(v)::DOUBLE, 6) AS pct_high_box FROM a GROUP BY 1""",
)
def m09(spark, sf):
    out = M.value_shares(answers(spark, sf).select("respondent_id", F.ceil(F.col("quantity") / 10).alias("v")), "respondent_id", "v")
    return out.select("respondent_id", "n_items", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("pct_")])


@query(
    "m10_coded_ngram_diversity",
    """WITH a AS (SELECT user_id AS id, event_type AS v, lag(event_type, 1) OVER w AS p1, lag(event_type, 2) OVER w AS p2, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    f AS (SELECT * FROM a WHERE n > 2), b AS (SELECT id, p1, v, count(*) AS c FROM f WHERE p1 IS NOT NULL GROUP BY ALL), t AS (SELECT id, p2, p1, v, count(*) AS c FROM f WHERE p2 IS NOT NULL GROUP BY ALL), o AS (SELECT id, v, count(*) AS c FROM f GROUP BY ALL),
    bb AS (SELECT id, count(*) AS bigram_unique, round(count(*) / sum(c)::DOUBLE, 6) AS bigram_diversity, max(c) AS bigram_top_freq FROM b GROUP BY 1), tt AS (SELECT id, count(*) AS trigram_unique, round(count(*) / sum(c)::DOUBLE, 6) AS trigram_diversity FROM t GROUP BY 1),
    oo AS (SELECT id, max(c) AS max_repeat, round(max(c) / sum(c)::DOUBLE, 6) AS max_repeat_pct, count(*) FILTER (c = 1) AS single_answers, round(count(*) FILTER (c = 1) / count(*)::DOUBLE, 6) AS single_pct FROM o GROUP BY 1)
    SELECT id AS user_id, * EXCLUDE (id) FROM oo JOIN bb USING (id) JOIN tt USING (id)""",
)
def m10(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "event_type")
    out = M.ngram_diversity(e, "user_id", "t", "event_id", "event_type")
    for c in ("bigram_diversity", "trigram_diversity", "max_repeat_pct", "single_pct"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "m11_coded_diversity",
    """SELECT user_id, count(*) AS coded_count, round(count(DISTINCT event_type) / count(*)::DOUBLE, 6) AS coded_unique_ratio, count(*) FILTER (event_type = 'error') AS coded_dk_count,
      round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS coded_dk_ratio, round(count(*) FILTER (event_type IN ('view', 'none')) / count(*)::DOUBLE, 6) AS coded_none_pct FROM events GROUP BY 1""",
)
def m11(spark, sf):
    out = M.coded_diversity(table(spark, sf, "events").select("user_id", "event_type"), "user_id", "event_type", ("error",), ("view", "none"))
    for c in ("coded_unique_ratio", "coded_dk_ratio", "coded_none_pct"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "m12_round_allocation",
    """SELECT o_custkey AS respondent_id, count(*) AS n_values, round(avg(CAST(l_quantity IN (0, 10, 20, 25, 33, 34, 50, 90, 95, 100) AS INTEGER)), 6) AS round_share,
      CAST(count(*) >= 12 AND avg(CAST(l_quantity IN (0, 10, 20, 25, 33, 34, 50, 90, 95, 100) AS INTEGER)) >= 0.2 AS INTEGER) AS round_allocation FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def m12(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("respondent_id"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    out = M.round_allocation(li.join(o, "k"), "respondent_id", "l_quantity", min_share=0.2)
    return out.withColumn("round_share", F.round("round_share", 6))


@query(
    "m13_question_outliers",
    """WITH a AS (SELECT l_orderkey AS id, 'q' || l_linenumber AS f, l_extendedprice AS v FROM lineitem), s AS (SELECT f, avg(v) AS qm, stddev_pop(v) AS qs, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM a GROUP BY 1 HAVING count(*) > 10),
    z AS (SELECT id, abs(v - qm) / (qs + 1e-6::DOUBLE) AS z, CAST(v < q25 - 1.5 * (q75 - q25) OR v > q75 + 1.5 * (q75 - q25) AS INTEGER) AS o FROM a JOIN s USING (f))
    SELECT id AS respondent_id, round(avg(z), 5) AS mean_z, round(max(z), 5) AS max_z, round(stddev_pop(z), 5) AS std_z, CAST(sum(o) AS BIGINT) AS iqr_outlier_count, round(avg(o), 6) AS iqr_outlier_pct, round(avg(CAST(z > 3 AS INTEGER)), 6) AS extreme_z_pct FROM z GROUP BY 1""",
)
def m13(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("respondent_id"), F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_extendedprice").alias("v"))
    out = M.question_outliers(a, "respondent_id", "field", "v")
    for c, d in (("mean_z", 5), ("max_z", 5), ("std_z", 5), ("iqr_outlier_pct", 6), ("extreme_z_pct", 6)):
        out = out.withColumn(c, F.round(c, d))
    return out


@query(
    "m14_prevalence_gate",
    f"""WITH {GRIDS}, c AS (SELECT id, v, count(*) AS c FROM g GROUP BY 1, 2), s AS (SELECT id, sum(c) AS n, count(*) AS u, max(c) AS m FROM c GROUP BY 1),
    f AS (SELECT CAST(n >= 5 AND u / n::DOUBLE <= 0.2 AS INTEGER) AS straight, CAST(n >= 5 AND u / n::DOUBLE <= 0.4 AS INTEGER) AS near_straight, CAST(n >= 2 AS INTEGER) AS answered, CAST(n >= 20 AS INTEGER) AS very_long FROM s),
    u AS (SELECT 'straight' AS signal, straight AS v FROM f UNION ALL SELECT 'near_straight', near_straight FROM f UNION ALL SELECT 'answered', answered FROM f UNION ALL SELECT 'very_long', very_long FROM f)
    SELECT signal, count(*) AS n_rows, CAST(sum(v) AS BIGINT) AS n_present, round(avg(v), 6) AS prevalence, CASE WHEN avg(v) > 0.85 THEN 'context_only' WHEN avg(v) > 0.8 THEN 'not_scored' WHEN avg(v) < 0.01 THEN 'sparse' ELSE 'active' END AS gate FROM u GROUP BY 1""",
)
def m14(spark, sf):
    f = M.matrix_features(grids(spark, sf), "respondent_id", "v").select(
        "respondent_id", F.col("matrix_straightline").alias("straight"), F.col("matrix_near_straightline").alias("near_straight"),
        (F.col("matrix_count") >= 2).cast("int").alias("answered"), (F.col("matrix_count") >= 20).cast("int").alias("very_long"),
    )
    return M.prevalence_gate(f, "respondent_id", ("straight", "near_straight", "answered", "very_long")).withColumn("prevalence", F.round("prevalence", 6))


@query(
    "m15_missingness",
    f"""WITH {FRAME}, m AS (SELECT respondent_id, (CAST(rejected IS NULL AS INTEGER) + CAST(toxic IS NULL AS INTEGER) + CAST(qtime IS NULL AS INTEGER) + CAST(n_items IS NULL AS INTEGER) + CAST(open_text IS NULL OR trim(open_text) = '' AS INTEGER)) / 5.0::DOUBLE AS r FROM frame)
    SELECT respondent_id, round(r, 6) AS missing_rate, CAST(r > 0.55 AS INTEGER) AS high_missing_55, CAST(r > 0.6 AS INTEGER) AS high_missing_60 FROM m""",
)
def m15(spark, sf):
    out = M.missingness(respondent_frame(spark, sf), ("rejected", "toxic", "qtime", "n_items", "open_text"))
    return out.select("respondent_id", F.round("missing_rate", 6).alias("missing_rate"), "high_missing_55", "high_missing_60")


@query(
    "m16_matrix_severity",
    f"""WITH a AS (SELECT l_orderkey AS id, l_returnflag AS v, row_number() OVER w AS rn, CASE WHEN lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS ch FROM lineitem WINDOW w AS {ORDER}),
    r AS (SELECT id, sum(ch) AS runs, count(*) AS n FROM a GROUP BY 1), s AS (SELECT id, max(c) / sum(c)::DOUBLE AS m, count(*) / sum(c)::DOUBLE AS u FROM (SELECT id, v, count(*) AS c FROM a GROUP BY 1, 2) GROUP BY 1)
    SELECT id AS respondent_id, round(least(1.0::DOUBLE, (0.5::DOUBLE * m + 0.3::DOUBLE * (1 - u) + 0.2::DOUBLE * (1 - (runs - 1) / greatest(n - 1, 1)::DOUBLE)) * least(1.0::DOUBLE, n / 5.0::DOUBLE)), 6) AS matrix_severity FROM r JOIN s USING (id)""",
)
def m16(spark, sf):
    runs = M.run_lengths(line_order(spark, sf), "respondent_id", "line", "tie", "flag")
    stats = M.straightline(answers(spark, sf), ["respondent_id"], "flag").select("respondent_id", "modal_share", (F.col("n_unique") / F.col("n_items")).alias("u"))
    out = runs.join(stats, "respondent_id")
    return out.select("respondent_id", F.round(M.severity(F.col("modal_share"), F.col("u"), F.col("n_items"), F.col("transition_rate")), 6).alias("matrix_severity"))
