"""Queries over rates, lifts, interactions, effect sizes and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.operators import funnel as U
from respondex.operators import lift as D
from respondex.operators import neighbours as N
from respondex.operators import profiling as P
from respondex.operators import signals as G
from respondex.plans.catalog import query
from respondex.plans.study import SCORED, STUDY, RESP, answers, chain, client_labels, profiles, q, respondents, scored_frame
from respondex.sources.tables import table

LAB = f"WITH {SCORED}, lab AS (SELECT * FROM scored WHERE rejected IS NOT NULL)"
TRAIN = "respondent_id % 5 <> 0"


@query(
    "d01_supplier_stats",
    f"""WITH {RESP}, s AS (SELECT supplier, count(*) AS total, count(*) FILTER (rejected = 1) AS reject, count(*) FILTER (rejected = 0) AS accept FROM resp GROUP BY 1)
    SELECT *, round(reject / total::DOUBLE * 100, 1) AS reject_rate, CASE WHEN reject / total::DOUBLE * 100 >= 40 THEN 'high' WHEN reject / total::DOUBLE * 100 >= 20 THEN 'medium' WHEN reject / total::DOUBLE * 100 < 10 THEN 'low' ELSE 'moderate' END AS risk_level FROM s""",
)
def d01(spark, sf):
    return D.supplier_stats(respondents(spark, sf), "supplier")


@query(
    "d02_smoothed_rate",
    f"""WITH {RESP}, tr AS (SELECT * FROM resp WHERE rejected IS NOT NULL AND {TRAIN}), g AS (SELECT avg(rejected) AS g FROM tr), k AS (SELECT supplier, count(*) AS train_n, (sum(rejected) + 20 * g) / (count(*) + 20)::DOUBLE AS r FROM tr, g GROUP BY supplier, g)
    SELECT respondent_id, supplier, coalesce(train_n, 0) AS train_n, round(coalesce(r, g), 6) AS smoothed_rate FROM resp LEFT JOIN k USING (supplier), g""",
)
def d02(spark, sf):
    r = respondents(spark, sf).select("respondent_id", "supplier", "rejected")
    out = D.smoothed_rates(r, "supplier", "rejected", F.pmod("respondent_id", F.lit(5)) != 0)
    return out.select("respondent_id", "supplier", "train_n", F.round("smoothed_rate", 6).alias("smoothed_rate"))


@query(
    "d03_hierarchical_supplier",
    f"""WITH {RESP} SELECT supplier, dataset_id, CAST(grouping(dataset_id) AS INTEGER) AS is_total, count(*) AS n, CAST(sum(rejected) AS BIGINT) AS rejects, round(sum(rejected) / count(*)::DOUBLE, 6) AS reject_rate FROM resp WHERE rejected IS NOT NULL GROUP BY GROUPING SETS ((supplier), (supplier, dataset_id))""",
)
def d03(spark, sf):
    out = D.hierarchical_rates(respondents(spark, sf), "supplier", "dataset_id")
    return out.withColumn("is_total", F.col("is_total").cast("int")).withColumn("reject_rate", F.round("reject_rate", 6))


@query(
    "d04_target_encode",
    f"""WITH a AS (SELECT l_orderkey AS respondent_id, 'q' || l_linenumber || x.f AS field, x.v AS value FROM lineitem, LATERAL (VALUES ('flag', l_returnflag), ('band', CAST(CAST(floor(l_quantity / 10) AS INTEGER) AS VARCHAR))) x(f, v)),
    t AS (SELECT a.*, 1 - quality AS rejected FROM a JOIN labels ON doc_id = respondent_id WHERE {TRAIN}), g AS (SELECT avg(rejected) AS g FROM t)
    SELECT field, value, count(*) AS train_n, round((sum(rejected) + 10 * g) / (count(*) + 10)::DOUBLE, 6) AS encoded FROM t, g GROUP BY field, value, g""",
)
def d04(spark, sf):
    """Coded answers as they are, numeric ones in bands of ten."""
    a = answers(spark, sf)
    cells = F.explode(F.array(
        F.struct(F.concat("field", F.lit("flag")).alias("f"), F.col("flag").alias("v")), F.struct(F.concat("field", F.lit("band")).alias("f"), F.floor(F.col("quantity") / 10).cast("string").alias("v"))
    ))
    long_ = a.select("respondent_id", cells.alias("x")).select("respondent_id", F.col("x.f").alias("field"), F.col("x.v").alias("value"))
    long_ = long_.join(client_labels(spark, sf).select("respondent_id", "rejected"), "respondent_id")
    out = D.target_encoding(long_, "field", "value", "rejected", F.pmod("respondent_id", F.lit(5)) != 0)
    return out.withColumn("encoded", F.round("encoded", 6))


PREV = f"""{LAB}, ex AS (SELECT dataset_id, rejected, unnest(signals) AS signal FROM lab), ds AS (SELECT dataset_id, avg(rejected) AS base, count(*) FILTER (rejected = 0) AS acc FROM lab GROUP BY 1),
  prev AS (SELECT dataset_id, signal, count(*) FILTER (rejected = 0) AS accepted_hits, count(*) FILTER (rejected = 1) AS rejected_hits, count(*) AS support, avg(rejected) AS rate, base, CASE WHEN base > 0 THEN avg(rejected) / base ELSE 0 END AS lift, acc FROM ex JOIN ds USING (dataset_id) GROUP BY dataset_id, signal, base, acc)"""


@query(
    "d05_signal_prevalence",
    f"""{PREV} SELECT dataset_id, signal, accepted_hits, rejected_hits, support, round(rate, 6) AS reject_rate_when_present, round(base, 6) AS dataset_reject_rate, round(lift, 6) AS lift, round(accepted_hits / greatest(acc, 1)::DOUBLE, 6) AS false_positive_burden FROM prev""",
)
def d05(spark, sf):
    out = D.signal_prevalence(scored_frame(spark, sf), "dataset_id")
    return out.select("dataset_id", "signal", "accepted_hits", "rejected_hits", "support", *[F.round(c, 6).alias(c) for c in ("reject_rate_when_present", "dataset_reject_rate", "lift", "false_positive_burden")])


ROLE = """CASE WHEN support < 10 THEN 'needs_more_examples' WHEN r >= greatest(0.6, b * 1.75) THEN 'candidate_rejection_signal' WHEN r <= least(0.2, b * 0.55) THEN 'accepted_row_guardrail' ELSE 'context_signal' END"""
STATS = f"""{LAB}, ex AS (SELECT dataset_id, rejected, unnest(signals) AS signal FROM lab), b AS (SELECT avg(rejected) AS b, count(*) FILTER (rejected = 0) AS acc FROM lab),
  st AS (SELECT signal, count(*) AS support, count(*) FILTER (rejected = 1) AS rejected_hits, count(*) FILTER (rejected = 0) AS accepted_hits, count(DISTINCT dataset_id) AS datasets_present, avg(rejected) AS r FROM ex GROUP BY 1)"""


@query(
    "d06_signal_stats",
    f"""{STATS} SELECT signal, support, rejected_hits, accepted_hits, round(r, 4) AS reject_rate_when_present, round(b, 4) AS base_reject_rate, round(r / b, 4) AS lift, round(accepted_hits / acc::DOUBLE, 4) AS accepted_counterexample_rate,
    datasets_present, CASE WHEN support >= 25 AND r > b * 1.1 THEN 'promote_to_agent_instruction' ELSE 'hold_for_more_evidence' END AS promotion_decision FROM st, b""",
)
def d06(spark, sf):
    return D.signal_stats(scored_frame(spark, sf), "dataset_id").drop("signal_role")


@query("d07_signal_role", f"{STATS} SELECT signal, support, {ROLE} AS signal_role FROM st, b")
def d07(spark, sf):
    return D.signal_stats(scored_frame(spark, sf), "dataset_id").select("signal", "support", "signal_role")


TOP = "top AS (SELECT signal FROM prev GROUP BY 1 HAVING sum(support) > 0 ORDER BY round(avg(lift), 9) DESC, sum(support) DESC, signal LIMIT {k})"
PAIRS = f"""{PREV}, {TOP.format(k=14)}, k AS (SELECT respondent_id, dataset_id, rejected, unnest(signals) AS s FROM lab), kk AS (SELECT k.* FROM k JOIN top ON s = signal),
  pr AS (SELECT x.dataset_id, x.s AS signal_a, y.s AS signal_b, count(*) AS support, count(*) FILTER (x.rejected = 1) AS rejected_hits, count(*) FILTER (x.rejected = 0) AS accepted_hits, avg(x.rejected) AS r FROM kk x JOIN kk y ON x.respondent_id = y.respondent_id AND x.s < y.s GROUP BY 1, 2, 3 HAVING count(*) >= 5),
  pairs AS (SELECT pr.dataset_id, signal_a, signal_b, pr.support, pr.rejected_hits, pr.accepted_hits, round(r, 4) AS reject_rate, round(CASE WHEN ds.base > 0 THEN r / ds.base ELSE 0 END, 4) AS lift, round(r - greatest(a.rate, b.rate), 4) AS incremental_value, round(pr.accepted_hits / greatest(ds.acc, 1)::DOUBLE, 4) AS false_positive_burden
    FROM pr JOIN ds ON ds.dataset_id = pr.dataset_id JOIN prev a ON a.dataset_id = pr.dataset_id AND a.signal = signal_a JOIN prev b ON b.dataset_id = pr.dataset_id AND b.signal = signal_b)"""


@query("d08_pair_interactions", f"{PAIRS} SELECT * FROM pairs")
def d08(spark, sf):
    return D.pair_interactions(scored_frame(spark, sf), "dataset_id")


@query(
    "d08_pair_summary",
    f"{PAIRS} SELECT signal_a, signal_b, count(*) AS datasets, CAST(sum(support) AS BIGINT) AS support, CAST(sum(rejected_hits) AS BIGINT) AS rejected_hits, round(avg(lift), 6) AS mean_lift, round(avg(incremental_value), 6) AS mean_incremental_value FROM pairs GROUP BY 1, 2",
)
def d08b(spark, sf):
    out = D.pair_summary(D.pair_interactions(scored_frame(spark, sf), "dataset_id"), "dataset_id")
    return out.withColumn("mean_lift", F.round("mean_lift", 6)).withColumn("mean_incremental_value", F.round("mean_incremental_value", 6))


@query(
    "d09_triple_interactions",
    f"""{PREV}, kk AS (SELECT respondent_id, dataset_id, rejected, unnest(signals) AS s FROM lab), b AS (SELECT avg(rejected) AS b FROM lab),
    t AS (SELECT x.s || '|' || y.s || '|' || z.s AS pattern, count(*) AS support, count(*) FILTER (x.rejected = 1) AS rejected_hits, count(DISTINCT x.dataset_id) AS datasets, avg(x.rejected) AS r FROM kk x JOIN kk y ON x.respondent_id = y.respondent_id AND x.s < y.s JOIN kk z ON z.respondent_id = x.respondent_id AND y.s < z.s GROUP BY 1 HAVING count(*) >= 3)
    SELECT pattern, support, rejected_hits, datasets, round(r, 4) AS reject_rate, round(r / b, 4) AS lift, CASE WHEN rejected_hits >= 10 AND 1 - r <= 0.7 THEN 'candidate' ELSE 'hold_for_residual_review' END AS promotion_status FROM t, b""",
)
def d09(spark, sf):
    return D.triple_interactions(scored_frame(spark, sf), "dataset_id", min_support=3)


@query(
    "d10_signal_archetypes",
    f"""{LAB}, b AS (SELECT avg(rejected) AS b FROM lab) SELECT array_to_string(list_sort(signals), ' + ') AS archetype, count(*) AS support, count(*) FILTER (rejected = 1) AS rejects, round(avg(rejected), 4) AS reject_rate, round(avg(rejected) / b, 4) AS lift FROM lab, b GROUP BY 1, b""",
)
def d10(spark, sf):
    return D.archetypes(scored_frame(spark, sf))


@query(
    "d11_signal_count_thresholds",
    f"""{LAB}, n AS (SELECT len(signals) AS k, rejected FROM lab), t AS (SELECT unnest(range(1, 12)) AS threshold)
    SELECT CAST(threshold AS INTEGER) AS threshold, count(*) FILTER (k >= threshold AND rejected = 1) AS tp, count(*) FILTER (k >= threshold AND rejected = 0) AS fp,
      round(CASE WHEN count(*) FILTER (k >= threshold) > 0 THEN count(*) FILTER (k >= threshold AND rejected = 1) / count(*) FILTER (k >= threshold)::DOUBLE ELSE 0 END, 6) AS precision,
      round(count(*) FILTER (k >= threshold AND rejected = 1) / count(*) FILTER (rejected = 1)::DOUBLE, 6) AS recall,
      round((count(*) FILTER (k >= threshold AND rejected = 1) + count(*) FILTER (k < threshold AND rejected = 0)) / count(*)::DOUBLE, 6) AS accuracy FROM n, t GROUP BY 1""",
)
def d11(spark, sf):
    return D.count_thresholds(scored_frame(spark, sf), top=11)


NUMQ = ", ".join(f"quantile_cont(v, {p}) AS {n}" for n, p in D._PROBS.items())


@query(
    "d12_numeric_summary",
    f"""WITH x AS (SELECT l_returnflag AS field, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem), m AS (SELECT field, count(*) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, {NUMQ} FROM x GROUP BY 1),
    d AS (SELECT x.field, quantile_cont(abs(v - median), 0.5) AS mad, avg(least(greatest(v, p05), p95)) AS winsorized_mean FROM x JOIN m USING (field) GROUP BY 1),
    r AS (SELECT field, v, row_number() OVER (PARTITION BY field ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY field) AS n FROM x), t AS (SELECT field, avg(v) AS trimmed_mean FROM r WHERE i >= floor(n * 0.05::DOUBLE) AND i < floor(n * 0.95::DOUBLE) GROUP BY 1)
    SELECT field, count, min, max, {', '.join(f'round({c}, 5) AS {c}' for c in ('mean', 'std', 'p01', 'p05', 'p10', 'p25', 'median', 'p75', 'p90', 'p95', 'p99', 'mad', 'winsorized_mean', 'trimmed_mean'))}, round(p75 - p25, 5) AS iqr FROM m JOIN d USING (field) JOIN t USING (field)""",
)
def d12(spark, sf):
    li = table(spark, sf, "lineitem")
    x = li.select(F.col("l_returnflag").alias("field"), F.col("l_extendedprice").alias("v")).unionByName(li.select(F.lit("discount").alias("field"), F.col("l_discount").alias("v")))
    out = D.numeric_summary(x, ["field"], "v")
    return out.select("field", "count", "min", "max", *[F.round(c, 5).alias(c) for c in out.columns if c not in ("field", "count", "min", "max")])


@query(
    "d13_effect_sizes",
    f"""{LAB}, u AS (SELECT dataset_id, rejected, 'word_count' AS measure, word_count::DOUBLE AS v FROM lab UNION ALL SELECT dataset_id, rejected, 'unique_token_ratio', unique_token_ratio FROM lab UNION ALL SELECT dataset_id, rejected, 'modal_share', modal_share FROM lab WHERE modal_share IS NOT NULL),
    m AS (SELECT dataset_id, measure, avg(v) FILTER (rejected = 0) AS am, avg(v) FILTER (rejected = 1) AS rm, coalesce(var_samp(v) FILTER (rejected = 0), 0) AS va, coalesce(var_samp(v) FILTER (rejected = 1), 0) AS vb FROM u GROUP BY 1, 2),
    c AS (SELECT x.dataset_id, x.measure, sum(sign(x.v - y.v)) / count(*)::DOUBLE AS cd FROM u x JOIN u y ON x.dataset_id = y.dataset_id AND x.measure = y.measure AND x.rejected = 1 AND y.rejected = 0 GROUP BY 1, 2),
    h AS (SELECT dataset_id, 2 * (asin(sqrt(coalesce(avg(f_repeated_phrase) FILTER (rejected = 1), 0))) - asin(sqrt(coalesce(avg(f_repeated_phrase) FILTER (rejected = 0), 0)))) AS h FROM lab GROUP BY 1)
    SELECT dataset_id, measure, round(am, 5) AS accepted_mean, round(rm, 5) AS rejected_mean, round(CASE WHEN sqrt((va + vb) / 2) > 0 THEN (rm - am) / sqrt((va + vb) / 2) ELSE 0 END, 5) AS cohen_d, round(cd, 6) AS cliffs_delta, round(h, 6) AS repeated_phrase_cohen_h FROM m LEFT JOIN c USING (dataset_id, measure) JOIN h USING (dataset_id)""",
)
def d13(spark, sf):
    s = D.labelled(scored_frame(spark, sf))
    names = ["word_count", "unique_token_ratio", "modal_share"]
    u = s.select("dataset_id", "rejected", "respondent_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["dataset_id", "rejected", "respondent_id"], names, "measure", "v").where("v IS NOT NULL")
    d = D.cohen_d(u, ["dataset_id", "measure"], "v", "rejected")
    auc = P.auroc(u, ["dataset_id", "measure"], "v", "rejected").select("dataset_id", "measure", F.round(2 * F.col("auroc") - 1, 6).alias("cliffs_delta"))
    f = F.col("f_repeated_phrase")
    rates = s.groupBy("dataset_id").agg(
        F.coalesce(F.avg(F.when(F.col("rejected") == 1, f)), F.lit(0.0)).alias("rr"), F.coalesce(F.avg(F.when(F.col("rejected") == 0, f)), F.lit(0.0)).alias("ra")
    ).select("dataset_id", F.round(D.cohen_h(F.col("rr"), F.col("ra")), 6).alias("repeated_phrase_cohen_h"))
    out = d.join(auc, ["dataset_id", "measure"]).join(rates, "dataset_id")
    for c in ("accepted_mean", "rejected_mean", "cohen_d"):
        out = out.withColumn(c, F.round(c, 5))
    return out


@query(
    "d14_categorical_top_values",
    """WITH x AS (SELECT o_orderstatus AS field, o_orderpriority AS v FROM orders), c AS (SELECT field, v, count(*) AS c FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY c DESC, v) AS rn FROM c)
    SELECT field, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_distinct, round(max(c) / sum(c)::DOUBLE, 6) AS modal_share, '{' || string_agg('"' || v || '":' || c, ',' ORDER BY rn) FILTER (rn <= 3) || '}' AS top_values FROM r GROUP BY 1""",
)
def d14(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("v0"))
    return D.top_values(o, ["field"], "v0", 3).withColumn("modal_share", F.round("modal_share", 6))


@query(
    "d15_demographic_summary",
    """WITH p AS (SELECT c_mktsegment AS segment, CAST(c_acctbal AS VARCHAR) AS balance, n_name AS nation, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    u AS (SELECT 'segment' AS field_name, segment AS v FROM p UNION ALL SELECT 'nation', nation FROM p UNION ALL SELECT 'region', region FROM p UNION ALL SELECT 'balance', balance FROM p),
    c AS (SELECT field_name, v, count(*) AS c FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY c DESC, v) AS rn FROM c), t AS (SELECT field_name, count(*) AS n_distinct, '{' || string_agg('"' || v || '":' || c, ',' ORDER BY rn) FILTER (rn <= 8) || '}' AS top_values FROM r GROUP BY 1)
    SELECT field_name, count(*) AS respondents, count(v) AS nonempty_rows, count(*) - count(v) AS missing_rows, round(avg(try_cast(v AS DOUBLE)), 4) AS mean, min(try_cast(v AS DOUBLE)) AS min, max(try_cast(v AS DOUBLE)) AS max, round(quantile_cont(try_cast(v AS DOUBLE), 0.5), 4) AS median, n_distinct, top_values FROM u JOIN t USING (field_name) GROUP BY field_name, n_distinct, top_values""",
)
def d15(spark, sf):
    names = ["segment", "balance", "nation", "region"]
    out = D.demographic_summary(P.melt(profiles(spark, sf), ["respondent_id"], names), "field_name", "raw_value")
    return out.withColumn("mean", F.round("mean", 4)).withColumn("median", F.round("median", 4))


@query(
    "d16_tier_label_crosstab",
    f"""WITH {SCORED} SELECT operational_tier, count(*) FILTER (rejected = 0) AS accepted, count(*) FILTER (rejected = 1) AS rejected, count(*) FILTER (rejected IS NULL) AS unlabelled FROM scored GROUP BY 1""",
)
def d16(spark, sf):
    name = F.when(F.col("rejected") == 0, "accepted").when(F.col("rejected") == 1, "rejected").otherwise("unlabelled")
    s = scored_frame(spark, sf).select("operational_tier", name.alias("label"))
    return D.crosstab(s, "operational_tier", "label", ["accepted", "rejected", "unlabelled"])


@query(
    "d17_cross_dataset_meta",
    f"""{LAB}, u AS ({' UNION ALL '.join(f"SELECT dataset_id, rejected, '{c}' AS col, {c}::DOUBLE AS v FROM lab" for c in ('word_count', 'unique_token_ratio', 'modal_share'))}),
    b AS (SELECT dataset_id, col, count(*) FILTER (rejected = 0) AS an, avg(v) FILTER (rejected = 0) AS am, coalesce(stddev_samp(v) FILTER (rejected = 0), 0) AS asd, count(*) FILTER (rejected = 1) AS rn, avg(v) FILTER (rejected = 1) AS rm, coalesce(stddev_samp(v) FILTER (rejected = 1), 0) AS rsd FROM u GROUP BY 1, 2),
    a AS (SELECT x.dataset_id, x.col, sum(CASE WHEN x.v > y.v THEN 1.0::DOUBLE WHEN x.v = y.v THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS auc FROM u x JOIN u y ON x.dataset_id = y.dataset_id AND x.col = y.col AND x.rejected = 1 AND y.rejected = 0 AND x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY 1, 2),
    e AS (SELECT b.*, coalesce(auc, 0.5) AS auc, CASE WHEN sqrt((asd * asd + rsd * rsd) / 2) > 0 THEN (rm - am) / sqrt((asd * asd + rsd * rsd) / 2) ELSE 0 END AS eff FROM b LEFT JOIN a USING (dataset_id, col)),
    f AS (SELECT *, round(CASE WHEN auc < 0.5 THEN -eff ELSE eff END, 4) AS effect_size, round(CASE WHEN auc < 0.5 THEN 1 - auc ELSE auc END, 4) AS au FROM e)
    SELECT col AS "column", count(*) AS datasets, CAST(sum(an) AS BIGINT) AS support, CAST(sum(rn) AS BIGINT) AS rejected_support, round(avg(au), 6) AS mean_auroc, max(au) AS max_auroc, round(avg(effect_size), 6) AS mean_effect, round(stddev_samp(effect_size), 6) AS heterogeneity,
      CASE WHEN count(*) >= 5 THEN 'cross_dataset' WHEN count(*) >= 2 THEN 'survey_family_specific' ELSE 'survey_specific' END AS transfer_class FROM f GROUP BY 1""",
)
def d17(spark, sf):
    prof = P.profile_by_label(scored_frame(spark, sf), "dataset_id", "rejected", "respondent_id", ("word_count", "unique_token_ratio", "modal_share"))
    out = D.meta_over_datasets(prof, "column")
    for c in ("mean_auroc", "mean_effect", "heterogeneity"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "d18_signal_generalisation",
    f"""{LAB}, z AS (SELECT dataset_id, count(*) FILTER (rejected = 1) AS nr, count(*) FILTER (rejected = 0) AS na FROM lab GROUP BY 1), h AS (SELECT dataset_id, signal, count(*) FILTER (rejected = 1) AS r, count(*) FILTER (rejected = 0) AS a FROM (SELECT dataset_id, rejected, unnest(signals) AS signal FROM lab) GROUP BY 1, 2),
    l AS (SELECT signal, (CASE WHEN nr > 0 THEN r / nr::DOUBLE ELSE 0 END) / greatest(CASE WHEN na > 0 THEN a / na::DOUBLE ELSE 0 END, 0.001::DOUBLE) AS lift FROM h JOIN z USING (dataset_id))
    SELECT signal, count(*) AS appears_in, round(avg(lift), 2) AS avg_lift, count(*) FILTER (lift > 2) AS datasets_with_lift_gt_2, count(*) FILTER (lift > 5) AS datasets_with_lift_gt_5 FROM l GROUP BY 1""",
)
def d18(spark, sf):
    return D.signal_generalisation(scored_frame(spark, sf), "dataset_id")


FAM_MEAN = {n: "(" + " + ".join(f"f_{m}" for m in ms) + f") / {float(len(ms))}::DOUBLE" for n, ms in G.FAMILIES.items()}


@query(
    "d19_family_correlation",
    f"""{LAB}, u AS ({' UNION ALL '.join(f"SELECT dataset_id, rejected, '{n}' AS family, {e} AS v FROM lab" for n, e in FAM_MEAN.items())}),
    c AS (SELECT dataset_id, family, CASE WHEN var_pop(v) > 0 AND var_pop(rejected) > 0 THEN corr(v, rejected) ELSE 0 END AS c FROM u GROUP BY 1, 2 HAVING sum(rejected) >= 5 AND count(*) - sum(rejected) >= 5)
    SELECT family, count(*) AS n_datasets, round(avg(c), 6) AS mean_correlation, round(quantile_cont(c, 0.5), 6) AS median_correlation, round(stddev_pop(c), 6) AS std_correlation, CASE WHEN avg(c) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM c GROUP BY 1""",
)
def d19(spark, sf):
    out = D.family_correlation(scored_frame(spark, sf), "dataset_id", G.FAMILIES, min_rows=5)
    for c in ("mean_correlation", "median_correlation", "std_correlation"):
        out = out.withColumn(c, F.round(c, 6))
    return out


FAM_MAX = {n: ("greatest(" + ", ".join(f"f_{m}" for m in ms) + ")" if len(ms) > 1 else f"f_{ms[0]}") for n, ms in G.FAMILIES.items()}


@query(
    "d20_family_scores",
    f"""WITH {SCORED}, f AS (SELECT respondent_id, {', '.join(f'{e} AS {n}' for n, e in FAM_MAX.items())} FROM scored)
    SELECT *, {' + '.join(FAM_MAX)} AS families_fired, round(({' + '.join(FAM_MAX)}) / {float(len(FAM_MAX))}::DOUBLE, 6) AS client_reject_proxy FROM f""",
)
def d20(spark, sf):
    out = D.family_scores(scored_frame(spark, sf), G.FAMILIES)
    return out.select("respondent_id", *G.FAMILIES, "families_fired", F.round("client_reject_proxy", 6).alias("client_reject_proxy"))


# --- fixed values: ids, families and roles of the rulebook ---------------------------------------
RULEBOOK = (
    ("speed_under_4_minutes", "timing", "review_routing"),
    ("speed_4_to_5_minutes", "timing", "context_signal"),
    ("platform_termflag", "platform_quality", "candidate_discard_signal"),
    ("platform_scrutinyflag", "platform_quality", "candidate_discard_signal"),
    ("research_defender_nonzero_review", "platform_quality", "review_routing"),
    ("required_open_end_placeholder", "open_end_authenticity", "candidate_discard_signal"),
    ("required_open_end_too_short", "open_end_authenticity", "review_routing"),
    ("copied_open_end", "duplication", "candidate_discard_signal"),
    ("pasted_text_helper", "open_end_authenticity", "review_routing"),
    ("survey_feedback_in_substantive_field", "open_end_authenticity", "review_routing"),
    ("ai_or_overpolished_generic_text", "llm_suspicion", "review_routing"),
    ("hostile_or_nonsense_text", "open_end_authenticity", "candidate_discard_signal"),
    ("matrix_near_straightline", "attention", "review_routing"),
    ("long_low_specificity_text", "llm_suspicion", "review_routing"),
    ("internal_inconsistency_numeric_allocations", "consistency", "context_signal"),
    ("semantic_abstract_business_no_lived_detail", "semantic_authenticity", "agent_semantic_rule"),
    ("semantic_survey_meta_answer", "semantic_authenticity", "agent_semantic_rule"),
    ("semantic_role_or_qualification_mismatch", "semantic_authenticity", "agent_semantic_rule"),
    ("semantic_personal_home_project_in_trade_context", "semantic_authenticity", "agent_semantic_rule"),
    ("semantic_generic_project_claim", "semantic_authenticity", "agent_semantic_rule"),
    ("semantic_sentence_drift", "semantic_authenticity", "agent_semantic_rule"),
    ("semantic_list_when_use_case_required", "semantic_authenticity", "agent_semantic_rule"),
    ("semantic_off_domain_professional_claim", "semantic_authenticity", "agent_semantic_rule"),
)

#: What a rule looks at in this study. Rules without an entry need helper fields or judgments that the study does not
#: have: they stay in the rulebook and are reported as not observed.
RULE_CONDITIONS = {
    "speed_under_4_minutes": f"qtime < {STUDY.fast_seconds}",
    "speed_4_to_5_minutes": f"qtime >= {STUDY.fast_seconds} AND qtime < {STUDY.slow_fast_seconds}",
    "required_open_end_placeholder": f"f_open_generic = 1 AND word_count > {STUDY.low_words}",
    "required_open_end_too_short": f"word_count BETWEEN 1 AND {STUDY.low_words}",
    "copied_open_end": "f_duplicate_open = 1 OR f_template_cluster = 1",
    "survey_feedback_in_substantive_field": "f_survey_meta = 1",
    "ai_or_overpolished_generic_text": "f_polished = 1",
    "hostile_or_nonsense_text": "f_hostile = 1",
    "matrix_near_straightline": "f_matrix_uniform = 1",
    "long_low_specificity_text": "f_low_specificity = 1",
    "internal_inconsistency_numeric_allocations": f"n_items >= {STUDY.matrix_min_items} AND modal_share >= 0.75",
    "semantic_survey_meta_answer": "f_survey_meta = 1 AND g_grounded = 0",
    "semantic_generic_project_claim": "f_polished = 1 AND g_grounded = 0 AND g_domain_rich = 0",
    "semantic_sentence_drift": "f_repeated_phrase = 1",
    "semantic_list_when_use_case_required": "g_specific_detail = 0 AND g_domain_rich = 1",
}
RULES_SQL = tuple((rule, family, role, RULE_CONDITIONS.get(rule, "false")) for rule, family, role in RULEBOOK)
AGENT_RULES = ", ".join(f"'{r}'" for r, _, role in RULEBOOK if role == "agent_semantic_rule")


def rules():
    return [(r, f, t, F.expr(c)) for r, f, t, c in RULES_SQL]


EVID = f"""{LAB}, hit AS ({' UNION ALL '.join(f"SELECT dataset_id, respondent_id, rejected, '{r}' AS rule_id FROM lab WHERE {c}" for r, _, _, c in RULES_SQL)}),
  cat AS (SELECT * FROM (VALUES {', '.join(f"('{r}', '{f}', '{t}')" for r, f, t, _ in RULES_SQL)}) v(rule_id, family, rulebook_role)), base AS (SELECT dataset_id, avg(rejected) AS b FROM lab GROUP BY 1),
  rk AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, rule_id, rejected ORDER BY respondent_id) AS rn FROM hit),
  st AS (SELECT dataset_id, rule_id, count(*) FILTER (rejected = 0) AS ah, count(*) FILTER (rejected = 1) AS rh, coalesce(string_agg(CAST(respondent_id AS VARCHAR), ',' ORDER BY respondent_id) FILTER (rejected = 1 AND rn <= 3), '') AS rex, coalesce(string_agg(CAST(respondent_id AS VARCHAR), ',' ORDER BY respondent_id) FILTER (rejected = 0 AND rn <= 3), '') AS aex FROM rk GROUP BY 1, 2),
  g AS (SELECT base.dataset_id, b, cat.*, coalesce(ah, 0) AS accepted_hits, coalesce(rh, 0) AS rejected_hits, coalesce(ah, 0) + coalesce(rh, 0) AS support, CASE WHEN coalesce(ah + rh, 0) > 0 THEN rh / (ah + rh)::DOUBLE ELSE 0 END AS r, coalesce(rex, '') AS rejected_examples, coalesce(aex, '') AS accepted_examples FROM base, cat LEFT JOIN st ON st.dataset_id = base.dataset_id AND st.rule_id = cat.rule_id),
  ev AS (SELECT dataset_id, rule_id, family, rulebook_role, accepted_hits, rejected_hits, support AS support_rows, round(r, 4) AS reject_rate_when_rule_fires, round(b, 4) AS dataset_reject_rate,
    CASE WHEN support = 0 THEN 'not_observed' WHEN support < 10 THEN 'needs_more_examples' WHEN r >= greatest(0.6, b * 1.75) THEN 'candidate_discard_signal' WHEN r <= least(0.2, b * 0.55) THEN 'false_positive_guardrail' ELSE rulebook_role END AS observed_role, rejected_examples, accepted_examples FROM g)"""


@query("d21_discard_rulebook", f"{EVID} SELECT * FROM ev")
def d21(spark, sf):
    rs = rules()
    return D.rule_evidence(D.rule_hits(scored_frame(spark, sf), rs), rs, "respondent_id", "dataset_id")


@query("d21_uncovered_rejected", f"{EVID} SELECT l.respondent_id, l.dataset_id, l.supplier FROM lab l WHERE rejected = 1 AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.respondent_id = l.respondent_id AND h.rule_id NOT IN ({AGENT_RULES}))")
def d21b(spark, sf):
    """Rejected rows that no script rule explains; they go to a semantic reading."""
    hits = D.rule_hits(scored_frame(spark, sf), [r for r in rules() if r[2] != "agent_semantic_rule"])
    return hits.where((F.col("rejected") == 1) & (F.size("rules") == 0)).select("respondent_id", "dataset_id", "supplier")


@query("d21_accepted_guardrails", f"{EVID} SELECT respondent_id, dataset_id, count(*) AS rule_count, string_agg(rule_id, '; ' ORDER BY rule_id) AS rules FROM hit WHERE rejected = 0 GROUP BY 1, 2")
def d21c(spark, sf):
    hits = D.rule_hits(scored_frame(spark, sf), rules())
    return hits.where((F.col("rejected") == 0) & (F.size("rules") > 0)).select("respondent_id", "dataset_id", F.size("rules").cast("long").alias("rule_count"), F.array_join("rules", "; ").alias("rules"))


@query(
    "d22_quota_cells",
    """WITH p AS (SELECT c_custkey, c_mktsegment AS segment, n_name AS nation, r_name AS region, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    m AS (SELECT 'SegmentQuota' AS quota, segment AS value FROM p UNION ALL SELECT 'NationQuota', nation FROM p UNION ALL SELECT 'RegionQuota', region FROM p UNION ALL SELECT 'BalanceQuota', band FROM p), c AS (SELECT quota, value, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT quota, value, n, CAST(sum(n) OVER (PARTITION BY quota) AS BIGINT) AS quota_total, round(n / sum(n) OVER (PARTITION BY quota)::DOUBLE, 6) AS share, CAST(n / sum(n) OVER (PARTITION BY quota)::DOUBLE > 0.2 AS INTEGER) AS over_filled FROM c""",
)
def d22(spark, sf):
    band = F.when(F.col("balance") < 0, "negative").when(F.col("balance") < 5000, "low").otherwise("high")
    p = profiles(spark, sf).withColumn("band", band)
    m = D.quota_cells(p, "respondent_id", {"SegmentQuota": "segment", "NationQuota": "nation", "RegionQuota": "region", "BalanceQuota": "band"})
    return D.cell_totals(m, 0.2).withColumn("share", F.round("share", 6))


FUNNEL = """e AS (SELECT user_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) % 20 AS brand, CASE event_type WHEN 'view' THEN 'aware' WHEN 'click' THEN 'considered' WHEN 'purchase' THEN 'used' ELSE 'other' END AS stage, event_type = 'signup' AND CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) < 3 AS excl FROM events),
  b AS (SELECT user_id, brand, max(CAST(stage = 'aware' AS INTEGER)) AS a, max(CAST(stage = 'considered' AS INTEGER)) AS c, max(CAST(stage = 'used' AS INTEGER)) AS u, max(CAST(excl AS INTEGER)) AS x FROM e GROUP BY 1, 2),
  f AS (SELECT user_id, CAST(sum(a) AS BIGINT) AS n_aware, CAST(sum(c) AS BIGINT) AS n_considered, CAST(sum(u) AS BIGINT) AS n_used, CAST(sum(u * (1 - a)) AS BIGINT) AS used_not_aware, CAST(sum(c * (1 - a)) AS BIGINT) AS considered_not_aware, max(x) AS chose_none FROM b GROUP BY 1),
  fn AS (SELECT *, CAST(chose_none = 1 AND n_aware > 0 AS INTEGER) AS exclusive_contradiction, CAST(used_not_aware = 0 AND considered_not_aware = 0 AS INTEGER) AS funnel_consistent FROM f)"""
SOFT = {"brand_overclaim": "n_aware >= 12", "used_beyond_considered": "n_used > n_considered", "considered_unaware": "considered_not_aware >= 5", "narrow_use": "n_used <= 6"}
HARD = {"exclusive_contradiction": "exclusive_contradiction = 1", "used_unaware": "used_not_aware >= 7"}
COH = f"""{FUNNEL}, ch AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in HARD.items())}], lambda x: x IS NOT NULL) AS hard, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in SOFT.items())}], lambda x: x IS NOT NULL) AS soft FROM fn),
  cs AS (SELECT *, CASE WHEN len(hard) > 0 THEN 'incoherent_hard' WHEN len(soft) >= 3 THEN 'incoherent_soft' WHEN len(soft) >= 1 THEN 'minor_concern' ELSE 'coherent' END AS coherence_status FROM ch)"""


def funnel(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    stage = F.when(F.col("event_type") == "view", "aware").when(F.col("event_type") == "click", "considered").when(F.col("event_type") == "purchase", "used").otherwise("other")
    e = table(spark, sf, "events").select("user_id", (k % 20).alias("brand"), stage.alias("stage"), ((F.col("event_type") == "signup") & (k < 3)).alias("excl"))
    return U.brand_funnel(e, "user_id", "brand", "stage", F.col("excl"))


def coherent(spark, sf):
    return U.coherence(funnel(spark, sf), {n: F.expr(c) for n, c in HARD.items()}, {n: F.expr(c) for n, c in SOFT.items()})


@query("d23_brand_funnel", f"WITH {FUNNEL} SELECT * FROM fn")
def d23(spark, sf):
    return funnel(spark, sf)


@query("d24_coherence_status", f"WITH {COH} SELECT user_id, array_to_string(hard, '; ') AS hard_invalidities, array_to_string(soft, '; ') AS soft_concerns, coherence_status FROM cs")
def d24(spark, sf):
    c = coherent(spark, sf)
    return c.select("user_id", F.array_join("hard_invalidities", "; ").alias("hard_invalidities"), F.array_join("soft_concerns", "; ").alias("soft_concerns"), "coherence_status")


@query(
    "d25_label_lift_of_concerns",
    f"""WITH {COH}, x AS (SELECT cs.*, 1 - quality AS rejected FROM cs JOIN labels ON doc_id = user_id), z AS (SELECT sum(rejected) AS nr, sum(1 - rejected) AS na FROM x), cx AS (SELECT rejected, unnest(list_concat(hard, soft)) AS concern FROM x), c AS (SELECT concern, sum(rejected) AS r, sum(1 - rejected) AS a FROM cx GROUP BY 1)
    SELECT concern, round(coalesce(r / nullif(nr, 0)::DOUBLE, 0), 4) AS rejected_rate, round(coalesce(a / nullif(na, 0)::DOUBLE, 0), 4) AS accepted_rate, round(coalesce(r / nullif(nr, 0)::DOUBLE, 0) / greatest(coalesce(a / nullif(na, 0)::DOUBLE, 0), 0.001::DOUBLE), 2) AS lift FROM c, z""",
)
def d25(spark, sf):
    labels = client_labels(spark, sf).select(F.col("respondent_id").alias("user_id"), "rejected")
    c = coherent(spark, sf).join(labels, "user_id").withColumn("concerns", F.concat("hard_invalidities", "soft_concerns"))
    return U.concern_lift(c, "concerns", "rejected")


@query(
    "d26_marker_family_share",
    """WITH m AS (SELECT 1 - quality AS rejected, event_type AS family FROM events JOIN labels ON doc_id = user_id UNION ALL SELECT 1 - quality, 'k' || (CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) // 25) FROM events JOIN labels ON doc_id = user_id)
    SELECT family, count(*) AS mentions, CAST(sum(rejected) AS BIGINT) AS rejected_mentions, CAST(sum(1 - rejected) AS BIGINT) AS accepted_mentions, round(sum(rejected) / count(*)::DOUBLE, 6) AS rejected_share FROM m GROUP BY 1""",
)
def d26(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    labels = client_labels(spark, sf).select(F.col("respondent_id").alias("user_id"), "rejected")
    markers = F.concat("event_type", F.lit("/"), k.cast("string"), F.lit(";k"), F.floor(k / 25).cast("string"), F.lit("/any"))
    e = table(spark, sf, "events").select("user_id", markers.alias("markers")).join(labels, "user_id")
    return U.marker_family_share(e, "markers", "rejected")


@query(
    "d27_theme_inventory",
    f"""WITH {SCORED}, t AS (SELECT respondent_id, supplier, coalesce(signals[1], 'none') AS theme FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY respondent_id) AS rn FROM t),
    a AS (SELECT theme, count(*) AS support_rows, string_agg(CAST(respondent_id AS VARCHAR), ', ' ORDER BY respondent_id) FILTER (rn <= 8) AS example_ids FROM r GROUP BY 1), m AS (SELECT theme, supplier, count(*) AS value_rows FROM t GROUP BY 1, 2)
    SELECT theme, supplier, value_rows, support_rows, example_ids, round(support_rows / (SELECT count(*) FROM t)::DOUBLE, 6) AS support_rate FROM a JOIN m USING (theme)""",
)
def d27(spark, sf):
    t = scored_frame(spark, sf).select("respondent_id", "supplier", F.coalesce(F.get("signals", F.lit(0)), F.lit("none")).alias("theme"))
    return D.theme_inventory(t, "theme", "respondent_id", "supplier")


DEC = "CASE WHEN tier_n >= 5 THEN 'DISCARD' WHEN tier_n >= 3 THEN 'REVIEW' ELSE 'KEEP' END"


def with_decision(spark, sf):
    n = G.tier_number(F.col("operational_tier"))
    return scored_frame(spark, sf).withColumn("tier_n", n).withColumn("decision", F.when(n >= 5, "DISCARD").when(n >= 3, "REVIEW").otherwise("KEEP"))


@query(
    "d28_criterion_response_table",
    f"""WITH {SCORED}, e AS (SELECT respondent_id, {DEC} AS decision, unnest(signals) AS criterion FROM scored)
    SELECT criterion, count(*) AS n_rows, count(*) FILTER (decision = 'DISCARD') AS discards, count(*) FILTER (decision = 'REVIEW') AS reviews, count(*) FILTER (decision = 'KEEP') AS keeps, min(respondent_id) AS sample_id FROM e GROUP BY 1""",
)
def d28(spark, sf):
    return D.criterion_table(with_decision(spark, sf), "signals", "decision", "respondent_id")


@query(
    "d29_promotion_specs",
    f"""{EVID}, p AS (SELECT rule_id, family, rulebook_role, CAST(sum(accepted_hits) AS BIGINT) AS accepted, CAST(sum(rejected_hits) AS BIGINT) AS rejected, CAST(sum(support_rows) AS BIGINT) AS support_rows, CASE WHEN sum(support_rows) > 0 THEN sum(dataset_reject_rate * support_rows) / sum(support_rows)::DOUBLE ELSE 0 END AS b FROM ev GROUP BY 1, 2, 3),
    x AS (SELECT *, CASE WHEN support_rows > 0 THEN rejected / support_rows::DOUBLE ELSE 0 END AS r FROM p), y AS (SELECT *, CASE WHEN b > 0 THEN r / b ELSE 0 END AS lift, (SELECT sum(accepted_hits) FROM ev) AS al FROM x)
    SELECT rule_id, family, support_rows, rejected, accepted, round(r, 4) AS reject_rate_when_present, round(lift, 3) AS lift_vs_base, round(accepted / al::DOUBLE, 4) AS accepted_exposure,
      CASE WHEN support_rows = 0 THEN 'unobserved_runtime_question' WHEN rulebook_role = 'candidate_discard_signal' AND rejected >= 10 AND lift >= 1.5 THEN 'promote_to_review_routing_with_tier5_audit' WHEN rulebook_role IN ('review_routing', 'agent_semantic_rule') OR lift >= 1.1 THEN 'hold_for_agent_review' WHEN accepted > rejected THEN 'guardrail_or_report_only' ELSE 'demote_until_more_evidence' END AS disposition FROM y""",
)
def d29(spark, sf):
    rs = rules()
    return D.promotion_specs(D.rule_evidence(D.rule_hits(scored_frame(spark, sf), rs), rs, "respondent_id", "dataset_id"))


@query(
    "d31_supplier_dashboard",
    f"""WITH {SCORED} SELECT supplier, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER ({DEC} = 'DISCARD') AS discards, count(*) FILTER ({DEC} = 'REVIEW') AS reviews FROM scored GROUP BY 1 ORDER BY n DESC, supplier LIMIT 15""",
)
def d31(spark, sf):
    return D.supplier_dashboard(with_decision(spark, sf), "supplier", "score", "decision")


@query("d31_score_histogram", f"WITH {SCORED} SELECT CAST(least(greatest(floor(score / (1.0::DOUBLE / 20)), 0), 19) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY 1")
def d31b(spark, sf):
    return D.score_histogram(scored_frame(spark, sf), "score", 0.0, 1.0, 20)


PRIOR = ("mean_words", "mean_variety", "mean_missing", "duplicate_rate")


@query(
    "d32_historical_prior_profile",
    f"""WITH {SCORED}, p AS (SELECT dataset_id, avg(word_count) AS mean_words, avg(unique_token_ratio) AS mean_variety, avg(missing_rate) AS mean_missing, avg(f_duplicate_open) AS duplicate_rate, avg(rejected) AS rr FROM scored GROUP BY 1),
    s AS (SELECT {', '.join(f'stddev_samp({m}) AS s_{m}' for m in PRIOR)} FROM p), d AS (SELECT a.dataset_id AS target, b.dataset_id AS closest, b.rr, round(sqrt({' + '.join(f'coalesce(pow(a.{m} - b.{m}, 2) / nullif(pow(s_{m}, 2), 0), 0)' for m in PRIOR)}), 6) AS distance FROM p a JOIN p b ON a.dataset_id <> b.dataset_id, s),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY distance, closest) AS INTEGER) AS rank FROM d) SELECT target, closest, rank, distance, round(rr, 6) AS historical_reject_rate FROM r WHERE rank <= 2""",
)
def d32(spark, sf):
    p = scored_frame(spark, sf).groupBy("dataset_id").agg(
        F.avg("word_count").alias("mean_words"), F.avg("unique_token_ratio").alias("mean_variety"), F.avg("missing_rate").alias("mean_missing"), F.avg("f_duplicate_open").alias("duplicate_rate"), F.avg("rejected").alias("reject_rate")
    )
    return D.historical_priors(p, "dataset_id", PRIOR)


REASONS = {"article": r"(^|[^a-z])(the|les|der|los)([^a-z]|$)", "conjunction": r"(^|[^a-z])(and|et|und|y)([^a-z]|$)", "numbers": r"[0-9]", "accents": r"[éèêñçöüß]", "pipes": r"\|"}


@query(
    "d33_reason_tally",
    f"""WITH t AS (SELECT role, lower(text) AS t FROM conversations), e AS (SELECT role, unnest(list_filter([{', '.join(f"CASE WHEN regexp_matches(t, {q(p)}) THEN '{n}' END" for n, p in REASONS.items())}], lambda x: x IS NOT NULL)) AS reason FROM t) SELECT role, reason, count(*) AS n FROM e GROUP BY 1, 2""",
)
def d33(spark, sf):
    return D.reason_tally(chain(spark, sf), "text", REASONS, ["role"])


# --- contrast with matched controls (similarity ids, built on the signal matrix) --------------------

NUMERIC = ("qtime", "word_count", "missing_rate", "modal_share")
FLAGS = tuple(f"f_{s}" for s in G.SIGNALS)
DIST = " + ".join([f"abs(coalesce(r.{c}, 0) - coalesce(a.{c}, 0)) / coalesce(nullif(s_{c}, 0), 1)" for c in NUMERIC] + [f"0.4::DOUBLE * abs(r.{f} - a.{f})" for f in FLAGS])
CONTROLS = f"""{LAB}, sc AS (SELECT dataset_id, {', '.join(f'stddev_samp({c}) AS s_{c}' for c in NUMERIC)} FROM lab WHERE rejected = 0 GROUP BY 1),
  pr AS (SELECT r.respondent_id AS query, a.respondent_id AS neighbour, {DIST} AS d, r.dataset_id, r.signals AS rs, a.signals AS sa, a.guards AS ag FROM lab r JOIN lab a ON r.dataset_id = a.dataset_id AND r.rejected = 1 AND a.rejected = 0 JOIN sc ON sc.dataset_id = r.dataset_id),
  ctl AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(d, 9), neighbour) AS INTEGER) AS rank FROM pr)"""


def controls(spark, sf):
    return N.matched_controls(scored_frame(spark, sf), "respondent_id", "dataset_id", "rejected", NUMERIC, FLAGS)


@query("s15_matched_controls", f"{CONTROLS} SELECT query AS rejected_id, neighbour AS accepted_id, rank AS control_rank, round(d, 4) AS match_distance FROM ctl WHERE rank <= 3")
def s15(spark, sf):
    return controls(spark, sf).select(F.col("query").alias("rejected_id"), F.col("neighbour").alias("accepted_id"), F.col("rank").alias("control_rank"), F.round("dist", 4).alias("match_distance"))


@query(
    "s16_contrastive_pairs",
    f"""{CONTROLS} SELECT dataset_id, query AS rejected_id, neighbour AS accepted_id, rank AS control_rank, array_to_string(list_sort(list_filter(rs, lambda x: NOT list_contains(sa, x))), '|') AS distinguishing_signals,
    array_to_string(list_sort(list_filter(rs, lambda x: list_contains(sa, x))), '|') AS shared_signals, array_to_string(list_sort(ag), '|') AS accepted_guards FROM ctl WHERE rank <= 3""",
)
def s16(spark, sf):
    return D.contrastive_pairs(controls(spark, sf), scored_frame(spark, sf), "respondent_id")


@query(
    "s16_guardrail_casebook",
    f"""{CONTROLS} SELECT DISTINCT dataset_id, neighbour AS accepted_id, array_to_string(list_sort(list_filter(rs, lambda x: list_contains(sa, x))), '|') AS shared_signals, array_to_string(list_sort(ag), '|') AS accepted_guards FROM ctl WHERE rank <= 3 AND len(ag) > 0""",
)
def s16b(spark, sf):
    return D.guardrail_casebook(D.contrastive_pairs(controls(spark, sf), scored_frame(spark, sf), "respondent_id"))


@query(
    "s17_coordination_clusters",
    f"""WITH {SCORED}, e AS (SELECT dataset_id, rejected, unnest(signals) AS cluster_type FROM scored) SELECT dataset_id, cluster_type, count(*) AS n_rows, count(*) FILTER (rejected = 1) AS rejected_rows, count(*) FILTER (rejected = 0) AS accepted_rows FROM e GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def s17(spark, sf):
    return D.coordination_clusters(scored_frame(spark, sf), "dataset_id")
