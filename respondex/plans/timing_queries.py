"""Queries over durations and time stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.functions import text as X
from respondex.operators import timing as T
from respondex.plans.catalog import query
from respondex.plans.study import FRAME, SESS, client_labels, respondent_frame, sessions, words_sql
from respondex.sources.tables import table


def base(spark, sf):
    return sessions(spark, sf).select("dataset_id", "user_id", "day", "session_key", "n_events", "qtime")


@query(
    "t01_timing_band",
    f"""WITH {SESS}, c AS (SELECT dataset_id, quantile_cont(qtime, 0.1) AS p10, quantile_cont(qtime, 0.25) AS p25, quantile_cont(qtime, 0.5) AS p50 FROM sess WHERE qtime > 0 GROUP BY 1)
    SELECT user_id, day, CASE WHEN qtime <= 0 THEN 'unknown' WHEN qtime <= p10 THEN 'bottom_10' WHEN qtime <= p25 THEN 'bottom_25' WHEN qtime <= p50 THEN 'below_median' ELSE 'above_median' END AS timing_band
    FROM sess LEFT JOIN c USING (dataset_id)""",
)
def t01(spark, sf):
    return T.timing_bands(base(spark, sf), "dataset_id", "qtime").select("user_id", "day", "timing_band")


EXC = "max(CASE WHEN rn = least(greatest(floor({p}::DOUBLE * (n + 1)), 1), n) THEN qtime END) + (max(CASE WHEN rn = least(greatest(ceil({p}::DOUBLE * (n + 1)), 1), n) THEN qtime END) - max(CASE WHEN rn = least(greatest(floor({p}::DOUBLE * (n + 1)), 1), n) THEN qtime END)) * max({p}::DOUBLE * (n + 1) - floor({p}::DOUBLE * (n + 1)))"


@query(
    "t02_timing_band6",
    f"""WITH {SESS}, r AS (SELECT dataset_id, qtime, row_number() OVER (PARTITION BY dataset_id ORDER BY qtime) AS rn, count(*) OVER (PARTITION BY dataset_id) AS n FROM sess WHERE qtime > 0),
    c AS (SELECT dataset_id, {', '.join(f"{EXC.format(p=p)} AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM r GROUP BY 1)
    SELECT user_id, day, CASE WHEN qtime <= 0 THEN NULL WHEN qtime < p10 THEN 'bottom_10' WHEN qtime < p25 THEN 'bottom_25' WHEN qtime < p50 THEN 'below_median' WHEN qtime < p75 THEN 'above_median' WHEN qtime < p90 THEN 'top_25' ELSE 'top_10' END AS timing_band6
    FROM sess LEFT JOIN c USING (dataset_id)""",
)
def t02(spark, sf):
    return T.timing_bands6(base(spark, sf), "dataset_id", "qtime").select("user_id", "day", "timing_band6")


@query(
    "t03_fast_flag",
    f"""WITH {SESS}, x AS (SELECT *, CASE WHEN dataset_id = 'wave3' THEN qtime / 3600 ELSE qtime END AS t FROM sess), m AS (SELECT dataset_id, CASE WHEN quantile_cont(t, 0.5) > 30 THEN 1.0::DOUBLE ELSE 3600.0::DOUBLE END AS unit FROM x GROUP BY 1),
    k AS (SELECT dataset_id, CASE WHEN t <= 0 THEN 'unknown' WHEN t < 7200 / unit THEN 'fast' WHEN t < 14400 / unit THEN 'brisk' WHEN t < 28800 / unit THEN 'short' ELSE 'normal' END AS speed_class FROM x JOIN m USING (dataset_id))
    SELECT dataset_id, speed_class, CAST(speed_class = 'fast' AS INTEGER) AS fast_flag, count(*) AS n_rows FROM k GROUP BY ALL""",
)
def t03(spark, sf):
    """One wave reports hours instead of seconds; its median gives that away."""
    b = base(spark, sf).withColumn("t", F.when(F.col("dataset_id") == "wave3", F.col("qtime") / 3600).otherwise(F.col("qtime")))
    f = T.fast_flags(b, "dataset_id", "t", 7200.0, 14400.0, 28800.0, per_unit=3600.0)
    return f.groupBy("dataset_id", "speed_class", "fast_flag").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "t04_robust_z",
    f"""WITH {SESS}, x AS (SELECT s.*, 1 - l.quality AS rejected FROM sess s LEFT JOIN labels l ON l.doc_id = s.user_id), a AS (SELECT * FROM x WHERE rejected = 0),
    b AS (SELECT dataset_id, quantile_cont(qtime, 0.5) AS med, quantile_cont(qtime, 0.1) AS p10 FROM a GROUP BY 1), d AS (SELECT dataset_id, quantile_cont(abs(qtime - med), 0.5) AS mad FROM a JOIN b USING (dataset_id) GROUP BY 1)
    SELECT user_id, day, round((qtime - med) / CASE WHEN mad = 0 THEN 1 ELSE mad END, 6) AS robust_z, coalesce(CAST(qtime < p10 AS INTEGER), 0) AS fast_route_adjusted FROM x LEFT JOIN b USING (dataset_id) LEFT JOIN d USING (dataset_id)""",
)
def t04(spark, sf):
    labels = client_labels(spark, sf).select(F.col("respondent_id").alias("user_id"), "rejected")
    out = T.robust_z(base(spark, sf).join(labels, "user_id", "left"), "dataset_id", "qtime", "rejected")
    return out.select("user_id", "day", F.round("robust_z", 6).alias("robust_z"), "fast_route_adjusted")


@query(
    "t05_zscore_by_dataset",
    """WITH s AS (SELECT o_orderstatus, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY 1)
    SELECT o_orderkey AS respondent_id, o_orderstatus AS dataset_id, round(CASE WHEN sd > 0 THEN (o_totalprice - m) / sd ELSE 0 END, 6) AS zscore FROM orders JOIN s USING (o_orderstatus)""",
)
def t05(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("respondent_id"), F.col("o_orderstatus").alias("dataset_id"), "o_totalprice")
    z = T.zscores(o, "dataset_id", "o_totalprice", "respondent_id")
    return z.select("respondent_id", "dataset_id", F.round("zscore", 6).alias("zscore"))


def cut_sql(col: str, parts: int) -> str:
    qs = ", ".join(f"quantile_cont({col}, {i / parts})" for i in range(parts + 1))
    return f"list_distinct([{qs}])"


@query(
    "t06_quantile_bucket",
    f"""WITH p AS (SELECT o_orderpriority, {cut_sql('o_totalprice', 4)} AS e4, {cut_sql('o_totalprice', 10)} AS e10 FROM orders GROUP BY 1),
    l AS (SELECT {cut_sql('l_discount', 10)} AS e FROM lineitem)
    SELECT 'price' AS what, o_orderpriority AS dataset_id, CAST(greatest(len(list_filter(e4, lambda x: x < o_totalprice)) - 1, 0) AS INTEGER) AS quartile, CAST(greatest(len(list_filter(e10, lambda x: x < o_totalprice)) - 1, 0) AS INTEGER) AS decile, count(*) AS n FROM orders JOIN p USING (o_orderpriority) GROUP BY ALL
    UNION ALL SELECT 'discount', 'all', 0, CAST(greatest(len(list_filter(e, lambda x: x < l_discount)) - 1, 0) AS INTEGER), count(*) FROM lineitem, l GROUP BY ALL""",
)
def t06(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset_id"), "o_totalprice")
    o = T.quantile_bucket(T.quantile_bucket(o, "dataset_id", "o_totalprice", 4, "quartile"), "dataset_id", "o_totalprice", 10, "decile")
    d = table(spark, sf, "lineitem").select(F.lit("all").alias("dataset_id"), "l_discount")
    d = T.quantile_bucket(d, "dataset_id", "l_discount", 10, "decile").withColumn("quartile", F.lit(0))
    both = o.select(F.lit("price").alias("what"), "dataset_id", "quartile", "decile").unionByName(d.select(F.lit("discount").alias("what"), "dataset_id", "quartile", "decile"))
    return both.groupBy("what", "dataset_id", "quartile", "decile").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t07_time_text_mismatch",
    f"""WITH {FRAME}, w AS (SELECT respondent_id, dataset_id, qtime, len({words_sql('open_text')}) AS wc FROM frame), m AS (SELECT dataset_id, quantile_cont(qtime, 0.5) AS med FROM w GROUP BY 1),
    f AS (SELECT w.*, coalesce(qtime, med, 0) AS t FROM w LEFT JOIN m USING (dataset_id)), c AS (SELECT dataset_id, quantile_cont(t, 0.1) AS t10, quantile_cont(t, 0.2) AS t20, quantile_cont(t, 0.95) AS t95, quantile_cont(wc::DOUBLE, 0.8) AS w80 FROM f GROUP BY 1)
    SELECT respondent_id, CAST(t <= t10 AS INTEGER) AS qtime_low, CAST(t >= t95 AS INTEGER) AS qtime_high, CAST(wc >= w80 AND t <= t20 AS INTEGER) AS answer_time_text_mismatch FROM f JOIN c USING (dataset_id)""",
)
def t07(spark, sf):
    f = respondent_frame(spark, sf).select("respondent_id", "dataset_id", "qtime", X.word_count(F.col("open_text")).alias("wc"))
    return T.time_text_flags(f, "dataset_id", "qtime", "wc").select("respondent_id", "qtime_low", "qtime_high", "answer_time_text_mismatch")


@query(
    "t08_fielding_start_stats",
    """SELECT count(*) AS n_rows, count(t) AS n_parsed, count(*) FILTER (hour(t) >= 22 OR hour(t) <= 4) AS odd_hour_starts, round(count(t) / count(*)::DOUBLE, 6) AS parse_rate
    FROM (SELECT CASE WHEN event_type = 'error' AND user_id % 10 = 0 THEN NULL ELSE ts END AS t FROM events)""",
)
def t08(spark, sf):
    """Start stamps arrive as text; some of them are unreadable."""
    bad = (F.col("event_type") == "error") & (F.pmod("user_id", F.lit(10)) == 0)
    e = table(spark, sf, "events").select(F.when(bad, F.concat(F.lit("on "), F.col("props"))).otherwise(F.col("ts").cast("string")).alias("start_text"))
    return T.fielding_start_stats(e, "start_text")


@query(
    "t08_minute_bursts",
    "SELECT date_trunc('minute', ts) AS minute, count(*) AS n_starts FROM events GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
def t08b(spark, sf):
    return T.minute_bursts(table(spark, sf, "events").select("ts"), "ts", 5)


@query(
    "t09_temporal_features",
    "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, date_diff('microseconds', min(ts), max(ts)) / 1e6::DOUBLE AS range_seconds, count(*) AS n_stamps FROM events GROUP BY 1",
)
def t09(spark, sf):
    return T.temporal_features(table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts")


@query(
    "t10_fielding_trend",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (toxic = 1) AS review, count(*) FILTER (quality = 0) AS discard FROM events LEFT JOIN labels ON doc_id = user_id GROUP BY 1""",
)
def t10(spark, sf):
    labels = client_labels(spark, sf).select(F.col("respondent_id").alias("user_id"), "rejected", "toxic")
    e = table(spark, sf, "events").select("user_id", "ts").join(labels, "user_id", "left")
    return T.fielding_trend(e, "ts", F.col("toxic") == 1, F.col("rejected") == 1)


@query(
    "t11_time_interactions",
    f"""WITH {FRAME}, w AS (SELECT respondent_id, qtime, modal_share, n_items, len({words_sql('open_text')}) AS wc FROM frame WHERE qtime IS NOT NULL)
    SELECT respondent_id, round(qtime / (wc + 1), 6) AS qtime_per_word, round(qtime / (n_items + 1), 6) AS qtime_per_question, round(modal_share * qtime / 1000, 6) AS modal_share_x_qtime FROM w""",
)
def t11(spark, sf):
    f = respondent_frame(spark, sf).where("qtime IS NOT NULL").withColumn("wc", X.word_count(F.col("open_text")))
    out = T.time_interactions(f, "qtime", {"word": "wc", "question": "n_items"}, ["modal_share"])
    return out.select("respondent_id", *[F.round(c, 6).alias(c) for c in ("qtime_per_word", "qtime_per_question", "modal_share_x_qtime")])


@query(
    "t12_percentile_rank",
    f"WITH {SESS} SELECT user_id, day, round(cume_dist() OVER (PARTITION BY dataset_id ORDER BY qtime), 6) AS pct_rank FROM sess",
)
def t12(spark, sf):
    return T.percentile_rank(base(spark, sf), "dataset_id", "qtime").select("user_id", "day", F.round("pct_rank", 6).alias("pct_rank"))
