"""Binds the test tables to the survey roles: who answered, what, when, and with which label.

documents -> respondents (one open answer each; lang = data set, source = supplier),
labels -> accept/reject label and second rater, events -> sessions and coded
sequence, lineitem -> grid and coded answers, customer/orders -> profile,
conversations -> ordered multi-field chain, embeddings -> vectors, benchmark ->
answer bank. Each reader selects only the columns its role needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from respondex.config import SignalConfig
from respondex.functions import lexicons as L
from respondex.functions import ranking as R
from respondex.functions import text as X
from respondex.functions.scan import Reading, finder, plain, read_texts, value
from respondex.operators import lift as D
from respondex.operators import matrix as M
from respondex.operators import text_signals as T
from respondex.operators import timing as TM
from respondex.operators.scoring import FACTOR_TERMS
from respondex.operators.signals import GUARDS, SIGNALS, RiskWeights, evaluation_score, frozen_risk, signal_matrix, text_facts
from respondex.sources.stages import stage
from respondex.sources.tables import spread, table

# The tables hold invented prose, so the study's vocabulary is chosen to occur in it.
STUDY = SignalConfig(
    low_words=40,
    long_words=45,
    low_unique_ratio=0.55,
    fast_seconds=1800.0,
    slow_fast_seconds=7200.0,
    matrix_modal_share=0.75,
    high_missing=0.45,
    meta_pattern=r"license|licence|copyright|all rights reserved",
    polished_pattern=r"\|",
    hostile_pattern=r"(^|[^a-z])(idiot|stupid|worthless|pathetic|fuck|shit)([^a-z]|$)",
    topic_pattern=r"(^|[^a-z])(the|and|les|des|der|und|los|las)([^a-z]|$)",
    domain_terms=("the", "and", "of", "les", "des", "der", "die", "los", "las"),
    topic_keywords=("the ", "les ", "der ", "los "),
    extra={"domain_rich_hits": 10},
)


def respondents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("respondent_id"),
        F.col("lang").alias("dataset_id"),
        F.col("source").alias("supplier"),
        F.col("text").alias("open_text"),
    )
    return d.join(client_labels(spark, sf), "respondent_id", "left")


def respondent_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Only ids and texts, in enough partitions for work that is heavy per row."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select(F.col("doc_id").alias("respondent_id"), F.col("text").alias("open_text"))


def client_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("respondent_id"),
        (F.lit(1) - F.col("quality")).cast("int").alias("rejected"),
        F.col("toxic").cast("int").alias("toxic"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Grid answers in order: respondent = order, item key = (line, part, supplier)."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("respondent_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("field"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("linestatus"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user and day with start, duration and number of events."""
    e = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        e.groupBy(F.col("user_id"), F.to_date("ts").alias("day"))
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count(F.lit(1)).alias("n_events"),
            ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("qtime"),
        )
        .withColumn("dataset_id", F.concat(F.lit("wave"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")))
        .withColumn("session_key", F.col("user_id") * 100000 + F.datediff(F.col("day"), F.lit("2000-01-01").cast("date")))
    )


def chain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("respondent_id"), F.col("turn"), F.col("role"), F.col("text")
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("respondent_id"), "embedding", F.col("label").alias("dataset_no")
    ).withColumn("rejected", (F.col("dataset_no") < 3).cast("int"))


def exemplars(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark")


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey, "left")
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("c_custkey").alias("respondent_id"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
        )
    )


def respondent_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Respondents with the fastest session of the same id and the flag grid of the same id."""
    timing = (
        sessions(spark, sf).where("n_events >= 2").groupBy(F.col("user_id").alias("respondent_id")).agg(F.min("qtime").alias("qtime"))
    )
    cells = answers(spark, sf).groupBy("respondent_id", "flag").agg(F.count(F.lit(1)).alias("c"))
    grid = cells.groupBy("respondent_id").agg(
        F.sum("c").alias("n_items"),
        (F.max("c") / F.sum("c")).alias("modal_share"),
        F.count(F.lit(1)).alias("n_distinct"),
    )
    return respondents(spark, sf).join(timing, "respondent_id", "left").join(grid, "respondent_id", "left")


# --- the same bindings in SQL, for the twins ---------------------------------------------------


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


RESP = """resp AS (
  SELECT d.doc_id AS respondent_id, d.lang AS dataset_id, d.source AS supplier, d.text AS open_text,
         CAST(1 - l.quality AS INTEGER) AS rejected, CAST(l.toxic AS INTEGER) AS toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

NORM = "lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"


def norm_sql(c: str) -> str:
    return NORM.format(c=c)


SESS = """sess AS (
  SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events,
         date_diff('microseconds', min(ts), max(ts)) / 1e6::DOUBLE AS qtime,
         'wave' || (user_id % 4) AS dataset_id
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""

FRAME = f"""{RESP}, {SESS},
timing AS (SELECT user_id AS respondent_id, min(qtime) AS qtime FROM sess WHERE n_events >= 2 GROUP BY 1),
cells AS (SELECT l_orderkey AS respondent_id, l_returnflag AS flag, count(*) AS c FROM lineitem GROUP BY 1, 2),
grid AS (SELECT respondent_id, CAST(sum(c) AS BIGINT) AS n_items, max(c) / CAST(sum(c) AS DOUBLE) AS modal_share,
                count(*) AS n_distinct FROM cells GROUP BY 1),
frame AS (SELECT resp.*, timing.qtime, grid.n_items, grid.modal_share, grid.n_distinct
  FROM resp LEFT JOIN timing USING (respondent_id) LEFT JOIN grid USING (respondent_id))"""

WORDS = "regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}'']+')"


def words_sql(c: str) -> str:
    return WORDS.format(c=c)


def text_facts_frame(spark: SparkSession, sf: str) -> DataFrame:
    return stage(spark, sf, "text_facts", lambda: text_facts(respondent_texts(spark, sf), "respondent_id", "open_text", STUDY))


def scored_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Signals, frozen risk with weights that spread over the study's texts, and the evaluation score.

    Most queries start here, so it is a stage table: the texts are read once.
    """

    def build() -> DataFrame:
        frame = respondent_frame(spark, sf).drop("open_text").join(text_facts_frame(spark, sf), "respondent_id", "left")
        return evaluation_score(frozen_risk(signal_matrix(frame, STUDY), STUDY_WEIGHTS))

    return stage(spark, sf, "scored", build)


STUDY_WEIGHTS = RiskWeights(specific=0.05, client_scale=1.3)


def flag_sql(cond: str, name: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER) AS {name}"


_S = STUDY
_IN = "(" + ", ".join(q(x) for x in _S.domain_terms) + ")"
SIG = f"""{FRAME},
s0 AS (SELECT frame.*, {norm_sql('open_text')} AS t FROM frame),
s1 AS MATERIALIZED (SELECT s0.*, {words_sql('t')} AS w, trim(regexp_replace(regexp_replace(regexp_replace(t, '[0-9]+', '#', 'g'), '[^a-z# ]+', ' ', 'g'), ' +', ' ', 'g')) AS sg,
  regexp_extract_all(t, '[a-z'']+') AS lw,
  (CAST(qtime IS NULL AS INTEGER) + CAST(n_items IS NULL AS INTEGER) + CAST(coalesce(supplier, '') = '' AS INTEGER) + CAST(t = '' AS INTEGER)) / 4.0::DOUBLE AS missing_rate FROM s0),
bg AS (SELECT respondent_id, unnest(list_transform(range(1, len(lw)), lambda i: lw[i] || ' ' || lw[i + 1])) AS g FROM s1 WHERE len(lw) >= 6),
rp AS MATERIALIZED (SELECT DISTINCT respondent_id AS rid FROM (SELECT respondent_id, g FROM bg GROUP BY 1, 2 HAVING count(*) >= 3)),
s2 AS (SELECT s1.*, len(w) AS word_count, length(t) AS char_count, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0.0::DOUBLE END AS unique_token_ratio,
  CASE WHEN length(t) >= {_S.min_duplicate_chars} THEN count(*) OVER (PARTITION BY t) ELSE 0 END AS dup_count,
  CASE WHEN length(sg) >= {_S.min_signature_chars} THEN count(*) OVER (PARTITION BY sg) ELSE 0 END AS sig_count, rid IS NOT NULL AS rep FROM s1 LEFT JOIN rp ON rid = respondent_id),
s3 AS MATERIALIZED (SELECT *, word_count > 0 AND (regexp_matches(t, {q(_S.generic_pattern)}) OR word_count <= {_S.low_words}) AS gen FROM s2),
sig AS MATERIALIZED (SELECT respondent_id, dataset_id, supplier, rejected, toxic, qtime, n_items, modal_share, n_distinct, word_count, char_count, unique_token_ratio, missing_rate, dup_count,
  {flag_sql('dup_count >= 2', 'f_duplicate_open')}, {flag_sql('sig_count >= 2', 'f_template_cluster')}, {flag_sql(f'qtime < {_S.fast_seconds}', 'f_fast_complete')}, {flag_sql('gen', 'f_open_generic')},
  {flag_sql(f'word_count >= {_S.long_words} AND unique_token_ratio < {_S.low_unique_ratio}', 'f_low_specificity')}, {flag_sql(f'regexp_matches(t, {q(_S.meta_pattern)})', 'f_survey_meta')},
  {flag_sql(f'regexp_matches(t, {q(_S.polished_pattern)})', 'f_polished')}, {flag_sql(f'n_items >= {_S.matrix_min_items} AND modal_share >= {_S.matrix_modal_share}', 'f_matrix_uniform')},
  {flag_sql(f'missing_rate > {_S.high_missing}', 'f_high_missing')}, {flag_sql('rep', 'f_repeated_phrase')}, {flag_sql(f'regexp_matches(t, {q(_S.hostile_pattern)})', 'f_hostile')},
  {flag_sql(f'regexp_matches(t, {q(_S.grounded_pattern)})', 'g_grounded')}, {flag_sql('word_count >= 8 AND NOT gen', 'g_specific_detail')},
  {flag_sql(f'len(list_filter(w, lambda x: x IN {_IN})) >= {_S.extra["domain_rich_hits"]}', 'g_domain_rich')} FROM s3)"""

_LIST = "list_filter([{items}], lambda x: x IS NOT NULL)"
SIGNAL_LIST = _LIST.format(items=", ".join(f"CASE WHEN f_{s} = 1 THEN '{s}' END" for s in SIGNALS))
GUARD_LIST = _LIST.format(items=", ".join(f"CASE WHEN g_{g} = 1 THEN '{g}' END" for g in GUARDS))

_W = STUDY_WEIGHTS
SCORED = f"""{SIG},
sets AS (SELECT *, {SIGNAL_LIST} AS signals, {GUARD_LIST} AS guards, CAST(word_count = 0 AS INTEGER) AS no_open, CAST(word_count > 0 AND word_count <= 6 AND f_open_generic = 0 AS INTEGER) AS short_valid FROM sig),
raw AS (SELECT *, greatest(0.0::DOUBLE, {_W.template}::DOUBLE * f_template_cluster + {_W.fast_generic}::DOUBLE * (f_fast_complete * f_open_generic) + {_W.missing_polished}::DOUBLE * (f_high_missing * f_polished)
  + {_W.uniform_weak}::DOUBLE * (f_matrix_uniform * greatest(f_open_generic, no_open)) + {_W.missing_no_open}::DOUBLE * (f_high_missing * no_open) + {_W.generic}::DOUBLE * f_open_generic
  - {_W.specific}::DOUBLE * g_specific_detail - {_W.short_valid}::DOUBLE * short_valid) AS risk_raw FROM sets),
prob AS (SELECT *, round(least(greatest(risk_raw / {_W.client_scale}::DOUBLE, 0.02::DOUBLE), 0.98::DOUBLE), 6) AS client_reject_probability,
  round(least(greatest((risk_raw + 0.4::DOUBLE * f_template_cluster + 0.3::DOUBLE * (f_fast_complete * f_polished)) / {_W.authenticity_scale}::DOUBLE, 0.02::DOUBLE), 0.98::DOUBLE), 6) AS authenticity_risk_probability,
  round(least(greatest((0.6::DOUBLE * f_high_missing + 0.5::DOUBLE * f_matrix_uniform + 0.4::DOUBLE * f_fast_complete + 0.35::DOUBLE * f_open_generic) / {_W.attention_scale}::DOUBLE, 0.02::DOUBLE), 0.98::DOUBLE), 6) AS attention_or_validity_risk,
  round(least(greatest(0.5::DOUBLE * g_specific_detail + 0.25::DOUBLE * short_valid + 0.25::DOUBLE * CAST(missing_rate < 0.5 AS INTEGER), 0.0::DOUBLE), 1.0::DOUBLE), 6) AS protective_score,
  round(least(greatest(0.2::DOUBLE + 0.35::DOUBLE * no_open + 0.25::DOUBLE * CAST(missing_rate > 0.65 AS INTEGER) + 0.2::DOUBLE * CAST(qtime IS NULL AS INTEGER), 0.05::DOUBLE), 1.0::DOUBLE), 6) AS model_uncertainty FROM raw),
scored AS MATERIALIZED (SELECT *, CASE WHEN client_reject_probability >= 0.75 THEN 'Exclude candidate' WHEN client_reject_probability >= 0.55 THEN 'Review closely' WHEN client_reject_probability >= 0.30 THEN 'Light review'
  WHEN client_reject_probability >= 0.15 OR protective_score > 0 THEN 'Keep with note' ELSE 'Clean keep' END AS operational_tier,
  CASE WHEN client_reject_probability >= 0.75 THEN 5 WHEN client_reject_probability >= 0.55 THEN 4 WHEN client_reject_probability >= 0.30 THEN 3 WHEN client_reject_probability >= 0.15 OR protective_score > 0 THEN 2 ELSE 1 END AS tier_n,
  round(0.65::DOUBLE * client_reject_probability + 0.35::DOUBLE * least(1.0::DOUBLE, 1 - unique_token_ratio), 6) AS score FROM prob)"""


# --- triage frame: everything the decision queries look at -------------------------------------------

CONTEXT = r"(^|[^a-z])(the|les|der|los)([^a-z]|$)"
SUPPLIER_BRANDS, SUPPLIER_CATEGORIES, SUPPLIER_INVALID = r"src[0-4]$", r"src1[0-4]$", r"^src9$"


LATIN_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'"
SYLLABLES = "[aeiouyàâäéèêëíîïóôöúûüñ]+"
_SEARCHED = (
    L.MASH_MARKERS, L.THIRD_PERSON_MARKERS, L.OFF_TOPIC_MARKERS, L.FIRST_PERSON_MARKERS, L.EXPERIENCE_MARKERS, L.TOPIC_MARKERS, L.MISSPELLINGS, FACTOR_TERMS,
    STUDY.topic_pattern, CONTEXT, L.SUBSTANTIVE_PATTERN, L.PROJECT_PATTERN, L.ENTHUSIASM_PATTERN, L.FEEDBACK_NARRATIVE_PATTERN, L.ABUSIVE_PATTERN, T.EMPTY_TALK_PATTERN,
)
#: What the decision rules look for, read in one go. The contact pattern means the same to Arrow in squashed texts, and takes time with their length there.
TEXT_READING = Reading(
    (*dict.fromkeys(p for p in map(X.as_pattern, _SEARCHED) if plain(p)), L.CONTACT_PATTERN),
    counts=(SYLLABLES,), letters=(T.VOWELS, T.CONSONANTS), runs=(LATIN_LETTERS, ".!?"), phrases=True,
)


def triage_frame(spark: SparkSession, sf: str) -> DataFrame:
    return stage(spark, sf, "triage", lambda: _triage(spark, sf))


def _text_reads(spark: SparkSession, sf: str) -> DataFrame:
    """What the decision rules read from the text, one narrow row per respondent."""
    t, find = F.col("open_text"), finder(TEXT_READING, "_r")
    texts = read_texts(respondent_texts(spark, sf).withColumn("open_text", X.norm(t)), "open_text", TEXT_READING, "_r")
    n_words, n_sent = value(TEXT_READING, "_r", "runs", LATIN_LETTERS), F.greatest(value(TEXT_READING, "_r", "runs", ".!?"), F.lit(1))
    syl = value(TEXT_READING, "_r", "count", SYLLABLES)
    level = F.round(0.39 * n_words / n_sent + 11.8 * syl / F.greatest(n_words, F.lit(1)) - 15.59, 4)

    def bit(x):
        return x.cast("int")

    return texts.select(
        "respondent_id",
        T.open_text_class(t, find=find, normed=True, letters=lambda some: value(TEXT_READING, "_r", "letters", some)).alias("oe_class"),
        T.narrative_quality(t, STUDY.topic_pattern, find, True, F.col("_r.repeated")).alias("narrative_quality"),
        bit(T.severe_weak(t, CONTEXT, find, True)).alias("weak_text"),
        bit(T.misplaced(t, CONTEXT, find, True, find(t, L.CONTACT_PATTERN))).alias("misplaced_text"),
        level.alias("read_level"),
        bit(find(t, L.MISSPELLINGS)).alias("misspelled"),
        bit(find(t, L.PROJECT_PATTERN)).alias("project_context"),
        bit(find(t, L.SUBSTANTIVE_PATTERN)).alias("substantive_context"),
        bit(find(t, L.ENTHUSIASM_PATTERN)).alias("enthusiastic"),
        bit(t.rlike(r"(.)\1{4,}")).alias("repeated_characters"),
        bit(t.rlike(f"^({L.NON_RESPONSE_PATTERN})$")).alias("non_response"),
        bit(find(t, FACTOR_TERMS)).alias("factor_terms"),
        F.when(t != "", F.md5(t)).alias("_k"),
    )


def _triage(spark: SparkSession, sf: str) -> DataFrame:
    s = scored_frame(spark, sf).join(stage(spark, sf, "text_reads", lambda: _text_reads(spark, sf)), "respondent_id")
    s = R.with_group_stats(
        s, ["_k"], "respondent_id", _n=F.count(F.lit(1)), _s1=F.min("supplier"), _s2=F.max("supplier"), _d1=F.min("dataset_id"), _d2=F.max("dataset_id")
    )
    dup = (
        F.when(F.col("_k").isNull() | (F.col("_n") <= 1), "single")
        .when((F.col("_s1") == F.col("_s2")) & (F.col("_d1") == F.col("_d2")), "shared_response_chain").otherwise("independent_duplicate_cluster")
    )
    s = s.withColumn("duplicate_type", dup).drop("_k", "_n", "_s1", "_s2", "_d1", "_d2")
    rates = D.supplier_stats(respondents(spark, sf).select("supplier", "rejected"), "supplier").select("supplier", F.col("reject_rate").alias("supplier_reject_rate"))
    entropy = M.answer_entropy(answers(spark, sf), "respondent_id", "flag").select("respondent_id", "answer_entropy")
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("respondent_id"), T.role_class(F.col("c_mktsegment")).alias("role_class"))
    s = TM.timing_bands(s, "dataset_id", "qtime")
    s = TM.zscores(s, "dataset_id", "qtime", "respondent_id").withColumnRenamed("zscore", "qtime_z")
    s = R.attach_groups(s, rates, ["supplier"]).join(entropy, "respondent_id", "left").join(people, "respondent_id", "left")
    token = T.brand_token_class(F.col("supplier"), SUPPLIER_BRANDS, SUPPLIER_CATEGORIES, SUPPLIER_INVALID)
    quality = (
        F.when(token == "blank", "missing_brand_list").when(token.isin("valid_brand_or_variant", "tool_category_not_brand"), "has_valid_brand_or_tool_category")
        .when(token == "unknown_possible_brand", "unknown_possible_brand_only").when(token.isin("invalid_or_too_generic", "too_short_unknown"), "weak_or_invalid_brand_list")
        .otherwise("unknown_brand_quality")
    )
    t1 = F.col("f_hostile") + F.col("f_survey_meta")
    return (
        s.withColumn("role_class", F.coalesce("role_class", F.lit("missing_role")))
        .withColumn("brand_quality", quality)
        .withColumn("answer_entropy", F.round(F.coalesce("answer_entropy", F.lit(0.0)), 6))
        .withColumn("near_straightline", F.coalesce(((F.col("n_items") >= 4) & (F.col("modal_share") >= 0.6)).cast("int"), F.lit(0)))
        .withColumn("is_discard_signal", T.is_discard_class(F.col("oe_class")).cast("int"))
        .withColumn("is_personal", (F.col("oe_class") == "first_person_personal").cast("int"))
        .withColumn("t1_count", t1).withColumn("t2_count", F.col("f_duplicate_open")).withColumn("t3_count", F.size("signals") - t1 - F.col("f_duplicate_open"))
        .withColumn("ml_score", F.col("score"))
    )


def any_sql(col: str, markers) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(m)})" for m in markers) + ")"


def bit_sql(cond: str, name: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER) AS {name}"


def starts_sql(col: str, markers) -> str:
    return "(" + " OR ".join(f"starts_with({col}, {q(m)})" for m in markers) + ")"


def class_sql(t: str = "t", topics=L.TOPIC_MARKERS) -> str:
    last = f"string_split({t}, ' ')[-1]"
    return f"""CASE WHEN length({t}) < 3 THEN 'empty'
      WHEN length({t}) > 10 AND ((length(regexp_replace({t}, '[^aeiou]', '', 'g')) > 0 AND length(regexp_replace({t}, '[^bcdfghjklmnpqrstvwxyz]', '', 'g'))
           > 5 * length(regexp_replace({t}, '[^aeiou]', '', 'g'))) OR {any_sql(t, L.MASH_MARKERS)}) THEN 'gibberish'
      WHEN {any_sql(t, L.PRAISE_MARKERS)} AND length({t}) < 40 THEN 'generic_praise'
      WHEN {any_sql(t, L.THIRD_PERSON_MARKERS)} THEN 'third_person_meta'
      WHEN {any_sql(t, L.OFF_TOPIC_MARKERS)} THEN 'off_topic_incoherent'
      WHEN length({t}) < 15 AND {any_sql(t, L.NON_ANSWER_MARKERS)} THEN 'off_topic_incoherent'
      WHEN length({t}) > 30 AND right({t}, 1) NOT IN ('.', '!', '?') AND ((length({last}) <= 2 AND {last} NOT IN ('ed', 'er', 'ly', 'ng'))
           OR ({starts_sql(t, L.TEMPLATE_STARTS)} AND length({t}) < 100)) THEN 'templated_truncated'
      WHEN {any_sql(t, L.FIRST_PERSON_MARKERS)} AND {any_sql(t, L.EXPERIENCE_MARKERS)} THEN 'first_person_personal'
      WHEN NOT {any_sql(t, L.FIRST_PERSON_MARKERS)} AND {any_sql(t, topics)} THEN 'generic_topic_restatement'
      WHEN length({t}) > 30 THEN 'substantive' ELSE 'short_neutral' END"""


def narrative_sql(t: str = "t", rep: str = "rep", w: str = "w", topic: str = STUDY.topic_pattern) -> str:
    n, u = f"len({w})", f"len(list_distinct({w}))"
    return f"""CASE WHEN {t} = '' THEN 'blank'
      WHEN regexp_matches({t}, {q(L.ABUSIVE_PATTERN)}) OR regexp_full_match({t}, {q(L.NON_COOPERATIVE_PATTERN)}) THEN 'non_cooperative'
      WHEN {rep} THEN 'nonsensical_or_repetitive'
      WHEN regexp_matches({t}, {q(L.FEEDBACK_NARRATIVE_PATTERN)}) AND NOT regexp_matches({t}, {q(topic)}) AND NOT regexp_matches({t}, {q(L.SUBSTANTIVE_PATTERN)}) THEN 'generic_survey_feedback'
      WHEN regexp_matches({t}, {q(topic)}) THEN CASE WHEN {n} <= 2 OR {u} <= 2 THEN 'low_information' ELSE 'topic_relevant' END
      WHEN regexp_matches({t}, {q(L.SUBSTANTIVE_PATTERN)}) THEN CASE WHEN {n} <= 2 OR {u} <= 2 THEN 'low_information' ELSE 'substantive_narrative' END
      WHEN {n} <= 3 OR {u} <= 2 THEN 'low_information' ELSE 'unclear_product_answer' END"""


_SUBST = f"regexp_matches(t, {q(L.SUBSTANTIVE_PATTERN)})"
_PROTECT = f"(regexp_matches(t, {q(L.PROJECT_PATTERN)}) OR regexp_matches(t, {q(CONTEXT)}))"
# DuckDB's regular expressions have no back references: a run of five is spelled out per character
_CHARS = [chr(i) for i in range(33, 127)] + list("àâäáçèéêëíîïñóôöùúûüßœæ—–’“”…€")
_RUN5 = "regexp_matches(t, " + q("|".join(("\\" + ch if not ch.isalnum() and ord(ch) < 128 else ch) + "{5}" for ch in _CHARS)) + ")"
# needs t, lw (words longer than two characters) and aw (all words)
WEAK_SQL = f"""(t = '' OR (NOT {_PROTECT} AND (regexp_full_match(t, {q(L.NON_RESPONSE_PATTERN)}) OR (NOT {_SUBST} AND (
   regexp_matches(t, '(^|[^a-z])(test|asdf|qwerty|n/?a|dont know|don''t know|no idea|not sure)([^a-z]|$)')
   OR (len(list_distinct(lw3)) <= 3 AND coalesce(list_max(list_transform(list_distinct(lw3), lambda d: len(list_filter(lw3, lambda y: y = d)))), 0) >= 3) OR {_RUN5})))))"""
MISPLACED_SQL = f"""(t = '' OR regexp_matches(t, {q(L.CONTACT_PATTERN)}) OR (NOT ({_SUBST} OR {_PROTECT}) AND (len(aw) = 0 OR (len(aw) <= 6 AND (
   len(list_filter(aw, lambda x: length(x) <= 3)) >= greatest(3, len(aw) - 1) OR len(list_filter(aw, lambda x: regexp_matches(x, '[aeiouy]'))) <= greatest(1, len(aw) // 3))))))"""

TRIAGE = f"""{SCORED},
x0 AS MATERIALIZED (SELECT respondent_id, t, rep, regexp_extract_all(t, '[a-z0-9'']+') AS aw, list_filter(regexp_extract_all(t, '[a-z0-9'']+'), lambda x: length(x) > 2) AS lw3, len(regexp_extract_all(t, '[A-Za-z'']+')) AS nw,
  greatest(len(regexp_extract_all(t, '[.!?]+')), 1) AS ns, len(regexp_extract_all(t, '[aeiouyàâäéèêëíîïóôöúûüñ]+')) AS sy FROM s3),
x1 AS MATERIALIZED (SELECT respondent_id, t, {class_sql()} AS oe_class, {narrative_sql(w='aw')} AS narrative_quality, {bit_sql(WEAK_SQL, 'weak_text')}, {bit_sql(MISPLACED_SQL, 'misplaced_text')},
  round(0.39::DOUBLE * nw / ns + 11.8::DOUBLE * sy / greatest(nw, 1) - 15.59::DOUBLE, 4) AS read_level, {bit_sql(any_sql('t', L.MISSPELLINGS), 'misspelled')}, {bit_sql(f"regexp_matches(t, {q(L.PROJECT_PATTERN)})", 'project_context')},
  {bit_sql(_SUBST, 'substantive_context')}, {bit_sql(f"regexp_matches(t, {q(L.ENTHUSIASM_PATTERN)})", 'enthusiastic')}, {bit_sql(_RUN5, 'repeated_characters')}, {bit_sql(f"regexp_full_match(t, {q(L.NON_RESPONSE_PATTERN)})", 'non_response')},
  {bit_sql(any_sql('t', FACTOR_TERMS), 'factor_terms')} FROM x0),
dk AS (SELECT s3.t, count(*) AS n, count(DISTINCT s3.supplier) AS su, count(DISTINCT s3.dataset_id) AS da FROM s3 WHERE t <> '' GROUP BY 1),
sr AS (SELECT supplier, round(count(*) FILTER (rejected = 1) / count(*)::DOUBLE * 100, 1) AS supplier_reject_rate FROM resp GROUP BY 1),
ec AS (SELECT respondent_id, c / sum(c) OVER (PARTITION BY respondent_id)::DOUBLE AS p FROM cells), en AS (SELECT respondent_id, round(-sum(p * log2(p)), 6) + 0.0 AS answer_entropy FROM ec GROUP BY 1),
tc AS (SELECT dataset_id, quantile_cont(qtime, 0.1) AS p10, quantile_cont(qtime, 0.25) AS p25, quantile_cont(qtime, 0.5) AS p50 FROM scored WHERE qtime > 0 GROUP BY 1),
tz AS (SELECT dataset_id, avg(qtime) AS m, stddev_samp(qtime) AS sd FROM scored GROUP BY 1),
ro AS (SELECT c_custkey AS respondent_id, CASE WHEN lower(c_mktsegment) = '' THEN 'missing_role' WHEN regexp_matches(lower(c_mktsegment), {q(L.ABUSIVE_PATTERN)}) THEN 'non_cooperative' WHEN regexp_matches(lower(c_mktsegment), {q(L.TRADE_PATTERN)}) THEN 'trade_relevant'
  WHEN regexp_matches(lower(c_mktsegment), {q(L.NON_TRADE_PATTERN)}) THEN 'likely_non_trade' ELSE 'ambiguous_role' END AS role_class FROM customer),
triage AS MATERIALIZED (SELECT scored.*, x1.* EXCLUDE (respondent_id, t), CASE WHEN dk.n IS NULL OR dk.n <= 1 THEN 'single' WHEN su <= 1 AND da <= 1 THEN 'shared_response_chain' ELSE 'independent_duplicate_cluster' END AS duplicate_type,
  supplier_reject_rate, coalesce(answer_entropy, 0) AS answer_entropy, CASE WHEN qtime IS NULL OR qtime <= 0 THEN 'unknown' WHEN qtime <= p10 THEN 'bottom_10' WHEN qtime <= p25 THEN 'bottom_25' WHEN qtime <= p50 THEN 'below_median' ELSE 'above_median' END AS timing_band,
  CASE WHEN sd > 0 THEN (qtime - m) / sd ELSE 0 END AS qtime_z, coalesce(role_class, 'missing_role') AS role_class,
  CASE WHEN regexp_matches(supplier, {q(SUPPLIER_INVALID)}) THEN 'weak_or_invalid_brand_list' WHEN regexp_matches(supplier, {q(SUPPLIER_BRANDS)}) OR regexp_matches(supplier, {q(SUPPLIER_CATEGORIES)}) THEN 'has_valid_brand_or_tool_category' ELSE 'unknown_brand_quality' END AS brand_quality,
  CAST(coalesce(n_items >= 4 AND modal_share >= 0.6, false) AS INTEGER) AS near_straightline, CAST(oe_class NOT IN ('first_person_personal', 'substantive', 'short_neutral') AS INTEGER) AS is_discard_signal, CAST(oe_class = 'first_person_personal' AS INTEGER) AS is_personal,
  f_hostile + f_survey_meta AS t1_count, f_duplicate_open AS t2_count, len(signals) - f_hostile - f_survey_meta - f_duplicate_open AS t3_count, score AS ml_score
  FROM scored JOIN x1 USING (respondent_id) LEFT JOIN dk ON dk.t = x1.t LEFT JOIN sr USING (supplier) LEFT JOIN en USING (respondent_id) LEFT JOIN tc ON tc.dataset_id = scored.dataset_id LEFT JOIN tz ON tz.dataset_id = scored.dataset_id LEFT JOIN ro USING (respondent_id))"""
