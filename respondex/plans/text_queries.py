"""Queries over free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.functions import lexicons as L
from respondex.functions import text as X
from respondex.operators import text_signals as T
from respondex.plans.catalog import query
from respondex.plans.study import CONTEXT, MISPLACED_SQL, STUDY, WEAK_SQL, any_sql, chain, class_sql, narrative_sql, norm_sql, q, words_sql
from respondex.sources.tables import spread, table

LW = "regexp_extract_all({c}, '[A-Za-z'']+')"
SQUASH = "trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
TXT = f"WITH t AS (SELECT doc_id AS respondent_id, lang AS dataset_id, {SQUASH.format(c='text')} AS s, {norm_sql('text')} AS t FROM documents)"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def docs(spark, sf):
    """Texts without labels: no join, and enough partitions for work that is heavy per row."""
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return d.select(F.col("doc_id").alias("respondent_id"), F.col("lang").alias("dataset_id"), F.col("text").alias("open_text"))


@query(
    "c01_text_metrics",
    f"""{TXT}, w AS (SELECT *, {LW.format(c='lower(s)')} AS w FROM t)
    SELECT respondent_id, dataset_id, length(s) AS char_count, len(w) AS word_count,
      len(regexp_extract_all(s, '[.!?]+')) + CASE WHEN s <> '' THEN 1 ELSE 0 END AS sentence_count,
      CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w)::DOUBLE, 6) ELSE 0.0 END AS unique_token_ratio,
      CAST(regexp_matches(t, {q(STUDY.generic_pattern)}) OR length(t) <= 2 AS INTEGER) AS generic_placeholder,
      CAST(regexp_matches(t, {q(STUDY.polished_pattern)}) AS INTEGER) AS polished_marker
    FROM w""",
)
def c01(spark, sf):
    m = T.text_metrics(docs(spark, sf), "open_text", STUDY).drop("open_text")
    return m.withColumn("unique_token_ratio", F.round("unique_token_ratio", 6))


@query(
    "c02_open_text_features",
    f"""WITH t AS (SELECT conv_id AS respondent_id, {SQUASH.format(c='text')} AS t FROM conversations),
    r AS (SELECT *, lower(t) AS low, string_split(lower(t), ' ') AS w FROM t WHERE t <> ''),
    d AS (SELECT respondent_id, count(DISTINCT word) AS n_unique FROM (SELECT respondent_id, unnest(w) AS word FROM r) GROUP BY 1),
    a AS (SELECT respondent_id, count(*) AS oe_count, CAST(sum(length(t)) AS BIGINT) AS oe_total_chars, max(length(t)) AS oe_max_chars,
      min(length(t)) AS oe_min_chars, avg(length(t)) AS m, stddev_pop(length(t)) AS sd, CAST(sum(len(w)) AS BIGINT) AS oe_total_words,
      max(len(w)) AS oe_max_words,
      max(CAST({any_sql('low', ('none', 'n/a', 'na', 'nothing', 'no opinion', 'no idea'))} AS INTEGER)) AS oe_has_none,
      max(CAST({any_sql('low', ('good', 'fine', 'ok', 'okay', 'nice', 'great'))} AS INTEGER)) AS good,
      max(CAST(upper(t) = t AND regexp_matches(t, '\\p{{L}}') AND length(t) > 5 AS INTEGER)) AS oe_all_caps
      FROM r GROUP BY 1)
    SELECT respondent_id, oe_count, oe_total_chars, oe_max_chars, oe_min_chars, round(m, 6) AS oe_mean_chars, round(sd, 6) AS oe_std_chars,
      CASE WHEN m = 0 THEN NULL ELSE round(round(sd, 6) / round(m, 6), 6) END AS oe_cv_chars, oe_max_chars - oe_min_chars AS oe_range_chars,
      oe_total_words, oe_max_words, round(n_unique / oe_total_words::DOUBLE, 6) AS oe_lex_div, oe_has_none,
      CAST(good = 1 AND oe_max_words <= 3 AS INTEGER) AS oe_generic, oe_all_caps,
      CAST(oe_max_chars < 10 AS INTEGER) AS oe_very_short, CAST(oe_max_chars < 30 AS INTEGER) AS oe_short
    FROM a JOIN d USING (respondent_id)""",
)
def c02(spark, sf):
    return T.open_text_features(chain(spark, sf), "respondent_id", "text")


LOW_EFFORT_SQL = f"""(t <> '' AND (t IN {in_list(L.LOW_EFFORT_WORDS)}
   OR (length(t) >= 5 AND replace(t, substr(t, 1, 1), '') = '')
   OR (regexp_matches(t, '^[a-z]{{1,3}}$') AND t NOT IN {in_list(L.SHORT_WORDS_ALLOWED)})
   OR {any_sql('t', L.KEYBOARD_TOKENS)}))"""


@query(
    "c03_low_effort",
    f"""WITH t AS (SELECT doc_id AS respondent_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    n AS (SELECT respondent_id, {norm_sql('line')} AS t FROM t)
    SELECT respondent_id, count(*) AS n_lines, CAST(sum(CASE WHEN {LOW_EFFORT_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS low_effort_lines FROM n GROUP BY 1""",
)
def c03(spark, sf):
    """Every line of a document is judged as one answer."""
    lines = docs(spark, sf).select("respondent_id", F.explode(F.split("open_text", "\n")).alias("line"))
    return lines.groupBy("respondent_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(T.low_effort(F.col("line")).cast("int")).alias("low_effort_lines")
    )


@query(
    "c04_placeholder",
    f"""WITH t AS (SELECT lang AS dataset_id, unnest(string_split(text, ' ')) AS tok FROM documents), n AS (SELECT dataset_id, {norm_sql('tok')} AS t FROM t)
    SELECT dataset_id, count(*) AS n_tokens, CAST(sum(CAST(regexp_matches(t, {q(STUDY.placeholder_pattern)}) AS INTEGER)) AS BIGINT) AS placeholder_tokens FROM n GROUP BY 1""",
)
def c04(spark, sf):
    """The pattern is applied to every single word, where it does occur in these tables."""
    toks = docs(spark, sf).select("dataset_id", F.explode(F.split("open_text", " ")).alias("tok"))
    return toks.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum(T.placeholder(F.col("tok"), STUDY).cast("int")).alias("placeholder_tokens")
    )


@query(
    "c05_open_text_class",
    f"""{TXT} SELECT respondent_id, text_class, CAST(text_class NOT IN ('first_person_personal', 'substantive', 'short_neutral') AS INTEGER) AS is_discard_signal
    FROM (SELECT respondent_id, {class_sql()} AS text_class FROM t)""",
)
def c05(spark, sf):
    out = docs(spark, sf).select("respondent_id", T.open_text_class(F.col("open_text")).alias("text_class"))
    return out.withColumn("is_discard_signal", T.is_discard_class(F.col("text_class")).cast("int"))


STUDY_OUTRO = (
    ("gibberish_nonenglish", r"bvnhgjut|asdf|qwerty"),
    ("wrong_dimension", r"@|https?:"),
    ("wrong_universe", r"license|licence|copyright"),
    ("survey_meta_nonresponsive", r"idiot|pathetic|worthless"),
    ("survey_meta_praise", r"^(the|la|le|der|el) "),
)
STUDY_TEMPLATED = r"\|"
STUDY_PERSONAL = r"(^|[^a-z])(of|de|des|der)([^a-z]|$)"


@query(
    "c06_outro_class",
    f"""{TXT}, k AS (SELECT respondent_id, dataset_id, CASE WHEN t = '' THEN 'blank'
      {' '.join(f"WHEN regexp_matches(t, {q(p)}) THEN '{n}'" for n, p in STUDY_OUTRO)}
      WHEN len(regexp_extract_all(t, {q(STUDY_TEMPLATED)})) = 1 AND regexp_matches(t, {q(STUDY_PERSONAL)}) THEN 'adjacent_fit'
      WHEN len(regexp_extract_all(t, {q(STUDY_TEMPLATED)})) >= 1 THEN 'generic_filler_templated' ELSE 'direct_fit' END AS category FROM t)
    SELECT category, weight, rationale, count(*) AS n_rows FROM k JOIN (VALUES
      {', '.join(f"({q(k)}, {q(w)}, {q(r)})" for k, (w, r) in T.OUTRO_WEIGHTS.items())}) v(category, weight, rationale) USING (category) GROUP BY ALL""",
)
def c06(spark, sf):
    out = docs(spark, sf).select(T.outro_class(F.col("open_text"), STUDY_OUTRO, STUDY_TEMPLATED, STUDY_PERSONAL).alias("category"))
    rationale = F.coalesce(*[F.when(F.col("category") == k, F.lit(r)) for k, (_, r) in T.OUTRO_WEIGHTS.items()])
    return (
        out.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("weight", T.outro_weight(F.col("category"))).withColumn("rationale", rationale)
    )


STUDY_TAGS = {
    **L.TAG_PATTERNS,
    "templated": r"license|copyright",
    "repetition_loop": r"haha|hehe|\| [^|]+ \| [^|]+ \|",
    "non_english": r"(^|[^\p{L}])(les|des|der|die|und|los|las|el)([^\p{L}]|$)",
}


@query(
    "c07_pattern_tags",
    f"""WITH t AS (SELECT doc_id, lang AS dataset_id, {norm_sql('text')} AS t FROM documents),
    g AS (SELECT dataset_id, unnest(CASE WHEN t = '' THEN ['blank'] ELSE list_filter([
        CASE WHEN length(t) < 5 THEN 'very_short' END,
        {', '.join(f"CASE WHEN regexp_matches(t, {q(p)}) THEN '{n}' END" for n, p in STUDY_TAGS.items())},
        CASE WHEN len(string_split(t, ' ')) > 40 THEN 'long_text_40plus' END,
        CASE WHEN len(string_split(t, ' ')) <= 3 THEN 'very_few_words_3less' END], lambda x: x IS NOT NULL) END) AS tag FROM t)
    SELECT dataset_id, tag, count(*) AS n_rows FROM g GROUP BY ALL""",
)
def c07(spark, sf):
    tags = docs(spark, sf).select("dataset_id", F.explode(T.pattern_tags(F.col("open_text"), STUDY_TAGS)).alias("tag"))
    return tags.groupBy("dataset_id", "tag").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "c08_language_flags",
    f"""{TXT}, f AS (SELECT respondent_id, CAST(regexp_matches(t, {q(STUDY.meta_pattern)}) AS INTEGER) AS survey_meta_language,
      regexp_matches(t, {q(STUDY.polished_pattern)}) AS p, regexp_matches(t, {q(STUDY.grounded_pattern)}) AS g FROM t)
    SELECT respondent_id, survey_meta_language, CAST(p AS INTEGER) AS polished, CAST(p AND NOT g AS INTEGER) AS polished_ungrounded, CAST(g AS INTEGER) AS personal_grounding FROM f""",
)
def c08(spark, sf):
    return T.language_flags(docs(spark, sf).select("respondent_id", "open_text"), "open_text", STUDY).drop("open_text")


REPEAT_CTE = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents),
  grams AS (
    SELECT doc_id, w, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tok WHERE len(w) >= 6
    UNION ALL SELECT doc_id, w, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM tok WHERE len(w) >= 6
    UNION ALL SELECT doc_id, w, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS g FROM tok WHERE len(w) >= 6),
  repeated AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) >= 3))"""


@query(
    "c09_repeated_phrase",
    f"""WITH {REPEAT_CTE} SELECT d.doc_id AS respondent_id, CAST(r.doc_id IS NOT NULL AS INTEGER) AS repeated_phrase
    FROM documents d LEFT JOIN repeated r ON r.doc_id = d.doc_id""",
)
def c09(spark, sf):
    return docs(spark, sf).select("respondent_id", X.repeated_phrase(F.col("open_text")).cast("int").alias("repeated_phrase"))


@query(
    "c10_narrative_quality",
    f"""WITH {REPEAT_CTE}, t AS (SELECT d.doc_id AS respondent_id, {norm_sql('text')} AS t, r.doc_id IS NOT NULL AS rep FROM documents d LEFT JOIN repeated r ON r.doc_id = d.doc_id),
    x AS (SELECT *, regexp_extract_all(t, '[a-z0-9'']+') AS w FROM t)
    SELECT respondent_id, {narrative_sql()} AS narrative_quality FROM x""",
)
def c10(spark, sf):
    return docs(spark, sf).select("respondent_id", T.narrative_quality(F.col("open_text"), STUDY.topic_pattern).alias("narrative_quality"))


@query(
    "c11_weak_or_misplaced_lines",
    f"""WITH l AS (SELECT doc_id AS respondent_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    n AS (SELECT respondent_id, {norm_sql('line')} AS t FROM l),
    w AS (SELECT *, list_filter(regexp_extract_all(t, '[a-z0-9'']+'), lambda x: length(x) > 2) AS lw3, regexp_extract_all(t, '[a-z0-9'']+') AS aw FROM n),
    f AS (SELECT respondent_id, {WEAK_SQL} AS weak, {MISPLACED_SQL} AS misplaced FROM w)
    SELECT respondent_id, count(*) AS n_lines, CAST(sum(CAST(weak AS INTEGER)) AS BIGINT) AS weak_lines,
      CAST(sum(CAST(misplaced AS INTEGER)) AS BIGINT) AS misplaced_lines FROM f GROUP BY 1""",
)
def c11(spark, sf):
    lines = docs(spark, sf).select("respondent_id", F.explode(F.split("open_text", "\n")).alias("line"))
    return lines.groupBy("respondent_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(T.severe_weak(F.col("line"), CONTEXT).cast("int")).alias("weak_lines"),
        F.sum(T.misplaced(F.col("line"), CONTEXT).cast("int")).alias("misplaced_lines"),
    )


@query(
    "c12_long_low_specificity",
    f"""WITH w AS (SELECT doc_id AS respondent_id, {words_sql('lower(text)')} AS w FROM documents)
    SELECT respondent_id, CAST(len(w) >= {STUDY.long_words} AND len(list_distinct(w)) / len(w)::DOUBLE < {STUDY.low_unique_ratio} AS INTEGER) AS long_low_specificity FROM w""",
)
def c12(spark, sf):
    return docs(spark, sf).select("respondent_id", T.long_low_specificity(F.col("open_text"), STUDY).cast("int").alias("long_low_specificity"))


BRANDS, CATEGORIES = r"gizmo|widget", r"bolt|gear|ring"


@query(
    "c13_role_and_brand_quality",
    f"""WITH b AS (SELECT o.o_custkey AS respondent_id, lower(p.p_name) AS t FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey),
    k AS (SELECT respondent_id, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, {q(L.ABUSIVE_PATTERN)}) THEN 'hostile_or_abusive' WHEN regexp_matches(t, {q(L.INVALID_BRAND_PATTERN)}) THEN 'invalid_or_too_generic'
        WHEN regexp_matches(t, {q(BRANDS)}) THEN 'valid_brand_or_variant' WHEN regexp_matches(t, {q(CATEGORIES)}) THEN 'tool_category_not_brand' WHEN length(t) <= 2 THEN 'too_short_unknown'
        WHEN regexp_matches(t, '^[a-z ]{{3,35}}$') THEN 'unknown_possible_brand' ELSE 'other_unknown' END AS c FROM b),
    z AS (SELECT respondent_id, count(*) FILTER (c <> 'blank') AS n_brands,
      CASE WHEN count(*) FILTER (c <> 'blank') = 0 THEN 'missing_brand_list' WHEN bool_or(c = 'hostile_or_abusive') THEN 'hostile_brand_answer'
        WHEN bool_or(c IN ('valid_brand_or_variant', 'tool_category_not_brand')) THEN 'has_valid_brand_or_tool_category'
        WHEN bool_or(c = 'unknown_possible_brand') THEN 'unknown_possible_brand_only'
        WHEN bool_or(c IN ('invalid_or_too_generic', 'too_short_unknown')) THEN 'weak_or_invalid_brand_list' ELSE 'unknown_brand_quality' END AS brand_quality FROM k GROUP BY 1)
    SELECT c.c_custkey AS respondent_id, CASE WHEN lower(c_mktsegment) = '' THEN 'missing_role' WHEN regexp_matches(lower(c_mktsegment), {q(L.ABUSIVE_PATTERN)}) THEN 'non_cooperative'
        WHEN regexp_matches(lower(c_mktsegment), {q(L.TRADE_PATTERN)}) THEN 'trade_relevant' WHEN regexp_matches(lower(c_mktsegment), {q(L.NON_TRADE_PATTERN)}) THEN 'likely_non_trade'
        WHEN regexp_matches(lower(c_mktsegment), {q(L.MAYBE_TRADE_PATTERN)}) OR len(string_split(c_mktsegment, ' ')) <= 3 THEN 'ambiguous_role' ELSE 'unclear_role' END AS role_class,
      coalesce(z.n_brands, 0) AS n_brands, coalesce(z.brand_quality, 'missing_brand_list') AS brand_quality
    FROM customer c LEFT JOIN z ON z.respondent_id = c.c_custkey""",
)
def c13(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", T.brand_token_class(F.col("p_name"), BRANDS, CATEGORIES).alias("token_class")
    )
    # count per (customer, class) before anything wide: a class list per customer has eight rows at most
    entries = (
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("respondent_id"), "token_class")
    )
    quality = T.brand_quality(entries, "respondent_id", "token_class")
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("respondent_id"), T.role_class(F.col("c_mktsegment")).alias("role_class"))
    return people.join(quality, "respondent_id", "left").select(
        "respondent_id", "role_class", F.coalesce("n_brands", F.lit(0)).alias("n_brands"), F.coalesce("brand_quality", F.lit("missing_brand_list")).alias("brand_quality")
    )


@query(
    "c14_specificity",
    f"""{TXT}, w AS (SELECT *, {LW.format(c='lower(s)')} AS w FROM t),
    x AS (SELECT respondent_id, len(w) AS word_count, len(list_filter(w, lambda y: y IN {in_list(STUDY.domain_terms)})) AS domain_term_count,
      len(regexp_extract_all(s, '[0-9]+')) AS number_count, len(regexp_extract_all(s, '[A-Z][A-Za-z0-9&]{{2,}}')) AS capitalized_entity_count,
      len(list_distinct(w)) AS unique_words FROM w)
    SELECT *, round(domain_term_count + number_count + least(capitalized_entity_count, 5) + unique_words / 12.0::DOUBLE, 6) AS specificity_score FROM x""",
)
def c14(spark, sf):
    return T.specificity(docs(spark, sf).select("respondent_id", "open_text"), "open_text", STUDY).drop("open_text")


def cnt(lex) -> str:
    return f"len(list_filter(w, lambda y: y IN {in_list(lex)}))"


@query(
    "c15_grounding",
    f"""WITH w AS (SELECT doc_id AS respondent_id, {words_sql('lower(text)')} AS w FROM documents),
    x AS (SELECT respondent_id, {cnt(L.TEMPORAL_ANCHORS)} AS temporal_anchors, {cnt(L.LOCATION_ANCHORS)} AS locational_anchors, {cnt(L.SENSORY_ANCHORS)} AS sensory_anchors,
      {cnt(L.FIRST_PERSON_WORDS)} AS first_person_count, {cnt(STUDY.domain_terms)} AS domain_mentions, {cnt(('widget', 'gizmo', 'on', 'in'))} AS brand_mentions,
      round(len(list_distinct(w)) / greatest(len(w), 1)::DOUBLE, 6) AS oe_specificity FROM w)
    SELECT *, temporal_anchors + locational_anchors + sensory_anchors AS grounding_total FROM x""",
)
def c15(spark, sf):
    return T.grounding(docs(spark, sf).select("respondent_id", "open_text"), "open_text", STUDY.domain_terms, ("widget", "gizmo", "on", "in")).drop("open_text")


SIG_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[0-9]+', '#', 'g'), '[^a-z# ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("c16_signature", f"SELECT doc_id AS respondent_id, {SIG_SQL.format(c='text')} AS signature FROM documents")
def c16(spark, sf):
    return docs(spark, sf).select("respondent_id", X.signature(F.col("open_text")).alias("signature"))


@query(
    "c17_cross_answer_overlap",
    f"""WITH s AS (SELECT conv_id, turn, list_distinct({words_sql('lower(text)')}) AS w, length(coalesce(text, '')) AS n FROM conversations),
    p AS (SELECT a.conv_id, sum(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE) AS total
      FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn AND len(a.w) > 0 AND len(b.w) > 0 GROUP BY 1),
    g AS (SELECT conv_id, count(*) AS n_answers, avg(n) AS m, stddev_pop(n) AS sd FROM s GROUP BY 1)
    SELECT g.conv_id AS respondent_id, n_answers, round(coalesce(total, 0) / greatest(n_answers * (n_answers - 1) / 2, 1), 6) AS mean_overlap,
      CASE WHEN m = 0 THEN NULL ELSE round(sd / m, 6) END AS length_cv FROM g LEFT JOIN p USING (conv_id)""",
)
def c17(spark, sf):
    return T.cross_answer_overlap(chain(spark, sf), "respondent_id", "turn", "text")


def lines_as_fields(spark, sf):
    """Each line of a document is one field of the respondent."""
    return docs(spark, sf).select("respondent_id", F.posexplode(F.split("open_text", "\n")).alias("pos", "line"))


@query(
    "c18_copied_across_fields",
    f"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents),
    t AS (SELECT id, array_to_string({words_sql('lower(line)')}, ' ') AS t FROM l), d AS (SELECT id, t, count(*) AS same FROM t WHERE length(t) > 0 GROUP BY 1, 2),
    c AS (SELECT a.id, a.t, count(*) AS k FROM d a JOIN d b ON a.id = b.id AND length(b.t) > length(a.t) AND length(a.t) > 10
      AND contains(' ' || b.t || ' ', ' ' || a.t || ' ') GROUP BY 1, 2),
    g AS (SELECT d.id AS respondent_id, CAST(sum(same) AS BIGINT) AS n_answers, CAST(sum(CASE WHEN same > 1 AND length(d.t) > 5 THEN same ELSE 0 END) AS BIGINT) AS identical_answers,
      CAST(sum(CASE WHEN k IS NOT NULL THEN same ELSE 0 END) AS BIGINT) AS contained_answers FROM d LEFT JOIN c ON c.id = d.id AND c.t = d.t GROUP BY 1)
    SELECT *, CAST(identical_answers > 0 OR contained_answers > 0 AS INTEGER) AS copied FROM g""",
)
def c18(spark, sf):
    return T.copied_across_fields(lines_as_fields(spark, sf), "respondent_id", "pos", "line")


@query(
    "c19_topic_mismatch",
    f"""{TXT} SELECT respondent_id, CAST(len(string_split(t, ' ')) >= 5 AND NOT {any_sql('t', STUDY.topic_keywords)} AS INTEGER) AS topic_mismatch FROM t""",
)
def c19(spark, sf):
    return docs(spark, sf).select("respondent_id", T.topic_mismatch(F.col("open_text"), STUDY.topic_keywords).cast("int").alias("topic_mismatch"))


def tfidf_sql(terms_cte: str, min_df: int, max_df: float) -> str:
    return f"""WITH {terms_cte}, tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
    v AS (SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), n
      WHERE df >= {min_df} AND df <= n * {max_df}::DOUBLE),
    w AS (SELECT id, term, tf, tf * idf AS w FROM tf JOIN v USING (term)), l AS (SELECT id, sqrt(sum(w * w)) AS l2 FROM w GROUP BY 1)
    SELECT id AS respondent_id, term, tf, round(w / l2, 6) AS tfidf FROM w JOIN l USING (id)"""


@query(
    "c20_tfidf_word",
    tfidf_sql(
        """tk AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents),
    terms AS (SELECT id, unnest(w) AS term FROM tk UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM tk)""",
        5, 0.8,
    ),
)
def c20(spark, sf):
    return T.tfidf(docs(spark, sf), "respondent_id", T.word_terms(F.col("open_text")), min_df=5, max_df=0.8)


@query(
    "c21_tfidf_char",
    tfidf_sql(
        """tk AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w0 FROM documents), pd AS (SELECT id, ' ' || w0 || ' ' AS w FROM tk),
    sz AS (SELECT id, w, unnest([3, 4, 5]) AS n FROM pd),
    terms AS (SELECT id, unnest(list_transform(range(1, greatest(length(w) - n + 2, 1)), lambda i: substr(w, i, n))) AS term FROM sz)""",
        5, 0.8,
    ),
)
def c21(spark, sf):
    return T.tfidf(docs(spark, sf), "respondent_id", T.char_terms(F.col("open_text"), 3, 5), min_df=5, max_df=0.8)


@query(
    "c23_stitch_chain",
    f"""WITH t AS (SELECT conv_id, turn, role, {SQUASH.format(c='text')} AS s FROM conversations)
    SELECT conv_id AS respondent_id, CAST(turn // 500 AS INTEGER) AS block_no, string_agg('[' || role || '] ' || s, ' || ' ORDER BY turn) AS chain, count(*) AS n_fields
    FROM t WHERE s <> '' GROUP BY 1, 2""",
)
def c23(spark, sf):
    return T.stitch_chain(chain(spark, sf), "respondent_id", "turn", "role", "text")


@query(
    "c24_meaningful_segments",
    f"""WITH t AS (SELECT conv_id AS respondent_id, turn, role, {SQUASH.format(c='text')} AS answer FROM conversations),
    k AS (SELECT *, length(answer) + CASE WHEN role IN ('user') THEN 100 ELSE 0 END AS score FROM t WHERE length(answer) >= 3 AND NOT regexp_matches(answer, '^[0-9. /:-]+$')
      AND lower(answer) NOT IN ('nan', 'none', 'no', 'yes', 'male', 'female', 'english') AND length(regexp_replace(answer, '[^A-Za-z]', '', 'g')) >= 3),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY respondent_id ORDER BY score DESC, turn) AS INTEGER) AS rank FROM k)
    SELECT * FROM r WHERE rank <= 3""",
)
def c24(spark, sf):
    return T.meaningful_segments(chain(spark, sf), "respondent_id", "turn", "role", "text", 3, ("user",))


PROP_Q = {"segment": "What market segment are you in?", "priority": "Which of the following delivery priorities have you purchased?", "status": "What is the state of your largest order?"}


@query(
    "c25_propositions",
    f"""SELECT c_custkey AS respondent_id, 'segment' AS field, 'demographic' AS answer_type, 'My demographic: ' || c_mktsegment || '.' AS proposition FROM customer
    UNION ALL SELECT o_custkey, 'status', 'single_select', 'I claim regarding is the state of your largest order: ' || arg_max(o_orderstatus, {{'p': o_totalprice, 'k': o_orderkey}}) || '.' FROM orders GROUP BY o_custkey
    UNION ALL SELECT o_custkey, 'priority', 'multi_select', 'I purchased/installed in my home: ' || string_agg(p, ', ' ORDER BY p) || '.' FROM (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) GROUP BY o_custkey
    UNION ALL SELECT conv_id, 'turn' || turn, 'open_text', 'I said about this: "' || {SQUASH.format(c='text')} || '"' FROM conversations WHERE role = 'user'""",
)
def c25(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("respondent_id"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    seg = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("respondent_id"), F.lit("segment").alias("field"), F.lit("demographic").alias("answer_type"), F.lit(PROP_Q["segment"]).alias("question"), F.col("c_mktsegment").alias("value")
    )
    status = orders.groupBy("respondent_id").agg(F.max_by("o_orderstatus", F.struct("o_totalprice", "o_orderkey")).alias("value")).select(
        "respondent_id", F.lit("status").alias("field"), F.lit("single_select").alias("answer_type"), F.lit(PROP_Q["status"]).alias("question"), "value"
    )
    priority = orders.select("respondent_id", F.lit("priority").alias("field"), F.lit("multi_select").alias("answer_type"), F.lit(PROP_Q["priority"]).alias("question"), F.col("o_orderpriority").alias("value"))
    talk = chain(spark, sf).where("role = 'user'").select(
        "respondent_id", F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("field"), F.lit("open_text").alias("answer_type"), F.lit("?").alias("question"), F.col("text").alias("value")
    )
    answers = seg.unionByName(status).unionByName(priority).unionByName(talk)
    return T.propositions(answers, "respondent_id", "field", "answer_type", "question", "value")


@query(
    "c26_readability",
    f"""{TXT}, w AS (SELECT respondent_id, dataset_id, len({LW.format(c='s')}) AS n_words, greatest(len(regexp_extract_all(s, '[.!?]+')), 1) AS n_sentences,
      len(regexp_extract_all(t, '[aeiouyàâäéèêëíîïóôöúûüñ]+')) AS n_syl FROM t),
    r AS (SELECT *, round(0.39::DOUBLE * n_words / n_sentences + 11.8::DOUBLE * n_syl / greatest(n_words, 1) - 15.59::DOUBLE, 4) AS read_level FROM w)
    SELECT dataset_id, flag, count(*) AS n_rows, round(sum(read_level), 4) AS total_level FROM (SELECT *, CASE WHEN read_level >= 15 AND n_words <= 15 THEN 'very_high_for_short_text' WHEN read_level >= 17 THEN 'very_high'
      WHEN read_level < 2 AND n_words > 5 THEN 'very_low' ELSE 'normal' END AS flag FROM r) GROUP BY ALL""",
)
def c26(spark, sf):
    """The reading level comes with the data in practice; here it is derived with the grade formula."""
    s = X.squash(F.coalesce(F.col("open_text"), F.lit("")))
    d = docs(spark, sf).withColumn("s", s)
    d = d.select(
        "dataset_id",
        F.regexp_count("s", F.lit(X.LATIN_WORD)).alias("n_words"),
        F.greatest(F.regexp_count("s", F.lit(r"[.!?]+")), F.lit(1)).alias("n_sentences"),
        F.regexp_count(F.lower("s"), F.lit("[aeiouyàâäéèêëíîïóôöúûüñ]+")).alias("n_syl"),
    )
    level = F.round(0.39 * F.col("n_words") / F.col("n_sentences") + 11.8 * F.col("n_syl") / F.greatest(F.col("n_words"), F.lit(1)) - 15.59, 4)
    d = d.withColumn("read_level", level).withColumn("flag", T.readability_flag(F.col("read_level"), F.col("n_words")))
    return d.groupBy("dataset_id", "flag").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("read_level"), 4).alias("total_level"))


@query(
    "c27_compact_words",
    """SELECT doc_id AS respondent_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 3), ' ') AS normalized FROM documents""",
)
def c27(spark, sf):
    return docs(spark, sf).select("respondent_id", X.compact_words(F.col("open_text")).alias("normalized"))
