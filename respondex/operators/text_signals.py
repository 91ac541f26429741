"""Signals read from free text: metrics, classes, tags, grounding, chains and n-gram weights."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from respondex.config import SignalConfig
from respondex.functions import lexicons as L
from respondex.functions import text as X
from respondex.operators.term_weights import Terms, char_grams, weigh_terms, with_pairs
from respondex.session import ensure_checkpoint_dir


#: Answers whether a pattern, or any of several strings, occurs in a text; how many of some letters it has.
Find = Callable[[Column, "str | Sequence[str]"], Column]
Letters = Callable[[str], Column]

#: Characters of a respondent's answers that are compared in one task.
MOST_CHARS = 1 << 18
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
EMPTY_TALK_PATTERN = r"(^|[^a-z])(test|asdf|qwerty|n/?a|dont know|don't know|no idea|not sure)([^a-z]|$)"


def text_metrics(df: DataFrame, text: str, cfg: SignalConfig) -> DataFrame:
    """Characters, words, sentences, share of different words, generic and polished markers."""
    s = X.squash(F.coalesce(F.col(text), F.lit("")))
    n = F.lower(s)
    base = df.withColumn("_s", s).withColumn("_w", X.lower_words(s, X.LATIN_WORD))
    return base.select(
        *df.columns,
        F.length("_s").alias("char_count"),
        F.size("_w").alias("word_count"),
        (F.regexp_count("_s", F.lit(r"[.!?]+")) + (F.col("_s") != "").cast("int")).alias("sentence_count"),
        X.unique_ratio(F.col("_w")).alias("unique_token_ratio"),
        (n.rlike(cfg.generic_pattern) | (F.length(n) <= 2)).cast("int").alias("generic_placeholder"),
        n.rlike(cfg.polished_pattern).cast("int").alias("polished_marker"),
    )


def open_text_features(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Per respondent over all its text fields: sizes, diversity of words, weak-answer flags.

    Distinct words are counted from (respondent, word) pairs, so one respondent
    with millions of texts never has to fit into one array.
    """
    t = df.select(F.col(id_col), X.squash(F.coalesce(F.col(text), F.lit(""))).alias("t")).where("t <> ''")
    t = t.withColumn("low", F.lower("t")).withColumn("w", F.split(F.col("low"), " ")).withColumn("len", F.length("t"))
    none_words = ("none", "n/a", "na", "nothing", "no opinion", "no idea")
    good_words = ("good", "fine", "ok", "okay", "nice", "great")
    per_row = t.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("oe_count"),
        F.sum("len").alias("oe_total_chars"),
        F.max("len").alias("oe_max_chars"),
        F.min("len").alias("oe_min_chars"),
        F.avg("len").alias("oe_mean_chars"),
        F.stddev_pop("len").alias("oe_std_chars"),
        F.sum(F.size("w")).alias("oe_total_words"),
        F.max(F.size("w")).alias("oe_max_words"),
        F.max(X.contains_any(F.col("low"), none_words).cast("int")).alias("oe_has_none"),
        F.max(X.contains_any(F.col("low"), good_words).cast("int")).alias("_good"),
        F.max(((F.upper("t") == F.col("t")) & F.col("t").rlike(r"\p{L}") & (F.col("len") > 5)).cast("int")).alias("oe_all_caps"),
    )
    distinct_words = (
        t.select(id_col, F.explode("w").alias("word")).groupBy(id_col, "word").agg(F.lit(1).alias("one"))
        .groupBy(id_col).agg(F.count(F.lit(1)).alias("n_unique_words"))
    )
    out = per_row.join(distinct_words, id_col)
    return out.select(
        id_col, "oe_count", "oe_total_chars", "oe_max_chars", "oe_min_chars",
        F.round("oe_mean_chars", 6).alias("oe_mean_chars"),
        F.round("oe_std_chars", 6).alias("oe_std_chars"),
        F.round(F.try_divide(F.col("oe_std_chars"), F.col("oe_mean_chars")), 6).alias("oe_cv_chars"),
        (F.col("oe_max_chars") - F.col("oe_min_chars")).alias("oe_range_chars"),
        "oe_total_words", "oe_max_words",
        F.round(F.col("n_unique_words") / F.col("oe_total_words"), 6).alias("oe_lex_div"),
        "oe_has_none",
        ((F.col("_good") == 1) & (F.col("oe_max_words") <= 3)).cast("int").alias("oe_generic"),
        "oe_all_caps",
        (F.col("oe_max_chars") < 10).cast("int").alias("oe_very_short"),
        (F.col("oe_max_chars") < 30).cast("int").alias("oe_short"),
    )


def low_effort(c: Column) -> Column:
    """Placeholder word, one character repeated, up to three letters, or keyboard runs."""
    t = X.norm(c)
    return (t != "") & (
        t.isin(*L.LOW_EFFORT_WORDS)
        | t.rlike(r"^(.)\1{4,}$")
        | (t.rlike(r"^[a-z]{1,3}$") & ~t.isin(*L.SHORT_WORDS_ALLOWED))
        | X.contains_any(t, L.KEYBOARD_TOKENS)
    )


def placeholder(c: Column, cfg: SignalConfig) -> Column:
    return X.norm(c).rlike(cfg.placeholder_pattern)


def open_text_class(c: Column, topic_markers: Sequence[str] = L.TOPIC_MARKERS, find: Find = X.found, normed: bool = False, letters: Letters | None = None) -> Column:
    """One of ten classes; the first rule that holds wins.

    ``normed`` tells that ``c`` is normalised already; ``find`` and ``letters`` may
    know the answers from one reading of the text.
    """

    def classify(t: Column) -> Column:
        n_of = letters or (lambda some: F.length(t) - F.length(F.translate(t, some, "")))
        hard = X.let(n_of(VOWELS), lambda vowels: (vowels > 0) & (n_of(CONSONANTS) > 5 * vowels))
        mash = (F.length(t) > 10) & (hard | find(t, L.MASH_MARKERS))
        last = F.substring_index(t, " ", -1)
        cut = (F.length(t) > 30) & ~t.rlike(r"[.!?]$") & (
            ((F.length(last) <= 2) & ~last.isin("ed", "er", "ly", "ng"))
            | (X.starts_with_any(t, L.TEMPLATE_STARTS) & (F.length(t) < 100))
        )
        first_person = find(t, L.FIRST_PERSON_MARKERS)
        return (
            F.when(F.length(t) < 3, "empty")
            .when(mash, "gibberish")
            .when((F.length(t) < 40) & X.contains_any(t, L.PRAISE_MARKERS), "generic_praise")
            .when(find(t, L.THIRD_PERSON_MARKERS), "third_person_meta")
            .when(find(t, L.OFF_TOPIC_MARKERS), "off_topic_incoherent")
            .when((F.length(t) < 15) & X.contains_any(t, L.NON_ANSWER_MARKERS), "off_topic_incoherent")
            .when(cut, "templated_truncated")
            .when(first_person & find(t, L.EXPERIENCE_MARKERS), "first_person_personal")
            .when(~first_person & find(t, topic_markers), "generic_topic_restatement")
            .when(F.length(t) > 30, "substantive")
            .otherwise("short_neutral")
        )

    return X.let(c if normed else X.norm(c), classify)


def is_discard_class(text_class: Column) -> Column:
    return ~text_class.isin("first_person_personal", "substantive", "short_neutral")


# --- fixed values: closing-answer categories, their weight and the reason for it ---------------
OUTRO_WEIGHTS = {
    "direct_fit": ("low", "on-topic summary"),
    "adjacent_fit": ("low", "polished but grounded"),
    "wrong_universe": ("high", "coherent answer in the wrong domain"),
    "survey_meta_praise": ("moderate", "describes the survey experience"),
    "survey_meta_nonresponsive": ("moderate", "vague or nonresponsive"),
    "generic_filler_templated": ("moderate", "research-summary style without grounding"),
    "gibberish_nonenglish": ("high", "keyboard mash or other language"),
    "wrong_dimension": ("high", "answers a different question"),
    "blank": ("moderate", "missing closing answer"),
}

# --- fixed values: default patterns of the closing-answer categories, first match wins ---------
OUTRO_PATTERNS = (
    ("gibberish_nonenglish", r"bvnhgjut|vcgtr|bvhfyt|badanie dotyczące|filtrów do wody"),
    ("wrong_dimension", r"i bought one because|i obviously decided to get|i wanted a more cost effective solution"),
    ("wrong_universe", r"finance|banking|investment|whiskey|alcohol|eyeglass|dishwasher|aquarium|loyalty program|transportation"),
    ("survey_meta_nonresponsive", r"about stuff|none nothing|everything is good|about getting money"),
    ("survey_meta_praise", r"thank you so much|so amazing|great experience|i enjoy|nice survey|very interesting|i love this survey"),
)
OUTRO_TEMPLATED = r"the survey examined|the poll examined|the study aimed|the purpose of this study|in order to determine|interestingly|consumer research on"
OUTRO_PERSONAL = r"(^|[^a-z])my[^a-z].*(home|house|kitchen|bathroom|shower|tap|water|filter|family|kid|health)"


def outro_class(
    c: Column,
    patterns: Sequence[tuple[str, str]] = OUTRO_PATTERNS,
    templated: str = OUTRO_TEMPLATED,
    personal: str = OUTRO_PERSONAL,
) -> Column:
    def classify(t: Column) -> Column:
        rule = F.when(t == "", "blank")
        for name, pattern in patterns:
            rule = rule.when(t.rlike(pattern), name)
        hits = F.regexp_count(t, F.lit(templated))
        rule = rule.when((hits == 1) & t.rlike(personal), "adjacent_fit").when(hits >= 1, "generic_filler_templated")
        return rule.otherwise("direct_fit")

    return X.let(X.norm(c), classify)


def outro_weight(category: Column) -> Column:
    rule = None
    for name, (weight, _) in OUTRO_WEIGHTS.items():
        rule = F.when(category == name, weight) if rule is None else rule.when(category == name, weight)
    return rule.otherwise("low")


def pattern_tags(c: Column, patterns: dict[str, str] = L.TAG_PATTERNS) -> Column:
    """All tags that hold; a blank text has the tag ``blank`` only."""

    def tags(t: Column) -> Column:
        n_words = F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
        found = [F.when(F.length(t) < 5, "very_short")]
        found += [F.when(t.rlike(p), name) for name, p in patterns.items()]
        found += [F.when(n_words > 40, "long_text_40plus"), F.when(n_words <= 3, "very_few_words_3less")]
        return F.when(t == "", F.array(F.lit("blank"))).otherwise(F.array_compact(F.array(*found)))

    return X.let(X.norm(c), tags)


def language_flags(df: DataFrame, text: str, cfg: SignalConfig) -> DataFrame:
    t = X.norm(F.col(text))
    out = df.withColumn("_t", t)
    grounded, polished = F.col("_t").rlike(cfg.grounded_pattern), F.col("_t").rlike(cfg.polished_pattern)
    return out.select(
        *df.columns,
        F.col("_t").rlike(cfg.meta_pattern).cast("int").alias("survey_meta_language"),
        polished.cast("int").alias("polished"),
        (polished & ~grounded).cast("int").alias("polished_ungrounded"),
        grounded.cast("int").alias("personal_grounding"),
    )


def narrative_quality(c: Column, topic_pattern: str, find: Find = X.found, normed: bool = False, repeated: Column | None = None) -> Column:
    def classify(t: Column) -> Column:
        topic, factor = find(t, topic_pattern), find(t, L.SUBSTANTIVE_PATTERN)

        def with_words(w: Column) -> Column:
            n, u = F.size(w), F.size(F.array_distinct(w))
            thin = (n <= 2) | (u <= 2)
            return (
                F.when(topic, F.when(thin, "low_information").otherwise("topic_relevant"))
                .when(factor, F.when(thin, "low_information").otherwise("substantive_narrative"))
                .when((n <= 3) | (u <= 2), "low_information")
                .otherwise("unclear_product_answer")
            )

        return (
            F.when(t == "", "blank")
            .when(find(t, L.ABUSIVE_PATTERN) | t.rlike(f"^({L.NON_COOPERATIVE_PATTERN})$"), "non_cooperative")
            .when(X.repeated_phrase(t) if repeated is None else repeated, "nonsensical_or_repetitive")
            .when(find(t, L.FEEDBACK_NARRATIVE_PATTERN) & ~topic & ~factor, "generic_survey_feedback")
            .otherwise(X.let(X.lower_words(t, r"[a-z0-9']+"), with_words))
        )

    return X.let(c if normed else X.norm(c), classify)


def severe_weak(c: Column, context_pattern: str, find: Find = X.found, normed: bool = False) -> Column:
    """Empty, a non-response, or repetition without any context that would protect it."""

    def judge(t: Column) -> Column:
        protected = find(t, context_pattern) | find(t, L.PROJECT_PATTERN)
        substantive = find(t, L.SUBSTANTIVE_PATTERN)
        long_words = F.filter(X.words(t, r"[a-z0-9']+"), lambda w: F.length(w) > 2)
        repeats = X.let(long_words, lambda w: X.occurs_at_least(w, 3) & (F.size(F.array_distinct(w)) <= 3))
        weak = (
            find(t, EMPTY_TALK_PATTERN)
            | repeats
            | t.rlike(r"(.)\1{4,}")
        )
        return (t == "") | (~protected & (t.rlike(f"^({L.NON_RESPONSE_PATTERN})$") | (weak & ~substantive)))

    return X.let(c if normed else X.norm(c), judge)


def contact_details(t: Column) -> Column:
    """A mail or street address in a squashed text in lower case, in time that grows with its length only."""
    return (t.contains("@") & t.rlike(L.MAIL_PATTERN)) | t.rlike(L.STREET_PATTERN)


#: Seven words: texts with more than six are told apart without taking all their words.
SEVEN_WORDS = r"^(?:[^a-z0-9']*+[a-z0-9']++){7}"


def misplaced(c: Column, context_pattern: str, find: Find = X.found, normed: bool = False, contact: Column | None = None) -> Column:
    """Contact details, no words at all, or a few words that are mostly short or vowel-free."""

    def judge(t: Column) -> Column:
        protected = find(t, context_pattern) | find(t, L.SUBSTANTIVE_PATTERN) | find(t, L.PROJECT_PATTERN)

        def odd(w: Column) -> Column:
            n = F.size(w)
            short = F.size(F.filter(w, lambda x: F.length(x) <= 3))
            vowel = F.size(F.filter(w, lambda x: x.rlike("[aeiouy]")))
            return (n == 0) | (
                (n <= 6) & ((short >= F.greatest(F.lit(3), n - 1)) | (vowel <= F.greatest(F.lit(1), F.floor(n / 3).cast("int"))))
            )

        few = F.when(t.rlike(SEVEN_WORDS), F.lit(False)).otherwise(~protected & X.let(X.words(t, r"[a-z0-9']+"), odd))
        return (t == "") | few | (contact_details(t) if contact is None else contact)

    return X.let(c if normed else X.norm(c), judge)


def long_low_specificity(c: Column, cfg: SignalConfig) -> Column:
    return X.let(
        X.lower_words(c),
        lambda w: (F.size(w) >= cfg.long_words) & (X.unique_ratio(w) < cfg.low_unique_ratio),
    )


def role_class(c: Column, trade: str = L.TRADE_PATTERN, non_trade: str = L.NON_TRADE_PATTERN, maybe: str = L.MAYBE_TRADE_PATTERN) -> Column:
    t = X.norm(c)
    return (
        F.when(t == "", "missing_role")
        .when(t.rlike(L.ABUSIVE_PATTERN), "non_cooperative")
        .when(t.rlike(trade), "trade_relevant")
        .when(t.rlike(non_trade), "likely_non_trade")
        .when(t.rlike(maybe) | (F.size(F.split(t, " ")) <= 3), "ambiguous_role")
        .otherwise("unclear_role")
    )


def brand_token_class(c: Column, brands: str, categories: str, invalid: str = L.INVALID_BRAND_PATTERN) -> Column:
    t = X.norm(c)
    return (
        F.when(t == "", "blank")
        .when(t.rlike(L.ABUSIVE_PATTERN), "hostile_or_abusive")
        .when(t.rlike(invalid), "invalid_or_too_generic")
        .when(t.rlike(brands), "valid_brand_or_variant")
        .when(t.rlike(categories), "tool_category_not_brand")
        .when(F.length(t) <= 2, "too_short_unknown")
        .when(t.rlike(r"^[a-z ]{3,35}$"), "unknown_possible_brand")
        .otherwise("other_unknown")
    )


def brand_quality(df: DataFrame, id_col: str, token_class: str) -> DataFrame:
    """Verdict on a respondent's brand list from the classes of its entries."""
    c = F.col(token_class)

    def some(*names: str) -> Column:
        return F.max(c.isin(*names).cast("int")) == 1

    return df.groupBy(id_col).agg(
        F.sum((c != "blank").cast("int")).alias("n_brands"),
        F.when(F.sum((c != "blank").cast("int")) == 0, "missing_brand_list")
        .when(some("hostile_or_abusive"), "hostile_brand_answer")
        .when(some("valid_brand_or_variant", "tool_category_not_brand"), "has_valid_brand_or_tool_category")
        .when(some("unknown_possible_brand"), "unknown_possible_brand_only")
        .when(some("invalid_or_too_generic", "too_short_unknown"), "weak_or_invalid_brand_list")
        .otherwise("unknown_brand_quality")
        .alias("brand_quality"),
    )


def specificity(df: DataFrame, text: str, cfg: SignalConfig) -> DataFrame:
    """Domain words + numbers + up to five capitalised names + different words / 12."""
    s = X.squash(F.coalesce(F.col(text), F.lit("")))
    base = df.withColumn("_s", s).withColumn("_w", X.lower_words(s, X.LATIN_WORD))
    base = base.withColumn("_u", F.size(F.array_distinct("_w")))
    out = base.select(
        *df.columns,
        F.size("_w").alias("word_count"),
        X.hits_in(F.col("_w"), cfg.domain_terms).alias("domain_term_count") if cfg.domain_terms else F.lit(0).alias("domain_term_count"),
        F.regexp_count("_s", F.lit(r"[0-9]+")).alias("number_count"),
        F.regexp_count("_s", F.lit(r"[A-Z][A-Za-z0-9&]{2,}")).alias("capitalized_entity_count"),
        F.col("_u").alias("unique_words"),
    )
    return out.withColumn(
        "specificity_score",
        F.round(
            F.col("domain_term_count") + F.col("number_count") + F.least(F.col("capitalized_entity_count"), F.lit(5)) + F.col("unique_words") / 12,
            6,
        ),
    )


def grounding(df: DataFrame, text: str, domain: Sequence[str] = (), brands: Sequence[str] = ()) -> DataFrame:
    """Counts of anchors in time, place and senses, of the first person and of given vocabularies."""
    base = df.withColumn("_w", X.lower_words(F.col(text)))
    w = F.col("_w")

    def n(lex: Sequence[str]) -> Column:
        return X.hits_in(w, lex) if lex else F.lit(0)

    out = base.select(
        *df.columns,
        n(L.TEMPORAL_ANCHORS).alias("temporal_anchors"),
        n(L.LOCATION_ANCHORS).alias("locational_anchors"),
        n(L.SENSORY_ANCHORS).alias("sensory_anchors"),
        n(L.FIRST_PERSON_WORDS).alias("first_person_count"),
        n(tuple(domain)).alias("domain_mentions"),
        n(tuple(brands)).alias("brand_mentions"),
        F.round(F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)), 6).alias("oe_specificity"),
    )
    return out.withColumn("grounding_total", F.col("temporal_anchors") + F.col("locational_anchors") + F.col("sensory_anchors"))


def cross_answer_overlap(df: DataFrame, id_col: str, pos: str, text: str) -> DataFrame:
    """Mean over a respondent's answer pairs of shared words / words of the smaller answer.

    No pair is built. A word that occurs in answers with s1 <= s2 <= ... different
    words adds 1/s_k for every later answer, so counting answers per (word, size)
    and summing "answers after mine" / size gives the same total.
    """
    sized = df.select(id_col, pos, F.array_distinct(X.lower_words(F.col(text))).alias("w"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("len"))
    sized = sized.withColumn("size", F.size("w"))
    per_size = (
        sized.select(id_col, "size", F.explode("w").alias("word"))
        .groupBy(id_col, "word", "size").agg(F.count(F.lit(1)).alias("c"))
    )
    later = W.partitionBy(id_col, "word").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    shared = (
        per_size.withColumn("bigger", F.coalesce(F.sum("c").over(later), F.lit(0)))
        .groupBy(id_col)
        .agg(F.sum((F.col("c") * (F.col("c") - 1) / 2 + F.col("c") * F.col("bigger")) / F.col("size")).alias("total"))
    )
    sizes = sized.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_answers"), F.avg("len").alias("m"), F.stddev_pop("len").alias("sd")
    )
    n = F.col("n_answers")
    return sizes.join(shared, id_col, "left").select(
        id_col,
        "n_answers",
        F.round(F.coalesce(F.col("total"), F.lit(0.0)) / F.greatest(n * (n - 1) / 2, F.lit(1)), 6).alias("mean_overlap"),
        F.round(F.try_divide(F.col("sd"), F.col("m")), 6).alias("length_cv"),
    )


WINDOWS = (16, 4, 1)


def _winnowed(hashes: Column, width: int) -> Column:
    """The smallest hash of every window of ``width`` words, each once."""
    starts = F.sequence(F.lit(1), F.size(hashes) - (width - 1))
    least = hashes if width == 1 else F.transform(starts, lambda i: F.array_min(F.slice(hashes, i, width)))
    return F.when(F.size(hashes) >= width, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def copied_across_fields(df: DataFrame, id_col: str, pos: str, text: str, min_chars: int = 10, most_chars: int = MOST_CHARS) -> DataFrame:
    """Answers whose words appear again, whole or inside a longer answer of the same respondent.

    Answers meet once, by respondent, and a task searches each answer in the
    others of its respondent. Respondents of more than ``most_chars`` characters,
    and rows without an id, take ``_copied_by_joins``: their number is bounded by
    the size of the texts, and so is the list of them that is sent to the rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sizes = df.groupBy(F.col(id_col).alias("_big")).agg(F.sum(F.length(text)).alias("_chars"))
    big = sizes.where(F.col("_big").isNull() | (F.col("_chars") > most_chars)).select("_big").checkpoint()
    same = F.col(id_col).eqNullSafe(F.col("_big"))
    any_big = not big.isEmpty()
    t = (df.join(F.broadcast(big), same, "left_anti") if any_big else df).select(id_col, F.array_join(X.lower_words(F.col(text)), " ").alias("t")).where(F.length("t") > 0)
    kind = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(f"{c}_answers", T.LongType()) for c in ("n", "identical", "contained"))])
    out = t.repartition(id_col).sortWithinPartitions(id_col).mapInArrow(_copied_in_task(min_chars), kind)
    out = out.withColumn("copied", ((F.col("identical_answers") > 0) | (F.col("contained_answers") > 0)).cast("int"))
    return out.unionByName(_copied_by_joins(df.join(F.broadcast(big), same, "left_semi"), id_col, pos, text, min_chars)) if any_big else out


def _copied_answers(answers: Sequence[str], min_chars: int) -> tuple[int, int, int]:
    """Numbers of answers, of those that come more than once and of those that stand inside another one."""
    same = Counter(answers)
    identical = sum(n for t, n in same.items() if n > 1 and len(t) > 5)
    contained, at = 0, 0
    if len(same) > 1:
        whole = "\n".join(f" {t} " for t in same)  # no word holds a line break, so nothing is found across answers
        for t, n in same.items():
            if len(t) > min_chars and (whole.find(f" {t} ") != at or whole.find(f" {t} ", at + 1) >= 0):
                contained += n
            at += len(t) + 3
    return len(answers), identical, contained


def _copied_in_task(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``id, answer`` sorted by id to one row per id; a respondent may go over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def made(ids: pa.Array, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in zip(*found))], names=[id_col, "n_answers", "identical_answers", "contained_answers"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts, id_col = batch.column(0), batch.column(1).to_pylist(), batch.schema.names[0]
            codes = ids.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(texts)]
            found, starts = [], []
            for a, b in zip(cuts, cuts[1:]):
                if a == 0 and last is not None and last[0].equals(ids[0]):
                    held += texts[a:b]
                    continue
                if held:
                    yield made(pa.array([last[0].as_py()], ids.type), [_copied_answers(held, min_chars)])
                    held = []
                if b < len(texts):
                    starts.append(a)
                    found.append(_copied_answers(texts[a:b], min_chars))
                else:
                    held, last = texts[a:b], (ids[a],)
            if found:
                yield made(ids.take(pa.array(starts)), found)
        if held:
            yield made(pa.array([last[0].as_py()], last[0].type), [_copied_answers(held, min_chars)])

    return run


def _copied_by_joins(df: DataFrame, id_col: str, pos: str, text: str, min_chars: int) -> DataFrame:
    """The same for respondents of any size.

    Equal texts are counted, not paired. For the others, an answer names the
    smallest word hash of its first window of 16, 4 or 1 words, the widest that
    it fills; a longer answer names those of all its windows (winnowing). If it
    contains the short one, it contains that window, so both name the same hash.
    Only hashes and digests meet; texts are fetched for candidate pairs.
    """
    tokens = F.array_join(X.lower_words(F.col(text)), " ")
    t = df.select(id_col, pos, tokens.alias("t")).where(F.length("t") > 0)
    distinct = t.groupBy(id_col, F.md5("t").alias("k")).agg(F.count(F.lit(1)).alias("same"), F.any_value("t").alias("t"), F.max(F.length("t")).alias("chars")).checkpoint()
    marked = distinct.withColumn("h", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)))
    own = F.when(F.size("h") >= 16, 16).when(F.size("h") >= 4, 4).otherwise(1)
    short = marked.where(F.col("chars") > min_chars).select(id_col, F.col("k").alias("a"), F.col("chars").alias("ca"), own.alias("width"), F.array_min(F.slice("h", F.lit(1), own)).alias("mark"))
    marks = F.array(*[F.struct(F.lit(w).alias("width"), _winnowed(F.col("h"), w).alias("marks")) for w in WINDOWS])
    long_ = marked.select(id_col, F.col("k").alias("b"), F.col("chars").alias("cb"), F.explode(marks).alias("x")).select(id_col, "b", "cb", "x.width", F.explode("x.marks").alias("mark"))
    met = short.join(long_, [id_col, "width", "mark"]).where(F.col("cb") > F.col("ca")).select(id_col, "a", "b").distinct()
    texts = distinct.select(id_col, "k", F.concat(F.lit(" "), "t", F.lit(" ")).alias("t"))
    both = met.join(texts.withColumnRenamed("k", "a").withColumnRenamed("t", "ta"), [id_col, "a"]).join(texts.withColumnRenamed("k", "b").withColumnRenamed("t", "tb"), [id_col, "b"])
    inside = both.where(F.col("tb").contains(F.col("ta"))).select(id_col, F.col("a").alias("k"), F.lit(1).alias("contained")).distinct()
    return (
        distinct.join(inside, [id_col, "k"], "left")
        .groupBy(id_col)
        .agg(
            F.sum("same").alias("n_answers"),
            F.sum(F.when((F.col("same") > 1) & (F.col("chars") > 5), F.col("same")).otherwise(0)).alias("identical_answers"),
            F.sum(F.when(F.col("contained").isNotNull(), F.col("same")).otherwise(0)).alias("contained_answers"),
        )
        .withColumn("copied", ((F.col("identical_answers") > 0) | (F.col("contained_answers") > 0)).cast("int"))
    )


def topic_mismatch(c: Column, keywords: Sequence[str], min_words: int = 5) -> Column:
    t = X.norm(c)
    return (F.size(F.split(t, " ")) >= min_words) & ~X.contains_any(t, tuple(keywords))


def tfidf(df: DataFrame, id_col: str, terms: Column | Terms, min_df: int, max_df: float, max_features: int | None = None, digits: int | None = 6) -> DataFrame:
    """Exact TF-IDF: smooth idf, L2 norm per document, every term within the document frequencies.

    ``terms`` is an array column, or the terms that ``word_terms`` and
    ``char_terms`` make of words. ``max_features`` keeps the most frequent terms
    only, for models with a fixed number of inputs; by default all stay. Terms
    are counted where their text is read, see ``term_weights``.
    """
    return weigh_terms(df, id_col, terms, min_df, max_df, max_features, digits=digits)


def word_terms(c: Column, stop_words: Sequence[str] = ()) -> Terms:
    """Words of two letters or more, and their bigrams."""
    toks = X.lower_words(c, r"[\p{L}\p{N}_]{2,}")
    if stop_words:
        toks = F.filter(toks, lambda w: ~w.isin(*stop_words))
    return Terms(toks, X.let(toks, lambda t: F.concat(t, X.ngrams(t, 2))), with_pairs)


def char_terms(c: Column, lo: int, hi: int) -> Terms:
    """Character n-grams inside each word padded by one space on both sides."""

    def grams(word: Column) -> Column:
        parts = []
        for n in range(lo, hi + 1):
            parts.append(
                F.when(
                    F.length(word) >= n,
                    F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n))),
                ).otherwise(F.array().cast("array<string>"))
            )
        return F.concat(*parts)

    words = X.lower_words(c, r"[\p{L}\p{N}_]+")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return Terms(words, F.flatten(F.transform(padded, grams)), char_grams(lo, hi), 1 << 17)


def stitch_chain(df: DataFrame, id_col: str, pos: str, role: str, text: str, block: int = 500) -> DataFrame:
    """``[role] answer`` pieces in order, joined by `` || ``, in blocks of at most ``block`` positions.

    A normal respondent has one block. A respondent with a huge number of answers
    gets many rows instead of one unbounded string.
    """
    piece = F.concat(F.lit("["), F.col(role), F.lit("] "), X.squash(F.col(text)))
    return (
        df.where(X.squash(F.coalesce(F.col(text), F.lit(""))) != "")
        .groupBy(id_col, F.floor(F.col(pos) / block).cast("int").alias("block_no"))
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), piece.alias("s")))), lambda x: x["s"]), " || ").alias("chain"),
            F.count(F.lit(1)).alias("n_fields"),
        )
    )


def meaningful_segments(df: DataFrame, id_col: str, pos: str, role: str, text: str, k: int, bonus_roles: Sequence[str]) -> DataFrame:
    """The ``k`` segments per respondent that say most: length plus a bonus for telling roles."""
    s = X.squash(F.coalesce(F.col(text), F.lit("")))
    scored = df.select(id_col, pos, role, s.alias("answer")).where(
        (F.length("answer") >= 3)
        & ~F.col("answer").rlike(r"^[0-9. /:-]+$")
        & ~F.lower("answer").isin("nan", "none", "no", "yes", "male", "female", "english")
        & (F.length(F.regexp_replace("answer", "[^A-Za-z]", "")) >= 3)
    )
    scored = scored.withColumn("score", F.length("answer") + F.when(F.col(role).isin(*bonus_roles), 100).otherwise(0))
    w = W.partitionBy(id_col).orderBy(F.col("score").desc(), F.col(pos))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def subject_of(question: Column) -> Column:
    """Subject phrase of a question: lead-in and question marks removed."""
    t = F.regexp_replace(question, r"\[pipe:[^\]]*\]", "")
    t = F.regexp_replace(F.trim(t), r"(?i)^(which of the following |what |how |do you |are you |where |when |why |please |using the |for each )", "")
    t = F.lower(F.trim(F.regexp_replace(t, r"\?*$", "")))
    return F.when(t == "", "this").otherwise(t)


# --- fixed values: verb of a multi-select claim by a word of its question, first match wins ------
SELECT_VERBS = (
    (r"aware", "am aware of the following"),
    (r"purchased|bought", "purchased/installed in my home"),
    (r"interested|plan", "am interested in purchasing"),
    (r"research|source", "used the following research sources"),
    (r"concern", "am concerned about the following"),
    (r"information|get info", "would use the following for information"),
    (r"pay|willing", "am willing to pay for"),
)


def select_verb(question: Column) -> Column:
    q = F.lower(question)
    rule = None
    for pattern, verb in SELECT_VERBS:
        rule = F.when(q.rlike(pattern), verb) if rule is None else rule.when(q.rlike(pattern), verb)
    return rule.otherwise("selected")


def propositions(df: DataFrame, id_col: str, field: str, answer_type: str, question: str, value: str) -> DataFrame:
    """First-person claims: one per answer, one per multi-select question with all its different options."""
    single = df.where(F.col(answer_type) != "multi_select").select(
        id_col, F.col(field).alias("field"), F.col(answer_type).alias("answer_type"),
        F.when(F.col(answer_type) == "open_text", F.concat(F.lit("I said about "), subject_of(F.col(question)), F.lit(': "'), X.squash(F.col(value)), F.lit('"')))
        .when(F.col(answer_type) == "demographic", F.concat(F.lit("My demographic: "), F.col(value), F.lit(".")))
        .otherwise(F.concat(F.lit("I claim regarding "), subject_of(F.col(question)), F.lit(": "), F.col(value), F.lit(".")))
        .alias("proposition"),
    )
    options = df.where(F.col(answer_type) == "multi_select").groupBy(id_col, field, question, value).agg(F.lit(1).alias("one"))
    multi = options.groupBy(id_col, field, question).agg(F.array_sort(F.collect_list(value)).alias("items")).select(
        id_col, F.col(field).alias("field"), F.lit("multi_select").alias("answer_type"),
        F.concat(F.lit("I "), select_verb(F.col(question)), F.lit(": "), F.array_join("items", ", "), F.lit(".")).alias("proposition"),
    )
    return single.unionByName(multi)


def readability_flag(read_level: Column, n_words: Column) -> Column:
    return (
        F.when((read_level >= 15) & (n_words <= 15), "very_high_for_short_text")
        .when(read_level >= 17, "very_high")
        .when((read_level < 2) & (n_words > 5), "very_low")
        .otherwise("normal")
    )
