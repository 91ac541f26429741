"""The signal matrix of a respondent frame and the frozen risk score built on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from respondex.config import SignalConfig
from respondex.functions import ranking as R
from respondex.functions import text as X
from respondex.functions.scan import Reading, finder, plain, read_texts

#: What is between the words of ``X.WORD``.
NO_WORD = r"[^\p{L}\p{N}']+"

SIGNALS = (
    "duplicate_open", "template_cluster", "fast_complete", "open_generic", "low_specificity", "survey_meta", "polished",
    "matrix_uniform", "high_missing", "repeated_phrase", "hostile",
)
GUARDS = ("grounded", "specific_detail", "domain_rich")

FAMILIES = {
    "timing_cognitive_dynamics": ("fast_complete",),
    "open_end_semantics": ("open_generic", "low_specificity", "survey_meta", "polished", "hostile"),
    "duplicate_replay_coordination": ("duplicate_open", "template_cluster"),
    "matrix_behavior": ("matrix_uniform",),
    "routing_nonresponse": ("high_missing",),
    "text_repetition": ("repeated_phrase",),
}


def text_facts(df: DataFrame, id_col: str, text: str, cfg: SignalConfig) -> DataFrame:
    """What the signals need to know about a text, one narrow row per respondent.

    Runs on the text table alone, before any join, so no text is ever shuffled;
    equal texts and equal templates are compared by digest later.
    """
    searched = (cfg.meta_pattern, cfg.polished_pattern, cfg.hostile_pattern, cfg.grounded_pattern)
    reading = Reading(tuple(dict.fromkeys(p for p in searched if plain(p))), words=NO_WORD, lexicon=tuple(cfg.domain_terms), phrases=True)
    find = finder(reading, "_r")
    d = df.select(id_col, X.norm(F.col(text)).alias("_t"))
    d = read_texts(d, "_t", reading, "_r").withColumn("_sig", X.signature(F.col("_t")))
    t, n = F.col("_t"), F.col("_r.n_words")

    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("int"), F.lit(0))

    generic = (n > 0) & (t.rlike(cfg.generic_pattern) | (n <= cfg.low_words))
    ratio = F.when(n > 0, F.col("_r.n_distinct") / n).otherwise(F.lit(0.0))
    return d.select(
        id_col,
        n.alias("word_count"),
        F.length("_t").alias("char_count"),
        ratio.alias("unique_token_ratio"),
        F.when(F.length("_t") >= cfg.min_duplicate_chars, F.md5("_t")).alias("text_digest"),
        F.when(F.length("_sig") >= cfg.min_signature_chars, F.md5("_sig")).alias("template_digest"),
        flag(generic).alias("f_open_generic"),
        flag((n >= cfg.long_words) & (ratio < cfg.low_unique_ratio)).alias("f_low_specificity"),
        flag(find(t, cfg.meta_pattern)).alias("f_survey_meta"),
        flag(find(t, cfg.polished_pattern)).alias("f_polished"),
        flag(F.col("_r.repeated")).alias("f_repeated_phrase"),
        flag(find(t, cfg.hostile_pattern)).alias("f_hostile"),
        flag(find(t, cfg.grounded_pattern)).alias("g_grounded"),
        flag((n >= 8) & ~generic).alias("g_specific_detail"),
        flag(F.col("_r.n_lexicon") >= cfg.extra.get("domain_rich_hits", 4)).alias("g_domain_rich"),
    )


def signal_matrix(frame: DataFrame, cfg: SignalConfig) -> DataFrame:
    """One row per respondent: 0/1 signals ``f_*``, guards ``g_*`` and both as sets.

    ``frame`` has the text facts next to supplier, timing and grid columns.
    """

    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("int"), F.lit(0))

    blanks = [F.col("qtime").isNull(), F.col("n_items").isNull(), F.coalesce(F.col("supplier"), F.lit("")) == "", F.coalesce("char_count", F.lit(0)) == 0]
    missing = sum(b.cast("int") for b in blanks) / F.lit(float(len(blanks)))
    df = frame.withColumn("missing_rate", missing)
    df = df.withColumn("f_fast_complete", flag(F.col("qtime") < cfg.fast_seconds)).withColumn("f_high_missing", flag(F.col("missing_rate") > cfg.high_missing))
    df = df.withColumn("f_matrix_uniform", flag((F.col("n_items") >= cfg.matrix_min_items) & (F.col("modal_share") >= cfg.matrix_modal_share)))
    df = R.with_group_stats(df, ["text_digest"], "respondent_id", _dn=F.count(F.lit(1)))
    df = R.with_group_stats(df, ["template_digest"], "respondent_id", _sn=F.count(F.lit(1)))
    df = df.withColumn("dup_count", F.when(F.col("text_digest").isNull(), F.lit(0)).otherwise(F.col("_dn")))
    df = df.withColumn("f_duplicate_open", (F.col("dup_count") >= 2).cast("int"))
    df = df.withColumn("f_template_cluster", flag(F.col("template_digest").isNotNull() & (F.col("_sn") >= 2))).drop("template_digest", "_dn", "_sn")
    return df.withColumn("signals", F.array_compact(F.array(*[F.when(F.col(f"f_{s}") == 1, s) for s in SIGNALS]))).withColumn(
        "guards", F.array_compact(F.array(*[F.when(F.col(f"g_{g}") == 1, g) for g in GUARDS]))
    )


# --- fixed values: weights of the frozen risk score and its three denominators --------------------
@dataclass(frozen=True)
class RiskWeights:
    template: float = 1.1
    fast_generic: float = 1.0
    missing_polished: float = 0.9
    uniform_weak: float = 0.8
    missing_no_open: float = 0.65
    generic: float = 0.45
    specific: float = 0.55
    short_valid: float = 0.30
    client_scale: float = 3.4
    authenticity_scale: float = 3.8
    attention_scale: float = 2.2


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def frozen_risk(sig: DataFrame, w: RiskWeights = RiskWeights()) -> DataFrame:
    """Client, authenticity and attention probabilities, protection, uncertainty and tier."""
    f = {s: F.col(f"f_{s}") for s in SIGNALS}
    wc = F.col("word_count")
    no_open = (wc == 0).cast("int")
    specific = F.col("g_specific_detail")
    short_valid = ((wc > 0) & (wc <= 6) & (f["open_generic"] == 0)).cast("int")
    both = lambda a, b: a * b  # noqa: E731  0/1 flags
    weak = F.greatest(f["open_generic"], no_open)
    raw = F.greatest(
        F.lit(0.0),
        w.template * f["template_cluster"]
        + w.fast_generic * both(f["fast_complete"], f["open_generic"])
        + w.missing_polished * both(f["high_missing"], f["polished"])
        + w.uniform_weak * both(f["matrix_uniform"], weak)
        + w.missing_no_open * both(f["high_missing"], no_open)
        + w.generic * f["open_generic"]
        - w.specific * specific
        - w.short_valid * short_valid,
    )
    out = sig.withColumn("risk_raw", raw)
    r = F.col("risk_raw")
    client = clip(r / w.client_scale, 0.02, 0.98)
    authenticity = clip((r + 0.4 * f["template_cluster"] + 0.3 * both(f["fast_complete"], f["polished"])) / w.authenticity_scale, 0.02, 0.98)
    attention = clip(
        (0.6 * f["high_missing"] + 0.5 * f["matrix_uniform"] + 0.4 * f["fast_complete"] + 0.35 * f["open_generic"]) / w.attention_scale, 0.02, 0.98
    )
    protective = clip(0.5 * specific + 0.25 * short_valid + 0.25 * (F.col("missing_rate") < 0.5).cast("int"), 0.0, 1.0)
    uncertainty = clip(0.2 + 0.35 * no_open + 0.25 * (F.col("missing_rate") > 0.65).cast("int") + 0.2 * F.col("qtime").isNull().cast("int"), 0.05, 1.0)
    out = out.select(
        *sig.columns, "risk_raw",
        F.round(client, 6).alias("client_reject_probability"),
        F.round(authenticity, 6).alias("authenticity_risk_probability"),
        F.round(attention, 6).alias("attention_or_validity_risk"),
        F.round(protective, 6).alias("protective_score"),
        F.round(uncertainty, 6).alias("model_uncertainty"),
    )
    return out.withColumn("operational_tier", risk_tier(F.col("client_reject_probability"), F.col("protective_score")))


def risk_tier(p: Column, protective: Column) -> Column:
    return (
        F.when(p >= 0.75, "Exclude candidate").when(p >= 0.55, "Review closely").when(p >= 0.30, "Light review")
        .when((p >= 0.15) | (protective > 0), "Keep with note").otherwise("Clean keep")
    )


def tier_number(tier: Column) -> Column:
    return (
        F.when(tier == "Exclude candidate", 5).when(tier == "Review closely", 4).when(tier == "Light review", 3)
        .when(tier == "Keep with note", 2).otherwise(1)
    )


def evaluation_score(scored: DataFrame) -> DataFrame:
    """A score with many values: the client probability blended with lack of word variety."""
    s = 0.65 * F.col("client_reject_probability") + 0.35 * F.least(F.lit(1.0), 1 - F.col("unique_token_ratio"))
    return scored.withColumn("score", F.round(s, 6))
