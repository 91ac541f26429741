"""Evidence, scores, tiers and decisions. Everything is one projection per respondent unless noted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from respondex.functions import lexicons as L
from respondex.functions import ranking as R
from respondex.functions import text as X

EMPTY = "array<string>"
#: Signals of a dictionary that share one long.
MASK_BITS = 63


def listed(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))


# --- criteria, weights, thresholds, evidence --------------------------------------------------------


@dataclass(frozen=True)
class Criterion:
    """One quality criterion: when it fires, what it looked at, and what its evidence is worth."""

    id: str
    family: str
    evidence_type: str  # transparent_deterministic or review_judgment
    condition: str  # SQL expression over the respondent row
    source: str
    observed: str  # SQL expression, text shown as evidence


def criteria_support(df: DataFrame, criteria: Sequence[Criterion]) -> DataFrame:
    """Rows on which each criterion fires: one pass over the data, one row per criterion out."""
    one = df.agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.sum(F.expr(f"CASE WHEN {c.condition} THEN 1 ELSE 0 END")).alias(f"n{i}") for i, c in enumerate(criteria)]
    )
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c.id).alias("criterion_id"), F.lit(c.family).alias("family"), F.lit(c.evidence_type).alias("evidence_type"), F.col(f"n{i}").alias("support_rows")) for i, c in enumerate(criteria)])
    return one.select("total_rows", F.explode(cells).alias("x")).select("x.*", "total_rows")


def generate_weights(support: DataFrame) -> DataFrame:
    """Base 10, +12 for deterministic or +6 for judgment evidence, +8 when rare, -4 when common, even; 0 without support."""
    share = F.col("support_rows") / F.greatest(F.col("total_rows"), F.lit(1))
    raw = (
        F.lit(10) + F.when(F.col("evidence_type") == "transparent_deterministic", 12).otherwise(6)
        + F.when(share <= 0.05, 8).when(share >= 0.20, -4).otherwise(0)
    )
    weight = F.when(F.col("support_rows") == 0, 0).otherwise(F.greatest(F.lit(1), (F.bround(raw / 2) * 2).cast("int"))).cast("int")
    reason = F.when(F.col("support_rows") == 0, "no observed support").otherwise(
        F.concat_ws("; ", F.lit("base weight"), F.when(F.col("evidence_type") == "transparent_deterministic", "deterministic evidence").otherwise("judgment evidence"), F.when(share <= 0.05, "rare").when(share >= 0.20, "common"))
    )
    return support.withColumn("support_rate", F.round(share, 4)).withColumn("weight", weight).withColumn("rationale", reason)


def generate_thresholds(weights: DataFrame) -> DataFrame:
    """Light review at the median weight, close review at 0.9 x the two largest; one row."""
    positive = weights.where("weight > 0").agg(F.array_sort(F.collect_list("weight")).alias("w"))  # one entry per criterion
    n = F.size("w")
    median = F.when(n > 0, (F.get("w", F.floor((n - 1) / 2).cast("int")) + F.get("w", F.floor(n / 2).cast("int"))) / 2)
    top_two = F.aggregate(F.slice("w", F.greatest(n - 1, F.lit(1)), F.lit(2)), F.lit(0), lambda a, b: a + b)
    out = positive.select(F.when(n == 0, 1).otherwise(F.greatest(F.lit(1), F.bround(median).cast("int"))).alias("light_min"), top_two.alias("_t"), n.alias("_n"))
    out = out.withColumn("review_min", F.when(F.col("_n") == 0, 2).otherwise(F.greatest(F.col("light_min") + 1, F.bround(F.col("_t") * 0.9).cast("int"))))
    return out.select("light_min", "review_min", F.greatest(F.col("review_min") + F.col("light_min"), F.col("review_min") + 1).alias("escalation_min"))


def evaluate_criteria(df: DataFrame, criteria: Sequence[Criterion], weights: DataFrame) -> DataFrame:
    """Adds ``evidence`` and ``points``. In every family only the first criterion that fires counts."""
    points = weights.agg(F.map_from_entries(F.collect_list(F.struct("criterion_id", "weight"))).alias("_weights"))  # one entry per criterion
    out = R.attach_row(df, points)
    seen: dict[str, Column] = {}
    items = []
    for c in criteria:
        fires = F.coalesce(F.expr(c.condition), F.lit(False))
        first = fires & ~seen.get(c.family, F.lit(False))
        seen[c.family] = seen.get(c.family, F.lit(False)) | fires
        items.append(
            F.when(first, F.struct(F.lit(c.id).alias("criterion_id"), F.lit(c.source).alias("source"), F.expr(c.observed).cast("string").alias("observed"), F.coalesce(F.element_at("_weights", F.lit(c.id)), F.lit(0)).alias("points")))
        )
    out = out.withColumn("evidence", F.array_compact(F.array(*items))).drop("_weights")
    return out.withColumn("points", F.aggregate("evidence", F.lit(0), lambda a, e: a + e["points"])).withColumn("evidence_ids", F.transform("evidence", lambda e: e["criterion_id"]))


def action_for_score(df: DataFrame, thresholds: DataFrame, points: str = "points") -> DataFrame:
    """Keep, Light review or Review closely by the generated limits (one row, attached to all)."""
    out = R.attach_row(df, thresholds)
    p = F.col(points)
    return out.withColumn("action", F.when(p < F.col("light_min"), "Keep").when(p < F.col("review_min"), "Light review").otherwise("Review closely")).drop("light_min", "review_min", "escalation_min")


def second_pass(ids: Column) -> Column:
    """Discard candidate only when independent families of evidence converge."""
    has = lambda *names: F.arrays_overlap(ids, F.array(*[F.lit(n) for n in names]))
    dup, straight = has("duplicate_text"), has("matrix_straightline")
    speed, effort = has("raw_fast"), has("low_effort_open_end")
    topic, authentic = has("topic_mismatch"), has("polished_text")
    decisive = (dup & (straight | speed | effort)) | (straight & effort) | (straight & speed) | (topic & authentic & (F.size(ids) >= 2))
    return F.when(decisive, "discard_candidate").when(F.size(ids) > 0, "keep_with_recommendation").otherwise("keep_no_issue")


# --- fixed values: tags of a criterion by a part of its name ----------------------------------------
TAG_RULES = (
    ("fast", ("timing", "speeding")),
    ("straightline", ("straightlining", "grid_quality")),
    ("duplicate", ("technical_duplicate", "possible_repeat_entry")),
    ("template", ("technical_duplicate",)),
    ("open_end", ("open_end_quality",)),
    ("topic", ("open_end_quality", "relevance")),
    ("effort", ("effort",)),
    ("polished", ("open_end_quality",)),
    ("brand", ("brand_consistency",)),
)


def tags_for(ids: Column) -> Column:
    per_id = F.transform(
        ids, lambda i: F.flatten(F.array(*[F.when(i.contains(part), F.array(*[F.lit(t) for t in tags])).otherwise(F.array().cast(EMPTY)) for part, tags in TAG_RULES]))
    )
    return F.array_sort(F.array_distinct(F.flatten(per_id)))


def recommendation(ids: Column) -> Column:
    has = lambda n: F.array_contains(ids, n)
    return (
        F.when(F.size(ids) == 0, "no recommendation")
        .when(has("matrix_straightline"), "shorten grids, vary and reverse items")
        .when(has("raw_fast"), "add page timers and attention checks")
        .when(has("topic_mismatch"), "ask for a concrete example in the open end")
        .when(has("low_effort_open_end"), "require substance and follow up vague answers")
        .otherwise("review the criterion family after more feedback")
    )


def owner(decision: Column) -> Column:
    return F.when(decision == "discard_candidate", "Data Quality Lead").otherwise("No escalation")


def evidence_table(df: DataFrame, id_col: str, weights: DataFrame) -> DataFrame:
    """One row per piece of evidence with the reason for its weight; a ``none`` row where there is none."""
    e = df.select(id_col, F.posexplode_outer("evidence").alias("position", "e"))
    flat = e.select(
        id_col, F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("e.criterion_id", F.lit("none")).alias("criterion_id"), "e.source", "e.observed", F.coalesce("e.points", F.lit(0)).alias("points")
    )
    # the catalogue has one row per criterion
    return flat.join(F.broadcast(weights.select("criterion_id", "rationale")), "criterion_id", "left")


def feedback_config(df: DataFrame, flags: str, kind: str, families: dict[str, tuple[str, str]]) -> DataFrame:
    """Under-escalated feedback rows per flag family and the change they ask for in the next run."""
    under = df.where(F.col(kind) == "under_escalated")
    t = F.lower(F.coalesce(F.col(flags), F.lit("")))
    one = under.agg(*[F.sum(t.rlike(p).cast("int")).alias(n) for n, (p, _) in families.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("family"), F.coalesce(F.col(n), F.lit(0)).alias("support_rows"), F.lit(change).alias("trial_change")) for n, (_, change) in families.items()])
    return one.select(F.explode(cells).alias("x")).select("x.*").where("support_rows > 0")


# --- convergence score -------------------------------------------------------------------------------


def convergence_score(df: DataFrame, matrix_prevalence: DataFrame) -> DataFrame:
    """-1 (clear discard) .. +1 (clear keep) from converging concerns and protective evidence, with reasons.

    ``matrix_prevalence`` is one row: the share of straightlined respondents. Above
    0.8 the signal separates nobody and only counts as a concern.
    """
    d = R.attach_row(df, matrix_prevalence)
    c = F.col
    gated = c("matrix_prevalence") > 0.8
    bad = c("is_discard_signal") == 1
    cls, band = c("oe_class"), c("timing_band")
    tier_free = (c("t1_count") == 0) & (c("t2_count") == 0)
    long_ok = ~bad & (cls != "empty")
    # (condition, change of score, concerns, reason)
    steps = [
        (c("t1_count") > 0, -0.5, 3, "tier 1 signal"),
        (c("t2_count") > 0, -0.2, 2, "tier 2 signal"),
        (bad & cls.isin("gibberish", "off_topic_incoherent"), -0.3, 2, "unusable open end"),
        (bad & cls.isin("third_person_meta", "generic_topic_restatement"), -0.25, 2, "open end describes the survey"),
        (bad & (cls == "templated_truncated"), -0.15, 1, "templated or truncated open end"),
        (bad & (cls == "generic_praise"), -0.2, 1, "generic praise"),
        (bad & (cls == "empty"), -0.15, 1, "empty open end"),
        (c("supplier_reject_rate") > 30, -0.1, 1, "high-risk supplier"),
        ((c("supplier_reject_rate") > 20) & (c("supplier_reject_rate") <= 30), -0.05, 1, None),
        (band == "bottom_10", -0.12, 1, "very fast"),
        (band == "bottom_25", -0.06, 1, None),
        (long_ok & (c("char_count") < 10), -0.1, 1, "very short open end"),
        (long_ok & (c("char_count") >= 10) & (c("char_count") < 30), -0.05, 0, None),
        ((c("f_matrix_uniform") == 1) & gated, 0.0, 1, None),
        ((c("f_matrix_uniform") == 1) & ~gated, -0.12, 1, "straightlining"),
        ((c("f_matrix_uniform") == 0) & (c("near_straightline") == 1) & ~gated, -0.04, 0, None),
        (c("answer_entropy") < 0.5, -0.1, 1, "very low answer entropy"),
        ((c("answer_entropy") >= 0.5) & (c("answer_entropy") < 1.0), -0.05, 0, None),
        (c("dup_count") > 10, -0.08, 1, "open end shared by many"),
        ((c("read_level") > 0) & (c("read_level") < 3) & (c("char_count") > 25), -0.06, 1, "very low readability"),
        (F.size("signals") >= 5, -0.08, 1, "high signal count"),
        (c("ml_score") > 0.7, -0.1, 1, "model flags high risk"),
        ((c("ml_score") > 0.5) & (c("ml_score") <= 0.7), -0.05, 0, None),
        (tier_free & (c("is_personal") == 1), 0.15, 0, "personal experience"),
        (tier_free & (c("char_count") > 100) & ~bad, 0.08, 0, "substantive open end"),
        (tier_free & (c("answer_entropy") > 2.5), 0.05, 0, None),
        (tier_free & (c("supplier_reject_rate") > 0) & (c("supplier_reject_rate") < 15), 0.05, 0, None),
        (tier_free & (band == "above_median"), 0.05, 0, None),
        (tier_free & (c("misspelled") == 1), 0.05, 0, "natural misspellings"),
    ]
    # one array of the steps that apply; score, concerns and reasons are read from it
    entries = [
        F.when(s[0], F.struct(F.lit(s[1]).alias("delta"), F.lit(s[2]).alias("concern"), F.lit(s[3]).cast("string").alias("reason"))) for s in steps
    ]
    out = d.withColumn("_fired", F.array_compact(F.array(*entries)))
    out = out.withColumn("concerns", F.aggregate("_fired", F.lit(0), lambda a, e: a + e["concern"])).withColumn(
        "_score", F.aggregate("_fired", F.lit(0.0), lambda a, e: a + e["delta"])
    ).withColumn("reasons", F.array_compact(F.transform("_fired", lambda e: e["reason"])))
    bonus = F.when(F.col("concerns") >= 4, -0.1).when(F.col("concerns") >= 3, -0.05).otherwise(0.0)
    out = out.withColumn("convergence_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("_score") + bonus)), 6))
    return out.withColumn("reasons", F.when(F.size("reasons") == 0, F.array(F.lit("clean profile"))).otherwise(F.col("reasons"))).drop("_score", "_fired", "matrix_prevalence")


def reassess(df: DataFrame) -> DataFrame:
    """Second reading of negative scores: tier 1 stays discarded, strong protection pulls back to review."""
    c = F.col
    protective = (
        (c("char_count") > 150).cast("int") + F.coalesce((c("answer_entropy") > 3.0).cast("int"), F.lit(0))
        + ((c("supplier_reject_rate") > 0) & (c("supplier_reject_rate") < 12)).cast("int") + ((c("timing_band") == "above_median") & (c("qtime") > 900)).cast("int")
    )
    s = c("convergence_score")
    out = df.withColumn("protective_count", F.coalesce(protective, F.lit(0)))
    p = c("protective_count")
    judgment = (
        F.when(s >= 0, "KEEP").when(c("t1_count") > 0, "DISCARD").when((s < -0.3) & (p >= 2), "REVIEW").when(s < -0.3, "DISCARD").otherwise("REVIEW")
    )
    final = F.when(s >= 0, s).when(c("t1_count") > 0, F.least(s, F.lit(-0.8))).when((s < -0.3) & (p >= 2), F.greatest(s, F.lit(-0.15))).otherwise(s)
    return out.withColumn("judgment", judgment).withColumn("final_score", final)


def key_signals(df: DataFrame) -> Column:
    c = F.col
    found = listed([
        ("tier 1 signal", c("t1_count") > 0),
        ("high-risk supplier", c("supplier_reject_rate") > 30),
        ("medium-risk supplier", (c("supplier_reject_rate") > 20) & (c("supplier_reject_rate") <= 30)),
        ("very fast", c("timing_band") == "bottom_10"),
        ("fast", c("timing_band") == "bottom_25"),
        ("very short open end", c("char_count") < 10),
        ("short open end", (c("char_count") >= 10) & (c("char_count") < 30)),
        ("straightlining", c("f_matrix_uniform") == 1),
        ("near straightlining", (c("f_matrix_uniform") == 0) & (c("near_straightline") == 1)),
        ("low answer entropy", c("answer_entropy") < 1.0),
        ("duplicate open end", c("dup_count") > 1),
        ("low readability", (c("read_level") > 0) & (c("read_level") < 5)),
        ("high signal count", F.size("signals") >= 5),
    ])
    return F.when(F.size(found) == 0, F.array(F.lit("no significant signals"))).otherwise(found)


# --- fixed values: weights of the semantic risk and of its guardrails, and the tier limits ------------
SEMANTIC_WEIGHTS = (1.15, 1.0, 0.9, 0.9, 0.85, 0.75, 0.7, 0.65)
GUARD_WEIGHTS = (0.9, 0.55, 0.45)
SEMANTIC_LIMITS = (2.4, 1.55, 0.85)


def semantic_risk(df: DataFrame, features: Sequence[Column], guards: Sequence[Column]) -> DataFrame:
    """Weighted 0/1 features minus guardrails, and a tier 1..5 that never sees the label."""
    zero = F.lit(0.0)
    risk = sum((f * w for f, w in zip(features, SEMANTIC_WEIGHTS)), zero) - sum((g * w for g, w in zip(guards, GUARD_WEIGHTS)), zero)
    out = df.withColumn("semantic_risk", F.round(F.greatest(risk, zero), 6))
    r = F.col("semantic_risk")
    protected = F.greatest(*guards) > 0
    hi, mid, lo = SEMANTIC_LIMITS
    return out.withColumn("blind_tier", F.when(r >= hi, 5).when(r >= mid, 4).when(r >= lo, 3).when(protected, 2).otherwise(1))


def tier_from_score(score: Column, threshold: Column) -> Column:
    """Tiers at 1, 0.8, 0.55 and 0.35 of the threshold."""
    return (
        F.when(score >= threshold, L.TIERS[4]).when(score >= threshold * 0.80, L.TIERS[3]).when(score >= threshold * 0.55, L.TIERS[2])
        .when(score >= threshold * 0.35, L.TIERS[1]).otherwise(L.TIERS[0])
    )


def quantile_tiers(df: DataFrame, score: str) -> DataFrame:
    """Tiers at the 45th, 70th, 85th and 95th percentile of all scores; no score means light review."""
    q = R.quantiles(df, [], score, {"_p45": 0.45, "_p70": 0.70, "_p85": 0.85, "_p95": 0.95}).drop("n_rows")
    s = F.col(score)
    tier = (
        F.when(s.isNull(), L.TIERS[2]).when(s >= F.col("_p95"), L.TIERS[4]).when(s >= F.col("_p85"), L.TIERS[3]).when(s >= F.col("_p70"), L.TIERS[2])
        .when(s >= F.col("_p45"), L.TIERS[1]).otherwise(L.TIERS[0])
    )
    return R.attach_row(df, q).withColumn("quantile_tier", tier).drop("_p45", "_p70", "_p85", "_p95")


def rule_determination(df: DataFrame) -> DataFrame:
    """Rule verdict and risk from signals; needs the triage columns."""
    c = F.col
    very_short = c("char_count") < 60
    review = ((c("f_matrix_uniform") == 1) & very_short) | ((c("f_duplicate_open") == 1) & (c("f_template_cluster") == 1)) | (F.size("signals") >= 5)
    risk = (
        0.3 * ((c("f_matrix_uniform") == 1) & very_short).cast("int") + 0.2 * ((c("f_duplicate_open") == 1) & (c("f_template_cluster") == 1)).cast("int")
        + 0.1 * (c("f_open_generic") == 1).cast("int") + 0.15 * F.coalesce((c("qtime_z") < -1.28).cast("int"), F.lit(0)) + 0.2 * (F.size("signals") >= 5).cast("int") + 0.15 * (c("t2_count") > 0).cast("int")
    )
    return df.withColumn("rule_determination", F.when(c("t1_count") > 0, "DISCARD").when(review, "REVIEW").otherwise("KEEP")).withColumn("rule_risk", F.round(risk, 6))


def combine_ml_rules(df: DataFrame, ml: str, threshold: float) -> DataFrame:
    """Model and rules agree -> high confidence; a blend of 0.6 model and 0.4 rules as combined risk."""
    s, rule = F.col(ml), F.col("rule_determination")
    hit = s >= threshold
    out = df.withColumn(
        "determination",
        F.when(rule == "DISCARD", "DISCARD").when(hit & (s > threshold + 0.1), "DISCARD").when(hit | (rule == "REVIEW"), "REVIEW").otherwise("KEEP"),
    )
    conf = F.when(rule == "DISCARD", "HIGH").when(hit | (rule == "REVIEW"), "MEDIUM").otherwise("LOW")
    return out.withColumn("confidence", conf).withColumn("combined_risk", F.round(s * 0.6 + F.col("rule_risk") * 0.4, 6))


def independent_audit(df: DataFrame, fast: float) -> DataFrame:
    """Risks from role, brand, narrative, speed and duplicates, and the action they suggest."""
    role, brand, narr = F.col("role_class"), F.col("brand_quality"), F.col("narrative_quality")
    risks = listed([
        ("role_fit_risk", role.isin("likely_non_trade", "non_cooperative")),
        ("role_calibration_needed", role.isin("ambiguous_role", "unclear_role")),
        ("brand_answer_risk", brand.isin("hostile_brand_answer", "weak_or_invalid_brand_list", "unknown_brand_quality")),
        ("narrative_discard_risk", narr.isin("non_cooperative", "nonsensical_or_repetitive")),
        ("narrative_quality_risk", narr.isin("generic_survey_feedback", "low_information", "unclear_product_answer")),
        ("speed_risk", F.coalesce(F.col("qtime") < fast, F.lit(False))),
        ("duplicate_ip_risk", F.col("duplicate_type") == "independent_duplicate_cluster"),
    ])
    out = df.withColumn("risk_factors", risks)
    has = lambda n: F.array_contains("risk_factors", n)
    clean = (
        role.isin("trade_relevant", "not_applicable_no_role_field")
        & brand.isin("has_valid_brand_or_tool_category", "unknown_possible_brand_only", "not_applicable_no_brand_list")
        & narr.isin("topic_relevant", "substantive_narrative", "not_applicable_no_narrative_field") & ~has("speed_risk") & ~has("duplicate_ip_risk")
    )
    discard = has("narrative_discard_risk") | (has("role_fit_risk") & (has("duplicate_ip_risk") | has("brand_answer_risk") | has("speed_risk"))) | (has("narrative_quality_risk") & has("speed_risk"))
    action = (
        F.when(clean, "keep_no_issue_from_independent_audit").when(discard, "review_for_possible_discard")
        .when(F.size("risk_factors") > 0, "review_or_pm_calibration").otherwise("keep_no_issue_from_independent_audit")
    )
    return out.withColumn("suggested_action", action)


def verify_full_chain(df: DataFrame) -> DataFrame:
    """Discard only with a semantic basis and without counterevidence in the whole chain."""
    c = F.col
    has = lambda n: F.array_contains("risk_factors", n)
    counter = listed([
        ("usable narrative", c("narrative_quality").isin("topic_relevant", "substantive_narrative")),
        ("concrete project or product answer", c("project_context") == 1),
        ("spirited answer with substance", (c("repeated_characters") == 1) & (c("enthusiastic") == 1) & (c("substantive_context") == 1)),
    ])
    out = df.withColumn("counterevidence", counter)
    alone = F.size("counterevidence") == 0
    weak = (c("weak_text") == 1) | (c("misplaced_text") == 1)
    basis = listed([
        ("hostile language", c("f_hostile") == 1),
        ("direct non-response", c("non_response") == 1),
        ("speed with weak narrative", weak & has("speed_risk") & alone),
        ("fast without meaningful narrative", has("speed_risk") & alone),
        ("repetitive narrative", (c("narrative_quality") == "nonsensical_or_repetitive") & alone),
        ("narrative discard risk", has("narrative_discard_risk") & alone),
        ("role fit invalid", has("role_fit_risk") & alone),
        ("duplicate with straightlining", (c("f_duplicate_open") == 1) & (c("f_matrix_uniform") == 1) & alone),
        ("straightlining with low effort", (c("f_matrix_uniform") == 1) & (c("f_open_generic") == 1) & alone),
    ])
    out = out.withColumn("discard_basis", basis)
    early = c("suggested_action") == "review_for_possible_discard"
    return out.withColumn("early_discard", early.cast("int")).withColumn("final_decision", F.when(F.size("discard_basis") > 0, "discard").otherwise("keep_with_review_note"))


FACTOR_TERMS = (
    "cost", "price", "quality", "fit", "function", "warranty", "strength", "durability", "comfort", "visibility", "service", "brand", "design", "safety", "security", "privacy", "easy", "convenience",
)  # fixed values: words that make a thin answer topic-adjacent


def review_theme(df: DataFrame) -> DataFrame:
    """Theme of a reviewed row, and the theme rewritten after the verdict of the verifier."""
    c = F.col
    has = lambda n: F.array_contains("risk_factors", n)
    narr = c("narrative_quality")
    usable = narr.isin("topic_relevant", "substantive_narrative")
    dup, straight, fast, low = c("f_duplicate_open") == 1, c("f_matrix_uniform") == 1, c("f_fast_complete") == 1, c("f_open_generic") == 1
    candidate = (
        F.when(narr == "nonsensical_or_repetitive", "repetitive or nonsensical narrative discard candidate")
        .when(has("narrative_quality_risk") & has("speed_risk"), "speed plus weak or evasive narrative discard candidate")
        .when(dup & straight, "independent duplicate cluster plus straightline discard candidate")
        .when(dup & fast, "independent duplicate cluster plus speed discard candidate")
        .when(straight, "straightline plus weak evidence discard candidate")
        .when(has("role_fit_risk"), "role-fit risk discard candidate")
        .when(has("brand_answer_risk"), "brand answer risk discard candidate")
        .when(has("duplicate_ip_risk"), "independent duplicate cluster discard candidate")
        .otherwise("non-cooperative or evasive narrative discard candidate")
    )
    kept = (
        F.when(fast & usable, "speed-only plausible narrative answer kept with note")
        .when(narr == "generic_survey_feedback", "generic survey-feedback narrative kept for calibration")
        .when(narr.isin("low_information", "unclear_product_answer") & (c("factor_terms") == 1), "thin but topic-adjacent narrative kept for calibration")
        .when(narr.isin("low_information", "unclear_product_answer"), "weak or unclear narrative kept for calibration")
        .when((c("f_survey_meta") == 1) & usable, "topic-adjacent keyword false positive on narrative text")
        .when(dup, "technical duplicate cluster kept for context")
        .when(low, "weak or unclear narrative kept for calibration")
        .otherwise("general review signal kept for calibration")
    )
    out = df.withColumn("review_theme", F.when(c("suggested_action") == "review_for_possible_discard", candidate).otherwise(kept))
    t = c("review_theme")
    verified = (
        F.when((c("final_decision") != "discard") & t.contains("discard candidate"), F.replace(t, F.lit("discard candidate"), F.lit("kept after critic verification")))
        .when(
            (c("final_decision") == "discard") & t.contains("kept"),
            F.when(t.contains("brand"), "required open-end non-response discard candidate").when(t.contains("speed"), "speed plus weak or evasive narrative discard candidate")
            .when(t.contains("survey-feedback"), "required narrative non-response discard candidate").when(t.contains("weak") | t.contains("unclear"), "non-cooperative or evasive narrative discard candidate")
            .otherwise("semantic discard candidate after full-chain verification"),
        )
        .otherwise(t)
    )
    return out.withColumn("verified_theme", verified)


def integrate_judgments(df: DataFrame, judgments: DataFrame, id_col: str, rule_score: str) -> DataFrame:
    """External judgment and score where there is one, else keep or review by the sign of the rule score."""
    j = judgments.select(id_col, F.col("agent_judgment").alias("_j"), F.col("agent_score").alias("_s"))
    out = df.join(j, id_col, "left")
    return out.withColumn("final_score", F.coalesce("_s", F.col(rule_score))).withColumn(
        "final_judgment", F.coalesce("_j", F.when(F.col(rule_score) >= 0, "KEEP").otherwise("REVIEW"))
    ).withColumn("judged_by", F.when(F.col("_s").isNotNull(), "agent").otherwise("rule")).drop("_j", "_s")


def majority_vote(ratings: DataFrame, id_col: str, vote: str, risk: str, disagree: float = 0.15) -> DataFrame:
    """Votes 0 keep, 1 review, 2 discard from any number of raters, in long form."""
    v = F.col(vote)
    std = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    rstd = F.coalesce(F.stddev_samp(risk), F.lit(0.0))
    out = ratings.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_raters"), F.sum(v).alias("vote_sum"), F.avg(v).alias("vote_mean"), F.max(v).alias("vote_max"), F.min(v).alias("vote_min"), std.alias("vote_std"),
        (F.sum((v >= 2).cast("int")) >= 2).cast("int").alias("majority_discard"), (F.sum((v <= 0).cast("int")) >= 2).cast("int").alias("majority_keep"),
        F.avg(risk).alias("avg_risk"), F.max(risk).alias("max_risk"), F.min(risk).alias("min_risk"), rstd.alias("risk_std"),
    )
    return out.withColumn("all_agree", (F.col("vote_max") == F.col("vote_min")).cast("int")).withColumn("confidence", 1 - F.col("vote_std") / 2).withColumn("risk_disagree", (F.col("risk_std") > disagree).cast("int"))


def review_priority(df: DataFrame) -> Column:
    """How likely a REVIEW row is a true discard."""
    c = F.col
    return (
        3.0 * c("t1_count") + 2.0 * c("t2_count") + 0.5 * c("t3_count")
        + F.when(c("supplier_reject_rate") >= 40, 2.0).when(c("supplier_reject_rate") >= 20, 1.0).otherwise(0.0)
        + F.when(c("timing_band") == "bottom_10", 1.0).when(c("timing_band") == "bottom_25", 0.5).otherwise(0.0)
        + 0.5 * c("weak_text") + F.when(F.size("signals") >= 6, 1.0).when(F.size("signals") >= 4, 0.5).otherwise(0.0)
    )


def discard_strength(df: DataFrame) -> Column:
    """How firm a DISCARD is; tier 1 is never weakened."""
    c = F.col
    weak = (
        10.0 + 2.0 * c("t2_count") - F.when((c("t2_count") == 0) & (c("t3_count") > 0), 3.0).otherwise(0.0) - F.when(c("supplier_reject_rate") < 10, 2.0).otherwise(0.0)
        - 1.0 + 0.5 * c("weak_text") - F.when(c("timing_band") == "above_median", 0.5).otherwise(0.0)
    )
    return F.when(c("t1_count") > 0, 10.0 + 1000.0).otherwise(weak)


def calibrate_to_rate(df: DataFrame, dataset: str, id_col: str, judgment: str, up: str, firm: str, target: float) -> DataFrame:
    """Move rows until each data set has ``round(n * target)`` discards.

    Too few: the REVIEW rows with the highest ``up`` become DISCARD. Too many: the
    DISCARD rows with the lowest ``firm`` become REVIEW. Ranks are taken without
    bringing a data set into one task.
    """
    sizes = df.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col(judgment) == "DISCARD").cast("int")).alias("_d")
    ).select(dataset, (F.bround(F.col("_n") * target).cast("long") - F.col("_d")).alias("_need"))
    key = F.when(F.col(judgment) == "REVIEW", -F.col(up)).when(F.col(judgment) == "DISCARD", F.col(firm))
    d = df.withColumn("_key", key)
    ranked = R.positions(d.where("_key IS NOT NULL").select(dataset, judgment, id_col, "_key"), [dataset, judgment], "_key", id_col, out="_pos").select(id_col, "_pos")
    out = R.attach_groups(d.join(ranked, id_col, "left"), sizes, [dataset], "inner")
    up_ = (F.col(judgment) == "REVIEW") & (F.col("_pos") <= F.col("_need"))
    down = (F.col(judgment) == "DISCARD") & (F.col("_pos") <= -F.col("_need"))
    return out.withColumn("calibrated_judgment", F.when(up_, "DISCARD").when(down, "REVIEW").otherwise(F.col(judgment))).withColumn(
        "calibration_change", F.when(up_, "upgraded").when(down, "downgraded").otherwise("unchanged")
    ).drop("_key", "_pos", "_need")


def cohort_thresholds(df: DataFrame, cohort: str, score: str, limits: dict[str, tuple[float, float]], default: tuple[float, float], overrides: Column, certain: float = 0.85) -> DataFrame:
    """Discard and review limits per cohort, hard overrides, and a score that always discards."""
    d, r = F.lit(default[0]), F.lit(default[1])
    for name, (dt, rt) in limits.items():
        d = F.when(F.col(cohort) == name, dt).otherwise(d)
        r = F.when(F.col(cohort) == name, rt).otherwise(r)
    s = F.col(score)
    return df.withColumn("cohort_judgment", F.when(overrides | (s >= certain) | (s >= d), "DISCARD").when(s >= r, "REVIEW").otherwise("KEEP"))


def combined_context(df: DataFrame, probability: str, risk: str, prior_tier: str, blind_tier: str) -> DataFrame:
    """0.65 x client probability + 0.35 x semantic risk (scaled by its maximum), and the routing tier.

    The client's prior may raise the routing tier; the blind tier itself stays as it is.
    """
    top = df.agg(F.greatest(F.max(risk), F.lit(1.0)).alias("_m"))
    p, b = F.col(prior_tier), F.col(blind_tier)
    tier = (
        F.when(p == L.TIERS[4], 5).when((p == L.TIERS[3]) | (b >= 4), 4).when((p == L.TIERS[2]) | (b == 3), 3).when((p == L.TIERS[1]) | (b == 2), 2).otherwise(1)
    )
    return R.attach_row(df, top).withColumn("combined_score", F.round(0.65 * F.coalesce(F.col(probability), F.lit(0.0)) + 0.35 * F.col(risk) / F.col("_m"), 6)).withColumn("routing_tier", tier).drop("_m")


def select_examples(df: DataFrame, dataset: str, id_col: str, best: Column, worst: Column, k: int) -> DataFrame:
    """The ``k`` best and the ``k`` worst rows of every data set; the rank limit cuts on the map side."""
    parts = []
    for name, s in (("best", best), ("worst", worst)):
        d = df.select(dataset, id_col, F.round(s, 6).alias("example_score"))
        w = W.partitionBy(dataset).orderBy(F.col("example_score").desc(), id_col)
        parts.append(d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("example_group", F.lit(name)))
    return parts[0].unionByName(parts[1])


# --- platform flags, rubric, packets, families, routing -----------------------------------------------

# fixed values: platform quality codes
QC_LABELS = {
    1: "Not select 3", 2: "State mismatch", 3: "Red Herring", 4: "REGION mismatch", 5: "AGE mismatch", 6: "RD /REVIEW rejection", 7: "OE screening",
    8: "RD /SEARCH threat rejection", 9: "RD /SEARCH duplicate rejection", 10: "RD /SEARCH country rejection", 11: "Speeder", 12: "Exceeded number of terms",
}


def platform_flags(qc: Column, terminated: Column, threat: Column, language: Column, dropped_out: Column) -> Column:
    """Readable summary of what the fielding platform reported."""
    label = None
    for code, name in QC_LABELS.items():
        label = F.when(qc == code, name) if label is None else label.when(qc == code, name)
    parts = F.concat_ws(
        " | ",
        F.when((qc != 0) & label.isNotNull(), F.concat(F.lit("QC FLAG: "), label)),
        F.when(terminated, "TERMINATED"),
        F.when(threat >= 25, F.concat(F.lit("threat="), threat.cast("string"), F.lit(" (ELEVATED)"))).when(threat >= 20, F.concat(F.lit("threat="), threat.cast("string"), F.lit(" (moderate)"))),
        F.when(~F.lower(language).isin("english", "en", "us"), F.concat(F.lit("language="), language)),
        F.when(dropped_out, "DROPPED OUT"),
    )
    return F.when(parts == "", "No platform signals triggered.").otherwise(parts)


def semantic_rubric(df: DataFrame, text: str, hard: dict[str, str], soft: dict[str, str], keep: dict[str, str], extra_soft: dict[str, Column] | None = None) -> DataFrame:
    """Hard, soft and keep signals read from the text, and the decision they lead to."""
    d = df.withColumn("_t", X.norm(F.col(text)))
    t = F.col("_t")
    d = d.withColumn("hard_signals", listed([(n, t.rlike(p)) for n, p in hard.items()]))
    d = d.withColumn("soft_signals", listed([(n, t.rlike(p)) for n, p in soft.items()] + list((extra_soft or {}).items())))
    d = d.withColumn("keep_signals", listed([(n, t.rlike(p)) for n, p in keep.items()])).drop("_t")
    h, s, k = F.size("hard_signals"), F.size("soft_signals"), F.size("keep_signals")
    d = d.withColumn("decision", F.when(h > 0, "discard").when(s >= 2, "discard").when((s == 1) & (k < 2), "review").otherwise("keep"))
    return d.withColumn(
        "confidence",
        F.when(h > 0, "high").when(s >= 2, "moderate").when((s == 1) & (k >= 2), "moderate").when(s == 1, "low").when(k > 0, "high").otherwise("moderate"),
    )


def review_packets(df: DataFrame, dataset: str, id_col: str, fields: Sequence[str], chunk: int) -> DataFrame:
    """One nested record per respondent and the number of the chunk it is reviewed in."""
    p = R.positions(df.select(dataset, id_col, *fields), [dataset], id_col, id_col, out="_pos")
    return p.select(dataset, F.ceil(F.col("_pos") / chunk).cast("int").alias("chunk"), id_col, F.struct(*fields).alias("packet"))


def family_convergence(df: DataFrame, families: Sequence[str], score: str, certain: Column, strong: float = 0.6, many: int = 4) -> DataFrame:
    """Discard: strong score with one family or more, or ``many`` families, or certain fraud."""
    fired = sum(F.col(f) for f in families)
    out = df.withColumn("families_fired", fired)
    hit = certain | ((F.col(score) >= strong) & (F.col("families_fired") >= 1)) | (F.col("families_fired") >= many)
    return out.withColumn("convergence_decision", F.when(hit, "DISCARD").when((F.col("families_fired") >= 2) | (F.col(score) >= strong), "REVIEW").otherwise("KEEP"))


def signal_profile(df: DataFrame, id_col: str, signals: Sequence[str]) -> DataFrame:
    """Present rate per signal and whether it may count towards discard."""
    long_ = df.select(id_col, *[F.col(f"f_{s}").alias(s) for s in signals]).unpivot([id_col], list(signals), "signal", "present")
    out = long_.groupBy("signal").agg(F.count(F.lit(1)).alias("n_assessed"), F.sum("present").alias("n_present"))
    rate = F.col("n_present") / F.col("n_assessed")
    return out.withColumn("present_rate", F.round(rate, 6)).withColumn("decision_weight", F.when(rate > 0.85, "context_only").when(rate < 0.01, "sparse").otherwise("counted"))


def unassessed(ids: DataFrame, assessed: DataFrame, id_col: str, dictionary: Sequence[str]) -> DataFrame:
    """(id, signal) pairs of the dictionary that nobody assessed; the pairs are built in the row.

    What was assessed is a set of bits per id, put together on the map side, so
    one narrow row of an id travels and no pair. Pairs come from rows that look
    small to the planner, so the join must not be a broadcast: the hint rules it out.
    """
    names = list(dict.fromkeys(dictionary))
    at = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("signal")).cast("int") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(MASK_BITS)))
    words = range(-(-len(names) // MASK_BITS))
    held = assessed.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        *[F.bit_or(F.when((at >= w * MASK_BITS) & (at < (w + 1) * MASK_BITS), bit)).alias(f"_m{w}") for w in words]
    )
    marked = ids.select(id_col).join(held.hint("merge"), F.col(id_col) == F.col("_id"), "left")

    def absent(signal: str) -> Column:
        w, i = divmod(names.index(signal), MASK_BITS)
        return F.when(F.coalesce(F.col(f"_m{w}"), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << i)) == 0, F.lit(signal))

    return marked.select(id_col, F.explode(F.array_compact(F.array(*[absent(s) for s in dictionary]))).alias("signal"))


def review_routing(df: DataFrame, judgment: str, score: str) -> DataFrame:
    j, s = F.col(judgment), F.col(score)
    cls = (
        F.when(j == "KEEP", "auto_keep_candidate").when(j == "DISCARD", "high_conf_discard_candidate").when(F.col("protective_score") >= 0.5, "targeted_second_read").otherwise("human_review")
    )
    priority = F.when(j == "KEEP", "low").when(j == "DISCARD", "urgent").when(s >= 0.5, "high").otherwise("medium")
    reason = F.when(j == "KEEP", "no_converging_signal").when(F.size("signals") == 0, "score_only").otherwise(F.get("signals", F.lit(0)))
    return df.withColumn("review_routing_class", cls).withColumn("review_priority", priority).withColumn("review_reason_code", reason)
