"""Queries over scores, tiers and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.functions import lexicons as L
from respondex.operators import lift as D
from respondex.operators import scoring as S
from respondex.operators import signals as G
from respondex.plans.catalog import query
from respondex.plans.study import SCORED, STUDY, TRIAGE, client_labels, norm_sql, q, respondents, scored_frame, triage_frame
from respondex.sources.stages import stage
from respondex.sources.tables import table

FLAGS = ", ".join([f"f_{s}" for s in G.SIGNALS] + [f"g_{g}" for g in G.GUARDS])


@query(
    "r10_frozen_risk_score",
    f"""WITH {SCORED} SELECT respondent_id, dataset_id, word_count, round(unique_token_ratio, 6) AS unique_token_ratio, round(missing_rate, 6) AS missing_rate, dup_count, {FLAGS}, round(risk_raw, 6) AS risk_raw,
    client_reject_probability, authenticity_risk_probability, attention_or_validity_risk, protective_score, model_uncertainty, operational_tier,
    array_to_string(signals, '|') AS signals, array_to_string(guards, '|') AS guards, score FROM scored""",
)
def r10(spark, sf):
    s = scored_frame(spark, sf)
    return s.select(
        "respondent_id", "dataset_id", "word_count", F.round("unique_token_ratio", 6).alias("unique_token_ratio"), F.round("missing_rate", 6).alias("missing_rate"),
        "dup_count", *[c.strip() for c in FLAGS.split(",")], F.round("risk_raw", 6).alias("risk_raw"), "client_reject_probability", "authenticity_risk_probability",
        "attention_or_validity_risk", "protective_score", "model_uncertainty", "operational_tier",
        F.array_join("signals", "|").alias("signals"), F.array_join("guards", "|").alias("guards"), "score",
    )


# --- criteria and evidence ------------------------------------------------------------------------------

CRITERIA = (
    S.Criterion("raw_fast", "qtime", "transparent_deterministic", "f_fast_complete = 1", "qtime", "round(qtime, 0)"),
    S.Criterion("matrix_straightline", "straightline", "transparent_deterministic", "f_matrix_uniform = 1", "flag_grid", "n_items"),
    S.Criterion("duplicate_text", "duplicate", "transparent_deterministic", "f_duplicate_open = 1", "open_text", "dup_count"),
    S.Criterion("template_text", "duplicate", "transparent_deterministic", "f_template_cluster = 1", "open_text", "'template'"),
    S.Criterion("low_effort_open_end", "open_end_effort", "transparent_deterministic", "f_open_generic = 1", "open_text", "word_count"),
    S.Criterion("polished_text", "open_end_authenticity", "review_judgment", "f_polished = 1", "open_text", "'polished'"),
    S.Criterion("topic_mismatch", "topic_relevance", "review_judgment", "f_survey_meta = 1", "open_text", "'meta'"),
    S.Criterion("repeated_phrase", "repetition", "review_judgment", "f_repeated_phrase = 1", "open_text", "word_count"),
    S.Criterion("long_answer_chain", "length", "review_judgment", "word_count > 100000", "open_text", "word_count"),
)
WEIGHTS = "tot AS (SELECT count(*) AS n FROM scored), sup AS (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c.id}' AS criterion_id, '{c.family}' AS family, '{c.evidence_type}' AS evidence_type, (SELECT count(*) FROM scored WHERE {c.condition}) AS support_rows" for i, c in enumerate(CRITERIA)
) + """), wt AS (SELECT sup.*, n AS total_rows, round(support_rows / n::DOUBLE, 4) AS support_rate, CASE WHEN support_rows = 0 THEN 0 ELSE CAST(10 + CASE WHEN evidence_type = 'transparent_deterministic' THEN 12 ELSE 6 END
   + CASE WHEN support_rows / n::DOUBLE <= 0.05 THEN 8 WHEN support_rows / n::DOUBLE >= 0.20 THEN -4 ELSE 0 END AS INTEGER) END AS weight FROM sup, tot),
  th0 AS (SELECT greatest(1, CAST(round_even(median(weight), 0) AS INTEGER)) AS light_min, (SELECT sum(weight) FROM (SELECT weight FROM wt WHERE weight > 0 ORDER BY weight DESC LIMIT 2)) AS t2 FROM wt WHERE weight > 0),
  th AS (SELECT light_min, greatest(light_min + 1, CAST(round_even(t2 * 0.9::DOUBLE, 0) AS INTEGER)) AS review_min FROM th0),
  fired AS (""" + " UNION ALL ".join(
    f"SELECT respondent_id, {i} AS pos, '{c.id}' AS criterion_id, '{c.family}' AS family, '{c.source}' AS source, CAST({c.observed} AS VARCHAR) AS observed FROM scored WHERE {c.condition}" for i, c in enumerate(CRITERIA)
) + """), ev AS (SELECT f.*, w.weight AS points FROM (SELECT *, min(pos) OVER (PARTITION BY respondent_id, family) AS mp FROM fired) f JOIN wt w USING (criterion_id) WHERE f.pos = mp),
  agg AS (SELECT s.respondent_id, CAST(coalesce(sum(points), 0) AS INTEGER) AS points, coalesce(list(criterion_id ORDER BY ev.pos) FILTER (criterion_id IS NOT NULL), []) AS ids FROM scored s LEFT JOIN ev USING (respondent_id) GROUP BY 1)"""
HAS = lambda n: f"list_contains(ids, '{n}')"
SECOND = f"""CASE WHEN ({HAS('duplicate_text')} AND ({HAS('matrix_straightline')} OR {HAS('raw_fast')} OR {HAS('low_effort_open_end')})) OR ({HAS('matrix_straightline')} AND {HAS('low_effort_open_end')})
  OR ({HAS('matrix_straightline')} AND {HAS('raw_fast')}) OR ({HAS('topic_mismatch')} AND {HAS('polished_text')} AND len(ids) >= 2) THEN 'discard_candidate' WHEN len(ids) > 0 THEN 'keep_with_recommendation' ELSE 'keep_no_issue' END"""


def weights(spark, sf):
    return S.generate_weights(S.criteria_support(scored_frame(spark, sf), CRITERIA))


def evidence(spark, sf):
    return S.evaluate_criteria(scored_frame(spark, sf), CRITERIA, weights(spark, sf))


@query("r01_generate_weights", f"WITH {SCORED}, {WEIGHTS} SELECT criterion_id, support_rows, support_rate, weight FROM wt")
def r01(spark, sf):
    return weights(spark, sf).select("criterion_id", "support_rows", "support_rate", "weight")


@query("r02_generate_thresholds", f"WITH {SCORED}, {WEIGHTS} SELECT light_min, review_min, greatest(review_min + light_min, review_min + 1) AS escalation_min FROM th")
def r02(spark, sf):
    return S.generate_thresholds(weights(spark, sf))


@query("r03_evaluate_criteria", f"WITH {SCORED}, {WEIGHTS} SELECT agg.respondent_id, agg.points, coalesce(string_agg(criterion_id || '=' || ev.points || '(' || observed || ')', '; ' ORDER BY ev.pos), '') AS evidence FROM agg LEFT JOIN ev USING (respondent_id) GROUP BY 1, 2")
def r03(spark, sf):
    shown = F.transform("evidence", lambda e: F.concat(e["criterion_id"], F.lit("="), e["points"].cast("string"), F.lit("("), e["observed"], F.lit(")")))
    return evidence(spark, sf).select("respondent_id", "points", F.array_join(shown, "; ").alias("evidence"))


@query("r04_action_for_score", f"WITH {SCORED}, {WEIGHTS} SELECT respondent_id, points, CASE WHEN points < light_min THEN 'Keep' WHEN points < review_min THEN 'Light review' ELSE 'Review closely' END AS action FROM agg, th")
def r04(spark, sf):
    return S.action_for_score(evidence(spark, sf), S.generate_thresholds(weights(spark, sf))).select("respondent_id", "points", "action")


@query("r05_second_pass_disposition", f"WITH {SCORED}, {WEIGHTS} SELECT respondent_id, array_to_string(ids, ',') AS evidence_ids, {SECOND} AS second_pass_decision FROM agg")
def r05(spark, sf):
    e = evidence(spark, sf)
    return e.select("respondent_id", F.array_join("evidence_ids", ",").alias("evidence_ids"), S.second_pass(F.col("evidence_ids")).alias("second_pass_decision"))


TAGS_SQL = "list_sort(list_distinct(flatten(list_transform(ids, lambda i: flatten([" + ", ".join(
    f"CASE WHEN contains(i, '{part}') THEN {list(tags)} ELSE [] END" for part, tags in S.TAG_RULES
) + "])))))"


@query(
    "r06_tags_and_recommendation",
    f"""WITH {SCORED}, {WEIGHTS} SELECT respondent_id, coalesce(array_to_string({TAGS_SQL}, ','), '') AS tags, CASE WHEN len(ids) = 0 THEN 'no recommendation' WHEN {HAS('matrix_straightline')} THEN 'shorten grids, vary and reverse items' WHEN {HAS('raw_fast')} THEN 'add page timers and attention checks'
    WHEN {HAS('topic_mismatch')} THEN 'ask for a concrete example in the open end' WHEN {HAS('low_effort_open_end')} THEN 'require substance and follow up vague answers' ELSE 'review the criterion family after more feedback' END AS recommendation,
    CASE WHEN {SECOND} = 'discard_candidate' THEN 'Data Quality Lead' ELSE 'No escalation' END AS owner FROM agg""",
)
def r06(spark, sf):
    ids = F.col("evidence_ids")
    return evidence(spark, sf).select("respondent_id", F.array_join(S.tags_for(ids), ",").alias("tags"), S.recommendation(ids).alias("recommendation"), S.owner(S.second_pass(ids)).alias("owner"))


# --- convergence ------------------------------------------------------------------------------------------

_bad = "is_discard_signal = 1"
_free = "t1_count = 0 AND t2_count = 0"
_gate = "(SELECT avg(f_matrix_uniform) FROM triage) > 0.8"
STEPS_SQL = (
    ("t1_count > 0", -0.5, 3, "tier 1 signal"), ("t2_count > 0", -0.2, 2, "tier 2 signal"),
    (f"{_bad} AND oe_class IN ('gibberish', 'off_topic_incoherent')", -0.3, 2, "unusable open end"), (f"{_bad} AND oe_class IN ('third_person_meta', 'generic_topic_restatement')", -0.25, 2, "open end describes the survey"),
    (f"{_bad} AND oe_class = 'templated_truncated'", -0.15, 1, "templated or truncated open end"), (f"{_bad} AND oe_class = 'generic_praise'", -0.2, 1, "generic praise"), (f"{_bad} AND oe_class = 'empty'", -0.15, 1, "empty open end"),
    ("supplier_reject_rate > 30", -0.1, 1, "high-risk supplier"), ("supplier_reject_rate > 20 AND supplier_reject_rate <= 30", -0.05, 1, None), ("timing_band = 'bottom_10'", -0.12, 1, "very fast"), ("timing_band = 'bottom_25'", -0.06, 1, None),
    (f"NOT ({_bad}) AND oe_class <> 'empty' AND char_count < 10", -0.1, 1, "very short open end"), (f"NOT ({_bad}) AND oe_class <> 'empty' AND char_count >= 10 AND char_count < 30", -0.05, 0, None),
    (f"f_matrix_uniform = 1 AND {_gate}", 0.0, 1, None), (f"f_matrix_uniform = 1 AND NOT {_gate}", -0.12, 1, "straightlining"), (f"f_matrix_uniform = 0 AND near_straightline = 1 AND NOT {_gate}", -0.04, 0, None),
    ("answer_entropy < 0.5", -0.1, 1, "very low answer entropy"), ("answer_entropy >= 0.5 AND answer_entropy < 1.0", -0.05, 0, None), ("dup_count > 10", -0.08, 1, "open end shared by many"),
    ("read_level > 0 AND read_level < 3 AND char_count > 25", -0.06, 1, "very low readability"), ("len(signals) >= 5", -0.08, 1, "high signal count"), ("ml_score > 0.7", -0.1, 1, "model flags high risk"), ("ml_score > 0.5 AND ml_score <= 0.7", -0.05, 0, None),
    (f"{_free} AND is_personal = 1", 0.15, 0, "personal experience"), (f"{_free} AND char_count > 100 AND NOT ({_bad})", 0.08, 0, "substantive open end"), (f"{_free} AND answer_entropy > 2.5", 0.05, 0, None),
    (f"{_free} AND supplier_reject_rate > 0 AND supplier_reject_rate < 15", 0.05, 0, None), (f"{_free} AND timing_band = 'above_median'", 0.05, 0, None), (f"{_free} AND misspelled = 1", 0.05, 0, "natural misspellings"),
)
CONV = f"""{TRIAGE}, cv0 AS MATERIALIZED (SELECT *, {' + '.join(f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for c, v, _, _ in STEPS_SQL)} AS sc, {' + '.join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, _, n, _ in STEPS_SQL if n)} AS concerns,
  list_filter([{', '.join(f"CASE WHEN {c} THEN '{r}' END" for c, _, _, r in STEPS_SQL if r)}], lambda x: x IS NOT NULL) AS rs FROM triage),
  cv AS (SELECT *, round(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, sc + CASE WHEN concerns >= 4 THEN -0.1::DOUBLE WHEN concerns >= 3 THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS convergence_score, CASE WHEN len(rs) = 0 THEN ['clean profile'] ELSE rs END AS reasons FROM cv0),
  pa AS (SELECT *, CAST(char_count > 150 AS INTEGER) + CAST(answer_entropy > 3 AS INTEGER) + CAST(supplier_reject_rate > 0 AND supplier_reject_rate < 12 AS INTEGER) + CAST(coalesce(timing_band = 'above_median' AND qtime > 900, false) AS INTEGER) AS protective_count FROM cv),
  ra AS MATERIALIZED (SELECT *, CASE WHEN convergence_score >= 0 THEN 'KEEP' WHEN t1_count > 0 THEN 'DISCARD' WHEN convergence_score < -0.3 AND protective_count >= 2 THEN 'REVIEW' WHEN convergence_score < -0.3 THEN 'DISCARD' ELSE 'REVIEW' END AS judgment,
    CASE WHEN convergence_score >= 0 THEN convergence_score WHEN t1_count > 0 THEN least(convergence_score, -0.8::DOUBLE) WHEN convergence_score < -0.3 AND protective_count >= 2 THEN greatest(convergence_score, -0.15::DOUBLE) ELSE convergence_score END AS final_score FROM pa)"""


def converged(spark, sf):
    t = triage_frame(spark, sf)
    return S.convergence_score(t, t.agg(F.avg("f_matrix_uniform").alias("matrix_prevalence")))


def reassessed(spark, sf):
    """The judged respondents: a stage table, because several decisions start from it."""
    return stage(spark, sf, "judged", lambda: S.reassess(converged(spark, sf)))


@query("r07_convergence_score", f"WITH {CONV} SELECT respondent_id, concerns, convergence_score, array_to_string(reasons, '; ') AS reasons FROM cv")
def r07(spark, sf):
    return converged(spark, sf).select("respondent_id", "concerns", "convergence_score", F.array_join("reasons", "; ").alias("reasons"))


@query("r08_reassess", f"WITH {CONV} SELECT respondent_id, protective_count, judgment, final_score FROM ra")
def r08(spark, sf):
    return reassessed(spark, sf).select("respondent_id", "protective_count", "judgment", "final_score")


KEY_SQL = (
    ("tier 1 signal", "t1_count > 0"), ("high-risk supplier", "supplier_reject_rate > 30"), ("medium-risk supplier", "supplier_reject_rate > 20 AND supplier_reject_rate <= 30"), ("very fast", "timing_band = 'bottom_10'"), ("fast", "timing_band = 'bottom_25'"),
    ("very short open end", "char_count < 10"), ("short open end", "char_count >= 10 AND char_count < 30"), ("straightlining", "f_matrix_uniform = 1"), ("near straightlining", "f_matrix_uniform = 0 AND near_straightline = 1"), ("low answer entropy", "answer_entropy < 1"),
    ("duplicate open end", "dup_count > 1"), ("low readability", "read_level > 0 AND read_level < 5"), ("high signal count", "len(signals) >= 5"),
)


def list_sql(rules) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + "], lambda x: x IS NOT NULL)"


@query("r09_key_signals", f"WITH {TRIAGE} SELECT respondent_id, CASE WHEN len({list_sql(KEY_SQL)}) = 0 THEN 'no significant signals' ELSE array_to_string({list_sql(KEY_SQL)}, '; ') END AS key_signals FROM triage")
def r09(spark, sf):
    t = triage_frame(spark, sf)
    return t.select("respondent_id", F.array_join(S.key_signals(t), "; ").alias("key_signals"))


SEM_FEATURES = ("f_hostile", "f_survey_meta", "f_open_generic", "f_template_cluster", "f_fast_complete * (1 - g_domain_rich)", "f_polished", "f_matrix_uniform", "f_low_specificity")
SEM_GUARDS = ("g_grounded", "CAST(word_count <= 8 AND g_domain_rich = 0 AND word_count > 0 AS INTEGER)", "g_domain_rich")
SEM = f"""{SCORED}, sm0 AS (SELECT *, round(greatest({' + '.join(f'{w}::DOUBLE * ({f})' for f, w in zip(SEM_FEATURES, S.SEMANTIC_WEIGHTS))} - {' - '.join(f'{w}::DOUBLE * ({g})' for g, w in zip(SEM_GUARDS, S.GUARD_WEIGHTS))}, 0.0::DOUBLE), 6) AS semantic_risk, greatest({', '.join(SEM_GUARDS)}) AS prot FROM scored),
  sm AS (SELECT *, CASE WHEN semantic_risk >= 2.4 THEN 5 WHEN semantic_risk >= 1.55 THEN 4 WHEN semantic_risk >= 0.85 THEN 3 WHEN prot > 0 THEN 2 ELSE 1 END AS blind_tier FROM sm0)"""


def semantic(spark, sf):
    return S.semantic_risk(scored_frame(spark, sf), [F.expr(f) for f in SEM_FEATURES], [F.expr(g) for g in SEM_GUARDS])


@query("r11_semantic_risk_tier", f"WITH {SEM} SELECT respondent_id, semantic_risk, blind_tier FROM sm")
def r11(spark, sf):
    return semantic(spark, sf).select("respondent_id", "semantic_risk", "blind_tier")


@query("r12_tier_from_score", f"WITH {SCORED} SELECT respondent_id, CASE WHEN score >= 0.5 THEN 'Exclude candidate' WHEN score >= 0.5::DOUBLE * 0.8::DOUBLE THEN 'Review closely' WHEN score >= 0.5::DOUBLE * 0.55::DOUBLE THEN 'Light review' WHEN score >= 0.5::DOUBLE * 0.35::DOUBLE THEN 'Keep with note' ELSE 'Clean keep' END AS tier FROM scored")
def r12(spark, sf):
    return scored_frame(spark, sf).select("respondent_id", S.tier_from_score(F.col("score"), F.lit(0.5)).alias("tier"))


@query(
    "r13_quantile_tiers",
    f"""WITH {SCORED}, c AS (SELECT quantile_cont(score, 0.45) AS p45, quantile_cont(score, 0.7) AS p70, quantile_cont(score, 0.85) AS p85, quantile_cont(score, 0.95) AS p95 FROM scored)
    SELECT respondent_id, CASE WHEN score >= p95 THEN 'Exclude candidate' WHEN score >= p85 THEN 'Review closely' WHEN score >= p70 THEN 'Light review' WHEN score >= p45 THEN 'Keep with note' ELSE 'Clean keep' END AS quantile_tier FROM scored, c""",
)
def r13(spark, sf):
    return S.quantile_tiers(scored_frame(spark, sf).select("respondent_id", "score"), "score").select("respondent_id", "quantile_tier")


RULEDET = f"""{TRIAGE}, rd AS (SELECT *, CASE WHEN t1_count > 0 THEN 'DISCARD' WHEN (f_matrix_uniform = 1 AND char_count < 60) OR (f_duplicate_open = 1 AND f_template_cluster = 1) OR len(signals) >= 5 THEN 'REVIEW' ELSE 'KEEP' END AS rule_determination,
  round(0.3::DOUBLE * CAST(f_matrix_uniform = 1 AND char_count < 60 AS INTEGER) + 0.2::DOUBLE * CAST(f_duplicate_open = 1 AND f_template_cluster = 1 AS INTEGER) + 0.1::DOUBLE * f_open_generic + 0.15::DOUBLE * CAST(coalesce(qtime_z < -1.28, false) AS INTEGER) + 0.2::DOUBLE * CAST(len(signals) >= 5 AS INTEGER) + 0.15::DOUBLE * CAST(t2_count > 0 AS INTEGER), 6) AS rule_risk FROM triage)"""


@query(
    "r14_combine_ml_rules",
    f"""WITH {RULEDET} SELECT respondent_id, rule_determination, rule_risk, CASE WHEN rule_determination = 'DISCARD' THEN 'DISCARD' WHEN ml_score >= 0.3 AND ml_score > 0.3::DOUBLE + 0.1::DOUBLE THEN 'DISCARD' WHEN ml_score >= 0.3 OR rule_determination = 'REVIEW' THEN 'REVIEW' ELSE 'KEEP' END AS determination,
    CASE WHEN rule_determination = 'DISCARD' THEN 'HIGH' WHEN ml_score >= 0.3 OR rule_determination = 'REVIEW' THEN 'MEDIUM' ELSE 'LOW' END AS confidence, round(ml_score * 0.6::DOUBLE + rule_risk * 0.4::DOUBLE, 6) AS combined_risk FROM rd""",
)
def r14(spark, sf):
    out = S.combine_ml_rules(S.rule_determination(triage_frame(spark, sf)), "ml_score", 0.3)
    return out.select("respondent_id", "rule_determination", "rule_risk", "determination", "confidence", "combined_risk")


RISK_SQL = (
    ("role_fit_risk", "role_class IN ('likely_non_trade', 'non_cooperative')"), ("role_calibration_needed", "role_class IN ('ambiguous_role', 'unclear_role')"), ("brand_answer_risk", "brand_quality IN ('hostile_brand_answer', 'weak_or_invalid_brand_list', 'unknown_brand_quality')"),
    ("narrative_discard_risk", "narrative_quality IN ('non_cooperative', 'nonsensical_or_repetitive')"), ("narrative_quality_risk", "narrative_quality IN ('generic_survey_feedback', 'low_information', 'unclear_product_answer')"),
    ("speed_risk", f"qtime < {STUDY.fast_seconds}"), ("duplicate_ip_risk", "duplicate_type = 'independent_duplicate_cluster'"),
)
RK = lambda n: f"list_contains(rf, '{n}')"
AUDIT = f"""{TRIAGE}, au0 AS MATERIALIZED (SELECT *, {list_sql(RISK_SQL)} AS rf FROM triage), au AS MATERIALIZED (SELECT *, CASE WHEN role_class = 'trade_relevant' AND brand_quality IN ('has_valid_brand_or_tool_category', 'unknown_possible_brand_only') AND narrative_quality IN ('topic_relevant', 'substantive_narrative') AND NOT {RK('speed_risk')} AND NOT {RK('duplicate_ip_risk')} THEN 'keep_no_issue_from_independent_audit'
  WHEN {RK('narrative_discard_risk')} OR ({RK('role_fit_risk')} AND ({RK('duplicate_ip_risk')} OR {RK('brand_answer_risk')} OR {RK('speed_risk')})) OR ({RK('narrative_quality_risk')} AND {RK('speed_risk')}) THEN 'review_for_possible_discard' WHEN len(rf) > 0 THEN 'review_or_pm_calibration' ELSE 'keep_no_issue_from_independent_audit' END AS suggested_action FROM au0),
  ct AS MATERIALIZED (SELECT *, {list_sql((('usable narrative', "narrative_quality IN ('topic_relevant', 'substantive_narrative')"), ('concrete project or product answer', 'project_context = 1'), ('spirited answer with substance', 'repeated_characters = 1 AND enthusiastic = 1 AND substantive_context = 1')))} AS ce FROM au),
  vf0 AS MATERIALIZED (SELECT *, {list_sql((('hostile language', 'f_hostile = 1'), ('direct non-response', 'non_response = 1'), ('speed with weak narrative', f"(weak_text = 1 OR misplaced_text = 1) AND {RK('speed_risk')} AND len(ce) = 0"), ('fast without meaningful narrative', f"{RK('speed_risk')} AND len(ce) = 0"),
    ('repetitive narrative', "narrative_quality = 'nonsensical_or_repetitive' AND len(ce) = 0"), ('narrative discard risk', f"{RK('narrative_discard_risk')} AND len(ce) = 0"), ('role fit invalid', f"{RK('role_fit_risk')} AND len(ce) = 0"), ('duplicate with straightlining', 'f_duplicate_open = 1 AND f_matrix_uniform = 1 AND len(ce) = 0'), ('straightlining with low effort', 'f_matrix_uniform = 1 AND f_open_generic = 1 AND len(ce) = 0')))} AS db FROM ct),
  vf AS MATERIALIZED (SELECT *, CASE WHEN len(db) > 0 THEN 'discard' ELSE 'keep_with_review_note' END AS final_decision FROM vf0)"""


def audited(spark, sf):
    return S.independent_audit(triage_frame(spark, sf), STUDY.fast_seconds)


@query("r15_independent_audit_action", f"WITH {AUDIT} SELECT respondent_id, coalesce(array_to_string(rf, '; '), '') AS risk_factors, suggested_action FROM au")
def r15(spark, sf):
    return audited(spark, sf).select("respondent_id", F.array_join("risk_factors", "; ").alias("risk_factors"), "suggested_action")


@query("r16_verify_full_chain", f"WITH {AUDIT} SELECT respondent_id, array_to_string(ce, '; ') AS counterevidence, array_to_string(db, '; ') AS discard_basis, CAST(suggested_action = 'review_for_possible_discard' AS INTEGER) AS early_discard, final_decision FROM vf")
def r16(spark, sf):
    v = S.verify_full_chain(audited(spark, sf))
    return v.select("respondent_id", F.array_join("counterevidence", "; ").alias("counterevidence"), F.array_join("discard_basis", "; ").alias("discard_basis"), "early_discard", "final_decision")


THEME = f"""{AUDIT}, tm AS MATERIALIZED (SELECT *, CASE WHEN suggested_action = 'review_for_possible_discard' THEN CASE WHEN narrative_quality = 'nonsensical_or_repetitive' THEN 'repetitive or nonsensical narrative discard candidate' WHEN {RK('narrative_quality_risk')} AND {RK('speed_risk')} THEN 'speed plus weak or evasive narrative discard candidate'
    WHEN f_duplicate_open = 1 AND f_matrix_uniform = 1 THEN 'independent duplicate cluster plus straightline discard candidate' WHEN f_duplicate_open = 1 AND f_fast_complete = 1 THEN 'independent duplicate cluster plus speed discard candidate' WHEN f_matrix_uniform = 1 THEN 'straightline plus weak evidence discard candidate'
    WHEN {RK('role_fit_risk')} THEN 'role-fit risk discard candidate' WHEN {RK('brand_answer_risk')} THEN 'brand answer risk discard candidate' WHEN {RK('duplicate_ip_risk')} THEN 'independent duplicate cluster discard candidate' ELSE 'non-cooperative or evasive narrative discard candidate' END
  ELSE CASE WHEN f_fast_complete = 1 AND narrative_quality IN ('topic_relevant', 'substantive_narrative') THEN 'speed-only plausible narrative answer kept with note' WHEN narrative_quality = 'generic_survey_feedback' THEN 'generic survey-feedback narrative kept for calibration'
    WHEN narrative_quality IN ('low_information', 'unclear_product_answer') AND factor_terms = 1 THEN 'thin but topic-adjacent narrative kept for calibration' WHEN narrative_quality IN ('low_information', 'unclear_product_answer') THEN 'weak or unclear narrative kept for calibration'
    WHEN f_survey_meta = 1 AND narrative_quality IN ('topic_relevant', 'substantive_narrative') THEN 'topic-adjacent keyword false positive on narrative text' WHEN f_duplicate_open = 1 THEN 'technical duplicate cluster kept for context' WHEN f_open_generic = 1 THEN 'weak or unclear narrative kept for calibration' ELSE 'general review signal kept for calibration' END END AS theme FROM vf)"""


@query(
    "r17_review_theme",
    f"""WITH {THEME} SELECT respondent_id, theme AS review_theme, CASE WHEN final_decision <> 'discard' AND contains(theme, 'discard candidate') THEN replace(theme, 'discard candidate', 'kept after critic verification')
    WHEN final_decision = 'discard' AND contains(theme, 'kept') THEN CASE WHEN contains(theme, 'brand') THEN 'required open-end non-response discard candidate' WHEN contains(theme, 'speed') THEN 'speed plus weak or evasive narrative discard candidate' WHEN contains(theme, 'survey-feedback') THEN 'required narrative non-response discard candidate'
      WHEN contains(theme, 'weak') OR contains(theme, 'unclear') THEN 'non-cooperative or evasive narrative discard candidate' ELSE 'semantic discard candidate after full-chain verification' END ELSE theme END AS verified_theme FROM tm""",
)
def r17(spark, sf):
    return S.review_theme(S.verify_full_chain(audited(spark, sf))).select("respondent_id", "review_theme", "verified_theme")


@query(
    "r18_integrate_judgments",
    f"""WITH {CONV} SELECT respondent_id, CASE WHEN toxic IS NOT NULL THEN CASE WHEN toxic = 1 THEN -0.9::DOUBLE ELSE 0.6::DOUBLE END ELSE convergence_score END AS final_score,
    CASE WHEN toxic = 1 THEN 'DISCARD' WHEN toxic = 0 THEN 'KEEP' WHEN convergence_score >= 0 THEN 'KEEP' ELSE 'REVIEW' END AS final_judgment, CASE WHEN toxic IS NOT NULL THEN 'agent' ELSE 'rule' END AS judged_by FROM cv""",
)
def r18(spark, sf):
    external = client_labels(spark, sf).select(
        "respondent_id", F.when(F.col("toxic") == 1, "DISCARD").otherwise("KEEP").alias("agent_judgment"), F.when(F.col("toxic") == 1, -0.9).otherwise(0.6).alias("agent_score")
    )
    c = converged(spark, sf).select("respondent_id", "convergence_score")
    return S.integrate_judgments(c, external, "respondent_id", "convergence_score").select("respondent_id", "final_score", "final_judgment", "judged_by")


@query(
    "r19_majority_vote",
    f"""WITH {SCORED}, l AS (SELECT respondent_id, CASE WHEN tier_n >= 5 THEN 2 WHEN tier_n >= 3 THEN 1 ELSE 0 END AS v, client_reject_probability AS r FROM scored WHERE rejected IS NOT NULL UNION ALL SELECT respondent_id, rejected * 2, rejected::DOUBLE FROM scored WHERE rejected IS NOT NULL UNION ALL SELECT respondent_id, toxic * 2, 0.5::DOUBLE * toxic FROM scored WHERE rejected IS NOT NULL),
    g AS (SELECT respondent_id, count(*) AS n_raters, CAST(sum(v) AS BIGINT) AS vote_sum, avg(v) AS vm, max(v) AS vote_max, min(v) AS vote_min, coalesce(stddev_samp(v), 0) AS vs, CAST(count(*) FILTER (v >= 2) >= 2 AS INTEGER) AS majority_discard, CAST(count(*) FILTER (v <= 0) >= 2 AS INTEGER) AS majority_keep, avg(r) AS ar, max(r) AS max_risk, min(r) AS min_risk, coalesce(stddev_samp(r), 0) AS rs FROM l GROUP BY 1)
    SELECT respondent_id, n_raters, vote_sum, round(vm, 6) AS vote_mean, vote_max, vote_min, round(vs, 6) AS vote_std, majority_discard, majority_keep, round(ar, 6) AS avg_risk, max_risk, min_risk, round(rs, 6) AS risk_std, CAST(vote_max = vote_min AS INTEGER) AS all_agree, round(1 - vs / 2, 6) AS confidence, CAST(rs > 0.15 AS INTEGER) AS risk_disagree FROM g""",
)
def r19(spark, sf):
    s = scored_frame(spark, sf).where("rejected IS NOT NULL")
    n = G.tier_number(F.col("operational_tier"))
    votes = F.array(
        F.struct(F.when(n >= 5, 2).when(n >= 3, 1).otherwise(0).alias("v"), F.col("client_reject_probability").alias("r")),
        F.struct((F.col("rejected") * 2).alias("v"), F.col("rejected").cast("double").alias("r")),
        F.struct((F.col("toxic") * 2).alias("v"), (F.col("toxic") * 0.5).alias("r")),
    )
    long_ = s.select("respondent_id", F.explode(votes).alias("x")).select("respondent_id", "x.v", "x.r")
    out = S.majority_vote(long_, "respondent_id", "v", "r")
    for c in ("vote_mean", "vote_std", "avg_risk", "risk_std", "confidence"):
        out = out.withColumn(c, F.round(c, 6))
    return out


UP = "3.0::DOUBLE * t1_count + 2.0::DOUBLE * t2_count + 0.5::DOUBLE * t3_count + CASE WHEN supplier_reject_rate >= 40 THEN 2.0::DOUBLE WHEN supplier_reject_rate >= 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE timing_band WHEN 'bottom_10' THEN 1.0::DOUBLE WHEN 'bottom_25' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.5::DOUBLE * weak_text + CASE WHEN len(signals) >= 6 THEN 1.0::DOUBLE WHEN len(signals) >= 4 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
FIRM = "CASE WHEN t1_count > 0 THEN 1010.0::DOUBLE ELSE 10.0::DOUBLE + 2.0::DOUBLE * t2_count - CASE WHEN t2_count = 0 AND t3_count > 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN supplier_reject_rate < 10 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END - 1.0::DOUBLE + 0.5::DOUBLE * weak_text - CASE WHEN timing_band = 'above_median' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END"


@query(
    "r20_calibrate_to_target_rate",
    f"""WITH {CONV}, k AS (SELECT respondent_id, dataset_id, judgment, CASE judgment WHEN 'REVIEW' THEN -({UP}) WHEN 'DISCARD' THEN {FIRM} END AS key FROM ra), n AS (SELECT dataset_id, CAST(round_even(count(*) * 0.12::DOUBLE, 0) AS BIGINT) - count(*) FILTER (judgment = 'DISCARD') AS need FROM k GROUP BY 1),
    r AS (SELECT k.*, need, row_number() OVER (PARTITION BY k.dataset_id, judgment ORDER BY key, respondent_id) AS pos FROM k JOIN n USING (dataset_id))
    SELECT respondent_id, judgment, CASE WHEN judgment = 'REVIEW' AND pos <= need THEN 'DISCARD' WHEN judgment = 'DISCARD' AND pos <= -need THEN 'REVIEW' ELSE judgment END AS calibrated_judgment, CASE WHEN judgment = 'REVIEW' AND pos <= need THEN 'upgraded' WHEN judgment = 'DISCARD' AND pos <= -need THEN 'downgraded' ELSE 'unchanged' END AS calibration_change FROM r""",
)
def r20(spark, sf):
    d = reassessed(spark, sf)
    d = d.select("respondent_id", "dataset_id", "judgment", S.review_priority(d).alias("up"), S.discard_strength(d).alias("firm"))
    return S.calibrate_to_rate(d, "dataset_id", "respondent_id", "judgment", "up", "firm", 0.12).select("respondent_id", "judgment", "calibrated_judgment", "calibration_change")


@query(
    "r21_cohort_thresholds",
    f"""WITH {TRIAGE} SELECT respondent_id, role_class, CASE WHEN f_hostile = 1 OR ml_score >= 0.85 OR ml_score >= CASE role_class WHEN 'trade_relevant' THEN 0.35 WHEN 'likely_non_trade' THEN 0.4 ELSE 0.45 END THEN 'DISCARD' WHEN ml_score >= CASE role_class WHEN 'trade_relevant' THEN 0.2 WHEN 'likely_non_trade' THEN 0.25 ELSE 0.3 END THEN 'REVIEW' ELSE 'KEEP' END AS cohort_judgment FROM triage""",
)
def r21(spark, sf):
    limits = {"trade_relevant": (0.35, 0.20), "likely_non_trade": (0.40, 0.25)}
    out = S.cohort_thresholds(triage_frame(spark, sf), "role_class", "ml_score", limits, (0.45, 0.30), F.col("f_hostile") == 1)
    return out.select("respondent_id", "role_class", "cohort_judgment")


@query(
    "r22_combined_context_score",
    f"""WITH {SEM}, m AS (SELECT greatest(max(semantic_risk), 1.0::DOUBLE) AS m FROM sm) SELECT respondent_id, blind_tier, round(0.65::DOUBLE * client_reject_probability + 0.35::DOUBLE * semantic_risk / m, 6) AS combined_score,
    CASE WHEN operational_tier = 'Exclude candidate' THEN 5 WHEN operational_tier = 'Review closely' OR blind_tier >= 4 THEN 4 WHEN operational_tier = 'Light review' OR blind_tier = 3 THEN 3 WHEN operational_tier = 'Keep with note' OR blind_tier = 2 THEN 2 ELSE 1 END AS routing_tier FROM sm, m""",
)
def r22(spark, sf):
    out = S.combined_context(semantic(spark, sf), "client_reject_probability", "semantic_risk", "operational_tier", "blind_tier")
    return out.select("respondent_id", "blind_tier", "combined_score", "routing_tier")


BEST = "45.0::DOUBLE * CAST(suggested_action = 'keep_no_issue_from_independent_audit' AS INTEGER) + 8 * CAST(role_class = 'trade_relevant' AS INTEGER) + 6 * CAST(brand_quality = 'has_valid_brand_or_tool_category' AS INTEGER) + 15 * CAST(narrative_quality IN ('topic_relevant', 'substantive_narrative') AS INTEGER) + 12 * CAST(len(rf) = 0 AS INTEGER) + floor(least(word_count, 45) / 3) - 8 * CAST(word_count < 4 AS INTEGER)"
WORST = "100.0::DOUBLE * CAST(final_decision = 'discard' AS INTEGER) + 10 * CAST(suggested_action = 'review_for_possible_discard' AS INTEGER) + 25 * CAST(len(db) > 0 AS INTEGER) + 8 * f_fast_complete + 8 * CAST(word_count <= 4 AS INTEGER)"


@query(
    "r23_select_examples",
    f"""WITH {AUDIT}, z AS (SELECT dataset_id, respondent_id, round({BEST}, 6) AS example_score, 'best' AS example_group FROM vf UNION ALL SELECT dataset_id, respondent_id, round({WORST}, 6), 'worst' FROM vf), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id, example_group ORDER BY example_score DESC, respondent_id) AS INTEGER) AS rank FROM z) SELECT * FROM r WHERE rank <= 5""",
)
def r23(spark, sf):
    v = S.verify_full_chain(audited(spark, sf))
    c, b = F.col, lambda x: x.cast("int")
    best = (
        45.0 * b(c("suggested_action") == "keep_no_issue_from_independent_audit") + 8 * b(c("role_class") == "trade_relevant") + 6 * b(c("brand_quality") == "has_valid_brand_or_tool_category")
        + 15 * b(c("narrative_quality").isin("topic_relevant", "substantive_narrative")) + 12 * b(F.size("risk_factors") == 0) + F.floor(F.least(c("word_count"), F.lit(45)) / 3) - 8 * b(c("word_count") < 4)
    )
    worst = 100.0 * b(c("final_decision") == "discard") + 10 * b(c("suggested_action") == "review_for_possible_discard") + 25 * b(F.size("discard_basis") > 0) + 8 * c("f_fast_complete") + 8 * b(c("word_count") <= 4)
    return S.select_examples(v, "dataset_id", "respondent_id", best, worst, 5)


RATIONALE = "CASE WHEN support_rows = 0 THEN 'no observed support' ELSE concat_ws('; ', 'base weight', CASE WHEN evidence_type = 'transparent_deterministic' THEN 'deterministic evidence' ELSE 'judgment evidence' END, CASE WHEN support_rows / total_rows::DOUBLE <= 0.05 THEN 'rare' WHEN support_rows / total_rows::DOUBLE >= 0.2 THEN 'common' END) END"


@query(
    "r24_evidence_table",
    f"""WITH {SCORED}, {WEIGHTS}, r AS (SELECT *, {RATIONALE} AS rationale FROM wt), e AS (SELECT respondent_id, CAST(row_number() OVER (PARTITION BY respondent_id ORDER BY pos) - 1 AS INTEGER) AS position, criterion_id, source, observed, points FROM ev)
    SELECT s.respondent_id, coalesce(position, 0) AS position, coalesce(e.criterion_id, 'none') AS criterion_id, source, observed, coalesce(points, 0) AS points, rationale FROM scored s LEFT JOIN e USING (respondent_id) LEFT JOIN r ON r.criterion_id = e.criterion_id""",
)
def r24(spark, sf):
    return S.evidence_table(evidence(spark, sf), "respondent_id", weights(spark, sf))


@query("r25_criteria_catalog", f"WITH {SCORED}, {WEIGHTS} SELECT criterion_id, family, evidence_type, support_rows, support_rate, weight, {RATIONALE} AS rationale FROM wt")
def r25(spark, sf):
    return weights(spark, sf).select("criterion_id", "family", "evidence_type", "support_rows", "support_rate", "weight", "rationale")


FEEDBACK = {
    "straightline": (r"straightline|matrix", "lower the straightline threshold from 0.95 to 0.90"),
    "duplicates": (r"duplicate|template", "keep duplicates review-only until mapped"),
    "ai_open_end": (r"polished|survey_meta", "keep semantic authenticity feedback-driven"),
    "brand": (r"brand", "supply the project's brand fields"),
}


@query(
    "r26_feedback_config",
    f"""WITH {SCORED}, u AS (SELECT array_to_string(signals, ' ') AS f FROM scored WHERE rejected = 1 AND tier_n <= 3), x AS ({' UNION ALL '.join(f"SELECT '{n}' AS family, (SELECT count(*) FROM u WHERE regexp_matches(f, {q(p)})) AS support_rows, {q(ch)} AS trial_change" for n, (p, ch) in FEEDBACK.items())}) SELECT * FROM x WHERE support_rows > 0""",
)
def r26(spark, sf):
    """Rejected rows that the tiers let through are the feedback."""
    s = scored_frame(spark, sf)
    miss = (F.col("rejected") == 1) & (G.tier_number(F.col("operational_tier")) <= 3)
    fb = s.select(F.array_join("signals", " ").alias("flags"), F.when(miss, "under_escalated").otherwise("other").alias("kind"))
    return S.feedback_config(fb, "flags", "kind", FEEDBACK)


QC_SQL = "CASE k % 14 " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in S.QC_LABELS.items()) + " END"


@query(
    "r27_platform_signal_flags",
    f"""WITH e AS (SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k, event_type, value, CASE user_id % 4 WHEN 0 THEN 'English' WHEN 1 THEN 'en' WHEN 2 THEN 'French' ELSE 'German' END AS lang FROM events),
    p AS (SELECT event_id, concat_ws(' | ', 'QC FLAG: ' || {QC_SQL}, CASE WHEN event_type = 'error' AND value > 50 THEN 'TERMINATED' END, CASE WHEN k % 30 >= 25 THEN 'threat=' || (k % 30) || ' (ELEVATED)' WHEN k % 30 >= 20 THEN 'threat=' || (k % 30) || ' (moderate)' END,
      CASE WHEN lower(lang) NOT IN ('english', 'en', 'us') THEN 'language=' || lang END, CASE WHEN value < 1 THEN 'DROPPED OUT' END) AS s FROM e)
    SELECT CASE WHEN s = '' THEN 'No platform signals triggered.' ELSE s END AS summary, count(*) AS n_rows FROM p GROUP BY 1""",
)
def r27(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.pmod("user_id", F.lit(4))
    lang = F.when(u == 0, "English").when(u == 1, "en").when(u == 2, "French").otherwise("German")
    e = table(spark, sf, "events").select(k.alias("k"), "event_type", "value", lang.alias("lang"))
    s = S.platform_flags(F.col("k") % 14, (F.col("event_type") == "error") & (F.col("value") > 50), F.col("k") % 30, F.col("lang"), F.col("value") < 1)
    return e.groupBy(s.alias("summary")).agg(F.count(F.lit(1)).alias("n_rows"))


HARD = {"license_boilerplate": r"license|copyright", "contact_details": r"@|https?:", "keyboard_mash": r"asdf|qwerty|bvnhgj"}
SOFT = {"pipes": r"\|", "insults": r"idiot|stupid|pathetic|worthless", "numbers": r"[0-9]{3}"}
KEEP = {"grounded": STUDY.grounded_pattern, "topic": STUDY.topic_pattern, "enthusiasm": L.ENTHUSIASM_PATTERN}


def rx(d) -> str:
    return list_sql([(n, f"regexp_matches(t, {q(p)})") for n, p in d.items()])


@query(
    "r28_semantic_rubric",
    f"""WITH t AS (SELECT doc_id AS respondent_id, {norm_sql('text')} AS t, source FROM documents), s AS (SELECT respondent_id, {rx(HARD)} AS h, {list_sql([(n, f"regexp_matches(t, {q(p)})") for n, p in SOFT.items()] + [('missing_supplier', "source = 'src9'")])} AS s, {rx(KEEP)} AS k FROM t)
    SELECT respondent_id, array_to_string(h, ';') AS hard_signals, array_to_string(s, ';') AS soft_signals, array_to_string(k, ';') AS keep_signals, CASE WHEN len(h) > 0 OR len(s) >= 2 THEN 'discard' WHEN len(s) = 1 AND len(k) < 2 THEN 'review' ELSE 'keep' END AS decision,
      CASE WHEN len(h) > 0 THEN 'high' WHEN len(s) >= 2 THEN 'moderate' WHEN len(s) = 1 AND len(k) >= 2 THEN 'moderate' WHEN len(s) = 1 THEN 'low' WHEN len(k) > 0 THEN 'high' ELSE 'moderate' END AS confidence FROM s""",
)
def r28(spark, sf):
    r = respondents(spark, sf).select("respondent_id", "supplier", "open_text")
    out = S.semantic_rubric(r, "open_text", HARD, SOFT, KEEP, {"missing_supplier": F.col("supplier") == "src9"})
    return out.select("respondent_id", *[F.array_join(c, ";").alias(c) for c in ("hard_signals", "soft_signals", "keep_signals")], "decision", "confidence")


@query(
    "r29_review_packets",
    f"""WITH {SCORED} SELECT dataset_id, CAST(ceil(row_number() OVER (PARTITION BY dataset_id ORDER BY respondent_id) / 50.0) AS INTEGER) AS chunk, respondent_id, '{{"word_count":' || word_count || ',"operational_tier":"' || operational_tier || '","dup_count":' || dup_count || '}}' AS packet FROM scored""",
)
def r29(spark, sf):
    p = S.review_packets(scored_frame(spark, sf), "dataset_id", "respondent_id", ["word_count", "operational_tier", "dup_count"], 50)
    return p.withColumn("packet", F.to_json("packet"))


FAM = {n: ("greatest(" + ", ".join(f"f_{m}" for m in ms) + ")" if len(ms) > 1 else f"f_{ms[0]}") for n, ms in G.FAMILIES.items()}


@query(
    "r30_evidence_family_convergence",
    f"""WITH {SCORED}, f AS (SELECT respondent_id, score, f_hostile, {' + '.join(FAM.values())} AS families_fired FROM scored) SELECT respondent_id, families_fired, CASE WHEN f_hostile = 1 OR (score >= 0.4 AND families_fired >= 1) OR families_fired >= 4 THEN 'DISCARD' WHEN families_fired >= 2 OR score >= 0.4 THEN 'REVIEW' ELSE 'KEEP' END AS convergence_decision FROM f""",
)
def r30(spark, sf):
    f = D.family_scores(scored_frame(spark, sf), G.FAMILIES)
    out = S.family_convergence(f, list(G.FAMILIES), "score", F.col("f_hostile") == 1, strong=0.4)
    return out.select("respondent_id", "families_fired", "convergence_decision")


@query("r31_signal_matrix", f"WITH {SCORED} SELECT respondent_id, {', '.join(f'f_{s} = 1 AS {s}' for s in G.SIGNALS)} FROM scored")
def r31(spark, sf):
    """Built from the long (id, signal) form, as a dictionary-driven job would."""
    s = scored_frame(spark, sf)
    long_ = s.select("respondent_id", F.explode(F.array(*[F.struct(F.lit(x).alias("signal"), (F.col(f"f_{x}") == 1).alias("present")) for x in G.SIGNALS])).alias("z")).select("respondent_id", "z.*")
    return long_.groupBy("respondent_id").pivot("signal", list(G.SIGNALS)).agg(F.bool_or("present"))


@query(
    "r31_signal_profile",
    f"""WITH {SCORED}, u AS ({' UNION ALL '.join(f"SELECT '{s}' AS signal, f_{s} AS v FROM scored" for s in G.SIGNALS)}) SELECT signal, count(*) AS n_assessed, CAST(sum(v) AS BIGINT) AS n_present, round(avg(v), 6) AS present_rate, CASE WHEN avg(v) > 0.85 THEN 'context_only' WHEN avg(v) < 0.01 THEN 'sparse' ELSE 'counted' END AS decision_weight FROM u GROUP BY 1""",
)
def r31b(spark, sf):
    return S.signal_profile(scored_frame(spark, sf), "respondent_id", G.SIGNALS)


@query("r31_signal_coverage", "SELECT doc_id AS respondent_id, 'hostile' AS signal FROM documents WHERE doc_id % 50 = 0")
def r31c(spark, sf):
    s = scored_frame(spark, sf).select("respondent_id")
    done = s.select("respondent_id", F.explode(F.array(*[F.lit(x) for x in G.SIGNALS])).alias("signal")).where(~((F.pmod("respondent_id", F.lit(50)) == 0) & (F.col("signal") == "hostile")))
    return S.unassessed(s, done, "respondent_id", G.SIGNALS)


ROUTE = """CASE judgment WHEN 'KEEP' THEN 'auto_keep_candidate' WHEN 'DISCARD' THEN 'high_conf_discard_candidate' ELSE CASE WHEN protective_score >= 0.5 THEN 'targeted_second_read' ELSE 'human_review' END END"""


@query(
    "r32_review_routing",
    f"""WITH {CONV}, r AS (SELECT judgment, {ROUTE} AS review_routing_class, CASE judgment WHEN 'KEEP' THEN 'low' WHEN 'DISCARD' THEN 'urgent' ELSE CASE WHEN score >= 0.5 THEN 'high' ELSE 'medium' END END AS review_priority, CASE WHEN judgment = 'KEEP' THEN 'no_converging_signal' WHEN len(signals) = 0 THEN 'score_only' ELSE signals[1] END AS review_reason_code FROM ra)
    SELECT judgment, review_routing_class, review_priority, review_reason_code, count(*) AS n_rows FROM r GROUP BY ALL""",
)
def r32(spark, sf):
    r = S.review_routing(reassessed(spark, sf), "judgment", "score")
    return r.groupBy("judgment", "review_routing_class", "review_priority", "review_reason_code").agg(F.count(F.lit(1)).alias("n_rows"))


@query("r33_missed_by_first_pass", f"WITH {AUDIT} SELECT respondent_id, dataset_id, suggested_action, score, operational_tier FROM au WHERE suggested_action = 'review_for_possible_discard' AND tier_n < 3")
def r33(spark, sf):
    """Rows the first pass never routed to review although the audit suggests a discard."""
    a = audited(spark, sf)
    reviewed = scored_frame(spark, sf).where(G.tier_number(F.col("operational_tier")) >= 3).select("respondent_id")
    missed = a.where(F.col("suggested_action") == "review_for_possible_discard").select("respondent_id", "dataset_id", "suggested_action").join(reviewed, "respondent_id", "left_anti")
    return missed.join(scored_frame(spark, sf).select("respondent_id", "score", "operational_tier"), "respondent_id")
