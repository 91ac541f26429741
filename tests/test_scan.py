"""Texts read in Arrow batches give what the expressions over one text at a time give."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from respondex.functions import lexicons as L
from respondex.functions import scan
from respondex.functions import text as X
from respondex.operators import text_signals as T
from respondex.operators.signals import NO_WORD, text_facts
from respondex.plans import study

TEXTS = [
    None, "", " ", "none", "None\n", "n/a", "a b a b a b", "one two three four one two one two", "x y x y x y z", "the the the the",
    "Ünïcode wörter ١٢ 漢字 don't", "call 12345 Main Street", "mail a@b.co", "aaaaaa", "brr brr tsk tsk grr", "I paint my kitchen wife",
    "the quality of water  is\tgood.", "survey | about!?.. it", "study  ", "a\u0085b", "#1 3.0 -- text", "the " * 30 + "end", "das ist gut " * 20,
]


def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "respondent_id long, open_text string")


def test_reading_equals_expressions(spark):
    cfg, t = study.STUDY, X.norm(F.col("open_text"))
    w = X.lower_words(t)
    want = rows(spark).select(
        "respondent_id", F.size(w).alias("word_count"), X.unique_ratio(w).alias("unique_token_ratio"), X.repeated_phrase(t).cast("int").alias("f_repeated_phrase"),
        *[t.rlike(p).cast("int").alias(n) for n, p in (("f_survey_meta", cfg.meta_pattern), ("f_polished", cfg.polished_pattern), ("f_hostile", cfg.hostile_pattern), ("g_grounded", cfg.grounded_pattern))],
        (X.hits_in(w, cfg.domain_terms) >= cfg.extra["domain_rich_hits"]).cast("int").alias("g_domain_rich"),
    )
    got = text_facts(rows(spark), "respondent_id", "open_text", cfg).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_decision_rules_equal_plain_rules(spark, monkeypatch):
    c, t = F.col("open_text"), X.norm(F.col("open_text"))
    want = rows(spark).select(
        "respondent_id", T.open_text_class(c).alias("oe_class"), T.narrative_quality(c, study.STUDY.topic_pattern).alias("narrative_quality"),
        T.severe_weak(c, study.CONTEXT).cast("int").alias("weak_text"), T.misplaced(c, study.CONTEXT).cast("int").alias("misplaced_text"),
        t.rlike(L.SUBSTANTIVE_PATTERN).cast("int").alias("substantive_context"),
    )
    monkeypatch.setattr(study, "respondent_texts", lambda *_: rows(spark))
    reads = study._text_reads(spark, "")
    assert sorted(reads.select(*want.columns).collect()) == sorted(want.collect())
    # long texts are walked by Arrow, not by Java's alternatives
    plan = reads._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "maintenance" not in plan and "driveway" not in plan


def test_slices_and_wide_keys(monkeypatch):
    reading = scan.Reading(("the",), ("[aeiou]+",), ("aeiou",), (".!?",), words=NO_WORD, lexicon=("the",), phrases=True)
    texts = pa.array([t if t is None else t.lower() for t in TEXTS] * 3)
    whole = reading.read(texts).to_pylist()
    monkeypatch.setattr(scan, "SLICE_BYTES", 16)
    assert reading.read(texts).to_pylist() == whole
    assert reading.read(texts.slice(5, 20)).to_pylist() == whole[5:25]
    assert reading.read(texts.slice(0, 0)).to_pylist() == []
    assert whole[23]["r2"] == whole[0]["r2"] == 0 and whole[16]["r3"] == 1 and whole[17]["r3"] == 1


def test_repeated_pairs_beyond_64_bits():
    row, code = np.array([0] * 7 + [2] * 6), np.array([0, 1, 0, 1, 0, 1, 2] + [0, 1, 2, 0, 1, 2])
    narrow = scan._repeated_pairs(row, code, range(3), 3)
    wide = scan._repeated_pairs(row, code, range(1 << 31), 3)
    assert narrow.tolist() == wide.tolist() == [True, False, False]


def test_only_plain_patterns_go_to_arrow():
    assert scan.plain(L.SUBSTANTIVE_PATTERN) and scan.plain(study.CONTEXT) and scan.plain(r"\|") and scan.plain(X.as_pattern(("a.b", "c|d")))
    assert not any(map(scan.plain, (r"(.)\1", r"^none$", r"a\b", r"x(?=y)", r"[a-z]+", r"a*", r".", r"(?i)a", r"\d")))
