"""No list, prefix or number of rows decides which rows, texts or options count."""

from pyspark.sql import functions as F

from respondex.config import SignalConfig
from respondex.operators import duplicates as D
from respondex.operators import lift as U
from respondex.operators import models as M
from respondex.operators import text_signals as T


def test_rows_of_unlisted_data_sets_and_channels_are_scored(spark):
    rows = [(i, [None, "de", "xx"][i % 3], float((i * 7) % 11), i % 2, f"t{i}") for i in range(120)]
    d = spark.createDataFrame(rows, "id long, ds string, f double, y int, digest string")
    out = M.leave_one_out(d, ["f"], "y", "ds", "digest")
    assert out.where(F.col("probability").isNotNull()).count() == out.select("id").distinct().count() == 120
    ch = M.per_channel(d, d, ["f"], "y", "ds", min_rows=30)
    assert ch.count() == 120 and ch.where("ds IS NULL AND channel_score IS NULL AND final = global_score").count() == 40
    assert ch.where("ds IS NOT NULL AND channel_score IS NULL").count() == 0


def test_oversampling_has_the_same_columns_at_any_class_rate(spark):
    make = lambda share: spark.createDataFrame([(i, int(i % share == 0), float(i % 13), "x") for i in range(60)], "id long, y int, f double, other string")
    rare, common = (M.oversample_minority(make(s), "id", ["f"], "y") for s in (10, 2))
    assert rare.columns == common.columns and rare.count() > 0 and common.count() == 0


def test_long_texts_that_differ_late_are_two_templates(spark):
    d = spark.createDataFrame([(1, "word " * 80 + "alpha"), (2, "word " * 80 + "beta"), (3, "word " * 80 + "Beta.")], "id long, t string")
    got = {r["id"]: r["cluster_size"] for r in D.template_clusters(d, "id", "t", SignalConfig()).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_claims_name_all_options_and_whole_questions(spark):
    rows = [(1, "q", "multi_select", "Which did you buy?", f"o{i:02d}") for i in range(20)] + [(1, "s", "single_select", "What " + "long " * 40 + "end?", "yes")]
    d = spark.createDataFrame(rows, "id long, field string, kind string, question string, value string")
    got = {r["field"]: r["proposition"] for r in T.propositions(d, "id", "field", "kind", "question", "value").collect()}
    assert got["q"].endswith(": " + ", ".join(f"o{i:02d}" for i in range(20)) + ".")
    assert "end: yes." in got["s"]


def test_themes_have_a_row_per_value(spark):
    d = spark.createDataFrame([(i, "a", f"s{i % 9}") for i in range(27)], "id long, theme string, supplier string")
    got = U.theme_inventory(d, "theme", "id", "supplier").collect()
    assert len(got) == 9 and {(r["value_rows"], r["support_rows"], r["support_rate"]) for r in got} == {(3, 27, 1.0)}
