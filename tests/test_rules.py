"""Hand-made rows with known answers: metrics, labels, seals, joins, leakage, codebooks, edge texts."""

import pytest
from pyspark.sql import functions as F

from respondex.functions import text as X
from respondex.operators import evaluation as E
from respondex.operators import integrity as I
from respondex.operators import profiling as P
from respondex.operators import scoring as S
from respondex.operators import splits as PS
from respondex.operators import text_signals as T
from respondex.config import SignalConfig
from respondex.sources import tables as IO
from respondex.streaming import monitor


def test_confusion_of_four_cells(spark):
    m = E.confusion(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int"), "y", "p").first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (1, 1, 1, 1)
    assert m["precision"] == m["recall"] == 0.5 and m["mcc"] == 0.0


def test_average_precision_at_least_prevalence(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.8), (0, 0.2), (0, 0.1)], "y int, s double")
    assert E.average_precision(d, [], "s", "y").first()["average_precision"] == 1.0
    assert E.auroc(d, [], "s", "y").first()["auroc"] == 1.0


def test_auroc_ties_and_single_class(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.3), ("b", 1, 0.4)], "g string, y int, s double")
    out = {r["g"]: r["auroc"] for r in E.auroc(d, ["g"], "s", "y").collect()}
    assert out == {"a": 0.5, "b": None}


def test_status_labels(spark):
    d = spark.createDataFrame([("5",), ("3",), ("2",), ("5.0",), (" Rejected ",), ("keep",), (None,)], "s string")
    assert [r[0] for r in d.select(E.status_label(F.col("s"))).collect()] == [1, 0, None, 1, 1, 0, None]


def test_seal_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([("r1", 0.1), ("r2", None), ("r3", 0.3)], "id string, p double")
    b = a.orderBy(F.col("id").desc()).repartition(3)
    cols = ["id", "p"]
    sealed = I.seal(a, cols)
    assert sealed.first() == I.seal(b, cols).first()
    I.verify_seal(b, cols, sealed)
    with pytest.raises(I.BoundaryError):
        I.verify_seal(a.withColumn("p", F.when(F.col("id") == "r1", 0.9).otherwise(F.col("p"))), cols, sealed)
    with pytest.raises(I.BoundaryError):
        I.verify_seal(a, cols, None)


def test_join_by_id_not_by_order(spark):
    p = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "id string, s double")
    y = spark.createDataFrame([("b", 1), ("a", 0)], "id string, y int")
    assert {r["id"]: (r["s"], r["y"]) for r in I.join_by_stable_id(p, y, "id").collect()} == {"a": (0.1, 0), "b": (0.9, 1)}
    for bad_p, bad_y in ((p.union(p), y), (p, y.where("id = 'a'")), (p.withColumn("id", F.lit("")), y)):
        with pytest.raises(I.BoundaryError):
            I.join_by_stable_id(bad_p, bad_y, "id")


def test_evaluator_may_not_change_decisions(spark):
    before = spark.createDataFrame([("r1", "Tier 1", "false"), ("r2", None, "true")], "id string, decision_tier string, discard string")
    cols = ["decision_tier", "discard"]
    I.assert_unchanged(before, before, "id", cols)
    with pytest.raises(I.BoundaryError):
        I.assert_unchanged(before, before.withColumn("decision_tier", F.lit("Tier 5")), "id", cols)
    with pytest.raises(I.BoundaryError):
        I.assert_unchanged(before, before.where("id = 'r1'"), "id", cols)


def test_required_ledger_fields(spark):
    d = spark.createDataFrame([("r1", "x", ""), ("r2", None, "y")], "id string, a string, protective_evidence string")
    got = {(r["id"], r["violation"]) for r in I.violations(d, "id", I.required(["a", "protective_evidence"])).collect()}
    assert got == {("r1", "missing:protective_evidence"), ("r2", "missing:a")}


def test_leakage_columns():
    names = "status markers conditionsX noanswerq5_r3 qc5r2 VALIDCLIENT CHANNELTRACKING closingemail RD_Searchr0 qcoe1 q34 CLASSIFYGROUP".split()
    assert P.leakage_columns(names) == names[:9]
    names = ["uuid", "status", "markers", "client_decision", "qtime", "outro", "TERMFLAGS"]
    assert P.leakage_columns(names) == ["status", "markers", "client_decision", "TERMFLAGS"]


def test_blind_input_with_outcome_is_refused(spark):
    with pytest.raises(ValueError):
        P.refuse_outcomes(spark.createDataFrame([(1, 1)], "id int, client_decision int"))


def test_codebook_rows(spark):
    rows = spark.createDataFrame(
        [("s", 0, "[q5]: Rate these brands", None, None), ("s", 1, "Values: 1-2", None, None), ("s", 2, None, "1", "Bad"), ("s", 3, None, "2.0", "Good"), ("s", 4, "[q5r1]:", None, None), ("s", 5, None, "1", "Yes")],
        "sheet string, o int, a string, b string, c string",
    )
    heads, labels = P.build_codebook(rows, "o", "sheet")
    assert {r["field_name"]: r["question_text"] for r in P.inherit_prompts(heads, ["sheet"]).collect()} == {"q5": "Rate these brands", "q5r1": "Rate these brands"}
    assert {(r["field_name"], r["value"], r["label"]) for r in labels.collect()} == {("q5", "1", "Bad"), ("q5", "2", "Good"), ("q5r1", "1", "Yes")}


def test_missing_is_counted_once(spark):
    d = spark.createDataFrame([(1, ""), (2, None), (3, "answer"), (4, "  "), (5, "3.0")], "id int, v string")
    r = P.reconcile_counts(P.melt(d, ["id"], ["v"])).first()
    assert (r["n_rows"], r["n_answered"], r["n_distinct"]) == (5, 2, 2)


EDGE = ["", None, "   ", "none", "aaaaaaa", "Étion dans çouelle", "thank you", "bvnhgj xxxx yyyy", "i bought it for my family home kitchen, it is great.", "asdf qwer asdf", "Привет мир как дела"]


def test_edge_texts_have_one_class(spark):
    d = spark.createDataFrame([(t,) for t in EDGE], "t string")
    got = [r[0] for r in d.select(T.open_text_class(F.col("t"))).collect()]
    assert got[:3] == ["empty"] * 3 and got[3] == "off_topic_incoherent" and got[6] == "generic_praise" and got[7] == "gibberish"
    assert got[8] == "first_person_personal" and all(got)


def test_low_effort_and_repetition(spark):
    d = spark.createDataFrame([("na",), ("aaaaa",), ("gas",), ("xyz",), ("fine answer",), ("",)], "t string")
    assert [r[0] for r in d.select(T.low_effort(F.col("t"))).collect()] == [True, True, False, True, False, False]
    d = spark.createDataFrame([("go to go to go to",), ("a b c d e f g",), ("a a a",), (None,)], "t string")
    assert [r[0] for r in d.select(X.repeated_phrase(F.col("t"))).collect()] == [True, False, False, False]


def test_words_in_non_latin_text(spark):
    r = spark.createDataFrame([("Étion dans çouelle",)], "t string").select(X.word_count(F.col("t"))).first()
    assert r[0] == 3


def test_text_metrics_of_blank(spark):
    r = T.text_metrics(spark.createDataFrame([(None,)], "t string"), "t", SignalConfig()).first()
    assert (r["char_count"], r["word_count"], r["sentence_count"], r["unique_token_ratio"], r["generic_placeholder"]) == (0, 0, 0, 0.0, 1)


def test_client_score_never_moves_the_blind_tier(spark):
    d = spark.createDataFrame([(1, 0.0, 1, 0.99, "Exclude candidate")], "id int, risk double, blind int, p double, prior string")
    r = S.combined_context(d, "p", "risk", "prior", "blind").first()
    assert r["blind"] == 1 and r["routing_tier"] == 5


def test_terminal_state_needs_every_gate(spark):
    row = lambda ds, rec: (ds, 0.995, 0.99, 0.99, rec, 0.99, 0.97)
    schema = "dataset_id string, accuracy double, balanced_accuracy double, macro_f1 double, recall double, precision double, mcc double"
    bad = spark.createDataFrame([row("POOLED", 0.80), row("d1", 0.80)], schema)
    good = spark.createDataFrame([row("POOLED", 0.98), row("d1", 0.95)], schema)
    assert E.terminal_state(bad, "dataset_id").first()["terminal_state"] == "IMPROVING_NOT_MET"
    assert E.terminal_state(good, "dataset_id").first()["terminal_state"] == "TARGET_MET"


def test_thresholds_lie_in_unit_interval(spark):
    d = spark.createDataFrame([(i % 2, "ab"[i // 20], 1.0 - (i % 2) + i / 1000.0) for i in range(40)], "y int, ds string, s double")
    b = E.best_threshold(E.threshold_sweep(d, "s", "y", [0.1, 0.5, 0.9]), "macro_f1").first()
    assert 0 <= b["threshold"] <= 1 and b["inverted"] == 1 and b["macro_f1"] == 1.0


def test_second_pass_needs_convergence(spark):
    d = spark.createDataFrame([(["duplicate_text"],), (["duplicate_text", "raw_fast"],), ([],), (["matrix_straightline", "low_effort_open_end"],)], "ids array<string>")
    assert [r[0] for r in d.select(S.second_pass(F.col("ids"))).collect()] == ["keep_with_recommendation", "discard_candidate", "keep_no_issue", "discard_candidate"]


def test_split_is_disjoint_and_exact(spark):
    d = spark.range(1000).select("id", (F.col("id") % 2).alias("y"))
    s = PS.stratified_split(d, ["y"], "id", "seed")
    counts = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert counts == {(y, k): n for y in (0, 1) for k, n in (("train", 350), ("val", 75), ("test", 75))}
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, PS.stratified_split(d.repartition(7), ["y"], "id", "seed").collect()))


def test_latest_judgment_from_json_chunks(spark, tmp_path):
    for i, (j, v) in enumerate((("KEEP", 1), ("DISCARD", 2))):
        (tmp_path / f"chunk{i}.json").write_text('{"respondent_id": "r1", "agent_judgment": "%s", "v": %d}\n' % (j, v))
    df = IO.load_judgments(spark, str(tmp_path / "*.json"), "respondent_id string, agent_judgment string, v int").drop("chunk_file")
    assert IO.latest_per_id(df, "respondent_id", ["v"]).first()["agent_judgment"] == "DISCARD"
    assert IO.latest_per_id(df, "respondent_id", ["v"], keep="first").first()["agent_judgment"] == "KEEP"


def test_csv_headers_are_trimmed(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" uuid , q1\nx,1\n")
    assert IO.load_responses(spark, str(tmp_path / "a.csv"), "csv").columns == ["uuid", "q1"]


def test_stream_drops_repeats_and_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {22 + i % 2:02d}:{i % 50:02d}:00") for i in range(60)]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    d = spark.createDataFrame(rows, "event_id int, t string").select("event_id", F.col("t").cast("timestamp").alias("ts"))
    d.union(d.limit(20)).coalesce(1).write.parquet(src)
    late = spark.createDataFrame([(999, "2024-01-02 12:00:00")], "event_id int, t string").select("event_id", F.col("t").cast("timestamp").alias("ts"))
    late.coalesce(1).write.mode("append").parquet(src)
    stream = monitor.read_stream(spark, src, d.schema, 10)
    monitor.run_to_end(monitor.minute_counts(monitor.first_seen(stream, "event_id", "ts"), "ts", None), out, str(tmp_path / "cp"))
    got = {(r["minute"], r["n_starts"], r["odd_hour_starts"]) for r in spark.read.parquet(out).collect() if r["minute"].day == 1}
    want = {(r["minute"], r["n_starts"], r["odd_hour_starts"]) for r in monitor.minute_counts(d, "ts", None).collect()}
    assert got == want


def test_pairs_nobody_assessed_are_never_broadcast(spark):
    """Repeated and null ids stay, signals beyond the bits of one long too, and no pair of an id and a signal is sent."""
    names = [f"s{i:03}" for i in range(130)]
    ids = spark.createDataFrame([(1,), (1,), (2,), (None,), (4,)], "id long")
    done = [(1, s) for s in names[:64]] + [(2, names[129]), (2, names[129]), (2, "unknown"), (None, names[0]), (9, names[0]), (4, None)]
    done = spark.createDataFrame(done, "id long, signal string")
    out = S.unassessed(ids, done, "id", names)
    want = [(1, s) for s in names[64:]] * 2 + [(2, s) for s in names[:129]] + [(None, s) for s in names] + [(4, s) for s in names]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
