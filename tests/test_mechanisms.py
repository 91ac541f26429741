"""Operators with a mechanism of their own against brute force, hot groups and odd rows included."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from respondex.operators import evaluation as E
from respondex.operators import isolation as I
from respondex.operators import neighbours as N
from respondex.operators import profiling as P
from respondex.operators import similarity as S
from respondex.operators import text_signals as T
from respondex.operators.components import linked_classes
from respondex.operators.factor import truncated_svd
from respondex.operators.metric_tree import MetricTree
from respondex.operators.phrases import PhraseTrie, phrase_matches
from respondex.sources import tables as IO


# --- truncated singular value decomposition ---------------------------------------------------------------


def test_svd_equals_numpy_on_the_real_vocabulary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    weights = T.tfidf(docs, "doc_id", T.word_terms(F.col("text")), 2, 0.8, digits=None).cache()
    rows = weights.select("doc_id", "term", "tfidf").collect()
    names, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    at, col = {n: i for i, n in enumerate(names)}, {t: i for i, t in enumerate(terms)}
    a = np.zeros((len(names), len(terms)))
    for r in rows:
        a[at[r[0]], col[r[1]]] = r[2]
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    scores, loadings, values = truncated_svd(weights, "doc_id", "term", "tfidf", 4)
    assert np.allclose(values, s[:4], atol=1e-8)
    got = {r["doc_id"]: [r[f"c{i}"] for i in range(1, 5)] for r in scores.collect()}
    mine = np.array([got[n] for n in names])
    alone = [i for i in range(4) if min(abs(s[i] - s[j]) for j in range(len(s)) if j != i) > 1e-3 * s[0]]
    assert alone
    for i in alone:
        assert np.allclose(np.abs(mine[:, i]), np.abs(u[:, i] * s[i]), atol=1e-4)
    lead = loadings.orderBy(-F.abs(F.col("c1")), "term").first()
    assert lead["c1"] > 0


def test_svd_of_low_rank_hot_term_and_empty(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 9))
    a[:, 0] = 1.0  # a term of every row
    rows = [(f"r{i}", f"t{j}", float(a[i, j])) for i in range(60) for j in range(9)] + [(None, "t0", 1.0), ("r0", None, 1.0), ("r0", "t99", None), ("r0", "t98", 0.0)]
    d = spark.createDataFrame(rows, "r string, t string, w double")
    scores, loadings, values = truncated_svd(d, "r", "t", "w", 5)
    assert len(values) == 3 and np.allclose(values, np.linalg.svd(a)[1][:3])
    back = {(x["r"], y["t"]): sum(x[f"c{i}"] * y[f"c{i}"] for i in (1, 2, 3)) for x in scores.collect() for y in loadings.collect()}
    assert max(abs(back[f"r{i}", f"t{j}"] - a[i, j]) for i in range(60) for j in range(9)) < 1e-6
    assert truncated_svd(d.limit(0), "r", "t", "w", 3)[2] == []


# --- metric tree ------------------------------------------------------------------------------------------


def clustered(n, rng, centres=40, dim=6):
    c = np.random.default_rng(11).normal(0, 20, (centres, dim))
    return c[rng.integers(0, centres, n)] + rng.normal(0, 0.3, (n, dim))


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_neighbours_with_string_ids_repeats_and_groups(spark, metric):
    rng = np.random.default_rng(5)
    x = np.round(clustered(240, rng), 2)
    x[60:140] = x[0]  # a third of all rows share one vector
    ids, groups = [f"id{i:04}" for i in rng.permutation(240)], ["a" if i % 4 else None for i in range(240)]
    rows = [(ids[i], groups[i], x[i].tolist()) for i in range(240)]
    d = spark.createDataFrame(rows, "id string, g string, v array<double>").repartition(5)
    got = {}
    for r in N.nearest(d, d, "id", "v", 4, metric, "g").collect():
        got.setdefault(r["query"], []).append((r["rank"], r["dist"], r["neighbour"]))
    norm = (lambda v: math.sqrt((v * v).sum())) if metric == "l2" else (lambda v: np.abs(v).sum())
    for i in range(240):
        want = sorted((round(float(norm(x[i] - x[j])), 9), ids[j]) for j in range(240) if j != i and groups[i] == groups[j])[:4]
        mine = sorted(got[ids[i]])
        assert [m[2] for m in mine] == [w[1] for w in want] and np.allclose([m[1] for m in mine], [w[0] for w in want], atol=1e-6)


def test_visits_grow_slower_than_the_square(spark):
    def visited(n):
        x = clustered(n, np.random.default_rng(n), centres=200)
        d = spark.createDataFrame([(0, i, v.tolist(), 1) for i, v in enumerate(x)], "_g int, _b long, _bv array<double>, _n long").cache()
        tree = MetricTree(d, "l2")
        tree.nearest(d.select("_g", F.col("_b").alias("_q"), F.col("_bv").alias("_qv")), 6).count()
        rows = {c: int(k) for c, k in zip(tree.pivots.cells[0].leaf, tree.pivots.cells[0].rows)}
        return tree.visited * sum(rows.values()) / len(rows)  # about the pairs of rows compared

    small, large = visited(1000), visited(4000)
    assert large < 16 * small * 0.7
    assert large < 0.25 * 4000 * 4000


# --- phrases, copies, clusters ----------------------------------------------------------------------------


def test_trie_finds_what_plain_search_finds():
    rng = random.Random(2)
    phrases = [[rng.choice("abc") for _ in range(rng.randrange(1, 5))] for _ in range(60)] + [["a", "b", "a", "b", "c"], ["b"]]
    trie = PhraseTrie(phrases)
    for _ in range(400):
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        text = f" {' '.join(words)} "
        assert trie.found(words) == {i for i, p in enumerate(phrases) if f" {' '.join(p)} " in text}


def test_ten_thousand_items_with_a_hot_word(spark):
    rng = random.Random(4)
    items = [(i, " ".join(["the"] + [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 3))])) for i in range(10_000)] + [(10_000, ""), (10_001, None), (10_002, "The!")]
    texts = [(i, " ".join(rng.choice(["the", "The", f"w{rng.randrange(400)}"]) for _ in range(40))) for i in range(300)] + [(300, items[7][1]), (301, ""), (302, None)]
    d, bank = spark.createDataFrame(texts, "row long, t string").repartition(4), spark.createDataFrame(items, "item long, p string")
    norm = lambda s: " ".join(w.lower().strip("!") for w in (s or "").split())
    phrases = {}
    for i, p in items:
        if norm(p):
            phrases.setdefault(norm(p), []).append(i)
    want = set()
    for r, t in texts:
        words = norm(t).split()
        for a in range(len(words)):
            for b in range(a + 1, min(a + 4, len(words) + 1)):
                for i in phrases.get(" ".join(words[a:b]), ()):
                    want.add((r, i, "equal" if b - a == len(words) else "contains"))
    whole = {tuple(r) for r in phrase_matches(d, "row", "t", bank, "item", "p").collect()}
    assert whole == want and len(want) > 1000
    assert {tuple(r) for r in phrase_matches(d, "row", "t", bank, "item", "p", block_chars=20_000).collect()} == want
    assert phrase_matches(d, "row", "t", bank.limit(0), "item", "p").count() == 0


def test_copied_passages_of_every_length_and_a_giant_respondent(spark):
    rng = random.Random(6)
    rows = []
    for who in [1] * 300 + [2, 3, 4, 5] * 25:
        words = [f"word{rng.randrange(30)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 40]))]
        if rows and rng.random() < 0.4:
            other = rng.choice([r[2] for r in rows if r[0] == who] or ["x"]).split()
            a = rng.randrange(len(other))
            words = other[a : a + rng.randrange(1, 30)] if rng.random() < 0.5 else words + other
        rows.append((who, len(rows), " ".join(words)))
    rows += [(9, 1, None), (9, 2, ""), (9, 3, "a single long answer")]
    got = {r[0]: tuple(r)[1:] for r in T.copied_across_fields(spark.createDataFrame(rows, "id long, pos long, t string").repartition(5), "id", "pos", "t").collect()}
    for who in (1, 2, 3, 4, 5):
        mine = [r[2] for r in rows if r[0] == who]
        equal = sum(1 for t in mine if mine.count(t) > 1 and len(t) > 5)
        inside = sum(1 for t in mine if len(t) > 10 and any(len(o) > len(t) and f" {t} " in f" {o} " for o in mine))
        assert got[who] == (len(mine), equal, inside, int(equal > 0 or inside > 0))
    assert got[9] == (1, 0, 0, 0)


def test_classes_of_chains_stars_and_pairs(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, j) for j in range(501, 560)] + [(7, 7), (3, 2), (2, 3)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)]
    parent = {}

    def find(u):
        parent.setdefault(u, u)
        while parent[u] != u:
            u = parent[u]
        return u

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    d = spark.createDataFrame([*links, (None, 5), (6, None)], "a long, b long")
    assert {tuple(r) for r in linked_classes(d, "a", "b").collect()} == {(u, find(u)) for u in list(parent)}


def test_answer_sets_with_a_hot_token_and_small_sets(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_ROWS", 5)
    rng = random.Random(9)
    sets = {f"r{i:03}": [1] * (i % 3 == 0) + [rng.randrange(2, 14) for _ in range(rng.randrange(0, 7))] for i in range(150)} | {"r900": None, "r901": [1], "r902": [1]}
    d = spark.createDataFrame(list(sets.items()), "id string, s array<long>").repartition(4)
    plain = {k: frozenset(v or ()) for k, v in sets.items()}
    linked = {k: {o for o in plain if o != k and plain[k] and plain[o] and len(plain[k] & plain[o]) >= 0.7 * len(plain[k] | plain[o])} for k in plain}
    for r in S.answer_set_clusters(d, "id", "s", 0.7).collect():
        seen, todo = {r["id"]}, [r["id"]]
        while todo:
            for o in linked[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        equal = sum(1 for o in plain if o != r["id"] and plain[o] and plain[o] == plain[r["id"]])
        assert tuple(r) == (r["id"], len(plain[r["id"]]), equal, len(linked[r["id"]]), min(seen), len(seen))


def test_every_text_comes_back_and_a_token_of_a_third(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_ROWS", 8)
    rng = random.Random(10)
    base = [" ".join(f"w{rng.randrange(50)}" for _ in range(12)) for _ in range(12)]
    texts = ["we all say this here " + rng.choice(base) if i % 3 == 0 else rng.choice(base) + f" and {rng.randrange(5)} more words" for i in range(90)]
    texts += ["short", "", None, "onlyoneverylongwordwithoutspace", "onlyoneverylongwordwithoutspace", "twoverylongwords andanotherlongone", base[0], base[0]]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    got = {r["id"]: r for r in S.near_duplicates(d, "id", "t").collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}

    compared = {i: t for i, t in enumerate(texts) if t and len(t) > 20}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        near = [o for o, u in compared.items() if o != i and i in compared and (u == t or len(grams(u) & grams(t)) > 0.6 * len(grams(u) | grams(t)))]
        assert got[i]["n_similar"] == len(near), (i, t)


# --- forest, bootstrap, relations, judgments --------------------------------------------------------------


def test_forest_grows_the_same_trees_over_exactly_the_sample(spark):
    rng = np.random.default_rng(7)
    rows = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(900, 2)))] + [("far", 40.0, -40.0), ("none", None, None)]
    d = spark.createDataFrame(rows, "id string, a double, b double")
    one = I.grow_forest(d.na.fill(0.0), "id", ["a", "b"], trees=12, sample=64, seed=3).orderBy("tree", "node").collect()
    two = I.grow_forest(d.na.fill(0.0).repartition(7), "id", ["a", "b"], trees=12, sample=64, seed=3).orderBy("tree", "node").collect()
    assert one == two
    roots = [r for r in one if r["node"] == 0]
    assert len(roots) == 12 and {r["rows"] for r in roots} == {64}
    for t in range(12):
        nodes = {r["node"]: r for r in one if r["tree"] == t}
        assert all(n["rows"] == nodes[n["below"]]["rows"] + nodes[n["below"] + 1]["rows"] for n in nodes.values() if n["feature"] >= 0)
    scores = {r["id"]: r["iso_score"] for r in I.isolation_scores(d, "id", ["a", "b"], trees=30, sample=64).collect()}
    assert len(scores) == 902 and max(scores, key=scores.get) == "far" and 0 < min(scores.values()) < 0.5 < scores["far"] <= 1
    assert I.isolation_scores(d.limit(0), "id", ["a", "b"]).count() == 0


def test_depths_in_a_tree_made_by_hand():
    tree = {"feature": np.array([0, -1, 1, -1, -1]), "cut": np.array([5.0, 0, 2.0, 0, 0]), "below": np.array([1, -1, 3, -1, -1]), "rows": np.array([6, 1, 5, 1, 4])}
    tree["rest"] = np.array([I.expected_depth(n) if f < 0 else 0.0 for f, n in zip(tree["feature"], tree["rows"])])
    depths = I.path_depths(tree, np.array([[4.9, 0], [5.0, 1.9], [5.0, 2.0]]))
    assert np.allclose(depths, [1, 2, 2 + I.expected_depth(4)])


def test_poisson_draws_have_the_right_mean_and_spread(spark):
    table = {r["m"]: r["cdf"] for r in E.poisson_table(spark).collect()}
    assert all(abs(c[-1] - 1) < 1e-12 and all(b >= a for a, b in zip(c, c[1:])) for c in table.values())
    rows = [(i % 7 / 10, int(i % 3 == 0), int(i % 5 == 0)) for i in range(3000)]
    d = spark.createDataFrame(rows, "s double, y int, p int")
    out = {r["metric"]: r for r in E.bootstrap(d, "s", "y", "p", resamples=200).collect()}
    accuracy = sum(y == p for _, y, p in rows) / len(rows)
    spread = 1.96 * math.sqrt(accuracy * (1 - accuracy) / len(rows))
    got = out["accuracy"]
    assert abs(got["mean"] - accuracy) < spread / 3
    assert abs((got["ci_high"] - got["ci_low"]) / 2 - spread) < 0.2 * spread
    assert sorted(out) == sorted(["accuracy", "balanced_accuracy", "precision", "recall", "macro_f1", "mcc", "auroc", "auprc"])


def test_relations_over_gaps_families_and_giants(spark):
    rng = random.Random(12)
    families = [*P.FAMILY_RELATIONS, "survey response chain", None]
    rows = [(who, pos, rng.choice(families)) for who in (1, 2, 3) for pos in rng.sample(range(1000), 40)] + [(4, 5, families[0]), (None, 1, families[0]), (5, None, families[0])]
    d = spark.createDataFrame(rows, "id long, pos long, f string").repartition(4)
    want = set()
    for who in (1, 2, 3):
        mine = sorted((p, f) for w, p, f in rows if w == who)
        last = {}
        for i, (p, f) in enumerate(mine):
            if i:
                want.add((who, mine[i - 1][0], p, P.SEQUENTIAL))
            if f in last:
                want.add((who, last[f], p, P.FAMILY_RELATIONS.get(f, P.ANY_FAMILY)))
            if f is not None:
                last[f] = p
    for hot in (100_000, 5):  # the second makes every respondent a giant
        assert {tuple(r) for r in P.relation_edges(d, "id", "pos", "f", hot_rows=hot).collect()} == want


def test_judgments_of_both_layouts_with_broken_lines_and_evidence(spark, tmp_path):
    good = lambda i, e: json.dumps({"id": f"r{i}", "v": i, "evidence": e})
    (tmp_path / "a.json").write_text(good(1, '{"chars": 5, "families": ["x"]}') + "\n{broken\n" + good(2, "no json") + "\n" + good(3, None) + "\n")
    deep = tmp_path / "more"
    deep.mkdir()
    (deep / "b.array").write_text(json.dumps([{"id": "r4", "v": 4, "evidence": '{"chars": 6}'}, {"id": "r5", "v": 5}], indent=2))
    (deep / "c.array").write_text("[ not json")
    read = IO.load_judgments(spark, str(tmp_path), "id string, v int, evidence string", "*.json", "*.array", "evidence", "chars int, families array<string>")
    rows = {r["id"]: r for r in read.collect() if r["id"]}
    assert sorted(rows) == ["r1", "r2", "r3", "r4", "r5"]
    assert rows["r1"]["evidence"]["chars"] == 5 and rows["r1"]["evidence"]["families"] == ["x"] and rows["r4"]["evidence"]["chars"] == 6
    assert [rows[f"r{i}"]["evidence_bad"] for i in range(1, 6)] == [False, True, False, False, False]
    assert rows["r1"]["chunk_file"] == "a.json" and rows["r5"]["chunk_file"] == "b.array"
    assert sorted(r["chunk_file"] for r in read.where("corrupt_record IS NOT NULL").collect()) == ["a.json", "c.array"]


# --- texts ------------------------------------------------------------------------------------------------


def test_contact_details_in_linear_time_equal_the_pattern(spark):
    """A text of very many numbers took time with the square of its length."""
    import time

    from respondex.functions import lexicons as L
    from respondex.functions import text as X
    from respondex.operators import text_signals as T

    rng = random.Random(4)
    parts = ["12", "123", "12345", "123456", "main", "st", "street", "a@b.co", "@", "x.y@z", "ave", "avenues", ",", ".", "#", " ", " ", "é", "dr", "'", "-", "0", "first"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(4000)] + ["12 main st", "123 st", "1234  st", "x 123 4 rd", "a@b.c", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.norm(F.col("t")).alias("t"))
    got = df.select("t", T.contact_details(F.col("t")).alias("now"), F.col("t").rlike(L.CONTACT_PATTERN).alias("want")).collect()
    assert [r for r in got if r["now"] != r["want"]] == []
    assert {r["want"] for r in got} == {True, False}
    long_ = spark.range(1).select(F.concat(F.repeat(F.lit("1234 abc "), 30_000), F.lit(",x")).alias("t"))
    start = time.time()
    assert not long_.select(T.misplaced(F.col("t"), "(^| )the( |$)").alias("m")).first()["m"]
    assert time.time() - start < 20


def test_copied_answers_are_found_in_one_task_as_by_joins(spark):
    rng = random.Random(16)
    rows = [(None if i % 50 == 7 else i % 23, i, " ".join(f"{'ab' * 3}{rng.randrange(4)}" for _ in range(rng.choice([0, 1, 2, 3, 6, 18])))) for i in range(900)]
    d = spark.createDataFrame([*rows, (30, 1, None), (31, 1, "Élan vitale élan"), (31, 2, "élan  vitale")], "id long, pos long, t string").repartition(6)
    in_task = T.copied_across_fields(d, "id", "pos", "t")
    by_joins = {tuple(r) for r in T.copied_across_fields(d, "id", "pos", "t", most_chars=0).collect()}
    assert {tuple(r) for r in in_task.collect()} == by_joins and len(by_joins) == 25
    assert (31, 2, 0, 1, 1) in by_joins
    plan = T.copied_across_fields(d.where("id IS NOT NULL"), "id", "pos", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2  # the test's own repartition, and answers by respondent
