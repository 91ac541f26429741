"""The helpers that keep giant groups out of single tasks give the plain result, hot groups included."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from respondex.functions import ranking as R
from respondex.functions import sequences as Q
from respondex.operators import matrix as M
from respondex.operators import metric_tree as MT
from respondex.operators import neighbours as N
from respondex.operators import similarity as S


@pytest.fixture(scope="module")
def rows(spark):
    """Group a holds most rows and one value of it holds a third of all."""
    rng = np.random.default_rng(1)
    data = []
    for i in range(3000):
        g = "a" if i % 10 < 8 else "bcdef"[i % 5]
        v = 0.25 if i % 3 == 0 else float(np.round(rng.normal(0, 100) ** 3 / 1e4, 4))
        data.append((i, g, v, None if i % 97 == 0 else i % 4))
    return spark.createDataFrame(data, "id long, g string, v double, k int").cache()


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_order_bucket_is_monotone(spark):
    vals = sorted([-1e9, -3.5, -1.0, -1e-12, 0.0, 1e-12, 0.1, 0.2, 0.9999999, 1.0, 1.0000001, 7.999999999999999, 8.0, 1e15])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in vals], "v double").select(R.order_bucket(F.col("v"))).collect()]
    assert got == sorted(got)


def test_positions_equal_row_number(rows):
    for desc in (False, True):
        got = R.positions(rows, ["g"], "v", "id", descending=desc, out="p").select("id", "p")
        order = F.col("v").desc() if desc else F.col("v")
        want = rows.select("id", F.row_number().over(W.partitionBy("g").orderBy(order, "id")).cast("long").alias("p"))
        same(got, want)


def test_positions_without_groups(rows):
    got = R.positions(rows, [], "v", "id", out="p").select("id", "p")
    same(got, rows.select("id", F.row_number().over(W.orderBy("v", "id")).cast("long").alias("p")))


def test_quantiles_equal_percentile(rows):
    got = R.quantiles(rows, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()
    want = {r["g"]: r for r in rows.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in (("a", 0.1), ("b", 0.5), ("c", 0.99))]).collect()}
    for r in got:
        for n in "abc":
            assert r[n] == pytest.approx(want[r["g"]][n], abs=1e-9)


def test_group_stats_with_hot_and_null_keys(rows):
    got = R.with_group_stats(rows, ["k"], "id", n=F.count(F.lit(1)), m=F.max("v")).select("id", "n", "m")
    w = W.partitionBy("k")
    same(got, rows.select("id", F.count(F.lit(1)).over(w).alias("n"), F.max("v").over(w).alias("m")))


def test_group_stats_when_no_key_is_hot(spark):
    d = spark.range(5000).select("id", (F.col("id") % 2500).alias("k"))
    assert R.with_group_stats(d, ["k"], "id", n=F.count(F.lit(1))).where("n <> 2").count() == 0


def test_ordered_hot_respondents_take_the_block_way(spark, rows, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 64)
    src = rows.select("g", F.when(F.col("id") % 7 != 0, F.col("v")).alias("v"), "id", F.coalesce("k", F.lit(9)).alias("k"))
    plain = Q.ordered(src, "g", "v", "id", "k", hot_rows=10**9)
    hot = Q.ordered(src, "g", "v", "id", "k", hot_rows=50)
    cols = ["g", "k", "pos", "n", "prev1", "prev2", "run_id"]
    same(plain.select(*cols), hot.select(*cols))


def test_run_lengths_and_ngrams_agree_on_both_ways(rows, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 64)
    src = rows.withColumn("k", F.coalesce("k", F.lit(9)))
    same(M.run_lengths(src, "g", "v", "id", "k", 10**9), M.run_lengths(src, "g", "v", "id", "k", 50))
    same(M.ngram_diversity(src, "g", "v", "id", "k", 10**9), M.ngram_diversity(src, "g", "v", "id", "k", 50))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.3, (60, 4)) for c in (0, 2, 5)] + [np.zeros((30, 4))])
    return x, spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>").cache()


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_nearest_equals_brute_force_with_small_blocks(vectors, monkeypatch, metric):
    monkeypatch.setattr(MT, "BLOCK_ROWS", 16)
    monkeypatch.setattr(MT, "CHUNK_ROWS", 8)
    x, df = vectors
    d = np.abs(x[:, None] - x[None]).sum(2) if metric == "l1" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in N.nearest(df, df, "id", "v", 3, metric).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["dist"]))
    assert len(got) == len(x)
    for i, rs in got.items():
        want = np.sort(d[i])[:3]
        # l2 goes through a matrix product: equal points come out within 1e-6 of 0
        assert [v for _, v in sorted(rs)] == pytest.approx(list(want), abs=1e-6)


def test_count_within_equals_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(MT, "BLOCK_ROWS", 16)
    monkeypatch.setattr(MT, "CHUNK_ROWS", 8)
    x, df = vectors
    d = np.abs(x[:, None] - x[None]).sum(2)
    got = {r["query"]: r["n_within"] for r in N.count_within(df, df, "id", "v", 0.9, "l1").collect()}
    assert got == {i: int((np.round(d[i], 9) <= 0.9).sum()) for i in range(len(x))}


def test_nearest_stays_in_group_and_handles_empty_base(vectors):
    _, df = vectors
    g = df.withColumn("g", F.pmod("id", F.lit(2)))
    out = N.nearest(g, g, "id", "v", 2, "l1", "g").collect()
    assert all(r["query"] % 2 == r["neighbour"] % 2 for r in out)
    assert N.nearest(df, df.limit(0), "id", "v", 2).count() == 0


@pytest.mark.parametrize("common", [1, 5, 1000])
def test_similarity_join_equals_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(S, "COMMON_TOKENS", common)
    rng = np.random.default_rng(3)
    sets = [sorted(set(rng.integers(0, 25, rng.integers(1, 14)).tolist()) | {0}) for _ in range(120)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, s array<long>").cache()
    got = {(r["a"], r["b"]): round(r["similarity"], 9) for r in S.set_similarity_join(df, "id", "s", 0.6).collect()}
    want = {}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            sim = len(set(a) & set(sets[j])) / len(set(a) | set(sets[j]))
            if sim >= 0.6:
                want[(i, j)] = round(sim, 9)
    assert got == want


def test_near_duplicates_count_copies_without_pairing_them(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(i, base) for i in range(40)] + [(100, base + " nu"), (101, "short"), (102, "one two three four five six seven eight nine")]
    out = {r["id"]: r for r in S.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert out[0]["n_similar"] == 40 and out[0]["max_similarity"] == 1.0
    assert out[100]["n_similar"] == 40 and out[100]["similar_to"] == "0"
    assert out[101]["n_similar"] == 0 and out[101]["copies"] == 1 and out[102]["n_similar"] == 0  # short texts come back, not compared


def test_zero_vectors_keep_their_row(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in rng.normal(size=4)] for _ in range(30)] + [[0.0] * 4, None]
    d = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    got = {r["id"]: r for r in N.knn_features(d, "id", "v", k=3).collect()}
    assert sorted(got) == list(range(32))
    assert all(got[i]["graph_degree"] == 0 and got[i]["graph_mean_dist"] is None for i in (30, 31))
    assert all(got[i]["graph_mean_dist"] is not None for i in range(30))


def test_stamps_of_one_month_spread_over_many_cells_and_rank_the_same(spark):
    d = spark.range(100_000).select(
        F.lit("a").alias("g"), "id", (F.lit(1_700_000_000_000_000) + F.col("id") * 25_920_000 + F.pmod(F.xxhash64("id"), F.lit(1000))).alias("t")
    )
    spread = d.withColumn("_bucket", R.order_bucket(F.col("t")))
    assert spread.select("_bucket").distinct().count() < 10  # what the logarithm of the value alone would give
    ranges = spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    cells = spread.join(ranges, "_bucket").groupBy("_bucket", R.cell_of(F.col("t"), F.col("n"), F.col("a"), F.col("b"), 500).alias("cell")).count()
    assert cells.count() >= 150 and cells.agg(F.max("count")).first()[0] <= 1500
    same(R.ranked_values(d.limit(20_000), ["g"], "t", narrow=True, limit=500), R.ranked_values(d.limit(20_000), ["g"], "t"))
    plain = d.limit(5000).withColumn("position", F.row_number().over(W.partitionBy("g").orderBy("t", "id")).cast("long"))
    same(R.positions(d.limit(5000), ["g"], "t", "id", narrow=True).select(*plain.columns), plain)


def test_bit_maps_never_part_similar_sets_and_part_unlike_ones(spark):
    """Pairs of sets are told apart by their bit maps before the sets move, whatever their sizes."""
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 7, 300, 512, 513, 900, 2000):
        base = rng.integers(-(2**62), 2**62, n)
        near = np.concatenate([base[: max(1, n * 4 // 5)], rng.integers(-(2**62), 2**62, n // 9)])
        sets += [base, near, rng.integers(-(2**62), 2**62, n)]
    rows = [(i, [int(x) for x in s], len(s)) for i, s in enumerate(sets)]
    maps = S._sketched(spark.createDataFrame(rows, "id int, s array<bigint>, n int")).select("id", "f", "w")
    pairs = maps.toDF("a", "fa", "wa").join(maps.toDF("b", "fb", "wb"), F.col("a") < F.col("b"))
    far = 0
    for r in pairs.select("a", "b", S._unlike("fa", "fb").alias("f"), S._unlike_wide("wa", "wb").alias("w")).collect():
        a, b = set(sets[r["a"]].tolist()), set(sets[r["b"]].tolist())
        assert r["f"] <= len(a ^ b) and r["w"] <= len(a ^ b)
        if not a & b and 0.6 <= len(a) / len(b) <= 1 / 0.6 and len(a) > 1:
            assert r["w"] > 0.25 * (len(a) + len(b))
            far += 1
    assert far > 10


def test_queries_are_sent_once_to_a_node_and_in_slices(spark):
    """Vectors without structure visit every leaf: lines grow with nodes, and no task holds all bounds at once."""
    x = np.random.default_rng(8).normal(size=(400, 12))
    base = spark.createDataFrame([(0, i, v.tolist(), 1) for i, v in enumerate(x)], "_g int, _b long, _bv array<double>, _n long").cache()
    tree = MT.MetricTree(base, "l2")
    cells = tree.pivots.cells[0]
    asked = base.select("_g", F.col("_b").alias("_q"), F.col("_bv").alias("_qv"), F.lit(float("inf")).alias("_radius"))
    lines = tree.plan(asked, lambda cells, low, high, part: np.nonzero(low < np.inf)).cache()
    assert lines.count() == 400 * len(np.unique(cells.node)) < 400 * len(cells.leaf)
    assert MT.leaves_of(lines) == 400 * len(cells.leaf)
    part = asked.toPandas()
    slices = list(MT.limited(part, MT.Cells(*[np.arange(MT.MOST_BOUNDS // 100)] * 6)))
    assert [len(s) for s in slices] == [100] * 4


@pytest.mark.parametrize("threshold,beyond", [(0.5, 0), (0.7, 6)])
def test_packed_prefixes_blocks_and_tiles_equal_brute_force(spark, monkeypatch, threshold, beyond):
    """Many buckets, classes cut into blocks, tokens cut into tiles, rows that come twice, ids of any sign."""
    for name, value in (("BUCKET_TOKENS", 300), ("CELL_TOKENS", 60), ("TILE_ROWS", 6), ("COMMON_TOKENS", 8)):
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(6)
    sets = {int(i): sorted({int(x) * 7**19 % 2**61 for x in rng.integers(0, 13, rng.integers(1, 14))} | ({5} if i % 3 else set())) for i in rng.integers(-(2**60), 2**60, 150)}
    d = spark.createDataFrame([*sets.items(), *list(sets.items())[:40]], "id long, s array<long>").repartition(5)
    got = [(r["a"], r["b"], round(r["similarity"], 9)) for r in S.set_similarity_join(d, "id", "s", threshold, beyond).collect()]
    want = []
    for a in sets:
        for b in sets:
            sim = len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
            if a < b and sim >= threshold and max(len(sets[a]), len(sets[b])) > beyond:
                want.append((a, b, round(sim, 9)))
    assert sorted(got) == sorted(want) and len(want) > 30


def test_near_copies_move_digests_and_prefixes_not_sets(spark, monkeypatch):
    kept = []
    keep = S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: kept.append((name, df.schema.simpleString())) or keep(df, name))
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[i % 5 :] + [f"x{i}"]) for i in range(20)] + ["Ärger über ölige Öfen, 1 2 3"] * 3 + [None, "!!! ??? ... ,,, ;;; :::"]
    got = {r["id"]: r for r in S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4), "id", "t").collect()}
    assert len(got) == 25 and got[0]["n_similar"] == 19 and got[21]["copies"] == 3 and got[21]["n_similar"] == 2 and got[24]["n_similar"] == 0
    assert {n for n, _ in kept} == {"text-keys", "set-maps", "set-pairs", "likely-pairs", "near-copies"}
    assert not any("string" in s or ("array" in s and n != "set-maps") for n, s in kept)


@pytest.mark.parametrize("threshold,most", [(0.7, 10**9), (0.5, 10**9), (0.7, 4)])
def test_small_answer_sets_make_no_pairs(spark, monkeypatch, threshold, most):
    """Few tokens make every set like many others: they are counted and tied by their subsets, and only larger sets make pairs."""
    if most == 4:
        monkeypatch.setattr(S, "MOST_SUBSETS", most)
    else:
        monkeypatch.setattr(S, "set_similarity_join", None)
    rng = np.random.default_rng(7)
    size = max(S._subset_sizes(threshold))
    sets = [sorted(set(rng.integers(0, 11, rng.integers(0, (12 if most == 4 else size) + 1)).tolist())) for _ in range(260)]
    sets = [s[:size] if most > 4 else s for s in sets]
    got = {r["id"]: tuple(r)[1:] for r in S.answer_set_clusters(spark.createDataFrame(list(enumerate(sets)), "id long, s array<long>").repartition(4), "id", "s", threshold).collect()}
    like = [[j for j, t in enumerate(sets) if j != i and s and t and len(set(s) & set(t)) >= threshold * len(set(s) | set(t)) - 1e-9] for i, s in enumerate(sets)]
    for i, s in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            for o in like[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        equal = sum(1 for j, t in enumerate(sets) if j != i and s and t == s)
        assert got[i] == (len(s), equal, len(like[i]), min(seen), len(seen))


def test_vectors_go_through_one_shuffle_and_no_line_is_written_for_a_visit(spark, monkeypatch):
    """Unstructured vectors prune nothing; what is kept grows with rows, not with visits, and blocks go when the answers are there."""
    monkeypatch.setattr(MT, "BLOCK_ROWS", 32)
    monkeypatch.setattr(MT, "CHUNK_ROWS", 64)
    kept, gone = [], []
    keep, drop = MT.stored, MT.discard
    monkeypatch.setattr(MT, "stored", lambda df, name, *path: kept.append((name, keep(df, name, *path))) or kept[-1][1])
    monkeypatch.setattr(MT, "discard", lambda spark, path: gone.append(path) or drop(spark, path))
    x = np.random.default_rng(9).normal(size=(300, 10))
    x[200:220] = x[5]
    ids = [f"q{i:03}" for i in range(300)]
    d = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, v array<double>").repartition(3)
    near = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    got = {}
    for r in N.nearest(d, d, "id", "v", 3).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
    for i in range(300):
        assert [n for _, n in sorted(got[ids[i]])] == [ids[j] for j in sorted((j for j in range(300) if j != i), key=lambda j: (near[i, j] if x[i].tolist() != x[j].tolist() else 0.0, j))[:3]]
    blocks, answers = (table for _, table in kept)
    assert [n for n, _ in kept] == ["metric-blocks", "metric-answers"] and len(gone) == 1
    assert answers.count() == 300 and answers.agg(F.sum("_visits")).first()[0] > 5 * 300
    counts = {r["query"]: r["n_within"] for r in N.count_within(d, d, "id", "v", 3.1).collect()}
    assert counts == {ids[i]: int((near[i] <= 3.1).sum()) for i in range(300)} and len(gone) == 2
