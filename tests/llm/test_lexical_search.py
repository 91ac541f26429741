"""Reversed lexical search: SQL, brute force, blocks of items, ties and odd inputs."""

import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd

from respondex.llm import queries as Q
from respondex.llm.lexical_search import search_items, search_sql, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def cut(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k):
    """[(item, rank, doc, score)] by the formula, with Python's integers."""
    counts = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in cut(text) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc if doc is not None else 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return out


def rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "中文", "a1", "x_y", "don't", "foo-bar", "...", "№5", "rare"] + [f"w{i}" for i in range(60)]
    text = lambda m: " ".join(rng.choice(words[: rng.randrange(1, len(words))]) for _ in range(rng.randrange(m)))
    docs = [(i, text(80)) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!!! --"), (n + 3, "w1 " * 50_000), (n + 4, docs[5][1]), (n + 5, docs[5][1]), (None, docs[6][1])]
    items = [(i, text(30)) for i in range(25)] + [(25, None), (26, "nowhere found"), (27, "rare rare rare the"), (27, "rare"), (None, "w3 w4"), (28, docs[5][1])]
    return docs, items


def test_equals_brute_force_in_one_index_and_in_many(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, text string, n int, terms string, item int").repartition(7)
    i = spark.createDataFrame([(*r, 9.0, "y") for r in items], "item_id long, text string, score double, doc_id string")
    want = sorted(brute(docs, items, 20), key=str)
    assert rows(search_items(d, i)) == want
    assert rows(search_items(d, i, index_entries=30)) == want
    assert rows(search_items(d, i, k=3)) == sorted(brute(docs, items, 3), key=str)


def test_ties_go_by_id_of_any_type_across_tasks(spark):
    docs = [(f"d{i:03}", "same words here") for i in range(90)] + [("zz", "other text")]
    d = spark.createDataFrame(random.Random(3).sample(docs, len(docs)), "doc_id string, text string").repartition(9)
    got = search_items(d, spark.createDataFrame([("q", "WORDS words other")], "item_id string, text string"), k=10)
    assert rows(got) == sorted(brute(docs, [("q", "WORDS words other")], 10), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search_items(docs.limit(0), items).count() == 0
    empty = search_items(docs, items.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
    assert search_items(spark.createDataFrame([(1, "!?")], docs.schema), items).count() == 0


def test_terms_are_cut_like_the_pattern():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128), rng.randrange(0x2FF), 0x85, 0xA0, 0x2028, 0x1F600])) for _ in range(40))
        assert [t.decode() for t in terms(text)] == cut(text)


def test_registered_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = Q.op13_lexical_search(spark, sf)
    want = con.execute(search_sql()).fetchall()
    assert rows(got) == sorted(want, key=str) and len(want) > 300
    docs, items = (pd.read_parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    assert rows(got) == sorted(brute(list(zip(docs.doc_id.tolist(), docs.text)), list(zip(items.item_id.tolist(), items.text)), 20), key=str)
