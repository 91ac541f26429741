"""TF-IDF: no (row, term) pairs travel, and repeated and null ids, whole pieces and large vocabularies give the same weights."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from respondex.operators import term_weights
from respondex.operators import text_signals as T

SCHEMA = "id long, text string"


def texts():
    made = [(i, " ".join(f"word{(i * 7 + j * j) % 23}" for j in range(i % 40))) for i in range(120)]
    return [*made, (5, "word1 word2 word2 other"), (5, None), (6, ""), (None, "word1 word3"), (None, "word3"), (900, None)]


def brute(rows, terms_of, min_df, max_df):
    tf = collections.defaultdict(collections.Counter)
    for i, t in rows:
        tf[i].update(terms_of(t or ""))
    df = collections.Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items() if min_df <= n <= max_df * len(rows)}
    out = {}
    for i, c in tf.items():
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(i, t): (c[t], x / norm) for t, x in w.items() if i is not None}
    return out


def pairs_of(text):
    words = text.split()
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("most", [term_weights.MOST_LOOKUP, 0])
def test_weights_equal_brute_force(spark, most):
    d = spark.createDataFrame(texts(), SCHEMA)
    got = term_weights.weigh_terms(d, "id", T.word_terms(F.col("text")), 3, 0.8, max_lookup=most).collect()
    want = brute(texts(), pairs_of, 3, 0.8)
    assert len(got) == len(want)
    assert {(r["id"], r["term"]): r["tf"] for r in got} == {k: n for k, (n, _) in want.items()}
    assert {(r["id"], r["term"]): r["tfidf"] for r in got} == pytest.approx({k: x for k, (_, x) in want.items()})


def test_pieces_end_with_a_document(monkeypatch):
    monkeypatch.setattr(term_weights, "PIECE_TERMS", 3)
    n = [0, 0, 1, 2, 2, 2, 2, 2, 3, 4, 5, 5, 7]
    rows = pa.RecordBatch.from_arrays([pa.array(n), pa.array([-i for i in n]), pa.array([f"t{k % 2}" for k in range(len(n))])], names=["_n", "id", "term"])
    for step in (1, 2, 5, 13):
        pieces = [p.column(0).to_pylist() for p in term_weights._documents(iter([rows.slice(i, step) for i in range(0, len(n), step)]))]
        assert sum(pieces, []) == n and all(a[-1] < b[0] for a, b in zip(pieces, pieces[1:]))
        assert step == 13 or len(pieces) > 1
    doc, term, times, names, ids = term_weights._counted(rows)
    assert ids.to_pylist() == [0, -1, -2, -3, -4, -5, -7] and times.sum() == len(n)
    assert [(int(d), names[int(t)].as_py(), int(c)) for d, t, c in zip(doc, term, times)][3:5] == [(2, "t0", 2), (2, "t1", 3)]


def test_digests_are_those_of_spark_and_nothing_is_shuffled(spark):
    d = spark.createDataFrame([(i, f"grün {'ab' * (i % 9)} x𝔸y") for i in range(60)], "name long, text string").withColumn("name", F.concat(F.lit("r"), "name"))
    out = T.tfidf(d, "name", T.char_terms(F.col("text"), 3, 5), 2, 1.0)
    got = out.collect()
    assert {r["term"] for r in got} >= {" gr", "grün ", " x𝔸y ", "baba"} and len({r["name"] for r in got}) == 60
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_tables_without_rows_or_terms(spark):
    d = spark.createDataFrame(texts(), SCHEMA)
    for none in (d.limit(0), d.where("text IS NULL")):
        assert T.tfidf(none, "id", T.word_terms(F.col("text")), 1, 1.0).collect() == []


def test_terms_made_of_words_are_those_of_the_columns(spark):
    """Pairs and character n-grams are made where the words are read, and no array of them is laid out before."""
    d = spark.createDataFrame([*texts(), (901, "Grün 𝔸b c über_9 x"), (902, "a a a")], SCHEMA)
    for terms, min_df in ((T.word_terms(F.col("text")), 2), (T.char_terms(F.col("text"), 3, 5), 1)):
        made = T.tfidf(d, "id", terms, min_df, 1.0)
        laid_out = T.tfidf(d, "id", terms.column, min_df, 1.0)
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, laid_out.collect()))
        unique = d.where("id IS NOT NULL AND id NOT IN (5, 6)")
        assert "substring" not in T.tfidf(unique, "id", terms, min_df, 1.0)._jdf.queryExecution().executedPlan().toString()


def test_the_vocabulary_comes_in_slices(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(term_weights, "SLICE_TERMS", 7)
    words = spark.createDataFrame([(f"w{i}", float(i)) for i in range(100)], "term string, idf double")
    collect = type(words).toArrow
    monkeypatch.setattr(type(words), "toArrow", lambda self: taken.append(collect(self)) or taken[-1])
    digest, idf = term_weights._lookup(words, 100)
    want = sorted((r[0], r[1]) for r in words.select(F.xxhash64("term"), "idf").collect())
    assert list(zip(digest.tolist(), idf.tolist())) == want
    assert len(taken) == 15 and max(t.num_rows for t in taken) < 30


def test_weights_are_rounded_as_spark_rounds_them(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(5000), rng.integers(1, 10**7, 3000) / 10**7, (rng.integers(1, 10**6, 500) + 0.5) / 10**6, 1 / 2.0 ** np.arange(30), [0.0, 1.0]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert term_weights._rounded(x, 6).tolist() == want
