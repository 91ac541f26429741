"""Whitening: eigenvectors against known ones, whole results against numpy, odd vectors."""

import math
from decimal import Decimal

import numpy as np
import pytest

from respondex.llm import queries as Q
from respondex.llm.whitening import refined_eigenvectors, whiten_vectors

SPECTRA = {
    "spread": 10.0 ** np.linspace(3, -3, 40),
    "clusters": np.concatenate([1 + 1e-9 * np.arange(8), 2 + 1e-13 * np.arange(8), 3 + 1e-5 * np.arange(8), np.linspace(4, 9, 16)]),
    "equal": np.repeat([5.0, 4, 3, 1], 10),
    "flat": 1 + 1e-6 * np.random.default_rng(4).random(40),
    "low rank": np.concatenate([np.arange(1.0, 5), np.zeros(36)]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors_of_every_kind_of_spectrum(name):
    true = np.sort(SPECTRA[name])[::-1].astype(np.longdouble)
    d = len(true)
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d) - 0.5 * (q.T @ q))
    a = (q * true) @ q.T
    a = (a + a.T) / 2
    values, vectors = refined_eigenvectors(a)
    eps = float(np.finfo(np.longdouble).eps)
    size = float(np.abs(true).max())
    assert np.abs(a @ vectors - vectors * values).max() < 200 * d * eps * size
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 200 * d * eps
    assert np.abs(values - true).max() < 200 * d * eps * size
    alone = [i for i in range(d) if all(abs(true[i] - true[j]) > 1e-4 * size for j in range(d) if j != i)]
    for i in alone:
        assert 1 - abs(float(q[:, i] @ vectors[:, i])) < 1e-15


def test_float32_alone_would_not_do():
    true = np.linspace(1, 2, 30)
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(30, 30)))[0]
    a = (q * true) @ q.T
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    assert np.abs(start.T @ a @ start - np.diag(true)).max() > 1e-8
    values, vectors = refined_eigenvectors(a)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-15


def brute(rows, components=16):
    """{id: sorted [(component, n, deviation, |whitened|, explained)]}, by numpy in double precision, one length of vectors."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.int64)
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    mean = np.array([s / n for s in total])
    cov = (fit - mean).T @ (fit - mean) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > np.trace(cov) * len(e) * 1e-13).sum()))
    return [
        (i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, total)), abs(float((np.array(x) - mean) @ v[:, c]) / math.sqrt(e[c])), float(e[c] / np.trace(cov)))
        for i, x in kept for c in range(k)
    ]


def plain(frame):
    return [(r[0], r["component"], r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"]) for r in frame.collect()]


def agree(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], round(r[4], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-8, atol=1e-8)


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(f"v{i}", [float(x) for x in rng.normal(size=20) * np.linspace(1, 5, 20)]) for i in range(300)]
    rows += [("same", rows[0][1])] * 150 + [(None, rows[1][1])]
    return rows, [("null", None), ("hole", [1.0] * 19 + [None]), ("nan", [float("nan")] * 20), ("inf", [float("-inf")] * 20), ("empty", [])]


def test_equals_brute_force_with_repeats_nulls_and_clashing_names(spark):
    rows, bad = odd_rows()
    frame = spark.createDataFrame([(*r, "a", 1, "b") for r in rows + bad], "vec_id string, embedding array<double>, _x string, component int, _vec string").repartition(5)
    got = whiten_vectors(frame)
    agree(plain(got), brute(rows))
    signed = {}
    for r in got.collect():
        signed.setdefault((r["component"], r["deviation"], round(abs(r["whitened"]), 9)), set()).add(r["whitened"] > 0)
        assert r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signed.values())  # equal vectors, equal signs


def test_lengths_apart_few_vectors_huge_entries_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    short = [(1, [0.5, 1.0]), (2, [2.0, -1.0]), (3, [0.0, 0.25])]
    long = [(4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 4.0])]
    got = whiten_vectors(spark.createDataFrame(short + long, schema))
    agree(plain(got), brute(short) + brute(long))
    assert whiten_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    assert whiten_vectors(spark.createDataFrame([], schema)).count() == 0
    huge = whiten_vectors(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.5]), (3, [0.0, 2.0])], schema)).collect()
    # the second component has less than 1e-15 of the variance of the first
    assert sorted((r["vec_id"], r["component"]) for r in huge) == [(1, 1), (2, 1), (3, 1)] and all(math.isfinite(r["whitened"]) for r in huge)
    x = [[2**51 + 10**6, 64 + 10**6], [-(2**51) + 10**6, 96 + 10**6], [10**6, 128 + 10**6]]
    total = [sum(c) for c in zip(*x)]
    assert [r["deviation"] for r in sorted(huge)] == [Decimal(sum((3 * a - s) ** 2 for a, s in zip(v, total))) for v in x]


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = Q.op12_whitening(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    agree(plain(got), brute(rows))
    assert got.agg({"identity_error": "max"}).first()[0] < 1e-9
