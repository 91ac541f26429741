"""Bootstrap: all resamples of a cell in one array give what one row per draw gave."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from respondex.operators import evaluation as E
from respondex.operators import resampling as S

REPS, SEED = 20, 2607


def made():
    rng = random.Random(5)
    rows = [(round(rng.random(), 3), rng.randrange(2), rng.randrange(2)) for _ in range(3000)]
    return rows + [(0.25, 1, 0)] * 700 + [(None, 1, 1)] * 5 + [(None, 0, 0), (0.5, 1, None), (0.75, 0, None), (0.1, None, 1)]


def brute(rows):
    """Every draw by itself, and ranks by comparing all scores."""
    cdf = dict(S.poisson_rows())
    cells = collections.Counter(r for r in rows if r[1] is not None)
    found = []
    for rep in range(REPS):
        w = {}
        for (s, y, p), c in cells.items():
            w[s, y, p] = 0
            for part in range((c - 1) // 64 + 1):
                name = "|".join(str(x) for x in (None if s is None else round(s * 1_000_000), y, p, part, rep, SEED) if x is not None)
                u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
                w[s, y, p] += sum(x < u for x in cdf[min(64, c - part * 64)])
        count = lambda y, p: sum(n for (_, b, q), n in w.items() if (b, q) == (y, p))  # noqa: E731,B023
        pos, neg = collections.Counter(), collections.Counter()
        for (s, y, _), n in w.items():
            if s is not None:
                (pos if y else neg)[s] += n
        scores = sorted({*pos, *neg})
        won, gain, below = 0, 0.0, 0
        pt, nt, pb = sum(pos.values()), sum(neg.values()), 0
        for s in scores:
            won += pos[s] * (2 * below + neg[s])
            gain += pos[s] / pt * ((pt - pb) / (pt - pb + nt - below)) if pos[s] else 0.0
            below, pb = below + neg[s], pb + pos[s]
        found.append((rep, count(1, 1), count(0, 1), count(0, 0), count(1, 0), pt, nt, won, gain))
    return found


def test_sums_equal_draws_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_PARTS", 3)
    d = spark.createDataFrame(made(), "s double, y int, p int").repartition(5)
    got = S.resampled_sums(d.where("y IS NOT NULL"), F.round("s", 6), F.col("y"), F.col("p"), REPS, SEED).orderBy("rep").collect()
    want = brute(made())
    assert [tuple(r)[:8] for r in got] == [r[:8] for r in want]
    assert [r["gain"] for r in got] == pytest.approx([r[8] for r in want])


def test_a_large_cell_is_drawn_by_several_tasks_and_few_rows_leave_resamples_out(spark):
    big = spark.range(3 * S.BLOCK_PARTS * S.DRAW_ROWS + 1).select(F.lit(0.5).alias("s"), F.lit(1).alias("y"), F.lit(1).alias("p"))
    got = S.resampled_sums(big, F.col("s"), F.col("y"), F.col("p"), 30, SEED).collect()
    assert len(got) == 30 and abs(np.mean([r["tp"] for r in got]) / big.count() - 1) < 0.01 and {r["neg"] for r in got} == {0}
    one = spark.createDataFrame([(0.5, 1, 1), (None, 0, 0)], "s double, y int, p int")
    assert 0 < S.resampled_sums(one, F.col("s"), F.col("y"), F.col("p"), 30, SEED).count() < 30
    empty = {r["metric"]: r["mean"] for r in E.bootstrap(one.limit(0), "s", "y", "p", 10).collect()}
    assert not any(empty.values())
