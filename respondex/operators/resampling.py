"""Poisson resampling of cells of equal rows, all resamples of a cell at a time.

A task draws the weights of a cell in all resamples as one array, so neither
draws nor ranks are rows of a table. The arrays are laid out by ranges of the
score; a pass sums every range, and a second one, which knows the sums of the
ranges below, ranks inside its range. The driver sees two sums per range and
resample.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from respondex.session import ensure_checkpoint_dir

#: Rows of a cell that are drawn together; a cell of more rows is the sum of several draws.
DRAW_ROWS = 64
DRAW_BITS = 52
#: Parts of a cell that one task draws; a larger cell is drawn by several.
BLOCK_PARTS = 256
#: Cells whose arrays are unpacked at a time.
SLICE = 500
SUMS = ("tp", "fp", "tn", "fn", "pos", "neg", "won", "gain")


def poisson_rows(most: int = DRAW_ROWS) -> list[tuple[int, list[float]]]:
    """``m, cdf``: P(X <= 0), P(X <= 1), ... of the Poisson distributions with mean 1 to ``most``, up to 12 deviations beyond the mean."""
    rows = []
    for m in range(1, most + 1):
        steps = range(int(m + 12 * math.sqrt(m) + 12))
        rows.append((m, list(itertools.accumulate(math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in steps))))
    return rows


def _draw(resamples: int, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    cdf = {m: np.array(c) for m, c in poisson_rows()}
    tails = [f"{rep}|{seed}".encode() for rep in range(resamples)]

    def weights(name: str, first: int, rows: int) -> bytes:
        total = np.zeros(resamples, dtype=np.int64)
        for part, left in enumerate(range(rows, 0, -DRAW_ROWS), first):
            head = f"{name}|{part}|".encode()
            digests = np.frombuffer(b"".join([hashlib.md5(head + t).digest()[:8] for t in tails]), dtype=">u8").astype(np.uint64)
            u = ((digests >> np.uint64(64 - DRAW_BITS)).astype(np.float64) + 0.5) / float(1 << DRAW_BITS)
            # the place of u among the rising probabilities is the draw
            total += np.searchsorted(cdf[min(left, DRAW_ROWS)], u, side="left")
        return zlib.compress(total.astype("<i8").tobytes(), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at : at + SLICE]
                yield part[["s", "y", "p"]].assign(w=[weights(*x) for x in zip(part["name"], part["first"], part["rows"])])

    return run


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Score (NaN where null), label, prediction (-1 where null) and weights, a row per cell and a column per resample."""
    for pdf in batches:
        for at in range(0, len(pdf), SLICE):
            part = pdf.iloc[at : at + SLICE]
            w = np.frombuffer(b"".join(map(zlib.decompress, part["w"])), dtype="<i8").reshape(len(part), -1)
            yield part["s"].to_numpy(np.float64), part["y"].to_numpy(np.int64), part["p"].fillna(-1).to_numpy(np.int64), w


def _sums_of_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    low, pos, neg = None, 0, 0
    for s, y, _, w in _slices(batches):
        real = ~np.isnan(s)
        if real.any():
            low = s[real][0] if low is None else low
            pos = pos + y[real] @ w[real]
            neg = neg + (1 - y[real]) @ w[real]
    if low is not None:
        yield pd.DataFrame({"low": [low], "pos": [pos], "neg": [neg]})


def _ranks_of_range(resamples: int, before: dict[float, tuple[np.ndarray, np.ndarray]], pos_total: np.ndarray, neg_total: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts of the confusion and the sums behind AUROC (``won``) and AUPRC (``gain``) of one range, its rows in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = {n: np.zeros(resamples, dtype=np.float64 if n == "gain" else np.int64) for n in SUMS}
        below, held = None, None

        def rank(pos: np.ndarray, neg: np.ndarray) -> None:
            """Adds different scores in rising order; a row per score."""
            nonlocal below
            pos_before = below[0] + np.cumsum(pos, axis=0) - pos
            neg_before = below[1] + np.cumsum(neg, axis=0) - neg
            out["won"] += (pos * (2 * neg_before + neg)).sum(axis=0)
            tp = pos_total - pos_before
            gained = np.where(pos > 0, pos / np.maximum(pos_total, 1) * (tp / np.maximum(tp + neg_total - neg_before, 1)), 0.0)
            out["gain"] += gained.sum(axis=0)
            below = below[0] + pos.sum(axis=0), below[1] + neg.sum(axis=0)

        for s, y, p, w in _slices(batches):
            for name, chosen in (("tp", (y == 1) & (p == 1)), ("fp", (y == 0) & (p == 1)), ("tn", (y == 0) & (p == 0)), ("fn", (y == 1) & (p == 0))):
                out[name] += w[chosen].sum(axis=0)
            real = ~np.isnan(s)
            if not real.any():
                continue
            s, y, w = s[real], y[real], w[real]
            below = before[s[0]] if below is None else below
            at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            pos, neg = (np.add.reduceat(w * side[:, None], at, axis=0) for side in (y, 1 - y))
            out["pos"] += pos.sum(axis=0)
            out["neg"] += neg.sum(axis=0)
            if held is not None:
                if held[0] == s[0]:
                    pos[0] += held[1]
                    neg[0] += held[2]
                else:
                    rank(held[1][None], held[2][None])
            held = s[-1], pos[-1].copy(), neg[-1].copy()
            rank(pos[:-1], neg[:-1])
        if held is not None:
            rank(held[1][None], held[2][None])
        yield pd.DataFrame({"rep": range(resamples), **out})

    return run


def resampled_sums(df: DataFrame, score: Column, label: Column, pred: Column, resamples: int, seed: int) -> DataFrame:
    """``rep, tp, fp, tn, fn, pos, neg, won, gain`` of every resample that holds a scored row; see ``evaluation.bootstrap``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cells = df.groupBy(score.alias("s"), label.alias("y"), pred.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / DRAW_ROWS), F.lit(BLOCK_PARTS).cast("long")))
    name = F.concat_ws("|", F.round(F.col("s") * 1_000_000).cast("long"), "y", "p")
    blocks = cells.select(F.col("s").cast("double").alias("s"), "y", "p", name.alias("name"), "c", first.alias("first"))
    blocks = blocks.select("s", "y", "p", "name", "first", F.least(F.lit(BLOCK_PARTS * DRAW_ROWS), F.col("c") - F.col("first") * DRAW_ROWS).alias("rows"))
    drawn = blocks.repartition(tasks, "s", "y", "p", "first").mapInPandas(_draw(resamples, seed), "s double, y int, p int, w binary").checkpoint()
    laid = drawn.repartitionByRange(tasks, "s").sortWithinPartitions("s").checkpoint()
    ranges = sorted(laid.mapInPandas(_sums_of_range, "low double, pos array<bigint>, neg array<bigint>").collect(), key=lambda r: r["low"])
    before, pos, neg = {}, np.zeros(resamples, dtype=np.int64), np.zeros(resamples, dtype=np.int64)
    for r in ranges:
        before[r["low"]] = pos, neg
        pos, neg = pos + np.array(r["pos"]), neg + np.array(r["neg"])
    ranked = laid.mapInPandas(_ranks_of_range(resamples, before, pos, neg), "rep int, " + ", ".join(f"{n} {'double' if n == 'gain' else 'bigint'}" for n in SUMS))
    return ranked.groupBy("rep").agg(*[F.sum(n).alias(n) for n in SUMS]).where("pos + neg > 0")
