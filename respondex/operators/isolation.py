"""Isolation forest grown in the cluster: rows are dealt to trees by hash, every tree is grown by its own task, trees are a table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

NODES = "tree int, node int, feature int, cut double, below int, rows long"


def expected_depth(n: float) -> float:
    """Mean depth at which a search in a random tree of ``n`` rows ends."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def dealt_rows(df: DataFrame, id_col: str, features: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """``tree, h, x``: for each tree the rows with a low hash of (id, tree), somewhat more than ``sample`` of them.

    The limit is ten standard deviations above the need, so a tree lacks rows
    only when the table does. About ``trees * sample`` rows leave the tasks, at any size.
    """
    n = df.count()
    share = min(1.0, (sample + 10 * sample**0.5 + 10) / max(n, 1))
    h = lambda t: F.shiftrightunsigned(F.xxhash64(F.col(id_col), t, F.lit(seed)), 1)
    chances = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), h(t).alias("h")))
    mine = F.filter(chances, lambda c: c["h"] <= F.lit(min(2**63 - 1, int(share * 2.0**63))))
    return df.select(F.explode(mine).alias("c"), F.array(*features).alias("x"), F.col(id_col).cast("string").alias("tie")).select("c.*", "x", "tie")


def grow_forest(df: DataFrame, id_col: str, features: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """The nodes of ``trees`` trees, each over exactly ``sample`` rows (all rows where there are fewer).

    A node with ``feature`` >= 0 sends rows with a value below ``cut`` to node
    ``below`` and others to ``below + 1``; a leaf has feature -1 and ``rows``.
    The same rows and seed grow the same trees, wherever the rows lie.
    """
    depth = int(np.ceil(np.log2(max(sample, 2))))

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows.sort_values(["h", "tie"])["x"].tolist()[:sample], dtype=float)
        rng = np.random.default_rng([seed, int(key[0])])
        nodes: list[list] = [[-1, 0.0, -1, len(x)]]
        todo = [(0, x, depth)]
        while todo:
            at, part, left = todo.pop()
            low, high = part.min(0), part.max(0)
            usable = np.flatnonzero(high > low)
            nodes[at][3] = len(part)
            if left == 0 or len(part) <= 1 or not len(usable):
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            if not low[f] < cut <= high[f]:
                cut = float(high[f])
            below = part[:, f] < cut
            nodes[at][:3] = [f, cut, len(nodes)]
            todo += [(len(nodes), part[below], left - 1), (len(nodes) + 1, part[~below], left - 1)]
            nodes += [[-1, 0.0, -1, 0], [-1, 0.0, -1, 0]]
        out = pd.DataFrame(nodes, columns=["feature", "cut", "below", "rows"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", int(key[0]))
        return out

    return dealt_rows(df, id_col, features, trees, sample, seed).groupBy("tree").applyInPandas(grow, NODES)


def path_depths(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """How deep each row of ``x`` ends in one tree, leaves of several rows counted on by their expected depth."""
    at, depth = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    while True:
        inner = np.flatnonzero(tree["feature"][at] >= 0)
        if not len(inner):
            return depth + tree["rest"][at]
        node = at[inner]
        at[inner] = tree["below"][node] + (x[inner, tree["feature"][node]] >= tree["cut"][node])
        depth[inner] += 1


def isolation_scores(df: DataFrame, id_col: str, features: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation score in (0, 1], high for rows that few random cuts set apart.

    Absent values count as 0; ids may be of any type. The grown forest has at
    most ``trees * 2 * sample`` nodes whatever the size of the data: that table
    is broadcast, and all rows are scored where they are.
    """
    names = [f"x{i}" for i in range(len(features))]
    d = df.select(F.col(id_col), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(n) for f, n in zip(features, names)])
    forest = []
    nodes = grow_forest(d, id_col, names, trees, sample, seed).orderBy("tree", "node").toArrow()
    numbers = nodes["tree"].to_numpy()
    for t in np.unique(numbers):
        part = nodes.filter(numbers == t)
        tree = {c: part[c].to_numpy() for c in ("feature", "cut", "below", "rows")}
        tree["rest"] = np.array([expected_depth(float(n)) if f < 0 else 0.0 for f, n in zip(tree["feature"], tree["rows"])])
        forest.append(tree)
    grown = int(forest[0]["rows"][0]) if forest else 0
    shared, scale = df.sparkSession.sparkContext.broadcast(forest), max(expected_depth(grown), 1e-9)

    def run(batches):
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            total = sum((path_depths(t, x) for t in shared.value), np.zeros(len(x)))
            yield pd.DataFrame({id_col: pdf[id_col], "iso_score": np.round(2.0 ** (-(total / max(len(shared.value), 1)) / scale), 6)})

    return d.mapInPandas(run, T.StructType([d.schema[id_col], T.StructField("iso_score", T.DoubleType())]))
