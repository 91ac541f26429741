"""Exact range join of vectors by angle: pivots cut the space into cells that are joined one by one.

The angle between two vectors is a metric. Every vector lives in the cell of
its nearest pivot. A pair within the range may lie in two cells; the triangle
inequality says which vectors of other cells can reach a cell (angle to its
pivot at most the cell's radius plus the range, and not deeper than the range
behind the plane between the two pivots), and only those are sent there. A cell
is cut into blocks of bounded size, so a dense region is many small joins.

A block keeps its own rows in memory and lets the visitors stream by. It counts
links and emits only the links that join two of its components, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from respondex.llm.base import stored
from respondex.llm.components import connected_components

VISIT_ROWS = 1024
SLACK = 1e-7


def _matrix(column: pa.ListArray) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False)
    return np.stack([np.asarray(r, dtype=np.float64) for r in rows]) if len(rows) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Forest:
    """Components of a block's own rows; ``join`` reports which of them a row brings together."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, hits: np.ndarray) -> np.ndarray:
        found = np.unique(self.label[hits])
        if len(found) > 1:
            self.label[np.isin(self.label, found[1:])] = found[0]
        return found


def _links_of(own: np.ndarray, own_ids: np.ndarray, limit: float, counts: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """Count the links among a block's own rows and return those that join components."""
    edges = []
    for start in range(0, len(own), VISIT_ROWS):
        near = own[start : start + VISIT_ROWS] @ own.T >= limit
        near[np.arange(near.shape[0]), np.arange(start, start + near.shape[0])] = False
        counts += near.sum(axis=0)
        for i in np.flatnonzero(near.any(axis=1)):
            me = start + int(i)
            edges += [(own_ids[me], own_ids[r]) for r in forest.join(np.append(np.flatnonzero(near[i]), me)) if r != me]
    return edges


def _join_cells(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        own: list[np.ndarray] = []
        own_ids: list[np.ndarray] = []
        matrix, ids, counts, forest = None, None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal matrix
            if cell is not None:
                if matrix is None:
                    yield from start()
                yield _rows(ids, None, counts)
            matrix = None

        def start() -> Iterator[pa.RecordBatch]:
            nonlocal matrix, ids, counts, forest
            matrix, ids = np.concatenate(own), np.concatenate(own_ids)
            counts, forest = np.zeros(len(ids), dtype=np.int64), Forest(len(ids))
            if edges := _links_of(matrix, ids, limit, counts, forest):
                yield _rows(*np.array(edges, dtype=np.int64).T, None)

        for batch in batches:
            cells, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (visits[1:] != visits[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(cells)]):
                if cells[a] != cell:
                    yield from close()
                    cell, own, own_ids = cells[a], [], []
                for s in range(a, z, VISIT_ROWS):
                    part = batch.slice(s, min(VISIT_ROWS, z - s))
                    m, rid = _unit(_matrix(part.column(3))), part.column(2).to_numpy()
                    if not visits[a]:
                        own.append(m)
                        own_ids.append(rid)
                        continue
                    if not own:
                        continue
                    if matrix is None:
                        yield from start()
                    near = m @ matrix.T >= limit
                    counts += near.sum(axis=0)
                    edges = [(rid[i], ids[r]) for i in np.flatnonzero(near.any(axis=1)) for r in forest.join(np.flatnonzero(near[i]))]
                    mine = near.sum(axis=1)
                    yield _rows(rid[mine > 0], None, mine[mine > 0])
                    if edges:
                        yield _rows(*np.array(edges, dtype=np.int64).T, None)
        if own:
            yield from close()

    return run


def _rows(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if n is None else pa.array(n, pa.int64())], names=["a", "b", "n"])


def link_vectors(vectors: DataFrame, min_cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", max_pivots: int = 256, rows_per_pivot: int = 512, block_rows: int = 2048) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row, links being cosines of ``min_cosine`` or more.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; so do vectors of different lengths with each other.
    Every row is a vector of its own, also with a repeated or null id. The
    component id is the smallest non-null id reachable, for rows without links
    their own. ``kept`` is true where it is the row's own id, false for a null id. An
    empty table gives an empty result; other columns are ignored.

    At most ``max_pivots`` pivots (an evenly drawn sample) and the sizes and
    radii of their cells are on the driver. Pivots prune what the data let them:
    isotropic vectors in many dimensions have to visit most cells.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = stored(rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    good = rows.where("fine").select("rid", "v", F.size("v").alias("dim"))
    n_pivots = max(1, min(max_pivots, good.count() // rows_per_pivot))
    pivots: dict[int, np.ndarray] = {}
    for r in good.select("dim", "v").orderBy(F.xxhash64("rid")).limit(n_pivots).collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    pivots = {d: _unit(np.array(p)) for d, p in pivots.items()}

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell, angle = np.zeros(len(dims), dtype=np.int32), np.full(len(dims), math.pi)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d in pivots:
                    cos = _unit(_matrix(batch.column(1).take(pa.array(at)))) @ pivots[d].T
                    cell[at] = cos.argmax(axis=1)
                    angle[at] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["rid", "v", "dim", "cell", "angle"])

    placed = stored(good.mapInArrow(home, "rid bigint, v array<double>, dim int, cell int, angle double"), "vector-cells")
    # One entry per cell: its first block number, its number of blocks, its radius.
    cells: dict[tuple[int, int], tuple[int, int, float]] = {}
    at = 0
    for r in placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).orderBy("dim", "cell").collect():
        blocks = -(-r["n"] // block_rows)
        cells[r["dim"], r["cell"]] = at, blocks, r["radius"]
        at += blocks
    reach = math.acos(min_cosine)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, VISIT_ROWS):
                batch = whole.slice(s, VISIT_ROWS)
                dims, home_cell, rid = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(0).to_numpy()
                spread = (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = np.array([cells[d, c][0] + int(h) % cells[d, c][1] for d, c, h in zip(dims, home_cell, spread)])
                goals, takes, roles = [own], [np.arange(len(own))], [np.zeros(len(own), dtype=np.int32)]
                for d in np.unique(dims):
                    mine = np.flatnonzero(dims == d)
                    if d in pivots:
                        cos = _unit(_matrix(batch.column(1).take(pa.array(mine)))) @ pivots[d].T
                        angle = np.arccos(np.clip(cos, -1, 1))
                        homes = cos[np.arange(len(mine)), home_cell[mine]]
                        gap = np.sqrt(np.maximum(2 - 2 * np.clip(pivots[d] @ pivots[d].T, -1, 1), 0))[home_cell[mine]]
                    for (dim, c), (first, blocks, radius) in cells.items():
                        if dim != d:
                            continue
                        near = np.ones(len(mine), dtype=bool)
                        if d in pivots:
                            plane = (homes - cos[:, c]) <= (math.sin(reach) + SLACK) * gap[:, c] + SLACK
                            near = (angle[:, c] <= radius + reach + SLACK) & (plane | (home_cell[mine] == c))
                        go = mine[near]
                        for block in range(first, first + blocks):
                            # Of two blocks the later one is visited if their numbers add up to an even one, else the earlier.
                            later = own[go] < block
                            to = go[(own[go] != block) & (later == ((own[go] + block) % 2 == 0))]
                            goals.append(np.full(len(to), block))
                            takes.append(to)
                            roles.append(np.ones(len(to), dtype=np.int32))
                take = pa.array(np.concatenate(takes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(goals).astype(np.int64)), pa.array(np.concatenate(roles)), batch.column(0).take(take), batch.column(1).take(take)],
                    names=["block", "visit", "rid", "v"],
                )

    sent = placed.mapInArrow(visits, T.StructType.fromDDL("block bigint, visit int, rid bigint, v array<double>"))
    dealt = sent.withColumn("v", F.col("v").cast("array<float>")) if _single(vectors, vec_col) else sent
    found = stored(dealt.repartition("block").sortWithinPartitions("block", "visit").mapInArrow(_join_cells(min_cosine), "a bigint, b bigint, n bigint"), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n_links"))
    labels = connected_components(found.where("b IS NOT NULL"))
    member = rows.select("rid", "id").join(labels.withColumnRenamed("node", "rid"), "rid")
    smallest = member.groupBy("label").agg(F.min("id").alias("least_id"))
    named = member.join(smallest, "label").select("rid", "least_id")
    component = F.coalesce("least_id", "id")
    return (
        rows.select("rid", "id").join(counts, "rid", "left").join(named, "rid", "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
    )


def _single(vectors: DataFrame, vec_col: str) -> bool:
    """Whether components are single-precision, which then travel as such without loss."""
    return isinstance(vectors.schema[vec_col].dataType, T.ArrayType) and isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
