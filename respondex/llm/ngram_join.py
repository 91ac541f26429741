"""Jaccard self join on word n-grams with PartEnum signatures.

Sets fall into bands of size. For the sets that may meet in a band, a Jaccard
threshold bounds the number k of n-grams that two partners do not share. The
n-grams are dealt by a hash into ``n1`` partitions of ``n2`` parts each. A pair
with k differences at most has ``1 + spare`` partitions or more with ``k2``
differences at most, and in such a partition some choice of ``n2 - k2`` parts
is equal in both. So every choice of every partition, taken as one digest, is
a signature, and partners share one. ``spare`` and the number of parts are
chosen per band (``enumeration``).

A choice may be empty. Empty choices say little, so they give no signature of
their own. Of two partners it is enough that one has ``spare`` such partitions at
most. A set with more is dealt again by another hash, and so on until a deal
leaves it few: partners take part in the same deals up to the first that suits
one of them, which keeps the guarantee. After ``DEALS`` deals, which hardly any set
needs, it gets a signature for every ``1 + spare`` of those partitions of the last.

Sets that share a signature are compared with a pivot of their bucket, not all
with all. Links join components, members of one component need no more
comparing, and what is left of a bucket gets further pivots, more of them each
round, until nothing is left (``join_ngrams``). No candidate is left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from respondex.llm.base import mix64, scratch, slices, stored
from respondex.llm.components import connected_components
from respondex.llm.sketch import key_filter, possible_rows

#: Rounds of comparing take 1, 4, 16, ... pivots of a bucket.
PIVOT_GROWTH = 4
WORD_CACHE = 200_000
#: Bits of the map of a set, a power of two; sets or pairs whose maps are held at once.
MAP_BITS = 2048
MAP_ROWS = 2048
BAND_RATIO = 1.35
SPARE_ROOTS = 3.5
#: Deals of a set that keeps too many partitions with an empty choice.
DEALS = 8
#: Shares of empty choices, the first that leads to at most one signature per n-gram is taken.
EMPTY_SHARES = (0.03, 0.06, 0.12, 0.25, 0.4)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case; ASCII white space separates."""
    return (text or "").encode().lower().split()


class Shingler:
    """Set of n-gram digests (sorted, 64 bits) of a text; word digests are remembered for a while."""

    def __init__(self, n: int):
        self.n = n
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > WORD_CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.n, len(h))
        out = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for j in range(width):
            out = mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : len(h) - width + 1 + j])
        return np.unique(out)


def set_key(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set. Two of n different sets get one key with probability n**2 / 2**65."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)))


@lru_cache(maxsize=None)
def bands(percent: int) -> list[int]:
    """Lower ends of the size bands; a band is wide enough that partners lie in one band or in neighbouring ones."""
    ends, low = [1], 1
    while low < 1 << 40:
        low = max(low + 1, math.floor(low * BAND_RATIO), low * 100 // percent + 1 if low * 100 // percent < low + 2 else 0)
        ends.append(low)
    return ends


@lru_cache(maxsize=None)
def enumeration(band: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for pairs whose larger set lies in ``band``: the fewest signatures with few empty choices.

    ``spare`` is about four standard deviations (of cells left empty) above the number of partitions with an empty choice.
    """
    ends = bands(percent)
    largest, smallest = ends[band + 1] - 1, max(1, -(-ends[band] * percent // 100))
    k = 2 * largest * (100 - percent) // (100 + percent)
    if k == 0:
        return 1, 1, 0, 0
    best: dict[float, tuple[int, tuple[int, int, int, int]]] = {}
    for k2, n2 in itertools.product(range(min(k, 6) + 1), range(1, 11)):
        if n2 <= k2:
            continue
        choices, spare = math.comb(n2, k2), 0
        for _ in range(40):
            n1 = k // (k2 + 1) + 1 + spare
            empty = (1 - (n2 - k2) / (n1 * n2)) ** smallest
            hollow = n1 * min(1.0, choices * empty)
            if spare >= hollow + SPARE_ROOTS * math.sqrt(hollow) - 0.5:
                break
            spare = math.ceil(hollow + SPARE_ROOTS * math.sqrt(hollow))
        else:
            continue
        for share in EMPTY_SHARES:
            if empty <= share and (share not in best or n1 * choices < best[share][0]):
                best[share] = n1 * choices, (n1, n2, k2, spare)
    for share in EMPTY_SHARES:
        if share in best and (best[share][0] <= smallest or share == EMPTY_SHARES[0]):
            return best[share][1]
    found = [*best.values(), (math.comb(k + 2, k), (1, k + 2, k, 0))]
    return min(found)[1]


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set (unsigned 64 bits), for the bands in which it may meet a partner."""
    if not len(s):
        return np.zeros(0, dtype=np.uint64)
    ends = bands(percent)
    band = int(np.searchsorted(ends, len(s), side="right")) - 1
    out = [_band_signatures(s, band, percent)]
    if len(s) * 100 // percent >= ends[band + 1]:
        out.append(_band_signatures(s, band + 1, percent))
    return np.concatenate(out)


def _band_signatures(s: np.ndarray, band: int, percent: int) -> np.ndarray:
    _, _, _, spare = enumeration(band, percent)
    made = []
    for deal in range(DEALS):
        found, gaps = _dealt(s, band, percent, deal)
        made.append(found)
        if len(gaps) <= spare:
            break
    else:
        rest = [xxhash.xxh3_64_intdigest(np.array([band, *some], dtype=np.int64).tobytes()) for some in itertools.combinations(gaps.tolist(), 1 + spare)]
        made.append(np.array(rest, dtype=np.uint64))
    return np.concatenate(made)


def _dealt(s: np.ndarray, band: int, percent: int, deal: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the choices that are not empty in one deal of the set, and the partitions with an empty choice."""
    n1, n2, k2, _ = enumeration(band, percent)
    spread = mix64(s + np.uint64(0x632BE59BD9B4E019) + np.uint64(deal * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    cell = ((spread >> np.uint64(40)) * np.uint64(n1 * n2) >> np.uint64(24)).astype(np.int64)
    digest = mix64(s ^ np.uint64(0xD6E8FEB86659FD93))
    low = np.bincount(cell, weights=(digest & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n1 * n2)
    high = np.bincount(cell, weights=(digest >> np.uint64(32)).astype(np.float64), minlength=n1 * n2)
    sums = (low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))).reshape(n1, n2)
    filled = (np.bincount(cell, minlength=n1 * n2) > 0).reshape(n1, n2)
    picks = np.array(list(itertools.combinations(range(n2), n2 - k2)), dtype=np.int64)
    tag = np.uint64((band * 64 + 1 + deal) * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF)
    part = (np.arange(n1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))[:, None]
    whole = np.zeros((n1, len(picks)), dtype=np.uint64)
    some = np.zeros(whole.shape, dtype=bool)
    for q in picks.T:
        whole = mix64(whole + sums[:, q])
        some |= filled[:, q]
    number = tag + (np.arange(len(picks), dtype=np.uint64) << np.uint64(20))
    return mix64(mix64(whole ^ part) + number)[some], np.flatnonzero(~some.all(axis=1))


def set_table(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, key`` for every row; the key is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for part in slices(batches, text_col):
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())],
                names=[id_col, "n_shingles", "key"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_shingles bigint, key bigint")


def signature_table(docs: DataFrame, n: int, percent: int, text_col: str = "text") -> DataFrame:
    """``signature, key``. Within a task a set gives its rows once, however many copies it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(n), set()
        for part in slices(batches, text_col, 1 << 20):
            keys, rows = [], []
            for t in part.column(0).to_pylist():
                s = shingles(t)
                key = set_key(s) if len(s) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                if len(seen) > WORD_CACHE:
                    seen.clear()
                rows.append(signatures(s, percent))
                keys.append(np.full(len(rows[-1]), key, dtype=np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).astype(np.int64)), pa.array(np.concatenate(keys))], names=["signature", "key"])

    return docs.select(text_col).mapInArrow(run, "signature bigint, key bigint")


def shared_signatures(table: DataFrame) -> DataFrame:
    """Rows of signatures that two sets or more share, without repeats; one shuffle."""
    bucket = W.partitionBy("signature")
    once = table.repartition("signature").dropDuplicates(["signature", "key"])
    least = once.withColumn("first", F.min("key").over(bucket)).withColumn("last", F.max("key").over(bucket))
    return least.where(F.col("first") < F.col("last")).select("signature", "key")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``key, grams`` (sorted digests) for the rows of ``wanted`` (id, key), which name one document per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for part in slices(batches, text_col, 1 << 20):
            sets = [shingles(t).astype(np.int64) for t in part.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s.astype(np.uint64)) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["key", "grams"])

    texts = possible_rows(docs.select(id_col, text_col), id_col, key_filter(wanted, id_col))
    ids = wanted.select(F.col(id_col).alias("_wanted")).distinct()
    return texts.join(ids, F.col(id_col).eqNullSafe(F.col("_wanted"))).select(id_col, text_col).mapInArrow(run, "key bigint, grams array<bigint>").dropDuplicates(["key"])


def set_maps(sets: DataFrame) -> DataFrame:
    """``key, n, bits``: the size of every set and a bit map of its digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, MAP_ROWS):
                part = batch.slice(s, MAP_ROWS)
                sizes = pc.list_value_length(part.column(1)).to_numpy()
                hit = np.zeros((part.num_rows, MAP_BITS), dtype=bool)
                at = part.column(1).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS.bit_length() + 1)
                hit[np.repeat(np.arange(part.num_rows), sizes), at.astype(np.int64)] = True
                bits = pa.Array.from_buffers(pa.binary(MAP_BITS // 8), part.num_rows, [None, pa.py_buffer(np.packbits(hit, axis=1).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), bits.cast(pa.binary())], names=["key", "n", "bits"])

    return sets.select("key", "grams").mapInArrow(run, "key bigint, n bigint, bits binary")


def possible_links(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be similar enough, all that are among them.

    A bit that only one map has stands for a digest that only this set has, so
    bits bound the common digests from above. Maps are a fraction of the sets,
    and what they end needs no set to move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, MAP_ROWS):
                part = batch.slice(s, MAP_ROWS)
                n, m = part.column(2).to_numpy(), part.column(4).to_numpy()
                one, other = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(part.num_rows, -1) for c in (3, 5))
                only = np.bitwise_count(one & ~other).sum(axis=1, dtype=np.int64), np.bitwise_count(other & ~one).sum(axis=1, dtype=np.int64)
                common = np.minimum(n - only[0], m - only[1])
                yield part.filter(pa.array(common * 100 >= (n + m - common) * percent)).select(["a", "b"])

    left, right = (maps.select(F.col("key").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_n", "a_bits", "b_n", "b_bits")
    return both.mapInArrow(run, "a bigint, b bigint")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar enough, from the sets themselves."""
    left = sets.select(F.col("key").alias("a"), F.col("grams").alias("left"))
    right = sets.select(F.col("key").alias("b"), F.col("grams").alias("right"))
    common = F.size(F.array_intersect("left", "right")).cast("long")
    either = F.size("left") + F.size("right") - common
    return pairs.join(left, "a").join(right, "b").where(common * 100 >= either * percent).select("a", "b")


def link_buckets(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, label`` of the components of all similar sets that share a signature.

    ``shared`` (signature, key) and ``sets`` (key, grams) are stored tables;
    sets without a link may be missing in the result.
    """
    # Sets that share signatures with many others stand in the middle of their group: they are the first pivots.
    sizes = shared.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    degree = shared.join(sizes, "signature").groupBy("key").agg(F.sum("n").alias("degree"))
    order = W.partitionBy("signature").orderBy(F.desc("degree"), "key")
    ranked = stored(shared.join(degree, "key").select("signature", "key", F.row_number().over(order).alias("rank")), "shingle-ranks")

    maps = stored(set_maps(sets), "set-maps")
    links, labels, done, pivots = None, None, 0, 1
    open_rows = ranked.withColumn("label", F.col("key"))
    while True:
        pivot = open_rows.where((F.col("rank") > done) & (F.col("rank") <= done + pivots)).select("signature", F.col("key").alias("b"), F.col("rank").alias("b_rank"), F.col("label").alias("b_label"))
        pairs = open_rows.join(pivot, "signature").where((F.col("rank") > F.col("b_rank")) & (F.col("label") != F.col("b_label")))
        # stored, so that few pairs and their sets are known to be few: the other sets stay where they are
        with scratch(possible_links(pairs.select(F.col("key").alias("a"), "b").distinct(), maps, percent), "likely-links") as likely:
            ends = likely.select(F.explode(F.array("a", "b")).alias("key")).distinct()
            with scratch(sets.join(ends, "key", "left_semi"), "likely-sets") as met:
                found = stored(linked(likely, met, percent), "shingle-links")
        links = found if links is None else links.unionByName(found)
        labels = stored(connected_components(links), "shingle-labels")
        done, pivots = done + pivots, pivots * PIVOT_GROWTH
        named = ranked.join(labels.withColumnRenamed("node", "key"), "key", "left").select("signature", "key", "rank", F.coalesce("label", "key").alias("label"))
        left = named.groupBy("signature").agg(F.max("rank").alias("top"), F.min("label").alias("x"), F.max("label").alias("y")).where((F.col("top") > done + 1) & (F.col("x") != F.col("y")))
        open_rows = stored(named.join(left.select("signature"), "signature"), "shingle-open")
        if open_rows.isEmpty():
            break
    return labels


def join_ngrams(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``docs``.

    A document's set are its distinct ``n``-word shingles (with fewer words the
    whole sequence). Documents link when ``100 * intersection >= percent *
    union``; ``component_id`` is the smallest id reachable over links.
    Documents without words have an empty set and link with nothing. Copies are
    one set. Null ids never become a component id unless all of a class are
    null; repeated rows are kept; other columns are ignored; an empty table
    gives an empty result.
    """
    table = stored(set_table(docs, n, id_col, text_col), "shingle-keys")
    shared = stored(shared_signatures(signature_table(docs, n, percent, text_col)), "shared-signatures")
    near = shared.select("key").distinct()
    one_each = table.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(id_col).alias(id_col))
    wanted = stored(one_each.join(near, "key").select(id_col, "key"), "shingle-wanted")
    sets = stored(sets_of(docs, wanted, n, id_col, text_col), "shingle-sets")

    labels = link_buckets(shared, sets, percent)
    grouped = table.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("label", "key"))
    least = grouped.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(id_col).alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = grouped.select("group", id_col, "n_shingles").join(least.drop("n"), "group", "left")
    return named.select(id_col, "n_shingles", F.coalesce("component_id", F.col(id_col)).alias("component_id"))
