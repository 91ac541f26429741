"""Ranked lexical search turned around: the items are the index, the documents the stream.

Few items are searched in very many documents. So the inverted index is built
over the items' terms (term -> items that hold it) and broadcast, and every
document streams its term counts through it once. A task keeps a bounded heap
of the best documents for each item; the heaps of all tasks are merged in two
levels. Nothing is ever built over the documents' own vocabulary.

Texts are read once: the first pass counts the words of each document and keeps,
of its terms, only those that some item holds. Document frequencies and lengths
are aggregates of that narrow table, and the scoring pass reads it too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import total_ordering
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from respondex.llm.base import slices, stored

#: Bytes that belong to terms: ASCII letters and digits, and every byte of a character beyond ASCII. Capital A-Z become small, the rest a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: (Item, term) entries of one index; it takes about 100 bytes for each. More items are searched in several indexes, one after the other.
INDEX_ENTRIES = 1 << 20
CELLS = 1 << 21
MERGE_BUCKETS = 512


def terms(text: str) -> list[bytes]:
    """Terms of the whole text in UTF-8, in order, with repeats."""
    return text.encode().translate(TERM_BYTES).split()


@total_ordering
class _Later:
    """Turns the order of ids round, so that the heap's least entry is the highest id among equal scores; null ids come last."""

    __slots__ = ("id",)

    def __init__(self, value):
        self.id = value

    def __eq__(self, other):
        return self.id == other.id

    def __lt__(self, other):
        if self.id is None or other.id is None:
            return other.id is not None
        return self.id > other.id


@dataclass
class ItemIndex:
    """For term t, ``items[starts[t]:starts[t + 1]]`` hold it, ``times`` often. ``order`` finds t by the term."""

    order: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    n_items: int


def build_index(texts: list[str | None]) -> ItemIndex:
    order: dict[bytes, int] = {}
    held: list[list[tuple[int, int]]] = []
    for item, text in enumerate(texts):
        for term, times in Counter(terms(text or "")).items():
            at = order.setdefault(term, len(order))
            if at == len(held):
                held.append([])
            held[at].append((item, times))
    flat = [pair for pairs in held for pair in pairs]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in held])]).astype(np.int64)
    items, times = (np.array([p[i] for p in flat], dtype=np.int64) for i in (0, 1))
    return ItemIndex(order, starts, items, times, len(texts))


def count_terms(docs: DataFrame, index, id_col: str, text_col: str) -> DataFrame:
    """``_id, n, terms, counts`` for every document with a term: its length in terms, and those of its terms that the index knows."""
    schema = T.StructType([
        T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = index.value.order.get
        for part in slices(batches, "_text"):
            rows, lengths, found, counts, ends = [], [], [], [], [0]
            for row, text in enumerate(part.column(1).to_pylist()):
                words = terms(text or "")
                if not words:
                    continue
                known = Counter(map(find, words))
                known.pop(None, None)
                rows.append(row)
                lengths.append(len(words))
                found += known.keys()
                counts += known.values()
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
            ], names=schema.names)

    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(run, schema)


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + size - 1 for each pair, joined."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def best_documents(counted: DataFrame, index, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, score, _id``: of each task, the ``k`` best documents of each item of the index, and ``bucket``, the task's number folded."""
    schema = T.StructType([
        T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("_id", counted.schema["_id"].dataType), T.StructField("bucket", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, weight = index.value, weights.value
        width = max(own.n_items, 1)
        sizes = np.diff(own.starts)
        heaps: list[list[tuple]] = [[] for _ in range(own.n_items)]
        bar = np.zeros(own.n_items, dtype=np.int64)  # a score that does not reach it cannot enter the item's heap any more
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            term, tf = batch.column(2).values.to_numpy().astype(np.int64), batch.column(3).values.to_numpy()
            m = 75 + (25 * lengths * n_docs) // n_terms
            at = 0
            while at < batch.num_rows:
                stop = min(batch.num_rows, at + max(1, CELLS // width))
                reach = np.concatenate([[0], np.cumsum(sizes[term[ends[at] : ends[stop]]])])[ends[at : stop + 1] - ends[at]]
                stop = at + max(1, int(np.searchsorted(reach[1 : stop - at + 1], CELLS, side="right")))
                mine = slice(ends[at], ends[stop])
                doc = np.repeat(np.arange(stop - at), np.diff(ends[at : stop + 1]))
                value = weight[term[mine]] * ((1_000_000_000 * tf[mine]) // (1000 * tf[mine] + 12 * m[at:stop][doc]))
                many = sizes[term[mine]]
                spots = _expanded(own.starts[term[mine]], many)
                scores = np.zeros((stop - at) * width, dtype=np.int64)
                np.add.at(scores, np.repeat(doc, many) * width + own.items[spots], np.repeat(value, many) * own.times[spots])
                scores = scores.reshape(stop - at, width)
                rows, items = np.nonzero((scores > 0) & (scores >= bar[None, : scores.shape[1]]) if own.n_items else scores > 0)
                if len(rows):
                    ids = batch.column(0).slice(at, stop - at).take(pa.array(rows)).to_pylist()
                    for value, name, item in zip(scores[rows, items].tolist(), ids, items.tolist()):
                        heap = heaps[item]
                        if len(heap) < k:
                            heappush(heap, (value, _Later(name)))
                        else:
                            heappushpop(heap, (value, _Later(name)))
                        if len(heap) == k:
                            bar[item] = heap[0][0]
                at = stop
        bucket = TaskContext.get().partitionId() % MERGE_BUCKETS
        kept = [(item, value, name.id, bucket) for item, heap in enumerate(heaps) for value, name in heap]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept), _arrow(schema))], schema=_arrow(schema))

    return counted.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def merge_heaps(heaps: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each item, numbered. Tasks meet in buckets first, so no item's heaps all come to one task."""
    best = lambda *by: W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
    some = heaps.withColumn("rank", F.row_number().over(best("item", "bucket"))).where(F.col("rank") <= k).drop("rank", "bucket")
    return some.withColumn("rank", F.row_number().over(best("item"))).where(F.col("rank") <= k)


def search_items(
    docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    index_entries: int = INDEX_ENTRIES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``items`` its ``k`` highest-scoring documents with a score above 0.

    Terms are the maximal runs of ASCII letters and digits and of characters
    beyond ASCII in the whole text, with A-Z in lower case. With N documents that
    hold a term, L their terms with repeats, n one document's terms, df the
    documents that hold the term, tf its count in the document:

        weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))
        m      = 75 + (25 n N) div L
        score  = sum over the item's terms, repeats included, of weight * ((10**9 tf) div (1000 tf + 12 m))

    Equal scores rank by ascending document id, null ids last. Null and empty
    texts hold no terms: such documents are never found and do not count, such
    items find nothing. Every row of ``items`` is an item of its own, repeated
    or null ids included; repeated documents are found each for itself. Either
    table may be empty. Other columns are ignored, whatever their names.

    Items are read in blocks of at most ``index_entries`` (item, term) pairs (one
    item at least); each block is one broadcast index and one pass over the
    texts, so the index stays bounded whatever the number of items. Scores are
    64-bit integers: term weights times counts of one item must stay below 2**63.
    """
    spark = docs.sparkSession
    out = None
    for ids, texts in _item_blocks(items, item_id, item_text, index_entries):
        own = build_index(texts)
        index = spark.sparkContext.broadcast(own)
        counted = stored(count_terms(docs, index, doc_id, doc_text), "term-counts")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(own.order), dtype=np.int64)
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row for each term of the index
            df[row["term"]] = row["count"]
        weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(c) + 1))) for c in df], dtype=np.int64))
        found = merge_heaps(best_documents(counted, index, weights, n_docs, max(n_terms, 1), k), k)
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_id, items.schema[item_id].dataType)]))
        part = found.join(names, "item").select(item_id, "rank", F.col("_id").alias(doc_id), "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], T.StructType([
            T.StructField(item_id, items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("score", T.LongType()),
        ]))
    return out


def _item_blocks(items: DataFrame, item_id: str, item_text: str, entries: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, block by block; only one block is held at a time."""
    ids, texts, size = [], [], 0
    for row in items.select(items[item_id].alias("i"), items[item_text].alias("t")).toLocalIterator():
        more = len(set(terms(row["t"] or "")))
        if ids and size + more > entries:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += more
    if ids:
        yield ids, texts


def search_sql(k: int = 20) -> str:
    """The same for tables ``documents`` and ``benchmark`` in DuckDB; item ids and document ids must be unique and not null."""
    split = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH doc_terms AS (SELECT doc_id, unnest({split}) AS term FROM documents),
item_terms AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({split}) AS term FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), whole),
measured AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM lengths, whole),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM counts JOIN item_terms USING (term) JOIN weights USING (term) JOIN measured USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
