"""Byte-level BPE by corpus-level merge replay, and back.

The texts of an Arrow slice are one corpus: its distinct words are laid out
one after the other as bytes, and an inverted index leads from the rank of
every adjacent token pair to the positions where it stands. The lowest rank in
the index is taken next and merged at all its positions; only the two
neighbours of a merged place get new index entries. A word that occurs a
million times is merged once, and a word of a million letters costs no more
than its letters do.

A word is one match of the split pattern. Words that are tokens themselves take
their own rank, as in the tiktoken library.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from respondex.llm.base import slices

#: Parts of texts in each half of their memory; words have twice as many: about 400 MB in all at most. The older half is
#: dropped when the younger is full, which changes no result.
MEMORY_ENTRIES = 300_000
TEXT_BYTES = 2 << 20
DECODE_TOKENS = 1 << 18


class Memory:
    """Results by key, bounded: what was not asked for during the last ``limit`` new keys is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Keys without a result. All others are in ``young`` afterwards, until the next call."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        absent = keys - self.young.keys()
        again = absent & self.old.keys()
        old = self.old
        self.young.update({key: old[key] for key in again})
        return list(absent - again)


class MergeTable:
    """Tokens by rank and the rank that two neighbouring tokens merge into."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}
        self.size = max(self.ranks.values(), default=-1) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        single = [self.ranks.get(bytes([b])) for b in range(256)]
        if None in single:
            raise ValueError("every single byte must be a token")
        self.single = np.array(single, dtype=np.int32)
        self.first = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int32)
        #: Every way to put a token together from two, as first * size + second.
        self.pairs = {
            a * self.size + b: rank for token, rank in self.ranks.items() for cut in range(1, len(token))
            if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None
        }
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.pool = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Token ids of every word as little-endian int32 bytes: all merges of all words, in the order of their ranks."""
        raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        stops = np.concatenate([[0], np.cumsum(sizes + 1)])  # a border stands before, between and after the words
        border = np.zeros(len(raw), dtype=bool)
        border[stops] = True
        start = np.where(border, -1, self.single[raw])
        rank = np.where(border[:-1] | border[1:], -1, self.first[raw[:-1], raw[1:]])
        spots = np.flatnonzero(rank >= 0)
        spots = spots[np.argsort(rank[spots], kind="stable")]
        heap, at = np.unique(rank[spots], return_index=True)
        heap = heap.tolist()  # ascending, so already a heap
        index = {r: part.tolist() for r, part in zip(heap, np.split(spots, at[1:]))}

        tok, pair = start.tolist(), rank.tolist() + [-1]
        nxt, prv = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        find, size = self.pairs.get, self.size
        while heap:
            now = heappop(heap)
            places = index.pop(now)
            places.sort()  # leftmost first, as overlapping pairs of one rank ask for
            for done, p in enumerate(places, 1):
                if pair[p] != now:
                    continue  # one side was merged otherwise meanwhile
                q, before = nxt[p], prv[p]
                after = nxt[q]
                tok[p], tok[q], pair[q] = now, -2, -1
                nxt[p], prv[after] = after, p
                right = find(now * size + tok[after], -1) if tok[after] >= 0 else -1
                pair[p] = right
                if right >= 0:
                    if right in index:
                        index[right].append(p)
                    else:
                        index[right] = [p]
                        heappush(heap, right)
                if tok[before] < 0:
                    left = -1
                else:
                    left = pair[before] = find(tok[before] * size + now, -1)
                    if left >= 0:
                        if left in index:
                            index[left].append(before)
                        else:
                            index[left] = [before]
                            heappush(heap, left)
                if 0 <= left < now or 0 <= right < now:  # an earlier merge became possible: it goes first, the rest of this rank waits
                    if done < len(places):
                        index[now] = places[done:]
                        heappush(heap, now)
                    break
        kept = np.array(tok, dtype=np.int32)
        alive = kept >= 0
        ends = np.cumsum(alive)[stops]
        ids = kept[alive].tobytes()
        return [ids[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, joined. A rank without a token is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.lengths[ids].all()):
            raise ValueError("id without a token")
        out = []
        for at in range(0, len(ids), DECODE_TOKENS):
            part = ids[at : at + DECODE_TOKENS]
            n = self.lengths[part]
            shift = self.starts[part] - (np.cumsum(n) - n)
            out.append(self.pool[np.repeat(shift, n) + np.arange(n.sum())].tobytes())
        return b"".join(out)


class CorpusEncoder:
    """Encodes slice after slice; what it learned about words serves the following slices."""

    def __init__(self, file: bytes, pattern: str, spaces_open_words: bool, memory: int = MEMORY_ENTRIES):
        import regex

        self.table, self.split, self.apart = MergeTable(file), regex.compile(pattern).findall, spaces_open_words
        self.words, self.parts, self.heads = Memory(2 * memory), Memory(memory), Memory(memory // 4)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as int32 bytes."""
        cut = [self._cut(t) for t in texts]
        self._learn(self.heads, {c[0] for c in cut}, "")
        self._learn(self.parts, set(chain.from_iterable([rest for _, rest in cut])), " ")
        head, part = self.heads.young, self.parts.young
        return [head[first] + b"".join([part[p] for p in rest]) for first, rest in cut]

    def _cut(self, text: str) -> tuple[str, list[str]]:
        """The text up to its first word border, and what follows each border space. Borders are spaces before a character that is no space."""
        if not self.apart:
            return text, []
        first, *rest = text.split(" ")
        if all(c and not c.isspace() for c in {p[:1] for p in rest}):
            return first, rest
        pieces = [first]
        for p in rest:
            if p and not p[0].isspace():
                pieces.append(p)
            else:
                pieces[-1] += " " + p
        return pieces[0], pieces[1:]

    def _learn(self, memory: Memory, keys: set[str], before: str) -> None:
        fresh = [(key, self.split(before + key)) for key in memory.missing(keys)]
        self._merge(set(chain.from_iterable([words for _, words in fresh])))
        known = self.words.young
        for key, words in fresh:
            memory.young[key] = b"".join([known[w] for w in words])

    def _merge(self, words: set[str]) -> None:
        whole, apart = [], []
        for w in self.words.missing(words):
            data = w.encode()
            rank = self.table.ranks.get(data)
            if rank is None:
                apart.append((w, data))
            else:
                whole.append((w, rank))
        young = self.words.young
        for w, rank in whole:
            young[w] = rank.to_bytes(4, "little")
        if apart:
            young.update(zip([w for w, _ in apart], self.table.replay([d for _, d in apart])))


_ready: dict[str, CorpusEncoder] = {}


def _encoder(file: bytes, pattern: str, spaces_open_words: bool) -> CorpusEncoder:
    """The encoder of this worker process, kept from task to task."""
    key = hashlib.sha256(file).hexdigest() + pattern + str(spaces_open_words)
    if key not in _ready:
        _ready.clear()
        _ready[key] = CorpusEncoder(file, pattern, spaces_open_words)
    return _ready[key]


def encode_corpus(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", spaces_open_words: bool = True
) -> DataFrame:
    """``id, ids, decoded`` for every row: token ids of the whole text, and the bytes that these ids stand for.

    ``spaces_open_words`` says that every space before a character that is no
    space begins a match of ``pattern`` and that matches before it do not look
    past it, as is so where words are `` ?letters``, `` ?digits``, `` ?signs``
    or white space; texts are then cut there and parts seen before need no
    pattern. Give False for other patterns.

    Null and empty texts give no ids and empty bytes. Rows keep null and
    repeated ids; equal texts get equal ids; other columns are ignored, whatever
    their names. An empty table gives an empty table. There is no shuffle: the
    rank file is read on the driver (a fixed input below a megabyte) and
    broadcast, and the memory of words is bounded.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern, spaces_open_words)
        for part in slices(batches, "_text", TEXT_BYTES):
            coded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            ids = np.frombuffer(b"".join(coded), dtype=np.int32)
            ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
            sizes = np.concatenate([[0], np.cumsum(encoder.table.lengths[ids])])[ends].astype(np.int32)
            decoded = pa.Array.from_buffers(pa.binary(), len(coded), [None, pa.py_buffer(sizes), pa.py_buffer(encoder.table.decode(ids))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), decoded], names=[id_col, "ids", "decoded"])

    return docs.select(docs[id_col], docs[text_col].alias("_text")).mapInArrow(run, schema)
