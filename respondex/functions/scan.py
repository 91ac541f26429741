"""Long texts read in Arrow batches: which patterns occur, how often, how many different words.

Java's patterns try every alternative at every character, and word arrays of whole texts are built and hashed entry by
entry. Arrow's patterns walk a text once, whatever the number of alternatives, and words are counted by their codes, a few
MiB of text at a time. Only patterns that mean the same to both are given to it; all others stay with Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from respondex.functions import text as X

#: Bytes of text that are read at once.
SLICE_BYTES = 4 << 20

_EDGES = ("(^|[^a-z])", "([^a-z]|$)")
_PLAIN = re.compile(r"(?:[\w '&,;:!/—@%#-]\??|\\[|.]|[|()])*")


def plain(pattern: str) -> bool:
    """Only strings, alternatives, groups and edges of words: the same in Java's patterns and in Arrow's."""
    for edge in _EDGES:
        pattern = pattern.replace(edge, "")
    return _PLAIN.fullmatch(pattern) is not None


@dataclass(frozen=True)
class Reading:
    """What to read from a text.

    ``found`` has patterns (``plain`` ones or such as the caller knows to mean the
    same to Arrow), ``counts`` patterns whose matches are counted, ``letters``
    sets of ASCII characters that are counted one by one, ``runs`` sets whose
    unbroken runs are counted. ``words`` is what is between words: their number, the
    number of different ones and of those in ``lexicon`` are read. ``phrases`` asks
    whether two neighbouring words of a-z and ' occur three times.
    """

    found: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    letters: tuple[str, ...] = ()
    runs: tuple[str, ...] = ()
    words: str | None = None
    lexicon: tuple[str, ...] = ()
    phrases: bool = False
    names: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        keys = [("found", p) for p in self.found] + [("count", p) for p in self.counts] + [("letters", p) for p in self.letters] + [("runs", p) for p in self.runs]
        self.names.update({key: f"r{i}" for i, key in enumerate(keys)})

    def schema(self) -> str:
        parts = [f"{name} {'boolean' if kind == 'found' else 'int'}" for (kind, _), name in self.names.items()]
        if self.words is not None:
            parts += ["n_words int", "n_distinct int", "n_lexicon int"]
        return f"struct<{', '.join(p.replace(' ', ':') for p in parts + (['repeated boolean'] if self.phrases else []))}>"

    def read(self, texts: pa.Array) -> pa.Array:
        """One struct per text; null reads as empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(texts)]
        parts = [self._slice(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a or len(texts) == 0]
        return pa.concat_arrays(parts)

    def _slice(self, texts: pa.Array) -> pa.StructArray:
        out = {}
        for (kind, what), name in self.names.items():
            if kind == "found":
                out[name] = pc.match_substring_regex(texts, what)
            elif kind == "count":
                out[name] = pc.count_substring_regex(texts, what).cast(pa.int32())
            else:
                out[name] = pa.array(_count_bytes(texts, what, kind == "runs"), pa.int32())
        if self.words is not None:
            row, code, lexicon = _words(texts, self.words)
            n = np.bincount(row, minlength=len(texts))
            pairs = np.sort(row * max(len(lexicon), 1) + code)
            first = np.ones(len(pairs), bool)
            first[1:] = pairs[1:] != pairs[:-1]
            distinct = np.bincount(pairs[first] // max(len(lexicon), 1), minlength=len(texts))
            listed = pc.is_in(lexicon, pa.array(self.lexicon, lexicon.type)).to_numpy(zero_copy_only=False).astype(bool)
            hits = np.bincount(row[listed[code]], minlength=len(texts))
            out |= {"n_words": pa.array(n, pa.int32()), "n_distinct": pa.array(distinct, pa.int32()), "n_lexicon": pa.array(hits, pa.int32())}
        if self.phrases:
            out["repeated"] = pa.array(_repeated_pairs(*_words(texts, "[^a-z']+"), len(texts)))
        return pa.StructArray.from_arrays(list(out.values()), names=list(out))


def _words(texts: pa.Array, between: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every word in order, and the different words by code."""
    lists = pc.split_pattern_regex(texts, between)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return row[full], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _repeated_pairs(row: np.ndarray, code: np.ndarray, lexicon: pa.Array, rows: int) -> np.ndarray:
    """Whether a row of six words or more holds the same two neighbours three times."""
    size = max(len(lexicon), 1)
    same = row[1:] == row[:-1]
    at, pair = row[:-1][same], (code[:-1] * size + code[1:])[same]
    if rows * size * size < 1 << 63:
        key = np.sort(at * (size * size) + pair)
        hit = key[2:][key[2:] == key[:-2]] // (size * size)
    else:
        order = np.lexsort((pair, at))
        at, pair = at[order], pair[order]
        hit = at[2:][(at[2:] == at[:-2]) & (pair[2:] == pair[:-2])]
    return (np.bincount(hit, minlength=rows) > 0) & (np.bincount(row, minlength=rows) >= 6)


def _count_bytes(texts: pa.Array, letters: str, runs: bool) -> np.ndarray:
    """Characters out of ``letters`` per text, or their unbroken runs."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    _, offsets, data = texts.buffers()
    if data is None or ends[-1:].sum() == 0:
        return np.zeros(len(texts), np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    start = int(np.frombuffer(offsets, width)[texts.offset])
    table = np.zeros(256, bool)
    table[list(letters.encode("ascii"))] = True
    hit = table[np.frombuffer(data, np.uint8)[start : start + int(ends[-1])]]
    if runs:
        first = hit.copy()
        first[1:] &= ~hit[:-1]
        begins = (ends - lengths)[lengths > 0]
        first[begins] = hit[begins]
        hit = first
    total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    return total[ends] - total[ends - lengths]


def read_texts(df: DataFrame, text: str, reading: Reading, out: str) -> DataFrame:
    """``df`` with the struct ``out`` of what ``reading`` asks of the column ``text``."""
    return df.withColumn(out, F.arrow_udf(reading.read, reading.schema())(F.col(text)))


def value(reading: Reading, out: str, kind: str, what: str) -> Column:
    return F.col(out)[reading.names[(kind, what)]]


def finder(reading: Reading, out: str) -> Callable[[Column, str | Sequence[str]], Column]:
    """``X.found`` that looks the answer up where ``reading`` has the pattern."""

    def found(t: Column, what: str | Sequence[str]) -> Column:
        key = ("found", X.as_pattern(what))
        return F.col(out)[reading.names[key]] if key in reading.names else X.found(t, what)

    return found
