"""Which known phrases stand in which texts, word for word: all phrases are looked for in one pass over a text.

The phrases of a block form a trie over words with failure links, which is
broadcast; a text walks through it once, whatever the number of phrases, and no
word of it is ever shuffled. Blocks are bounded, so a bank of any size is
searched, one pass for each block.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from respondex.functions import text as X

BLOCK_CHARS = 4 << 20


class PhraseTrie:
    """States are numbers, 0 the start; ``ends[s]`` are the phrases whose last word leads to s, ``up[s]`` the next shorter suffix that is a state."""

    def __init__(self, phrases: Iterable[list[str]]):
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, words in enumerate(phrases):
            at = 0
            for w in words:
                if w not in self.step[at]:
                    self.step[at][w] = len(self.step)
                    self.step.append({})
                    self.ends.append([])
                at = self.step[at][w]
            if at:
                self.ends[at].append(number)
        self.up = [0] * len(self.step)
        #: The nearest state on the way up that ends a phrase, 0 for none.
        self.also = [0] * len(self.step)
        todo = deque(self.step[0].values())
        while todo:
            at = todo.popleft()
            for w, below in self.step[at].items():
                back = self.up[at]
                while back and w not in self.step[back]:
                    back = self.up[back]
                self.up[below] = self.step[back].get(w, 0)
                todo.append(below)
            over = self.up[at]
            self.also[at] = over if self.ends[over] else self.also[over]

    def found(self, words: list[str]) -> set[int]:
        """Numbers of the phrases that stand in the words."""
        step, up, out, at = self.step, self.up, set(), 0
        hit: set[int] = set()
        for w in words:
            while at and w not in step[at]:
                at = up[at]
            at = step[at].get(w, 0)
            end = at if self.ends[at] else self.also[at]
            while end and end not in hit:
                hit.add(end)
                out.update(self.ends[end])
                end = self.also[end]
        return out


def _blocks(bank: DataFrame, item_id: str, words, block_chars: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for item, phrase in bank.select(F.col(item_id).alias("i"), words.alias("p")).where("p <> ''").toLocalIterator():
        if block and size + len(phrase) > block_chars:
            yield block
            block, size = [], 0
        block.append((item, phrase))
        size += len(phrase)
    if block:
        yield block


def phrase_matches(df: DataFrame, row_id: str, text: str, bank: DataFrame, item_id: str, item_text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row_id, item_id, match``: rows that equal or contain (word for word) an item of the bank.

    Items without a word match nothing; repeated items match each for itself.
    """
    joined = lambda c: F.coalesce(F.array_join(X.lower_words(F.col(c)), " "), F.lit(""))
    rows = df.select(F.col(row_id), joined(text).alias("_t"))
    schema = T.StructType([rows.schema[row_id], T.StructField(item_id, bank.schema[item_id].dataType), T.StructField("match", T.StringType())])
    out = None
    for block in _blocks(bank, item_id, joined(item_text), block_chars):
        shared = df.sparkSession.sparkContext.broadcast((PhraseTrie([p.split(" ") for _, p in block]), block))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            trie, items = shared.value
            for pdf in batches:
                hits = [(r, items[n][0], "equal" if items[n][1] == t else "contains") for r, t in zip(pdf[row_id], pdf["_t"]) for n in sorted(trie.found(t.split(" ")))]
                yield pd.DataFrame(hits, columns=schema.names)

        part = rows.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return df.sparkSession.createDataFrame([], schema) if out is None else out
