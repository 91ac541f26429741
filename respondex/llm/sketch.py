"""A key filter of fixed size: which rows may have a key of a table, told without sending the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: 2**22 bits are 512 KiB on every executor, whatever the number of keys.
FILTER_BITS = 22
PROBES = 2


def key_filter(keys: DataFrame, col: str) -> np.ndarray:
    """Bit field of the column ``col``. It is built by aggregation into at most 2**16 words of 64 bits.

    It never misses a key and lets a few others through: it saves work, and
    what it lets through must still meet the exact join. With very many keys it
    lets everything through, and the join does all the work.
    """
    h = F.xxhash64(F.col(col))
    bits = keys.select(F.explode(F.array(*[F.shiftrightunsigned(h, FILTER_BITS * p).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for p in range(PROBES)])).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    field = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    found = words.toArrow()
    field[found["word"].to_numpy()] = found["bits"].to_numpy()
    return field


def possible_rows(df: DataFrame, col: str, field: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose ``col`` may be in the filter. It travels as a broadcast variable, not as a literal that every plan would print."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.view(np.uint64)
        for batch in batches:
            h = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            inside = np.ones(len(h), dtype=bool)
            for p in range(PROBES):
                bit = (h >> np.uint64(FILTER_BITS * p)) & np.uint64((1 << FILTER_BITS) - 1)
                inside &= (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            if inside.any():
                yield batch.filter(pa.array(inside)).select(batch.schema.names[:-1])

    return df.select("*", F.xxhash64(F.col(col)).alias("_filter_hash")).mapInArrow(run, df.schema)
