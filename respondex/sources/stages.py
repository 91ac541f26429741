"""Stage tables: results that many later steps read, written once per session.

A stage is a parquet table in the shared checkpoint folder, so it survives the
loss of executors and nothing recomputes the text work behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from respondex.session import ensure_checkpoint_dir

_written: dict[tuple[str, str, str], str] = {}


def stage(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from ``source``; built and written on first use in this application."""
    app = spark.sparkContext.applicationId
    key = (app, source, name)
    if key not in _written:
        tag = hashlib.md5(source.encode()).hexdigest()[:10]
        path = f"{ensure_checkpoint_dir(spark)}/stages_{app}/{name}_{tag}"
        build().write.mode("overwrite").parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
