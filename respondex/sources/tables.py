"""Readers and writers. Schemas are declared by the files (parquet) or by the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of few splits over all cores before work that is heavy per row.

    A large table has far more splits than cores and is left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_responses(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A respondent table with trimmed header names."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return trim_headers(df)


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def load_judgments(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, lines: str | None = "*", whole: str | None = None,
    evidence: str | None = None, evidence_schema: T.StructType | str | None = None,
) -> DataFrame:
    """Judgment chunks from many JSON files: the declared columns, ``chunk_file``, ``corrupt_record`` and, on request, the evidence parsed.

    File names that match the glob ``lines`` hold one object a line and are split
    between tasks; names that match ``whole`` hold one array or object over many
    lines. What is no JSON (a line of the first, a file of the second) stays as
    one row with ``corrupt_record`` and nulls elsewhere. ``evidence`` names a
    string column that holds JSON itself: it is replaced by a struct of
    ``evidence_schema``, null where there is none, and ``evidence_bad`` tells
    the rows where it was there and could not be read.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wanted = T.StructType([*wanted.fields, T.StructField("corrupt_record", T.StringType())])
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for glob, many_lines in ((lines, False), (whole, True)):
        if glob is None:
            continue
        reader = spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_record")
        part = reader.option("multiLine", many_lines).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(paths).withColumn("chunk_file", F.col("_metadata.file_name"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("name files with lines or whole files")
    if evidence is None:
        return out
    inner = T._parse_datatype_string(evidence_schema) if isinstance(evidence_schema, str) else evidence_schema
    inner = T.StructType([*inner.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json(F.col(evidence), inner, {"columnNameOfCorruptRecord": "_broken"})
    out = out.withColumn("_parsed", parsed).withColumn("evidence_bad", F.col(evidence).isNotNull() & (F.col("_parsed").isNull() | F.col("_parsed._broken").isNotNull()))
    return out.withColumn(evidence, F.when(F.col(evidence).isNotNull() & ~F.col("evidence_bad"), F.col("_parsed").dropFields("_broken"))).drop("_parsed")


def latest_per_id(df: DataFrame, id_col: str, order_cols: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per id: the first or the last in ``order_cols``.

    ``max_by``/``min_by`` combine on the map side, so an id that repeats a
    billion times is reduced before the shuffle; no sort of a hot group.
    """
    others = [c for c in df.columns if c != id_col]
    pick = F.max_by if keep == "last" else F.min_by
    order = F.struct(*[F.col(c) for c in order_cols])
    return (
        df.groupBy(id_col)
        .agg(pick(F.struct(*others), order).alias("_row"), F.count(F.lit(1)).alias("n_versions"))
        .select(id_col, "_row.*", "n_versions")
    )


def union_corpora(frames: dict[str, DataFrame], id_cols: Sequence[str] = ()) -> DataFrame:
    """Union by name of data sets with different columns; the absent ones are NULL."""
    out: DataFrame | None = None
    for dataset_id, df in frames.items():
        part = df.withColumn("dataset_id", F.lit(dataset_id))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no data sets given")
    return out


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> list[str]:
    """One folder per table under ``root``; formats parquet, csv, json (lines), orc."""
    written = []
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        target = f"{root}/{name}"
        writer.save(target)
        written.append(target)
    return written
