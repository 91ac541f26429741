"""Exact copies: counts, groups, clusters, template signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from respondex.config import SignalConfig
from respondex.functions import text as X
from respondex.functions import ranking as R


def text_key(text: str):
    """Digest of the normal form: the shuffle moves 32 characters instead of whole texts."""
    t = X.norm(F.col(text))
    return F.when(t != "", F.md5(t))


def exact_duplicates(df: DataFrame, row_id: str, text: str, min_chars: int = 0) -> DataFrame:
    """How many rows share the normalised text. Blank and shorter texts have no copies."""
    keyed = df.withColumn("_k", F.when(F.length(X.norm(F.col(text))) >= min_chars, text_key(text)))
    out = R.with_group_stats(keyed, ["_k"], row_id, dup_count=F.count(F.lit(1)))
    n = F.when(F.col("_k").isNull(), 0).otherwise(F.col("dup_count"))
    return out.withColumn("dup_count", n.cast("long")).withColumn("is_duplicate", (F.col("dup_count") > 1).cast("int")).drop("_k")


def duplicate_groups(df: DataFrame, row_id: str, field: str, text: str, min_chars: int = 16, first_ids: int = 10) -> DataFrame:
    """Groups of equal texts per field: size and the first ids.

    The ids are cut to ``first_ids`` before they are collected; the rank filter
    is applied on the map side too, so a giant group sends a few rows only.
    """
    keyed = df.where(F.length(X.squash(F.coalesce(F.col(text), F.lit("")))) >= min_chars).select(row_id, field, text_key(text).alias("text_hash"))
    sizes = keyed.groupBy(field, "text_hash").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    w = W.partitionBy(field, "text_hash").orderBy(row_id)
    firsts = (
        keyed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first_ids)
        .groupBy(field, "text_hash").agg(F.array_sort(F.collect_list(row_id)).alias("first_ids"))
    )
    return sizes.join(firsts, [field, "text_hash"])


def duplicate_values(df: DataFrame, field: str, text: str, cfg: SignalConfig, min_chars: int) -> DataFrame:
    """Values used at least twice per field, placeholders left out."""
    v = X.compact_words(F.col(text))
    keep = (F.length("value") >= min_chars) & ~F.col("value").rlike(cfg.placeholder_pattern)
    return df.select(field, v.alias("value")).where(keep).groupBy(field, "value").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows >= 2")


def cluster_types(df: DataFrame, key: str, dims: Sequence[str]) -> DataFrame:
    """Rows per key and different values of each dimension -> type of the cluster.

    Each (key, value) is reduced first, so a giant key never holds a set of values in memory.
    """
    d = df.where(F.col(key).isNotNull())
    out = d.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    for c in dims:
        per = d.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.lit(1).alias("one")).groupBy(key).agg(F.count(F.lit(1)).alias(f"{c}_n"))
        out = out.join(per, key, "left")
    one_source = F.lit(True)
    for c in dims:
        one_source = one_source & (F.coalesce(F.col(f"{c}_n"), F.lit(0)) <= 1)
    return out.withColumn(
        "cluster_type",
        F.when(F.col("n_rows") <= 1, "single").when(one_source, "shared_response_chain").otherwise("independent_duplicate_cluster"),
    )


def template_clusters(df: DataFrame, row_id: str, text: str, cfg: SignalConfig) -> DataFrame:
    """Rows whose template signature is long enough and shared by two rows or more."""
    sig = X.signature(F.col(text))
    keyed = df.withColumn("_sig", sig).withColumn("_k", F.when(F.length("_sig") >= cfg.min_signature_chars, F.md5("_sig")))
    out = R.with_group_stats(keyed, ["_k"], row_id, cluster_size=F.count(F.lit(1)))
    n = F.when(F.col("_k").isNull(), 0).otherwise(F.col("cluster_size"))
    return out.withColumn("cluster_size", n.cast("long")).withColumn("template_cluster", (F.col("cluster_size") >= 2).cast("int")).drop("_sig", "_k")


def rejected_only_duplicates(df: DataFrame, row_id: str, text: str, rejected: str, min_chars: int = 10) -> DataFrame:
    """Texts used by two rejected respondents or more and by no accepted one."""
    v = X.compact_words(F.col(text))
    d = df.where(F.col(rejected).isNotNull()).select(row_id, rejected, v.alias("value")).where(F.length("value") >= min_chars)
    per_row = d.groupBy("value", row_id, rejected).agg(F.lit(1).alias("one"))
    return (
        per_row.groupBy("value")
        .agg(F.sum((F.col(rejected) == 1).cast("int")).alias("rejected_rows"), F.sum((F.col(rejected) == 0).cast("int")).alias("accepted_rows"))
        .where("rejected_rows >= 2 AND accepted_rows = 0")
    )
