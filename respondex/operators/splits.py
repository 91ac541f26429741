"""Reproducible splits and label-safe preparation of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from respondex.functions import ranking as R
from respondex.operators.evaluation import div, hash_score


def stratified_split(df: DataFrame, strata: Sequence[str], id_col: str, seed: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Exact shares of train, val and test in every stratum, ordered by a hash of the id.

    The assignment depends on ids and seed only, not on partitions or task order.
    """
    d = df.withColumn("_h", hash_score(id_col, seed))
    p = R.positions(d, strata, "_h", id_col, out="_pos")
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    share = (F.col("_pos") - 1) / F.col("_n")
    return R.attach_groups(p, sizes, list(strata), "inner").withColumn("split", F.when(share < train, "train").when(share < train + val, "val").otherwise("test")).drop("_h", "_pos", "_n")


def folds(id_col: str, seed: str, k: int) -> Column:
    return F.floor(hash_score(id_col, seed) * k).cast("int")


def duplicate_safe(train: DataFrame, test: DataFrame, digest: str) -> DataFrame:
    """Training rows whose text does not occur in the test rows."""
    seen = test.where(F.col(digest).isNotNull()).select(digest).distinct()
    return train.join(seen, digest, "left_anti")


def mutual_information(df: DataFrame, label: str, features: Sequence[str], top: int) -> DataFrame:
    """Mutual information (nats) of discrete or binned features with the label, best ``top``."""
    d = df.where(F.col(label).isNotNull())
    long_ = d.select(label, *[F.col(f).cast("string").alias(f) for f in features]).unpivot([label], list(features), "feature", "v").where("v IS NOT NULL")
    joint = long_.groupBy("feature", "v", label).agg(F.count(F.lit(1)).alias("c"))
    by_v = joint.groupBy("feature", "v").agg(F.sum("c").alias("cv"))
    by_y = joint.groupBy("feature", label).agg(F.sum("c").alias("cy"))
    n = joint.groupBy("feature").agg(F.sum("c").alias("n"))
    p = joint.join(by_v, ["feature", "v"]).join(by_y, ["feature", label]).join(n, "feature")
    term = F.col("c") / F.col("n") * F.log(F.col("c").cast("double") * F.col("n") / (F.col("cv").cast("double") * F.col("cy")))
    return p.groupBy("feature").agg(F.round(F.sum(term), 9).alias("mutual_information")).orderBy(F.col("mutual_information").desc(), "feature").limit(top)


def equal_width_bin(c: Column, lo: float, hi: float, bins: int) -> Column:
    return F.least(F.greatest(F.floor((c - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")


def coverage_gate(df: DataFrame, id_col: str, evidence: DataFrame, columns: Sequence[str], min_share: float = 0.05) -> DataFrame:
    """Attach external evidence; absent evidence stays NULL with an indicator.

    A column is used only if it covers more than ``min_share`` of the rows; the
    others become NULL for everybody.
    """
    j = df.join(evidence.select(id_col, *columns), id_col, "left")
    cover = j.agg(*[div(F.count(c), F.count(F.lit(1))).alias(f"_c_{c}") for c in columns])
    out = R.attach_row(j, cover)
    for c in columns:
        use = F.col(f"_c_{c}") > min_share
        out = out.withColumn(f"has_{c}", F.when(use, F.col(c).isNotNull().cast("int")).otherwise(0)).withColumn(c, F.when(use, F.col(c)))
    return out.drop(*[f"_c_{c}" for c in columns])
