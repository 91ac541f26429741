"""Connected components of a link table as DataFrame joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from respondex.llm.base import stored


def _min_join(edges: DataFrame) -> DataFrame:
    """Replace (u, v) by (v, least of u's own neighbourhood)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of the links; the label is the smallest node of its component.

    Links may repeat, be given in one direction only or join a node with
    itself; rows with a null end are left out. Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the size of
    the largest component. Minima are combined before the shuffle, and the join
    of a hub with its own neighbours is an inner join that Spark may split.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    edges = stored(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _min_join(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.where("u = v")).where("u >= v").distinct()
        small = _min_join(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stored(small.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
