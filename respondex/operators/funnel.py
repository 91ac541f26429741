"""Consistency of choices along a brand funnel and coherence of a respondent's claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from respondex.functions.ranking import attach_row


def brand_funnel(df: DataFrame, id_col: str, brand: str, stage: str, exclusive: Column) -> DataFrame:
    """Brands per funnel stage and breaks between stages, from one row per (respondent, brand).

    Stages: aware, considered, used. ``exclusive`` marks a "none of these" choice,
    which contradicts any named brand.
    """
    has = lambda s: F.max((F.col(stage) == s).cast("int"))
    per = df.groupBy(id_col, brand).agg(has("aware").alias("a"), has("considered").alias("c"), has("used").alias("u"), F.max(exclusive.cast("int")).alias("x"))
    out = per.groupBy(id_col).agg(
        F.sum("a").alias("n_aware"), F.sum("c").alias("n_considered"), F.sum("u").alias("n_used"),
        F.sum(F.col("u") * (1 - F.col("a"))).alias("used_not_aware"), F.sum(F.col("c") * (1 - F.col("a"))).alias("considered_not_aware"), F.max("x").alias("chose_none"),
    )
    return out.withColumn("exclusive_contradiction", ((F.col("chose_none") == 1) & (F.col("n_aware") > 0)).cast("int")).withColumn(
        "funnel_consistent", ((F.col("used_not_aware") == 0) & (F.col("considered_not_aware") == 0)).cast("int")
    )


def coherence(df: DataFrame, hard: dict[str, Column], soft: dict[str, Column]) -> DataFrame:
    """Lists of hard and soft contradictions and the status they lead to."""
    found = lambda rules: F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    out = df.withColumn("hard_invalidities", found(hard)).withColumn("soft_concerns", found(soft))
    n_hard, n_soft = F.size("hard_invalidities"), F.size("soft_concerns")
    return out.withColumn(
        "coherence_status",
        F.when(n_hard > 0, "incoherent_hard").when(n_soft >= 3, "incoherent_soft").when(n_soft >= 1, "minor_concern").otherwise("coherent"),
    )


def concern_lift(df: DataFrame, concerns: str, rejected: str) -> DataFrame:
    """Share of rejected and of accepted respondents with each concern, and their ratio."""
    d = df.where(F.col(rejected).isNotNull())
    sizes = d.agg(F.sum(rejected).alias("nr"), F.sum(1 - F.col(rejected)).alias("na"))
    e = d.select(rejected, F.explode(concerns).alias("concern")).groupBy("concern").agg(F.sum(rejected).alias("r"), F.sum(1 - F.col(rejected)).alias("a"))
    rr, ra = F.coalesce(F.try_divide("r", "nr"), F.lit(0.0)), F.coalesce(F.try_divide("a", "na"), F.lit(0.0))
    return attach_row(e, sizes).select(
        "concern", F.round(rr, 4).alias("rejected_rate"), F.round(ra, 4).alias("accepted_rate"), F.round(rr / F.greatest(ra, F.lit(0.001)), 2).alias("lift")
    )


def marker_family_share(df: DataFrame, markers: str, rejected: str, separator: str = ";") -> DataFrame:
    """Mentions per marker family (text before ``/``), split by label."""
    e = df.where(F.col(rejected).isNotNull()).select(rejected, F.explode(F.split(markers, separator)).alias("m"))
    e = e.select(rejected, F.trim(F.split_part("m", F.lit("/"), F.lit(1))).alias("family")).where("family <> ''")
    out = e.groupBy("family").agg(F.count(F.lit(1)).alias("mentions"), F.sum(rejected).alias("rejected_mentions"), F.sum(1 - F.col(rejected)).alias("accepted_mentions"))
    return out.withColumn("rejected_share", F.round(F.col("rejected_mentions") / F.col("mentions"), 6))
