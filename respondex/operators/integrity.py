"""Seals, strict joins, reconciliation and rule checks of judgments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


class BoundaryError(ValueError):
    """An evaluation step met data that it must not use."""


def row_fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of the row's values in the given order; NULL differs from blank."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)


def seal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: number of rows and a digest that does not depend on their order.

    The digest hashes the sums of four 60-bit pieces of the row fingerprints.
    Sums combine anywhere, so nothing is sorted or collected.
    """
    fp = df.select(row_fingerprint(columns).alias("fp"))
    lanes = [F.sum(F.conv(F.substring("fp", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return fp.agg(F.count(F.lit(1)).alias("n_rows"), *[x.alias(f"l{i}") for i, x in enumerate(lanes)]).select(
        "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[F.coalesce(f"l{i}", F.lit("0")) for i in range(4)]), 256).alias("digest")
    )


def verify_seal(df: DataFrame, columns: Sequence[str], sealed: DataFrame | None) -> None:
    """Raises unless ``df`` has the sealed digest. Runs one small aggregate."""
    if sealed is None:
        raise BoundaryError("ledger is not sealed")
    want, got = sealed.first(), seal(df, columns).first()
    if (want["n_rows"], want["digest"]) != (got["n_rows"], got["digest"]):
        raise BoundaryError("seal mismatch: rows changed after sealing")


def stable_id_report(predictions: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Counts of missing and duplicate ids on both sides and of predictions without label."""

    def side(df: DataFrame, name: str) -> DataFrame:
        blank = F.col(id_col).isNull() | (F.trim(F.col(id_col).cast("string")) == "")
        per = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("c"))
        return per.agg(
            F.coalesce(F.sum(F.when(blank, F.col("c")).otherwise(0)), F.lit(0)).alias(f"{name}_missing"), F.coalesce(F.sum(F.when(~blank & (F.col("c") > 1), F.col("c") - 1).otherwise(0)), F.lit(0)).alias(f"{name}_duplicates")
        )

    lost = predictions.join(labels.select(id_col), id_col, "left_anti").agg(F.count(F.lit(1)).alias("predictions_without_label"))
    one = side(predictions, "prediction").crossJoin(F.broadcast(side(labels, "label"))).crossJoin(F.broadcast(lost))  # one row each
    bad = sum(F.col(c) for c in one.columns)
    return one.withColumn("passed", (bad == 0).cast("int"))


def join_by_stable_id(predictions: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Joins by id, or raises when ids are missing, repeated or without label."""
    r = stable_id_report(predictions, labels, id_col).first()
    if r["prediction_missing"] or r["label_missing"]:
        raise BoundaryError("stable id missing")
    if r["prediction_duplicates"] or r["label_duplicates"]:
        raise BoundaryError("stable id duplicate")
    if r["predictions_without_label"]:
        raise BoundaryError("stable id without label")
    return predictions.join(labels, id_col)


def reconcile(predictions: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """Full outer match of ids with a status per id; sides are counted per id before they meet."""
    p = predictions.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_predictions"))
    q = labels.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_labels"), F.max(label).alias(label))
    j = p.join(q, id_col, "full")
    status = (
        F.when(F.col("n_labels").isNull(), "prediction_only").when(F.col("n_predictions").isNull(), "label_only").when(F.col(label).isNull(), "unresolved_status")
        .when((F.col("n_predictions") > 1) | (F.col("n_labels") > 1), "duplicate_key").otherwise("matched_one_to_one")
    )
    return j.select(id_col, F.coalesce("n_predictions", F.lit(0)).alias("n_predictions"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"), status.alias("status"))


def decision_changes(before: DataFrame, after: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Rows that are gone and protected columns that differ, NULLs compared as values."""
    b = before.select(id_col, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    a = after.select(id_col, F.lit(1).alias("_in"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    j = b.join(a, id_col, "left")
    found = F.array_compact(
        F.array(
            F.when(F.col("_in").isNull(), F.struct(F.lit("row_missing").alias("column"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))),
            *[
                F.when(F.col("_in").isNotNull() & ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), F.struct(F.lit(c).alias("column"), F.col(f"b_{c}").alias("before"), F.col(f"a_{c}").alias("after")))
                for c in columns
            ],
        )
    )
    return j.select(id_col, F.explode(found).alias("x")).select(id_col, "x.*")


def assert_unchanged(before: DataFrame, after: DataFrame, id_col: str, columns: Sequence[str]) -> None:
    bad = decision_changes(before, after, id_col, columns).take(1)
    if bad:
        raise BoundaryError(f"decision changed: {bad[0][id_col]} {bad[0]['column']}")


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """One row per (id, violated rule)."""
    return df.select(id_col, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))).alias("violation"))


def required(columns: Sequence[str]) -> dict[str, Column]:
    return {f"missing:{c}": F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns}


def one_of(column: str, values: Sequence[str]) -> dict[str, Column]:
    return {f"invalid:{column}": F.col(column).isNotNull() & ~F.col(column).isin(*values)}


def in_range(column: str, lo: float, hi: float) -> dict[str, Column]:
    return {f"range:{column}": (F.col(column) < lo) | (F.col(column) > hi)}


def review_rate_check(df: DataFrame, judgment: str, limit: float) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(judgment) == "REVIEW").cast("int")).alias("reviews"))
    rate = F.try_divide(F.col("reviews").cast("double"), F.col("n").cast("double"))
    return one.select("n", "reviews", F.round(rate, 6).alias("review_rate"), (rate > limit).cast("int").alias("exceeds_limit"))


def completeness_audit(source: DataFrame, predictions: DataFrame, id_col: str, probability: str) -> DataFrame:
    """Every input row has exactly one prediction with a probability in [0, 1]."""
    i = source.agg(F.count(F.lit(1)).alias("input_rows"))
    per = predictions.groupBy(id_col).agg(F.count(F.lit(1)).alias("c"), F.sum((F.col(probability).isNull() | (F.col(probability) < 0) | (F.col(probability) > 1)).cast("int")).alias("bad"))
    p = per.agg(F.sum("c").alias("prediction_rows"), F.sum(F.col("c") - 1).alias("duplicate_prediction_ids"), F.sum("bad").alias("invalid_probability_rows"))
    passed = (F.col("input_rows") == F.col("prediction_rows")) & (F.col("duplicate_prediction_ids") == 0) & (F.col("invalid_probability_rows") == 0)
    return i.crossJoin(F.broadcast(p)).withColumn("passed", passed.cast("int"))
