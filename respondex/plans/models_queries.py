"""Queries over risk models; results depend on optimisers, so they have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.operators import models as M
from respondex.operators import signals as G
from respondex.operators.isolation import isolation_scores
from respondex.plans.catalog import query
from respondex.plans.integrity_queries import split_frame
from respondex.plans.study import respondent_texts, scored_frame, vectors
from respondex.session import ensure_checkpoint_dir
from respondex.sources.stages import stage

FEATURES = (*[f"f_{s}" for s in G.SIGNALS], *[f"g_{g}" for g in G.GUARDS], "word_count", "unique_token_ratio", "missing_rate", "modal_share")
SMALL = ("f_hostile", "f_repeated_phrase", "word_count", "unique_token_ratio", "modal_share")


def frame(spark, sf):
    return scored_frame(spark, sf).select("respondent_id", "dataset_id", "supplier", "rejected", "text_digest", *FEATURES)


def parts(spark, sf):
    """Train, validation and test rows by the stratified split, from a stage table: fitting reads them many times."""

    def build():
        return frame(spark, sf).join(split_frame(spark, sf).select("respondent_id", "split"), "respondent_id")

    d = stage(spark, sf, "model_rows", build)
    return tuple(d.where(F.col("split") == x).drop("split") for x in ("train", "val", "test"))


@query("c22_svd_reduce")
def c22(spark, sf):
    return M.svd_reduce(respondent_texts(spark, sf), "respondent_id", "open_text")


@query("s11_kmeans_cluster")
def s11(spark, sf):
    return M.kmeans_clusters(vectors(spark, sf), "respondent_id", "embedding", "rejected", F.pmod("respondent_id", F.lit(5)) != 0)


@query("s14_isolation_score")
def s14(spark, sf):
    return isolation_scores(frame(spark, sf), "respondent_id", ("word_count", "unique_token_ratio", "missing_rate", "modal_share"))


@query("d30_estimate_reject_rate")
def d30(spark, sf):
    p = scored_frame(spark, sf).groupBy("supplier").agg(
        F.avg("word_count").alias("mean_words"), F.avg("unique_token_ratio").alias("mean_variety"), F.avg("f_duplicate_open").alias("dup_rate"), F.avg("rejected").alias("reject_rate")
    )
    return M.estimate_reject_rate(p, "supplier", ("mean_words", "mean_variety", "dup_rate"), "reject_rate")


@query("p03_logistic_risk_oof")
def p03(spark, sf):
    d = stage(spark, sf, "labelled_rows", lambda: frame(spark, sf).where("rejected IS NOT NULL"))
    return M.leave_one_out(d, FEATURES, "rejected", "dataset_id", "text_digest").select("respondent_id", "dataset_id", "rejected", "probability")


@query("p04_gbt_risk_importance")
def p04(spark, sf):
    train, _, _ = parts(spark, sf)
    return M.importances(M.fit(train, FEATURES, "rejected", "boosted"), FEATURES, spark)


@query("p05_isotonic_calibrate")
def p05(spark, sf):
    train, val, test = parts(spark, sf)
    m = M.fit(train, SMALL, "rejected")
    return M.isotonic(M.score(m, val, SMALL), M.score(m, test, SMALL), "probability", "rejected").select("respondent_id", "rejected", "probability", "calibrated")


def members(train, df):
    a = M.score(M.fit(train, SMALL, "rejected"), df, SMALL, "logistic").select("respondent_id", "rejected", "logistic")
    b = M.score(M.fit(train, SMALL, "rejected", "boosted"), df, SMALL, "boosted").select("respondent_id", "boosted")
    return M.ensemble([a, b], "respondent_id", ["logistic", "boosted"])


@query("p06_ensemble_stack")
def p06(spark, sf):
    train, val, test = parts(spark, sf)
    return M.stack(members(train, val), members(train, test), ["logistic", "boosted"], "rejected")


@query("p07_self_train")
def p07(spark, sf):
    d = frame(spark, sf)
    model, train, rounds = M.self_train(d.where("rejected IS NOT NULL"), d.where("rejected IS NULL"), SMALL, "rejected", "respondent_id", confident=0.75, rounds=2)
    return M.score(model, d, SMALL).select("respondent_id", "rejected", "probability", F.lit(rounds).alias("rounds"))


@query("p09_oversample_minority")
def p09(spark, sf):
    return M.oversample_minority(frame(spark, sf), "respondent_id", SMALL, "rejected")


@query("p10_iterative_reweight")
def p10(spark, sf):
    return M.iterative_reweight(frame(spark, sf), SMALL, "rejected", "respondent_id", rounds=2)


@query("p11_two_stage")
def p11(spark, sf):
    train, _, test = parts(spark, sf)
    return M.two_stage(train, test, SMALL, "rejected", "respondent_id").select("respondent_id", "rejected", "base", "specialist", "final")


@query("p11_channel_models")
def p11b(spark, sf):
    train, _, test = parts(spark, sf)
    out = M.per_channel(train, test, SMALL, "rejected", "dataset_id", min_rows=100)
    return M.gated_expert(out, "global_score", "channel_score", F.col("global_score").between(0.3, 0.7)).select("respondent_id", "dataset_id", "rejected", "global_score", "channel_score", "final", "gated")


@query("p11_transfer_base_score")
def p11c(spark, sf):
    train, _, test = parts(spark, sf)
    en = F.col("dataset_id") == "en"
    return M.transfer(train.where(~en), train.where(en), test.where(en), SMALL, "rejected").select("respondent_id", "rejected", "base_score", "probability")


@query("p12_leakage_audit")
def p12(spark, sf):
    train, _, test = parts(spark, sf)
    leak = lambda d: d.withColumn("f_leak", F.col("rejected").cast("double"))
    return M.leakage_audit(leak(train), leak(test), "rejected", {"small": SMALL, "signals_only": FEATURES[: len(G.SIGNALS)], "with_outcome_column": (*SMALL, "f_leak")})


@query("p14_score_unseen")
def p14(spark, sf):
    """Saved in the shared checkpoint folder, loaded again and applied to rows without label."""
    train, _, _ = parts(spark, sf)
    path = M.save_model(M.fit(train, SMALL, "rejected"), f"{ensure_checkpoint_dir(spark)}/model_{spark.sparkContext.applicationId}")
    unseen = scored_frame(spark, sf).where("rejected IS NULL").select("respondent_id", "f_hostile", "word_count", "unique_token_ratio")
    return M.score_unseen(path, unseen, SMALL, {"modal_share": 0.5})
