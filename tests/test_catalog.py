"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest
from compare import compare, duck

from respondex.plans import load_catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOG = load_catalog()

#: Results of optimisers and random starts: no SQL says the same. All others must have a twin.
WITHOUT_SQL = {
    "c22_svd_reduce",
    "d30_estimate_reject_rate",
    "p03_logistic_risk_oof",
    "p04_gbt_risk_importance",
    "p05_isotonic_calibrate",
    "p06_ensemble_stack",
    "p07_self_train",
    "p09_oversample_minority",
    "p10_iterative_reweight",
    "p11_channel_models",
    "p11_transfer_base_score",
    "p11_two_stage",
    "p12_leakage_audit",
    "p14_score_unseen",
    "s11_kmeans_cluster",
    "s14_isolation_score",
}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    ok, message, _ = compare(spark, con, CATALOG[name], SF)
    assert ok, message


def test_only_named_queries_lack_sql():
    assert {n for n, q in CATALOG.items() if q.sql is None} == WITHOUT_SQL


def test_entry_contract():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert len(names) > 180
