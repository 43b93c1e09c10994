"""Every registered query runs on the smallest tables, and agrees with its SQL where it has one."""

import pytest

import parity
from tabloom.plans import ORACLES, QUERIES

# minutes long even on the smallest tables; `python tests/parity.py` runs them
SLOW = {"train_adaboost_reg", "train_gbt_cls", "train_gbt_reg", "train_kernel_svm", "automl_holdout", "automl_classify",
        "kmeans_sweep", "dbscan", "train_adaboost_cls", "train_random_forest_reg", "train_extra_trees_reg"}


@pytest.fixture(scope="session")
def duck(tiny):
    return parity.connect(tiny)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, tiny, duck, name):
    assert parity.compare(QUERIES[name](spark, tiny), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 11
    assert set(e.oracle_sql()) <= set(e.queries())
