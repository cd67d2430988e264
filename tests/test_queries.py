"""Every registered query runs; those with SQL give the same rows as DuckDB on the same files."""

import pytest

from oracle import DATA, compare, views
from tripwave.plans.catalog import QUERIES, SQL

FOLDER = f"{DATA}/sf0.001"
SLOW = {"train_oof", "search", "ablate_features", "ablate_data", "isotonic", "forest_vote"}
SLOW_FACTS = {"train_oof_facts", "search_facts", "ablate_features_facts", "isotonic_facts"}  # the driver compares them


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW_FACTS))
def test_same_rows_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["zscore_global", "params_broadcast", "ks_two_sample", "label_index", "histogram",
                                  "random_group_holdout", "control_trip", "balanced_weights"])
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
