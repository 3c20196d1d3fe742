import pytest
from checks import DATA, same_rows

from docket_spark.plans import oracle, queries

SLOW = {"train_rf", "train_lr", "forward_cv", "grid_search", "importances", "score_rows", "compare_estimators", "ablation_refit"}


@pytest.mark.parametrize("name", [n for n in queries.NAMES if n in oracle.SQL])
def test_query_equals_sql(spark, duck, name):
    found = duck.sql(oracle.SQL[name])
    same_rows(queries.QUERIES[name](spark, DATA), found.columns, found.fetchall())


def test_every_query_without_sql_is_a_model():
    assert set(queries.NAMES) - set(oracle.SQL) == SLOW


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert set(e.oracle_sql()) <= set(e.queries())
