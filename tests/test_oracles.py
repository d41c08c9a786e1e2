"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, difference, spark_rows, sql_rows

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
MODELS = [n for n in queries() if n.startswith("model_")]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert difference(spark_rows(queries()[name](spark, FOLDER)), sql_rows(duck, oracle_sql()[name])) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", MODELS)
def test_models_score_both_tasks(spark, name):
    rows = queries()[name](spark, FOLDER).collect()
    assert {r.task for r in rows} == {"cd", "sober_cd"}
    assert all(r.tp + r.tn + r.fp + r.fn > 0 and 0 <= r.auc <= 1 for r in rows)
