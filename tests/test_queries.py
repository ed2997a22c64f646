"""Every named query against its SQL twin, on the smallest tables."""

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meterlens.catalog import ORACLES, QUERIES  # those of the llm folder have tests of their own
from meterlens.catalog import jobs
from meterlens.config import JobParams


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    _, diff = compare(spark, con, QUERIES[name], ORACLES[name], sf)
    assert diff == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_model_queries_train_the_full_forest(spark, sf):
    """As many trees as the job's defaults ask for, whatever the fixtures of the tests use."""
    forest = jobs.trained_models(spark, sf).forest
    trees = [r[0] for r in forest.groupBy("segment").agg(F.countDistinct("tree").alias("n")).select("n").collect()]
    assert trees and set(trees) == {JobParams().anomaly.n_estimators}
