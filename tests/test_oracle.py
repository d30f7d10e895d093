"""Every check query against its SQL on DuckDB."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from exprlake.queries import all_oracles as oracle_sql
from exprlake.queries import all_queries as queries

from .compare import TESTDATA, duck, mismatch

SF = f"{TESTDATA}/sf0.001"
# No supplier of the smallest data set has a negative balance.
EMPTY_HERE = {"keep_samples"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", list(queries()))
def test_equals_duckdb(spark, con, key):
    problem = mismatch(queries()[key](spark, SF), con, oracle_sql()[key])
    assert problem is None or (key in EMPTY_HERE and problem == "both sides are empty")


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["job_id", "gene_id", "sequenced_id", "value"]
