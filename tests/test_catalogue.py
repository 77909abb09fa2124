"""Every query against DuckDB over the same files. Staged inputs are shared between the queries."""

import pytest

import __spark_entry__ as entry_module
from appconv.catalogue import oracle
from appconv.catalogue.queries import CATALOGUE, Inputs
from tests.comparing import compare, connect

FOLDER = "/root/testdata/sf0.01"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, FOLDER)


def test_names_agree():
    assert set(SQL) == set(CATALOGUE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, inputs, name):
    assert compare(spark, lambda s, f: CATALOGUE[name](inputs), SQL[name], FOLDER, con) == []


def test_models_are_compared_on_the_same_cells(inputs):
    rows = {r["model"]: r for r in CATALOGUE["compare_models"](inputs).collect()}
    assert set(rows) == {"logistic", "binning"}
    assert rows["logistic"]["cells"] == rows["binning"]["cells"] > 0
    assert rows["logistic"]["weight"] == rows["binning"]["weight"]


def test_entry(spark):
    df = entry_module.entry(spark)
    assert "nCVU" in df.columns and df.count() > 0
