"""Every registered query with SQL must give the same rows as DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tablegauge.queries import load_all

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = load_all()  # the queries of training text have tests of their own
QUERIES, ORACLE = REGISTRY.QUERIES, REGISTRY.ORACLE
# fitted sweeps take long and have no SQL; random_search is in test_tuning, the others are exercised by the model tests
SLOW = {"random_search", "classifier_sweep_and_vote", "train_classifiers", "datetime_mutual_information"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    theirs = [d[0] for d in found.description]
    assert sorted(mine.columns) == sorted(theirs)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(theirs, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 11  # one row per column of lineitem
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
