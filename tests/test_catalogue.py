"""Every query with SQL against DuckDB; the others give rows of a stable schema."""

import math
import os

import duckdb
import pytest

from braidseq.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def rows(got, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i]) for i in order) for r in got)


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in ("events", "documents", "orders", "lineitem"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, db, name):
    d, want = catalogue.QUERIES[name](spark, SF), db.sql(catalogue.SQL[name])
    assert sorted(d.columns) == sorted(want.columns)
    assert rows(d.collect(), d.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_scans_are_pruned(spark):
    plan = catalogue.event_seqs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]
