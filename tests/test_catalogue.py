"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from estatelens.plans import catalogue, catalogue_graph, catalogue_history, catalogue_more  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(repr([None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r]) for r in pdf[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    assert rows(got) == rows(duck.execute(catalogue.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
