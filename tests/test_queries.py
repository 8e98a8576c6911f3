"""Every registered query against its SQL on the small tables."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry_points
from fleetsift.registry import load

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return round(value, 6) if isinstance(value, float) else value


def _sorted(rows, columns, order):
    return sorted(([_plain(row[columns.index(c)]) for c in order] for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    relation = duck.sql(ORACLES[name])
    order = sorted(frame.columns)
    assert order == sorted(relation.columns)
    assert _sorted(frame.collect(), frame.columns, order) == _sorted(relation.fetchall(), relation.columns, order)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and rows[0].RuleLevel == "critical"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
