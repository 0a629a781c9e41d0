"""Every registered query with SQL gives the rows of that SQL."""

import math

import duckdb
import pytest

import alertlift.plans.trained  # noqa: F401  (registers its queries)
from alertlift.plans.oracles import ORACLES
from alertlift.plans.queries import QUERIES

TABLES = ("orders", "lineitem")


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def comparable(table, columns):
    def clean(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted((tuple(clean(r[c]) for c in columns) for r in table.to_pylist()), key=repr)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, sf_dir, name):
    mine = QUERIES[name](spark, sf_dir).toArrow()
    theirs = db.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(mine.column_names)
    assert sorted(theirs.column_names) == columns
    assert comparable(mine, columns) == comparable(theirs, columns)
    assert mine.num_rows > 0
