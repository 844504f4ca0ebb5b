"""Every registered query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def norm(rows):
    return sorted(tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = norm(df.select(*cols).collect())
    if name not in entry.oracle_sql():
        assert got
        return
    cur = sql.execute(entry.oracle_sql()[name])
    place = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(place) == cols
    assert got == norm([r[place[c]] for c in cols] for r in cur.fetchall())


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.text.startswith("*Listing digest")
