"""Every registered query with SQL gives the rows that DuckDB gives; those without give rows with a stable schema."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from contactsheet import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["month", "n", "cover_id", "first_ts", "last_ts"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_groups_hold_all_copies(spark, db):
    found = {}
    for r in plans.queries()["g6_groups"](spark, SF).where("kind = 'exact'").collect():
        found.setdefault(r.root, set()).add(r.id)
    photos = plans.similarity.Library(spark, SF).photos.select("sha256", "id").collect()
    copies = {}
    for r in photos:
        copies.setdefault(r.sha256, set()).add(r.id)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in copies.values() if len(v) > 1)
