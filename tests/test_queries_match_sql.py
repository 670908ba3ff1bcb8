"""Every registered query of the archive model against its SQL."""

import datetime

import duckdb
import pytest

from threadloom.plans.registry import ORACLE_SQL, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=key)


def test_flagship(spark, sf_dir):
    assert flagship(spark, sf_dir).count() > 0
