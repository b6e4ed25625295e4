"""Every archive query against its SQL, run by DuckDB on the same small tables."""

import math

import duckdb
import pytest

from ledgerloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(map(_norm, r)) for r in df.select(*cols).collect())
    res = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want
