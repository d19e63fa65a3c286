import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(set(entry.oracle_sql()) - {n for n in entry.oracle_sql() if n.startswith("op")})


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or v.__class__.__name__ == "Decimal":
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.bank for r in rows} == {"FED", "ECB"} and all(-1 <= r["index"] <= 1 for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    have = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    have.sort(key=order)
    want.sort(key=order)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)
