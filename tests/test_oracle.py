"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from concourse.plans import load_all

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in NAMES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    f = float(v)
    return "nan" if math.isnan(f) else repr(round(f, 6) + 0.0)


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_query(spark, con, key):
    query = REGISTRY[key]
    df = query.build(spark, FOLDER)
    rows = df.collect()
    if query.sql is None:
        assert df.columns
        return
    cursor = con.execute(query.sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    assert got == want
