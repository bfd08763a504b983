"""Every query with SQL is compared with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from loomgrid.plans.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame, columns):
    out = []
    for r in frame:
        out.append(tuple("null" if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in (r[c] for c in columns)))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    d.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    if name not in ORACLE_SQL:
        assert got.count() >= 0
        return
    rel = duck.sql(ORACLE_SQL[name])
    columns = sorted(rel.columns)
    assert sorted(got.columns) == columns
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert rows([r.asDict() for r in got.collect()], columns) == rows(want, columns)
