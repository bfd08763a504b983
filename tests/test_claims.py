"""Claims between places on a line against the walk through all pairs."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import claims
from loomgrid.plans.queries import ORACLE_SQL, QUERIES
from loomgrid.sources import staged


def walk(left, right, reach):
    pairs = [(t is None, t or 0, abs(x - y), a, b, k) for a, k, t, x in left for b, m, y in right if None not in (a, b, k, x, y) and k == m and abs(x - y) <= reach]
    taken, out = set(), []
    for *_, a, b, k in sorted(pairs):
        if ("c", a, k) not in taken and ("s", b, k) not in taken:
            taken |= {("c", a, k), ("s", b, k)}
            out.append((a, b))
    return sorted(out)


def claimed(spark, left, right, reach, tier="t"):
    c = spark.createDataFrame(left, "c int, k string, t int, x double").repartition(3)
    s = spark.createDataFrame(right, "s long, m string, y double").repartition(3)
    out = claims.claim_near(c, s, "c", "s", "x", "y", reach, [("k", "m")], tier)
    assert out.dtypes == [("c", "int"), ("s", "bigint")]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("span", "step"), [(7, 0.01), (7, 25.0), (40, 1.0), (100_000, 1.0)])
def test_claims_over_many_stretches_are_those_of_a_walk(spark, monkeypatch, span, step):
    # crowded places with many ties, and places that are nearly all different
    monkeypatch.setattr(claims, "SPAN", span)
    rng = random.Random(3)
    at = lambda: round(rng.randrange(int(200 / step)) * step, 2)
    left = [(i, rng.choice("ab"), rng.choice((0, 1, None)), at()) for i in rng.sample(range(1000), 150)]
    right = [(i, rng.choice("abc"), at()) for i in rng.sample(range(1000), 90)]
    assert claimed(spark, left, right, 30.0) == walk(left, right, 30.0)


def test_claims_depend_on_a_far_chain(spark, monkeypatch):
    # each place is nearer to the next one than to the last, so the far end decides who is left
    monkeypatch.setattr(claims, "SPAN", 6)
    at = [sum(100 - i for i in range(j)) * 1.0 for j in range(60)]
    left, right = [(j, "a", 0, at[j]) for j in range(0, 60, 2)], [(j, "a", at[j]) for j in range(1, 59, 2)]
    assert claimed(spark, left, right, 100.0) == walk(left, right, 100.0)


def test_claims_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(claims, "SPAN", 4)
    inf, nan = float("inf"), float("nan")
    left = [(1, "a", 0, 0.0), (1, "a", 0, 0.0), (2, "a", 0, -0.0), (3, "a", None, 5.0), (4, None, 0, 1.0), (None, "a", 0, 1.0), (5, "a", 0, None), (6, "a", 0, inf), (7, "a", 0, nan), (8, "b", 0, 9.0), (-9, "a", 1, 6.0)]
    right = [(1, "a", -0.0), (2, "a", 0.0), (2, "a", 0.0), (3, "a", 5.0), (4, None, 1.0), (None, "a", 1.0), (5, "a", None), (6, "a", inf), (7, "a", nan), (8, "b", -9.0), (-9, "a", 6.0)]
    plain = lambda rows: [r for r in rows if r[-1] is None or abs(r[-1]) < inf]
    assert claimed(spark, left, right, 5.0) == walk(plain(left), plain(right), 5.0)
    assert claimed(spark, left, right, 0.0) == walk(plain(left), plain(right), 0.0)
    assert claimed(spark, left, [], 5.0) == claimed(spark, [], right, 5.0) == []
    untold = [(a, k, 0, x) for a, k, _, x in left]
    assert claimed(spark, left, right, 5.0, tier=None) == walk(plain(untold), plain(right), 5.0)


def test_claims_write_no_pairs(spark, tmp_path):
    # 1200 customers within reach of 600 suppliers, all at different places: 720,000 pairs
    rng = random.Random(4)
    c = [(i, 1, x / 100, rng.choice(("BUILDING", "X", None))) for i, x in enumerate(rng.sample(range(25_000), 1200))]
    s = [(i, 1, x / 100) for i, x in enumerate(rng.sample(range(25_000), 600))]
    spark.createDataFrame(c, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(s, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    before = len(staged._written)
    got = QUERIES["claims_once"](spark, str(tmp_path)).select("c_custkey", "s_suppkey")
    written = sum(spark.read.parquet(p).count() for _, p in staged._written[before:])
    assert got.count() == 600 and got.select(F.count_distinct("c_custkey"), F.count_distinct("s_suppkey")).first()[:] == (600, 600)
    assert written <= 3 * 1800


def test_claims_of_a_small_folder_are_those_of_the_sql(spark, tmp_path):
    rng = random.Random(5)
    c = [(i, rng.choice((1, 2, None)), rng.choice((None, rng.randrange(40) * 25.0)), rng.choice(("BUILDING", "X", None))) for i in range(60)]
    s = [(i, rng.choice((1, 2, None)), rng.choice((None, rng.randrange(40) * 25.0, rng.randrange(400) * 2.5))) for i in range(40)]
    spark.createDataFrame(c, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(s, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    d = duckdb.connect()
    for t in ("customer", "supplier"):
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(tmp_path, t)}.parquet/*.parquet'")
    got = QUERIES["claims_once"](spark, str(tmp_path)).select("c_custkey", "s_suppkey").collect()
    assert sorted(tuple(r) for r in got) == sorted(d.sql(ORACLE_SQL["claims_once"]).fetchall())
