"""Clusters, nearest rows, boxes, claims and conflicts against plain walks over small tables."""

import random

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import graphs, spatial


def values(df):
    return sorted(tuple(r) for r in df.collect())


def plain_clusters(points, gap):
    root = {i: i for i, _, _ in points}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x, y in points:
        for j, u, v in points:
            if abs(x - u) <= gap and abs(y - v) <= gap:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, find(i)) for i, _, _ in points)


def test_clusters_of_random_points(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-12, 12), rng.uniform(-12, 12)) for i in range(300)] + [(300 + i, 3.0, 4.0) for i in range(5)] + [(400, 20.0, 20.0), (401, 21.0, 21.0), (402, 22.0, 20.0), (403, 30.0, -30.0)]
    df = spark.createDataFrame([("a", i, x, y) for i, x, y in points] + [("b", 1000 + i, x, y) for i, x, y in points[:40]] + [("b", 2000, None, 1.0)], "k string, id long, x double, y double")
    for gap in (1.0, 0.37):
        got = values(spatial.clusters(df, ["k"], "id", "x", "y", gap).select("id", "cluster"))
        assert got == sorted(plain_clusters(points, gap) + plain_clusters([(1000 + i, x, y) for i, x, y in points[:40]], gap))


def test_a_long_chain_and_a_crowd(spark):
    chain = spark.range(10_000).select(F.col("id"), F.col("id").cast("double").alias("x"), (F.col("id") * -1.0).alias("y"))
    crowd = spark.range(20_000).select((F.col("id") + 10_000).alias("id"), (F.col("id") % 100 / 200 - 50).alias("x"), (F.col("id") / 40_000 + 70).alias("y"))
    got = spatial.clusters(chain.unionByName(crowd), [], "id", "x", "y", 1.0)
    assert values(got.groupBy("cluster").count()) == [(0, 10_000), (10_000, 20_000)]


def test_bridge(spark):
    rows = [(1, 0.0, 0.0, "P", 1), (2, 0.5, 0.0, "t", 1), (3, 4.0, 0.0, "C", 3), (4, 4.5, 0.0, "C", 3), (5, 9.0, 0.0, "P", 5), (6, 30.0, 0.0, "C", 6), (7, 9.5, 0.0, "C", 5)]
    df = spark.createDataFrame([("d", *r) for r in rows], "k string, id int, x double, y double, kind string, cluster int")
    got = spatial.bridge(df, ["k"], "id", "x", "y", "cluster", F.col("kind") == "C", F.col("kind") == "P", 5.0)
    assert values(got) == [("d", 3, 1)]


@pytest.mark.parametrize("within", [None, 0.8])
def test_nearest_in_two_dimensions(spark, within):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), rng.choice([rng.gauss(0, 1), rng.uniform(-90, 90)]), rng.gauss(0, 3)) for i in range(300)] + [(900, "z", 0.0, 0.0), (901, "a", None, 0.0)]
    right = [(i, rng.choice("ab"), rng.gauss(0, 1), rng.gauss(0, 3)) for i in range(200)] + [(500, "a", 40.0, 1.0), (501, "a", 40.0, 1.0)]
    want = []
    for i, k, x, y in left:
        best = min(((max(abs(x - u), abs(y - v)), j) for j, q, u, v in right if q == k), default=None) if x is not None else None
        if best and (within is None or best[0] <= within):
            want.append((i, best[1], best[0]))
    a, b = spark.createDataFrame(left, "l int, k string, x double, y double"), spark.createDataFrame(right, "r int, q string, u double, v double")
    assert values(spatial.nearest(a, b, "l", "r", [("x", "u"), ("y", "v")], [("k", "q")], within)) == sorted(want)
    assert values(spatial.nearest(a, b.where("false"), "l", "r", [("x", "u")])) == []


def test_boxes_of_all_sizes(spark):
    rng = random.Random(3)
    make = lambda n, at: [(at + i, x, y, x + w, y + h) for i in range(n) for x, y, w, h in [(rng.uniform(-99, 99), rng.uniform(-99, 99), rng.choice([0.0, 0.3, 3.0, 40.0, 150.0]), rng.choice([0.0, 0.5, 5.0, 60.0]))]]
    left, right = make(120, 0) + [(998, 0.0, 0.0, 4.0, 4.0), (997, None, 0.0, 1.0, 1.0)], make(150, 1000) + [(1998, 4.0, 4.0, 5.0, 8.0)]
    shape = "{} int, x0 double, y0 double, x1 double, y1 double"
    got = spatial.box_pairs(spark.createDataFrame(left, shape.format("l")), spark.createDataFrame(right, shape.format("r")), "l", "r")
    want = [(a[0], b[0]) for a in left for b in right if a[1] is not None and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]]
    assert values(got) == sorted(want) and (998, 1998) in want


def test_outer_boxes(spark):
    rows = [(1, 0.0, 0.0, 1000.0, 1000.0), (2, -5.0, 0.0, 500.0, 500.0), (3, 0.0, 0.0, 1000.0, 1000.0), (4, 900.0, 900.0, 1900.0, 1100.0), (5, 985.0, 0.0, 1985.0, 2.0), (6, 50.0, 999.0, 1040.0, 1000.0), (7, 1000.0, 0.0, 1000.0, 0.0)]
    got = spatial.outer_boxes(spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double"), "id")
    assert [r[0] for r in values(got.select("id"))] == [1, 4, 5, 6]


def test_claims_are_those_of_a_walk(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(3), rng.randrange(4), rng.randrange(40), rng.randrange(40)) for _ in range(400)]
    pairs += [pairs[0], (0, 0, None, 1)]
    left, right, want = set(), set(), set()
    for t, o, a, b in sorted(p for p in pairs if p[2] is not None):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((t, o, a, b))
    df = spark.createDataFrame(pairs, "tier int, o int, a int, b int")
    assert values(graphs.claim_once(df, "a", "b", ["tier", "o"])) == sorted(want)
    assert values(graphs.claim_once(df.where("false"), "a", "b", ["tier"])) == []


def test_first_wins_is_that_of_a_walk(spark):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}) + [(i, i + 1) for i in range(100, 112)]
    kept: list[int] = []
    for i in [*range(60), *range(100, 113)]:
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    items = spark.createDataFrame([(i,) for i in [*range(60), *range(100, 113)]], "i int")
    assert [r[0] for r in values(graphs.first_wins(items, "i", spark.createDataFrame(pairs, "e int, l int"), "e", "l"))] == kept


def test_components(spark):
    edges = spark.createDataFrame([(5, 3), (3, 5), (3, 9), (7, 7), (8, 6), (None, 1)], "a int, b int")
    assert values(graphs.components(edges, "a", "b")) == [(3, 3), (5, 3), (6, 6), (8, 6), (9, 3)]
    assert values(graphs.components(edges.where("false"), "a", "b")) == []


def test_crowded_boxes_are_dealt_over_tasks(spark):
    boxes = spark.range(6_000).select(F.col("id"), (F.col("id") % 2).cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.lit(40.0).alias("x1"), F.lit(40.0).alias("y1"))
    few = boxes.where("id < 500").withColumnRenamed("id", "few")
    got = spatial.box_pairs(boxes, few, "id", "few")
    n, tasks, largest = got.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.count("*"), F.max("count")).first()
    assert n == 6_000 * 500 and tasks > 1 and largest < n


@pytest.mark.parametrize("slack,covered", [(0.0, 2.0), (2.0, 0.9), (1.0, 0.3)])
def test_outer_boxes_in_classes_are_those_of_a_walk(spark, slack, covered):
    rng = random.Random(7)
    rows = [(i, float(x), float(y), float(x + rng.randrange(9)), float(y + rng.randrange(9))) for i in range(300) for x, y in [(rng.randrange(30), rng.randrange(30))]]
    rows += [(300 + i, *rows[i][1:]) for i in range(40)]
    kept: list = []
    for r in sorted(rows, key=lambda r: (-(r[3] - r[1]) * (r[4] - r[2]), r[0])):
        i, x0, y0, x1, y1 = r
        area = (x1 - x0) * (y1 - y0)
        share = lambda k: max(min(x1, k[3]) - max(x0, k[1]), 0) * max(min(y1, k[4]) - max(y0, k[2]), 0)  # noqa: B023, E731
        if not any((k[1] <= x0 + slack and k[2] <= y0 + slack and k[3] >= x1 - slack and k[4] >= y1 - slack) or (area > 0 and share(k) >= area * covered) for k in kept):
            kept.append(r)
    df = spark.createDataFrame([*rows, (900, None, 0.0, 1.0, 1.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    got = spatial.outer_boxes(df, "id", slack=slack, covered=covered, batch=100)
    assert sorted(r[0] for r in got.select("id").collect()) == sorted([k[0] for k in kept] + [900])


def test_near_join_deals_a_crowded_cell_over_tasks(spark):
    left = spark.range(9_000).select("id", (F.col("id") % 3 / 10).alias("a"), (F.col("id") % 2).alias("k"))
    right = spark.range(600).select(F.col("id").alias("other"), (F.col("id") % 3 / 10 + 0.25).alias("b"), (F.col("id") % 2).alias("l"))
    want = sum(1 for i in range(9_000) for j in range(3) if abs(i % 3 / 10 - (j % 3 / 10 + 0.25)) <= 0.3) * 200
    got = spatial.near_join(left, right, "a", "b", 0.3)
    n, tasks, largest = got.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.count("*"), F.max("count")).first()
    assert n == want == got.select("id", "other").distinct().count() and tasks > 1 and largest < n
    keyed = spatial.near_join(left, right, "a", "b", 0.3, [("k", "l")])
    assert keyed.columns == got.columns and keyed.count() == got.where("k = l").count()


def test_nearest_works_each_place_out_once(spark, monkeypatch):
    met = []
    plain = spatial._even_join
    monkeypatch.setattr(spatial, "_even_join", lambda a, b, *more: met.append((a.count(), b.count())) or plain(a, b, *more))
    left = spark.range(600).select(F.col("id").alias("l"), (F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    right = spark.createDataFrame([(7, 0.0, 0.0), (8, 2.0, 1.5), (9, 2.0, 1.5)], "r int, u double, v double")
    got = {r["l"]: (r["r"], r["distance"]) for r in spatial.nearest(left, right, "l", "r", [("x", "u"), ("y", "v")]).collect()}
    assert max(a for a, _ in met) == 6
    assert got == {i: min((max(abs(i % 3 - u), abs(i % 2 - v)), r) for r, u, v in ((7, 0.0, 0.0), (8, 2.0, 1.5)))[::-1] for i in range(600)}


def test_claims_of_alike_members_are_those_of_a_walk(spark):
    rng = random.Random(6)
    left = [(i, rng.randrange(2), rng.randrange(12)) for i in range(60)] + [(100 + i, 0, 50) for i in range(250)]
    right = [(1000 + i, rng.randrange(12)) for i in range(40)] + [(1100 + i, 50 + rng.choice((-1, 1))) for i in range(260)]
    taken, want = set(), []
    for _, _, a, b in sorted((t, abs(x - y), a, b) for a, t, x in left for b, y in right if abs(x - y) <= 3):
        if a not in taken and b not in taken:
            taken |= {a, b}
            want.append((a, b))
    c = spark.createDataFrame(left, "c int, tier int, x int").withColumn("cg", F.struct("tier", "x"))
    s = spark.createDataFrame(right, "s int, y int").withColumn("sg", F.struct("y"))
    pairs = c.select("cg", "tier", "x").distinct().join(s.select("sg", "y").distinct(), F.abs(F.col("x") - F.col("y")) <= 3).select("cg", "sg", "tier", F.abs(F.col("x") - F.col("y")).alias("off"))
    assert values(graphs.claim_alike(pairs, c, s, "cg", "sg", "c", "s", ["tier", "off"])) == sorted(want)
    assert values(graphs.claim_alike(pairs.where("false"), c, s, "cg", "sg", "c", "s", ["tier", "off"])) == []
