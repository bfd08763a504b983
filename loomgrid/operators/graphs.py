"""Iterative operators on pairs: connected components, greedy one-to-one claims, and ordered selection against conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staged import drop, staged

#: Rounds after which an iteration that should shrink by itself is given up.
ROUNDS = 200


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node with an edge to another one the least node it reaches. Edges in any direction; nulls are ignored.

    Alternating large-star and small-star steps (Kiveris et al., 2014): a minimum per node, joined back, so the rounds grow
    with the logarithm of a chain's length and no component is ever gathered.
    """
    now = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _mark(now)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nxt = staged(_star(_star(both, F.col("v") > F.col("u")), F.lit(True)))
        drop(now)
        last, now, mark = mark, nxt, _mark(nxt)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _star(edges: DataFrame, move: Column) -> DataFrame:
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    moved = edges.join(least, "u").select(F.explode(F.array("u", F.when(move, F.col("v")))).alias("e"), "m")
    return moved.where("e <> m").select(F.greatest("e", "m").alias("u"), F.least("e", "m").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def claim_once(pairs: DataFrame, left: str, right: str, order: Sequence[str]) -> DataFrame:
    """The pairs that a walk through pairs in order takes, if it takes each pair whose left and right are both still free.

    order and the two names together are the order, so it is total; put a tier first to exhaust it, or the left side's own order
    first to let each left row choose in its turn. Each round takes the pairs that come first both for their left and for
    their right, which the walk would take too, and drops the pairs of what is taken; a null left or right is never taken.
    """
    place = F.struct(*order, left, right)
    now, taken = staged(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())), None
    for _ in range(ROUNDS):
        if now.isEmpty():
            break
        best = [now.groupBy(F.col(c).alias(f"__{c}")).agg(F.min(place).alias(f"__first_{i}")) for i, c in enumerate((left, right))]
        met = now.join(best[0], F.col(left) == F.col(f"__{left}")).join(best[1], F.col(right) == F.col(f"__{right}"))
        won = staged(met.where((place == F.col("__first_0")) & (place == F.col("__first_1"))).select(*pairs.columns).dropDuplicates([left, right]))
        taken = won if taken is None else taken.unionByName(won)
        rest = now.join(won.select(left), left, "left_anti").join(won.select(right), right, "left_anti")
        nxt = staged(rest.select(*pairs.columns))
        drop(now)
        now = nxt
    else:
        raise RuntimeError(f"claims did not settle in {ROUNDS} rounds")
    return now if taken is None else taken


def claim_alike(pairs: DataFrame, left: DataFrame, right: DataFrame, left_group: str, right_group: str, left_id: str, right_id: str, order: Sequence[str]) -> DataFrame:
    """(left_id, right_id): what claim_once takes of the pairs of members, given the pairs of their groups; order is the groups', then come the two ids.

    A round takes groups that come first for one another. If one of them is first alone, no other pair can come between those of
    their members, so these are taken in the order of both ids, many at once. Where several groups are equally near on both
    sides, they wait, and if all do, the least pair of all is taken. A group that has no member left goes, with all its pairs.
    """
    k = F.struct(*order)
    now = staged(pairs.select(F.col(left_group).alias("l"), F.col(right_group).alias("r"), k.alias("k")).where("l IS NOT NULL AND r IS NOT NULL").distinct())
    member = lambda df, g, i, n: staged(df.where(F.col(i).isNotNull()).select(F.col(g).alias(n), F.col(i).alias("id")))
    free = {"l": member(left, left_group, left_id, "l"), "r": member(right, right_group, right_id, "r")}
    taken = None
    for _ in range(ROUNDS):
        for n in "lr":
            now = now.join(free[n].select(n).distinct(), n, "left_semi")
        now = staged(now.select("l", "r", "k"))
        if now.isEmpty():
            break
        first = now
        for n in "lr":
            first = first.join(now.groupBy(n).agg(F.min("k").alias(f"k{n}")), n)
        # edges that come first for a side; a group is closed if all of its first edges come first for both sides
        first = staged(first.where("k = kl OR k = kr").withColumn("both", F.expr("k = kl AND k = kr")))
        for n in "lr":
            own = first.where(f"k = k{n}").groupBy(n).agg(F.bool_and("both").alias(f"c{n}"), F.count("*").alias(f"n{n}"))
            first = first.join(own, n)
        edges = first.where("both AND cl AND cr")
        # a star: one group whose edges lead to groups that have no other one
        star = lambda hub, leaf: edges.join(edges.groupBy(hub).agg(F.max(f"n{leaf}").alias("most")).where("most = 1").select(hub), hub, "left_semi").select("l", "r", F.struct(hub).cast("struct<h:" + now.schema[hub].dataType.simpleString() + ">").alias("s"))
        met = []
        for hub, leaf in (("l", "r"), ("r", "l")):
            stars = star(hub, leaf) if hub == "l" else star(hub, leaf).join(star("l", "r").select("l", "r"), ["l", "r"], "left_anti")
            place = lambda n, stars=stars: stars.select(n, "s").distinct().join(free[n], n).select("s", F.col("id").alias(f"i{n}"), F.row_number().over(Window.partitionBy("s").orderBy("id")).alias("at"))
            met.append(place("l").join(place("r"), ["s", "at"]).select("il", "ir"))
        won = met[0].unionByName(met[1])
        won = staged(won)
        if won.isEmpty():  # no star: the least pair of all is taken
            least = first.where("both")
            for n in "lr":
                least = least.join(free[n].groupBy(n).agg(F.min("id").alias(f"i{n}")), n)
            won = staged(least.orderBy("k", "il", "ir").limit(1).select("il", "ir"))
        taken = won if taken is None else taken.unionByName(won)
        free = {n: staged(free[n].join(won.select(F.col(f"i{n}").alias("id")), "id", "left_anti").select(n, "id")) for n in "lr"}
    else:
        raise RuntimeError(f"claims did not settle in {ROUNDS} rounds")
    out = now.where("false").select(F.lit(None).cast(left.schema[left_id].dataType).alias("il"), F.lit(None).cast(right.schema[right_id].dataType).alias("ir")) if taken is None else taken
    return out.select(F.col("il").alias(left_id), F.col("ir").alias(right_id))


def first_wins(items: DataFrame, key: str, conflicts: DataFrame, earlier: str, later: str) -> DataFrame:
    """The items that stay when a walk in order keeps each one that conflicts with none kept before it.

    conflicts are pairs of keys (earlier, later) in that order. A round decides all items without an open earlier conflict: they
    stay, and what they conflict with goes, with all its pairs; so there are as many rounds as a chain of conflicts is long.
    """
    now, gone = staged(conflicts.select(F.col(earlier).alias("e"), F.col(later).alias("l")).distinct()), None
    for _ in range(ROUNDS):
        if now.isEmpty():
            break
        free = now.select(F.col("e").alias("k")).distinct().join(now.select(F.col("l").alias("k")).distinct(), "k", "left_anti")
        lost = staged(now.join(free, F.col("e") == F.col("k")).select(F.col("l").alias("k")).distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        open_pairs = now.join(free.withColumnRenamed("k", "e"), "e", "left_anti")
        nxt = staged(open_pairs.join(lost.withColumnRenamed("k", "e"), "e", "left_anti").join(lost.withColumnRenamed("k", "l"), "l", "left_anti").select("e", "l"))
        drop(now)
        now = nxt
    else:
        raise RuntimeError(f"conflicts did not settle in {ROUNDS} rounds")
    return items if gone is None else items.join(gone, F.col(key) == F.col("k"), "left_anti")
