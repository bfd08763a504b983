"""Near copies by real shingle similarity: SimHash, through its table of distances to reference fingerprints, and slices of the shingle sets propose pairs, the table and the fingerprints screen them, the sets themselves decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scoped, text_batches
from .components import connected_components
from .simhash import _distance, link_fingerprints, majority_bits, reference_distances, shingle_hashes

#: Slices that a text names at each of its two levels: a pair at the least similarity misses all of them about once in 10^8.
SLICES = 40
#: Bits of 64 that two sets at similarity 0.8 differ in: 10 to 12 on average, this many less than once in 10,000 pairs.
DISTANCE = 26
MASK = (1 << 64) - 1


def shingle_set(data: bytes, width: int):
    """The distinct shingle hashes of a UTF-8 text, in order."""
    import numpy as np

    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(data, width)]))


def set_id(hashes) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(hashes.tobytes(), 77)
    return x - (1 << 64) if x >> 63 else x


def slice_keys(hashes, least: float):
    """The keys of a set's slices: two sets of similarity least or more have many in common, others hardly any.

    A level is for pairs whose larger set lies between two powers of 1 / least; the smaller one is of that level or the one
    below, so each set goes into two. Similar sets of a level differ in at most slices - 1 elements, so at least 1/e of the
    slices are equal on average. Few slices are drawn several times over, of many only the first SLICES are named.
    """
    import math

    import numpy as np

    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    own = int(math.log(n) / -math.log(least) + 1e-9) if least < 1 else 0
    out = []
    for level in (own, own + 1):
        largest = int(least ** -(level + 1)) if least < 1 else n
        slices = int(2 * largest * (1 - least) / (1 + least) + 1e-9) + 1
        draws = -(-SLICES // slices)
        odd = np.array([(0x9E3779B97F4A7C15 * (2 * d + 1)) & MASK | 1 for d in range(draws)], np.uint64)
        place = (((hashes[None, :] * odd[:, None]) >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
        used = place < SLICES
        at = (place + np.arange(draws)[:, None] * slices)[used]
        kept = max(draws * slices, SLICES)
        content, filled = np.zeros(kept, np.uint64), np.bincount(at, minlength=kept) > 0
        np.add.at(content, at, np.broadcast_to(hashes, place.shape)[used])
        name = (np.arange(kept, dtype=np.uint64) + np.uint64(level << 32)) * np.uint64(0xD1B54A32D192ED03)
        out.append((content + name)[filled])
    return np.concatenate(out).view(np.int64)


def _sets(docs: DataFrame, width: int, least: float) -> DataFrame:
    """(id, u, n, fp, keys): the set of every row by its hash, its size, the SimHash of the set and its slices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for i, t in zip(x["id"], x["text"], strict=True):
                h = shingle_set((t or "").encode("utf-8", "surrogatepass"), width)
                rows.append((i, set_id(h), len(h), majority_bits([h], len(h)), slice_keys(h, least)))
            yield pd.DataFrame(rows, columns=["id", "u", "n", "fp", "keys"]).astype({"id": "Int64"})

    return docs.mapInPandas(run, "id long, u long, n long, fp long, keys array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(src, dst) of the pairs whose sets are similar, by the smallest ids of both."""
    one, two = sets.withColumnsRenamed({"u": "a", "set": "sa"}), sets.withColumnsRenamed({"u": "b", "set": "sb"})
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    alike = F.col("common") >= least * (F.size("sa") + F.size("sb") - F.col("common")) - 1e-9
    return both.where(alike).select(F.col("a1").alias("src"), F.col("b1").alias("dst"))


def _screened(met: DataFrame, least: float, distance: int) -> DataFrame:
    """(a, a1, b, b1) of the pairs of met, with structs x and y, that may be similar by their sizes, by how much of them other texts have too (s), by their rows of the table of distances and by their fingerprints."""
    x, y = F.col("x"), F.col("y")
    sizes: Column = F.least(x["n"], y["n"], x["s"], y["s"]) * (1 + least) >= least * (x["n"] + y["n"]) - 1e-9
    rows = reduce(Column.__and__, (F.abs(p - q) <= distance for p, q in zip(reference_distances(x["fp"]), reference_distances(y["fp"]), strict=True)))
    near = met.where((x["u"] != y["u"]) & sizes & rows & (_distance(x["fp"], y["fp"]) <= distance))
    first, last = F.when(x["u"] < y["u"], x).otherwise(y), F.when(x["u"] < y["u"], y).otherwise(x)
    out = near.select(first.alias("p"), last.alias("q"))
    return out.select(F.col("p.u").alias("a"), F.col("p.first").alias("a1"), F.col("q.u").alias("b"), F.col("q.first").alias("b1")).distinct()


@scoped
def _shared_sizes(sets: DataFrame) -> DataFrame:
    """(u, own): how many shingles of a set no other set has. Counts are summed in the tasks first, so a frequent shingle is a row from each."""
    once = sets.select("u", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("u").alias("u")).where("n = 1")
    return once.groupBy("u").agg(F.count("*").alias("own"))


def _proposed(units: DataFrame) -> DataFrame:
    """(u, w): pairs of sets whose fingerprints are equal or, through the table of distances to the references, found within two bits; of equal ones each with the least."""
    fps = materialize(units.groupBy("fp").agg(F.min("u").alias("w")))
    equal = units.join(fps, "fp").where("u <> w").select("u", "w")
    ends = link_fingerprints(fps.select("fp"))
    for old, new in (("a", "u"), ("b", "w")):
        ends = ends.join(fps.select(F.col("fp").alias(old), F.col("w").alias(new)), old).drop(old)
    return equal.unionByName(ends.select("u", "w"))


@scoped
def near_copy_components(docs: DataFrame, width: int = 5, least: float = 0.8, distance: int = DISTANCE, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, component_id long): one row per row of docs; rows link whose sets of width-word shingles have Jaccard similarity least or more.

    component_id is the smallest id reachable, itself included. Equal sets (copies, empty texts) are taken together first.
    Sets whose fingerprints SimHash finds within two bits of one another are compared first. Sets with an equal slice meet in a bucket. Shingles that no other set in a bucket has can't be common to two sets: with
    too many of them a set links with nothing and goes, exactly, which thins out crowds of loosely alike texts. In a bucket
    each set is held against the bucket's two ends in some order, rounds times at most while that finds many more links. Then all pairs of a bucket that aren't connected yet are compared, so a large group of near copies costs a few
    comparisons a member. Rows that repeat an id belong together; a row with a null id links with nothing and has a null
    component. A very long text is a longer set. Other columns of docs are not read. An empty table gives an empty one.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with text_batches(docs.sparkSession):
        each = materialize(_sets(read, width, least))
    named = each.where("id IS NOT NULL")
    units = materialize(named.groupBy("u").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.min("fp").alias("fp")))
    keyed = named.select("u", F.explode("keys").alias("key")).distinct()
    meet = materialize(_crowded(keyed))
    close = materialize(_proposed(units))
    wanted = meet.select("u").unionByName(close.select("u")).unionByName(close.select(F.col("w").alias("u"))).distinct().join(units.select("u", F.col("first").alias("id")), "u")

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for x in batches:
            found = [(u, shingle_set((t or "").encode("utf-8", "surrogatepass"), width)) for u, t in zip(x["u"], x["text"], strict=True)]
            yield pd.DataFrame([(u, h.view(np.int64)) for u, h in found if set_id(h) == u], columns=["u", "set"]).astype({"u": "int64"})

    with text_batches(docs.sparkSession):
        sets = materialize(read.join(wanted, "id").select("u", "text").mapInPandas(hashes, "u long, set array<long>").dropDuplicates(["u"]))
    able = units.join(_shared_sizes(sets), "u", "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0))).where(F.col("s") >= least * F.col("n") - 1e-9)
    able = materialize(able.select("u", F.struct("u", "first", "n", "s", "fp").alias("x")))
    buckets = materialize(_crowded(meet.join(able, "u")).select("key", "x"))
    ids = units.select("u", "first")
    twice = named.groupBy("id").agg(F.min("u").alias("v"), F.max("u").alias("w")).where("v <> w").select("id").join(named, "id").join(ids, "u").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    simhash = _verified(materialize(_screened(close.join(able, "u").join(able.select(F.col("u").alias("w"), F.col("x").alias("y")), "w").select("x", "y"), least, distance)), sets, least)
    links = materialize(twice.unionByName(simhash).distinct())
    found, before, comp = links.count(), -1, None
    for turn in range(rounds + 1):
        comp = materialize(connected_components(links)) if found else docs.sparkSession.createDataFrame([], "node long, component long")
        left = materialize(buckets.join(comp, F.col("x.first") == F.col("node"), "left").select("key", "x", F.coalesce("component", F.col("x.first")).alias("label")))
        labels = left.groupBy("key", "label").agg(F.count("*").alias("size"))
        most = materialize(labels.groupBy("key").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "label")).alias("top")).where("parts > 1").select("key", "all", F.col("top.label").alias("top"), (F.col("all") - F.col("top.size")).alias("few")))
        open_pairs, members = most.agg(F.sum(F.col("few") * F.col("all")), F.sum("all")).first()
        if not open_pairs:
            break
        here = left.join(most, "key")
        last = turn == rounds or turn > 0 and (found <= 1.05 * before or open_pairs <= 16 * members)
        if last:
            few = here.where("label <> top").select("key", F.col("label").alias("m"), F.col("x").alias("y"))
            met = left.join(few, "key").where("label <> m").select("x", "y")
        else:
            order = F.struct(F.xxhash64(F.lit(turn), "x.u").alias("h"), F.col("x"), F.col("label"))
            ends = here.groupBy("key").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).select("key", F.explode(F.array("lo", "hi")).alias("end"))
            met = here.join(ends, "key").where("label <> end.label").select("x", F.col("end.x").alias("y"))
        links = materialize(links.unionByName(_verified(materialize(_screened(met, least, distance)), sets, least)).distinct())
        found, before = links.count(), found
        if last:
            comp = connected_components(links)
            break
    label = materialize(ids.join(comp, F.col("first") == F.col("node"), "left").select("u", F.coalesce("component", "first").alias("component_id")))
    return each.select("id", "u").join(label, "u", "left").select("id", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def _crowded(keyed: DataFrame) -> DataFrame:
    """The rows of keyed whose key another row has too."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keyed.join(shared, "key")
