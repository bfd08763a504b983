"""The near-copy stage against brute force on real shingle sets."""

import random
import re

import corpus_pipeline
from loomgrid.llm import near_copies

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = BLANK.findall((t or "").lower())
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def planted():
    """Bases of many lengths with copies that share 70 to 100 % of their shingles, one crowded group, and unrelated texts with one passage."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out, passage = [], fresh(30)
    for length in (4, 6, 9, 12, 20, 24, 50, 120, 400, 1500, 6000):
        base = fresh(length)
        out.append(base)
        for edits in range(1, max(2, min(12, length // 12))):
            copy = list(base)
            for k in rng.sample(range(length), max(1, edits * length // 300)):
                copy[k] = fresh(1)[0]
            out += [copy, copy[edits:], copy + fresh(edits)]
    crowd = fresh(80)
    for _ in range(150):
        copy = list(crowd)
        for k in rng.sample(range(80), rng.randint(1, 3)):
            copy[k] = fresh(1)[0]
        out.append(copy)
    out += [passage + fresh(rng.randint(1, 90)) for _ in range(60)]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)] + [(9001, None), (9002, ""), (9003, " ")]


def test_groups_equal_brute_force(spark):
    rows = planted()
    want = brute(rows)
    got = {r["id"]: r["component_id"] for r in near_copies.near_copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_stage_drops_near_copies(spark):
    rows = planted()[:40]
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(brute(rows).values())) and kept.count(None) == 1
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


def test_repeated_ids_belong_together(spark):
    rows = [(1, "a b c d e f"), (1, "k l m n o p"), (2, "k l m n o p"), (3, "A  b c d e f"), (4, "q r s t u v")]
    got = near_copies.near_copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_simhash_proposes_pairs_by_itself(spark, monkeypatch):
    import numpy as np

    from loomgrid.llm.simhash import majority_bits

    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    rows = [(1, " ".join(base)), *((10 + i, " ".join([*base, f"odd{i}"])) for i in range(6)), (50, " ".join(f"w{rng.randrange(10**6)}" for _ in range(4000))), (60, None), (61, "")]
    bits = lambda t: majority_bits([h := near_copies.shingle_set(t.encode(), 5)], len(h))
    close = [i for i, t in rows[1:7] if ((bits(t) ^ bits(rows[0][1])) & near_copies.MASK).bit_count() <= 2]
    assert close
    monkeypatch.setattr(near_copies, "slice_keys", lambda hashes, least: np.zeros(0, np.int64))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in near_copies.near_copy_components(docs).collect()}
    assert all(got[i] == 1 for i in close) and got[50] == 50 and got[61] == 60


def test_table_of_distances_bounds_the_distance(spark):
    from pyspark.sql import functions as F

    from loomgrid.llm.simhash import reference_distances

    rng = random.Random(13)
    pairs = [(rng.getrandbits(63), rng.getrandbits(6)) for _ in range(50)]
    df = spark.createDataFrame([(a, a ^ b, b.bit_count()) for a, b in pairs], "a long, b long, n int")
    off = F.greatest(*(F.abs(p - q) for p, q in zip(reference_distances(F.col("a")), reference_distances(F.col("b")), strict=True)))
    assert df.where(off > F.col("n")).count() == 0 and df.where((off > 0) & (F.col("n") > 0)).count() > 0
