"""Vector codes, graph search and hard negatives against plain versions, on nulls, repeats, copies, ties, empty tables and clashing names."""

import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomgrid.llm import hard_negatives, vector_codes, vector_graph

SCHEMA = "vec_id long, embedding array<float>, label int, id string, dim int, ints string, code string, a int, score int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 9, "y", "z", 1, 2, 3) for i, v, lab in rows], SCHEMA)


def odd_rows(n=300, dim=16, seed=3):
    """Clusters, a vector with a third of all rows, null and odd vectors, a null label, and an id that repeats."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 6] + 0.3 * rng.normal(size=dim)], int(i % 4)) for i in range(n)]
    rows += [(n + i, rows[1][1], i % 2) for i in range(n // 2)]
    k = len(rows)
    rows += [(k, None, 1), (k + 1, [0.5] * (dim - 1) + [None], 1), (k + 2, [float("nan")] * dim, 2), (k + 3, [float("inf")] * dim, 2), (k + 4, [0.25] * dim, None), (None, [0.5] * dim, 1), (7, rows[8][1], 3), (k + 5, [0.0] * dim, 1)]
    return rows


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if good(v)]
    w = len(kept[0][1]) // parts
    head = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[r[1][p * w : p * w + w] for r in head] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for r in kept:
                x = r[1][p * w : p * w + w]
                got.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(got[e]) for c in zip(*got[e], strict=True)] if e in got else b for e, b in enumerate(books[p])]
    out, by_label = [], {}
    for i, v, lab in kept:
        best = [nearest(v[p * w : p * w + w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), lab))
        by_label[lab] = by_label.get(lab, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, err, by_label[lab], digest) for i, code, err, lab in out), key=str)


def write(df, tmp_path):
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_codes(spark, tmp_path):
    rows = odd_rows(120)
    got = vector_codes.op11_vector_codes(spark, write(table(spark, rows), tmp_path))
    assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == plain_codes(rows)


def test_few_vectors_of_several_lengths(spark):
    rows = [(1, [0.5] * 8, 1), (2, [], 1), (3, [0.25] * 9, None), (4, [-0.00001] * 8, 1)]
    codes, books = vector_codes.compress_vectors(table(spark, rows))
    assert sorted((r["id"], list(r["code"]), r["error"]) for r in codes.collect()) == [(1, [0] * 8, 0), (2, [0] * 8, 0), (3, [0] * 8, 0), (4, [1] * 8, 0)]
    assert [list(r["values"]) for r in books.where("dim = 8 AND part = 0").orderBy("entry").collect()] == [[2048], [-1]]
    with pytest.raises(Exception, match="larger"):
        vector_codes.compress_vectors(table(spark, [(1, [1e9] * 8, 1)]))


def test_exponion_is_exact():
    rng = np.random.default_rng(0)
    x, book = rng.integers(-9, 9, (2000, 3)), rng.integers(-9, 9, (16, 3))
    book[5] = book[2]
    far = np.square(x[:, None] - book[None]).sum(axis=2)
    for start in (np.zeros(2000, np.int64), rng.integers(0, 16, 2000)):
        entry, least = vector_codes.nearest_entries(x, start, book)
        assert (entry == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def plain_neighbours(rows, step, k=5):
    kept = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and good(v) and any(v)]
    firsts = {}
    for i, v in kept:
        firsts[i] = v if i not in firsts else min(firsts[i], v, key=list)
    out = {}
    for q in (i for i in firsts if i % step == 0):
        v = firsts[q]
        cos = sorted((-round(float(v @ w / math.sqrt(v @ v) / math.sqrt(w @ w)), 12), i) for i, w in kept if i != q)
        out[q] = [(i, -c) for c, i in cos[:k]]
    return out


def test_graph_neighbours(spark):
    rows = odd_rows(600)
    want = plain_neighbours(rows, 5)
    for shard_rows in (8192, 64):
        got: dict = {}
        for r in vector_graph.graph_neighbours(table(spark, rows), lambda i: i % 5 == 0, shard_rows=shard_rows, block_queries=50).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
        assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.98 * 5 * len(want)


def test_graph_recall_on_the_table(spark, folder):
    t = pq.read_table(f"{folder}/embeddings.parquet").to_pydict()
    want = plain_neighbours(list(zip(t["vec_id"], t["embedding"], t["label"], strict=True)), 50)
    got = vector_graph.op12_vector_graph(spark, folder).collect()
    assert len(got) == 5 * len(want) and {(r["query_id"], r["vec_id"]) for r in got} == {(q, i) for q, found in want.items() for i, _ in found}


def test_pruning_keeps_directions_and_all_are_reached():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 8)), 30, axis=0) + 0.01 * rng.normal(size=(1200, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(1200)]
    graph = vector_graph.build_graph(x)
    reached, front = set(range(32)), list(range(32))
    while front:
        front = list({int(j) for i in front for j in graph[i] if j < 1200} - reached)
        reached |= set(front)
    assert len(reached) == 1200
    padded = np.concatenate([x, np.zeros((1, 8), np.float32)])
    near = np.argsort(-(x[:1] @ x.T)[0])[None, :200]
    kept = vector_graph.robust_prune(padded, np.array([0]), near, 32)[0]
    kept = kept[kept < 1200]
    assert 1 < len(kept) < 32 and kept[0] == near[0, 1]


def plain_negatives(rows, step, k=5):
    kept = [(i, np.array([math.floor(256 * x) for x in v], np.int64), lab) for i, v, lab in rows if i is not None and lab is not None and good(v) and len(v)]
    out = []
    for a, v, lab in ((i, v, lab) for i, v, lab in kept if i % step == 0):
        scores = sorted((-int(v @ w), i, other) for i, w, other in kept if i != a)
        for s, p, _ in [x for x in scores if x[2] == lab][:k]:
            hard = [(j, -n) for n, j, other in scores if other != lab and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, p, rank, j, -s, n) for rank, (j, n) in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives(spark):
    rows = [r for r in odd_rows(400) if r[0] != 7]
    want = plain_negatives(rows, 10)
    assert len({r[:2] for r in want}) > 100
    for shard_rows in (8192, 100):
        got = hard_negatives.mine_hard_negatives(table(spark, rows), lambda i: i % 10 == 0, shard_rows=shard_rows, block_anchors=20)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_repeated_ids_and_windows(spark):
    rows = [(10, [1.0, 0.0], 1), (10, [0.5, 0.0], 2), (11, [0.5, 0.0], 1), (12, [0.5, 0.5], 1), (13, [0.45, 0.0], 2), (14, [0.3, 0.0], 2), (15, [-1.0, 0.0], 1), (16, [0.5, 0.0], 2)]
    got = hard_negatives.mine_hard_negatives(table(spark, rows), lambda i: i == 10, positives=2)
    assert sorted(tuple(r) for r in got.collect()) == [(10, 11, 1, 16, 32768, 32768), (10, 11, 2, 13, 32768, 29440), (10, 12, 1, 16, 32768, 32768), (10, 12, 2, 13, 32768, 29440)]


def test_tree_reads_few_leaves_of_clusters():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(40, 6))[rng.integers(0, 40, 4000)] * 200 + rng.normal(size=(4000, 6)) * 5)
    tree = hard_negatives.Tree.of(x)
    least, most = tree.leaves(x[:50])
    for i in range(50):
        s = x @ x[i]
        ids = np.arange(4000)
        window = (0.8 * s.max(), s.max() - 1)
        rows, scores = tree.first(x[i], least[i], most[i], window, np.ones(4000, bool), ids, 5)
        inside = np.flatnonzero((s >= window[0]) & (s <= window[1]))
        best = inside[np.lexsort((inside, -s[inside]))][:5]
        assert list(rows) == list(best) and list(scores) == list(s[best])
    assert (least < np.sqrt(np.square(x).sum(axis=1).max())).mean() < 0.9


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_vector_graph", "op13_hard_negatives"])
def test_nothing_in(spark, tmp_path, name):
    folder = write(spark.createDataFrame([(1, None, None), (None, None, 3)], "vec_id long, embedding array<float>, label int"), tmp_path)
    f = {**vector_codes.QUERIES, **vector_graph.QUERIES, **hard_negatives.QUERIES}[name]
    assert f(spark, folder).collect() == []
