"""Embedding near-duplicates: exact threshold pairs from a dual traversal of cover trees with halving radii."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scoped
from .components import connected_components

#: Radii of the nested levels below the cells; the last one is under half the distance at cosine 0.95.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Products held at once, node or row pairs followed at once, and links kept before they are cut down to a forest.
PRODUCTS, SLICE, LINKS = 1 << 22, 1 << 15, 1 << 20
#: Single-precision products find what could link, by this much too many; double precision decides.
SLACK = 1e-4
#: How far off a distance taken from a single-precision product may be.
FAR = 5e-3


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of raw in double precision, scaled to length one; scaled by the largest part first, so squares don't overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def net(x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(centre of each row, distance to it): the first row left is a centre and takes all rows within r, again and again.

    A batch of rows is held against all that are left in one product, and the batch's own products say which of it are centres.
    """
    owner, dist = np.full(len(x), -1), np.zeros(len(x))
    left, least, size = np.arange(len(x)), 1 - r * r / 2, 64
    while len(left):
        batch = left[: max(1, min(size, PRODUCTS // len(left)))]
        near = x[batch] @ x[left].T
        covered, centres = np.zeros(len(batch), bool), []
        inside = near[:, : len(batch)] >= least
        for i in range(len(batch)):
            if not covered[i]:
                centres.append(i)
                covered |= inside[i]
        near = near[centres]
        near[np.arange(len(centres)), centres] = 1  # a centre takes itself, whatever rounding says
        first = (near >= least).argmax(axis=0)
        cos = near[first, np.arange(len(left))]
        got = cos >= least
        owner[left[got]] = batch[np.array(centres)][first[got]]
        dist[left[got]] = np.sqrt(np.maximum(2 - 2 * cos[got], 0))
        left = left[~got]
        size = min(2 * size, 1024) if len(centres) > len(batch) // 2 else 64
    dist[owner == np.arange(len(x))] = 0
    return owner, dist


def cover_tree(x: np.ndarray, radii: tuple[float, ...] = RADII) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(order, levels): rows (units, single precision) in an order in which every node of every level is one run; a level is (starts, covering radii).

    A node's centre is its first row. A node of radius r is cut into nodes of the next radius, see net(). The covering
    radius is the largest distance found and a margin for rounding; a node of one row has none. The last level are the rows.
    """
    order, bounds, levels = np.arange(len(x)), np.array([0, len(x)]), []
    for r in radii:
        starts = np.zeros(len(x), bool)
        cover = np.zeros(len(x))
        starts[bounds[:-1]] = True
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            rows = order[a:b]
            owner, dist = net(x[rows], r)
            by = np.lexsort((owner != np.arange(len(rows)), owner))
            order[a:b] = rows[by]
            owner, dist = owner[by], dist[by]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            starts[a + first] = True
            many = np.diff(np.r_[first, len(rows)]) > 1
            cover[a + first] = np.where(many, np.maximum.reduceat(dist, first) + FAR, 0)
        at = np.flatnonzero(starts)
        levels.append((at, cover[at]))
        bounds = np.r_[at, len(x)]
    levels.append((np.arange(len(x)), np.zeros(len(x))))
    return order, levels


def forest(n: int, edges: np.ndarray) -> np.ndarray:
    """The least number of each number's component, by repeated minima over the edges and pointer jumping."""
    label = np.arange(n)
    u, v = edges[:, 0], edges[:, 1]
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return label


def _spread(starts_a, ends_a, starts_b, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """All combinations of starts_a[k]..ends_a[k] and starts_b[k]..ends_b[k], for every k."""
    na, nb = ends_a - starts_a, ends_b - starts_b
    n = na * nb
    k = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return starts_a[k] + within // nb[k], starts_b[k] + within % nb[k]


class Side:
    """A tree's rows in its order: as given, as single-precision units, with weights, levels and the size of each node."""

    def __init__(self, raw: np.ndarray, weight: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.raw, self.weight, self.n = raw, weight, len(raw)
        self.x = units(raw).astype(np.float32)
        self.levels = [(s, r, np.diff(np.r_[s, len(raw)])) for s, r in levels]


class Traversal:
    """The links between two trees, or within one (a is b): counts per row, and edges that connect what is linked."""

    def __init__(self, a: Side, b: Side, cosine: float):
        self.a, self.b, self.same, self.cosine = a, b, a is b, cosine
        self.reach = np.sqrt(2 - 2 * cosine)
        self.base = 0 if self.same else a.n
        self.count_a = np.zeros(a.n, np.int64)
        self.count_b = self.count_a if self.same else np.zeros(b.n, np.int64)
        self.edges: list[np.ndarray] = []
        self.held = 0

    def run(self) -> None:
        self.dense(0, 0, len(self.a.levels[0][0]))

    def label(self) -> np.ndarray:
        found = np.concatenate(self.edges) if self.edges else np.zeros((0, 2), np.int64)
        return forest(self.base + self.b.n, found)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        self.edges.append(np.stack([u, v], axis=1))
        self.held += len(u)
        if self.held > LINKS:
            label = self.label()
            own = np.flatnonzero(label != np.arange(len(label)))
            self.edges, self.held = [np.stack([own, label[own]], axis=1)], len(own)

    def rows(self, i: np.ndarray, j: np.ndarray) -> None:
        """Row pairs (i, j): cosines in double precision decide."""
        for s in range(0, len(i), SLICE):
            u, v = i[s : s + SLICE], j[s : s + SLICE]
            near = np.einsum("ij,ij->i", units(self.a.raw[u]), units(self.b.raw[v])) >= self.cosine
            u, v = u[near], v[near]
            np.add.at(self.count_a, u, self.b.weight[v])
            np.add.at(self.count_b, v, self.a.weight[u])
            self.link(u, self.base + v)

    def dense(self, level: int, low: int, high: int) -> None:
        """Nodes low..high of a's level against all of b's: products in tiles.

        Pairs of single rows are kept by the threshold, others by the covering radii. If a tile's pairs hold more than one in 64
        of the row pairs that there are, following them costs more than the products of the next level, to which its nodes go instead.
        """
        (sa, ra, na), (sb, rb, nb) = self.a.levels[level], self.b.levels[level]
        last = level + 1 == len(self.a.levels)
        wide_b = np.flatnonzero(nb > 1)
        cb = self.b.x if last else self.b.x[sb]
        at = low
        while at < high:
            from_b = at if self.same else 0
            end = min(high, at + max(1, PRODUCTS // max(1, len(sb) - from_b)))
            near = (self.a.x[at:end] if last else self.a.x[sa[at:end]]) @ cb[from_b:].T
            hit = near >= self.cosine - SLACK
            if not last:
                beyond = lambda d, r: d + np.square(np.minimum(r, 2)) / 2 >= 1 - SLACK
                wide_a = np.flatnonzero(na[at:end] > 1)
                cols = wide_b[wide_b >= from_b]
                if len(cols):
                    hit[:, cols - from_b] = beyond(near[:, cols - from_b], (ra[at:end, None] + rb[None, cols] + (self.reach + FAR)).astype(np.float32))
                if len(wide_a):
                    hit[wide_a] = beyond(near[wide_a], (ra[at:end][wide_a, None] + rb[None, from_b:] + (self.reach + FAR)).astype(np.float32))
                if len(wide_a) or len(cols):
                    held = float(na[at:end] @ (hit @ nb[from_b:].astype(np.float32)))
                    if held > self.b.n * na[at:end].sum() / 64:
                        s, e = (np.searchsorted(self.a.levels[level + 1][0], x) for x in (sa[at], sa[end - 1] + na[end - 1]))
                        del near, hit
                        self.dense(level + 1, int(s), int(e))
                        at = end
                        continue
            found = np.flatnonzero(hit)
            i, j = found // hit.shape[1] + at, found % hit.shape[1] + from_b
            del near, hit, found
            if self.same:
                i, j = i[i <= j], j[i <= j]
            alone = (na[i] == 1) & (nb[j] == 1)
            if self.same:
                self.rows(sa[i[alone & (i < j)]], sb[j[alone & (i < j)]])
            else:
                self.rows(sa[i[alone]], sb[j[alone]])
            i, j = i[~alone], j[~alone]
            for t in range(0, len(i), SLICE):
                self.visit(level, i[t : t + SLICE], j[t : t + SLICE])
            at = end

    def visit(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        """Node pairs (i, j) of a level, i <= j within one tree: what is near enough as a whole is linked, what is too far goes, the rest is cut."""
        if not len(i):
            return
        (sa, ra, na), (sb, rb, nb) = self.a.levels[level], self.b.levels[level]
        itself = (i == j) if self.same else np.zeros(len(i), bool)
        d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", self.a.x[sa[i]], self.b.x[sb[j]]), 0))
        d[itself] = 0
        keep = d <= ra[i] + rb[j] + self.reach + FAR
        full = keep & (na[i] * nb[j] >= 64) & (np.where(itself, 2 * ra[i], d + ra[i] + rb[j]) <= self.reach - FAR)
        for k in np.flatnonzero(full):
            self.whole(sa[i[k]], sa[i[k]] + na[i[k]], sb[j[k]], sb[j[k]] + nb[j[k]], itself[k])
        keep &= ~full
        i, j = i[keep], j[keep]
        alone = (na[i] == 1) & (nb[j] == 1)
        some = alone & ~((i == j) if self.same else np.zeros(len(i), bool))
        self.rows(sa[i[some]], sb[j[some]])
        i, j = i[~alone], j[~alone]
        if not len(i):
            return
        ca, cb = self.a.levels[level + 1][0], self.b.levels[level + 1][0]
        a0, a1 = np.searchsorted(ca, sa[i]), np.searchsorted(ca, sa[i] + na[i])
        b0, b1 = np.searchsorted(cb, sb[j]), np.searchsorted(cb, sb[j] + nb[j])
        ends = np.cumsum((a1 - a0) * (b1 - b0))
        at = 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            if to == at + 1 and (a1[at] - a0[at]) * (b1[at] - b0[at]) > SLICE:  # a pair with very many children: products in parts
                step = max(1, SLICE // int(b1[at] - b0[at]))
                parts = [np.r_[s : min(a1[at], s + step)] for s in range(a0[at], a1[at], step)]
                for p in parts:
                    for q in range(b0[at], b1[at], SLICE):
                        c = np.r_[q : min(b1[at], q + SLICE)]
                        self.cut(level + 1, np.repeat(p, len(c)), np.tile(c, len(p)))
            else:
                self.cut(level + 1, *_spread(a0[at:to], a1[at:to], b0[at:to], b1[at:to]))
            at = to

    def cut(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        if self.same:
            i, j = i[i <= j], j[i <= j]
        if level + 1 < len(self.a.levels):
            self.visit(level, i, j)
            return
        if self.same:
            i, j = i[i < j], j[i < j]
        near = np.einsum("ij,ij->i", self.a.x[i], self.b.x[j]) >= self.cosine - SLACK
        self.rows(i[near], j[near])

    def whole(self, a0: int, a1: int, b0: int, b1: int, itself: bool) -> None:
        """All rows of two nodes link."""
        if itself:
            self.count_a[a0:a1] += self.a.weight[a0:a1].sum() - self.a.weight[a0:a1]
            self.link(np.full(a1 - a0 - 1, a0), np.arange(a0 + 1, a1))
            return
        self.count_a[a0:a1] += self.b.weight[b0:b1].sum()
        self.count_b[b0:b1] += self.a.weight[a0:a1].sum()
        self.link(np.arange(a0, a1), np.full(a1 - a0, self.base + b0))
        self.link(np.full(b1 - b0, a0), self.base + np.arange(b0, b1))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column whose lists all have dim parts."""
    flat = pa.chunked_array(column) if isinstance(column, pa.Array) else column
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in flat.chunks] or [np.zeros(0)]).reshape(-1, dim)


def _block(t: pa.Table) -> pa.Table:
    dim = t["dim"][0].as_py()
    raw = matrix(t["vec"], dim)
    order, levels = cover_tree(units(raw).astype(np.float32))
    packed = lambda c: t[c].to_numpy()[order].astype(np.int64).tobytes()
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "cell": pa.array([t["cell"][0].as_py()], pa.int32()), "chunk": pa.array([t["chunk"][0].as_py()], pa.int32()),
        "keys": pa.array([packed("key")], pa.binary()), "ids": pa.array([packed("id")], pa.binary()), "weights": pa.array([packed("weight")], pa.binary()), "vecs": pa.array([np.ascontiguousarray(raw[order]).tobytes()], pa.binary()),
        "starts": pa.array([[s.astype(np.int64).tobytes() for s, _ in levels]], pa.list_(pa.binary())), "covers": pa.array([[c.astype(np.float64).tobytes() for _, c in levels]], pa.list_(pa.binary())),
    })


def _pairs(cosine: float, part: type):
    """One task's work: the one or two blocks of a pair."""

    def run(t: pa.Table) -> pa.Table:
        sides, keys, ids = [], [], []
        for r in t.to_pylist():
            keys.append(np.frombuffer(r["keys"], np.int64))
            ids.append(np.frombuffer(r["ids"], np.int64))
            levels = [(np.frombuffer(p, np.int64), np.frombuffer(q)) for p, q in zip(r["starts"], r["covers"], strict=True)]
            sides.append(Side(np.frombuffer(r["vecs"], part).reshape(len(keys[-1]), r["dim"]), np.frombuffer(r["weights"], np.int64), levels))
        found = Traversal(sides[0], sides[-1], cosine)
        found.run()
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        n = found.count_a if found.same else np.concatenate([found.count_a, found.count_b])
        label = found.label()
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, label, ids)  # each local component is named after its least id
        hit = np.flatnonzero(n)
        return pa.table({"key": keys[hit], "id": ids[hit], "n": n[hit], "root": root[label[hit]]})

    return run


def block_size(n: int, dim: int, block_bytes: int) -> int:
    """Rows in a block: a sixth of all, so that a small table has some twenty pairs of blocks, but no more than block_bytes hold."""
    return max(256, min(max(1024, -(-n // 6)), block_bytes // (8 * dim)))


@scoped
def cosine_links(vectors: DataFrame, cosine: float = 0.95, block_bytes: int = 1 << 25, most_cells: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id long): one row per row of vectors; rows link at a cosine of at least cosine.

    n_links counts the other rows that a row links with, component_id is the smallest id reachable. Vectors that are null,
    empty, zero or hold a null or a part that isn't finite link with nothing, as do rows with a null id (whose component is
    null) and vectors of different lengths. Rows that repeat an id are vectors of their own in one component. Other columns
    of vectors are not read, whatever their names. An empty table gives an empty one. Very long vectors make smaller blocks.

    Equal vectors are one weighted row from the start, told by 128 bits of hashes, so a vector with a third of all rows is
    paired once. The top level of the tree are cells around some vectors, those with the least hashes of their ids (one for
    a block's rows, most_cells at most per length); each vector goes to the nearest. Cells are cut into blocks of at most
    block_bytes in double precision by hash, which spreads a crowded cell. Each block is a cover tree with halving radii. Pairs
    of cells are pruned by their covering radii, and the pairs of blocks that stay are traversed together in tasks of their
    own, that hold two blocks. Only counts and a spanning star of each local component leave a task, never pairs. The driver
    sees cells (centres, radii, sizes), and one row per different length of vectors.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"
    part = np.float32 if kind == "float" else np.float64
    vec = F.col(vec_col).cast(f"array<{kind}>")
    sound = F.coalesce(F.col(id_col).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vec, lambda v: v != 0), F.lit(False))
    hashes = [F.when(sound, F.xxhash64(*seed, vec)).alias(c) for c, seed in (("a", ()), ("b", (F.lit("other"),)))]
    each = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, vec).alias("vec"), *hashes))
    equal = each.where("vec IS NOT NULL").groupBy("a", "b").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    equal = materialize(equal.select(F.monotonically_increasing_id().alias("key"), "a", "b", "id", "weight", "vec", F.size("vec").alias("dim")))
    sizes = {r["dim"]: r["count"] for r in equal.groupBy("dim").count().collect()}
    block = {dim: block_size(n, dim, block_bytes) for dim, n in sizes.items()}
    centres: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        if (k := min(most_cells, -(-n // block[dim]))) > 1:
            sample = equal.where(F.col("dim") == dim).select("vec", F.xxhash64("id").alias("o"), "key").orderBy("o", "key").limit(k).collect()
            centres[dim] = units(np.array([r["vec"] for r in sample], np.float64))

    def place(batches):
        for t in batches:
            dims = t.column("dim").to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.full(len(dims), 2.1)
            for dim in np.unique(dims):
                if dim in centres:
                    rows = np.flatnonzero(dims == dim)
                    c = units(matrix(t.column("vec").take(pa.array(rows)), dim)) @ centres[dim].T
                    cell[rows] = c.argmax(axis=1)
                    far[rows] = np.sqrt(np.maximum(2 - 2 * c.max(axis=1), 0)) + 1e-6
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("key", "id", "weight", "vec", "dim")), pa.array(cell), pa.array(far)], ["key", "id", "weight", "vec", "dim", "cell", "far"])

    placed = materialize(equal.select("key", "id", "weight", "vec", "dim").mapInArrow(place, f"key long, id long, weight long, vec array<{kind}>, dim int, cell int, far double"))
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("dim", "cell").collect()
    chunks = {(r["dim"], r["cell"]): max(1, -(-2 * r["n"] // (3 * block[r["dim"]]))) for r in cells}
    members = []
    for dim in sizes:
        own = [r for r in cells if r["dim"] == dim]
        at = centres.get(dim, np.ones((1, dim)) / np.sqrt(dim))[[r["cell"] for r in own]]
        far = np.array([r["far"] for r in own])
        d = np.sqrt(np.maximum(2 - 2 * at @ at.T, 0))
        for i, j in zip(*np.nonzero(np.triu(d <= far[:, None] + far + np.sqrt(2 - 2 * cosine) + 1e-6)), strict=True):
            a, b = own[i]["cell"], own[j]["cell"]
            members.append((dim, a, b, chunks[dim, a], chunks[dim, b]))
    parts = spark.createDataFrame([(d, c, n) for (d, c), n in chunks.items()], "dim int, cell int, chunks int")
    sized = placed.join(parts, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    shape = "dim int, cell int, chunk int, keys binary, ids binary, weights binary, vecs binary, starts array<binary>, covers array<binary>"
    blocks = materialize(sized.select("key", "id", "weight", "vec", "dim", "cell", "chunk").groupBy("dim", "cell", "chunk").applyInArrow(_block, shape))
    pairs = spark.createDataFrame(members, "dim int, cell_a int, cell_b int, chunks_a int, chunks_b int")
    pairs = pairs.withColumn("chunk_a", F.explode(F.expr("sequence(0, chunks_a - 1)"))).withColumn("chunk_b", F.explode(F.expr("sequence(0, chunks_b - 1)"))).where("cell_a <> cell_b OR chunk_a <= chunk_b")
    ends = pairs.select("dim", F.concat_ws(" ", "dim", "cell_a", "chunk_a", "cell_b", "chunk_b").alias("pair"), F.explode(F.array_distinct(F.array(F.struct(F.col("cell_a").alias("cell"), F.col("chunk_a").alias("chunk")), F.struct(F.col("cell_b").alias("cell"), F.col("chunk_b").alias("chunk"))))).alias("e")).select("dim", "pair", "e.cell", "e.chunk")
    met = blocks.join(ends, ["dim", "cell", "chunk"]).select("pair", "dim", "keys", "ids", "weights", "vecs", "starts", "covers")
    links = materialize(met.groupBy("pair").applyInArrow(_pairs(cosine, part), "key long, id long, n long, root long"))
    # rows that repeat an id with another vector, or without a sound one, tie its vectors together
    mark = lambda c: F.coalesce(c, F.lit(0))
    states = each.where("id IS NOT NULL").groupBy("id").agg(*(f(mark(F.col(c))).alias(f"{c}_{n}") for c in "ab" for n, f in (("low", F.min), ("high", F.max))))
    firsts = equal.select("key", "a", "b", "weight", F.col("id").alias("first"))
    twice = each.select("id", "a", "b").where("a IS NOT NULL").join(states.where("a_low <> a_high OR b_low <> b_high").select("id"), "id").join(firsts, ["a", "b"]).select(F.col("id").alias("src"), F.col("first").alias("dst"))
    comp = materialize(connected_components(links.select(F.col("id").alias("src"), F.col("root").alias("dst")).unionByName(twice)))
    total = links.groupBy("key").agg(F.sum("n").alias("n"))
    label = firsts.join(total, "key", "left").join(comp, F.col("first") == F.col("node"), "left")
    label = materialize(label.select("a", "b", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")))
    linked = each.where("a IS NOT NULL").select("id", "a", "b").join(label, ["a", "b"]).select("id", "n_links", "component_id")
    alone = each.where("a IS NULL").select("id").join(comp, F.col("id") == F.col("node"), "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return linked.unionByName(alone)


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    out = cosine_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
