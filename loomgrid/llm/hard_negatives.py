"""Hard negatives: a vantage-point tree over norm-augmented vectors, in which a window of scores is an annulus around the anchor."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scoped
from .vector_codes import finite, flat, integers
from .vector_graph import first_rows

#: Integer components up to this size: sums of 2^10 products stay exact in double precision.
LARGEST = 1 << 21
#: Rows in a leaf, and leaves read first; each further read takes twice as many.
LEAF, READ = 64, 4


class Tree:
    """A balanced vantage-point tree over rows of integers, each lengthened by the component that gives all rows the norm of the largest.

    So |q - y|² = |q|² + norm² - 2 q·y for an anchor q (lengthened by 0): the larger the product, the nearer the row. A node is a
    run of rows; its vantage point is the row farthest from its first one, and its halves are the nearer and the farther rows,
    each with the least and largest distance.
    """

    def __init__(self, x: np.ndarray, order: np.ndarray, bounds: list[np.ndarray], vantage: list[np.ndarray], near: list[np.ndarray], far: list[np.ndarray]):
        self.x, self.order, self.bounds, self.vantage, self.near, self.far = x, order, bounds, vantage, near, far
        self.square = float(np.square(x).sum(axis=1).max(initial=0))

    @classmethod
    def of(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        square = np.square(x).sum(axis=1)
        whole = np.concatenate([x, np.sqrt(square.max(initial=0) - square)[:, None]], axis=1)
        order, bounds, vantage, near, far = np.arange(len(x)), [np.array([0, len(x)])], [], [], []
        while np.diff(bounds[-1]).max() > leaf:
            edges, points, low, high = bounds[-1], [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = whole[order[a:b]]
                away = np.square(rows - rows[0]).sum(axis=1)
                points.append(order[a + away.argmax()])
                d = np.sqrt(np.square(rows - whole[points[-1]]).sum(axis=1))
                middle = (b - a) // 2
                split = np.argpartition(d, middle)
                order[a:b], d = order[a:b][split], d[split]
                for part in (d[:middle], d[middle:]):
                    low.append(part.min())
                    high.append(part.max())
            bounds.append(np.sort(np.r_[edges, edges[:-1] + np.diff(edges) // 2]))
            vantage.append(np.array(points))
            near.append(np.array(low))
            far.append(np.array(high))
        return cls(x, order, bounds, vantage, near, far)

    def leaves(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) possible distance of each anchor to the rows of each leaf, with a margin for rounding."""
        length = np.square(anchors).sum(axis=1) + self.square
        least, most = np.zeros((len(anchors), 1)), np.full((len(anchors), 1), np.inf)
        for points, near, far in zip(self.vantage, self.near, self.far, strict=True):
            d = np.repeat(np.sqrt(np.maximum(length[:, None] - 2 * (anchors @ self.x[points].T), 0)), 2, axis=1)
            least = np.maximum(np.repeat(least, 2, axis=1), np.maximum(d - far, near - d))
            most = np.minimum(np.repeat(most, 2, axis=1), d + far)
        margin = 1e-6 * (1 + np.sqrt(length))[:, None]
        return least - margin, most + margin

    def first(self, anchor: np.ndarray, least: np.ndarray, most: np.ndarray, window: tuple[float, float], wanted: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores): the k wanted rows with the highest scores in the window, ties by ids; leaves are read nearest first inside the annulus."""
        length = float(np.square(anchor).sum()) + self.square
        inner, outer = (np.sqrt(max(length - 2 * s, 0)) if np.isfinite(s) else (0 if s > 0 else np.inf) for s in (window[1], window[0]))
        at = np.maximum(least, inner)
        leaves = np.flatnonzero((at <= outer + 1e-6 * (1 + np.sqrt(length))) & (most >= inner))
        leaves = leaves[np.argsort(at[leaves], kind="stable")]
        edges = self.bounds[-1]
        rows, scores, done, step = np.zeros(0, np.int64), np.zeros(0), 0, READ
        while done < len(leaves):
            if len(rows) >= k and length - 2 * scores[k - 1] < at[leaves[done]] ** 2 and at[leaves[done]] > 0:
                break  # what is left is farther than the k-th row
            more = np.concatenate([np.arange(edges[j], edges[j + 1]) for j in leaves[done : done + step]])
            more = more[wanted[more]]
            s = self.x[self.order[more]] @ anchor
            inside = (s >= window[0]) & (s <= window[1])
            rows, scores = np.r_[rows, self.order[more[inside]]], np.r_[scores, s[inside]]
            best = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            done, step = done + step, 2 * step
        return rows, scores


def _build(t: pa.Table) -> pa.Table:
    order = np.argsort(t["place"].to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    x = flat(t["ints"].combine_chunks(), len(order))
    tree = Tree.of(x.astype(np.float64))
    packed = lambda a, kind: pa.array([np.ascontiguousarray(a).astype(kind).tobytes()], pa.binary())
    each = lambda levels, kind: pa.array([[np.asarray(v).astype(kind).tobytes() for v in levels]], pa.list_(pa.binary()))
    ids = t["ids"].combine_chunks()
    return pa.table({
        "dim": pa.array([t["dim"][0].as_py()], pa.int32()), "shard": pa.array([t["shard"][0].as_py()], pa.int32()), "ints": packed(x, np.int32), "labels": pa.array([t["label"].to_pylist()], pa.list_(pa.string())),
        "ids": packed(ids.flatten().to_numpy(), np.int64), "starts": packed(np.r_[0, np.cumsum([len(i) for i in ids])], np.int64), "rows": packed(tree.order, np.int64),
        "bounds": each(tree.bounds, np.int64), "vantage": each(tree.vantage, np.int64), "near": each(tree.near, np.float64), "far": each(tree.far, np.float64),
    })


TREES = "dim int, shard int, ints binary, labels array<string>, ids binary, starts binary, rows binary, bounds array<binary>, vantage array<binary>, near array<binary>, far array<binary>"


def _traverse(k: int, same: bool):
    """One task's work: a shard's tree, and the anchors of a block; for each anchor's windows the first k rows with its label (same), or with others."""

    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor_id": [], "top": [], "id": [], "score": []}
        if trees.num_rows and asked.num_rows:
            s = trees.to_pylist()[0]
            load = lambda name, kind: [np.frombuffer(b, kind) for b in s[name]]
            x = np.frombuffer(s["ints"], np.int32).reshape(-1, s["dim"]).astype(np.float64)
            tree = Tree(x, np.frombuffer(s["rows"], np.int64), load("bounds", np.int64), load("vantage", np.int64), load("near", np.float64), load("far", np.float64))
            ids, starts = np.frombuffer(s["ids"], np.int64), np.frombuffer(s["starts"], np.int64)
            names, label = np.unique(np.array(s["labels"], object).astype(str), return_inverse=True)
            number = {name: i for i, name in enumerate(names)}
            masks = {i: label[tree.order] == i for i in range(len(names))}
            anchors = flat(asked["ints"].combine_chunks(), asked.num_rows).astype(np.float64)
            least, most = tree.leaves(anchors)
            for i, a in enumerate(asked.select(["id", "label", "windows"]).to_pylist()):
                own = masks.get(number.get(a["label"], -1), np.zeros(len(x), bool))
                for w in a["windows"]:
                    low, high = (-np.inf, np.inf) if w is None else (w["low"], w["high"])
                    # an anchor isn't its own partner, so one row more than k is enough
                    rows, scores = tree.first(anchors[i], least[i], most[i], (low, high), own if same else ~own, ids[starts[:-1]], k + 1)
                    found = sorted((-int(v), int(j)) for r, v in zip(rows, scores, strict=True) for j in ids[starts[r] : starts[r + 1]] if j != a["id"])[:k]
                    for v, j in found:
                        for c, value in zip(out, (a["id"], None if w is None else int(w["high"]), j, -v), strict=True):
                            out[c].append(value)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


@scoped
def mine_hard_negatives(vectors: DataFrame, anchors: Callable, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, shard_rows: int = 8192, block_anchors: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows whose id satisfies anchors (a function of the id column).

    Components become floor(scale * x); a score is an integer inner product; higher ones come first, ties by the smaller id. A
    positive is one of an anchor's first other rows of its label; its negatives are the first rows of other labels that
    satisfy low * positive_score <= 100 * score <= high * positive_score. For high = 100 and a negative score no row does.

    Rows with a null id, label or vector, an empty vector, a null or a component that isn't finite take no part; vectors of
    different lengths don't meet. A row isn't its own partner, nor are others with its id; an id that repeats among the
    anchors asks with its least label and vector. Other columns are not read, whatever their names. An empty table gives an
    empty one. A component beyond 2^21 / scale ends in an error.

    Rows with equal integers and label are one node with its least ids (each map task sends no more of a crowded one). Nodes are
    dealt to shards by hash, each a vantage-point tree built in a task of its own; blocks of anchors meet every shard, first
    for positives, then with windows for negatives. A task holds one tree and one block. The result is exact.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(vec) & (F.size(vec) > 0)
    each = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.when(sound, integers(vec, scale, LARGEST)).alias("ints")).where("ints IS NOT NULL")
    each = materialize(each.withColumns({"dim": F.size("ints"), "a": F.xxhash64("ints"), "b": F.xxhash64(F.lit("other"), "ints")}))
    top = max(positives, negatives) + 1
    nodes = materialize(first_rows(each, ["dim", "a", "b", "label"], [F.col("id")], top).groupBy("dim", "a", "b", "label").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("ints").alias("ints")))
    asked = materialize(first_rows(each.where(anchors(F.col("id"))).select("id", "label", "dim", "ints"), ["id"], [F.col("label"), F.col("ints")], 1).drop("rank"))
    n_asked = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}
    sizes = [(r["dim"], max(1, round(r["count"] / min(shard_rows, max(256, (1 << 22) // r["dim"])))), -(-n_asked[r["dim"]] // block_anchors)) for r in nodes.groupBy("dim").count().collect() if r["dim"] in n_asked]
    sized = F.broadcast(spark.createDataFrame(sizes, "dim int, shards int, blocks int"))  # a row for each length of vectors
    dealt = nodes.join(sized, "dim").select("dim", F.pmod("a", "shards").cast("int").alias("shard"), F.struct("b", "label").alias("p"), "label", "ids", "ints").withColumn("place", F.xxhash64("p")).drop("p")
    trees = materialize(dealt.groupBy("dim", "shard").applyInArrow(_build, TREES))
    left = trees.join(sized.select("dim", "blocks"), "dim").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    keys = ["dim", "shard", "block"]

    def met(some: DataFrame, k: int, same: bool) -> DataFrame:
        right = some.join(sized, "dim").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).select(*keys, "id", "label", "ints", "windows")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_traverse(k, same), "anchor_id long, top long, id long, score long")

    no_window = F.array(F.lit(None).cast("struct<low:double,high:double>"))
    best = first_rows(met(asked.withColumn("windows", no_window), positives, True), ["anchor_id"], [F.desc("score"), F.col("id")], positives)
    best = best.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # low * p <= 100 * n <= high * p in whole numbers: n from ceil(low * p / 100) to floor(high * p / 100)
    floor = lambda c: ((c - F.pmod(c, F.lit(100))) / 100).cast("long")
    best = materialize(best.withColumn("top", floor(F.col("positive_score") * high)).withColumn("bottom", -floor(-F.col("positive_score") * low)))
    windows = best.where("bottom <= top").groupBy("anchor_id", "top").agg(F.min("bottom").alias("bottom")).groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("bottom").cast("double").alias("low"), F.col("top").cast("double").alias("high"))).alias("windows"))
    hard = first_rows(met(asked.join(windows, F.col("id") == F.col("anchor_id")).drop("anchor_id"), negatives, False), ["anchor_id", "top"], [F.desc("score"), F.col("id")], negatives)
    out = best.drop("bottom").join(hard.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score"), ["anchor_id", "top"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(rows, lambda i: i % 100 == 0)


ORACLE_SQL: dict[str, str] = {"op13_hard_negatives": """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5"""}
QUERIES = {"op13_hard_negatives": op13_hard_negatives}
