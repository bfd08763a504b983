"""Approximate nearest neighbours: a robust-pruned directed graph per shard, beam search of every shard, exact scores of what it finds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scoped
from .embeddings import matrix, units
from .vector_codes import finite

#: Links of a node after pruning, and places for links that others add before it is pruned again.
DEGREE, SPARE = 32, 16
#: Nodes inserted, and queries searched, at once; nodes of the first batch, which see one another.
BATCH, FIRST = 512, 128
#: How much nearer to a kept link than to the node itself a candidate may be, as a factor of distances, before it is pruned.
ALPHA = 1.2


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, cosines) of the beam best nodes seen for each query, best first; node n = len(graph) where there are fewer.

    Greedy search from starts: the width best nodes not yet expanded hand in their links, until the beam's nodes all have.
    x has one row of zeros more than graph, for links that aren't there.
    """
    n, m = len(graph), len(queries)
    nodes, near, done = np.full((m, beam), n), np.full((m, beam), -np.inf, np.float32), np.ones((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    seen[:, starts] = True
    first = queries @ x[starts].T
    best = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    k = best.shape[1]
    nodes[:, :k], near[:, :k], done[:, :k] = starts[best], np.take_along_axis(first, best, 1), False
    live = np.arange(m)
    while len(live):
        place = np.argsort(done[live], axis=1, kind="stable")[:, :width]
        fresh = ~np.take_along_axis(done[live], place, 1)
        live, place, fresh = live[fresh[:, 0]], place[fresh[:, 0]], fresh[fresh[:, 0]]
        if not len(live):
            break
        np.put_along_axis(flags := done[live], place, True, 1)
        done[live] = flags
        at = np.where(fresh, np.take_along_axis(nodes[live], place, 1), n)
        links = np.where((at < n)[:, :, None], graph[np.minimum(at, n - 1)], n).reshape(len(live), -1)
        links = np.where(seen[live[:, None], links], n, links)
        links.sort(axis=1)
        links[:, 1:][links[:, 1:] == links[:, :-1]] = n
        seen[live[:, None], links] = True
        r, c = np.nonzero(links < n)
        cos = np.full(links.shape, -np.inf, np.float32)
        cos[r, c] = np.einsum("ij,ij->i", queries[live[r]], x[links[r, c]])
        all_near = np.concatenate([near[live], cos], axis=1)
        keep = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        keep = np.take_along_axis(keep, np.argsort(-np.take_along_axis(all_near, keep, 1), axis=1, kind="stable"), 1)
        near[live] = np.take_along_axis(all_near, keep, 1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], links], axis=1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], links == n], axis=1), keep, 1)
    return nodes, near


def robust_prune(x: np.ndarray, own: np.ndarray, found: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Up to degree of the candidates found (rows of node numbers) for each node of own, nearest first, the rest of the row n = len(x) - 1.

    A kept candidate takes out those that lie alpha times nearer to it than to the node: links point in different directions.
    """
    n = len(x) - 1
    found = np.sort(np.where(found == own[:, None], n, found), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = n
    vecs = x[found]
    near = np.where(found < n, np.einsum("bcd,bd->bc", vecs, x[own]), -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    found, near, vecs = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(vecs, order[:, :, None], 1)
    between = alpha * alpha * (1 - vecs @ vecs.transpose(0, 2, 1))
    alive, far = found < n, 1 - near
    kept, out = np.zeros(len(own), np.int64), np.full((len(own), degree), n)
    for i in range(found.shape[1]):
        rows = np.flatnonzero(alive[:, i] & (kept < degree))
        if len(rows):
            out[rows, kept[rows]] = found[rows, i]
            kept[rows] += 1
            alive[rows, i + 1 :] &= between[rows, i, i + 1 :] > far[rows, i + 1 :]
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = 64, alpha: float = ALPHA) -> np.ndarray:
    """The links of each row of x (single-precision units) as node numbers, n for none: degree + SPARE columns.

    Rows come in batches, in the order given: a greedy search over the graph so far proposes a row's neighbours, pruning
    keeps diverse ones, and each of these links back; a node whose places are full is pruned again.
    """
    n = len(x)
    graph = np.full((n, degree + SPARE), n)
    padded = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    starts = np.arange(min(n, FIRST))
    filled = 0
    while filled < n:
        size = FIRST if not filled else min(BATCH, filled)
        new = np.arange(filled, min(n, filled + size))
        peers = np.broadcast_to(new, (len(new), len(new)))
        if filled:
            candidates, _ = beam_search(padded, graph, starts[: min(len(starts), 32)], x[new], beam)
            # rows of a batch don't see one another in the graph: the nearest of them are proposed too
            among = x[new] @ x[new].T
            top = np.argsort(-among, axis=1)[:, : min(len(new), degree // 2)]
            candidates = np.concatenate([candidates, new[top]], axis=1)
        else:
            candidates = peers
        for s in range(0, len(new), 128):
            graph[new[s : s + 128], :degree] = robust_prune(padded, new[s : s + 128], candidates[s : s + 128], degree, alpha)
        _link_back(padded, graph, new, degree, alpha)
        filled += len(new)
    return graph


def _link_back(x: np.ndarray, graph: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    n, wide = len(graph), graph.shape[1]
    u, v = np.repeat(new, degree), graph[new, :degree].reshape(-1)
    u, v = u[v < n], v[v < n]
    known = (graph[v] == u[:, None]).any(axis=1)
    u, v = u[~known], v[~known]
    near = np.einsum("ij,ij->i", x[u], x[v])
    order = np.lexsort((-near, v))
    u, v = u[order], v[order]
    ends, first, count = np.unique(v, return_index=True, return_counts=True)
    rank = np.arange(len(v)) - np.repeat(first, count)
    held = (graph[ends] < n).sum(axis=1)
    row = np.repeat(np.arange(len(ends)), count)
    fits = np.repeat(held + count <= wide, count)
    graph[v[fits], held[row[fits]] + rank[fits]] = u[fits]
    full = np.flatnonzero(held + count > wide)
    for s in range(0, len(full), 256):
        some = full[s : s + 256]
        most = min(int(count[some].max()), 2 * wide)  # not all of more than these, the nearest ones, could stay
        incoming = np.full((len(some), most), n)
        at = np.flatnonzero(np.isin(row, some) & (rank < most))
        incoming[np.searchsorted(some, row[at]), rank[at]] = u[at]
        candidates = np.concatenate([graph[ends[some]], incoming], axis=1)
        graph[ends[some]] = n
        graph[ends[some], :degree] = robust_prune(x, ends[some], candidates, degree, alpha)


def _build(t: pa.Table) -> pa.Table:
    dim = t["dim"][0].as_py()
    order = np.argsort(t["place"].to_numpy(), kind="stable")
    raw = matrix(t["vec"], dim)[order]
    held = t["ids"].combine_chunks().take(pa.array(order))
    bounds = np.r_[0, np.cumsum(pa.compute.list_value_length(held).to_numpy())]
    packed = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    graph = build_graph(units(raw).astype(np.float32))
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([t["shard"][0].as_py()], pa.int32()), "vecs": packed(raw), "links": packed(graph.astype(np.int32)), "ids": packed(held.flatten().to_numpy()), "bounds": packed(bounds.astype(np.int64))})


def _search(k: int, beam: int, part: type):
    """One task's work: a shard's graph, and the queries of a block that meet it; each query's k nearest rows in the shard."""

    def run(shards: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not shards.num_rows or not asked.num_rows:
            return empty
        s = shards.to_pylist()[0]
        raw = np.frombuffer(s["vecs"], part).reshape(-1, s["dim"])
        graph, ids, bounds = np.frombuffer(s["links"], np.int32).reshape(len(raw), -1).astype(np.int64), np.frombuffer(s["ids"], np.int64), np.frombuffer(s["bounds"], np.int64)
        exact = units(raw)
        x = np.concatenate([exact.astype(np.float32), np.zeros((1, s["dim"]), np.float32)])
        queries = units(matrix(asked["vec"], s["dim"]))
        own, starts, out = asked["id"].to_numpy(), np.arange(min(len(raw), 32)), []
        for a in range(0, len(own), BATCH // 2):
            q = queries[a : a + BATCH // 2]
            nodes, _ = beam_search(x, graph, starts, q.astype(np.float32), min(beam, len(raw)))
            r, c = np.nonzero(nodes < len(raw))
            node = nodes[r, c]
            score = np.einsum("ij,ij->i", q[r], exact[node])
            # each node stands for its least ids: of the nodes in front k + 1 are enough, as one row is the query's own
            order = np.lexsort((ids[bounds[node]], -score, r))
            r, node, score = r[order], node[order], score[order]
            front = np.arange(len(r)) - np.searchsorted(r, r) <= k
            r, node, score = r[front], node[front], score[front]
            n = bounds[node + 1] - bounds[node]
            at = np.repeat(bounds[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            r, score, found = np.repeat(r, n), np.repeat(score, n), ids[at]
            other = found != own[a + r]
            r, score, found = r[other], score[other], found[other]
            order = np.lexsort((found, -score, r))
            r, score, found = r[order], score[order], found[order]
            front = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append(pa.table({"query_id": own[a + r[front]], "vec_id": found[front], "score": score[front]}))
        return pa.concat_tables(out)

    return run


def first_rows(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key with their place from 1; Spark cuts each map task's rows to k a key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


@scoped
def graph_neighbours(vectors: DataFrame, asks, k: int = 5, beam: int = 128, shard_rows: int = 8192, shard_bytes: int = 1 << 25, block_queries: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id satisfies asks (a function of the id column) the k nearest other rows found, by cosine.

    Vectors that are null, empty, zero or hold a null or a component that isn't finite take no part, as don't rows with a null
    id. Vectors of different lengths don't meet. Rows that repeat an id count as the query's own for a query with that id,
    whose vector is the least of them. Ties go to the smaller id; fewer than k candidates give fewer rows. Other columns are
    not read, whatever their names. An empty table gives an empty one.

    Equal vectors are one node with its k + 1 least ids (of a vector with a third of all rows each map task sends k + 1), so
    copies don't fill a beam. Nodes are dealt to shards of about shard_rows (fewer if long) by hash; each shard is a graph,
    built in a task of its own; every block of queries meets every shard in a task that holds one of each. The search is
    approximate within a shard; scores are cosines of the vectors as given, in double precision, as is the order of what is found.
    """
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"
    part = np.float32 if kind == "float" else np.float64
    vec = F.col(vec_col).cast(f"array<{kind}>")
    sound = F.col(id_col).isNotNull() & finite(vec) & F.exists(vec, lambda v: v != 0)
    each = materialize(vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.size(vec).alias("dim"), F.xxhash64(vec).alias("a"), F.xxhash64(F.lit("other"), vec).alias("b")))
    nodes = first_rows(each, ["dim", "a", "b"], [F.col("id")], k + 1).groupBy("dim", "a", "b").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))
    nodes = materialize(nodes)
    asked = materialize(first_rows(each.where(asks(F.col("id"))).select("id", "dim", "vec"), ["id"], [F.col("vec")], 1).drop("rank"))
    spark = vectors.sparkSession
    n_asked = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}
    sizes = [(r["dim"], max(1, round(r["count"] / min(shard_rows, max(256, shard_bytes // (8 * r["dim"]))))), -(-n_asked[r["dim"]] // block_queries)) for r in nodes.groupBy("dim").count().collect() if r["dim"] in n_asked]
    sized = F.broadcast(spark.createDataFrame(sizes, "dim int, shards int, blocks int"))  # a row for each length of vectors
    dealt = nodes.join(sized, "dim").select("dim", F.pmod("a", "shards").cast("int").alias("shard"), F.col("b").alias("place"), "vec", "ids")
    graphs = materialize(dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, vecs binary, links binary, ids binary, bounds binary"))
    left = graphs.join(sized.select("dim", "blocks"), "dim").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    right = asked.join(sized, "dim").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).select("dim", "shard", "block", "id", "vec")
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, beam, part), "query_id long, vec_id long, score double")
    return first_rows(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def op12_vector_graph(spark, sf_dir: str) -> DataFrame:
    return graph_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op12_vector_graph": op12_vector_graph}
