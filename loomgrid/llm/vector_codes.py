"""Vector code compression: a codebook per part from exact integer rounds; nearest entries by exponion search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, materialize, scoped

#: Integer components up to this size; squared distances of parts of up to 2^10 of them stay within 63 bits.
LARGEST = 1 << 25
#: Different labels up to which their sums are broadcast (some 60 bytes each).
BROADCAST_LABELS = 1 << 18


def finite(vec):
    """A list without nulls whose components are finite; null for a null list counts as no."""
    return F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def integers(vec, scale: int, largest: int):
    """floor(scale * component) of each component, in double precision; one that is larger than largest ends in an error."""
    whole = lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))
    held = lambda v: F.abs(v.cast("double")) <= float(largest) / scale
    return F.transform(vec, lambda v: F.when(held(v), whole(v)).otherwise(F.raise_error(F.lit(f"a vector component is larger than {largest / scale:g}"))).cast("int"))


def flat(column: pa.Array, rows: int) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(rows, len(values) // max(1, rows))


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.int32()), pa.array(values.reshape(-1), kind))


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts begin and end: equal ones, or as equal as the length allows."""
    return [(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]


def nearest_entries(x: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each integer row, the lower index on a tie.

    Exponion search: with u the distance to the entry where a row starts, whatever is as near lies within 2u of that entry
    (triangle inequality), so only the head of its distance-sorted list of entries is scanned: squared distances up to 4u².
    """
    between = np.square(book[:, None] - book[None]).sum(axis=2)
    order = np.argsort(between, axis=1, kind="stable")
    by_distance = np.take_along_axis(between, order, axis=1)
    own = np.square(x - book[start]).sum(axis=1)
    best, least = start.copy(), own.copy()
    heads = np.zeros(len(x), np.int64)
    for a in np.unique(start):
        rows = np.flatnonzero(start == a)
        heads[rows] = np.searchsorted(by_distance[a], 4 * own[rows], side="right")
    for k in range(len(book)):
        rows = np.flatnonzero(heads > k)
        if not len(rows):
            break
        entry = order[start[rows], k]
        far = np.square(x[rows] - book[entry]).sum(axis=1)
        better = (far < least[rows]) | ((far == least[rows]) & (entry < best[rows]))
        best[rows[better]], least[rows[better]] = entry[better], far[better]
    return best, least


def _assign(books: dict[int, list[np.ndarray]], parts: int, sums: bool):
    """Batches with new codes and errors; with sums, a last row for each length that holds the task's sums and counts by part and entry."""

    def run(batches):
        totals: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for t in batches:
            dims = t.column("dim").to_numpy()
            for dim in np.unique(dims):
                book = books[int(dim)]
                part = t if (dims == dim).all() else t.take(pa.array(np.flatnonzero(dims == dim)))
                n = part.num_rows
                ints, start = flat(part.column("ints"), n).astype(np.int64), flat(part.column("code"), n).astype(np.int64)
                code, error = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
                held = totals.setdefault(int(dim), [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in book])
                for p, (a, b) in enumerate(cuts(int(dim), parts)):
                    code[:, p], far = nearest_entries(ints[:, a:b], start[:, p], book[p])
                    error += far
                    if sums:
                        np.add.at(held[p][0], code[:, p], ints[:, a:b])
                        held[p][1][:] += np.bincount(code[:, p], minlength=len(book[p]))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("dim"), part.column("ints"), lists(code.astype(np.int8), pa.int8()), pa.array(error), pa.nulls(n, pa.list_(pa.int64()))], ["id", "label", "dim", "ints", "code", "error", "sums"])
        for dim, held in totals.items() if sums else ():
            line = np.concatenate([np.r_[s.reshape(-1), c] for s, c in held])[None]
            empty = [pa.nulls(1, t.schema.field(c).type) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([dim], pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int8())), pa.nulls(1, pa.int64()), lists(line, pa.int64())], ["id", "label", "dim", "ints", "code", "error", "sums"])

    return run


def _moved(book: list[np.ndarray], totals: np.ndarray) -> list[np.ndarray]:
    """The codebooks after a round: floor(sum / count) for each entry in use."""
    out, at = [], 0
    for b in book:
        sums = totals[at : at + b.size].reshape(b.shape)
        count = totals[at + b.size : at + b.size + len(b)]
        at += b.size + len(b)
        out.append(np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], b))
    return out


@scoped
def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(codes, codebooks): codes has id, label, dim, code (array of entry numbers by part) and error (squared distances summed over parts); codebooks has dim, part, entry, values.

    Components become floor(scale * x) and all that follows is exact in integers. Each part's codebook starts as that part of
    the vectors with the least ids (null ids last, then by the vector), fewer if there are fewer. A round sends each part to
    its nearest entry, the lower one on a tie, and moves each entry in use to the floor of its parts' mean.

    Rows whose vector is null or holds a null or a component that isn't finite are left out. Repeated rows count each time.
    Vectors of different lengths have codebooks of their own; a length that the parts don't divide is cut as evenly as it
    goes, and an empty vector has code 0 and error 0 in every part. A null label is a label of its own. Other columns are
    not read, whatever their names. An empty table gives empty ones. A component beyond 2^25 / scale ends in an error.

    A row keeps its last code from round to round in the table that the round writes, beside its task's sums for the next
    codebooks, which are added up in Spark. What travels to the driver and back are codebooks, of a size given by the
    parameters and the length of a vector, never rows.
    """
    spark = vectors.sparkSession
    label = vectors.schema[label_col].dataType.simpleString()
    vec = F.col(vec_col).cast("array<double>")
    first = F.array_repeat(F.lit(0).cast("tinyint"), parts)
    each = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(finite(vec), vec).alias("v")).where("v IS NOT NULL")
    now = materialize(each.select("id", "label", F.size("v").alias("dim"), integers(F.col("v"), scale, LARGEST).alias("ints"), first.alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("array<long>").alias("sums")))
    books: dict[int, list[np.ndarray]] = {}
    for row in now.select("dim").distinct().collect():
        dim = row["dim"]
        head = now.where(F.col("dim") == dim).select("id", "ints").orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
        whole = np.array([r["ints"] for r in head], np.int64).reshape(len(head), dim)
        books[dim] = [whole[:, a:b] for a, b in cuts(dim, parts)]
    shape = f"id long, label {label}, dim int, ints array<int>, code array<tinyint>, error long, sums array<long>"
    for _ in range(rounds):
        then = materialize(now.where("sums IS NULL").mapInArrow(_assign(books, parts, True), shape))
        drop_written(now)
        now = then
        totals = {dim: np.zeros(sum(b.size + len(b) for b in book), np.int64) for dim, book in books.items()}
        for r in now.where("sums IS NOT NULL").select("dim", F.posexplode("sums").alias("at", "v")).groupBy("dim", "at").agg(F.sum("v").alias("v")).collect():
            totals[r["dim"]][r["at"]] = r["v"]
        books = {dim: _moved(book, totals[dim]) for dim, book in books.items()}
    codes = materialize(now.where("sums IS NULL").mapInArrow(_assign(books, parts, False), shape).select("id", "label", "dim", "code", "error"))
    listed = [(dim, p, e, [int(v) for v in values]) for dim, book in books.items() for p, b in enumerate(book) for e, values in enumerate(b)]
    return codes, spark.createDataFrame(listed, "dim int, part int, entry int, values array<long>")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    small = totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    hexes = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "entry", "values"))), lambda e: e["values"])
    digest = books.groupBy(F.col("dim").alias("d")).agg(F.sha2(F.array_join(F.flatten(lines), ","), 256).alias("codebooks_sha256"))
    out = codes.join(F.broadcast(totals) if small else totals, F.col("label").eqNullSafe(F.col("l"))).join(digest, F.col("dim") == F.col("d"))
    return out.select(F.col("id").alias("vec_id"), hexes.alias("code"), "error", "label_error", "codebooks_sha256")


def _sql(rounds: int = 6) -> str:
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT vec_id, part, entry, {far} AS d FROM p JOIN b{i} USING (part)) GROUP BY vec_id, part)")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY pos) AS c FROM (SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM p JOIN a{i} USING (vec_id, part)) GROUP BY ALL) GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT b{i}.part, b{i}.entry, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (part, entry))""")
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, j AS part, v[j * (len(v) // 8) + 1 : (j + 1) * (len(v) // 8)] AS x FROM v, (SELECT unnest(range(8)) AS j)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 16),
{', '.join(steps)},
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT e.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM e JOIN v ON e.vec_id = v.vec_id"""


ORACLE_SQL: dict[str, str] = {"op11_vector_codes": _sql()}
QUERIES = {"op11_vector_codes": op11_vector_codes}
