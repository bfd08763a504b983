"""SimHash near-duplicates: fingerprints linked with the help of a table of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scoped
from .components import connected_components

#: The fingerprint's 64 bits in four blocks of 16.
BLOCKS = [0xFFFF << (16 * b) for b in range(4)]
SEED = 42
CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references(n: int) -> list[int]:
    """n reference fingerprints: XXH64 of 0, 1, ... under a fixed seed."""
    import xxhash

    return [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 2025) for i in range(n)]


def shingle_hashes(data: bytes, width: int):
    """The XXH64 hashes of the width-word shingles of a UTF-8 text, in arrays of CHUNK at most; a shorter text is one shingle."""
    import numpy as np
    import xxhash

    words = data.lower().split()
    if not words:
        return
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    if len(words) < width:
        start, end = start[:1], end[-1:]
    else:
        start, end = start[: len(words) - width + 1], end[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(start), CHUNK):
        spans = zip(start[i : i + CHUNK].tolist(), end[i : i + CHUNK].tolist())
        yield np.array([digest(text[a:b], SEED) for a, b in spans], np.uint64)


def majority_bits(hashes, n: int) -> int:
    """The bits that more than half of n hashes, given in arrays, have set; as a signed 64-bit number."""
    import numpy as np

    total = np.zeros(64, np.int64)
    for h in hashes:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(data: bytes, width: int = 3) -> int:
    """The SimHash of a UTF-8 text, as a signed 64-bit number."""
    hashes = list(shingle_hashes(data, width))
    return majority_bits(hashes, sum(map(len, hashes)))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; a null text has no words, and its fingerprint is zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "fp": [fingerprint((t or "").encode("utf-8", "surrogatepass"), width) for t in x["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, fp long")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def reference_distances(fp: Column, n: int = 24) -> list[Column]:
    """A fingerprint's row of the distance table: rows of fingerprints k bits apart differ by k at most in every place."""
    return [_distance(fp, F.lit(_signed(p))) for p in references(n)]


def candidate_keys(fp: DataFrame, n_references: int = 24) -> DataFrame:
    """(fp, d, key): d is the fingerprint's row of the distance table, one byte per reference; six keys.

    With at most two differing bits two of the four blocks hold none, and there the distances to every reference, taken
    over the block, differ by zero. So a key is the two blocks' part of the distance table, for each choice of two.
    """
    refs = references(n_references)
    near = lambda p, mask: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask))))
    block = lambda mask: F.concat(*(F.char((F.lit(65) + near(p, mask)).cast("long")) for p in refs))
    table = fp.select("fp", F.array(*(near(p, (1 << 64) - 1).cast("tinyint") for p in refs)).alias("d"), *(block(m).alias(f"b{i}") for i, m in enumerate(BLOCKS)))
    pairs = [(i, j) for i in range(4) for j in range(i)]
    return table.select("fp", "d", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), f"b{i}", f"b{j}").alias("h")) for n, (i, j) in enumerate(pairs)))).alias("key")).select("fp", "d", F.col("key.n").alias("n"), F.col("key.h").alias("h"))


def link_fingerprints(fp: DataFrame, bucket_limit: int = 48, n_references: int = 24) -> DataFrame:
    """(a, b): links among different fingerprints that connect exactly those within two differing bits of each other.

    fp has one row per fingerprint. Pairs with an equal key meet, those whose rows of the distance table differ by more
    than two somewhere are discarded, and the rest is verified. Buckets of over bucket_limit fingerprints are not paired
    up: each of their members names itself and its 64 one-bit neighbours, and those that name the same number, 65 at
    most and all within two bits of one another, are linked to the least of them. That finds every link among them.
    """
    keys = candidate_keys(fp, n_references)
    large = keys.groupBy("n", "h").count().where(F.col("count") > bucket_limit).select("n", "h")
    large = materialize(large)
    small = keys.join(large, ["n", "h"], "left_anti")
    a, b = small.alias("a"), small.alias("b")
    close = reduce(Column.__and__, (F.abs(F.col("a.d")[i] - F.col("b.d")[i]) <= 2 for i in range(n_references)))
    pairs = a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.fp") < F.col("b.fp")) & close & (_distance(F.col("a.fp"), F.col("b.fp")) <= 2)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowd = keys.join(large, ["n", "h"], "left_semi").select("fp").distinct()
    named = crowd.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))).alias("name"))
    met = named.groupBy("name").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


@scoped
def simhash_components(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = 48) -> DataFrame:
    """(id long, fp long, component_id long): one row per row of docs; fingerprints link at two or fewer differing bits.

    component_id is the smallest id reachable, itself included. Equal fingerprints (copies, empty texts) are taken
    together before anything is paired. Rows that repeat an id belong together; a row with a null id links with nothing
    and has a null component. Other columns of docs are not read. An empty table gives an empty one.
    """
    each = materialize(fingerprints(docs, width, id_col, text_col))
    fps = materialize(each.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    links = link_fingerprints(fps, bucket_limit)
    first = fps.select("fp", "first")
    edges = links.join(first.withColumnsRenamed({"fp": "a", "first": "src"}), "a").join(first.withColumnsRenamed({"fp": "b", "first": "dst"}), "b").select("src", "dst")
    twice = each.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("id").join(each, "id").join(first, "fp").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    comp = materialize(connected_components(edges.unionByName(twice)))
    label = materialize(first.join(comp, first["first"] == comp["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id")))
    out = each.join(label, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op6_simhash": op6_simhash}
