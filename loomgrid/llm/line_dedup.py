"""Line deduplication: hash normalised lines, count documents per hash, drop frequent lines, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, lower_ascii, materialize, scoped

#: So many frequent keys at most (12 MB) are broadcast; more are joined by shuffle, where hot keys are split.
BROADCAST_KEYS = 500_000


def line_keys(lines: Column, min_chars: int) -> Column:
    """The 128-bit keys of the lines: blanks stripped at both ends, A-Z lower-cased; null for keys of under min_chars code points."""

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(BLANKS))
        text = lower_ascii(bare)
        return F.when(F.char_length(bare) >= min_chars, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("line"), text).alias("b")))

    return F.transform(lines, key)


@scoped
def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, most_broadcast: int = BROADCAST_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text_col rewritten and n_lines, n_dropped (long) beside it.

    Lines whose key stands in at least min_docs different ids go everywhere but in the largest id that holds the key;
    there all of them stay. A null or empty text is one empty line. A row with a null id takes no part and stays as it is.
    Rows that repeat an id count as one document and are each rewritten. A column of docs named n_lines or n_dropped is
    replaced; other columns pass through. An empty table gives an empty one.

    What is shuffled for counting is 32 bytes a line; the texts move once, to meet the keys they lose. The keys over the
    threshold are written and counted: up to most_broadcast of them are broadcast, so that no line moves to meet them and a
    very common line is no task's burden; more are joined by hash, with hot keys split.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.explode(F.array_distinct(F.filter(line_keys(lines, min_chars), lambda k: k.isNotNull()))).alias("k")).select("__id", "k.a", "k.b")
    common = own.groupBy("a", "b").agg(F.count_distinct("__id").alias("n"), F.max("__id").alias("keeper")).where(F.col("n") >= min_docs).select("a", "b", "keeper")
    common = materialize(common)
    common = F.broadcast(common) if common.count() <= most_broadcast else common
    lost = own.join(common, ["a", "b"]).where(F.col("__id") != F.col("keeper")).groupBy("__id").agg(F.collect_set(F.struct("a", "b")).alias("__lost"))
    joined = docs.join(lost, docs[id_col] == lost["__id"], "left").drop("__id")
    names = docs.columns
    joined = joined.withColumn("__lines", lines)
    kept = F.when(F.col("__lost").isNull(), F.col("__lines")).otherwise(
        F.transform(F.filter(F.arrays_zip(F.col("__lines").alias("l"), line_keys(F.col("__lines"), min_chars).alias("k")), lambda x: x["k"].isNull() | ~F.array_contains(F.col("__lost"), x["k"])), lambda x: x["l"])
    )
    joined = joined.withColumn("__kept", kept)
    out = [F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in names]
    return joined.select(*out, F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def documents_sql(source: str = "documents") -> str:
    """DuckDB: doc_id, kept text, n_lines, n_dropped of the relation source."""
    return f"""
    WITH l AS (
      SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM {source})
    ), k AS (
      SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}') AS key FROM l
    ), f AS (
      SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), j AS (
      SELECT k.*, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f USING (key)
    )
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
           count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
    FROM j GROUP BY doc_id"""


ORACLE_SQL = {"op5_line_dedup": f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({documents_sql()})"}
QUERIES = {"op5_line_dedup": op5_line_dedup}
