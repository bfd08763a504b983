"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing and packing, each written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgrid.llm.common import materialize
from loomgrid.llm.line_dedup import dedup_lines
from loomgrid.llm.mixing import LEVELS, TARGET, domain_of, mix_sources
from loomgrid.llm.near_copies import near_copy_components
from loomgrid.llm.packing import VOCABULARY, pack_documents
from loomgrid.llm.quality import keep_passing, quality_rules

#: One pass at most, and this share of the words that come in: leaves over their stated or even share lose, the others stay whole.
MIX_SHARE = 0.95


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the likelihood ratio reject go. Null, empty and blank texts have no words and so go; rows that repeat an id are judged one by one."""
    return keep_passing(quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go from all documents but the last one that holds them. No row goes; a null text becomes an empty one, and a row with a null id stays as it is."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity 0.8 or more on 5-word shingles the document with the smallest id stays, once.

    Texts without words are equal to one another. Of rows that repeat the smallest id the least one in the order of all other
    columns stays. Rows without an id all stay.
    """
    groups = near_copy_components(docs, width=5, least=0.8)
    first = groups.where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*(c for c in docs.columns if c != "doc_id")))
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__place", place).where("__place = 1")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves of the domain-language-source tree give their budgets' prefixes: stated shares where there are any, one pass at most. Nulls in a level are a name of their own; a text without words costs nothing and is taken with its place in the order."""
    mixed = mix_sources(docs.withColumn("__domain", domain_of(F.col("source"))), total_share=MIX_SHARE, max_epochs=1, weights=TARGET, levels=("__domain", *LEVELS[1:]))
    return mixed.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of 4096; a null or empty text is its end id alone."""
    _, places = pack_documents(docs, public_tokenizers.path(VOCABULARY))
    return places.withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("mixing", mixing), ("packing", packing)]
#: Tokenizers and XXH64 fingerprints have no counterpart in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
