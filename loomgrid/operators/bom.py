"""Bills of material: keyed roll-ups with ordered texts, survivorship, first and best rows, stable orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order (a total order gives the same row each time)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def rollup_bom(df: DataFrame, keys: Sequence[str], quantity: Column, texts: Mapping[str, str], order: Column, seps: Mapping[str, str] | None = None, sep: str = "、") -> DataFrame:
    """Per key the sum of quantity and, for each text column, its distinct non-empty values in the order of first sight, joined by sep (or its own one in seps).

    One pass: rows are first added up for each combination of a key and its texts, so what a key gathers are its different
    texts, each with its first place, and no side is read or joined again. A null key is a key.
    """
    cols = {name: f"__t{i}" for i, name in enumerate(texts)}
    small = df.groupBy(*keys, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(cols[n]) for n, c in texts.items())).agg(F.sum(quantity).alias("__q"), F.min(order).alias("__o"))
    seen = lambda n: F.collect_list(F.when(F.col(cols[n]) != "", F.struct("__o", F.col(cols[n]).alias("v"))))
    joined = {n: F.array_join(F.array_distinct(F.transform(F.array_sort(seen(n)), lambda x: x["v"])), (seps or {}).get(n, sep)).alias(n) for n in texts}
    return small.groupBy(*keys).agg(F.sum("__q").alias("quantity"), *joined.values())


def spread(df: DataFrame, keys: Sequence[str], part: str, quantity: Column) -> DataFrame:
    """Per key the total and a map part -> sum: sums per (key, part) first, so a map holds one entry a part."""
    per = df.groupBy(*keys, part).agg(F.sum(quantity).alias("q"))
    return per.groupBy(*keys).agg(F.sum("q").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(part).alias("k"), F.col("q").alias("v"))))).alias("parts"))


def unmatched(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of left that refer to nothing in right."""
    return left.join(right, on, "left_anti")


def survivors(df: DataFrame, keys: Sequence[str], order: Column, longest: Sequence[str] = (), first_filled: Sequence[str] = (), agreed: Sequence[str] = ()) -> DataFrame:
    """One row per key: the longest text (earliest on a tie), the first non-empty value, and whether all non-empty values agree."""
    filled = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c))
    out = [F.min_by(F.col(c), F.struct(-F.char_length(F.col(c)), order)).alias(c) for c in longest]
    out += [F.min_by(F.col(c), F.when(filled(c).isNotNull(), order)).alias(c) for c in first_filled]
    out += [(F.count_distinct(filled(c)) <= 1).alias(f"{c}_agreed") for c in agreed]
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *out)


def merge_sightings(df: DataFrame, keys: Sequence[str], low: str, high: str, order: Column) -> DataFrame:
    """Rows of a key that overlap an earlier kept row by half of the smaller height are the same sighting; the first stays.

    The rule isn't transitive, so each key's rows are folded in order; a key's rows are those of one circuit signature.
    """
    fields = F.struct(order.alias("o"), F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi"))
    shared = lambda a, b: F.least(a["hi"], b["hi"]) - F.greatest(a["lo"], b["lo"]) >= 0.5 * F.least(a["hi"] - a["lo"], b["hi"] - b["lo"])
    rows = F.array_sort(F.collect_list(fields))
    kept = F.aggregate("rows", F.expr("filter(rows, x -> false)"), lambda acc, r: F.when(F.exists(acc, lambda k: shared(k, r)), acc).otherwise(F.concat(acc, F.array(r))))
    return df.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.explode(kept).alias("__kept")).select(*keys, "__kept.o", F.col("__kept.lo").alias(low), F.col("__kept.hi").alias(high))
