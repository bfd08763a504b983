"""Checks that emit one row per finding, and reconciliation of declared, expected and found codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(df: DataFrame, rules: Sequence[tuple[str, str, Column]], target: Column) -> DataFrame:
    """(rule_code, severity, target): a row for every rule that holds, in one pass over df."""
    found = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"))) for code, severity, cond in rules))
    return df.select(target.alias("target"), F.explode(F.array_compact(found)).alias("f")).select("f.rule_code", "f.severity", "target")


def phase_unbalance(df: DataFrame, key: str, phase: Column, load: Column, three_phase: Column | None = None, percent: int = 15, least: int = 1) -> DataFrame:
    """Keys whose three phase sums are all positive, the largest over least, and (max - min) / max over percent; whole numbers, no rounding.

    A three-phase load lies on each phase with a third: sums are in thirds, so that they stay whole.
    """
    three = F.lit(False) if three_phase is None else F.coalesce(three_phase, F.lit(False))
    sums = df.groupBy(key).agg(*(F.sum(F.when(three, load).when(phase == p, 3 * load).otherwise(0)).alias(f"phase_{p}") for p in range(3)))
    cols = [f"phase_{p}" for p in range(3)]
    high, low = F.greatest(*cols), F.least(*cols)
    return sums.where((low > 0) & (high > 3 * least) & ((high - low) * 100 > high * percent))


def cascade(df: DataFrame, key: str, incomer: Column, amps: Column) -> DataFrame:
    """Rows that aren't incomers whose amps exceed the least of their key's incomers; the minimum is aggregated, then joined."""
    least = df.where(incomer).groupBy(key).agg(F.min(amps).alias("least_incomer"))
    return df.where(~incomer).join(least, key).where(amps > F.col("least_incomer"))


def count_mismatch(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected counts (keys..., expected) against found rows: those with another count, missing ones with found 0."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("found"))
    return expected.join(counts, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(0))).where("expected <> found")


def coverage(declared: DataFrame, found: DataFrame, item: str, codes: str, code: str) -> DataFrame:
    """(item, n_declared, n_matched, missing, status) of declared code lists against the codes that were found."""
    each = declared.select(item, F.explode(F.array_distinct(codes)).alias("__c"))
    have = found.select(F.col(code).alias("__c")).distinct().withColumn("__f", F.lit(1))
    out = each.join(have, "__c", "left").groupBy(item).agg(F.count("*").alias("n_declared"), F.count("__f").alias("n_matched"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("__f").isNull(), F.col("__c")))), ",").alias("missing"))
    return out.withColumn("status", F.when(F.col("n_matched") == F.col("n_declared"), "COVERED").when(F.col("n_matched") > 0, "PARTIAL").otherwise("MISSING"))


def set_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """(value, side): every distinct value of two one-column frames and whether it is in both, only_a or only_b."""
    x, y = a.toDF("value").distinct().withColumn("a", F.lit(1)), b.toDF("value").distinct().withColumn("b", F.lit(1))
    return x.join(y, "value", "full_outer").select("value", F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both").alias("side"))


def contained(claims: DataFrame, corpus: DataFrame, claim: str, text: str, claim_id: str, text_id: str, anchor: int = 12, stride: int = 16) -> DataFrame:
    """(claim_id, text_id): corpus rows whose text contains the claim. An empty or null claim, as a null text, matches nothing.

    A text is cut once into pieces of stride characters. A claim of at least 2 * stride - 1 characters holds one of them whole,
    wherever it stands, so it meets the text on one of the hashes of its first stride windows. Shorter claims meet on the
    hash of their first anchor characters (of all of a shorter one): for them a text sends its windows of the lengths that
    such claims have, taken from short overlapping pieces. Either way the work is linear in the text, and only texts that
    meet a claim are read again to be verified. It is the same at every size of either side, and no nested loop.
    """
    named = claims.where(F.char_length(claim) > 0).select(F.col(claim_id).alias("__c"), F.col(claim).alias("__claim"), F.char_length(claim).alias("__len"))
    texts = corpus.where(F.col(text).isNotNull()).select(F.col(text_id).alias("__t"), F.col(text).alias("__text"))
    is_long = F.col("__len") >= 2 * stride - 1
    pieces = F.transform(F.regexp_extract_all("__text", F.lit(f"(?s).{{{stride}}}"), F.lit(0)), lambda p: F.xxhash64(p))
    windows = F.transform(F.sequence(F.lit(1), F.lit(stride)), lambda i: F.xxhash64(F.substring(F.col("__claim"), i, F.lit(stride))))
    met = [_met(texts, pieces, named.where(is_long).select("__c", F.explode(F.array_distinct(windows)).alias("__k")))]
    short = named.where(~is_long).withColumn("__n", F.least("__len", F.lit(anchor)))
    lengths = sorted(r[0] for r in short.select("__n").distinct().collect())  # anchor different ones at most
    if lengths:
        cut = F.regexp_extract_all("__text", F.lit("(?s).{1,64}"), F.lit(0))
        joined = F.zip_with(cut, F.slice(cut, 2, 1 << 30), lambda p, q: F.struct(F.char_length(p).alias("n"), F.concat(p, F.left(F.coalesce(q, F.lit("")), F.lit(anchor - 1))).alias("p")))
        of = lambda n: F.flatten(F.transform(F.col("__cut"), lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.xxhash64(F.substring(x["p"], i, F.lit(n))))))
        met.append(_met(texts.withColumn("__cut", joined), F.concat(*map(of, lengths)), short.select("__c", F.xxhash64(F.expr("left(__claim, __n)")).alias("__k"))))
    both = (met[0] if len(met) == 1 else met[0].unionByName(met[1])).join(texts, "__t").join(named.select("__c", "__claim"), "__c")
    return both.where(F.contains("__text", "__claim")).select(F.col("__c").alias(claim_id), F.col("__t").alias(text_id))


def _met(texts: DataFrame, keys: Column, named: DataFrame) -> DataFrame:
    return texts.select("__t", F.explode(F.array_distinct(keys)).alias("__k")).join(named, "__k").select("__t", "__c").distinct()


def recall_precision(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: counts, recall and precision; an empty denominator gives 1."""
    hit, gold, said = (F.count_if(c) for c in (truth & predicted, truth, predicted))
    return df.agg(hit.alias("hits"), gold.alias("gold"), said.alias("predicted")).select("*", F.coalesce(F.try_divide(F.col("hits"), F.col("gold")), F.lit(1.0)).alias("recall"), F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(1.0)).alias("precision"))
