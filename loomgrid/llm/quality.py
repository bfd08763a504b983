"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio of trusted against raw text. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, BLANKS

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
BASE = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
#: Buckets of the hashed n-grams, the smoothing of their counts, the least mean log-likelihood ratio of a text that is kept.
BUCKETS, ALPHA, THRESHOLD = 1 << 15, 10.0, -0.1
#: So many trusted ids at most (16 MB) are broadcast; more are joined by shuffle.
TRUSTED_BROADCAST = 2_000_000


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def running(hashes: Column, step: int = 1) -> Column:
    """The hashes of each element with the one step further on; two words running, of word hashes."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _steps(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the columns of text_rules() but base_failed, and with __g: the hashes of all words and word pairs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__w", F.filter(F.split(text, f"{BLANK_CLASS}+"), lambda w: w != ""))
    out = out.withColumn("__l", F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    out = out.withColumn("__h", word_hashes(F.col("__w")))
    out = out.withColumn("__2", running(F.col("__h")))  # its last element is the last word with nothing after it
    out = out.withColumn("__g", F.concat("__h", F.slice("__2", 1, F.greatest(F.size("__2") - 1, F.lit(0)))))
    out = out.withColumn("__h", running(F.col("__2"), 2))
    out = out.withColumn("__h", running(F.col("__h"), 4))
    out = out.withColumn("__h", F.slice("__h", 1, F.greatest(F.size("__w") - (WINDOW - 1), F.lit(0))))
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.withColumn("__s", F.when(twice, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = F.zip_with(F.col("__s"), F.slice("__s", 2, F.greatest(F.size("__s") - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.withColumn("__p", F.array_sort(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull())))))
    gaps = F.zip_with("__p", F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return out.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"),
    }).drop("__w", "__l", "__h", "__2", "__s", "__p")


def text_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed (boolean).

    Words are [^\\x20\\x09-\\x0D]+. A null or blank text has no words and fails. Repeated windows are found inside the row:
    the 64-bit hashes of its 8-word windows are compared as a set, and only where that is smaller than their number are
    they sorted to see which positions repeat. Columns of docs with these names are replaced, others pass through. Each row
    is judged by itself, whatever its id, so repeats, ties and null ids need no care; a very long text is a longer array in
    its row. An empty table gives an empty one.
    """
    return _steps(docs.drop(*RULES), text_col).withColumn("base_failed", F.expr(BASE)).drop("__g")


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = TRUSTED_BROADCAST) -> list[float]:
    """log(p_trusted / p_raw) per bucket of word and word-pair hashes, as counted over all of docs and over those whose id is in trusted.

    trusted: one column id_col; repeats and nulls do no harm. Their number is counted first: up to most_broadcast ids are
    sent to the tasks, more are joined by shuffle, with the same counts. Counts are summed per bucket in the tasks before
    the shuffle; the driver gets one row per bucket, buckets of them at most. Both multinomials are smoothed: alpha is
    added to a bucket's count in the target and to its raw count as scaled to the target's size, so a bucket that is
    hardly ever seen says nothing in either direction.
    """
    import math

    ids = trusted.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct().withColumn("t", F.lit(1))
    ids = F.broadcast(ids) if ids.count() <= most_broadcast else ids
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("__id"), word_hashes(F.filter(F.split(text, f"{BLANK_CLASS}+"), lambda w: w != "")).alias("h"))
    pairs = words.withColumn("p", running(F.col("h"))).select("__id", F.concat("h", F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0)))).alias("g"))
    # outer: a text without words gives a null that is left out after; else Spark would hash all words once more to test for empty arrays
    grams = pairs.join(ids, "__id", "left").select("t", F.explode_outer("g").alias("g")).where("g IS NOT NULL")
    counts = grams.groupBy(F.pmod("g", F.lit(buckets)).alias("g")).agg(F.count("*").alias("raw"), F.count("t").alias("target")).collect()
    all_raw, all_target = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    ratio = [0.0] * buckets
    if all_target:
        for r in counts:
            ratio[r["g"]] = math.log((r["target"] + alpha) / (r["raw"] * all_target / all_raw + alpha))
    return ratio


def gram_score(grams: Column, ratio: list[float]) -> Column:
    """The mean log-likelihood ratio of an array of word and word-pair hashes; 0 if there is none."""
    table = F.split(F.lit(",".join(repr(x) for x in ratio)), ",").cast("array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, F.pmod(g, F.lit(len(ratio))).cast("int")))
    return F.coalesce(F.try_divide(total, F.size(grams)), F.lit(0.0))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns of text_rules(), score (double, mean log-likelihood ratio) and kept (boolean).

    The trusted target are the rows of docs whose id labels marks with quality 1; the raw corpus are all rows, those with a
    null id too. kept is false if base_failed, else score >= threshold: the same for every row, nothing is drawn at random.
    Without any trusted row nothing is known of the target, so score is then 0. Nulls, ties and odd texts: see text_rules().
    """
    ratio = fit_ratio(docs, labels.where("quality = 1").select(F.col("doc_id").alias(id_col)), buckets, id_col=id_col, text_col=text_col)
    out = _steps(docs.drop(*RULES, "score", "kept"), text_col).withColumn("score", gram_score(F.col("__g"), ratio)).drop("__g")
    return out.withColumn("base_failed", F.expr(BASE)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_passing(judged: DataFrame, columns: list[str]) -> DataFrame:
    """columns of the rows of judged, from quality_rules(), that are kept.

    A filter on kept would be pushed below the steps that lead to it, with every step written out again wherever the next
    one names it: the words of a text would be split dozens of times. An exploded array of one or no elements stays above
    them, so each step is worked out once a row.
    """
    one = F.explode(F.when(F.col("kept"), F.array(F.lit(1)))).alias("__one")
    return judged.select(*(F.col(f"`{c}`") for c in columns), one).drop("__one")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op10_quality_rules": op10_quality_rules}
