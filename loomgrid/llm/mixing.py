"""Mixing sources to target weights: budgets pass down a tree of domains, languages and sources, then each leaf gives a prefix of its seeded order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK_CLASS, materialize, scoped

LEVELS = ("domain", "lang", "source")
SEED, BUCKET_HEX = 7, 3
#: Shares are stated in parts of this; the query's and the pipeline's stated shares of the sample tables' domains.
WHOLE = 1000
TARGET = {("domain0",): 300, ("domain1",): 100}


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANK_CLASS}+"), lambda w: w != "")).cast("long")


def domain_of(source: Column) -> Column:
    """The domain that a source belongs to in the sample tables: the last digit of its name, by twos."""
    return F.concat(F.lit("domain"), F.coalesce(F.floor(F.right(source, F.lit(1)).try_cast("int") / 2).cast("string"), F.lit("-")))


def with_weights(nodes: DataFrame, path: Sequence[str], parent: Sequence[str], weights: Mapping[tuple, int]) -> DataFrame:
    """nodes (path..., tokens) with weight, a whole number: what a node counts among its siblings.

    weights gives nodes by path their share in thousandths of what the parent gives; the siblings that it doesn't name
    have the rest among them by the square roots of their tokens. So a stated share is the same at every size of the table.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    share = F.lit(None).cast("long")
    for key, thousandths in weights.items():
        if len(key) == len(path):
            same = F.lit(True)
            for c, v in zip(path, key, strict=True):
                same = same & (F.col(c) == v)
            share = F.when(same, F.lit(int(thousandths)).cast("long")).otherwise(share)
    out = nodes.withColumns({"share": share, "root": F.greatest(F.floor(F.sqrt(F.col("tokens").cast("double"))).cast("long"), F.lit(1))})
    roots = F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("root"))).over(w), F.lit(1))
    rest = F.greatest(F.lit(WHOLE) - F.coalesce(F.sum("share").over(w), F.lit(0)), F.lit(1))
    return out.withColumn("weight", F.when(F.col("share").isNotNull(), F.col("share") * roots).otherwise(rest * F.col("root"))).drop("share", "root")


def share_out(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """children (parent..., cap, weight, parent_budget) with budget: the parent's budget by weight, none over its cap.

    What a child can't take goes to its siblings by their weights; only what all of them can't take is missing above.
    In the order of cap / weight a child is full if its cap is at most its share of what is left; whole-number arithmetic.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), "node")
    wide = lambda c: c.cast("decimal(19,0)")
    out = children.withColumns({"caps_before": F.sum("cap").over(order) - F.col("cap"), "weights_from": F.sum("weight").over(w) - F.sum("weight").over(order) + F.col("weight")})
    out = out.withColumn("full", wide(F.col("cap")) * wide(F.col("weights_from")) <= wide(F.col("weight")) * wide(F.greatest(F.col("parent_budget") - F.col("caps_before"), F.lit(0))))
    out = out.withColumns({"full_caps": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(w), "free_weight": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(w)})
    out = out.withColumn("left", wide(F.greatest(F.col("parent_budget") - F.col("full_caps"), F.lit(0))) * wide(F.col("weight")))
    return out.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.expr("left div free_weight")))).drop("caps_before", "weights_from", "full", "full_caps", "free_weight", "left")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], total: int, max_epochs: int, weights: Mapping[tuple, int] | None = None) -> DataFrame:
    """leaves (levels..., tokens) with budget: total passed down from the root, level by level."""
    budget = None
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = leaves.groupBy(*path).agg(F.sum("tokens").alias("tokens"))
        nodes = with_weights(nodes.withColumns({"cap": F.col("tokens") * max_epochs, "node": F.col(path[-1])}), path, parent, weights or {})
        nodes = nodes.withColumn("parent_budget", F.lit(int(total)).cast("long")) if budget is None else nodes.join(budget.withColumnRenamed("budget", "parent_budget"), parent)
        budget = share_out(nodes, parent).select(*path, "budget")
    return leaves.join(budget, list(levels))


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


@scoped
def mix_sources(docs: DataFrame, total_share: float = 1.0, max_epochs: int = 4, weights: Mapping[tuple, int] | None = None, levels: Sequence[str] = LEVELS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the mixture takes, with n_tokens and copies (long, 1 or more): how many epochs hold the row.

    weights: the stated shares, see with_weights(). The total is total_share of all tokens (words); a leaf can give max_epochs times its own. It gives whole epochs and,
    of the next one, the longest prefix of that epoch's seeded order whose tokens fit. Nulls in the level columns count as
    an empty name, a null text has no tokens, rows with an equal or null id stand at one place of the order and go
    together. Columns of docs named n_tokens or copies are replaced. A very long text is one row with many tokens, taken
    if it still fits. An empty table gives an empty one.

    The text is read to count words; what is shuffled is ids, leaf names and counts. The prefix's end is found from the
    token sums of 4096 slices of a leaf's order, then inside one slice, so no task holds a leaf. Each leaf's end is one
    row, joined to the documents by leaf, as a broadcast if the planner finds the leaves few.
    """
    docs = docs.drop("n_tokens", "copies")
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels}
    base = docs.select(F.col(id_col).alias("__id"), *(named[c].alias(c) for c in levels), word_count(F.col(text_col)).alias("n"))
    narrow = materialize(base)
    leaves = narrow.groupBy(*levels).agg(F.sum("n").alias("tokens"))
    all_tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, levels, int(all_tokens * total_share), max_epochs, weights)
    plan = plan.withColumns({"whole": F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END"), "rest": F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END")})
    plan = materialize(plan.select(*levels, "tokens", "whole", "rest"))
    keyed = narrow.join(plan.where("rest > 0").select(*levels, "whole", "rest"), list(levels)).withColumn("key", order_key(F.col("__id"), F.col("whole"), seed)).withColumn("slice", F.substring("key", 1, BUCKET_HEX))
    sums = keyed.groupBy(*levels, "slice", "rest").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*levels).orderBy("slice"))
    edge = materialize(sums.withColumn("upto", upto).where("upto > rest AND upto - n <= rest").select(*levels, "slice", (F.col("upto") - F.col("n")).alias("before")))
    inside = keyed.join(edge, [*levels, "slice"]).withColumn("run", F.col("before") + F.sum("n").over(Window.partitionBy(*levels, "slice").orderBy("key")))
    last = inside.groupBy(*levels).agg(F.max(F.when(F.col("run") <= F.col("rest"), F.col("key"))).alias("last"), F.min("slice").alias("slice"))
    ends = materialize(plan.join(last, list(levels), "left").select(*(F.col(c).alias(f"__{c}") for c in levels), "whole", F.when(F.col("rest") > 0, F.coalesce("last", "slice", F.lit(""))).otherwise("").alias("__end")))
    on = [named[c] == F.col(f"__{c}") for c in levels]
    found = docs.join(ends, on)
    copies = F.col("whole") + (order_key(F.col(id_col), F.col("whole"), seed) <= F.col("__end")).cast("long")
    return found.select(*docs.columns, word_count(F.col(text_col)).alias("n_tokens"), copies.alias("copies")).where("copies > 0")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("domain", domain_of(F.col("source")))
    return mix_sources(docs, weights=TARGET).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _level_sql(depth: int) -> str:
    path, parent = LEVELS[:depth], LEVELS[: depth - 1]
    root = "greatest(CAST(floor(sqrt(CAST(sum(tokens) AS DOUBLE))) AS HUGEINT), 1)"
    share = f"CASE domain {' '.join(f"WHEN '{d}' THEN {n}" for (d,), n in TARGET.items())} END" if depth == 1 else "CAST(NULL AS INTEGER)"
    over = f"PARTITION BY {', '.join(parent)}" if parent else "PARTITION BY 0"
    source = "(SELECT CAST(sum(tokens) AS BIGINT) AS budget FROM leaves)" if depth == 1 else f"b{depth - 1}"
    join = f"CROSS JOIN {source} p" if depth == 1 else f"JOIN {source} p USING ({', '.join(parent)})"
    return f"""
    m{depth} AS (SELECT {', '.join(path)}, CAST(sum(tokens) AS HUGEINT) * 4 AS cap, {root} AS root, {share} AS share FROM leaves GROUP BY {', '.join(path)}),
    n{depth} AS (SELECT *, CASE WHEN share IS NOT NULL THEN share * coalesce(sum(root) FILTER (share IS NULL) OVER w, 1)
      ELSE root * greatest({WHOLE} - coalesce(sum(share) OVER w, 0), 1) END AS weight FROM m{depth} WINDOW w AS ({over})),
    o{depth} AS (SELECT n.* EXCLUDE (root, share), CAST(p.budget AS HUGEINT) AS pb,
      sum(cap) OVER (w ORDER BY CAST(cap AS DOUBLE) / weight, {path[-1]} ROWS UNBOUNDED PRECEDING) - cap AS caps_before,
      sum(weight) OVER (w) - sum(weight) OVER (w ORDER BY CAST(cap AS DOUBLE) / weight, {path[-1]} ROWS UNBOUNDED PRECEDING) + weight AS weights_from
      FROM n{depth} n {join} WINDOW w AS ({over})),
    f{depth} AS (SELECT *, cap * weights_from <= weight * greatest(pb - caps_before, 0) AS is_full FROM o{depth}),
    g{depth} AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER w AS full_caps, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER w AS free_weight FROM f{depth} WINDOW w AS ({over})),
    b{depth} AS (SELECT {', '.join(path)}, CAST(CASE WHEN is_full THEN cap ELSE least(cap, (greatest(pb - full_caps, 0) * weight) // free_weight) END AS BIGINT) AS budget FROM g{depth})"""


ORACLE_SQL = {
    "op7_mixing": f"""
    WITH d AS (SELECT doc_id, 'domain' || coalesce(CAST(TRY_CAST(right(source, 1) AS INTEGER) // 2 AS VARCHAR), '-') AS domain, lang, source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
    {','.join(_level_sql(k) for k in (1, 2, 3))},
    p AS (SELECT domain, lang, source, CAST(budget // CAST(tokens AS BIGINT) AS BIGINT) AS whole, budget % CAST(tokens AS BIGINT) AS rest FROM b3 JOIN leaves USING (domain, lang, source)),
    r AS (SELECT d.*, whole, rest, md5('{SEED}-' || whole || '-' || doc_id) AS key FROM d JOIN p USING (domain, lang, source)),
    s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) <= rest AS taken FROM r)
    SELECT doc_id, domain, lang, source, n_tokens, whole + CASE WHEN taken THEN 1 ELSE 0 END AS copies FROM s WHERE whole + CASE WHEN taken THEN 1 ELSE 0 END > 0"""
}
QUERIES = {"op7_mixing": op7_mixing}
