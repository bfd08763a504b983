"""Snapshots and logs: upserts, row differences, guarded reverts and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if: dict[str, Column] | None = None) -> DataFrame:
    """The next snapshot: new rows win; a column in keep_if keeps its old value where the condition (over new columns named n_...) holds."""
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns)).withColumn("__new", F.lit(True))
    out = []
    for c in old.columns:
        take = F.col("__new").isNotNull()
        if keep_if and c in keep_if:
            take = take & ~(F.col(key).isNotNull() & keep_if[c])
        out.append(F.when(take, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
    return old.join(n, F.col(key) == F.col(f"n_{key}"), "full_outer").select(*out)


def row_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, old, new, change): a row per changed field, and one with field * per added or removed row."""
    a = old.select(F.col(key).alias("__a"), F.struct(*fields).alias("x"))
    b = new.select(F.col(key).alias("__b"), F.struct(*fields).alias("y"))
    text = lambda s, f: F.col(f"{s}.{f}").cast("string")
    changes = F.array(*(F.when(~text("x", f).eqNullSafe(text("y", f)), F.struct(F.lit(f).alias("field"), text("x", f).alias("old"), text("y", f).alias("new"), F.lit("update").alias("change"))) for f in fields))
    whole = lambda kind: F.array(F.struct(F.lit("*").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), F.lit(kind).alias("change")))
    joined = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    listed = F.when(F.col("__b").isNull(), whole("remove")).when(F.col("__a").isNull(), whole("add")).otherwise(F.array_compact(changes))
    return joined.select(F.coalesce("__a", "__b").alias(key), F.explode(listed).alias("d")).select(key, "d.*")


def revertible(changes: DataFrame, target: Sequence[str], order: Sequence[str]) -> DataFrame:
    """changes with can_revert: false if a later change touches the same target."""
    return changes.withColumn("can_revert", F.lead(F.lit(1)).over(Window.partitionBy(*target).orderBy(*order)).isNull())


def ledger_totals(calls: DataFrame, keys: Sequence[str], amount: Column, priced: Column, source: str) -> DataFrame:
    """Per key the calls, the amount over priced calls only, their number, and the distinct sources in order."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(F.when(priced, amount).otherwise(0)).alias("amount"), F.count_if(priced).alias("priced"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))


def latest_total(calls: DataFrame, n: int, order: Sequence[Column], amount: Column) -> DataFrame:
    """Totals of the latest n rows only: the limit comes before the sum, as the ledger's page shows it."""
    return calls.orderBy(*order).limit(n).agg(F.count("*").alias("calls"), F.sum(amount).alias("amount"))


def mark_interrupted(jobs: DataFrame, status: str, running: Sequence[str]) -> DataFrame:
    """jobs with those that a restart found running marked as interrupted."""
    return jobs.withColumn(status, F.when(F.col(status).isin(*running), "interrupted").otherwise(F.col(status)))
