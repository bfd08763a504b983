"""The usage ledger and job states as streams: windowed sums, sessions, job transitions, and tables kept by merging micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..sources.staged import folder

#: The states of a job and those that may follow each; "" is a job not seen yet.
JOB_STEPS = {"": ("queued",), "queued": ("converting", "failed"), "converting": ("rendering", "failed"), "rendering": ("extracting", "failed"), "extracting": ("building_excel", "failed"), "building_excel": ("done", "failed"), "done": ("queued",), "failed": ("queued",), "interrupted": ("queued",)}
IN_FLIGHT = ("queued", "converting", "rendering", "extracting", "building_excel")


def read_events(spark: SparkSession, folder: str, schema: str, time: str = "ts") -> DataFrame:
    """A file stream whose time column is a timestamp with a zone, as watermarks need it."""
    df = spark.readStream.schema(schema).parquet(folder)
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, time: str, width: str, keys: Sequence[str], amount: Column, late: str = "10 minutes") -> DataFrame:
    """Calls and amount per window and keys; rows later than late are dropped with their window."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("calls"), F.sum(amount).alias("amount")).select(F.col("window.start").alias("window_start"), *keys, "calls", "amount")


def sessions(events: DataFrame, time: str, gap: str, keys: Sequence[str], amount: Column, late: str = "10 minutes") -> DataFrame:
    """Calls and amount per session of a key: rows less than gap apart. Read it in complete mode, as open sessions still merge."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("calls"), F.sum(amount).alias("amount")).select(F.col("session_window.start").alias("session_start"), *keys, "calls", "amount")


def job_states(events: DataFrame, job: str, time: str, event_id: str, status: str, steps: Mapping[str, Sequence[str]] = JOB_STEPS) -> DataFrame:
    """(job, status, taken, refused) after each micro-batch, for the jobs it touched: a job takes a state that may follow its own, and counts what it refuses.

    A job's events are taken in the order of time and id within a micro-batch, and as they arrive across them. The state kept
    for a job is its status and two counts.
    """
    kind = dict(events.dtypes)[job]
    follow = {k: set(v) for k, v in steps.items()}

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, taken, refused = state.get if state.exists else ("", 0, 0)
        for said in pd.concat(list(batches)).sort_values([time, event_id])[status]:
            if said in follow.get(now, ()):
                now, taken = said, taken + 1
            else:
                refused += 1
        state.update((now, taken, refused))
        yield pd.DataFrame({job: [key[0]], "status": [now], "taken": [taken], "refused": [refused]})

    return events.select(job, time, event_id, status).groupBy(job).applyInPandasWithState(walk, f"{job} {kind}, status string, taken long, refused long", "status string, taken long, refused long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Take in what there is and stop: the table that the stream's rows leave if each replaces the one with its keys.

    Each micro-batch is written under its own number, over an earlier try of it, so a batch that runs twice counts once; the last
    number wins for a key. In complete mode a micro-batch is the whole table. Tables and the stream's checkpoint are in the
    folder that driver and executors share.
    """
    spark, base = stream.sparkSession, f"{folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    plain = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # nothing came in
        return spark.createDataFrame([], plain)
    rows = spark.read.schema(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain), "batch long"])).parquet(f"{base}/rows")
    if mode == "complete":
        return rows.join(rows.agg(F.max("batch").alias("batch")), "batch").select(*plain.names)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("__last", last).where("__last = 1").select(*plain.names)


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Take in what is there, write it to a Parquet table folder and stop."""
    stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
