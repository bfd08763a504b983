"""Intermediate tables of iterative operators, written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; only where driver and executors are one process a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else _own.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="loomgrid-")
    return base.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: a plan that is cut here, rows that outlive a lost executor. It stays until the session ends or drop()."""
    path = f"{folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parsed_once(df: DataFrame, text: Column, parse: Callable[[Column], Column], name: str) -> DataFrame:
    """df with parse(text) as column name, worked out once for each different text, a null one too."""
    said = df.withColumn("__text", text)
    each = staged(said.select("__text").distinct().select(F.col("__text").alias("__said"), parse(F.col("__text")).alias(name)))
    return said.join(each, F.col("__text").eqNullSafe(F.col("__said"))).drop("__text", "__said")


def drop(df: DataFrame) -> None:
    """Remove the files of a staged table that no later plan reads."""
    names = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    for spark, path in [x for x in _written if x[1].rpartition("/")[2] in names]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove((spark, path))


@atexit.register
def _cleanup() -> None:
    for spark, path in list(_written):
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is already gone
            return
