"""Shared helpers: written intermediate tables, and deterministic column checks."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space [\x20\x09-\x0D] of the text contracts.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of whole texts that go to Python at once: a batch takes its room on both sides.
TEXT_ROWS, BATCH_ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Folders written and not yet removed; the folder set by us, by application, where none was configured.
_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Only where neither is set and driver and executors are one process (tests, a notebook) a temporary one is made. On a
    cluster without a shared folder this raises: tables in a local folder would be lost with their executor.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(sc.applicationId)
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own[sc.applicationId] = tempfile.mkdtemp(prefix="loomgrid-")
    return base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a plan that is cut here, and rows that outlive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within this hands texts to Python TEXT_ROWS at a time, or fewer where the session says so."""
    old = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(old), TEXT_ROWS) if int(old) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, old)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table that materialize() wrote and that no later plan reads."""
    names = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    _remove([x for x in _written if x[1].rpartition("/")[2] in names])


def scoped(operator: Callable) -> Callable:
    """An operator that, once its result is planned, removes the tables it wrote on the way and that the result doesn't read; all of them if it fails.

    What the result reads stays until the session ends, as nobody can say when the last reader is done.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs):
        before = len(_written)
        try:
            out = operator(*args, **kwargs)
        except BaseException:
            _remove(_written[before:])
            raise
        read = {f.rpartition("/")[0].rpartition("/")[2] for x in (out if isinstance(out, tuple) else (out,)) for f in x.inputFiles()} if len(_written) > before else set()
        _remove([x for x in _written[before:] if x[1].rpartition("/")[2] not in read])
        return out

    return run


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove((spark, path))


@atexit.register
def _cleanup() -> None:
    for table in list(_written):
        try:
            if not table[0].sparkContext._jsc.sc().isStopped():
                _remove([table])
        except Exception:  # the session is already gone
            return


def lower_ascii(text):
    """A-Z in lower case, all other letters as they are."""
    return F.translate(text, UPPER, LOWER)
