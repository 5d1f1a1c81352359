"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000  # of whole texts that a Python worker gets at a time
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_OWN: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder on one machine (``local[...]``, as in tests) and an error on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        own = tempfile.mkdtemp(prefix="taleweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN.append("file://" + own)
    return _OWN[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get whole texts ``BATCH_ROWS`` at a time in jobs run inside."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` once all that reads them has been written itself."""
    for df in frames:
        drop_path(df.sparkSession, df._scratch_path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _MADE:
        _MADE.remove(path)


@contextmanager
def dropping(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the tables made inside, but for those of the frames put into the list that it gives."""
    kept: list[DataFrame] = []
    first = len(_MADE)
    yield kept
    stay = {df._scratch_path for df in kept}
    for path in _MADE[first:]:
        if path not in stay:
            drop_path(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this session; for a long session, once results that read them have been written elsewhere."""
    for path in list(_MADE):
        drop_path(spark, path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's JVM collects them, which on an idle driver may
    be long after; between steps that each move the whole corpus that is a lot of disk.
    """
    spark.range(1).count()  # the last query is known until another ends
    gc.collect()
    spark.sparkContext._jvm.System.gc()
