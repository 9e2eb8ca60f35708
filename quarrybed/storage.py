"""Tables that cut lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list = []
#: Bytes of an Arrow batch of texts or packs: Python holds a batch several times over, as buffers and as objects.
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the bytes of an Arrow batch in the session that runs it; a longer row is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > most:
        spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and all runs in one process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarrybed-"))
    return sc.getCheckpointDir().rstrip("/")


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as Python opens it, if it is on a file system that driver and executors mount; None in other stores."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove_made)
    _MADE.append((spark, path))
    return path


def _remove_made() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):  # the session may have ended
            sc = spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: a lost executor costs no more than the part since."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
