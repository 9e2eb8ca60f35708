"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, shared_folder
from ..storage import written as _written

__all__ = ["fresh_path", "hot_join", "partitions", "shared_folder", "sample_share", "slices", "small_batches", "text_or_empty", "utf8_buffers", "written"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives executors.

    The shuffle files behind it go as soon as it is written.
    """
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return _written(df, name)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without making Python strings; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    buffers = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if buffers[2] is None else np.frombuffer(buffers[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """Ranges of rows whose bytes sum to about the limit; a row over the limit stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts stays in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def sample_share(hashed, counted: DataFrame, rows: int):
    """Condition that lets about twice ``rows`` rows pass, chosen by a 64-bit hash; all where the table is small.

    A top-k over what passes sends the driver so many rows in all, whatever the number of tasks.
    """
    n = counted.count()
    if n <= 2 * rows:
        return F.lit(True)
    cells = 1 << 40
    return F.pmod(hashed, F.lit(cells)) < int(cells * 2 * rows / n)


def hot_join(rows: DataFrame, table: DataFrame, keys: list[tuple[str, str]], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table on (row column, table column) pairs, hot keys apart; no column may be in both.

    ``count`` says how many rows have a table row's key, ``total`` how many there are. Keys
    with over total / (4 x partitions) rows are at most 4 x partitions, so those rows of the
    table are broadcast. All else meets by shuffle, where no key has more rows than that;
    rows that have met are dealt evenly there.
    """
    limit = max(1000, total // (4 * partitions(rows.sparkSession)))
    hot, cold = table.where(F.col(count) > limit), table.where(F.col(count) <= limit)
    on = lambda left, right: reduce(and_, [left[a] == right[b] for a, b in keys])
    if hot.isEmpty():
        return rows.join(table, on(rows, table), how)
    names = table.columns
    met = rows.join(F.broadcast(hot.select(F.struct(*names).alias("hot_"), *[F.col(b).alias(f"on{i}_") for i, (_, b) in enumerate(keys)])), reduce(and_, [F.col(a) == F.col(f"on{i}_") for i, (a, _) in enumerate(keys)]), "left").drop(*[f"on{i}_" for i in range(len(keys))])
    met = met.withColumn("salt_", F.when(F.col("hot_").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")))
    cold = cold.select(F.struct(*names).alias("cold_"), *[F.col(b).alias(f"on{i}_") for i, (_, b) in enumerate(keys)], F.lit(0).cast("long").alias("none_"))
    found = met.join(cold, reduce(and_, [F.col(a) == F.col(f"on{i}_") for i, (a, _) in enumerate(keys)], F.col("salt_") == F.col("none_")), "left")
    both = F.coalesce("hot_", "cold_")
    if how == "inner":
        found = found.where(both.isNotNull())
    return found.select(*rows.columns, *[both[c].alias(c) for c in names])
