"""Comparing snapshots (path, oid) and keeping a staging table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.diffs import file_diff_udf, line_operations_udf
from ..functions.text import under_any

STAGE_KEY = ("name", "stage")


def changed_paths(old: DataFrame, new: DataFrame, dirs: list[str] | None = None) -> DataFrame:
    """path, old_oid, new_oid, change (add, delete, modify) of paths whose ids differ, under one of the dirs."""
    a, b = old.select("path", F.col("oid").alias("old_oid")), new.select("path", F.col("oid").alias("new_oid"))
    both = a.join(b, "path", "full_outer").where(~F.col("old_oid").eqNullSafe(F.col("new_oid")) & under_any("path", dirs or []))
    kind = F.when(F.col("old_oid").isNull(), "add").when(F.col("new_oid").isNull(), "delete").otherwise("modify")
    return both.select("path", "old_oid", "new_oid", kind.alias("change"))


def diff_snapshots(old: DataFrame, new: DataFrame, objects: DataFrame, dirs: list[str] | None = None) -> DataFrame:
    """path, data: the unified diff of every changed path; contents (oid, data) are joined in for those alone."""
    changed = changed_paths(old, new, dirs)
    needed = changed.select(F.explode(F.array("old_oid", "new_oid")).alias("oid")).where("oid IS NOT NULL").distinct()
    held = objects.select("oid", "data").join(needed, "oid", "left_semi").dropDuplicates(["oid"])
    one, two = held.select(F.col("oid").alias("old_oid"), F.col("data").alias("old")), held.select(F.col("oid").alias("new_oid"), F.col("data").alias("new"))
    joined = changed.join(one, "old_oid", "left").join(two, "new_oid", "left")
    return joined.select("path", file_diff_udf("path", F.col("old").cast("binary"), F.col("new").cast("binary")).alias("data")).where("data != ''")


def line_changes(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, seq, op, old_line, new_line, content: the line operations between two texts of each row."""
    ops = F.posexplode(line_operations_udf(F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))))
    return pairs.select(key, ops.alias("seq", "o")).select(key, "seq", "o.op", "o.old_line", "o.new_line", "o.content")


def line_bag_changes(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, line, delta: lines whose number of occurrences differs, without regard to order. Built-in functions only."""
    side = lambda c, n: pairs.select(key, F.explode(F.split(F.col(c), "\n")).alias("line"), F.lit(n).alias("n"))
    return side(old, -1).unionByName(side(new, 1)).groupBy(key, "line").agg(F.sum("n").alias("delta")).where("delta != 0")


def upsert(table: DataFrame, changes: DataFrame, key: tuple = STAGE_KEY, order: str = "seq") -> DataFrame:
    """The table after changes (its columns, deleted, order): of each key the last change wins, deletions drop it."""
    fields = table.columns
    old = table.withColumn("deleted", F.lit(False)).withColumn(order, F.lit(None).cast(changes.schema[order].dataType))
    both = old.unionByName(changes.select(*fields, "deleted", order))
    last = both.groupBy(*key).agg(F.max_by(F.struct(*fields, "deleted"), F.struct(F.col(order).isNotNull(), order)).alias("l"))
    return last.where("NOT l.deleted").select("l.*").select(*fields)


def tracked(table: DataFrame, paths: DataFrame, stage: int = 0) -> DataFrame:
    """Paths (name) that the staging table has at a stage."""
    return paths.join(table.where(F.col("stage") == stage).select("name"), "name", "left_semi")


def holds_dir(table: DataFrame, folder: str) -> bool:
    """Whether an entry lies strictly below a directory."""
    return not table.where(F.startswith("name", F.lit(folder.rstrip("/") + "/"))).limit(1).isEmpty()


def remove_dir(table: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(the table without a directory's entries, the names removed)."""
    below = F.startswith("name", F.lit(folder.rstrip("/") + "/"))
    return table.where(~below), table.where(below).select("name")


def modified(table: DataFrame, stats: DataFrame) -> DataFrame:
    """name, state of entries against file stats (name, size, mtime_s, mtime_ns, ctime_s, ctime_ns): missing, modified, same."""
    fields = ["ctime_s", "ctime_ns", "mtime_s", "mtime_ns", "size"]
    s = stats.select("name", F.lit(True).alias("here"), *[F.col(c).alias(f"f_{c}") for c in fields if c in stats.columns])
    differs = F.lit(False)
    for c in fields:
        if c in stats.columns:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"f_{c}"))
    return table.join(s, "name", "left").select("name", F.when(F.col("here").isNull(), "missing").when(differs, "modified").otherwise("same").alias("state"))


def file_stats(spark, path: str, root: str = "") -> DataFrame:
    """name, size, mtime_s, mtime_ns of files below a path, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    micros = F.unix_micros("modificationTime")
    return files.select(F.regexp_replace(F.col("path"), F.lit(f"^(file:)?/*{root.strip('/')}/"), F.lit("")).alias("name"), F.col("length").alias("size"), F.floor(micros / 1_000_000).alias("mtime_s"), (F.pmod(micros, F.lit(1_000_000)) * 1000).alias("mtime_ns"))
