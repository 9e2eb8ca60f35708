"""Aggregations over objects, packs and usage records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fan_out(ids: DataFrame, oid: str = "oid") -> DataFrame:
    """256 rows: ids by first byte (n) and the running total. The window sees 256 rows, whatever the input."""
    counts = ids.groupBy(F.conv(F.substring(oid, 1, 2), 16, 10).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    slots = ids.sparkSession.range(0, 256, 1, 1).select(F.col("id").cast("int").alias("slot"))
    full = slots.join(counts, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return full.withColumn("total", F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))


def pack_stats(entries: DataFrame, code: str = "type_bits") -> DataFrame:
    """Counts of a pack's entries by type: commits, trees, blobs, tags, deltas, total."""
    n = lambda *codes: F.count_if(F.col(code).isin(*codes))
    return entries.agg(n(1).alias("commits"), n(2).alias("trees"), n(3).alias("blobs"), n(4).alias("tags"), n(5, 6, 7).alias("deltas"), F.count(F.lit(1)).alias("total"))


def distinct_objects(*sources: DataFrame) -> DataFrame:
    """Union of sources, one row an id; contents of equal ids are equal."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.dropDuplicates(["oid"])


def fingerprint(ids: DataFrame, oid: str = "oid") -> DataFrame:
    """Order-independent fingerprint of a multiset of ids: count, five 32-bit lanes by exclusive or, and the
    sum of the first 128 bits in 32-bit pieces (sum0 the highest), which repeats change too."""
    lane = lambda k: F.conv(F.substring(oid, 8 * k + 1, 8), 16, 10).cast("long")
    return ids.agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(lane(k)).alias(f"lane{k}") for k in range(5)], *[F.sum(lane(k)).alias(f"sum{k}") for k in range(4)])


def compression_totals(objects: DataFrame, raw: str, stored: str, by: str | None = None) -> DataFrame:
    """Objects, raw bytes, stored bytes and stored per mille of raw."""
    grouped = objects.groupBy(by) if by else objects.groupBy()
    out = grouped.agg(F.count(F.lit(1)).alias("objects"), F.sum(raw).cast("long").alias("raw_bytes"), F.sum(stored).cast("long").alias("stored_bytes"))
    return out.withColumn("per_mille", F.when(F.col("raw_bytes") > 0, F.floor(F.col("stored_bytes") * 1000 / F.col("raw_bytes"))))


def dependency_counts(entries: DataFrame, base: str, *within: str) -> DataFrame:
    """Entries that build on each base (of each pack, if ``within`` names its column)."""
    return entries.where(F.col(base).isNotNull()).groupBy(*within, base).agg(F.count(F.lit(1)).alias("users"))


def releasable(bases: DataFrame, key: str, users: DataFrame, done: DataFrame, base: str) -> DataFrame:
    """Bases whose users are all done: (key)."""
    need = users.groupBy(F.col(base).alias(key)).agg(F.count(F.lit(1)).alias("need"))
    have = done.groupBy(F.col(base).alias(key)).agg(F.count(F.lit(1)).alias("have"))
    left = bases.select(key).distinct().join(need, key, "left").join(have, key, "left")
    return left.where(F.coalesce("need", F.lit(0)) <= F.coalesce("have", F.lit(0))).select(key)


def usage_totals(usage: DataFrame, key: str = "run_id") -> DataFrame:
    """Tokens and cost of each run; ``consistent`` where every record's total is the sum of its parts."""
    ok = F.col("total_tokens") == F.col("input_tokens") + F.col("output_tokens")
    return usage.groupBy(key).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"), F.bool_and(ok).alias("consistent"))


def touched_totals(patches: DataFrame, key: str = "run") -> DataFrame:
    """Lines added and deleted over the touched files of patch sets."""
    t = patches.select(key, F.explode("touched").alias("t"))
    return t.groupBy(key).agg(F.countDistinct("t.path").alias("files"), F.sum("t.lines_added").alias("added"), F.sum("t.lines_deleted").alias("deleted"))


def files_by_dir(paths: DataFrame, path: str = "path") -> DataFrame:
    """Files below every directory, itself and nested ones."""
    parts = F.split(path, "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    deep = F.when(F.size(parts) > 1, dirs).otherwise(F.array().cast("array<string>"))
    return paths.select(F.explode(deep).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
