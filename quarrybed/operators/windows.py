"""Ordered operators: pack order, running totals at scale, delta candidates, latest and best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_key, parent_dir, path_name_hash


def pack_order(objects: DataFrame) -> DataFrame:
    """Sort keys k0, k1 ... that put alike objects side by side.

    By type; objects with a path first, by directory, then by falling name hash; those
    without by their first bytes; larger ones first; ids break ties.
    """
    has = F.col("file_path").isNotNull() & (F.col("file_path") != "")
    keys = [
        F.col("obj_type"), F.when(has, 0).otherwise(1),
        F.when(has, parent_dir("file_path")).otherwise(content_key("data")),
        F.when(has, -path_name_hash("file_path")).otherwise(F.lit(0).cast("long")),
        -F.octet_length("data").cast("long"), F.col("oid"),
    ]
    return objects.select("*", *[k.alias(f"k{i}") for i, k in enumerate(keys)])


def running_total(df: DataFrame, order: list[str], value: Column, name: str, start: int = 0, parts: int | None = None) -> DataFrame:
    """Running total over a global order, without one task holding all rows.

    Rows are dealt by ranges of the order; each range sums within itself, and the totals of
    the ranges before it are added: one row a range. ``name`` is the total up to the row
    (exclusive), plus ``start``. The order must be unique.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_v", value.cast("long")).repartitionByRange(n, *order).withColumn("_r", F.spark_partition_id())
    # range bounds come from a sample: fix each row's range by writing it
    from ..storage import written

    dealt = written(dealt, "ranges")
    inner = Window.partitionBy("_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_l", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    totals = dealt.groupBy("_r").agg(F.sum("_v").alias("_t"))
    before = totals.select(F.col("_r").alias("_q"), F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    out = local.join(F.broadcast(before), local._r == before._q)  # one row a range
    return out.withColumn(name, F.lit(start) + F.col("_b") + F.col("_l")).drop("_v", "_r", "_l", "_q", "_b")


def ranked(df: DataFrame, order: list[str], name: str = "rn", parts: int | None = None) -> DataFrame:
    """Global row numbers from 1 over a unique order."""
    return running_total(df, order, F.lit(1), name, 1, parts)


def delta_candidates(rows: DataFrame, partition: str, window: int = 10, rn: str = "rn", key: str = "oid") -> DataFrame:
    """Pairs of a row and each of the ``window`` rows of its kind before it: key, base, distance.

    An equi-join on the kind and the block of ``window`` row numbers, the base's own block
    and the one after: no range join, no window over a whole kind.
    """
    block = F.floor((F.col(rn) - 1) / window)
    left = rows.select(partition, F.col(key).alias("target"), F.col(rn).alias("t_rn"), block.alias("block"))
    both = F.explode(F.array(block, block + 1))
    right = rows.select(partition, F.col(key).alias("base"), F.col(rn).alias("b_rn"), both.alias("block"))
    near = left.join(right, [partition, "block"]).where((F.col("b_rn") < F.col("t_rn")) & (F.col("b_rn") >= F.col("t_rn") - window))
    return near.select(partition, "target", "base", (F.col("t_rn") - F.col("b_rn")).alias("distance"))


def best_by(pairs: DataFrame, key: str, pick: str, score: Column, most: bool = False) -> DataFrame:
    """The best-scored row of each key; ties to the least ``pick``. Partial aggregation, no sort."""
    order = F.struct((-score if most else score).alias("s"), F.col(pick).alias("p"))
    return pairs.groupBy(key).agg(F.min(order).alias("_b")).select(key, F.col("_b.p").alias(pick), (-F.col("_b.s") if most else F.col("_b.s")).alias("score"))


def latest(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The fields of each key's last row by ``order``: an aggregate, so hot keys are combined map-side."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_l")).select(key, "_l.*")


def cull_buckets(rows: DataFrame, key: str, order: str, most: int = 64) -> DataFrame:
    """Rows of overfull keys thinned to ``most`` evenly spaced ones, the first among them.

    Rows are numbered over ranges of (key, order), so a key with most of the rows is many tasks.
    """
    numbered = running_total(rows, [key, order], F.lit(1), "_at")
    keys = numbered.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    numbered = numbered.join(keys, numbered[key].eqNullSafe(keys["_key"])).withColumn("_i", F.col("_at") - F.col("_first"))
    # row i is kept if it is floor(k * n / most) for some k
    k = F.ceil(F.col("_i") * most / F.col("_n"))
    kept = (F.col("_n") <= most) | ((k < most) & (F.floor(k * F.col("_n") / most) == F.col("_i")))
    return numbered.where(kept).select(*rows.columns)


def context_budget(frames: DataFrame, key: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """The newest frames of each key whose tokens, added up from the newest, fit the budget."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("used", F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(w)).where(F.col("used") <= budget)
