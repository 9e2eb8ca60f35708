"""Chat formatting: collapse cumulative snapshots of conversations, then render. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, partitions, written

#: Turns of a conversation rendered in one row.
BLOCK = 1024
ORDER = ["turn", "role", "sha", "tie"]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Turns with pos (from 1), n (turns of the conversation) and the rolling hash pair px, py; a written table.

    The order is turn, role, SHA-256 of the text. All turns are dealt by ranges of conversation
    and order; counts and hashes are accumulated in a range, then over the few ranges that a
    conversation spans, so no task needs a whole long conversation, or all turns of one
    number. The rolling hash is the exclusive or of two 64-bit hashes of (pos, role, text)
    each: 128 bits that depend on the order.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("tie", F.monotonically_increasing_id())
    t = t.repartitionByRange(partitions(turns.sparkSession), "conv_id", *ORDER).withColumn("range", F.spark_partition_id())
    t = written(t, "turns")  # once: the ranges come from a sample
    same = lambda a, b: a.conv_id.eqNullSafe(b.c) & (a.range == b.r)
    by_range = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sizes = t.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("size").over(by_range), zero).alias("before"), F.sum("size").over(Window.partitionBy("conv_id")).alias("n"))
    local = t.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*ORDER)))
    placed = local.join(sizes, same(local, sizes)).withColumn("pos", F.col("before") + F.col("i"))
    placed = placed.select("conv_id", "range", "turn", "role", "text", "pos", "n", F.xxhash64("pos", "role", "text").alias("hx"), F.xxhash64(F.lit("second"), "text", "pos", "role").alias("hy"))
    run = Window.partitionBy("conv_id", "range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = written(placed.withColumn("lx", F.bit_xor("hx").over(run)).withColumn("ly", F.bit_xor("hy").over(run)), "placed")
    totals = inner.groupBy("conv_id", "range").agg(F.bit_xor("hx").alias("tx"), F.bit_xor("hy").alias("ty"))
    totals = totals.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.bit_xor("tx").over(by_range), zero).alias("bx"), F.coalesce(F.bit_xor("ty").over(by_range), zero).alias("by"))
    out = inner.join(totals, same(inner, totals))
    return written(out.select("conv_id", "turn", "role", "text", "pos", "n", F.col("lx").bitwiseXOR(F.col("bx")).alias("px"), F.col("ly").bitwiseXOR(F.col("by")).alias("py")), "hashed")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(conv_id, n) of the conversations that are no prefix of a longer one; of equal ones the smallest conv_id."""
    whole = hashed.where("pos = n").select("conv_id", "n", "px", "py")
    strict = hashed.where("pos < n").select(F.col("pos").alias("n"), "px", "py").distinct()
    heads = whole.groupBy("n", "px", "py").agg(F.min("conv_id").alias("conv_id"))
    return heads.join(strict, ["n", "px", "py"], "left_anti").select("conv_id", "n")


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of rendered conversations: conv_id, part, n_turns, text.

    Conversations whose turns (role and text in order) begin a longer one are dropped, as are
    repeats but for the smallest conv_id. Each turn is ``<|role|>`` and its text on lines of
    their own, ended by ``<|end|>``. A row holds ``block`` turns: part p has turns
    p * block + 1 and on, and the parts end to end are the conversation, whatever its length.
    A null role or text counts as empty; turns with a null number come first, turns with one number and role
    in the order of their texts' SHA-256; rows with a null conv_id form one conversation, which
    loses to any other with the same turns. Repeated rows are turns that repeat. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    hashed = prefix_hashes(turns)
    name, none = F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull()
    kept = written(maximal_conversations(hashed).select(name.alias("c"), none.alias("cn"), F.col("n").alias("rows")), "maximal")
    live = hot_join(hashed.withColumn("k", name).withColumn("kn", none), kept, [("k", "c"), ("kn", "cn")], "rows", hashed.count())
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    parts = live.groupBy("conv_id", F.floor((F.col("pos") - 1) / block).alias("part"))
    out = parts.agg(F.max("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return out.select("conv_id", "part", "n_turns", F.array_join("lines.line", "").alias("text"))
