"""Current state, indexes and audit chains over append-only event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import latest


def current_state(events: DataFrame, key: str) -> DataFrame:
    """Kind and time of each entity's last event (created_at, then object_id)."""
    return latest(events, key, ["created_at", "object_id"], ["kind", "created_at", "object_id"])


def latest_patch_sets(patch_sets: DataFrame) -> DataFrame:
    """Each run's patch set with the highest sequence."""
    return latest(patch_sets, "run", ["sequence", "object_id"], ["object_id", "sequence"])


def reverse_index(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, values: the distinct values of each key in order. A key's list is as long as its values are many: see reverse_pairs."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n"), F.sort_array(F.collect_set(value)).alias("values"))


def reverse_pairs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (key, value): the reverse index as a table, for keys of any size."""
    return rows.select(key, value).where(F.col(key).isNotNull() & F.col(value).isNotNull()).distinct()


def audit_chain(intents: DataFrame, plans: DataFrame, tasks: DataFrame, runs: DataFrame, patch_sets: DataFrame, evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each path from an intent to what its runs left; missing links are null."""
    i = intents.select(F.col("object_id").alias("intent_id"))
    p = plans.select(F.col("object_id").alias("plan_id"), F.col("intent").alias("intent_id"))
    t = tasks.select(F.col("object_id").alias("task_id"), F.col("intent").alias("intent_id"))
    r = runs.select(F.col("object_id").alias("run_id"), F.col("task").alias("task_id"), F.col("plan").alias("run_plan_id"))
    s = patch_sets.select(F.col("object_id").alias("patchset_id"), F.col("run").alias("run_id"))
    e = evidence.groupBy("run_id").agg(F.count(F.lit(1)).alias("evidence"))
    d = decisions.select("run_id", "decision_type", F.col("chosen_patchset_id").alias("chosen"))
    chain = i.join(t, "intent_id", "left").join(r, "task_id", "left").join(s, "run_id", "left").join(e, "run_id", "left").join(d, "run_id", "left")
    known = p.select(F.col("plan_id").alias("run_plan_id"), F.lit(True).alias("plan_known"))
    return chain.join(known, "run_plan_id", "left").withColumn("plan_known", F.coalesce("plan_known", F.lit(False)))


def broken_links(tables: dict[str, DataFrame], keys=None) -> DataFrame:
    """child, column, missing: how many references of each edge lead nowhere. Of an array, each element is a reference."""
    from ..schemas import FOREIGN_KEYS

    def ids(df: DataFrame, column: str) -> DataFrame:
        head, _, rest = column.partition(".")
        out = df.select(F.col(head).alias("object_id"))
        if isinstance(out.schema[0].dataType, T.ArrayType):
            out = out.select(F.explode("object_id").alias("object_id"))
        return out.select(F.col(f"object_id.{rest}").alias("object_id")) if rest else out

    out = None
    for child, column, parent in keys or FOREIGN_KEYS:
        name, _, target = parent.partition(".")
        if child not in tables or name not in tables:
            continue
        refs = ids(tables[child], column).where("object_id IS NOT NULL")
        lost = refs.join(ids(tables[name], target or "object_id"), "object_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
        row = lost.select(F.lit(child).alias("child"), F.lit(column).alias("column"), "missing")
        out = row if out is None else out.unionByName(row)
    return out
