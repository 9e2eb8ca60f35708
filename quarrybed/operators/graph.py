"""Reachability, object sets, layers and revision checks over id graphs, in loops of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def closure(roots: DataFrame, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(node, depth): all nodes reachable from roots (node) over edges (src, dst), at their least depth.

    A round joins the frontier alone, and takes off what was seen; each round is written, so
    plans don't grow. Rounds follow the longest shortest path.
    """
    frontier = written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = frontier
    for depth in range(1, max_rounds):
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).where("node IS NOT NULL").distinct()
        frontier = written(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = written(seen, "seen")
    raise RuntimeError("the graph is deeper than max_rounds")


def tree_objects(roots: DataFrame, tree_items: DataFrame, include_links: bool = False) -> DataFrame:
    """(oid, kind): trees and blobs below root trees (node). Links and submodules only if asked for."""
    kinds = ["tree", "blob", "executable"] + ["link", "commit"] * include_links
    items = tree_items.where(F.col("kind").isin(*kinds))
    trees = closure(roots, items.where("kind = 'tree'").select(F.col("tree_oid").alias("src"), F.col("oid").alias("dst")))
    leaves = items.where("kind != 'tree'").join(trees, items.tree_oid == trees.node, "left_semi")
    leaves = leaves.select("oid", F.when(F.col("kind") == "commit", "commit").otherwise("blob").alias("kind"))
    return trees.select(F.col("node").alias("oid"), F.lit("tree").alias("kind")).unionByName(leaves.distinct())


def full_set(want: DataFrame, commits: DataFrame, commit_parents: DataFrame, tree_items: DataFrame) -> DataFrame:
    """(oid, kind): every object that wanted commits (node) need."""
    reached = closure(want, commit_parents.select(F.col("oid").alias("src"), F.col("parent").alias("dst")))
    roots = commits.join(reached, commits.oid == reached.node, "left_semi").select(F.col("tree_oid").alias("node"))
    return reached.select(F.col("node").alias("oid"), F.lit("commit").alias("kind")).unionByName(tree_objects(roots, tree_items)).distinct()


def common_commits(have: DataFrame, commits: DataFrame) -> DataFrame:
    """Ids (node) of ``have`` that are commits here."""
    return have.join(commits, have.node == commits.oid, "left_semi")


def incremental_set(want: DataFrame, have: DataFrame, commits: DataFrame, commit_parents: DataFrame, tree_items: DataFrame) -> DataFrame:
    """What ``want`` needs and ``have`` doesn't hold; ids of ``have`` that are unknown here are left out."""
    common = common_commits(have, commits)
    return full_set(want, commits, commit_parents, tree_items).join(full_set(common, commits, commit_parents, tree_items), ["oid", "kind"], "left_anti")


def missing_bases(entries: DataFrame, base: str, known: DataFrame, oid: str = "oid") -> DataFrame:
    """Entries whose base is nowhere; must be empty for a whole pack."""
    return entries.where(F.col(base).isNotNull()).join(known.select(F.col(oid).alias(base)).distinct(), base, "left_anti")


def layers(nodes: DataFrame, deps: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(node, layer): order in which nodes (node) can run, given deps (node, needs); nodes of cycles are left out."""
    left = written(nodes.select("node").distinct(), "nodes")
    done = None
    for k in range(max_rounds):
        open_deps = deps.join(left.select(F.col("node").alias("needs")), "needs", "left_semi")
        ready = written(left.join(open_deps, "node", "left_anti").withColumn("layer", F.lit(k)), "ready")
        if ready.isEmpty():
            return done if done is not None else left.withColumn("layer", F.lit(0)).limit(0)
        done = ready if done is None else done.unionByName(ready)
        left = written(left.join(ready, "node", "left_anti"), "nodes")
        if k % 16 == 15:
            done = written(done, "done")
    raise RuntimeError("more layers than max_rounds")


def ready_tasks(tasks: DataFrame, deps: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks (node), not done, of whose deps (node, needs) none is open."""
    open_deps = deps.join(done.select(F.col("node").alias("needs")), "needs", "left_anti")
    return tasks.join(done, "node", "left_anti").join(open_deps, "node", "left_anti")


def clean_parents(revisions: DataFrame, oid: str = "oid", parents: str = "parents") -> DataFrame:
    """Parents without repeats, nulls or the revision itself, in their order."""
    return revisions.withColumn(parents, F.array_distinct(F.filter(parents, lambda p: p.isNotNull() & (p != F.col(oid)))))


def mixed_parents(revisions: DataFrame, owner: str, oid: str = "oid", parents: str = "parents") -> DataFrame:
    """Revisions with a parent of another owner, which revision chains don't allow: (oid)."""
    edges = revisions.select(F.col(oid).alias("child"), F.col(owner).alias("own"), F.explode(parents).alias("parent"))
    other = revisions.select(F.col(oid).alias("parent"), F.col(owner).alias("theirs"))
    return edges.join(other, "parent").where("own != theirs").select(F.col("child").alias(oid)).distinct()


def heads(revisions: DataFrame, oid: str = "oid", parents: str = "parents") -> DataFrame:
    """Revisions that no other has as a parent."""
    used = revisions.select(F.explode(parents).alias(oid)).distinct()
    return revisions.join(used, oid, "left_anti")
