"""Snapshot life cycle as pure functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import closure
from loomgraph.operators.scope import first_of, unique
from loomgraph.operators.tables import checkpointed


def copy_snapshot(facts: DataFrame, source: int, target: int) -> DataFrame:
    """A snapshot's facts under another snapshot; ids stay, as identity is (snapshot, id)."""
    return facts.filter(F.col("snapshot_id") == source).withColumn("snapshot_id", F.lit(target).cast("long"))


def rebind(references: DataFrame, declared: DataFrame, selected: DataFrame) -> DataFrame:
    """references (id, identity) with the one declaration (identity, snapshot_id, target) of that identity in the selected snapshots, or null."""
    held = declared.join(selected, "snapshot_id", "left_semi")
    return references.join(unique(held, ["identity"], "target", "target"), "identity", "left")


def retained(snapshots: DataFrame, keep: int) -> DataFrame:
    """The newest generations of each workspace and repository; unknown times are the oldest."""
    order = Window.partitionBy("workspace_id", "repo_name").orderBy(F.col("generation").desc_nulls_last(), F.col("finished_at").desc_nulls_last(), F.col("id").desc())
    return snapshots.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep).drop("rn")


def prunable(snapshots: DataFrame, keep: int) -> DataFrame:
    """Snapshots that neither count nor reference keeps: what a kept one depends on, directly or not, stays."""
    kept = retained(snapshots, keep).select(F.col("id").alias("node"))
    edges = snapshots.filter(F.col("depends_on").isNotNull()).select(F.col("id").alias("src"), F.col("depends_on").alias("dst"))
    needed = closure(edges, kept)
    return snapshots.join(needed.select(F.col("node").alias("id")), "id", "left_anti")


class Busy(RuntimeError):
    """A workspace is being indexed; pruning has to wait."""


def prune(snapshots: DataFrame, selected: DataFrame, keep: int, before: Column, busy: DataFrame | None = None) -> DataFrame:
    """Snapshots that a prune removes, as a dry run lists them: finished before a time, not among the newest keep of their workspace and repository, not
    selected (id), and not needed by any that stays, directly or not. Refused while a workspace of theirs is busy (workspace_id), and where nothing would be kept.
    """
    if keep < 1:
        raise ValueError("a prune keeps at least one generation of each repository and workspace")
    if busy is not None and (held := snapshots.join(busy, "workspace_id", "left_semi").select("workspace_id").first()):
        raise Busy(f"workspace {held[0]} is busy")
    old = snapshots.filter(F.col("finished_at") < before).select("id")
    out = old.join(retained(snapshots, keep).select("id"), "id", "left_anti").join(selected.select("id"), "id", "left_anti")
    out = checkpointed(out)
    stay = snapshots.select("id").join(out, "id", "left_anti").select(F.col("id").alias("node"))
    edges = snapshots.filter(F.col("depends_on").isNotNull()).select(F.col("id").alias("src"), F.col("depends_on").alias("dst"))
    gone = out.join(closure(edges, stay).select(F.col("node").alias("id")), "id", "left_anti")
    return snapshots.join(gone, "id", "left_semi")


def pruned(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """facts without those of the snapshots that prune lists; facts without a snapshot stay."""
    return facts.join(gone.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_anti")


def unchanged(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates (path, content_hash) whose path is stored with the same hash."""
    return candidates.join(stored.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_semi")


def survivors(rows: DataFrame, keys: list[str], identity: str = "id") -> DataFrame:
    """For each row the least id among its equals: (old, survivor)."""
    return rows.select(F.col(identity).alias("old"), F.min(identity).over(Window.partitionBy(*keys)).alias("survivor"))


def repoint(dependents: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    """dependents with references to merged rows moved to their survivors."""
    joined = dependents.join(moved.filter("old <> survivor"), F.col(column) == F.col("old"), "left")
    return joined.withColumn(column, F.coalesce("survivor", column)).drop("old", "survivor")


def publish(active: DataFrame, candidates: DataFrame) -> DataFrame:
    """The selection (workspace_id, repo_name, snapshot_id) after publishing candidates: theirs where they have one, else as it was."""
    newest = first_of(candidates, ["workspace_id", "repo_name"], F.col("generation").desc(), F.col("snapshot_id").desc())
    joined = active.alias("a").join(newest.alias("n"), ["workspace_id", "repo_name"], "full")
    return joined.select("workspace_id", "repo_name", F.coalesce("n.snapshot_id", "a.snapshot_id").alias("snapshot_id"), F.col("n.snapshot_id").isNotNull().alias("changed"))
