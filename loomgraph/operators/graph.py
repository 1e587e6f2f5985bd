"""Graph walks as level-synchronous joins: each level joins the frontier with edges and removes what was visited.

A walk's depth bounds the number of rounds, never the driver's memory; a closure's rounds end when nothing is new. Frontiers and visited sets
stay distributed and are written each level. A node belongs to the parent that reaches it first; ties go to the least parent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.scope import first_of
from loomgraph.operators.tables import checkpointed

#: Depths and budgets of a walk: default and most; nodes of a trace: default and most; paths: default and most depth.
DEPTH, MOST_DEPTH, NODES, MOST_NODES, PATH_DEPTH, MOST_PATH_DEPTH = 4, 32, 2_000, 10_000, 5, 8
#: Levels of a walk whose tables are read one by one.
MERGED = 16
#: Confidences from the best.
CONFIDENCES = ("high", "medium", "low")


def typed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type, confidence); calls of high confidence where nothing else is said."""
    for column, value in (("edge_type", "call"), ("confidence", "high")):
        if column not in edges.columns:
            edges = edges.withColumn(column, F.lit(value))
    return edges.select("src", "dst", "edge_type", "confidence")


def bfs(edges: DataFrame | Callable[[DataFrame], DataFrame], roots: DataFrame, depth: int | None = DEPTH, expand: Column | None = None) -> DataFrame:
    """Rows (node, depth, parent, edge_type, confidence) of what roots (node) reach over edges (src, dst[, edge_type, confidence]).

    edges: a table, or a function that gives those of a frontier (node), for edges that are found by matching and shouldn't be listed in full.
    depth: levels, MOST_DEPTH at most; None goes on until nothing is new. expand: a condition on a reached row without which its node is a leaf.

    Levels are written once each and stay as they are: what was visited is their union, merged only every ``MERGED`` levels.
    """
    table = None if callable(edges) else typed(edges)
    kind = roots.schema["node"].dataType
    none = F.lit(None).cast("string")
    frontier = checkpointed(roots.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"), none.alias("edge_type"), none.alias("confidence")))
    levels = [frontier]
    for level in count(1) if depth is None else range(1, min(depth, MOST_DEPTH) + 1):
        source = frontier if expand is None or level == 1 else frontier.filter(expand)
        near = source.select("node")
        own = table if table is not None else typed(edges(near))
        step = near.withColumnRenamed("node", "src").join(own, "src").select(F.col("dst").alias("node"), F.lit(level).alias("depth"), F.col("src").alias("parent"), "edge_type", "confidence")
        # the least parent is found by aggregation, before anything of a level is shuffled twice
        least = step.groupBy("node").agg(F.min(F.struct("depth", "parent", "edge_type", "confidence")).alias("x")).select("node", "x.*")
        frontier = checkpointed(least.join(reduce(DataFrame.unionByName, levels).select("node"), "node", "left_anti"))
        if not frontier.limit(1).count():
            break
        levels.append(frontier)
        if len(levels) > MERGED:
            levels = [checkpointed(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything that seeds (node) reach over edges (src, dst), seeds included; rounds until nothing is new."""
    return bfs(edges, seeds, None).select("node", "depth")


def shortest_path(edges: DataFrame, source, target, depth: int = PATH_DEPTH) -> DataFrame:
    """The shortest path from source to target, least in node order among equals: rows (step, src, dst). None is empty; the same node too.

    Distances to the target come first, by a reverse walk; then each step takes the least neighbour that is nearer.
    """
    depth = min(depth, MOST_PATH_DEPTH)
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    far = bfs(reverse, spark.createDataFrame([(target,)], f"node {kind}"), depth).select("node", F.col("depth").alias("left"))
    at = far.filter(F.col("node") == F.lit(source)).select("node", "left")
    out = spark.createDataFrame([], f"step int, src {kind}, dst {kind}")
    for step in range(1, depth + 1):
        there = at.filter("left > 0").select(F.col("node").alias("src"), (F.col("left") - 1).alias("want")).join(edges, "src").join(far, (F.col("dst") == F.col("node")) & (F.col("left") == F.col("want")))
        taken = checkpointed(there.groupBy("src", "left").agg(F.min("dst").alias("dst")))
        if not taken.limit(1).count():
            break
        out = out.unionByName(taken.select(F.lit(step).alias("step"), "src", "dst"))
        at = taken.select(F.col("dst").alias("node"), "left")
    return out


def walks(edges: DataFrame, source, target, depth: int = PATH_DEPTH) -> DataFrame:
    """Steps (step, src, dst) of all walks from source, each as often as a walk takes it: a walk ends at target, where no edge leaves, or at depth.

    Unlike shortest_path it also tells how far a walk comes that never meets the target.
    """
    step = checkpointed(edges.filter(F.col("src") == F.lit(source)).select(F.lit(1).alias("step"), "src", "dst"))
    out = step
    for level in range(2, min(depth, MOST_PATH_DEPTH) + 1):
        at = step.filter(F.col("dst") != F.lit(target)).select(F.col("dst").alias("src"))
        step = checkpointed(at.join(edges, "src").select(F.lit(level).alias("step"), "src", "dst"))
        if not step.limit(1).count():
            break
        out = out.unionByName(step)
    return out


def parents(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Evidence tree: for each node its parent on a shortest path from roots, the least among equals; a depth cuts it."""
    return bfs(edges, roots, depth).select("node", "parent", "depth")


def frontier_bounded(edges: DataFrame | Callable[[DataFrame], DataFrame], roots: DataFrame, depth: int, most: int | None, sinks: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Predecessor frontier with budgets: rows reached, and one row (clipped) that says whether depth or nodes (most; None: all) ran out.

    edges: (src, dst, edge_type), walked from dst to src; nodes reached over a type in sinks aren't expanded. Or a function that gives, turned round, those
    that lead to a frontier (node). What lies beyond the depth is looked for only where clipped is asked for.
    """
    depth = min(depth, MOST_DEPTH)
    reverse = edges if callable(edges) else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type")
    keep = ~F.coalesce(F.col("edge_type").isin(*sinks), F.lit(False)) if sinks else F.lit(True)
    found = bfs(reverse, roots, depth, keep)
    kept = found if most is None else found.orderBy("depth", "node").limit(most)
    last = found.filter((F.col("depth") == depth) & ((F.col("depth") == 0) | keep)).select("node")
    beyond = reverse(last) if callable(reverse) else last.withColumnRenamed("node", "src").join(reverse, "src")
    deep = beyond.select(F.col("dst").alias("node")).join(found.select("node"), "node", "left_anti").limit(1).agg((F.count("*") > 0).alias("deep"))
    many = found.agg((F.lit(False) if most is None else F.count("*") > most).alias("many"))
    return kept, many.join(deep, F.lit(True)).select((F.col("deep") | F.col("many")).alias("clipped"))


def tree_rows(reached: DataFrame, most: int = NODES) -> DataFrame:
    """Nodes of a walk in order (depth, parent, node) up to a budget, with whether it cut anything."""
    most = min(most, MOST_NODES)
    total = reached.agg(F.count("*").alias("total"))
    return reached.orderBy("depth", F.col("parent").asc_nulls_first(), "node").limit(most).join(F.broadcast(total), F.lit(True)).withColumn("truncated", F.col("total") > most).drop("total")


def quality(reached: DataFrame) -> DataFrame:
    """One row on a walk: nodes, depth, edges by type, and the shares of each confidence."""
    held = lambda c: F.count_if(F.col("confidence") == c)
    total = F.count("confidence")
    share = lambda c: F.when(total > 0, held(c) / total).otherwise(F.lit(0.0))
    return reached.agg(
        F.count("*").alias("nodes"),
        F.max("depth").alias("max_depth"),
        F.count("edge_type").alias("edges"),
        *(held(c).alias(c) for c in CONFIDENCES),
        share("high").alias("direct_ratio"),
        share("medium").alias("resolved_ratio"),
        share("low").alias("name_ratio"),
    )


def with_evidence(edges: DataFrame) -> DataFrame:
    """Edges without file and line lose one step of confidence."""
    lacking = F.col("evidence_file").isNull() | (F.trim("evidence_file") == "") | F.coalesce(F.col("evidence_line") <= 0, F.lit(True))
    lower = F.when(F.col("confidence") == "high", "medium").otherwise("low")
    return edges.withColumn("confidence", F.when(lacking, lower).otherwise(F.col("confidence")))


def distinct_siblings(nodes: DataFrame) -> DataFrame:
    """Of a parent's children with equal identity and edge, or equal name, file and edge where there is no identity, the first by id."""
    key = F.when(F.coalesce(F.col("caller_id"), F.lit("")) != "", F.concat_ws("|", F.lit("i"), "caller_id", "edge_type")).otherwise(F.concat_ws("|", F.lit("n"), "name", "file", "edge_type"))
    return first_of(nodes.withColumn("__key", key), ["parent", "__key"], "id").drop("__key")


def expandable(nodes: DataFrame, calls_of: DataFrame, policy: str, root_repo: str, most_calls: int) -> DataFrame:
    """Nodes that a walk goes on from: leaf none, full all, smart those of the root's repository with one call to most_calls."""
    if policy == "leaf":
        return nodes.limit(0)
    if policy == "full":
        return nodes
    return nodes.join(calls_of, "node").filter((F.col("repo") == root_repo) & F.col("calls").between(1, most_calls)).drop("calls")


def traced(direct: DataFrame, guessed: DataFrame, owners: DataFrame, roots: DataFrame, profile: dict[str, Any]) -> DataFrame:
    """A walk within a profile's depth and nodes, as tree_rows gives it. Direct edges (src, dst) are always followed; guessed ones where the profile resolves,
    and what they reach is a leaf unless its expansion is full, or smart and the target is of the caller's repository with few direct calls.
    owners: (node, repo).
    """
    edges = direct.select("src", "dst").distinct().withColumn("edge_type", F.lit("call"))
    if profile["resolve"]:
        more = guessed.select("src", "dst").distinct()
        kind = F.lit("resolved" if profile["expand"] == "full" else "resolved_leaf")
        if profile["expand"] == "smart":
            counted = direct.select("src", "dst").distinct().groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("calls"))
            own = owners.select(F.col("node").alias("src"), F.col("repo").alias("src_repo"))
            other = owners.select(F.col("node").alias("dst"), F.col("repo").alias("dst_repo"))
            more = more.join(own, "src", "left").join(other, "dst", "left").join(counted, "dst", "left")
            kind = F.when((F.col("src_repo") == F.col("dst_repo")) & F.col("calls").between(1, profile["calls"]), "resolved").otherwise(kind)
        edges = edges.unionByName(more.select("src", "dst", kind.alias("edge_type")))
    reached = bfs(checkpointed(edges), roots, profile["depth"], F.col("edge_type") != "resolved_leaf")
    return tree_rows(reached, profile["nodes"])


def tiered_edges(*sources: DataFrame) -> DataFrame:
    """Edges (src, ...) of the first source that has any for a caller."""
    every = None
    for tier, one in enumerate(sources):
        ranked = one.withColumn("tier", F.lit(tier))
        every = ranked if every is None else every.unionByName(ranked)
    best = every.groupBy("src").agg(F.min("tier").alias("tier"))
    return every.join(best, ["src", "tier"])


def affected_snapshots(changed: DataFrame, references: DataFrame, declared: DataFrame | None = None, pending: DataFrame | None = None) -> DataFrame:
    """Snapshots that changed, and all that refer to them directly or not. references: (snapshot, target).

    Seeds by name as well: snapshots whose unresolved calls (pending: snapshot, name) name something that a changed snapshot declares
    (declared: snapshot, name), as a change may answer or confuse them.
    """
    seeds = changed.select("snapshot")
    if declared is not None and pending is not None:
        names = declared.join(seeds, "snapshot", "left_semi").select("name").distinct()
        seeds = seeds.unionByName(pending.join(names, "name", "left_semi").select("snapshot")).distinct()
    edges = references.select(F.col("target").alias("src"), F.col("snapshot").alias("dst"))
    return bfs(edges, seeds.select(F.col("snapshot").alias("node")), None).select(F.col("node").alias("snapshot"))
