"""Change impact: summaries over walks, entrypoints, change areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import impact_score
from loomgraph.operators.graph import bfs
from loomgraph.operators.tables import checkpointed


def summary(reached: DataFrame, key: str) -> DataFrame:
    """For each key its least depth, fanout (rows) and score; directly affected at depth 0."""
    out = reached.groupBy(key).agg(F.min("depth").alias("min_depth"), F.count("*").alias("fanout"))
    return out.withColumn("score", F.round(impact_score(F.col("min_depth"), F.col("fanout")), 6)).withColumn("direct", F.col("min_depth") == 0)


def merge(*entrypoints: DataFrame) -> DataFrame:
    """Entrypoints (method, path, min_depth, fanout) merged: least depth, summed fanout, scored again."""
    rows = entrypoints[0]
    for one in entrypoints[1:]:
        rows = rows.unionByName(one)
    out = rows.groupBy("method", "path").agg(F.min("min_depth").alias("min_depth"), F.sum("fanout").alias("fanout"))
    return out.withColumn("score", F.round(impact_score(F.col("min_depth"), F.col("fanout")), 6))


def targets(functions: DataFrame, *named: DataFrame) -> DataFrame:
    """Roots (node) of a change: functions named by id, or met by files, ranges or a diff; each of named has ids (id)."""
    out = None
    for one in named:
        held = one.select("id")
        out = held if out is None else out.unionByName(held)
    return functions.join(out.distinct(), "id", "left_semi").select(F.col("id").alias("node"))


def report(roots: DataFrame, edges: DataFrame, endpoints: DataFrame, functions: DataFrame, depth: int) -> DataFrame:
    """What a change of roots (node) can reach upstream over edges (src, dst): (kind, key, min_depth, fanout, score) of entrypoints, files and
    repositories."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = checkpointed(bfs(back, roots, depth).select("node", "depth"))
    handled = endpoints.select(F.col("handler_function_id").alias("node"), F.concat_ws(" ", "method", "path").alias("key"))
    named = functions.select(F.col("id").alias("node"), "file_path", "repo_name")
    rows = found.join(handled, "node").select(F.lit("entrypoint").alias("kind"), "key", "depth")
    for kind, column in (("file", "file_path"), ("repository", "repo_name")):
        rows = rows.unionByName(found.join(named, "node").select(F.lit(kind).alias("kind"), F.col(column).alias("key"), "depth"))
    out = rows.groupBy("kind", "key").agg(F.min("depth").alias("min_depth"), F.count("*").alias("fanout"))
    return out.withColumn("score", F.round(impact_score(F.col("min_depth"), F.col("fanout")), 6))


def areas(files: DataFrame, n: int = 3) -> DataFrame:
    """The folders (first two path parts) with most changes (path, changes)."""
    area = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    return files.groupBy(area.alias("area")).agg(F.sum("changes").alias("changes")).orderBy(F.col("changes").desc(), "area").limit(n)


def entity_scores(accesses: DataFrame, writes: int = 10, reads: int = 3) -> DataFrame:
    """Entities of a scope by access, writes above reads; of a best score of 8 or more only those within 2 of it stay."""
    held = accesses.groupBy(F.lower("entity_name").alias("entity")).agg(F.sum(F.when(F.lower("access") == "write", writes).otherwise(reads)).alias("score"))
    best = held.agg(F.max("score").alias("best"))
    return held.join(F.broadcast(best), F.lit(True)).filter((F.col("best") < 8) | (F.col("score") >= F.col("best") - 2)).drop("best")


def expand_entities(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities (entity) and those one relationship (entity, related) away, either way."""
    both = relationships.select("entity", "related").unionByName(relationships.select(F.col("related").alias("entity"), F.col("entity").alias("related")))
    return entities.select("entity").unionByName(entities.join(both, "entity").select(F.col("related").alias("entity"))).distinct()
