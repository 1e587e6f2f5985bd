"""Snapshot scope and fact-to-identity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import caller_id


#: Bytes of files up to which a table may be broadcast on Spark's estimate.
SMALL = 1_000_000


def read_bytes(df: DataFrame) -> int:
    """Bytes of all files that a DataFrame reads, whichever columns it takes."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def joinable(df: DataFrame) -> DataFrame:
    """df as a side of a join that isn't broadcast unless its files are small: Spark's estimate takes rows to be as large as they are compressed,
    and a broadcast is built in the driver's memory."""
    return df.hint("merge") if read_bytes(df) > SMALL else df


def in_scope(column: Column, active: list[int] | None, legacy: bool = False) -> Column:
    """No list: everything; a list: its snapshots, with legacy also rows without one; an empty list: nothing but legacy rows."""
    if active is None:
        return F.lit(True)
    inside = column.isin(*active) if active else F.lit(False)
    return F.coalesce(inside, F.lit(False)) | (column.isNull() if legacy else F.lit(False))


def semi_scope(facts: DataFrame, active: DataFrame, column: str = "snapshot_id", legacy: bool = False) -> DataFrame:
    """Scope by a table of active snapshots (snapshot_id), by semi-join, so that partitions are pruned at run time."""
    kept = facts.join(active.select(F.col("snapshot_id").alias(column)).distinct(), column, "left_semi")
    return kept.unionByName(facts.filter(F.col(column).isNull())) if legacy else kept


def identified(functions: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
    """Functions with file, repository, snapshot and identity."""
    f = files.select(F.col("id").alias("file_id"), "repo_id", "snapshot_id", F.col("path").alias("file_path"), "language")
    r = repositories.select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name"))
    return functions.join(joinable(f), "file_id").join(r, "repo_id").withColumn("caller_id", caller_id(F.col("repo_name"), F.col("file_path"), F.col("name")))


def lookup(keys: DataFrame, functions: DataFrame, on: list[str]) -> DataFrame:
    """For each key the one function picked: least start line, end line, id."""
    order = Window.partitionBy(*on).orderBy(F.col("start_line").asc_nulls_last(), F.col("end_line").asc_nulls_last(), "id")
    return keys.join(functions, on).withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def unique(rows: DataFrame, keys: list[str], value: str, as_name: str) -> DataFrame:
    """Keys that exactly one row has, with its value: an ambiguous key is no match."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias(as_name)).filter("n = 1").drop("n")


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key, first by order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def first_n(rows: DataFrame, keys: list[str], order: str | Column, n: int) -> DataFrame:
    """At most n rows for each key, first by order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__rn") <= n).drop("__rn")


def innermost(points: DataFrame, spans: DataFrame, on: list[str], line: str = "line_number") -> DataFrame:
    """For each point (id, on, line) the innermost span (span_id, on, start_line, end_line) that holds it."""
    met = points.join(spans, on).filter((F.col("start_line") <= F.col(line)) & (F.col(line) <= F.col("end_line")))
    return first_of(met, ["id"], F.col("end_line") - F.col("start_line"), F.col("start_line").desc(), "span_id")


def overlapping(ranges: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """Spans that a changed range [low, high] touches."""
    return ranges.join(spans, on).filter((F.col("start_line") <= F.col("high")) & (F.col("end_line") >= F.col("low")))


def merged_ranges(ranges: DataFrame, on: list[str]) -> DataFrame:
    """Ranges [low, high] that touch or overlap, merged."""
    order = Window.partitionBy(*on).orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("fresh", (before.isNull() | (F.col("low") > before + 1)).cast("int"))
    return marked.withColumn("block", F.sum("fresh").over(order)).groupBy(*on, "block").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("block")
