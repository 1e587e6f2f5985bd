"""What functions and classes integrate with: endpoints called over HTTP and consumers of produced queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import columns as C

COLUMNS = ["caller_function_id", "kind", "method", "path", "target_repo", "target_function_id", "line", "resolution"]


def http(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Calls on exactly an endpoint's path, as written or in canonical form, with its method or one that stands for any."""
    method = F.upper("http_method")
    c = calls.select("caller_function_id", F.col("http_method").alias("asked"), method.alias("c_method"), F.col("url_pattern").alias("key"), F.coalesce("line_number", F.lit(0)).alias("line"))
    plain = F.struct(F.col("path").alias("key"), F.upper("method").alias("e_method"))
    canonical = F.struct(C.canonical_endpoint(F.col("path")).alias("key"), C.normalize_method(F.col("method")).alias("e_method"))
    e = endpoints.select(
        F.col("repo_id").alias("target_repo"), F.col("handler_function_id").alias("target_function_id"), C.normalize_method(F.col("method")).alias("own"),
        C.canonical_endpoint(F.col("path")).alias("path"), F.explode(F.array_distinct(F.array(plain, canonical))).alias("form"),
    )
    e = e.select("target_repo", "target_function_id", "own", "path", "form.key", "form.e_method")
    met = c.join(e, "key").filter(F.col("c_method").isin("REQUEST", "ANY") | (F.col("c_method") == F.col("e_method")))
    named = F.coalesce(F.nullif("asked", F.lit("")), "own")
    return met.select("caller_function_id", F.lit("http").alias("kind"), named.alias("method"), "path", "target_repo", "target_function_id", "line", F.lit("matched").alias("resolution")).distinct()


def _bare(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "^%+|%+$", ""))


def queues(producers: DataFrame, consumers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Produced queues with each function that consumes them, by equal names or by an alias: key and value, or names that share a value. A queue that
    nothing consumes is unresolved. Names link before producers meet them, so that a busy queue is looked up once.
    """
    pairs = aliases.select(_bare(F.col("alias_key")).alias("key"), _bare(F.col("alias_value")).alias("value")).filter("key <> '' AND value <> ''").distinct()
    # every name of an alias, by the value that it stands for
    names = pairs.select(F.col("key").alias("name"), "value").unionByName(pairs.select(F.col("value").alias("name"), "value")).distinct()
    c = consumers.filter("queue_name <> ''").select(F.col("repo_id").alias("target_repo"), F.col("handler_function_id").alias("target_function_id"), _bare(F.col("queue_name")).alias("consumed")).distinct()
    asked = producers.select(_bare(F.col("queue_name")).alias("bare")).distinct()
    by_value = asked.join(names.withColumnRenamed("name", "bare"), "bare").join(names.withColumnRenamed("name", "consumed"), "value").select("bare", "consumed")
    linked = by_value.unionByName(asked.select("bare", F.col("bare").alias("consumed"))).distinct()
    found = linked.join(c, "consumed").select("bare", "target_repo", "target_function_id", F.lit("matched").alias("resolution")).distinct()
    p = producers.select("caller_function_id", F.col("queue_name").alias("path"), F.coalesce("line_number", F.lit(0)).alias("line"), _bare(F.col("queue_name")).alias("bare"))
    out = p.join(found, "bare", "left").withColumn("kind", F.lit("sqs")).withColumn("method", F.lit("SQS"))
    return out.withColumn("resolution", F.coalesce("resolution", F.lit("unresolved"))).select(*COLUMNS).distinct()


def methods_of(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions (class_id, function_id, function) that stand within a class's lines and carry its name before a dot. Files and names meet by
    equality, lines are compared within."""
    own = functions.select(F.col("id").alias("function_id"), "file_id", F.col("name").alias("function"), F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    parts = F.split("function", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    own = own.filter(F.contains("function", F.lit("."))).withColumn("name", F.explode(prefixes))
    held = classes.select(F.col("id").alias("class_id"), "file_id", "name", "start_line", "end_line").join(own, ["file_id", "name"])
    return held.filter("low >= start_line AND high <= end_line").select("class_id", "function_id", "function")


def of_classes(methods: DataFrame, found: DataFrame) -> DataFrame:
    """Integrations of each class's methods, each named once for a method, path and target, at its first line."""
    rows = methods.join(found.withColumnRenamed("caller_function_id", "function_id"), "function_id")
    return rows.groupBy("class_id", "function", "method", "path", "target_repo", "target_function_id", "resolution").agg(F.min("line").alias("line"))


def handled(methods: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Endpoints (class_id, method, path, function) that a class's methods handle, each once."""
    e = endpoints.select(F.col("handler_function_id").alias("function_id"), C.normalize_method(F.col("method")).alias("method"), C.canonical_endpoint(F.col("path")).alias("path"))
    return methods.join(e, "function_id").select("class_id", "method", "path", "function").distinct()
