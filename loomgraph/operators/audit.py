"""Index quality: HTTP classes, queue match rate, data coverage, dependency edges, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import columns as C
from loomgraph.operators import queues, routes
from loomgraph.operators.scope import first_of

#: Rates under which an audit warns: queues, data. Percent.
QUEUE_RATE, DATA_RATE = 90.0, 60.0


def duplicate_endpoints(endpoints: DataFrame, files: DataFrame) -> DataFrame:
    """Groups of endpoints equal in repository, route, method, handler and file."""
    own = files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    rows = endpoints.join(own, "file_id").filter(~F.startswith("file_path", F.lit(".codebase-snapshots/")))
    keys = ["repo_id", F.lower("path").alias("route"), F.upper("method").alias("method"), F.coalesce("handler_function_id", F.lit(0)).alias("handler"), "file_id"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def http_counts(classes: DataFrame) -> DataFrame:
    names = ("non_route_like", "path_unmatched", "method_mismatched", "invalid_method_token", "matched")
    return classes.agg(F.count("*").alias("total"), *(F.count_if(F.col("class") == n).alias(n) for n in names))


def unresolved_repos(classes: DataFrame, limit: int = 0) -> DataFrame:
    """Unresolved calls by repository, most first."""
    rows = classes.filter(F.col("class").isin("path_unmatched", "method_mismatched"))
    out = rows.groupBy("repo_id").agg(F.count("*").alias("n"), F.count_if(F.col("class") == "path_unmatched").alias("path_unmatched"), F.count_if(F.col("class") == "method_mismatched").alias("method_mismatched"))
    out = out.orderBy(F.col("n").desc(), "repo_id")
    return out.limit(limit) if limit else out


def unresolved_samples(classes: DataFrame, limit: int) -> DataFrame:
    """First samples: mismatched methods, then by repository, route and call."""
    rows = classes.filter(F.col("class").isin("path_unmatched", "method_mismatched"))
    return rows.orderBy((F.col("class") == "method_mismatched").desc(), "repo_id", "url_pattern", "id").limit(limit)


def queue_metrics(producers: DataFrame, consumers: DataFrame, strip_fifo: bool = False) -> DataFrame:
    held = queues.audit_reasons(producers, consumers, strip_fifo)
    n = lambda r: F.count_if(F.col("reason") == r)
    row = held.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("reason") != "no_consumer_match_single_repo").alias("counted"),
        n("exact_match").alias("exact"),
        n("normalized_match_only").alias("normalized"),
        n("no_consumer_match_internal").alias("unmatched"),
        n("no_consumer_match_single_repo").alias("single_repo"),
    )
    return row.withColumn("match_rate", F.when(F.col("counted") == 0, 100.0).otherwise((F.col("exact") + F.col("normalized")) * 100.0 / F.col("counted")))


def data_metrics(accesses: DataFrame) -> DataFrame:
    """Coverage of written entities. An entity is shared if several repositories write it or read it, covered if one reads what another writes.

    Which pairs of repositories read and write isn't listed: a reader differs from some writer unless there is one of each and they are the same.
    """
    rows = accesses.filter(F.col("entity_name") != "").select(F.lower("entity_name").alias("entity"), "repo_id", F.lower("access").alias("access"))
    side = lambda a: F.when(F.col("access") == a, F.col("repo_id"))
    by = rows.groupBy("entity").agg(F.countDistinct(side("write")).alias("w"), F.countDistinct(side("read")).alias("r"), F.min(side("write")).alias("w1"), F.min(side("read")).alias("r1")).filter("w > 0")
    cross = (F.col("r") > 0) & ((F.col("w") > 1) | (F.col("r") > 1) | (F.col("w1") != F.col("r1")))
    shared = (F.col("w") > 1) | (F.col("r") > 1)
    out = by.agg(
        F.count("*").alias("write_entities"),
        F.count_if(shared).alias("shared"),
        F.count_if(shared & cross).alias("covered"),
        F.count_if(F.col("r") == 0).alias("no_reader"),
        F.count_if((F.col("r") > 0) & ~cross).alias("same_repo_only"),
        F.count_if(~shared).alias("single_repo_only"),
    )
    rate = F.when(F.col("shared") > 0, F.col("covered") * 100.0 / F.col("shared")).when(F.col("write_entities") == 0, 100.0).otherwise(0.0)
    return out.withColumn("coverage_rate", rate)


def dependency_edges(calls: DataFrame, endpoints: DataFrame, producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Counted edges (src, tgt, type, queue_name): an HTTP call counts once for each repository it meets."""
    http = routes.audit_repos(routes.audit_calls(calls), endpoints).groupBy(F.col("c_repo").alias("src"), F.col("e_repo").alias("tgt")).agg(F.count("*").alias("n"))
    queue = queues.repo_edges(producers, consumers).withColumn("type", F.lit("sqs"))
    return http.withColumn("type", F.lit("http")).withColumn("queue_name", F.lit("")).unionByName(queue.select("src", "tgt", "n", "type", "queue_name"))


def health(repositories: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Counts for each repository and its commonest language, ties by name."""
    of_file = files.select(F.col("id").alias("file_id"), "repo_id")
    counted = lambda rows, name: rows.groupBy("repo_id").agg(F.count("*").alias(name))
    out = repositories.select(F.col("id").alias("repo_id"), "name")
    for rows, name in ((files, "files"), (functions.join(of_file, "file_id"), "functions"), (classes.join(of_file, "file_id"), "classes"), (endpoints, "endpoints")):
        out = out.join(counted(rows, name), "repo_id", "left")
    spoken = files.groupBy("repo_id", F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))
    main = first_of(spoken, ["repo_id"], F.col("n").desc(), "language").select("repo_id", F.col("language").alias("primary_language"))
    return out.join(main, "repo_id", "left").fillna(0, ["files", "functions", "classes", "endpoints"]).fillna("mixed", ["primary_language"])


def status(metrics: DataFrame) -> DataFrame:
    """metrics (duplicates, unresolved, counted, match_rate, shared, coverage_rate) with the number of warnings and the status."""
    flags = [F.col("duplicates") > 0, F.col("unresolved") > 0, (F.col("counted") > 0) & (F.col("match_rate") < QUEUE_RATE), (F.col("shared") > 0) & (F.col("coverage_rate") < DATA_RATE)]
    warnings = sum((f.cast("int") for f in flags), F.lit(0))
    return metrics.withColumn("warnings", warnings).withColumn("status", F.when(F.col("warnings") > 0, "warn").otherwise("ok"))


def unresolved_calls(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("callee_function_id").isNull()).groupBy(C.unresolved_reason(F.col("callee_name")).alias("reason")).agg(F.count("*").alias("n"))
