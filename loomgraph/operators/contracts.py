"""Service contracts: what a repository offers and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import queues, routes


def http_used(calls: DataFrame) -> DataFrame:
    """Calls of each repository by method and route: (repo_id, http_method, url_pattern, n, client_type)."""
    return calls.groupBy("repo_id", "http_method", "url_pattern").agg(F.count("*").alias("n"), F.max("client_type").alias("client_type"))


def http_callers(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """For each repository with endpoints, calls of each other repository that meet them."""
    return routes.contract_repos(calls, endpoints).groupBy(F.col("e_repo").alias("repo_id"), F.col("c_repo").alias("caller_repo")).agg(F.countDistinct("call_id").alias("n"))


def target_counts(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Weights of target repositories of a repository's grouped calls: each target once a group, by the group's calls."""
    keyed = http_used(calls).withColumn("id", F.xxhash64("repo_id", "http_method", "url_pattern"))
    rows = keyed.withColumn("caller_function_id", F.lit(0)).withColumn("line_number", F.lit(0))
    pairs = routes.contract_repos(rows, endpoints, literal=False)
    weight = keyed.select(F.col("id").alias("call_id"), "n")
    return pairs.join(weight, "call_id").groupBy("c_repo", "e_repo").agg(F.sum("n").alias("n"))


def overview(repositories: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """Counts of every kind of boundary fact (repo_id) for each repository."""
    out = repositories.select(F.col("id").alias("repo_id"), "name")
    for name, rows in kinds.items():
        out = out.join(rows.groupBy("repo_id").agg(F.count("*").alias(name)), "repo_id", "left")
    return out.fillna(0, list(kinds))


def detail(
    repo: int, limit: int, calls: DataFrame, endpoints: DataFrame, producers: DataFrame, consumers: DataFrame, aliases: DataFrame, accesses: DataFrame,
    operations: DataFrame, usages: DataFrame, resolvers: DataFrame, permissions: DataFrame, entrypoints: DataFrame, triggers: DataFrame,
) -> dict[str, DataFrame]:
    """The sixteen boundary lists of one repository, each limited. A GraphQL usage of a name meets the operations of that name."""
    own = lambda rows: rows.filter(F.col("repo_id") == repo)
    met = queues.counterparties(producers, consumers, aliases)
    offered = operations.select(F.col("repo_id").alias("o_repo"), F.col("name").alias("operation_name")).distinct()
    used = usages.select(F.col("repo_id").alias("u_repo"), "operation_name").distinct().join(offered, "operation_name").filter("u_repo <> o_repo")
    return {
        "endpoints": own(endpoints).select("method", "path").distinct().orderBy("path", "method").limit(limit),
        "http_calls": http_used(own(calls)).orderBy(F.col("n").desc(), "url_pattern", "http_method").limit(limit),
        "http_callers": http_callers(calls, own(endpoints)).orderBy(F.col("n").desc(), "caller_repo").limit(limit),
        "produced": own(producers).groupBy("queue_name").agg(F.count("*").alias("n")).orderBy("queue_name").limit(limit),
        "consumed": own(consumers).groupBy("queue_name").agg(F.count("*").alias("n")).orderBy("queue_name").limit(limit),
        "producers_met": met.filter(F.col("consumer_repo") == repo).select("producer_repo").distinct().orderBy("producer_repo").limit(limit),
        "consumers_met": met.filter(F.col("producer_repo") == repo).select("consumer_repo").distinct().orderBy("consumer_repo").limit(limit),
        "entities": own(accesses).groupBy(F.lower("entity_name").alias("entity"), F.lower("access").alias("access")).agg(F.count("*").alias("n")).orderBy("entity", "access").limit(limit),
        "graphql_operations": own(operations).select("name").distinct().orderBy("name").limit(limit),
        "graphql_usages": own(usages).groupBy("operation_name").agg(F.count("*").alias("n")).orderBy("operation_name").limit(limit),
        "graphql_targets": used.filter(F.col("u_repo") == repo).select("operation_name", "o_repo").distinct().orderBy("operation_name", "o_repo").limit(limit),
        "graphql_callers": used.filter(F.col("o_repo") == repo).select("operation_name", "u_repo").distinct().orderBy("operation_name", "u_repo").limit(limit),
        "graphql_resolvers": own(resolvers).select("operation_name", "handler").distinct().orderBy("operation_name", "handler").limit(limit),
        "graphql_permissions": own(permissions).select("operation_name", "role").distinct().orderBy("operation_name", "role").limit(limit),
        "graphql_entrypoints": own(entrypoints).select("path").distinct().orderBy("path").limit(limit),
        "timer_triggers": own(triggers).filter("kind = 'timer'").select("name", "value").distinct().orderBy("name", "value").limit(limit),
    }
