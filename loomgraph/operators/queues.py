"""Queue matchers: the trace's variants, the audit's forms, and the alias closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import columns as C


def audit_reasons(producers: DataFrame, consumers: DataFrame, strip_fifo: bool = False) -> DataFrame:
    """Each produced queue's reason: exact, normalized, or no consumer (several producing repositories, or one)."""
    named = lambda df: df.filter(F.col("queue_name").isNotNull() & (F.col("queue_name") != ""))
    p = named(producers).groupBy("queue_name").agg(F.countDistinct("repo_id").alias("producer_repos"))
    p = p.withColumn("exact", F.lower("queue_name")).withColumn("norm", C.audit_queue(F.col("queue_name"), strip_fifo))
    c = named(consumers).select("queue_name").distinct()
    exact = c.select(F.lower("queue_name").alias("exact")).distinct().withColumn("has_exact", F.lit(True))
    norm = c.select(C.audit_queue(F.col("queue_name"), strip_fifo).alias("norm")).distinct().withColumn("has_norm", F.lit(True))
    reason = (
        F.when(F.col("has_exact"), "exact_match").when(F.col("has_norm"), "normalized_match_only").when(F.col("producer_repos") > 1, "no_consumer_match_internal").otherwise("no_consumer_match_single_repo")
    )
    return p.join(exact, "exact", "left").join(norm, "norm", "left").select("queue_name", "producer_repos", reason.alias("reason"))


def alias_variants(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name, variant) with the variants that aliases add: keys and values met directly, and keys that share such a value."""
    pairs = aliases.select(F.lower(F.trim("alias_key")).alias("key"), F.lower(F.trim("alias_value")).alias("value")).distinct()
    bare = names.withColumn("met", C.alias_queue(F.col("variant")))
    by_key = bare.join(pairs, F.col("met") == F.col("key")).select("name", "key", "value")
    by_value = bare.join(pairs, F.col("met") == F.col("value")).select("name", "key", "value")
    direct = by_key.unionByName(by_value).distinct()
    shared = direct.select("name", "value").distinct().join(pairs, "value").select("name", "key", "value")
    every = direct.unionByName(shared).distinct()
    added = every.select("name", F.col("key").alias("variant")).unionByName(every.select("name", F.col("value").alias("variant")))
    return names.select("name", "variant").unionByName(added).distinct()


def trace_consumers(producers: DataFrame, consumers: DataFrame, aliases: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (queue_name, consumer_id) by any variant of the produced name, aliases included.

    consumers: (consumer_id, queue_name, kind), the union of queue consumers, triggers and queue reads.
    """
    names = producers.select(F.col("queue_name").alias("name")).distinct()
    names = names.select("name", F.explode(C.queue_variants(F.col("name"), prefixes)).alias("variant"))
    every = alias_variants(names, aliases)
    stored = consumers.select("consumer_id", "kind", F.lower(F.trim("queue_name")).alias("variant"))
    return every.join(stored, "variant").select(F.col("name").alias("queue_name"), "consumer_id", "kind").distinct()


def counterparties(producers: DataFrame, consumers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Repositories (producer_repo, consumer_repo, queue) that meet on a queue: equal names, an alias's key and value, or a shared alias value."""
    pairs = aliases.select(F.lower("alias_key").alias("key"), F.lower("alias_value").alias("value")).distinct()
    p = producers.select(F.col("repo_id").alias("producer_repo"), C.alias_queue(F.col("queue_name")).alias("a")).distinct()
    c = consumers.select(F.col("repo_id").alias("consumer_repo"), C.alias_queue(F.col("queue_name")).alias("b")).distinct()
    siblings = pairs.alias("x").join(pairs.alias("y"), F.col("x.value") == F.col("y.value")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    linked = pairs.select(F.col("key").alias("a"), F.col("value").alias("b")).unionByName(pairs.select(F.col("value").alias("a"), F.col("key").alias("b"))).unionByName(siblings).distinct()
    same = p.join(c, F.col("a") == F.col("b"))
    other = p.join(linked, "a").join(c, "b")
    cols = ["producer_repo", "consumer_repo", F.col("a").alias("queue")]
    return same.select(*cols).unionByName(other.select(*cols)).filter("producer_repo <> consumer_repo").distinct()


def repo_edges(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Counted edges between repositories over equal queue names."""
    p = producers.groupBy(F.col("repo_id").alias("src"), "queue_name").agg(F.count("*").alias("n"))
    c = consumers.select(F.col("repo_id").alias("tgt"), "queue_name").distinct()
    return p.join(c, "queue_name").filter("src <> tgt").select("src", "tgt", "queue_name", "n")
