"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input.

Counted as part of the llm subpackage. A stage works on all that its predecessor kept, and its decisions take effect: rejected documents go,
one document of each near-duplicate group stays, repeated passages leave the texts, the mix repeats or drops documents, and what
remains is encoded.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, and an empty table. Columns beyond those of documents pass
through all stages but the last, whatever their names: a stage sets them apart under names of its own while it works.

Stages run in order, each result written before the next stage over the same tables begins; a stage then removes the tables that the one
before it worked with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, mixing, neardup, quality, substrings
from loomgraph.llm.common import digest, read, release, remove, repeats, scratch, stored
from loomgraph.llm.queries import byte_bpe, quality_model

#: Columns that stages use by name; all others are set apart.
OWN = ("doc_id", "text", "lang", "source", "n_chars")
#: Tables that the stage run last over each folder of inputs worked with.
_left: dict[str, list[str]] = {}


def begin(spark: SparkSession, sf_dir: str, made: list[str]) -> None:
    """A stage begins when its predecessor's result has been written: the tables which that one worked with go, and made takes their place."""
    remove(spark, _left.get(sf_dir, []))
    _left[sf_dir] = made
    release(spark)


def apart(docs: DataFrame) -> DataFrame:
    """docs with columns that no operator knows under names that clash with none."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in OWN else f"extra__{k}") for k, c in enumerate(docs.columns)))


def together(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, by name and order, from rows whose others were set apart."""
    return found.select(*(F.col(c if c in OWN else f"extra__{k}").alias(c) for k, c in enumerate(docs.columns)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least quality.GOOD. Null and empty texts score the labelled share of good ones; equal texts score
    alike, so repeated rows go or stay together."""
    with scratch() as made:
        begin(spark, sf_dir, made)
        own = apart(docs)
        return together(quality.classify(own, quality_model(own, read(spark, sf_dir, "labels"))).filter("predicted = 1"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group, null ids last; of rows equal in id and text, one. Texts without words are
    linked with nothing and stay."""
    with scratch() as made:
        begin(spark, sf_dir, made)
        own = apart(docs)
        if repeats(own):
            own = stored(own.dropDuplicates(["doc_id", "text"]), "pipeline-distinct")
        return together(neardup.near_duplicates(own).filter("kept"), docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words under windows that start earlier; n_chars follows the text. Null texts become empty ones; rows equal in id and text
    are one document and stay alike; a document that loses all its words stays, empty."""
    with scratch() as made:
        begin(spark, sf_dir, made)
        found = substrings.deduplicate(apart(docs))
        if "n_chars" in docs.columns:
            chars = F.when(F.col("removed"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
            found = found.withColumn("n_chars", chars)
        return together(found, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times; those without words go. A null source is a source, the last. Rows equal in id
    and text are taken as often as the one of them taken most."""
    with scratch() as made:
        begin(spark, sf_dir, made)
        own = apart(docs)
        mixed = mixing.mix(own).groupBy("doc_id", "row_hash").agg(F.max("copies").alias("copies")).filter("copies > 0")
        named = mixed.select(F.col("doc_id").alias("mixed_id"), "row_hash", "copies")
        hashed = own.withColumn("own_hash", F.xxhash64("doc_id", "text"))
        joined = hashed.join(named, F.col("doc_id").eqNullSafe(F.col("mixed_id")) & (F.col("own_hash") == F.col("row_hash")))
        return together(joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the text that they decode to; null and empty texts have none. Other columns end here."""
    with scratch() as made:
        begin(spark, sf_dir, made)
        coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), byte_bpe())
        ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
        return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifier's scores and the encoder can't be written in SQL; tests hold each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    written: list[str] = []
    for name, stage in STAGES:
        with scratch() as result:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # what the stage worked with and its input have been read for the last time
        remove(spark, _left.pop(sf_dir, []))
        remove(spark, written)
        written = result
    return docs
