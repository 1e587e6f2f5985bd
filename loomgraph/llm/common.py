"""What the training-data operators share: word rules, the shared folder, and cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8; ``bytes.split`` breaks at exactly the six ASCII white-space bytes."""
    return text.encode().split() if text else []


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z alone lower-cased (``bytes.lower`` leaves other letters)."""
    return text.encode().lower() if text else b""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. On a single machine (tests) one of our own will do where that is unset;
    on a cluster executors would write where the driver can't read, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Lists of the tables that stored() has written, one for each scratch() that is open, the innermost last.
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Note the tables that stored() writes inside, for remove() once nothing reads them any more. Others of the session aren't touched."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [x for x in _open if x is not made]


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it again: compressed, pruned by column, safe from lost executors.

    With keep, an open scratch() doesn't note the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open and not keep:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a step of an iteration and cut its lineage. As a written table its size is known, so that joins with it are broadcast
    while it is small and shuffled when it is not; a checkpoint would compute it twice and hide its size."""
    return stored(df, "step")


def remove(spark: SparkSession, tables: list[str]) -> None:
    """Remove written tables and forget them. For callers that know that every result which reads them has been written."""
    while tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffles, broadcasts and checkpoints that nothing refers to any more: it acts on the driver's garbage
    collections, which a long run of small jobs on a large heap seldom brings about."""
    gc.collect()
    spark._jvm.System.gc()


def digest(column):
    return F.sha2((F.col(column) if isinstance(column, str) else column).cast("binary"), 256)


def give_back() -> None:
    """Return memory that Arrow and the allocator keep after a batch to the system; workers live on, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def by_size(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose text column sums to about ``most`` bytes, or one longer row."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(text)), 0).to_pylist()
        start = total = 0
        for k, size in enumerate(sizes):
            if total and total + size > most:
                yield whole.slice(start, k - start)
                start, total = k, 0
            total += size
        if start < whole.num_rows:
            yield whole.slice(start)
        give_back()


def repeats(docs: DataFrame, column: str = "doc_id") -> bool:
    """Whether an id repeats or is null."""
    flawed = docs.groupBy(column).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(column).isNull())
    return flawed.limit(1).count() > 0


def document_key(docs: DataFrame, column: str = "doc_id"):
    """A column that tells documents apart and orders them: the id itself, or, where ids repeat or are null, (null last, id, text hashes).

    Rows equal in id and text share a key and so a result.
    """
    if repeats(docs, column):
        return F.struct(F.col(column).isNull().alias("unknown"), F.col(column).alias("id"), F.xxhash64("text").alias("text1"), F.xxhash64(F.lit(1), F.col("text")).alias("text2"))
    return F.col(column)


def word_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def taken(column: pa.Array, counts: list[int]) -> pa.Array:
    """A column's values, each repeated as often as counts says."""
    return column.take(pa.array(np.repeat(np.arange(len(counts)), counts)))


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs (doc, text, ...) with the text compressed: it is shuffled by document."""
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in by_size(batches, at, 4_000_000):
            small = pa.array([None if x is None else press(x.encode()) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([small if k == at else batch.column(k) for k in range(len(names))], names=names)

    return docs.mapInArrow(run, schema)


def unpack(press: zstandard.ZstdDecompressor, x: bytes | None) -> bytes:
    return press.decompress(x) if x else b""
