"""Nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots in order of distance. The index is a stored table with a row for each shard: the
shard's vectors, and its inverted files, one for each pivot, that post the vectors which have that pivot in their prefix, with its rank.
Vectors are dealt to shards by a hash of id and components, so the index and its answers don't depend on how rows were partitioned. A
query's prefix is computed once and stored with it. A query reads the inverted files of its own
pivots and sums up, for each vector found there, the footrule distance |rank in query - rank in vector|, where a pivot
that one of them lacks counts as rank ``PREFIX``. The shard's best by footrule are reranked by exact Euclidean distance in
double precision, and the best ``k`` of all shards are the result. Equal vectors of a shard are indexed once, with all their ids, so
copies neither push others out of what is reranked nor get lost; vectors that tie with the last one reranked are reranked too.

Pivots are distinct vectors of a bounded sample (``SAMPLE`` rows at most, lowest hashes of the id), drawn from it at random with a fixed seed;
every row is indexed. Queries go to shards in blocks: a pair of blocks is one row, a task reads a part of the index and a part of the blocks, so neither all pairs nor
all queries meet in one place, and a shard gives at most k rows for a query.

Vectors that are null, zero, of another length than the commonest (the shorter of equals), or hold null or non-finite components take no part, as
queries or candidates; rows with a null id likewise. With fewer candidates than k all are returned, an empty table
returns none. Ties go to the smaller id. Of rows that repeat an id each is a candidate; as a query the id is asked once,
with its smallest vector by component. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import give_back, stored

#: Pivots, length of a permutation's prefix, rows that pivots are drawn from.
PIVOTS, PREFIX, SAMPLE = 256, 64, 4096
#: Vectors of a shard (about) and queries of a block.
SHARD, BLOCK = 8192, 1024
#: Distinct vectors of a shard reranked for a query: as many as this share of its rows, and this many at least, with all that tie.
SHARE, LEAST = 0.08, 300

INDEX = "shard long, width int, ids binary, vectors binary, of binary, begins binary, owners binary, ranks binary"


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def pivots_of(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Distinct vectors of a bounded sample, drawn at random with a fixed seed.

    The sample is written before it is collected: the driver gets its rows once, and not the lowest of every task. Rows that can't be among the lowest
    hashes go first, so that the task that orders the rest reads no more as the table grows.
    """
    order = ["h", "vec_id", "v"]
    lowest = lambda rows: stored(rows.orderBy(*order).limit(sample), "ann-sample")
    keyed = vectors.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v")
    n = vectors.count()
    held = lowest(keyed.filter(F.col("h") < F.lit(2**65 * sample // n - 2**63)) if n > 4 * sample else keyed)
    # hashes of ids that many rows repeat may leave too few
    if n > 4 * sample and held.count() < sample:
        held = lowest(keyed)
    rows = held.orderBy(*order).collect()
    if not rows:
        return np.zeros((0, 0))
    pool = np.array([r.v for r in rows]) + 0.0
    # a repeated pivot tells nothing apart and takes places of the prefix
    pool = pool[np.sort(np.unique(pool, axis=0, return_index=True)[1])]
    return pool[np.random.default_rng(7).permutation(len(pool))[:pivots]]


def nearest_pivots(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector its nearest pivots in order."""
    far = (pivots**2).sum(1) - 2 * v @ pivots.T
    prefix = min(prefix, len(pivots))
    some = np.argpartition(far, prefix - 1, axis=1)[:, :prefix]
    order = np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int32)


def inverted(perms: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted files of prefixes (rows): where each pivot's begins, and the postings, vector and rank, by pivot."""
    order = np.argsort(perms, axis=None, kind="stable")
    owner, rank = np.divmod(order, perms.shape[1])
    return np.searchsorted(perms.ravel()[order], np.arange(pivots + 1)).astype("<i4"), owner.astype("<i4"), rank.astype("<i2")


def footrule(queries: np.ndarray, begins: np.ndarray, owners: np.ndarray, ranks: np.ndarray, n: int) -> np.ndarray:
    """Footrule distances of queries' prefixes (rows) to the n vectors that inverted files post.

    A vector starts at the distance of one that shares no pivot with the query; each posting of a pivot of the query takes
    away what that pivot counts in both and adds the difference of its ranks.
    """
    prefix = queries.shape[1]
    ranks = ranks.astype(np.int32)
    out = np.full((len(queries), n), prefix * (prefix + 1), np.int32)
    for q, own in enumerate(queries):
        for r, pivot in enumerate(own):
            post = slice(begins[pivot], begins[pivot + 1])
            theirs = ranks[post]
            out[q, owners[post]] += np.abs(theirs - r) - (prefix - r) - (prefix - theirs)
    return out


def collapsed(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's distinct vectors, and its rows by (vector, id): number of the vector, and id."""
    bits = np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel()
    _, first, group = np.unique(bits, return_index=True, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((ids, group))
    return v[first], group[order].astype("<i4"), ids[order]


def search_block(q_ids: np.ndarray, q: np.ndarray, perms: np.ndarray, v: np.ndarray, group: np.ndarray, ids: np.ndarray, files: tuple, k: int, share: float, least: int) -> Iterator[tuple]:
    """Best k of a shard (as collapsed() and inverted() give it) for each query: (query id, vector id, distance)."""
    keep = min(len(v), max(least, int(len(ids) * share)))
    place = np.arange(len(ids)) - np.searchsorted(group, group, "left")
    distances = footrule(perms, *files, len(v))
    for j, own in enumerate(q_ids):
        # vectors that tie with the last one kept are kept as well
        near = np.arange(len(v)) if keep == len(v) else np.flatnonzero(distances[j] <= np.partition(distances[j], keep - 1)[keep - 1])
        score = np.full(len(v), np.inf)
        score[near] = np.sqrt(((v[near] - q[j]) ** 2).sum(1))
        taken = np.zeros(len(v), bool)
        taken[near] = True
        # of equal vectors the k smallest ids are enough, besides the query's own
        rows = np.flatnonzero(taken[group] & (ids != own) & (place < k + np.count_nonzero(ids == own)))
        best = rows[np.lexsort((ids[rows], score[group[rows]]))[:k]]
        yield from zip([int(own)] * len(best), ids[best].tolist(), score[group[best]].tolist(), strict=True)


def packed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays]


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, ids and vectors of whole shards, from batches (shard, vec_id, v) sorted by shard."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for shard, group in groupby(rows, key=lambda r: r[0]):
        held = list(group)
        yield shard, np.array([r[1] for r in held], "<i8"), np.array([r[2] for r in held], "<f8")


def dealt(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """vectors (vec_id, v) by the hash of a row in shards of about so many, and the number of shards. vectors: a written table."""
    shards = max(1, -(-vectors.count() // rows))
    return vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), "vec_id", "v").repartition("shard").sortWithinPartitions("shard", "vec_id"), shards


def build(vectors: DataFrame, pivots: np.ndarray, prefix: int = PREFIX, rows: int = SHARD) -> tuple[DataFrame, int]:
    """The stored index of vectors (vec_id, v): a row for each shard, with its inverted files; and the number of shards."""
    sorted_rows, shards = dealt(vectors, rows)
    handed = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in INDEX.split(", ")]
        for shard, ids, v in by_shard(batches):
            alone, group, ids = collapsed(ids, v)
            files = inverted(nearest_pivots(alone, handed.value, prefix), len(handed.value))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([v.shape[1]], pa.int32()), *packed(ids, alone, group, *files)], names=names)
        give_back()

    return stored(sorted_rows.mapInArrow(run, INDEX), "ann-index"), shards


def asked_blocks(queries: DataFrame, pivots: np.ndarray, prefix: int = PREFIX, rows: int = BLOCK) -> DataFrame:
    """Queries (vec_id, v) in stored blocks, with their prefixes."""
    sorted_rows, _ = dealt(queries, rows)
    handed = queries.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, v in by_shard(batches):
            yield pa.RecordBatch.from_arrays(packed(ids, v, nearest_pivots(v, handed.value, prefix)), names=["q_ids", "q", "q_perms"])
        give_back()

    return stored(sorted_rows.mapInArrow(run, "q_ids binary, q binary, q_perms binary"), "ann-queries")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of queries its k nearest of vectors but itself.

    vectors and queries: columns vec_id and embedding.
    """
    spark = vectors.sparkSession
    every = usable(vectors)
    widths = every.groupBy(F.size("v").alias("width")).count().orderBy(F.col("count").desc(), "width").first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths.width
    base = stored(every.filter(F.size("v") == width), "ann-vectors")
    centre = pivots_of(base, pivots)
    prefix = min(prefix, len(centre))
    index, _ = build(base, centre, prefix, shard)
    asked = asked_blocks(stored(usable(queries).filter(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-asked"), centre, prefix)
    # each pair of a block and a shard is a row, met where the stored tables are read: neither is copied by a shuffle, and blocks are broadcast only while
    # their own table is small, not their copies for every shard
    pairs = index.crossJoin(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, q_perms, ids, v, of, begins, owners, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files = (np.frombuffer(begins, "<i4"), np.frombuffer(owners, "<i4"), np.frombuffer(ranks, "<i2"))
                found = list(
                    search_block(
                        np.frombuffer(q_ids, "<i8"), np.frombuffer(q, "<f8").reshape(-1, width), np.frombuffer(q_perms, "<i4").reshape(-1, prefix),
                        np.frombuffer(v, "<f8").reshape(-1, width), np.frombuffer(of, "<i4"), np.frombuffer(ids, "<i8"), files, k, share, least,
                    )
                )
                if found:
                    a, b, c = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])
        give_back()

    near = pairs.select("q_ids", "q", "q_perms", "ids", "vectors", "of", "begins", "owners", "ranks").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
