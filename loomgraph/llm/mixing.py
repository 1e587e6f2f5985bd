"""Mixing sources to target weights by entropy balancing.

Rates r(d) of documents are sought that stay closest to 1 in relative entropy, every document counting alike, while every
source's tokens meet a target: minimise sum r log r - r + 1 subject to sum over the source of size * r = target and r <= ``MOST``.
The convex dual has a multiplier for each source, and the rates are exponentially tilted by size:
r(d) = min(MOST, exp(multiplier of d's source * size / mean size of the source)): a source that must grow repeats its longer documents
more often, one that must shrink drops them first, as that changes the fewest documents. A source whose target is MOST times its
size takes every document so often.

Newton iterations solve the dual: each aggregates the tilted tokens and their derivative over the documents' sizes, distributed, after the
documents are summed up by (source, size), which loses nothing; multipliers stay a distributed table as well, since the
number of sources has no bound. A step that leaves the bracket known so far is replaced by bisection, so that every source converges; if
one has not after ``STEPS``, the mix stops with an error.

Rates become whole copies by error diffusion: documents of one source, dealt by a hash into groups of about
``GROUP_ROWS``, take floor(r) or one more copies in descending order of size, whichever keeps the group's words nearest
to its tilted words. Rows equal in id and text are counted before that, so they are one row of a group, however many they are. A rate
is 3 at most, so no document is taken more than 3 times. Equal inputs give equal copies: order and
dealing depend on document ids, sizes and texts' hashes alone.

Null or empty texts have size 0 and take nothing; a null source is a source of its own, the last; rows that repeat are
documents of their own; empty tables give empty results; very long texts are whole; targets that the words cannot meet exactly are met within half
of the smallest document of a group. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import WORD, cut, stored

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a document.
MOST = 3
#: Documents of a source that are rounded together, about.
GROUP_ROWS = 20_000
#: Newton stops when every source is within this share of its target; not to get there in so many steps is an error.
TOLERANCE, STEPS = 1e-7, 80
#: Copies of one row that a task writes.
REPEATED = 100_000


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """rows with sums over all rows before each one in order, as columns of those names; no task sees more than a range of the rows."""
    spread = stored(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), name)
    here = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy("__p").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    parts = parts.select("__p", *(F.coalesce(F.sum(f"__{k}").over(ahead), F.lit(0)).alias(f"__{k}") for k in sums))
    out = spread.join(F.broadcast(parts), "__p")
    return out.select(*rows.columns, *((F.col(f"__{k}") + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(k) for k, c in sums.items()))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A target for each row (source, source_size, ...): shares of all words by weight, none above most times the source.

    Capped sources pass their excess to the others by weight until none is above, which is water-filling: with level t, each
    target is least(weight * t, most * source_size). Sorted by the level at which a source caps, running sums give t.
    """
    named = [F.col("source").isNull(), F.col("source")]
    table = F.array(*(F.lit(float(w)) for w in weights))
    ranked = running(by_source, named, {"place": F.lit(1)}, "mix-sources").withColumn("weight", F.get(table, (F.col("place") % len(weights)).cast("int")))
    ranked = ranked.withColumn("level", F.col("source_size") * most / F.col("weight"))
    summed = running(ranked, [F.col("level"), *named], {"capped": F.col("source_size") * most, "spent": F.col("weight")}, "mix-levels")
    every = ranked.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    # with the sources before this one capped, the rest share what is left; the first (and largest) that does not pass its own cap is the level
    free = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("spent"))
    summed = summed.join(F.broadcast(every), F.lit(True)).withColumn("free", free)
    fixed = summed.agg(F.max(F.when(F.col("free") <= F.col("level"), F.col("free"))).alias("fixed"))
    found = F.least(F.col("weight") * F.col("fixed"), F.col("source_size") * F.lit(float(most)))
    return summed.join(F.broadcast(fixed), F.lit(True)).select(*by_source.columns, F.coalesce(found, F.lit(0.0)).alias("target"))


def tilted(tilt: Column, most: int) -> Column:
    """The rate at a tilt (multiplier times relative size)."""
    return F.least(F.exp(tilt), F.lit(float(most)))


def solve(sizes: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """The dual's multipliers: rows (of, mean, multiplier) of sources with words. sizes: (source, size, n); goal: (source, source_size, rows, target).

    A source whose target is most times its size, within the tolerance, has the multiplier infinity.
    """
    base = goal.filter("source_size > 0").select(F.col("source").alias("of"), (F.col("source_size") / F.col("rows")).alias("mean"), "source_size", F.col("target").cast("double").alias("target"))
    full = F.col("target") >= F.col("source_size") * F.lit(most * (1 - TOLERANCE))
    none = F.lit(None).cast("double")
    state = cut(base.select("of", "mean", "target", F.when(full, float("inf")).otherwise(F.lit(0.0)).alias("multiplier"), none.alias("low"), none.alias("high"), full.alias("done")))
    unit = F.col("size") / F.col("mean")
    for _ in range(STEPS):
        open_sources = state.filter("NOT done")
        if not open_sources.limit(1).count():
            return state.select("of", "mean", "multiplier")
        free = F.exp(F.col("multiplier") * unit)
        words = F.col("size").cast("double") * F.col("n")
        sums = (
            sizes.filter("size > 0")
            .join(open_sources, F.col("source").eqNullSafe(F.col("of")))
            .groupBy("of", "mean", "target", "multiplier", "low", "high")
            .agg(F.sum(words * F.least(free, F.lit(float(most)))).alias("tokens"), F.sum(F.when(free < most, words * unit * free).otherwise(0.0)).alias("slope"))
        )
        short = F.col("tokens") < F.col("target")
        low, high = F.when(short, F.col("multiplier")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("multiplier"))
        step = F.col("multiplier") + F.when(F.col("slope") > 0, (F.col("target") - F.col("tokens")) / F.col("slope"))
        held = sums.withColumn("low", low).withColumn("high", high).withColumn("step", step)
        # outside the bracket, or where no document's rate moves: the middle, or twice as far where the bracket is open
        inside = F.col("step").isNotNull() & F.coalesce(F.col("step") > F.col("low"), F.lit(True)) & F.coalesce(F.col("step") < F.col("high"), F.lit(True)) & (F.abs(F.col("step") - F.col("multiplier")) <= 4)
        away = F.when(short, F.coalesce((F.col("low") + F.col("high")) / 2, F.col("multiplier") + 1 + F.abs("multiplier"))).otherwise(F.coalesce((F.col("low") + F.col("high")) / 2, F.col("multiplier") - 1 - F.abs("multiplier")))
        done = F.abs(F.col("tokens") - F.col("target")) <= F.col("target") * TOLERANCE
        moved = held.select("of", "mean", "target", F.when(done, F.col("multiplier")).when(inside, F.col("step")).otherwise(away).alias("multiplier"), "low", "high", done.alias("done"))
        state = cut(moved.unionByName(state.filter("done")))
    raise RuntimeError(f"entropy balancing has not converged in {STEPS} steps")


def round_group(rows: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For a group's documents, each n times there, the copies of every one and how many take one more: error diffusion in
    descending order of size; ties by hash of the id, then of id and text."""
    size, rate, n = (rows[c].to_numpy() for c in ("size", "rate", "n"))
    order = np.lexsort((rows["row_hash"].to_numpy(), rows["order"].to_numpy(), -size))
    low = np.minimum(np.floor(rate + 1e-9), most).astype(np.int64)
    part = np.where((low < most) & (rate - low > 1e-9), rate - low, 0.0)
    more, owed = np.zeros(len(size), np.int64), 0.0
    for k in order.tolist():
        if part[k] and size[k]:
            owed += n[k] * size[k] * part[k]
            more[k] = min(n[k], max(0, int(np.floor(owed / size[k] + 0.5))))
            owed -= more[k] * size[k]
    return low, more


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, rate, copies, row_hash) for every document of docs.

    row_hash is xxhash64 of id and text: it finds a document again where ids repeat with other texts.
    """
    base = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("row_hash"))
    base = stored(base.groupBy("doc_id", "source", "size", "row_hash").agg(F.count("*").alias("n")), "mix-sizes")
    sizes = cut(base.groupBy("source", "size").agg(F.sum("n").alias("n")))
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    goal = cut(targets(by_source, weights, most))
    multipliers = solve(sizes, goal, most)
    distinct = base.groupBy("source").agg(F.count("*").alias("distinct")).withColumnRenamed("source", "counted")
    plan = cut(
        goal.join(multipliers, F.col("source").eqNullSafe(F.col("of")), "left")
        .join(distinct, F.col("source").eqNullSafe(F.col("counted")))
        .select(F.col("source").alias("named"), "source_size", "target", "mean", "multiplier", F.ceil(F.col("distinct") / group_rows).cast("long").alias("groups"))
    )
    rate = F.when(F.col("size") > 0, tilted(F.col("multiplier") * F.col("size") / F.col("mean"), most)).otherwise(0.0)
    dealt = base.join(plan, F.col("source").eqNullSafe(F.col("named"))).select(
        "doc_id", "source", "size", "source_size", "target", "row_hash", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"), F.pmod("row_hash", F.col("groups")).alias("dealt"), F.xxhash64("doc_id").alias("order")
    )
    kept = ["doc_id", "source", "size", "source_size", "target", "rate", "row_hash", "n"]
    schema = T.StructType([*(dealt.schema[c] for c in kept), T.StructField("low", T.LongType()), T.StructField("more", T.LongType())])

    def run(rows: pa.Table) -> pa.Table:
        low, more = round_group(rows, most)
        return rows.select(kept).append_column("low", pa.array(low)).append_column("more", pa.array(more))

    rounded = dealt.groupBy("source", "dealt").applyInArrow(run, schema)
    # one row for each document again: rows that repeat often are written by several tasks
    single = rounded.filter("n = 1").withColumn("copies", F.col("low") + F.col("more"))
    chunks = rounded.filter("n > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATED)))).repartition("doc_id", "row_hash", "chunk")
    place = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * REPEATED, F.least(F.col("n"), (F.col("chunk") + 1) * REPEATED) - 1)))
    repeated = place.withColumn("copies", F.col("low") + (F.col("k") < F.col("more")).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "rate", "copies", "row_hash"]
    return single.select(*columns).unionByName(repeated.select(*columns))
