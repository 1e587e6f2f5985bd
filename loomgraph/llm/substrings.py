"""Substring deduplication by suffix automata.

Every window of ``WINDOW`` consecutive words that also starts earlier (smaller document, or earlier in the same one) is
removed. Equal windows must meet without comparing all texts with all others:

1. Each window picks its minimiser, the ``GRAM`` consecutive words in it with the least hash, so equal windows pick equal ones. Neighbouring
   windows share theirs; the text under the windows of one minimiser is a *zone*, and zones tile the text's windows.
2. Zones meet by their minimiser's hash. A zone whose whole text stood earlier is removed at once (most copied text). Zones that share a
   minimiser but differ, which happens at the borders of copied passages, go on.
3. These form reference shards, one for each minimiser: zones in order are streamed through the suffix automaton of
   those before them, whose matching statistics mark every window that ends a match of ``WINDOW`` words or more; then the zone's own
   words extend the automaton. Runs of marked windows are the maximal spans removed.

The automata are sent to the texts that can match them and no others, by shuffling both on the minimiser: the reference
of a corpus against itself has no size bound, so broadcasting all its automata to all documents would not scale. A bounded
reference (a benchmark) is broadcast: see ``matches``.

Groups stay bounded. A minimiser that stands ``HOT_ROWS`` times and in a 100,000th of all zones is hot: tasks count minimisers over all their
rows, and sums of what they report find each such one (a task leaves out those it meets under ``LOCAL`` times, which the bound allows for). There are
200,000 hot ones at most, broadcast; their zones are pre-aggregated in as many salts as their count asks for. Where more than ``SHARD_ZONES``
different zones share a minimiser, their windows meet one by one by hash, aggregated before shuffling; nothing is dropped.

Words are compared by hashes: 64 bits for the minimiser and 64 for what is compared under one minimiser, so two windows that differ are taken for
equal with a probability of about 2 ** -128 a pair under different minimisers, 2 ** -64 under one. Null texts count as empty, texts under ``WINDOW``
words lose nothing, rows that repeat an id and text are one document, null ids come last, very long texts are whole, empty tables give
empty results, extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import by_size, document_key, give_back, packed_texts, release, stored, taken, unpack, word_hashes, words

#: Words of a window and of a minimiser.
WINDOW, GRAM = 20, 6
#: Rows from which on a minimiser is hot, at least, and rows of a salt of a hot one; zones of a shard.
HOT_ROWS, SHARD_ZONES = 10_000, 2_000
#: Times that a minimiser stands in a task before the task reports it, and minimisers that a task counts at once.
LOCAL, COUNTED = 16, 2_000_000

ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def zones(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Zones of a text's word hashes: minimiser's hash, hash of the zone's words, first window, minimiser's offset, windows."""
    n = len(h)
    m = n - gram + 1
    g = np.zeros(m, np.uint64)
    for j in range(gram):
        g += h[j : j + m] * ODD[j]
    g = mix(g)
    chosen = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(1) + np.arange(n - window + 1)
    edges = np.flatnonzero(np.diff(chosen)) + 1
    first = np.concatenate([[0], edges])
    last = np.concatenate([edges, [n - window + 1]]) - 1
    at = chosen[first]
    sums = prefix_sums(h)
    text = segment(sums, first, last + window, n)
    shape = ((at - first) * 64 + (last - first)).astype(np.uint64)
    return g[at], mix(text ^ mix(shape + np.uint64(1))), first, at - first, last - first + 1


def prefix_sums(h: np.ndarray) -> np.ndarray:
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, len(h) - 1), BASE, np.uint64)])) if len(h) else np.zeros(0, np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)])


def segment(sums: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of [start, end), equal for equal words wherever they stand."""
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, INVERSE, np.uint64)]))
    return (sums[end] - sums[start]) * back[start]


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word hashes."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: Iterable[int]) -> None:
        """Insert a sequence; its factors are found from then on."""
        last = 0
        for c in sequence:
            last = self.extend(last, c)

    def extend(self, last: int, c: int) -> int:
        step, link, length = self.next, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self.split(last, q, c)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self.split(p, q, c)
        return new

    def split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the factors no longer than what leads over p."""
        step, link, length = self.next, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def statistics(self, sequence: Iterable[int]) -> list[int]:
        """For each place, the length of the longest match with an inserted sequence that ends there."""
        step, link, length = self.next, self.link, self.length
        state = held = 0
        out = []
        for c in sequence:
            while state and c not in step[state]:
                state = link[state]
                held = length[state]
            if c in step[state]:
                state = step[state][c]
                held += 1
            out.append(held)
        return out


def spans(statistics: list[int], window: int) -> list[tuple[int, int]]:
    """Runs (first window, number of windows) of places where a match of window words or more ends."""
    out: list[tuple[int, int]] = []
    for k, size in enumerate(statistics):
        if size >= window:
            start = k - window + 1
            if out and out[-1][0] + out[-1][1] == start:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((start, 1))
    return out


def matches(docs: DataFrame, reference: list[str], window: int = WINDOW, most_words: int = 2_000_000) -> DataFrame:
    """Spans of docs (doc_id, start, n windows) that stand in a bounded reference, whose automaton is broadcast.

    The reference is refused beyond most_words words.
    """
    sequences = [word_hashes(words(x)).tolist() for x in reference]
    if sum(map(len, sequences)) > most_words:
        raise ValueError("the reference is too large to broadcast")
    automaton = SuffixAutomaton()
    for one in sequences:
        automaton.add(one)
    handed = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, s, n) for d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s, n in spans(handed.value.statistics(word_hashes(words(x)).tolist()), window)]
            yield pa.RecordBatch.from_pylist([{"doc_id": d, "start": s, "n": n} for d, s, n in found], schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, n long")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def zone_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (doc, gram, zone, start, n) of every zone of docs (doc, text)."""
    schema = T.StructType([docs.schema["doc"], *(T.StructField(x, T.LongType()) for x in ("gram", "zone", "start", "n"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 1, 8_000_000):
            parts, counts = [], []
            for text in part.column(1).to_pylist():
                found = words(text)
                counts.append(0)
                if len(found) >= window:
                    g, z, first, _, n = zones(word_hashes(found), window, gram)
                    parts.append((g, z, first, n))
                    counts[-1] = len(g)
            if parts:
                g, z, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([taken(part.column(0), counts), signed(g), signed(z), pa.array(first.astype(np.int64)), pa.array(n.astype(np.int64))], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of parts (values, counts), with the sums of their counts."""
    values, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts[order], first)


def hot_grams(docs: DataFrame, window: int, gram: int, hot_rows: int) -> DataFrame:
    """Rows (hot, salts) of minimisers that stand in hot_rows zones and in a 100,000th of them: 200,000 at most.

    Tasks report what they meet LOCAL times, and by how much that may fall short. Less that, or half of it at most, is the bound that sums of
    reports are held against, so a minimiser that isn't found stands no more often than the bound and what tasks left out of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total, lost, size = 0, LOCAL - 1, 0
        for part in by_size(batches, 0, 8_000_000):
            parts = [zones(word_hashes(found), window, gram)[0] for x in part.column(0).to_pylist() if len(found := words(x)) >= window]
            if parts:
                held.append(np.unique(np.concatenate(parts), return_counts=True))
                total += int(held[-1][1].sum())
                size += len(held[-1][0])
            while size > COUNTED:
                values, counts = summed(held)
                if len(values) > COUNTED // 2:  # the rarest go; what is reported may fall short by as much more
                    least = int(counts.min())
                    values, counts, lost = values[counts > least], counts[counts > least], lost + least
                held, size = [(values, counts)], len(values)
        if total:
            values, counts = summed(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            some = counts >= LOCAL
            n = np.concatenate([[total], counts[some]]).astype(np.int64)
            short = np.zeros(len(n), np.int64)
            short[0] = lost
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, pa.int64()), signed(values[some])]), pa.array(n), pa.array(short)], names=["hot", "n", "short"])

    counted = stored(docs.select("text").mapInArrow(run, "hot long, n long, short long").groupBy("hot").agg(F.sum("n").alias("n"), F.sum("short").alias("short")), "dedup-hot")
    whole = counted.filter("hot IS NULL").first()
    bound = max(hot_rows, (whole.n if whole else 0) // 100_000 + 1)
    least = max(bound - (whole.short if whole else 0), (bound + 1) // 2)
    return counted.filter(F.col("hot").isNotNull() & (F.col("n") >= least)).select("hot", F.ceil(F.col("n") / hot_rows).cast("long").alias("salts"))


def zone_words(wanted: DataFrame, window: int) -> DataFrame:
    """Word hashes of the wanted zones: rows (gram, doc, start, hashes) from (doc, text, zones: array of gram, start, n, crowded);
    of crowded minimisers a row for each window, with its hash alone."""
    schema = T.StructType([T.StructField("gram", T.LongType()), wanted.schema["doc"], T.StructField("start", T.LongType()), T.StructField("crowded", T.BooleanType()), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for part in by_size(batches, 1, 1_000_000):
            grams, starts, crowds, hashes, counts = [], [], [], [], []
            for text, zs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                h = word_hashes(unpack(press, text).split())
                sums = prefix_sums(h)
                before = len(grams)
                for z in zs:
                    first, n = z["start"], z["n"]
                    if z["crowded"]:
                        at = np.arange(first, first + n)
                        one = segment(sums, at, at + window, len(h)).view(np.int64)
                        grams += [z["gram"]] * n
                        starts += at.tolist()
                        crowds += [True] * n
                        hashes += [one[k : k + 1] for k in range(n)]
                    else:
                        grams.append(z["gram"])
                        starts.append(first)
                        crowds.append(False)
                        hashes.append(h[first : first + n + window - 1].view(np.int64))
                counts.append(len(grams) - before)
            if grams:
                offsets = pa.array(np.cumsum([0, *map(len, hashes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hashes)))
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), taken(part.column(0), counts), pa.array(starts, pa.int64()), pa.array(crowds), lists], names=schema.fieldNames())

    return wanted.select("doc", "text", "zones").mapInArrow(run, schema)


def stream_shards(rows: DataFrame, window: int) -> DataFrame:
    """Spans (doc, start, n) that zones have in common with those before them under the same minimiser; one automaton a minimiser."""
    schema = T.StructType([rows.schema["doc"], T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, (g, s, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                yield g, batch.column(1), k, s, h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, starts, counts = [], [], []
        for _, group in groupby(flat(batches), key=lambda x: x[0]):
            automaton = None
            for _, column, k, start, hashes in group:
                if automaton is None:
                    automaton = SuffixAutomaton()
                else:
                    for first, n in spans(automaton.statistics(hashes), window):
                        docs.append(column.slice(k, 1))
                        starts.append(start + first)
                        counts.append(n)
                automaton.add(hashes)
            if len(docs) > 5000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=schema.fieldNames())
                docs, starts, counts = [], [], []
        if docs:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=schema.fieldNames())
        give_back()

    return rows.repartition("gram").sortWithinPartitions("gram", "doc", "start").select("gram", "doc", "start", "hashes").mapInArrow(run, schema)


def not_first(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows (keys, doc, start, ...) the first of each key by (doc, start), and the others; aggregated before shuffling."""
    first = rows.groupBy(*keys).agg(F.min(F.struct("doc", "start")).alias("__first"))
    marked = rows.join(first, keys)
    here = F.struct("doc", "start")
    return marked.filter(here == F.col("__first")).drop("__first"), marked.filter(here != F.col("__first")).drop("__first")


def repeated_spans(keyed: DataFrame, texts: DataFrame, window: int, gram: int, hot_rows: int, shard_zones: int) -> DataFrame:
    """Rows (doc, start, n): n windows from start on that also start earlier."""
    hot = hot_grams(keyed, window, gram, hot_rows)
    rows = zone_rows(keyed, window, gram).join(F.broadcast(hot), F.col("gram") == F.col("hot"), "left")
    rows = rows.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("doc"), F.col("salts"))).otherwise(F.lit(-1))).drop("salts")
    rows = rows.repartition("gram", "salt")  # serves both windows below, whose one sort it shares
    same = Window.partitionBy("gram", "salt", "zone").orderBy("doc", "start")
    group = Window.partitionBy("gram", "salt")
    ranked = rows.withColumn("rn", F.row_number().over(same)).withColumn("different", F.sum((F.col("rn") == 1).cast("int")).over(group)).withColumn("all", F.count("*").over(group))
    kind = (
        F.when(F.col("rn") > 1, "whole")
        .when(F.col("salt") >= 0, "hot")
        .when(F.col("different") > shard_zones, "crowded")
        .when(F.col("different") > 1, "shard")
    )
    found = stored(ranked.filter((F.col("all") > 1) | (F.col("salt") >= 0)).withColumn("kind", kind).filter("kind IS NOT NULL").select("kind", "gram", "zone", "doc", "start", "n"), "dedup-zones")
    release(keyed.sparkSession)
    whole = found.filter("kind = 'whole'").select("doc", "start", "n")
    first, later = not_first(found.filter("kind = 'hot'").drop("kind"), ["gram", "zone"])
    open_zones = found.filter("kind IN ('shard', 'crowded')").select("doc", F.struct("gram", "start", "n", (F.col("kind") == "crowded").alias("crowded")).alias("z"))
    open_zones = open_zones.unionByName(first.select("doc", F.struct("gram", "start", "n", F.lit(True).alias("crowded")).alias("z")))
    wanted = open_zones.groupBy("doc").agg(F.collect_list("z").alias("zones")).join(texts.select("doc", "text"), "doc")
    content = stored(zone_words(wanted, window), "dedup-words")
    partial = stream_shards(content.filter("NOT crowded").select("gram", "doc", "start", "hashes"), window)
    single = content.filter("crowded").select("gram", F.col("hashes")[0].alias("hash"), "doc", "start")
    _, again = not_first(single, ["gram", "hash"])
    return whole.unionByName(later.select("doc", "start", "n")).unionByName(partial).unionByName(again.select("doc", "start", F.lit(1).cast("long").alias("n")))


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS, shard_zones: int = SHARD_ZONES) -> DataFrame:
    """docs (doc_id, text, ...) with the text's remaining words joined by one space where words were removed, and else as it was, and
    with n_words, n_removed (of the input) and removed (boolean); a column of docs named so gives way."""
    extra = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "removed")]
    keyed = docs.select(document_key(docs).alias("doc"), "text", *(F.col(c).alias(f"x_{c}") for c in extra)).filter(F.col("doc").isNotNull())
    texts = packed_texts(keyed)
    found = repeated_spans(keyed.select("doc", "text"), texts, window, gram, hot_rows, shard_zones)
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = texts.join(by_doc, "doc", "left").select("text", "spans", *(f"x_{c}" for c in extra))
    fields = [T.StructField(c, keyed.schema[f"x_{c}"].dataType) for c in extra]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for part in by_size(batches, 0, 1_000_000):
            texts_out, totals, gone = [], [], []
            for text, cuts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = unpack(press, text)
                found = raw.split()
                edge = np.zeros(len(found) + 1, np.int64)
                if cuts:
                    at = np.array([(c["start"], c["n"]) for c in cuts])
                    np.add.at(edge, at[:, 0], 1)
                    np.add.at(edge, at[:, 0] + at[:, 1] + window - 1, -1)
                under = np.cumsum(edge[:-1]) > 0
                lost = int(under.sum())
                texts_out.append(raw.decode() if not lost else b" ".join([found[k] for k in np.flatnonzero(~under)]).decode())
                totals.append(len(found))
                gone.append(lost)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in range(2, 2 + len(extra))), pa.array(texts_out, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array([x > 0 for x in gone])],
                names=schema.fieldNames(),
            )

    return joined.mapInArrow(run, schema)
