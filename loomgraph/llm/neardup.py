"""Near duplicates by a chosen-path set similarity join.

A document's set holds its distinct shingles of five words (lower-cased A-Z); two documents are linked if
100 * intersection >= 75 * union. Equal sets are one representative from the start. Each set is embedded as minwise tokens
(coordinate, least hash). From the root of each of ``TREES`` independent trees, representatives branch: a node chooses one or two of
``COORDINATES`` coordinates, the same for all its members, and members that hold the same token there go to the same child. Sets of
similarity s keep s common choices of each one, so similar pairs survive and others part. Nodes of at most ``SMALL`` members are compared
exhaustively by sketches (``SKETCH`` coordinates, four bits each); larger ones branch again, up to ``DEPTH`` levels, and what is
still large then is compared in blocks, exhaustively as well. At similarity 0.75 a tree finds a pair at the first level with probability 0.84,
at the sixth with 0.58; ten trees miss one with probability 1e-8 to 2e-4.

Candidates whose sketches put the similarity under a floor are dropped: ``NEAR``, 3.9 standard deviations below 0.75, or ``NEAR_FEW`` if either set has
``FEW_SHINGLES`` at most, as sketches of small sets spread wider. Of 900,000 random pairs at exactly 0.75 of 3 and 4, 6 and 8, 9 and 12 shingles
none fell under it; of larger sets about 1 in 20,000 at exactly 0.75 falls under NEAR and is lost unless other texts link the two. Others are confirmed on
their full shingle sets, recomputed from the texts. So that groups of copies don't give all their pairs, it goes in two rounds:

1. Nodes give spanning forests of their candidates (large nodes: links to their least member); these are confirmed and joined into
   components. From then on only large nodes that hold several components branch, and forests only span components.
2. Forests and stars of all levels join documents into clouds: every candidate of any node lies in one cloud. A cloud of several components is
   compared exhaustively once, across components alone, in pairs of blocks; the candidates are confirmed and complete the components.

Null, empty and word-less texts have the empty set and are linked with nothing; under five words the whole sequence is the one
shingle. Rows equal in id and text are one document; null ids come last. Texts are whole. Empty tables give empty results.
Shingles are told apart by 64-bit hashes. Neither links nor components reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import by_size, document_key, give_back, lower_ascii, packed_texts, release, stored, unpack, word_hashes
from loomgraph.llm.components import components, in_few
from loomgraph.llm.substrings import ODD, mix

#: Words of a shingle; least similarity in percent.
SHINGLE, PERCENT = 5, 75
#: Minwise tokens, trees, levels, members of a node that is compared at once, members of a block of a larger one.
COORDINATES, TREES, DEPTH, SMALL, BLOCK = 64, 10, 6, 8192, 1024
#: Coordinates of a sketch, and least similarity by sketches of a candidate.
SKETCH, NEAR = 512, 0.67
#: Shingles of a small set, and the least similarity by sketches where one is small.
FEW_SHINGLES, NEAR_FEW = 16, 0.62
#: Similarity by sketches of the candidates that a forest takes first; candidates of others that are ranked at once.
STRONG, RANKED = 0.85, 500_000
#: Documents whose texts are told from the rest by a broadcast of their ids, at most; more are joined like any table.
FEW = 2_000_000
#: Members confirmed against one document in a task, about.
MEMBERS = 256

_draw = np.random.default_rng(23)
MULTIPLIERS = _draw.integers(1, 2**31, SKETCH).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a lower-cased text's shingles."""
    found = raw.split()
    if not found:
        return np.zeros(0, np.uint64)
    h = word_hashes(found)
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(size, len(h))):
        out += h[j : j + n] * ODD[j]
    if len(h) < size:
        out += np.uint64(len(h))
    return np.unique(mix(out))


def minwise(one: np.ndarray) -> tuple[bytes, bytes]:
    """A set's tokens (32 bits of COORDINATES coordinates) and its sketch (four bits of SKETCH ones, and a byte that tells small sets)."""
    x = (one >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * MULTIPLIERS[None, :]).min(0), out=least)
    low = (least & np.uint32(15)).astype(np.uint8)
    return least[:COORDINATES].astype("<u4").tobytes(), (low[::2] << 4 | low[1::2]).tobytes() + bytes([len(one) <= FEW_SHINGLES])


def signatures(docs: DataFrame) -> DataFrame:
    """Rows (doc, n, set1, set2, tokens, sketch) from docs (doc, text): set size, 128 bits that tell sets apart, minwise tokens and sketch."""
    longs = [T.StructField(x, T.LongType()) for x in ("n", "set1", "set2")]
    schema = T.StructType([docs.schema["doc"], *longs, T.StructField("tokens", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 1, 8_000_000):
            rows = []
            for text in part.column(1).to_pylist():
                one = shingles(lower_ascii(text))
                sums = np.array([one.sum(dtype=np.uint64), mix(one + np.uint64(77)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                rows.append((len(one), int(sums[0]), int(sums[1]), *(minwise(one) if len(one) else (b"", b""))))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def choices(node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For nodes, the coordinates each chooses: pairs of (which nodes, coordinate); one or two, at even odds."""
    x = mix(node + np.uint64(1))
    first = (x % np.uint64(COORDINATES)).astype(np.int64)
    second = ((x >> np.uint64(20)) % np.uint64(COORDINATES)).astype(np.int64)
    every = np.arange(len(node))
    more = np.flatnonzero((x >> np.uint64(40)) % np.uint64(2) == 1)
    more = more[second[more] != first[more]]
    return [(every, first), (more, second[more])]


def branch(node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of rows (node, tokens): which row, child node."""
    rows, children = [], []
    for which, coordinate in choices(node):
        token = tokens[which, coordinate].astype(np.uint64) + (coordinate.astype(np.uint64) << np.uint64(32))
        rows.append(which)
        children.append(mix(node[which] ^ mix(token + np.uint64(0x51ED27))))
    return np.concatenate(rows), np.concatenate(children)


def as_tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def branched(rows: DataFrame, trees: int = 0) -> DataFrame:
    """Rows (node, doc) of the children of rows (node, doc, tokens); with trees, of so many roots for rows (doc, tokens)."""
    schema = T.StructType([T.StructField("node", T.LongType()), rows.schema["doc"]])
    roots = mix(np.arange(1, trees + 1).astype(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = as_tokens(batch.column(1))
            starts = [np.full(batch.num_rows, r, np.uint64) for r in roots] if trees else [batch.column(2).to_numpy().view(np.uint64)]
            for node in starts:
                which, child = branch(node, tokens)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(0).take(pa.array(which))], names=["node", "doc"])
        give_back()

    return rows.select("doc", "tokens", *([] if trees else ["node"])).mapInArrow(run, schema)


def as_sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH // 2 + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities by sketches; four bits agree by chance in a sixteenth of the places."""
    apart = a[:, : SKETCH // 2] ^ b[:, : SKETCH // 2]
    equal = (((apart & 15) == 0).sum(1) + ((apart & 240) == 0).sum(1)) / SKETCH
    return (equal - 1 / 16) / (15 / 16)


def candidate(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Whether likenesses reach the floor of their pairs."""
    return share >= np.where((a[:, -1] | b[:, -1]) > 0, NEAR_FEW, NEAR)


def neighbours(node: np.ndarray, d: int, side: np.ndarray) -> np.ndarray:
    """Rows whose d-th next row lies in their node, on another side (a negative side is none); rows are sorted by node."""
    i = np.flatnonzero(node[:-d] == node[d:])
    return i[(side[i] < 0) | (side[i] != side[i + d])] if len(i) else i


def close_pairs(node: np.ndarray, sketches: np.ndarray, part: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All candidate pairs of rows of one node that lie in different parts."""
    ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, len(node)):
        if not (node[:-d] == node[d:]).any():
            break
        i = neighbours(node, d, side)
        i = i[part[i] != part[i + d]]
        for at in range(0, len(i), 20_000):
            some = i[at : at + 20_000]
            some = some[candidate(sketches[some], sketches[some + d], likeness(sketches[some], sketches[some + d]))]
            ones.append(some)
            twos.append(some + d)
    return np.concatenate(ones), np.concatenate(twos)


def spanning(node: np.ndarray, sketches: np.ndarray, part: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs that span, with the parts, whatever all candidate pairs of a node would.

    Strong ones come first as they are met; then others by descending likeness, RANKED at a time. Rows that are joined already aren't compared.
    """
    _, tree = np.unique(np.stack([node, part], 1), axis=0, return_inverse=True)
    tree = tree.ravel().copy()
    first = np.searchsorted(node, node, "left")
    end = np.searchsorted(node, node, "right")
    pairs: list[tuple[int, int]] = []

    def join(ones: np.ndarray, twos: np.ndarray) -> None:
        for a, b in zip(ones.tolist(), twos.tolist(), strict=True):
            if tree[a] != tree[b]:
                own = tree[first[a] : end[a]]
                own[own == tree[b]] = tree[a]
                pairs.append((a, b))

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rank() -> None:
        if held:
            share, ones, twos = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(-share, kind="stable")
            join(ones[order], twos[order])
            held.clear()

    for strong in (True, False):
        size = 0
        for d in range(1, len(node)):
            if not (node[:-d] == node[d:]).any():
                break
            i = neighbours(node, d, side)
            i = i[tree[i] != tree[i + d]]
            for at in range(0, len(i), 20_000):
                some = i[at : at + 20_000]
                share = likeness(sketches[some], sketches[some + d])
                good = share >= STRONG if strong else candidate(sketches[some], sketches[some + d], share)
                if strong:
                    join(some[good], some[good] + d)
                elif good.any():
                    held.append((share[good], some[good], some[good] + d))
                    size += int(good.sum())
            if size >= RANKED:
                rank()
                size = 0
    rank()
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def whole_nodes(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole nodes from batches sorted by node (column 0)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            node = table.column(0).to_numpy()
            edges = np.flatnonzero(node[1:] != node[:-1])
            if len(edges):
                stop = int(edges[-1]) + 1
                yield table.slice(0, stop)
                held = table.slice(stop).combine_chunks().to_batches()
                size = table.num_rows - stop
                del table
                give_back()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    give_back()


def compare_nodes(rows: DataFrame, every: bool) -> DataFrame:
    """Candidate pairs (a, b) across the parts of each node: all of them, or a spanning forest. rows: (node, doc, sketch, part, side)."""
    kind = rows.schema["doc"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_nodes(batches):
            node, part = table.column(0).to_numpy(), table.column(3).to_numpy()
            docs = table.column(1).combine_chunks()
            i, j = (close_pairs if every else spanning)(node, as_sketches(table.column(2)), part, table.column(4).to_numpy())
            if len(i):
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(i)), docs.take(pa.array(j))], names=["a", "b"])

    return rows.select("node", "doc", "sketch", "part", "side").repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


def near_pairs(rows: DataFrame) -> DataFrame:
    """Of rows (a, b, sketch, other) the candidate pairs."""
    kind = rows.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ones, twos = as_sketches(batch.column(2)), as_sketches(batch.column(3))
                good = candidate(ones, twos, likeness(ones, twos))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return rows.select("a", "b", "sketch", "other").mapInArrow(run, schema)


def stars(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of each large node's least member with others of other parts; least members are found before shuffling."""
    centre = rows.groupBy("node").agg(F.min(F.struct("doc", "sketch", "part")).alias("least"))
    joined = rows.join(centre, "node").filter(F.col("part") != F.col("least.part"))
    return near_pairs(joined.select(F.col("least.doc").alias("a"), F.col("doc").alias("b"), "sketch", F.col("least.sketch").alias("other")))


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (node, doc, sketch, part, size), each once for every pair of blocks of its node that it lies in: node then names that pair, and
    side the block, or -1 where a block meets itself."""
    cells = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    dealt = rows.withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("doc"), F.col("cells")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    side = F.when(F.col("cell") == F.col("other"), -1).otherwise(F.col("cell")).cast("long")
    return met.withColumn("side", side).withColumn("node", F.xxhash64("node", F.least("cell", "other"), F.greatest("cell", "other")))


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts that pairs name. If these are FEW at most, their ids are broadcast, so that other texts aren't shuffled."""
    ends = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    wanted = stored(in_few(ends, 2 * pairs.count()), "near-wanted")
    return texts if wanted.count() > FEW else texts.join(F.broadcast(wanted), "doc", "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough. pairs: a written table; texts: (doc, text compressed).

    Members b are confirmed against their a; an a with more than MEMBERS of them is salted, so each text travels once for each pair and
    an a once for each salt.
    """
    kind = pairs.schema["a"].dataType
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > MEMBERS).select("a", F.ceil(F.col("n") / MEMBERS).alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0))
    dealt = pairs.join(stored(in_few(many, pairs.count() // MEMBERS), "near-many"), "a", "left").select("a", "b", salt.alias("salt"))
    member = dealt.select("a", "salt", F.col("b").alias("doc"), F.lit(True).alias("member"))
    head = dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("doc"), F.lit(False).alias("member"))
    sent = member.unionByName(head).join(texts_of(pairs, texts.select("doc", "text")), "doc").select("a", "salt", "member", "doc", "text")
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        against = np.zeros(0, np.uint64)
        for part in by_size(batches, 3, 1_000_000):
            good = np.zeros(part.num_rows, bool)
            for k, (member, text) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                one = shingles(unpack(press, text).lower())
                if not member:
                    against = one
                    continue
                common = len(np.intersect1d(one, against, assume_unique=True))
                good[k] = 100 * common >= PERCENT * (len(one) + len(against) - common)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good))

    ordered = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "doc")
    return ordered.select("a", "doc", "member", "text").mapInArrow(run, schema)


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two members at least, with the node's size; counted before shuffling."""
    counted = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    return rows.join(counted, "node")


def representatives(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, n, rep) of every document and (doc, tokens, sketch) of the representatives of its non-empty sets; docs: (doc, text)."""
    found = stored(signatures(docs), "near-signatures")
    groups = found.filter("n > 0").groupBy("set1", "set2").agg(F.min(F.struct("doc", "tokens", "sketch")).alias("least"))
    groups = stored(groups.select("set1", "set2", F.col("least.doc").alias("rep"), F.col("least.tokens").alias("tokens"), F.col("least.sketch").alias("sketch")), "near-sets")
    member = found.select("doc", "n", F.when(F.col("n") > 0, F.col("set1")).alias("set1"), "set2").join(groups.select("set1", "set2", "rep"), ["set1", "set2"], "left")
    return member.select("doc", "n", F.coalesce("rep", "doc").alias("rep")), groups.select(F.col("rep").alias("doc"), "tokens", "sketch")


def part_of(rows: DataFrame, key: str, joined: DataFrame | None, name: str) -> DataFrame:
    """rows with the least document of the component of their column key as name; joined: (v, c), documents alone left out."""
    if joined is None:
        return rows.withColumn(name, F.col(key))
    return rows.join(joined.select(F.col("v").alias("__v"), F.col("c").alias("__c")), F.col(key) == F.col("__v"), "left").withColumn(name, F.coalesce("__c", key)).drop("__v", "__c")


def parted(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
    """rows with the number of their document's component as part, and no side."""
    held = part_of(rows, "doc", joined, "part")
    return held.withColumn("part", F.xxhash64("part")).withColumn("side", F.lit(-1).cast("long"))


def contracted(pairs: DataFrame, joined: DataFrame, most: int) -> DataFrame:
    """Pairs between components, each once, in place of at most so many pairs of documents."""
    ends = part_of(part_of(pairs, "a", joined, "a"), "b", joined, "b")
    return stored(in_few(ordered_pairs(ends), most), "near-contracted")


def mixed(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold several parts, with the node's size."""
    several = rows.groupBy("node").agg((F.min("part") != F.max("part")).alias("several"), F.count("*").alias("size")).filter("several").select("node", "size")
    return rows.join(several, "node")


def candidates(level: DataFrame, small: int, block: int | None = None) -> DataFrame:
    """Spanning candidates of a level's nodes: small ones compared, large ones by stars or, with block, in pairs of blocks. level: a written table."""
    large = F.col("size") > small
    found = compare_nodes(level.filter(~large), False)
    if level.filter(large).limit(1).count():
        found = found.unionByName(compare_nodes(in_blocks(level.filter(large), block), False) if block else stars(level.filter(large)))
    return stored(ordered_pairs(found), "near-pairs")


def labels(reps: DataFrame, texts: DataFrame, trees: int = TREES, depth: int = DEPTH, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Rows (doc, c) of all representatives: c is the least document that doc reaches over links."""
    spark = reps.sparkSession
    sketches = reps.select("doc", "sketch")
    level = stored(parted(sized(branched(reps, trees)).join(sketches, "doc"), None), "near-level")
    tried = candidates(level, small)
    joined = components(stored(confirm(tried, texts), "near-links"))
    release(spark)
    clouds = tried
    for step in range(1, depth):
        rest = level.filter(F.col("size") > small).select("node", "doc")
        if not rest.limit(1).count():
            break
        rest = mixed(parted(rest, joined)).select("node", "doc")
        below = sized(branched(rest.join(reps, "doc"))).drop("size")
        level = stored(mixed(parted(below.join(sketches, "doc"), joined)), "near-level")
        clouds = clouds.unionByName(candidates(level, small, block if step == depth - 1 else None))
        release(spark)
    # from here on components stand for their documents, so that what is joined already isn't walked again
    cloud = components(contracted(clouds, joined, clouds.count())).select(F.col("v").alias("p"), F.xxhash64("c").alias("node"))
    members = part_of(reps.select("doc"), "doc", joined, "p").join(cloud, "p").select("doc", "node")
    several = stored(mixed(parted(members, joined)).drop("side").join(sketches, "doc"), "near-clouds")
    more = ordered_pairs(compare_nodes(in_blocks(several, block), True)).join(tried, ["a", "b"], "left_anti")
    more = stored(more, "near-pairs")
    release(spark)
    last = components(contracted(confirm(more, texts), joined, more.count()))
    return part_of(part_of(reps.select("doc"), "doc", joined, "p"), "p", last, "c").select("doc", "c")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with n_shingles (long), component_id (of doc_id's type) and kept (boolean); columns of docs named so give way."""
    extra = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    keyed = docs.select(document_key(docs).alias("doc"), F.col("text"), *(F.col(c).alias(f"x_{c}") for c in extra))
    plain = keyed.select("doc", "text")
    member, reps = representatives(plain)
    label = stored(labels(reps, packed_texts(plain)).filter("doc <> c"), "near-labels").withColumnRenamed("doc", "v")
    release(docs.sparkSession)
    struct = isinstance(keyed.schema["doc"].dataType, T.StructType)
    least = F.coalesce("c", "rep")
    out = member.join(label, F.col("rep") == F.col("v"), "left").select("doc", "n", least.alias("least"))
    done = out.select(
        F.col("doc").alias("key"),
        F.col("n").alias("n_shingles"),
        (F.col("least.id") if struct else F.col("least")).alias("component_id"),
        (F.col("doc") == F.col("least")).alias("kept"),
    ).distinct()
    return keyed.join(done, F.col("doc") == F.col("key")).select(*(F.col(f"x_{c}").alias(c) for c in extra), "n_shingles", "component_id", "kept")
