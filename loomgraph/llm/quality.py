"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes a sparse vector of hashed terms: its words' shapes, pairs of neighbouring shapes, coarse rates (repeated
words, distinct words, repeated lines, symbols, capitals, mean word length, length) and its words. On a bounded sample of labelled texts
(``SAMPLE`` rows, lowest hashes of the row) terms are weighted by log frequency and inverse document frequency, and a
randomised singular value decomposition gives the latent space. The projection and the labelled vectors, both of fixed
size, are broadcast. Every document is projected, its cosines with all labelled vectors are computed in blocks, exactly, and the
``NEIGHBOURS`` nearest vote with their labels, weighted by a power of similarity.

Score is the weighted share of label 1, shrunk to the sample's share by ``PRIOR`` votes: 0 to 1. Null and empty texts
have the zero vector, are similar to nothing and score the sample's share of label 1. With no labelled row at all every
score is 0.5, with one label only it is that label. Label rows whose document is
missing, whose quality is null or not 0 or 1, are ignored; of repeated label rows for a document the larger label counts. Rows that
repeat score alike. Extra columns pass through. Only the sample is shuffled; documents are scanned once more to score.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import by_size

#: Labelled rows that a model is fitted on, at most: what is broadcast is bounded by SAMPLE * RANK and TERMS * RANK numbers.
SAMPLE = 3000
#: Hashed terms of each kind (shapes and rates, words), dimensions of the latent space, neighbours, votes of the prior.
TERMS, RANK, NEIGHBOURS, PRIOR = 4096, 48, 15, 0.5
#: Power of the cosine that a neighbour's vote weighs, and weight of word terms beside shape terms.
SHARPNESS, WORD_WEIGHT = 8, 0.25
#: Score from which a document counts as good.
GOOD = 0.7
#: Documents whose cosines are computed at once.
BLOCK = 256

#: Bytes to shape letters: lower case and non-ASCII letters to a, capitals to A, digits to 0, others stay.
SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
RUN = re.compile(rb"([^ \t\n\v\f\r])\1+")
SYMBOLS = b"#*$%&|<>!"


def bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x > e for e in edges)


def terms(text: str | None) -> dict[int, float]:
    """Weights of a text's terms before the inverse document frequency: 1 + log count."""
    raw = text.encode() if text else b""
    found = raw.split()
    if not found:
        return {}
    n = len(found)
    shapes = RUN.sub(rb"\1", raw.translate(SHAPE)).split()
    count = Counter(shapes)
    out: dict[int, float] = {}

    def put(term: bytes, weight: float, words: bool = False) -> None:
        k = zlib.crc32(term) % TERMS + TERMS * words
        out[k] = out.get(k, 0.0) + weight

    for shape, c in count.items():
        put(b"s" + shape[:12], bucket(c / n, (0.002, 0.01, 0.05, 0.2, 0.5)) + 1.0)
    for (a, b), c in Counter(zip(shapes, shapes[1:], strict=False)).items():
        if c / n > 0.02:
            put(b"b" + a[:8] + b" " + b[:8], bucket(c / n, (0.05, 0.2, 0.5)) + 1.0)
    lines = [x for x in raw.split(b"\n") if x.split()]
    size = len(raw)
    rates = {
        b"next": bucket(sum(map(eq, found, found[1:])) / n, (0.01, 0.05, 0.2, 0.5)),
        b"distinct": bucket(len(set(found)) / n, (0.1, 0.3, 0.5, 0.7)),
        b"lines": bucket(1 - len(set(lines)) / len(lines), (0.05, 0.2, 0.5)),
        b"symbols": bucket((size - len(raw.translate(None, SYMBOLS))) / size, (0.002, 0.01, 0.03, 0.1)),
        b"capitals": bucket(sum(map(raw.count, CAPITALS)) / size, (0.01, 0.05, 0.2, 0.5)),
        b"digits": bucket(sum(map(raw.count, DIGITS)) / size, (0.01, 0.05, 0.2)),
        b"long": bucket(size / n, (4, 6, 8, 12)),
        b"words": bucket(n, (3, 10, 30, 100)),
    }
    for name, level in rates.items():
        put(b"r" + name + b"%d" % level, RATE_WEIGHT)
    for word, c in Counter(found).items():
        put(b"w" + word.lower(), 1.0 + np.log(c) if c > 1 else 1.0, True)
    return out


CAPITALS = [bytes([b]) for b in range(65, 91)]
DIGITS = [bytes([b]) for b in range(48, 58)]
#: Weight of a rate beside a shape's.
RATE_WEIGHT = 3.0


@dataclass
class Model:
    """What is broadcast: term weights, the projection, unit vectors and labels of the sample, and the prior."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, found: list[dict[int, float]]) -> np.ndarray:
        out = np.zeros((len(found), self.axes.shape[1]), np.float64)
        for k, one in enumerate(found):
            if one:
                at = np.fromiter(one.keys(), np.int64, len(one))
                weight = weighted(at, np.fromiter(one.values(), np.float64, len(one)), self.idf)
                out[k] = weight @ self.axes[at]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    def score(self, found: list[dict[int, float]]) -> np.ndarray:
        """Similarity-weighted votes of the nearest labelled vectors, exact, a block of documents at a time."""
        out = np.full(len(found), self.prior)
        if not len(self.labels) or not self.axes.shape[1]:
            return out
        for at in range(0, len(found), BLOCK):
            mine = self.project(found[at : at + BLOCK])
            cosine = mine @ self.vectors.T
            some = np.argpartition(-cosine, min(NEIGHBOURS, cosine.shape[1]) - 1, axis=1)[:, :NEIGHBOURS]
            near = np.take_along_axis(cosine, some, 1)
            vote = np.clip(near, 0, 1) ** SHARPNESS
            out[at : at + BLOCK] = ((vote * self.labels[some]).sum(1) + PRIOR * self.prior) / (vote.sum(1) + PRIOR)
        return out


def weighted(at: np.ndarray, weight: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights by idf; shape and word terms each of unit length, words then scaled down."""
    weight = weight * idf[at]
    word = at >= TERMS
    for part, scale in ((word, WORD_WEIGHT), (~word, 1.0)):
        size = np.sqrt((weight[part] ** 2).sum())
        if size:
            weight[part] *= scale / size
    return weight


def fit(found: list[dict[int, float]], labels: np.ndarray, rank: int = RANK) -> Model:
    """Latent space and labelled vectors from a sample's terms; deterministic."""
    prior = float(labels.mean()) if len(labels) else 0.5
    width = 2 * TERMS
    frequency = np.zeros(width)
    for one in found:
        frequency[list(one)] += 1
    idf = np.log((1 + len(found)) / (1 + frequency)) + 0.1
    table = np.zeros((len(found), width), np.float32)
    for k, one in enumerate(found):
        if one:
            at = np.fromiter(one.keys(), np.int64, len(one))
            table[k, at] = weighted(at, np.fromiter(one.values(), np.float64, len(one)), idf)
    rank = min(rank, *table.shape)
    if not rank:
        return Model(idf, np.zeros((width, 0)), np.zeros((0, 0)), labels, prior)
    guess = np.random.default_rng(11).standard_normal((width, min(rank + 16, len(found)))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(table @ guess)
        guess = table.T @ basis
    _, _, axes = np.linalg.svd(guess.T, full_matrices=False)
    model = Model(idf, axes[:rank].T.astype(np.float64), np.zeros((0, rank)), labels.astype(np.float64), prior)
    model.vectors = model.project(found)
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Labelled texts, at most so many: (text, label). The choice goes by a hash of the label row's id, before texts are read, so
    that a table of at most ``most`` rows is broadcast and documents are scanned, not shuffled."""
    good = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    return found.orderBy(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), "text", "label").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on a bounded number of labelled rows, in one task; only the model, of fixed size, comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict[int, float]] = []
        known: list[int] = []
        for batch in batches:
            found += [terms(x) for x in batch.column(0).to_pylist()]
            known += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(found, np.array(known, np.float64)))], pa.binary())], names=["model"])

    rows = sample(docs, labels, most).coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0].model) if rows else fit([], np.zeros(0))


def classify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score (double) and predicted (int), with its text or without; columns of docs named so give way."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted") and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    at = names.index(text) if keep_text else len(names)
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, at, 2_000_000):
            score = handed.value.score([terms(x) for x in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(score), pa.array((score >= GOOD).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.select(*names, *([] if keep_text else [text])).mapInArrow(run, schema)
