"""Repetition rules by suffix arrays.

The words of a block of documents form one sequence; a suffix array over it (prefix doubling, in which suffixes of
different documents never compare equal and no match passes a document's end) brings suffixes that share a prefix together.
The longest-common-prefix (LCP) interval in which a suffix lies deepest spans the longest substring starting there that
occurs again in its document. The union of those spans is the union of all maximal repeated substrings. The rule limits the fraction of
words under spans of at least ``MIN_REPEAT`` words, and the longest repeat.

Null and empty texts have no words and fail the base rule. Very long texts are whole: a block holds at least one document.
Repeated rows are judged alike, each on its own; rows need no key. Extra columns pass through. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.common import by_size

#: Words of a repeat that counts to the covered fraction.
MIN_REPEAT = 10
#: Largest percentage of words under such repeats, and longest repeat, of a text that is kept.
MAX_COVERED_PERCENT, MAX_LONGEST = 30, 100
#: Base rule: fewest words, and largest percentage of words in repeated three-word windows.
MIN_WORDS, BASE_WINDOW, MAX_REPEATED_PERCENT = 50, 3, 50
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\v\f\r"
#: Bytes of text whose words share a suffix array.
BLOCK_BYTES = 2_000_000

MEASURES = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def longest_repeats(codes: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place, the words of the longest substring that starts there and occurs again in its document.

    codes: a number for each word; doc: the document of each place, ascending; end: where that document ends.
    """
    n = len(codes)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    _, first = np.unique(doc * (int(codes.max()) + 1) + codes, return_inverse=True)
    levels = [first.astype(np.int64)]
    live = np.flatnonzero(np.bincount(first)[first] > 1)
    start, step = live, 1
    while len(live):
        rank = levels[-1]
        ahead = live + step
        ahead = np.where(ahead < end[live], rank[np.minimum(ahead, n - 1)] + 1, 0)
        # ties of a rank are told apart by the rank that follows; a group of g places keeps g consecutive numbers to itself
        order = np.lexsort((ahead, rank[live]))
        at, by, key = live[order], ahead[order], rank[live[order]]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (by[1:] != by[:-1])
        group = np.cumsum(fresh) - 1
        new = rank.copy() if len(levels) > 1 else spread(rank)
        base = new[at]
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        offset = np.flatnonzero(fresh)[group] - np.flatnonzero(head)[np.cumsum(head) - 1]
        new[at] = base + offset
        levels.append(new)
        live = np.sort(at[np.bincount(group)[group] > 1])
        step *= 2
    if len(levels) == 1:
        return out
    array = start[np.argsort(levels[-1][start], kind="stable")]
    a, b = array[:-1], array[1:]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < end[a]) & (y < end[b])
        rank = levels[k]
        lcp += ((rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]) & inside).astype(np.int64) << k
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def spread(rank: np.ndarray) -> np.ndarray:
    """Dense ranks as ranks that leave each group as many numbers as it has places."""
    sizes = np.bincount(rank)
    return (np.cumsum(sizes) - sizes)[rank]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie under a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str | None]) -> dict[str, list]:
    raw = [t.encode() if t else b"" for t in texts]
    split = [x.split() for x in raw]
    counts = np.array([len(x) for x in split], np.int64)
    flat = [w for x in split for w in x]
    number = {w: k for k, w in enumerate(set(flat))}
    codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    doc, ends = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts)
    longest = longest_repeats(codes, doc, ends[doc] if len(doc) else doc)
    out = {f.name: [] for f in MEASURES}
    by_doc = lambda values: np.bincount(doc, values, minlength=len(texts)).astype(np.int64)
    hits = np.flatnonzero(longest >= BASE_WINDOW)
    repeated = by_doc(covered(hits, np.full(len(hits), BASE_WINDOW), len(flat)))
    hits = np.flatnonzero(longest >= MIN_REPEAT)
    under = by_doc(covered(hits, longest[hits], len(flat)))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc, longest)
    for k, text in enumerate(texts):
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        n = int(counts[k])
        failed = n < MIN_WORDS or bool(100 * repeated[k] > MAX_REPEATED_PERCENT * n)
        out["n_words"].append(n)
        out["word_chars"].append(len(text or "") - (len(raw[k]) - len(raw[k].translate(None, SPACE))))
        out["n_symbols"].append(len(raw[k]) - len(raw[k].translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(int(repeated[k]))
        out["n_covered"].append(int(under[k]))
        out["longest_repeat"].append(int(top[k]))
        out["base_failed"].append(failed)
        out["kept"].append(not failed and bool(100 * under[k] <= MAX_COVERED_PERCENT * n) and bool(top[k] <= MAX_LONGEST))
    return out


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the measures and the verdict; a column of docs that a measure is named after gives way."""
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in MEASURES.fieldNames()]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *MEASURES.fields])
    arrow = {"n": pa.int64(), "b": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, len(names), BLOCK_BYTES):
            found = measure(part.column(len(names)).to_pylist())
            columns = [pa.array(v, arrow["b" if f.dataType == T.BooleanType() else "n"]) for f, v in zip(MEASURES.fields, found.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *columns], names=schema.fieldNames())

    return docs.select(*names, docs[text].alias("__text")).mapInArrow(run, schema)
