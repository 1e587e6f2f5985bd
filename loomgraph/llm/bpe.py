"""Byte-level BPE by a prefix-sharing trie.

The distinct pre-tokens of a batch go into a trie, laid out by sorting them. A depth-first walk gives each trie node the *last token* of the
encoding of its prefix: the longest vocabulary entry that ends there and stays apart from the last token of what precedes
it. A prefix that many words share is so encoded once. A word's tokens are read back along those last tokens.

The result equals merging by rank because the encoding of a byte string is the only sequence of tokens in which every
adjacent pair would be left unmerged. That holds for vocabularies whose ids follow the order of the merges, which the
loader verifies.

Nulls and empty texts encode to no tokens; extra columns pass through untouched; every row gives one row. No shuffle.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from loomgraph.llm.common import by_size

#: The byte-level pre-tokeniser's pattern: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens kept with their encodings before memory is given back.
CACHE_WORDS = 500_000
#: Characters of text whose words share one trie.
TRIE_CHARS = 4_000_000
#: Characters from which on Unicode has unassigned places. The regex and tokenizers libraries follow different versions
#: and class characters differently that were assigned in between; such texts go through the latter's splitter.
LATE = re.compile("[^\x00-\u0557]")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        entries = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*entries.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for written, k in entries.items():
            self.tokens[k] = bytes(letters[c] for c in written)
        for content, k in self.special.items():
            self.tokens[k] = content.encode()
        self.ids = {self.tokens[k]: k for k in entries.values() if k not in set(self.special.values())}
        self.left, self.right, self.merged = list(range(size)), list(range(size)), {}
        before = -1
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, k = entries[a], entries[b], entries[a + b]
            if k <= before:
                raise ValueError(f"{path}: ids don't follow the order of the merges")
            before = k
            self.left[k], self.right[k], self.merged[a, b] = a, b, k
        self.longest = max(map(len, self.ids))
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        if LATE.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [x for x, _ in pre_tokenizers.Split(Regex(PATTERN), "isolated").pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def apart(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the boundary between the tokens a and b alone.

        The merges that built both are undone from the latest; a merge across the boundary that ranks before the one
        just undone would have come first.
        """
        bound = len(self.tokens) + 1
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                return False
            if a > b:
                if self.left[a] == a:
                    return True
                bound, a = a, self.right[a]
            else:
                if self.left[b] == b:
                    return True
                bound, b = b + 1, self.left[b]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str) -> TrieEncoder:
    """One for each Python worker, whose later tasks find the words of earlier ones encoded."""
    return TrieEncoder(vocabulary(path))


class TrieEncoder:
    """Encodes distinct words of batches, each shared prefix once; keeps the encodings while they fit."""

    def __init__(self, vocab: Vocabulary, most: int = CACHE_WORDS):
        self.vocab, self.most = vocab, most
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def learn(self, distinct: set[str]) -> None:
        new = distinct - self.known.keys()
        if len(self.known) + len(new) > self.most:
            self.known, self.pairs = {}, {}
            new = distinct
        self.walk(sorted((word.encode(), word) for word in new))

    def walk(self, trie: list[tuple[bytes, str]]) -> None:
        """Depth first through the trie of the words, which their order lays out: a word branches off where it stops
        agreeing with the one before, and ``last`` holds the last token of every prefix on the way down to it."""
        ids, longest, pairs, apart, tokens, known = self.vocab.ids.get, self.vocab.longest, self.pairs, self.vocab.apart, self.vocab.tokens, self.known
        above, last = b"", [0]
        for path, word in trie:
            branch = 0
            for x, y in zip(above, path):
                if x != y:
                    break
                branch += 1
            del last[branch + 1 :]
            size = len(path)
            for depth in range(branch + 1, size + 1):
                for start in range(depth - longest if depth > longest else 0, depth):
                    token = ids(path[start:depth])
                    if token is None:
                        continue
                    if not start:
                        break
                    pair = (last[start], token)
                    held = pairs.get(pair)
                    if held is None:
                        held = pairs[pair] = apart(*pair)
                    if held:
                        break
                last.append(token)
            above, out, at = path, [], size
            while at:
                out.append(last[at])
                at -= len(tokens[last[at]])
            known[word] = array("i", out[::-1]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        find, specials = self.vocab.pieces, self.vocab.specials
        split = []
        for text in texts:
            if not text:
                split.append(())
            elif specials and specials.search(text):
                split.append([y for k, x in enumerate(specials.split(text)) for y in ([(x,)] if k % 2 else find(x))])
            else:
                split.append(find(text))
        self.learn({x for one in split for x in one if isinstance(x, str)})
        known, special = self.known, self.vocab.special
        out = []
        for one in split:
            try:
                out.append(b"".join(map(known.__getitem__, one)))
            except KeyError:  # special tokens
                out.append(b"".join(known[x] if isinstance(x, str) else array("i", [special[x[0]]]).tobytes() for x in one))
        return out


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
    return b"".join(map(vocab.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with the columns ``ids`` (array of int) and ``decoded`` (string) in place of its text.

    tokenizer: path of the vocabulary file, readable where tasks run.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, "ids", "decoded")]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        vocab = encoder.vocab
        for part in by_size(batches, len(names), TRIE_CHARS):
            ids = encoder.encode(part.column(len(names)).to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "i")))
            back = pa.array([decode(vocab, np.frombuffer(x, "i")) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), lists, back], names=[*names, "ids", "decoded"])

    return docs.select(*names, docs[text].alias("__text")).mapInArrow(run, schema)
