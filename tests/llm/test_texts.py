"""Operators that judge each text alone: encoding, repetition, licences, quality."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import bpe, licences, quality, queries, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.byte_bpe())


def fuzzed():
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "é", "ß", "中文", "　", "\xa0", "\x85", "\U0001f600", "1", "23", "²", "<|endoftext|>", "!!", "ing", "the", "The", "\x1c", "​", "́", "_", "\x00"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(2000)]
    return out + ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(80))) for _ in range(2000)]


def test_encoding_equals_the_library(library):
    texts = fuzzed()
    encoder = bpe.TrieEncoder(bpe.vocabulary(queries.byte_bpe()))
    for text, raw, held in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(raw, "i")
        assert ids.tolist() == held.ids, text
        assert bpe.decode(encoder.vocab, ids) == library.decode(held.ids, skip_special_tokens=False)


def test_encoding_survives_a_full_cache(library):
    encoder = bpe.TrieEncoder(bpe.vocabulary(queries.byte_bpe()), most=50)
    for k in range(0, 400, 20):
        part = fuzzed()[k : k + 20]
        assert [np.frombuffer(x, "i").tolist() for x in encoder.encode(part)] == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]


def test_encoding_query(spark, sf, docs, library):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op2_bpe(spark, sf).collect():
        held = library.encode(texts[r.doc_id], add_special_tokens=False)
        assert r.n_tokens == len(held.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, held.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(held.ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_odd(odd_docs):
    found = bpe.encode_decode(odd_docs, queries.byte_bpe())
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "score", "doc", "ids", "decoded"]
    held = found.collect()
    assert len(held) == odd_docs.count() and sorted(r.decoded for r in held) == sorted(r.text or "" for r in odd_docs.collect())
    assert bpe.encode_decode(odd_docs.limit(0), queries.byte_bpe()).count() == 0


def brute_longest(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_longest_repeats():
    rng = random.Random(3)
    for _ in range(150):
        texts = [" ".join(rng.choice("ab" if rng.random() < 0.5 else "abcdefg") for _ in range(rng.randrange(25))) for _ in range(4)]
        flat = [w for t in texts for w in t.split()]
        counts = np.array([len(t.split()) for t in texts])
        ends, doc = np.cumsum(counts), np.repeat(np.arange(4), counts)
        found = repetition.longest_repeats(np.array([ord(w) for w in flat], np.int64), doc, ends[doc] if len(doc) else doc)
        assert found.tolist() == [x for t in texts for x in brute_longest(t.split())]


def test_repetition_verdict():
    rng = random.Random(5)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    passage = " ".join(f"p{k}" for k in range(110))
    short = " ".join(f"q{k}" for k in range(60))
    fresh = lambda n: " ".join(f"z{rng.randrange(10**7)}" for _ in range(n))
    texts = [clean, passage + " x " + fresh(600) + " " + passage, short + " y " + fresh(100) + " " + short, short + " y " + fresh(400) + " " + short]
    held = repetition.measure(texts)
    assert held["kept"] == [True, False, False, True] and not any(held["base_failed"][k] for k in (0, 1, 3))
    assert held["longest_repeat"] == [0, 110, 60, 60]


def test_repetition_odd(odd_docs):
    found = repetition.repetition(odd_docs)
    held = found.collect()
    assert len(held) == odd_docs.count() and {"doc_id", "lang", "score", "doc", "kept"} <= set(found.columns)
    assert all(r.base_failed and not r.kept for r in held if r.n_words < 50)
    assert repetition.repetition(odd_docs.limit(0)).count() == 0


def test_licences_against_brute_force(docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    whole_mit = next(text for label, _, text in licences.TEMPLATES if label == "mit" and len(text) > 500)
    texts = [r.text or "" for r in docs.collect()] + ["CC-BY cc by CC\nBY général public", "All  rights,RESERVED all rights", "the MIT license: permission is hereby granted, free of charge, to any person obtaining a copy of this software", "cc by " * 300, "", "x " + whole_mit + " y", whole_mit[40:], "of " + whole_mit[:300]]
    words_of = lambda text: split.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    every = [(label, words_of(must), words_of(whole)) for label, must, whole in [*((v, k, k) for k, v in phrases.items()), *licences.TEMPLATES]]
    rare = licences.index({}, 10)
    common = licences.index({w: 9 for one in licences.templates() for w in one.words[::2]}, 10)
    best = []
    for text in texts:
        found = words_of(text)
        assert [w.decode() for w in licences.licence_words(text)] == found
        hits, score = licences.scan(licences.licence_words(text), rare)
        assert sorted(hits) == sorted(licences.scan(licences.licence_words(text), common)[0])
        expected = sorted((label, i) for p, label in phrases.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.split())
        assert sorted((label, at) for label, at, base in hits if base) == expected
        own, top = set(), 0.0
        for label, must, whole in every:
            at = next(k for k in range(len(whole)) if whole[k : k + len(must)] == must)
            for i in range(len(found)):
                if found[i : i + len(must)] == must:
                    own.add(label)
                    m = sum(0 <= i - at + k < len(found) and found[i - at + k] == w for k, w in enumerate(whole))
                    top = max(top, m / len(whole) * (1 - 2 ** (-m / 8)))
        assert {label for label, _, _ in hits} == own and score == round(top, 6)
        best.append(score)
    # a whole licence scores near 1, a mention little
    assert best[-3] > 0.99 and 0 < best[-5] < 0.2 and best[-4] == 0 and 0.1 < best[-1] < 0.5


def test_licence_word_frequencies(docs, odd_docs):
    """Documents that hold each licence word, over the whole corpus."""
    found, total = licences.frequencies(docs)
    texts = [set(licences.licence_words(r.text)) for r in docs.collect()]
    assert total == len(texts) and found == {w: n for one in licences.templates() for w in one.words if (n := sum(w in t for t in texts))}
    assert licences.frequencies(odd_docs.limit(0)) == ({}, 0)


def test_licences_odd(odd_docs):
    held = licences.licences(odd_docs).collect()
    assert len(held) == odd_docs.count()
    assert [r.labels for r in held if r.doc_id == 11] == [["cc-by", "cc-by-nc"]]
    assert all(r.n_words == 0 and r.labels == [] and r.score == 0 for r in held if r.doc_id in (4, 5, 6))
    assert licences.licences(odd_docs.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = queries.op1_quality(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    known = [(r.predicted, labels[r.doc_id]) for r in held if r.held_out and r.doc_id in labels]
    assert len(known) > 50 and sum(a == b for a, b in known) / len(known) >= 0.95


def test_quality_score_ignores_other_columns(spark, docs, sf):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    one = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    other = docs.withColumn("source", F.lit("z")).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id: r.score for r in quality.classify(other, model).collect()} == one


def test_quality_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "B", "c|", "d!!", "1"], 30)) for _ in range(60)]
    found = [quality.terms(t) for t in texts]
    labels = rng.integers(0, 2, 40).astype(float)
    model = quality.fit(found[:40], labels)
    for text, score in zip(texts, model.score(found), strict=True):
        v = model.project([quality.terms(text)])[0]
        cosine = model.vectors @ v
        near = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
        vote = np.clip(cosine[near], 0, 1) ** quality.SHARPNESS
        assert score == pytest.approx(((vote * labels[near]).sum() + quality.PRIOR * model.prior) / (vote.sum() + quality.PRIOR), abs=1e-6)


def test_quality_odd(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (5, None), (7, 1), (7, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    held = quality.classify(odd_docs, model).collect()
    assert len(held) == odd_docs.count() and all(0 <= r.score <= 1 for r in held)
    assert all(r.score == pytest.approx(model.prior) for r in held if r.doc_id in (4, 5, 6))
    none = quality.train(odd_docs, labels.limit(0))
    assert {r.score for r in quality.classify(odd_docs, none).collect()} == {0.5}
    assert quality.classify(odd_docs.limit(0), model).count() == 0
