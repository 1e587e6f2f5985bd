"""Operators over the whole corpus: near duplicates, repeated passages, mixing, and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import common, components, mixing, neardup, quality, substrings
from loomgraph.llm.queries import byte_bpe, quality_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_groups(rows):
    """Components by full comparison: {row number: (set size, least id)}."""
    sets = []
    for _, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    return [(len(sets[i]), least[find(i)]) for i in range(len(rows))]


def varied(seed, groups=25, n=80):
    rng = random.Random(seed)
    out = []
    word = lambda: f"w{rng.randrange(400)}"
    for _ in range(groups):
        base = [word() for _ in range(n)]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                text[rng.randrange(n)] = word()
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_duplicates_against_brute_force(spark):
    for seed in (1, 2):
        rows = varied(seed)
        held = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for (d, _), (n, (_, least)) in zip(rows, brute_groups(rows), strict=True):
            assert (held[d].n_shingles, held[d].component_id, held[d].kept) == (n, least, d == least)


def test_near_duplicates_with_deep_trees_and_blocks(spark):
    """Small nodes and blocks take every row through branching, stars, clouds and pairs of blocks."""
    rows = varied(3, groups=12)
    plain = spark.createDataFrame(rows, "doc long, text string")
    member, reps = neardup.representatives(plain)
    label = {r.doc: r.c for r in neardup.labels(reps, common.packed_texts(plain), small=2, depth=4, block=4).collect()}
    held = {r.doc: label.get(r.rep, r.rep) for r in member.collect()}
    assert held == {d: least for (d, _), (_, (_, least)) in zip(rows, brute_groups(rows), strict=True)}


def test_near_duplicates_odd(odd_docs):
    found = neardup.near_duplicates(odd_docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "doc", "n_shingles", "component_id", "kept"]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    expected = Counter()
    for (d, text), (n, (unknown, least)) in zip(rows, brute_groups(rows), strict=True):
        expected[d, text, n, (None if unknown else least) if n else d] += 1
    assert Counter((r.doc_id, r.text, r.n_shingles, r.component_id) for r in found.collect()) == expected
    assert neardup.near_duplicates(odd_docs.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    held = {r.v: r.c for r in components.components(links).collect()}
    assert held == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(links.limit(0)).count() == 0


def brute_removed(rows, window=20):
    """Kept words of each row; rows are (order key, text), keys may repeat for equal rows."""
    first = {}
    split = [(key, WORD.findall(t or "")) for key, t in rows]
    for key, words in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, (key, i)), (key, i))
    out = []
    for key, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (key, i):
                gone |= set(range(i, i + window))
        out.append([w for k, w in enumerate(words) if k not in gone])
    return out


def passages(seed, n=40):
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randrange(60)}" for _ in range(k)]
    shared = [fresh(rng.choice([19, 20, 21, 45, 80])) for _ in range(6)]
    rows = []
    for d in range(n):
        words = fresh(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            words += rng.choice(shared) + fresh(rng.randrange(25))
        rows.append((d, " ".join(words)))
    return rows + [(n, "a " * 70), (n + 1, "a " * 25), (n + 2, rows[3][1])]


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 3, "shard_zones": 2}, {"shard_zones": 0}, {"gram": 3}])
def test_substrings_against_brute_force(spark, limits, monkeypatch):
    if "hot_rows" in limits:
        monkeypatch.setattr(substrings, "LOCAL", 1)
    for seed in (1, 2):
        rows = passages(seed)
        found = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
        held = {r.doc_id: (WORD.findall(r.text or ""), r.n_words, r.n_removed) for r in found}
        for (d, text), kept in zip(rows, brute_removed(rows), strict=True):
            total = len(WORD.findall(text))
            assert held[d] == (kept, total, total - len(kept))


def test_suffix_automaton():
    rng = random.Random(6)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(4)]
        automaton = substrings.SuffixAutomaton()
        for one in sequences:
            automaton.add(one)
        factors = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)}
        text = [rng.randrange(3) for _ in range(20)]
        expected = [max(k for k in range(i + 2) if tuple(text[i + 1 - k : i + 1]) in factors or not k) for i in range(len(text))]
        assert automaton.statistics(text) == expected


def test_bounded_reference(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = spark.createDataFrame([(1, f"x y {passage} z"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.n) for r in substrings.matches(rows, [passage]).collect()] == [(1, 2, 11)]
    with pytest.raises(ValueError):
        substrings.matches(rows, [passage], most_words=10)


def test_substrings_odd(odd_docs):
    found = substrings.deduplicate(odd_docs)
    assert {"doc_id", "lang", "score", "doc", "text", "n_words", "n_removed"} <= set(found.columns)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    keyed = {}
    for d, text in rows:
        keyed.setdefault((d, text), None)
    order = sorted(keyed, key=lambda x: (x[0] is None, x[0] or 0))
    # texts of one id: none of the repeated ids here shares a window, so their order doesn't matter
    kept = dict(zip(order, brute_removed([(k, t) for k, (_, t) in enumerate(order)]), strict=True))
    expected = Counter((d, tuple(kept[d, t])) for d, t in rows)
    assert Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in found.collect()) == expected
    assert substrings.deduplicate(odd_docs.limit(0)).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        rest = sum(weight[s] for s in order if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / rest for s in order}
        over = {s for s in order if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 40, None: 7}, {"a": 5}, {"a": 1, "b": 1, "c": 1, "d": 500}, {"a": 0, "b": 0}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    held = {r.source: r.target for r in mixing.targets(table).collect()}
    expected = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    assert held == {k: pytest.approx(v) for k, v in expected.items()}


def brute_rate(sizes, target, most=3):
    """Rates of one source by bisection of its dual: size -> rate."""
    mean = sum(sizes) / len(sizes)
    tokens = lambda m: sum(s * min(most, math.exp(min(700, m * s / mean))) for s in sizes)
    low, high = -1.0, 1.0
    while tokens(low) > target:
        low *= 2
    while tokens(high) < target * (1 - 1e-12) and high < 1e6:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if tokens(middle) < target else (low, middle)
    return {s: min(most, math.exp(min(700, high * s / mean))) for s in sizes}


def test_mixing(spark, docs):
    runs = [sorted((r.doc_id, r.copies) for r in mixing.mix(docs.repartition(n)).collect()) for n in (3, 7)]
    assert runs[0] == runs[1]
    held = mixing.mix(docs.repartition(7), group_rows=30).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sizes, taken, goal, own, dealt = Counter(), Counter(), {}, {}, {}
    for r in held:
        assert r.size == len(WORD.findall(texts[r.doc_id])) and 0 <= r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        goal[r.source] = r.target
        own.setdefault(r.source, []).append(r.size)
        dealt.setdefault((r.source, r.row_hash % -(-sum(1 for x in held if x.source == r.source) // 30)), []).append(r)
    assert goal == {k: pytest.approx(v) for k, v in brute_targets(sizes).items()}
    for r in held:
        rate = brute_rate(own[r.source], goal[r.source]) if r.size and len(own[r.source]) < 60 else {}
        assert r.copies in (math.floor(r.rate), math.ceil(r.rate)) and r.rate == pytest.approx(rate.get(r.size, r.rate), rel=1e-4)
    # a group's words are its tilted words but for half of its smallest document that is rounded
    for rows in dealt.values():
        tilted, words = sum(r.rate * r.size for r in rows), sum(r.copies * r.size for r in rows)
        rounded = [r.size for r in rows if r.size and 1e-9 < r.rate % 1 < 1 - 1e-9]
        assert abs(tilted - words) <= (max(rounded) / 2 if rounded else 0) + 1e-3


@pytest.mark.parametrize("target", [1, 40, 119, 120, 121, 300, 357, 359.9, 360])
def test_dual_against_bisection(spark, target):
    """Every share of a source from a word to all that a bound of three allows; rates tilt with size."""
    own = [1, 2, 2, 5, 10, 30, 70]
    sizes = spark.createDataFrame([("a", s, n) for s, n in Counter(own).items()] + [("b", 4, 2)], "source string, size long, n long")
    goal = spark.createDataFrame([("a", sum(own), len(own), float(target)), ("b", 8, 2, 8.0)], "source string, source_size long, rows long, target double")
    held = {r.of: r for r in mixing.solve(sizes, goal).collect()}
    rate = {s: min(3, math.exp(min(700, held["a"].multiplier * s / held["a"].mean))) for s in own}
    assert sum(s * rate[s] for s in own) == pytest.approx(target, rel=1e-6)
    assert rate == {s: pytest.approx(r, rel=1e-3) for s, r in brute_rate(own, target).items()}
    assert held["b"].multiplier == pytest.approx(0, abs=1e-6)


def test_running_sums(spark):
    rows = [(k * 7 % 100, k) for k in range(100)]
    held = mixing.running(spark.createDataFrame(rows, "a long, b long").repartition(5), [F.col("a")], {"s": F.col("b"), "n": F.lit(1)}, "test").collect()
    order = sorted(rows)
    assert sorted((r.a, r.s, r.n) for r in held) == [(a, sum(b for _, b in order[:k]), k) for k, (a, _) in enumerate(order)]


def test_mixing_odd(odd_docs, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATED", 2)
    every = odd_docs.unionByName(odd_docs.filter("doc_id = 10")).unionByName(odd_docs.filter("doc_id = 10")).unionByName(odd_docs.filter("doc_id = 10 OR doc_id IS NULL"))
    held = mixing.mix(every).collect()
    assert Counter(r.doc_id for r in held) == Counter(r.doc_id for r in every.collect()) and all(0 <= r.copies <= 3 for r in held)
    assert {(r.size, r.copies) for r in held if r.doc_id in (4, 5, 6)} == {(0, 0)}
    copies = [r.copies for r in held if r.doc_id == 10]
    assert len(copies) == 4 and max(copies) - min(copies) <= 1
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    """Each stage against brute force on its own input."""
    docs = common.read(spark, sf, "documents")
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        before = held
        held = common.stored(stage(spark, before, sf), f"test-{name}", keep=True)
        rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
        if name != "encoding":
            assert held.columns == docs.columns
        if name == "quality":
            model = quality_model(before, spark.read.parquet(f"{sf}/labels.parquet"))
            stay = {r.doc_id for r in held.collect()}
            for d, text in rows:
                assert (d in stay) == (brute_vote(model, text) >= quality.GOOD)
            known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            good = [d in stay for d, _ in rows if known.get(d) == 1]
            bad = [d in stay for d, _ in rows if known.get(d) == 0]
            assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.3
        if name == "near_duplicates":
            assert {r.doc_id for r in held.collect()} == {least for _, (_, least) in brute_groups(rows)}
        if name == "repeated_passages":
            assert {r.doc_id: WORD.findall(r.text or "") for r in held.collect()} == {d: kept for (d, _), kept in zip(rows, brute_removed(rows), strict=True)}
        if name == "mixing":
            assert_mixed(before.collect(), held.collect())
        if name == "encoding":
            library = Tokenizer.from_file(byte_bpe())
            expected = sorted((d, library.encode(text or "", add_special_tokens=False).ids) for d, text in rows)
            assert sorted((r.doc_id, r.ids) for r in held.collect()) == expected
            assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in held.collect())
            assert all(r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest() for r in held.collect())


def brute_vote(model, text):
    """A text's score by its cosines with every labelled vector, one at a time."""
    v = model.project([quality.terms(text)])[0]
    if not v.any():
        return model.prior
    cosine = np.array([float(w @ v) for w in model.vectors])
    near = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
    vote = np.clip(cosine[near], 0, 1) ** quality.SHARPNESS
    return ((vote * model.labels[near]).sum() + quality.PRIOR * model.prior) / (vote.sum() + quality.PRIOR)


def assert_mixed(before, after):
    """Copies are a rate's floor or ceiling, rates are those that bisection of each source's dual gives, and sources meet their targets."""
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in before}
    own = {}
    for r in before:
        own.setdefault(r.source, []).append(r.doc_id)
    goal = brute_targets({s: sum(size[d] for d in ds) for s, ds in own.items()})
    copies = Counter(r.doc_id for r in after)
    assert set(copies) <= set(size)
    for s, ds in own.items():
        sizes = [size[d] for d in ds]
        rate = brute_rate(sizes, goal[s])
        for d in ds:
            r = rate[size[d]] if size[d] else 0
            assert math.floor(r - 1e-4) <= copies[d] <= math.ceil(r + 1e-4)
        assert abs(sum(copies[d] * size[d] for d in ds) - goal[s]) <= max(sizes) / 2 + 1


def test_pipeline_odd(spark, odd_docs, tmp_path):
    """Nulls in each column, repeated rows and ids, extra columns under names that operators and stages use, and an empty table."""
    clashing = "predicted kept component_id n_shingles n_words n_removed removed copies mixed_id row_hash own_hash copy size rate spans extra__0".split()
    docs = odd_docs
    for k, name in enumerate(clashing):
        docs = docs.withColumn(name, F.lit(f"{k}"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (9, 1, 0), (10, 1, 0), (12, 1, None), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for at, rows in (("full", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{at}"
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        held = spark.read.parquet(f"{folder}/documents.parquet")
        values = {(r.score, r.doc) for r in held.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            held = common.stored(stage(spark, held, folder), f"odd-{name}", keep=True)
            assert held.columns == docs.columns
            found = held.collect()
            assert all([r[c] for c in clashing] == [str(k) for k in range(len(clashing))] and (r.score, r.doc) in values for r in found)
            assert bool(found) == (at == "full")
        assert (corpus_pipeline.run(spark, folder).count() > 0) == (at == "full")


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "near_duplicates" and len(corpus_pipeline.STAGES) == 5


def test_scratch(spark):
    """What a scratch notes is removed, and nothing else of the session."""
    other = common.stored(spark.range(3), "other")
    with common.scratch() as made:
        held = common.stored(spark.range(3), "noted")
        kept = common.stored(spark.range(3), "kept", keep=True)
    common.remove(spark, made)
    assert kept.count() == 3 and other.count() == 3 and not made
    with pytest.raises(Exception, match="(?i)exist|not found"):
        held.agg(F.sum("id")).collect()


def test_shared_folder():
    """Without a shared folder only a single machine goes on."""
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        common.shared_dir(unset)


def test_hot_minimisers(spark, monkeypatch):
    """Minimisers are counted over all that a task reads, and in as many salts as their rows ask for, however few a batch holds."""
    monkeypatch.setattr(substrings, "LOCAL", 4)
    monkeypatch.setattr(substrings, "COUNTED", 50)
    passage = " ".join(f"p{k}" for k in range(25))
    rng = random.Random(3)
    rows = [(k, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    found = {r.hot: r.salts for r in substrings.hot_grams(docs, 20, 6, 20).collect()}
    zones = Counter(r.gram for r in substrings.zone_rows(docs, 20, 6).collect())
    assert {g for g, n in zones.items() if n >= 32} <= set(found) <= {g for g, n in zones.items() if n >= 10}
    assert all(1 <= found[g] <= -(-zones[g] // 20) for g in found)
