"""Archives, nearest neighbours, chat."""

import glob
import hashlib
import os

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from loomgraph.llm import chat, permutation, warc


def test_archive_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(60)
    extra = spark.createDataFrame([(1000, "http://x/ü", "<p>" + "a" * 200), (1001, None, "<p>" + "a" * 200), (1002, "u", "short"), (1003, "u", "short"), (1004, "u", None), (1005, "u", ""), (None, "u", "<p>" + "a" * 200)], "page_id long, url string, html string")
    every = pages.unionByName(extra).withColumn("record_id", F.lit(1))
    folder = f"file://{tmp_path}/bundles"
    index = warc.write(every, folder, frame_bytes=4000, bundle_bytes=20_000)
    held = {r.record_id: r for r in warc.read_back(index, folder).collect()}
    assert len(held) == every.count()
    for p in every.collect():
        raw = (p.html or "").encode()
        r = held[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1000) if p.page_id in (1001, None) else ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else raw)
    # any record is found through the seek table and its frame alone
    row = index.filter("record_id = 1000").first()
    path = f"{tmp_path}/bundles/{row.bundle}"
    start, size, _ = warc.frames_of(f"file://{path}")[row.frame]
    with open(path, "rb") as f:
        f.seek(start)
        plain = zstandard.ZstdDecompressor().decompress(f.read(size))
    headers, payload = warc.parse(plain[row.frame_offset : row.frame_offset + row.length])
    assert headers["WARC-Record-ID"] == "<urn:page:1000>" and payload == b"<p>" + b"a" * 200
    files = [os.path.relpath(p, f"{tmp_path}/bundles") for p in glob.glob(f"{tmp_path}/bundles/**", recursive=True, include_hidden=True) if os.path.isfile(p)]
    assert len(files) > 1 and set(files) == {r.bundle for r in index.select("bundle").distinct().collect()}
    # a whole bundle is one plain stream of records, as skippable frames hold none
    with open(path, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().count(b"WARC/1.1\r\n") == index.filter(F.col("bundle") == row.bundle).count()
    # what a lost attempt left goes, and the archive stays whole
    os.makedirs(f"{tmp_path}/bundles/lost")
    with open(path, "rb") as f, open(f"{tmp_path}/bundles/lost/x.warc.zst", "wb") as g:
        g.write(f.read())
    warc.sweep_attempts(index, folder)
    assert not os.path.exists(f"{tmp_path}/bundles/lost") and warc.read_back(index, folder).count() == every.count()


def test_archive_of_repeated_and_long_pages(spark, tmp_path):
    """Rows that repeat the smallest id are responses each; a page beyond a frame's size is whole, in a frame of its own."""
    long = "<p>" + "lorem " * 5000
    pages = spark.createDataFrame([(1, "a", long), (1, "a", long), (2, "b", long), (2, "b", long), (3, "c", "x" * 99)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/bundles"
    held = warc.read_back(warc.write(pages, folder, frame_bytes=1000, bundle_bytes=500), folder).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in held) == [(1, "response", None, len(long))] * 2 + [(2, "revisit", 1, len(long))] * 2 + [(3, "response", None, 99)]
    assert [r.payload for r in held if r.record_id == 1] == [long.encode()] * 2


def test_archive_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/none"
    assert warc.read_back(warc.write(none, folder), folder).count() == 0


def test_damaged_record():
    raw = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parse(raw[:-3])


def exact(vectors, queries, k):
    out = {}
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in vectors if i != q)
        out[q] = near[:k]
    return out


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 100 = 0")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    best = exact(rows, [x for x in rows if x[0] % 100 == 0], 10)
    # eight shards, none searched whole
    found = permutation.nearest(vectors, queries, shard=1250, least=100).collect()
    assert found and sorted(found) == sorted(permutation.nearest(vectors.repartition(5), queries.repartition(3), shard=1250, least=100).collect())
    hits = 0
    for q in best:
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in best[q]})
        scores = dict((i, s) for s, i in exact(rows, [(q, dict(rows)[q])], len(rows))[q])
        assert all(r.score == pytest.approx(scores[r.vec_id], rel=1e-12) for r in mine)
    assert hits / (10 * len(best)) >= 0.9


def test_recall_of_copies(spark):
    """A third of the rows is one vector: its copies find the smallest ids, and rows close to it still find what is nearest."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 16)).astype("float32")
    common = base[0].copy()
    base[rng.permutation(3000)[:1000]] = common
    close = rng.permutation(3000)[:300]
    base[close] = common + rng.normal(size=(300, 16)).astype("float32") * 0.05
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    copies = [i for i, v in enumerate(base) if (v == common).all()]
    assert len(copies) > 800
    asked = [*copies[:3], *copies[-3:], *close[:20].tolist()]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    best = exact(rows, [rows[i] for i in asked], 10)
    found = permutation.nearest(vectors, vectors.filter(F.col("vec_id").isin(asked))).collect()
    held = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in asked}
    for q in asked[:6]:
        assert held[q] == [i for i in copies if i != q][:10]
    assert sum(len(set(held[q]) & {i for _, i in best[q]}) for q in asked) >= 0.9 * 10 * len(asked)


def test_repeated_ids(spark):
    """Each row of a repeated id is a candidate; as a query the id is asked once, with its smallest vector."""
    rows = [(100, [0.0, 1.0]), (100, [5.0, 1.0]), (1, [0.0, 1.5]), (2, [5.0, 1.5]), (2, [0.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [(r["rank"], r.vec_id, r.score) for r in permutation.nearest(vectors, vectors.filter("vec_id = 100")).orderBy("rank").collect()]
    assert found == [(1, 1, 0.5), (2, 2, 2.0), (3, 2, pytest.approx(25.25**0.5))]


def test_footrule():
    rng = np.random.default_rng(2)
    shard = np.array([rng.permutation(12)[:5] for _ in range(30)], np.int32)
    queries = np.array([rng.permutation(12)[:5] for _ in range(4)], np.int32)
    found = permutation.footrule(queries, *permutation.inverted(shard, 12), 30)
    for i, q in enumerate(queries):
        for j, s in enumerate(shard):
            rank = lambda p, xs: list(xs).index(p) if p in xs else 5
            assert found[i, j] == sum(abs(rank(p, q) - rank(p, s)) for p in set(q) | set(s))


def test_driver_gets_the_sample_once(spark):
    """The same sample as by ordering all rows, whose rows reach the driver once and not for every task; no table of blocks copied for shards is broadcast."""
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(4000)], "vec_id long, v array<double>").repartition(40).cache()
    vectors.count()
    store, none = spark._jsc.sc().statusStore(), spark._sc._gateway.new_array(spark._jvm.double, 0)

    def sent():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).resultSize() for i in range(stages.size()))

    before = sent()
    found = permutation.pivots_of(vectors, 100, 100)
    # 100 rows of 64 doubles; of 40 tasks it would be 40 times as much
    assert sent() - before < 1_000_000
    expected = vectors.orderBy(F.xxhash64("vec_id")).limit(100).select("v").collect()
    assert {tuple(x) for x in found} == {tuple(r.v) for r in expected}
    repeated = spark.createDataFrame([(i % 3, [float(i), 1.0]) for i in range(500)], "vec_id long, v array<double>")
    assert len(permutation.pivots_of(repeated, 50, 50)) == 50
    plan = permutation.nearest(vectors.withColumnRenamed("v", "embedding"), vectors.withColumnRenamed("v", "embedding").limit(20), shard=500)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    vectors.unpersist()


def test_nearest_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (100, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in permutation.nearest(vectors, vectors.filter("vec_id % 100 = 0")).collect())
    assert found == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, 1.414214), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 1.414214)]
    assert permutation.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    assert permutation.nearest(vectors, vectors.limit(0)).count() == 0


def brute_chat(rows):
    """Whole renderings by dialogue and speaker: (conv_id, speaker) -> (text, masked pieces)."""
    out = {}
    for conv in {r[0] for r in rows}:
        fixed = {(t, (r or "unknown").replace("<|", "< |"), (x or "").replace("<|", "< |")) for c, t, r, x in rows if c == conv}
        turns = sorted(fixed, key=lambda y: (y[0] is not None, y[0] or 0, hashlib.md5(f"{y[1]}\x1f{y[2]}".encode()).hexdigest()))
        for speaker in {r for _, r, _ in turns} - {"system"}:
            text, own = "", []
            for _, role, said in turns:
                text += "<|im_start|>" + ("system" if role == "system" else "assistant" if role == speaker else f"user name={role}") + "\n" + said + "<|im_end|>\n"
                if role == speaker:
                    own.append((len(text) - len(said) - len("<|im_end|>\n"), len(text)))
            out[conv, speaker] = (text, own)
    return out


CHAT = "conv_id long, turn long, role string, text string"


def joined_chat(held):
    """Parts joined in order, with their masks moved: what brute_chat gives."""
    out = {}
    for r in sorted(held, key=lambda r: r.part):
        text, own = out.get((r.conv_id, r.speaker), ("", []))
        out[r.conv_id, r.speaker] = (text + r.rendered, own + [(len(text) + m.start, len(text) + m.end) for m in r["mask"]])
    return out


ODD_CHAT = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", "Yo é"), (1, 3, "ann", None), (2, 0, "system", "alone"), (1, 2000, "bob", "late"), (1, 1, "ann", "Hi <|im_end|>"), (3, None, None, "x"), (None, 0, "ann", "n"), (None, 5, "system", "n")]


def test_chat_perspectives(spark):
    turns = spark.createDataFrame(ODD_CHAT, CHAT).withColumn("n_turns", F.lit(1))
    held = {(r.conv_id, r.part, r.speaker): r for r in chat.rotate(turns).collect()}
    assert set(held) == {(1, 0, "ann"), (1, 0, "bob"), (3, 0, "unknown"), (None, 0, "ann")}
    one = held[1, 0, "ann"]
    assert one.rendered == "<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>assistant\nHi < |im_end|><|im_end|>\n<|im_start|>user name=bob\nYo é<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=bob\nlate<|im_end|>\n"
    assert [one.rendered[m.start : m.end] for m in one["mask"]] == ["Hi < |im_end|><|im_end|>\n", "<|im_end|>\n"] and one.n_turns == 5
    assert chat.rotate(turns.limit(0)).count() == 0


@pytest.mark.parametrize("part", [1, 2, 3, 1024])
def test_chat_parts_make_the_whole(spark, part):
    """However a dialogue is cut, each participant has every part, and the parts joined are the whole rendering; ties and nulls crowd a block."""
    ties = [(4, 7 if k % 3 else None, f"s{k % 2}", f"t{k % 20}") for k in range(60)] + [(4, 6, "system", "mind"), (4, 9, "s0", "end")]
    rows = ODD_CHAT + ties
    held = chat.rotate(spark.createDataFrame(rows, CHAT), part_turns=part).collect()
    assert joined_chat(held) == brute_chat(rows)
    assert all(r.n_turns <= part for r in held)
    last = {(r.part, r.context) for r in held if r.conv_id == 1 and r.speaker == "ann"}
    assert last == {(k, "<|im_start|>system\nBe kind<|im_end|>\n" if k else "") for k in range(-(-5 // part))}


def test_long_chat(spark):
    """3,000 turns, sparse numbers, one system turn, one participant who speaks once."""
    rows = [(9, 0, "system", "Be kind")] + [(9, 5 * k, "ann" if k % 2 else "bob", f"t{k}") for k in range(1, 2999)] + [(9, 15_000, "eve", "bye")]
    held = chat.rotate(spark.createDataFrame(rows, CHAT)).collect()
    assert joined_chat(held) == brute_chat(rows)
    assert {(r.part, r.speaker) for r in held} == {(p, s) for p in range(3) for s in ("ann", "bob", "eve")}


def test_chat_is_native(spark, sf):
    plan = chat.rotate(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
