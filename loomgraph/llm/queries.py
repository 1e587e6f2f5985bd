"""The registered queries of this subpackage: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, chat, licences, mixing, neardup, permutation, quality, repetition, substrings, warc
from loomgraph.llm.common import digest, read


def vocabulary_file(name: str) -> str:
    """A public vocabulary's place: in the folder that LOOMGRAPH_TOKENIZERS names, else where its package says."""
    folder = os.environ.get("LOOMGRAPH_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> str:
    return vocabulary_file("byte_bpe_50k.json")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fitted on labelled rows outside the held-out fold."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    return quality.train(docs.filter(learn), labels.filter(learn))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return quality.classify(docs, quality_model(docs, read(spark, sf_dir, "labels")), keep_text=False).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, byte_bpe())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        digest("decoded").alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = warc.archive_folder(pages)
    back = warc.read_back(warc.write(pages, folder), folder, payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.reached = p.a)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = chat.rotate(read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return turned.select("conv_id", "part", "speaker", "n_turns", "context", "rendered", spans.alias("mask_spans"))


OP7_SQL = f"""
WITH d AS (
  SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         coalesce(role, 'unknown') = 'system' AS context
  FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(31) || text)) - 1 AS rank FROM d),
p AS (SELECT *, CAST(floor(rank / {chat.PART_TURNS}) AS BIGINT) AS part FROM t),
e AS (SELECT conv_id, part, arg_max('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), rank) FILTER (WHERE context) AS last FROM p GROUP BY 1, 2),
c AS (SELECT conv_id, part, coalesce(last_value(last IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM e),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM d WHERE NOT context),
r AS (
  SELECT s.conv_id, p.part, s.speaker, p.rank, NOT p.context AND p.role = s.speaker AS own,
         '<|im_start|>' || CASE WHEN p.context THEN p.role WHEN p.role = s.speaker THEN 'assistant' ELSE 'user name=' || p.role END || chr(10) AS head,
         p.text || '<|im_end|>' || chr(10) AS body
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM r),
g AS (
  SELECT conv_id, part, speaker, count(*) AS n_turns, string_agg(head || body, '' ORDER BY rank) AS rendered,
         coalesce(string_agg(CAST(upto - length(body) AS VARCHAR) || '-' || CAST(upto AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE own), '') AS mask_spans
  FROM o GROUP BY conv_id, part, speaker)
SELECT g.conv_id, g.part, g.speaker, g.n_turns, c.before AS context, g.rendered, g.mask_spans
FROM g JOIN c ON g.conv_id IS NOT DISTINCT FROM c.conv_id AND g.part = c.part
"""


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return found.select("doc_id", "n_words", "n_removed", digest(kept).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
g AS (SELECT doc_id, k, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS g FROM k),
d AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1 AS again FROM g WHERE k + 19 <= n),
c AS (
  SELECT k.doc_id, k.k, k.word, coalesce(bool_or(again) OVER (PARTITION BY k.doc_id ORDER BY k.k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM k LEFT JOIN d ON k.doc_id = d.doc_id AND k.k = d.k),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id)
"""


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _repeated(n: int) -> str:
    return f"""SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
      FROM (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM p WHERE i + {n - 1} <= n_words)) WHERE c > 1"""


OP9_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, len(ws) AS n_words, unnest(range(1, len(ws) + 1)) AS i FROM w),
r3 AS ({_repeated(3)}),
r10 AS ({_repeated(10)}),
r101 AS ({_repeated(101)}),
c3 AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r3, (SELECT unnest(range(3)) AS o) GROUP BY 1),
c10 AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r10, (SELECT unnest(range(10)) AS o) GROUP BY 1),
long AS (SELECT DISTINCT doc_id FROM r101),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
         coalesce(c3.n, 0) AS n_repeat_words, coalesce(c10.n, 0) AS n_covered, long.doc_id IS NOT NULL AS too_long
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c10 USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered <= 30 * n_words AND NOT too_long AS kept
FROM m
"""


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _templates() -> str:
    rows = ((one.label, one.base, b" ".join(one.phrase).decode(), b" ".join(one.words).decode(), one.phrase_at) for one in licences.templates())
    return ", ".join(f"('{label}', {base}, '{phrase}', '{words}', {at})" for label, base, phrase, words, at in rows)


OP10_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT label, base, phrase, string_split(phrase, ' ') AS must, string_split(words, ' ') AS words, shift FROM (VALUES {_templates()}) v(label, base, phrase, words, shift)),
p AS (
  SELECT doc_id, ws, label, base, must, words, shift, unnest(range(1, len(ws) + 1)) AS i
  FROM w JOIN t ON strpos(concat(' ', array_to_string(ws, ' '), ' '), concat(' ', phrase, ' ')) > 0),
h AS (
  SELECT doc_id, label, base, i - 1 AS place, len(words) AS n,
         list_sum(list_transform(range(1, len(words) + 1), lambda j: CASE WHEN i - shift + j - 1 >= 1 AND ws[i - shift + j - 1] = words[j] THEN 1 ELSE 0 END)) AS m
  FROM p WHERE ws[i:i + len(must) - 1] = must),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(place) FILTER (WHERE base) AS first_word, max(place) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         round(max(m / n * (1 - pow(2, -m / {licences.HALF}))), 6) AS score
  FROM h GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN g USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_bpe": op2_bpe,
        "op3_warc": op3_warc,
        "op4_mixing": op4_mixing,
        "op5_permutation": op5_permutation,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_chat": op7_chat,
        "op8_substrings": op8_substrings,
        "op9_repetition": op9_repetition,
        "op10_licences": op10_licences,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op6_near_duplicates": OP6_SQL, "op7_chat": OP7_SQL, "op8_substrings": OP8_SQL, "op9_repetition": OP9_SQL, "op10_licences": OP10_SQL}
