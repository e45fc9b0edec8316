"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chunks, fim, ngramjoin, packing, quality, secret_scan, spelling, spotsigs, substring, toxicity, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS own FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d) r),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY own ORDER BY doc_id, i) AS k FROM windows) f WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS text FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id AND words.p = covered.p WHERE covered.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(chat.format_conversations(rows))


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (  -- a backslash after the first character of control strings, and before backslashes
  SELECT *, replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS role1,
    replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS text1 FROM rows),
shown AS (
  SELECT *, CASE WHEN regexp_matches(role || chr(10) || text, '</?s>|\[/?INST\]') OR regexp_matches(role, '\\[\s\S]') OR regexp_matches(text, '\\[\s\S]')
    THEN '<s>' || role1 || '[INST]' || text1 || '</s>'
    ELSE '<s>' || role || '[INST]' || text || '</s>' END AS rendered FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(rendered)) AS BIGINT) AS formatted_chars, true AS identical
FROM shown GROUP BY conv_id
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(*warc.archive(table(spark, sf_dir, "pages")))


OP5_SQL = """
WITH facts AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
held AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM facts)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM held
"""


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


_COMMON = "[" + ", ".join(f"'{w}'" for w in sorted({w for words in spotsigs.COMMON.values() for w in words})) + "]"
_BREAKS = " || ".join(f"chr({ord(c)})" for c in spotsigs._BREAKS)
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after FROM d),
e AS (SELECT doc_id, text, substr(text, 1, length(text) - length(text) // 4) || substr(after, 1, length(text) // 4) AS edited FROM n),
w AS (SELECT doc_id, kind, list_filter(string_split(translate(lower(t), {_BREAKS}, repeat(' ', {len(spotsigs._BREAKS)})), ' '), lambda x: x <> '') AS w
  FROM (SELECT doc_id, 0 AS kind, text AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e) b),
c AS (SELECT *, [{{'x': w[i], 'anchored': i > 1 AND list_contains({_COMMON}, w[greatest(i - 1, 1)])}} FOR i IN range(1, len(w) + 1) IF NOT list_contains({_COMMON}, w[i])] AS c FROM w),
h AS (SELECT *, [{{'anchored': c[i].anchored, 'h': md5(c[i].x || ' ' || c[i + 1].x || ' ' || c[i + 2].x)[1:16]}} FOR i IN range(1, greatest(len(c) - 1, 1))] AS h FROM c),
s AS (SELECT doc_id, kind, CASE WHEN len(c) < 3 AND len(w) > 0 THEN [md5('short ' || array_to_string(w, ' '))[1:16]]
  WHEN len(list_filter(h, lambda x: x.anchored)) > 0 THEN list_sort(list_distinct([x.h FOR x IN h IF x.anchored])) ELSE list_sort(list_distinct([x.h FOR x IN h])) END AS s FROM h),
o AS (SELECT a.doc_id, a.s AS own, b.s AS edited, coalesce(lead(a.s) OVER (ORDER BY a.doc_id), first_value(a.s) OVER (ORDER BY a.doc_id)) AS after FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.kind = 0 AND b.kind = 1),
k AS (SELECT *, len(list_intersect(own, edited)) AS k1, len(list_intersect(own, after)) AS k2 FROM o)
SELECT k.doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, len(own) || ':' || array_to_string(own, '.') AS fingerprint, len(k.edited) || ':' || array_to_string(k.edited, '.') AS edited_fingerprint,
  CASE WHEN len(own) + len(k.edited) = 0 THEN 1.0::DOUBLE ELSE CAST(k1 AS DOUBLE) / (len(own) + len(k.edited) - k1) END AS near_edited,
  CASE WHEN len(own) + len(after) = 0 THEN 1.0::DOUBLE ELSE CAST(k2 AS DOUBLE) / (len(own) + len(after) - k2) END AS near_next
FROM k JOIN e ON k.doc_id = e.doc_id
"""


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) r),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, o) AS (SELECT a, a FROM sides UNION SELECT reach.doc_id, sides.b FROM reach JOIN sides ON reach.o = sides.a),
least AS (SELECT doc_id, min(o) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN least ON d.doc_id = least.doc_id
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, index).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "evidence")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w FROM d),
c AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS h1, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
p AS (SELECT doc_id, text, n, array_to_string(w[1:least(h1, h2)], '') AS prefix, array_to_string(w[least(h1, h2) + 1:greatest(h1, h2)], '') AS middle, array_to_string(w[greatest(h1, h2) + 1:n], '') AS suffix,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""


def op13_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.groups(table(spark, sf_dir, "documents")).drop("n_chunks")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_substring": op2_substring,
        "op3_chat": op3_chat,
        "op4_packing": op4_packing,
        "op5_warc": op5_warc,
        "op6_spotsigs": op6_spotsigs,
        "op7_ngram_join": op7_ngram_join,
        "op8_bpe": op8_bpe,
        "op9_secrets": op9_secrets,
        "op10_toxicity": op10_toxicity,
        "op11_spelling": op11_spelling,
        "op12_fim": op12_fim,
        "op13_chunks": op13_chunks,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring": OP2_SQL, "op3_chat": OP3_SQL, "op5_warc": OP5_SQL, "op6_spotsigs": OP6_SQL, "op7_ngram_join": OP7_SQL, "op12_fim": OP12_SQL, "op13_chunks": OP13_SQL}
