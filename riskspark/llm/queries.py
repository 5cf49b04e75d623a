"""One registered query per operator, with production parameters over whole tables,
and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.bpe import encode_documents
from riskspark.llm.collocations import HELD_PCT, LEAST, TOP, collocations
from riskspark.llm.common import table
from riskspark.llm.conversation import damage, repair_report
from riskspark.llm.dom import extract_main_text
from riskspark.llm.langid import identify_language
from riskspark.llm.line_rules import LINE_HOST_PCT, LINE_MIN_DOCS, MIN_LEFT_PCT, SHARE_HOST_DOCS, SHARE_MIN_DOCS, quality_rules
from riskspark.llm.ngram_join import jaccard_components
from riskspark.llm.packing import pack_documents
from riskspark.llm.personal_data import personal_data_digest
from riskspark.llm.quality import score_quality
from riskspark.llm.simhash import edited_fingerprints, near_counts
from riskspark.llm.toxicity import score_toxicity
from riskspark.llm.warc import warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


OP1_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3]))
    END AS sh FROM d
), t AS (
  SELECT rid, len(sh) AS n, unnest(sh) AS token FROM s
), inter AS (
  SELECT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM t a JOIN t b ON a.token = b.token AND a.rid < b.rid
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL
), link AS (
  SELECT a, b FROM inter WHERE 100 * c >= 85 * (na + nb - c)
), two AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT rid AS a, rid AS b FROM s
  UNION
  SELECT r.a, e.b FROM reach r JOIN two e ON r.b = e.a
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach r ON s.rid = r.a JOIN s o ON o.rid = r.b
GROUP BY s.rid, s.doc_id, len(s.sh)
"""


@query("op1_ngram_join", OP1_SQL)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p
), g AS (
  SELECT hex, payload_bytes, min(page_id) AS first FROM d GROUP BY ALL
)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((CAST('0x' || substr(d.hex, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT)
                       >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN d.page_id = g.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> g.first THEN g.first END AS refers_to
FROM d JOIN g ON d.hex = g.hex AND d.payload_bytes = g.payload_bytes
"""


@query("op2_warc", OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP packages, read back by range."""
    out = warc_round_trip(table(spark, sf_dir, "pages"))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and edited texts; ``n_near`` counts the other
    fingerprints of the table within the Hamming radius, by the block tables."""
    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    near = near_counts(out.select("fp"))
    out = out.join(near, out.fp == near.near_fp, "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                      "near_next", F.coalesce("n_near", F.lit(0)).alias("n_near"))


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("n_passages", F.size("passages")).drop("passages")


OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d
), tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, count(DISTINCT pos) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM tri) WHERE c >= 2)
  GROUP BY rid
), l AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), norm AS (
  SELECT d.rid, d.host, d.text, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line
  FROM (SELECT rid, unnest(ls) AS x FROM l) q JOIN d USING (rid)
), hosts AS (
  SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host
), frequent AS (
  SELECT n.host, n.line FROM norm n JOIN hosts h ON n.host IS NOT DISTINCT FROM h.host
  GROUP BY n.host, n.line, h.host_docs
  HAVING count(DISTINCT n.text) > {LINE_MIN_DOCS} OR (count(DISTINCT n.text) >= {SHARE_MIN_DOCS}
         AND h.host_docs >= {SHARE_HOST_DOCS} AND count(DISTINCT n.text) * 100 > h.host_docs * {LINE_HOST_PCT})
), lost AS (
  SELECT n.rid, sum(len(string_split(n.line, ' '))) AS lost
  FROM norm n JOIN frequent f ON n.line = f.line AND n.host IS NOT DISTINCT FROM f.host GROUP BY n.rid
), base AS (
  SELECT d.rid, d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l.ls) - len(list_distinct(l.ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(x.lost, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN rep r USING (rid) LEFT JOIN lost x USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND 100 * (n_words - removed_words) >= {MIN_LEFT_PCT} * n_words AS kept,
       removed_words
FROM base
"""


@query("op9_line_rules", OP9_SQL)
def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as the contract says, then repaired."""
    return repair_report(damage(table(spark, sf_dir, "conversations")))


OP12_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p
), f1 AS (
  SELECT lang, word, count(*) AS f FROM (SELECT lang, unnest(ws) AS word FROM w) GROUP BY ALL
), f2 AS (
  SELECT lang, g.a AS w1, g.b AS w2, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: {{'a': ws[i], 'b': ws[i+1]}})) AS g FROM w) GROUP BY ALL
), f3 AS (
  SELECT lang, g.a AS w1, g.b AS w2, g.c AS w3, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'a': ws[i], 'b': ws[i+1], 'c': ws[i+2]}})) AS g FROM w)
  GROUP BY ALL HAVING count(*) >= {LEAST}
), totals AS (
  SELECT lang, sum(f) AS n FROM f1 GROUP BY lang
), cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f3 t JOIN f1 x ON t.lang = x.lang AND t.w1 = x.word JOIN f2 y ON t.lang = y.lang AND t.w2 = y.w1 AND t.w3 = y.w2
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM f3 t JOIN f2 x ON t.lang = x.lang AND t.w1 = x.w1 AND t.w2 = x.w2 JOIN f1 y ON t.lang = y.lang AND t.w3 = y.word
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2, t.f, 1, x.f, y.f
  FROM f2 t JOIN f1 x ON t.lang = x.lang AND t.w1 = x.word JOIN f1 y ON t.lang = y.lang AND t.w2 = y.word
  WHERE t.f >= {LEAST}
    AND NOT EXISTS (SELECT 1 FROM f3 z WHERE z.lang = t.lang AND z.w1 = t.w1 AND z.w2 = t.w2 AND 100 * z.f >= {HELD_PCT} * t.f)
    AND NOT EXISTS (SELECT 1 FROM f3 z WHERE z.lang = t.lang AND z.w2 = t.w1 AND z.w3 = t.w2 AND 100 * z.f >= {HELD_PCT} * t.f)
), scored AS (
  SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, score
FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= {TOP}
"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(table(spark, sf_dir, "documents"))
