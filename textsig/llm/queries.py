"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import spread
from . import bpe, chats, counts, leaks, licenses, near, parsing, pii, quality, warc
from .shared import documents


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.links(documents(spark, sf_dir))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(documents(spark, sf_dir)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf_dir))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.conversations(chats.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def branching_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op4 on trees that branch: a message replies to any earlier one."""
    return chats.conversations(chats.branching(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(spread(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    restored = warc.restore(*warc.archive(warc.records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
    return restored.withColumn("record", F.col("record").cast("string"))


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spread(documents(spark, sf_dir)))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprint(spread(documents(spark, sf_dir)))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spread(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if (name.startswith("op") or name == "branching_conversations") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name.removesuffix("_SQL").lower(): sql for name, sql in globals().items() if name.isupper() and name.endswith("_SQL")}


OP2_NGRAM_JACCARD_JOIN_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT doc_a, doc_b FROM common JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b
  WHERE c / (x.n + y.n - c)::DOUBLE >= 0.7 - 1e-9),
reach AS (SELECT doc_id, doc_id AS other FROM documents WHERE doc_id IS NOT NULL UNION SELECT reach.doc_id, doc_b FROM reach JOIN pairs ON doc_a = other),
classes AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
degrees AS (SELECT doc_a AS doc_id, count(*) AS n FROM pairs GROUP BY doc_a)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM classes LEFT JOIN degrees USING (doc_id)
"""

_MESSAGES = r"""
WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
step AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM (SELECT DISTINCT conv_id, turn FROM c)),
said AS (SELECT conv_id AS tree_id, turn * 1048576 + row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text) - 1 AS message_id, earlier * 1048576 AS parent_id, text,
  len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')))::DOUBLE AS score, '<|' || coalesce(role, 'user') || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS line
  FROM c JOIN step USING (conv_id, turn)),"""
_PATHS = """
p AS (SELECT tree_id, message_id, [message_id] AS path, score, line AS text FROM m WHERE parent_id IS NULL
  UNION ALL SELECT m.tree_id, m.message_id, list_append(p.path, m.message_id), p.score + m.score, p.text || m.line FROM p JOIN m ON m.tree_id = p.tree_id AND m.parent_id = p.message_id)
SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY score DESC, message_id) AS rank, message_id AS leaf_id, score, len(path) AS n_turns, text FROM p
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tree_id = p.tree_id AND m.parent_id = p.message_id)
"""
OP4_CHAT_FORMATTING_SQL = f"{_MESSAGES} m AS (SELECT * FROM said), {_PATHS}"
BRANCHING_CONVERSATIONS_SQL = f"""{_MESSAGES}
placed AS (SELECT * EXCLUDE (parent_id), row_number() OVER (PARTITION BY tree_id ORDER BY message_id) - 1 AS before FROM said),
m AS (SELECT x.tree_id, x.message_id, y.message_id AS parent_id, x.score, x.line FROM placed x LEFT JOIN placed y ON y.tree_id = x.tree_id AND x.before > 0 AND y.before = length(x.text) % nullif(x.before, 0)), {_PATHS}"""

OP6_WARC_ARCHIVE_SQL = r"""
WITH r AS (SELECT page_id, url, html, sha256(html) AS digest, chr(13) || chr(10) AS nl FROM pages)
SELECT page_id AS record_id, digest, CASE WHEN html IS NOT NULL THEN true END AS verified,
  'WARC/1.0' || nl || 'WARC-Type: response' || nl || coalesce('WARC-Target-URI: ' || url || nl, '') || 'WARC-Date: 2024-01-01T00:00:00Z' || nl
  || 'WARC-Record-ID: <urn:sha256:' || sha256(coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '')) || '>' || nl || coalesce('WARC-Payload-Digest: sha256:' || digest || nl, '')
  || 'Content-Type: text/html' || nl || 'Content-Length: ' || coalesce(strlen(html), 0) || nl || nl || coalesce(html, '') || nl || nl AS record
FROM r
"""
