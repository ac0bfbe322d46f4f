"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import bpe, jaccard, langid, media, packing, quality_classifier, quality_rules, secret_scan, tool_calls, warc

MULTI = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_as_media(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict_language(docs, langid.learn(docs))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), MULTI)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality_classifier.grade_documents(docs, quality_classifier.learn(docs, ratings))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked_turns(_table(spark, sf_dir, "conversations"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"), words=4, share=(85, 100))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.references(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns,
        op2_language_id,
        op3_byte_bpe,
        op4_best_fit_packing,
        op5_quality_classifier,
        op6_tool_calls,
        op7_warc,
        op8_ngram_jaccard,
        op9_secret_scans,
        op10_quality_rules,
    )
}

SQL: dict[str, str] = {
    "op6_tool_calls": r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, text, conv_id || '/' || turn AS id, conv_id || '/' || (turn - 2) AS after,
         count(*) OVER (PARTITION BY conv_id, turn) AS n
  FROM conversations WHERE coalesce(role, '') <> 'assistant'
), r AS (
  SELECT conv_id || '/' || (turn - 1) AS id, coalesce(min(text), '') AS result FROM conversations WHERE role = 'assistant' GROUP BY ALL
), p AS (
  SELECT id, CAST(0 AS BIGINT) AS place FROM c WHERE n = 1 AND after NOT IN (SELECT id FROM c WHERE n = 1)
  UNION ALL
  SELECT c.id, p.place + 1 FROM c JOIN p ON c.after = p.id WHERE c.n = 1
)
SELECT c.id, c.after, c.role AS name, r.id IS NOT NULL AS answered, p.place,
       CASE WHEN c.n > 1 THEN 'id: not unique' WHEN coalesce(c.role, '') NOT IN ('user', 'system') THEN 'name: unknown tool' WHEN c.text IS NULL THEN 'text: missing' END AS error,
       '{"arguments":{' || coalesce('"text":' || to_json(c.text) || ',', '') || '"turn":' || c.turn || '},"id":' || to_json(c.id) || ',"name":' || to_json(c.role)
         || coalesce(',"result":' || to_json(r.result), '') || '}' AS message
FROM c LEFT JOIN r ON r.id = c.id LEFT JOIN p ON p.id = c.id
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
""",
}
