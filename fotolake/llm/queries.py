"""The operators' queries over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.llm import archives, conversation_repair, decontamination, html_text, kneser_ney, language_id, license_scan, piece_coding, pii, quality_rules, simhash, token_alignment, url_filter
from fotolake.llm.common import remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = remainder(F.col("doc_id"), 4)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(part != 2))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = remainder(F.col("doc_id"), 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a NULL text is an empty one, and is learnt from too
    model = kneser_ney.train(docs.filter(part != 1))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_coding.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' URLs, fetched on dates that follow from their ids, against a log that follows from their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(DATE '2024-01-01', CAST(page_id * 37 % 366 AS INT))"))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("entry"), "page_id").groupBy("entry").agg(F.min("page_id").alias("m"), F.count("*").alias("n")).dropna()
    added = F.expr("date_add(DATE '2024-01-01', CAST(m * 53 % 300 AS INT))")
    removed = F.date_add(added, (20 + F.col("n") % 90).cast("int"))
    event = lambda when, entry, action, at: F.when(when, F.struct(entry.alias("entry"), F.lit(action).alias("action"), at.alias("at")))
    listed, again, wide = F.col("m") % 3 == 0, F.col("m") % 6 == 0, F.col("m") % 50 == 7
    parent = F.regexp_extract("entry", r"([^.]+\.[^.]+)$", 1)
    log = hosts.select(F.explode(F.array(
        event(listed, F.col("entry"), "add", added), event(listed, F.col("entry"), "remove", removed),
        event(again, F.col("entry"), "add", F.date_add(removed, 45)),
        event(wide, parent, "add", F.lit("2024-12-01").cast("date")), event(wide, parent, "remove", F.lit("2024-12-11").cast("date")),
    )).alias("e")).select("e.*").dropna()
    return url_filter.judge(captures, log).select("page_id", "url", "fetched", "host", "blocked", "entry")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), *models)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_repair.digest(conversation_repair.damage(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_quality_rules, op3_html_text, op4_kneser_ney, op5_license_scan, op6_decontamination, op7_piece_coding, op8_pii, op9_url_filter, op10_simhash, op11_token_alignment, op12_warc_packages, op13_conversation_repair)
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op6_decontamination": r"""
WITH parts AS (
  SELECT true AS is_doc, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT false, item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
shingles AS (
  SELECT DISTINCT is_doc, id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
           WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM parts),
sizes AS (SELECT id AS item_id, count(*) AS n FROM shingles WHERE NOT is_doc GROUP BY id),
pairs AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared
  FROM shingles d JOIN shingles i ON d.g = i.g WHERE d.is_doc AND NOT i.is_doc GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, shared, CAST(shared AS DOUBLE) / n AS containment
FROM pairs JOIN sizes USING (item_id) WHERE shared >= 0.8e0 * n - 1e-9
""",
    "op9_url_filter": r"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([A-Za-z0-9._-]+)', 1)), '^www\.', ''), '') AS host
  FROM pages),
hosts AS (SELECT host AS entry, min(page_id) AS m, count(*) AS n FROM captures WHERE host IS NOT NULL GROUP BY host),
dated AS (
  SELECT *, DATE '2024-01-01' + CAST(m * 53 % 300 AS INTEGER) AS added,
         DATE '2024-01-01' + CAST(m * 53 % 300 + 20 + n % 90 AS INTEGER) AS removed FROM hosts),
log AS (
  SELECT entry, true AS on_, added AS day FROM dated WHERE m % 3 = 0
  UNION ALL SELECT entry, false, removed FROM dated WHERE m % 3 = 0
  UNION ALL SELECT entry, true, removed + 45 FROM dated WHERE m % 6 = 0
  UNION ALL SELECT regexp_extract(entry, '([^.]+\.[^.]+)$', 1), true, DATE '2024-12-01' FROM dated WHERE m % 50 = 7
  UNION ALL SELECT regexp_extract(entry, '([^.]+\.[^.]+)$', 1), false, DATE '2024-12-11' FROM dated WHERE m % 50 = 7),
states AS (SELECT entry, day, bool_and(on_) AS on_ FROM log GROUP BY entry, day),
hits AS (
  SELECT c.page_id, c.url, s.entry, arg_max(s.on_, s.day) AS on_
  FROM captures c JOIN states s ON (c.host = s.entry OR (ends_with(c.host, '.' || s.entry) AND contains(s.entry, '.'))) AND s.day <= c.fetched
  GROUP BY c.page_id, c.url, s.entry),
best AS (SELECT page_id, url, arg_max(entry, length(entry)) AS entry FROM hits WHERE on_ GROUP BY page_id, url)
SELECT c.page_id, c.url, c.fetched, c.host, b.entry IS NOT NULL AS blocked, b.entry
FROM captures c LEFT JOIN best b ON c.page_id = b.page_id AND c.url = b.url
""",
    "op12_warc_packages": r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best
  FROM pages),
fives AS (
  SELECT *, list_transform(range(32), lambda i: (CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS n
  FROM payloads)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(n, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN best END AS refers_to
FROM fives
""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
