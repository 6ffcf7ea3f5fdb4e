"""The operators' queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outrider.llm import bpe, exact_dedup, licenses, lm, ngram_join, packing, pii, quality, sharding, urls
from outrider.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Host, path, action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_shard_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards whose counts differ by one at most."""
    placed = sharding.shard_bounded(table(spark, sf_dir, "documents"), F.col("doc_id"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("home").alias("home_shard"))


def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the hidden Markov model and by single words."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm.score_documents(table(spark, sf_dir, "documents"), held_out)


def op3_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' tokens in windows of 1024."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), TOKENIZER, 1024, payload="crc32")
    return packing.pack(pieces, 1024)


def op4_jaccard_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id that near-duplicate links lead to."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and whether it is kept."""
    judged = quality.judge_lines(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), wins AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM wins WHERE times > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(list_sum(list_transform(list_filter(l, lambda x:
           regexp_matches(x, '[.!?…。！？](?:[\x20\x09-\x0D"''»”’)\]]|$)')
           AND NOT regexp_matches(x, '^[^|>»•·]*(?:[|»•·]|\x20>\x20)[^|>»•·]*(?:[|»•·]|\x20>\x20)')
           AND NOT regexp_matches(x, '(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept (?:all )?cookies|click here|enable javascript|skip to (?:main )?content|sign up for our newsletter|back to top)\b')
           AND len(regexp_extract_all(x, '(?:[#*$%&|<>]|!!+)[^\x20\x09-\x0D]*')) <= 0.3::DOUBLE * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
         ), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')))), 0)::BIGINT AS left_chars
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - left_chars <= 0.5::DOUBLE * word_chars AS kept,
       word_chars - left_chars AS lost_chars
FROM m
"""


def op6_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of a tree by source and language: its licence, or the one it inherits."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit("corpus"), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    templates = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")
    return licenses.scan(docs, templates, path)


def taken_in_before(docs: DataFrame):
    """Which documents count as taken in before: by a hash of the id, about half of them."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0


def op7_exact_dedup_mph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of all equal texts."""
    docs = table(spark, sf_dir, "documents")
    found = exact_dedup.exact_dedup(docs, taken_in_before(docs))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def op8_bpe_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""

    def row(coder: bpe.ByteBpe, doc, ids, _):
        return [(doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest())]

    return bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER, row, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data and of the words that reveal it."""
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    told = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    base = told(F.filter("spans", lambda s: s["kind"] != pii.TERM))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op10_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules; a page that none fits is allowed."""
    listed = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.judge(table(spark, sf_dir, "pages"), listed)


OP10_SQL = """
WITH s AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s
), r(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""

QUERIES = {f.__name__: f for f in (op1_shard_bounded_ring, op2_hmm_scores, op3_pack_best_fit, op4_jaccard_vertical, op5_line_first_quality, op6_license_tfidf, op7_exact_dedup_mph, op8_bpe_numpy, op9_pii_disclosure, op10_url_bloom)}
ORACLE = {"op5_line_first_quality": OP5_SQL, "op7_exact_dedup_mph": OP7_SQL, "op10_url_bloom": OP10_SQL}
