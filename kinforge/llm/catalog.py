"""The queries of this subpackage: each applies its operator to the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.llm import bpe, conversations, filter_audit, fingerprints, line_dedup, packing, quality, secret_scan, segment_bpe, sharding, simhash, suffix_dedup, token_store
from kinforge.llm.common import read_documents

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), WORD_TOKENIZER)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.byte_shards(read_documents(spark, sf_dir), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read_documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_ids(read_documents(spark, sf_dir), BYTE_TOKENIZER)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = line_dedup.line_verdicts(read_documents(spark, sf_dir), line_dedup.EVERY_LINE, line_dedup.NEAR_WORDS)
    return verdicts.select("doc_id", "n_lines", "n_long", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(read_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_documents(spark, sf_dir), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.without_spans(suffix_dedup.repeated_spans(read_documents(spark, sf_dir), 200))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(read_documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_bpe.round_trip(read_documents(spark, sf_dir), BYTE_TOKENIZER, public_tokenizers.PATTERN)


_ALL = (
    op1_packing, op2_sharding, op3_secret_scans, op4_byte_bpe, op5_token_output, op6_line_dedup, op7_quality_rules, op8_simhash, op9_suffix_dedup, op10_fingerprints,
    op11_filter_audit, op12_conversation_repair, op13_segment_bpe,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_OP6 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS no FROM split),
w AS (SELECT doc_id, no, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM l),
long AS (SELECT doc_id, no, words, row_number() OVER (ORDER BY doc_id, no) AS pos FROM w WHERE len(words) >= {line_dedup.EVERY_LINE}),
firsts AS (SELECT words, array_to_string(words, ' ') AS line, min(pos) AS pos FROM long GROUP BY words),
each AS (SELECT pos, words, unnest(range(len(words))) AS i FROM firsts WHERE len(words) >= {line_dedup.NEAR_WORDS}),
cut AS (SELECT pos, i, len(words) AS m, array_to_string(list_concat(words[1:i], words[i + 2:]), ' ') AS rest FROM each),
late AS (
  SELECT a.pos FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.m = b.m AND b.pos < a.pos
  UNION SELECT a.pos FROM cut a JOIN firsts b ON a.rest = b.line AND b.pos < a.pos AND len(b.words) >= {line_dedup.NEAR_WORDS}
  UNION SELECT b.pos FROM cut a JOIN firsts b ON a.rest = b.line AND a.pos < b.pos AND len(b.words) >= {line_dedup.NEAR_WORDS}),
gone AS (SELECT doc_id, no FROM long WHERE pos NOT IN (SELECT pos FROM firsts WHERE pos NOT IN (SELECT pos FROM late))),
per_doc AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS removed FROM gone GROUP BY doc_id),
longs AS (SELECT doc_id, count(*) AS n_long FROM long GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_lines, coalesce(n_long, 0) AS n_long, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM split s LEFT JOIN longs USING (doc_id) LEFT JOIN per_doc USING (doc_id)
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT *, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM l WHERE regexp_matches(line, '{WORD}')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY doc_id),
windows AS (SELECT doc_id, i, words[i + 1:i + 3] AS w FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 2, 0))) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
texts AS (SELECT host, text, min(doc_id) AS first FROM d GROUP BY host, text),
each AS (SELECT t.host, t.text, t.first, array_to_string(w, ' ') AS h, sum(len(w)) AS words FROM full_lines f JOIN texts t ON f.doc_id = t.first GROUP BY ALL),
frequent AS (SELECT host, h, min(first) AS holder FROM each GROUP BY host, h HAVING count(*) >= {quality.MIN_DOCS}),
lost AS (SELECT host, text, sum(words) AS removed_words FROM each JOIN frequent USING (host, h) WHERE first <> holder GROUP BY host, text),
counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (host, text)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND removed_words <= {quality.MAX_REMOVED} * n_words AS kept FROM based
"""

_OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, good, toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.i <> a.i JOIN letters c ON c.i NOT IN (a.i, b.i)
    JOIN letters d ON d.i NOT IN (a.i, b.i, c.i) JOIN letters e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
steps AS (SELECT *, unnest(range(1, 6)) AS step FROM orders),
each AS (
  SELECT part, filter_order, step, o[step] AS i, n, good, toxic, fails[o[step]] AS here, list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])) IS TRUE AS before,
    len(list_filter(fails, lambda x: x)) = 1 AS one
  FROM cells CROSS JOIN steps),
summed AS (
  SELECT part, filter_order, step, i, CAST(sum(n) FILTER (NOT here AND NOT before) AS BIGINT) AS kept, CAST(sum(n) FILTER (here AND NOT before) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (here AND before) AS BIGINT) AS redundant, CAST(sum(n) FILTER (here AND one) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (here AND NOT before) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (here AND NOT before) AS BIGINT) AS toxic_lost
  FROM each GROUP BY part, filter_order, step, i)
SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, i), 0) AS BIGINT) AS shapley
FROM summed
"""

#: The others need a tokenizer, a hash or a checksum that DuckDB lacks; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {"op6_line_dedup": _OP6, "op7_quality_rules": _OP7, "op11_filter_audit": _OP11}
