"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, mixing, packing, pii, quality, secret_scan, simhash, token_count, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
MIX_SEED = 0
SHARDS = 40


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture with equal weights: whole documents, repeated, with copy and shuffle_key."""
    return mixing.mix(table(spark, sf_dir, "documents"), seed=MIX_SEED, extras=True)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.shard(table(spark, sf_dir, "documents"), SHARDS)
    return rows.selectExpr("doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base, kept = quality.failed(quality.BASE).alias("base_failed"), (~quality.failed(quality.STRICT)).alias("kept")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, kept, "fail_bits")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.append(top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    named = (op1_mix_sources, op2_simhash_dedup, op3_best_fit_shards, op4_secret_scan, op5_url_filter, op6_language_id, op7_quality_ledger, op8_pii, op9_token_counts, op10_decontaminate, pipeline)
    return {f.__name__: f for f in named}


OP1_SQL = f"""
WITH RECURSIVE sums AS (
  SELECT source, sum(coalesce(octet_length(encode(text)), 0)) AS bytes FROM documents GROUP BY source
), weighed AS (
  SELECT source, CAST(bytes AS DOUBLE) AS bytes, 1.0::DOUBLE AS w FROM sums WHERE bytes > 0
), rated AS (
  SELECT source, w / (SELECT sum(w) FROM weighed) * (SELECT sum(bytes) FROM weighed) / bytes AS rate FROM weighed
), parted AS (
  SELECT source, greatest(CAST(ceil(rate / {mixing.RATE_PART}) AS BIGINT), 1) AS parts, rate / greatest(CAST(ceil(rate / {mixing.RATE_PART}) AS BIGINT), 1) AS part_rate FROM rated
), terms AS (
  SELECT source, part_rate, 0 AS k, exp(-part_rate) AS p, exp(-part_rate) AS cdf FROM parted
  UNION ALL
  SELECT source, part_rate, k + 1, p * part_rate / (k + 1), cdf + p * part_rate / (k + 1) FROM terms WHERE k < {mixing.TERMS} AND (k < part_rate + 1 OR cdf + p * part_rate / (k + 1) > cdf)
), tables AS (
  SELECT source, list(cdf ORDER BY k) AS cdfs FROM terms GROUP BY source
), numbered AS (
  SELECT row_number() OVER () AS rid, * FROM documents
), draws AS (
  SELECT d.rid, u.i, (CAST('0x' || substr(md5('count:{MIX_SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || u.i), 1, {mixing.DIGITS}) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE AS u, t.cdfs
  FROM numbered d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source JOIN tables t ON t.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.parts + 1)) AS u(i)
), counts AS (
  SELECT rid, CAST(sum(len(list_filter(cdfs, lambda c: c < u))) AS BIGINT) AS n FROM draws GROUP BY rid
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(c.copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5('order:{MIX_SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || c.copy), 1, {mixing.DIGITS}) AS BIGINT) AS shuffle_key
FROM numbered d JOIN counts n USING (rid), unnest(range(0, n.n)) AS c(copy)
"""

_SPACE = r"[\x20\x09-\x0D]+"

OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), wins AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win FROM w, unnest(range(1, len(words) - 6)) AS u(i) WHERE len(words) >= 8
), twice AS (
  SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), reps AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS u(k) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_marks,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN reps r USING (rid)
), b AS (
  SELECT *, CAST({" + ".join(f"CASE WHEN {test} THEN {1 << i} ELSE 0 END" for i, (_, test) in enumerate(quality.RULES))} AS BIGINT) AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (fail_bits & {quality.STRICT.mask}) = 0 AS kept, fail_bits FROM b
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array({_LOWER}, '{decontam.SEPARATORS}'), lambda x: x <> '') AS words FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array({_LOWER}, '{decontam.SEPARATORS}'), lambda x: x <> '') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(words[i:i + 7], ' ') AS win, least(len(words), 8) AS n FROM b, unnest(range(1, greatest(len(words) - 7, 1) + 1)) AS u(i) WHERE len(words) > 0
), sizes AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT rid, i, s.n, array_to_string(words[i:i + s.n - 1], ' ') AS win FROM d, sizes s, unnest(range(1, len(words) - s.n + 2)) AS u(i) WHERE len(words) >= s.n
), hit AS (
  SELECT DISTINCT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, hit.n)) AS u(k) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)

OP5_SQL = rf"""
WITH rules(r_verdict, r_host, r_path) AS (VALUES {_RULES}),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), best AS (
  SELECT rid, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op5_url_filter": OP5_SQL, "op7_quality_ledger": OP7_SQL, "op10_decontaminate": OP10_SQL}
