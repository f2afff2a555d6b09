"""Listing, reading, line search, paths and digests over tables read as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import listing
from ..sources.tables import document_files, key_files, table
from .registry import query

FILES = "(SELECT 'docs/' || coalesce(source, 'none') || '/' || doc_id || '.md' AS path, coalesce(text, '') AS text FROM documents)"
LINES = rf"(SELECT path, unnest(parts) AS text, generate_subscripts(parts, 1) AS line FROM (SELECT path, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts FROM (SELECT path, regexp_split_to_array(text, '\r\n|\n|\r') AS p FROM {FILES})))"
KEYS = "(SELECT 'customer/' || c_custkey || '.json' AS path FROM customer UNION ALL SELECT 'nation/' || n_nationkey || '.json' FROM nation UNION ALL SELECT 'region/' || r_regionkey || '.json' FROM region UNION ALL SELECT 'supplier/' || s_suppkey || '.json' FROM supplier UNION ALL SELECT 'orders/' || o_orderkey || '.json' FROM orders)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(table(spark, sf_dir, "documents"))


@query(f"SELECT path FROM {FILES} WHERE path > 'docs/src10/' ORDER BY path LIMIT 100")
def ls_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_page(files(spark, sf_dir), cursor="docs/src10/").select("path")


@query(f"SELECT count(*) AS remaining FROM {FILES} WHERE path > 'docs/src2/5'")
def ls_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.remaining(files(spark, sf_dir), "docs/src2/5")


@query(f"SELECT path, octet_length(encode(text)) AS size FROM {FILES} WHERE regexp_matches(path, '^docs/src[^/]*1/[^/]*\\.md$')")
def ls_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.select_files(files(spark, sf_dir), glob="docs/src*1/*.md").select("path", F.col("size").cast("long").alias("size"))


@query(f"SELECT path FROM {KEYS} WHERE regexp_matches(path, '^(?:[^/]+/)*[^/]*1\\.json$') AND NOT starts_with(path, 'orders/') AND NOT regexp_matches(path, '^customer/1[^/]*$')")
def set_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.select_files(key_files(spark, sf_dir), glob="**/*1.json", exclude=["orders/**", "customer/1*"])


PAGE_PATHS = "(SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)\\.') THEN 'ignored' WHEN regexp_matches(path, '[^/]\\.(md|yaml|yml|json)$') THEN 'record' ELSE 'asset' END AS kind FROM {PAGE_PATHS}")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files(spark, sf_dir).select("page_id", paths.file_kind(F.col("path")).alias("kind"))


@query(rf"SELECT page_id, regexp_matches(path, '[^\p{{L}}\p{{M}}\p{{N}}._ +@()\[\],=~!/-]') AS bad_character, octet_length(encode(path)) > 1024 AS too_long, path <> '' AND NOT regexp_matches(path, '(^|/)\.{{0,2}}(/|$)') AND NOT contains(path, chr(92)) AS well_formed FROM {PAGE_PATHS}")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    bad = paths.path_problems(p)
    return page_files(spark, sf_dir).select("page_id", F.array_contains(bad, "character").alias("bad_character"), F.array_contains(bad, "path-too-long").alias("too_long"), paths.well_formed(p).alias("well_formed"))


CASED = "(SELECT CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END || '/' || lang || '/' || doc_id AS path FROM documents)"


@query(f"""WITH p AS (SELECT path, array_to_string(string_split(path, '/')[1:n], '/') AS prefix FROM {CASED}, range(1, 4) AS r(n)),
s AS (SELECT lower(prefix) AS folded, prefix, min(path) AS p FROM p GROUP BY 1, 2),
f AS (SELECT folded, arg_min(prefix, p) AS first FROM s GROUP BY folded HAVING count(*) > 1)
SELECT path, prefix, first FROM p JOIN f ON lower(prefix) = folded WHERE prefix <> first""")
def case_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    source = F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise(F.col("source"))
    return listing.case_conflicts(docs.select(F.concat_ws("/", source, "lang", F.col("doc_id").cast("string")).alias("path")))


@query(f"SELECT path FROM {KEYS} WHERE NOT regexp_matches(string_split(path, '/')[-1], '^[0-9]{{1,3}}\\.json$')")
def filename_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_files(spark, sf_dir).where(~paths.last_segment(F.col("path")).rlike(r"^[0-9]{1,3}\.json$"))


@query(f"SELECT path, CASE WHEN starts_with(path, 'orders/') AND path LIKE '%7.json' THEN 2 WHEN starts_with(path, 'orders/') OR path LIKE '%7.json' THEN 1 ELSE 0 END AS n_collections FROM {KEYS}")
def collection_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = paths.collections_of(F.col("path"), {"orders": {"match": ["orders/*"]}, "sevens": {"match": ["*/*7.json"]}})
    return key_files(spark, sf_dir).select("path", F.size(claimed).alias("n_collections"))


@query(f"SELECT path, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS version FROM {FILES}")
def file_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.versions(files(spark, sf_dir))


@query(f"SELECT path, line, text FROM {LINES} WHERE contains(text, 'thr')")
def grep_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.grep(files(spark, sf_dir), listing.literal("thr")).select("path", F.col("line").cast("long").alias("line"), "text")


@query(f"SELECT path, line, text FROM {LINES} WHERE regexp_matches(text, '\\+1 \\([0-9]{{3}}\\) [0-9-]+')")
def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.portable import translate

    return listing.grep(files(spark, sf_dir), F.col("text").rlike(translate(r"\+1 \([0-9]{3}\) [0-9-]+"))).select("path", F.col("line").cast("long").alias("line"), "text")


@query(f"SELECT path, line, text FROM {LINES} WHERE contains(text, 'idiot') AND (path > 'docs/src11/' OR (path = 'docs/src11/' AND line > 3)) ORDER BY path, line LIMIT 50")
def grep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.grep(files(spark, sf_dir), listing.literal("idiot"), listing.GREP_LIMIT, ("docs/src11/", 3)).select("path", F.col("line").cast("long").alias("line"), "text")


@query(f"""SELECT path, line, text, before, after FROM (SELECT path, line, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM {LINES} WINDOW w AS (PARTITION BY path ORDER BY line)) WHERE contains(text, 'idiot')""")
def grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.grep_context(files(spark, sf_dir), listing.literal("idiot"), 1)
    return found.select("path", F.col("line").cast("long").alias("line"), "text", F.get("before", F.lit(0)).alias("before"), F.get("after", F.lit(0)).alias("after"))


@query(f"SELECT path, max(line) AS n_lines FROM {LINES} GROUP BY path")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.numbered_lines(files(spark, sf_dir)).where("n_lines > 0")


@query(f"SELECT path, line, text FROM {LINES} WHERE line BETWEEN 2 AND 3")
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.read_lines(files(spark, sf_dir), 2, 4).select("path", F.col("line").cast("long").alias("line"), "text")


@query(f"SELECT path, octet_length(encode(text)) AS size FROM {FILES} WHERE octet_length(encode(text)) <= 2000")
def read_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.readable(files(spark, sf_dir), 2000).select("path", F.col("size").cast("long").alias("size"))


@query(f"SELECT path, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens FROM {FILES}")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", text.token_estimate(F.col("content")).alias("tokens"))


@query(f"""WITH a AS (SELECT path, md5(text) AS v FROM {FILES} WHERE hash(path) IS NOT NULL AND length(path) % 2 = 0),
b AS (SELECT path, CASE WHEN path LIKE '%5.md' THEN 'x' ELSE md5(text) END AS v FROM {FILES} WHERE length(path) % 3 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.path = b.path WHERE a.v IS DISTINCT FROM b.v""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two states of a store."""
    rows = files(spark, sf_dir).select("path", F.md5("content").alias("version"))
    before = rows.where(F.length("path") % 2 == 0)
    after = rows.where(F.length("path") % 3 != 0).withColumn("version", F.when(F.col("path").endswith("5.md"), "x").otherwise(F.col("version")))
    return listing.changes(before, after)


@query("SELECT source AS v FROM documents EXCEPT ALL SELECT source FROM documents JOIN labels USING (doc_id)")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("v"))
    return docs.select("v").exceptAll(docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("v"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9_ -]', '', 'g'), ' ', '-', 'g') AS slug FROM (SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^ -~]', '', 'g') AS t FROM pages)")
def slug_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^ -~]", "")
    return table(spark, sf_dir, "pages").select("page_id", text.slug_ascii(title).alias("slug"))
