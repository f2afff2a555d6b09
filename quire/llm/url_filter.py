"""URL filters (5): host-suffix and path-prefix expressions, met by short hash prefixes, confirmed by full digests.

Each URL is expanded into its host suffixes and path prefixes, of only those label counts and path lengths that some
rule has (small sets, whatever the number of rules). Expressions meet the rules in an equi-join on the first eight
hex digits of a SHA-256, as a list is published; the full digest then confirms, and the longest rule wins. Only
matched expressions are gathered by URL.

Defined results: a null url or one without :// has an empty host and path; such pages, and those that no rule fits,
get the default verdict; an empty rule table gives the default to all; repeated pages are judged alike, each its own
row; of rules of equal length the one with the longer host wins, then block before allow. Only page_id and url are
read, so further columns may have any name; a very long url is cut only where rules end, and stands whole in the result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PREFIX = 8
#: Rules up to which they are broadcast (about 150 bytes each); beyond, the join shuffles expressions and rules.
BROADCAST_RULES = 200_000


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """verdict, host, path and the hash columns of literal rules."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(after) + 4, F.length(url))
    there = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.when(there, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise(F.lit(""))
    path = F.when(there, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))
    return host, path


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decides, else null) and verdict of every page."""
    host, path = parts(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    text = F.concat("host", "path")
    ranked = rules.select("verdict", F.col("host").alias("r_host"), text.alias("rule"), F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("length"))
    rules = ranked.select("verdict", "r_host", "rule", "labels", "length", F.sha2("rule", 256).alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX))
    # Sets of small whole numbers: at most as many as the longest host has labels, and the longest path characters.
    shapes = rules.select("labels", "length").distinct().collect()
    if not shapes:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.", -1)
    # One literal array and one lambda, however many shapes there are.
    wanted = F.from_json(F.lit(json.dumps(sorted([r["labels"], r["length"]] for r in shapes))), "array<array<int>>")
    fitting = F.filter(wanted, lambda w: (F.size(labels) >= w[0]) & (F.length("path") >= w[1]))
    made = F.transform(fitting, lambda w: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -w[0]), F.substring("path", F.lit(1), w[1])))
    urls = pages.where("host <> ''").select("host", "path").distinct()
    expressions = urls.select("host", "path", F.explode(made).alias("expression")).withColumn("full", F.sha2("expression", 256))
    expressions = expressions.withColumn("short", F.substring("full", 1, PREFIX))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    # The slash between host and path can't be moved: a rule's own host must end the URL's host.
    confirmed = (F.col("full") == F.col("digest")) & ((F.col("host") == F.col("r_host")) | F.endswith("host", F.concat(F.lit("."), "r_host")))
    met = expressions.join(F.broadcast(rules) if small else rules, "short").where(confirmed)
    strength = F.struct(F.length("rule").alias("a"), F.length("r_host").alias("b"), (F.col("verdict") == "block").alias("c"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), strength).alias("best"))
    return pages.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
