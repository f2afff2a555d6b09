"""Checks: uniqueness, keyed lists, schema predicates, severities and reports over issue tables.

An issue is (code, severity, path, at, message). Every source of issues is a DataFrame; a whole check is their union,
so Spark plans all of them together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code -> default severity, for the codes raised here. Fixed values.
SEVERITY = {
    "duplicate-key": "error", "duplicate-anchor": "error", "duplicate-tag": "warning", "anchor-invalid": "error",
    "schema-violation": "error", "keyed-list-key": "error", "keyed-list-required": "error", "path-invalid": "error",
    "path-case-conflict": "warning", "collection-conflict": "error", "filename-mismatch": "error",
    "ref-dangling": "error", "ref-ambiguous": "error", "ref-aliased": "warning", "ref-target-unreadable": "warning",
    "ref-target-not-allowed": "error", "ref-derived-anchor": "warning", "ref-derived-repeat": "warning",
    "alias-shadowed": "warning", "schema-invalid": "error", "syntax-error": "error", "multiple-h1": "warning",
}
#: Codes that a lenient store only warns about. Fixed values.
LENIENT = ("duplicate-key", "duplicate-anchor")
#: Validation codes that a strict reader refuses, besides structural errors. Fixed values.
REFUSED = ("schema-violation", "duplicate-key", "filename-mismatch")


def issues_of(rows: DataFrame, code: str, at: Column | None = None, message: Column | None = None) -> DataFrame:
    """rows with a `path` as issues of one code."""
    none = F.lit("")
    return rows.select(F.lit(code).alias("code"), F.col("path"), (none if at is None else at).alias("at"), (none if message is None else message).alias("message"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Every row of equal `by` after the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_n > 1").drop("_n")


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """Members and child sections that share a key with an earlier one of the same parent."""
    return issues_of(repeated(nodes.where("step is not null and step <> ''"), ["path", "parent", "step"], "doc_order"), "duplicate-key", F.col("at"), F.col("step"))


def duplicate_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors whose name an earlier, different node of the record has; each node once."""
    once = anchors.groupBy("path", "name", "at").agg(F.min("doc_order").alias("doc_order"))
    return issues_of(repeated(once, ["path", "name"], "doc_order"), "duplicate-anchor", F.col("at"), F.col("name"))


def duplicate_tags(tags: DataFrame) -> DataFrame:
    return issues_of(repeated(tags, ["path", "at", "tag"], "position"), "duplicate-tag", F.col("at"), F.col("tag"))


def keyed_list_issues(items: DataFrame, required: list[str], unique: bool, additional: list[str] | None = None) -> DataFrame:
    """Issues of one declared keyed list: items (path, list_at, at, key, doc_order), one row an item; key null if missing."""
    parts = [issues_of(items.where("key is null"), "keyed-list-key", F.col("at"))]
    if unique:
        parts.append(issues_of(repeated(items.where("key is not null"), ["path", "list_at", "key"], "doc_order"), "duplicate-key", F.col("at"), F.col("key")))
    if required:
        held = items.groupBy("path", "list_at").agg(F.collect_set("key").alias("keys"))
        lacking = held.select("path", "list_at", F.explode(F.array_except(F.array(*map(F.lit, required)), "keys")).alias("key"))
        parts.append(issues_of(lacking, "keyed-list-required", F.col("list_at"), F.col("key")))
    if additional is not None:
        parts.append(issues_of(items.where(F.col("key").isNotNull() & ~F.col("key").isin(additional)), "schema-violation", F.col("at"), F.col("key")))
    return union_all(parts)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One schema-violation for each (row, rule) whose test is false; a null test passes. One pass over the rows."""
    failed = F.array_compact(F.array(*(F.when(~test, F.lit(name)) for name, test in rules.items())))
    return issues_of(rows.select("path", F.explode(failed).alias("rule")), "schema-violation", F.concat(F.lit("/"), F.col("rule")))


def severities(issues: DataFrame, uniqueness: str = "strict", overrides: dict[str, str] | None = None) -> DataFrame:
    """issues with severity: an override, else warning for duplicates in a lenient store, else the default. `off` drops."""
    chosen = dict(SEVERITY)
    if uniqueness == "lenient":
        chosen |= {c: "warning" for c in LENIENT}
    chosen |= overrides or {}
    pairs = [x for c, s in sorted(chosen.items()) for x in (F.lit(c), F.lit(s))]
    severity = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("code")), F.lit("error"))
    return issues.withColumn("severity", severity).where("severity <> 'off'")


def ordered(issues: DataFrame) -> DataFrame:
    """By path (none first), then exact path, then code."""
    return issues.orderBy(F.col("path").asc_nulls_first(), "at", "code")


def counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n"))


def strict(records: DataFrame, issues: DataFrame) -> DataFrame:
    """Records that a strict reader returns: none of the refused codes, nothing structural."""
    return records.join(issues.where(F.col("code").isin(*REFUSED, "syntax-error")).select("path").distinct(), "path", "left_anti")


def summary(records: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: n_records, n_unreadable, n_issues, n_errors."""
    r = records.agg(F.count("*").alias("n_records"), F.count_if(~F.col("readable")).alias("n_unreadable"))
    i = issues.agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "error").alias("n_errors"))
    return r.withColumn("_k", F.lit(1)).join(i.withColumn("_k", F.lit(1)), "_k").drop("_k")


def collection_summary(records: DataFrame) -> DataFrame:
    """Records per collection, with those claimed by none or by several under their own names."""
    name = F.when(F.size("collections") == 0, "(none)").when(F.size("collections") > 1, "(conflict)").otherwise(F.element_at("collections", 1))
    return records.groupBy(name.alias("collection")).agg(F.count("*").alias("n_records"), F.count_if(~F.col("readable")).alias("n_unreadable"))
