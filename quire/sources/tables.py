"""Tables read as stores: rows as records, foreign keys as references, turns as sections.

Paths are made from keys, so that every operator over files, nodes and references runs on tables unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_path(folder: str, key: Column, extension: str = "json") -> Column:
    return F.concat(F.lit(f"{folder}/"), key.cast("string"), F.lit(f".{extension}"))


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt out by some columns to four tasks a core, for work in Python on each of them.

    A scan has a task for so many bytes, and at most one for a row group, so that a table of many small rows would be read, and
    all its records written and parsed, in a task or two whatever the cores. Only the columns that are used later are moved.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def document_files(docs: DataFrame) -> DataFrame:
    """documents as text files: path docs/<source>/<doc_id>.md, text, content and size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    path = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(path.alias("path"), text.alias("text"), F.encode(text, "UTF-8").alias("content"), F.octet_length(text).alias("size"))


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """conversations as records: path conversations/<conv_id>.json, a section a turn (title is the role, body the text).

    Columns: path, at, parent, step (the section key), kind, depth, title, body, doc_order.
    """
    path = record_path("conversations", F.col("conv_id"))
    sections = turns.select(
        path.alias("path"), F.concat(F.lit("/$sections/"), F.col("turn").cast("string")).alias("at"), F.lit("").alias("parent"),
        F.col("role").alias("step"), F.lit("section").alias("kind"), F.lit(1).alias("depth"), F.col("role").alias("title"), F.col("text").alias("body"), (F.col("turn") + 1).alias("doc_order"),
    )
    roots = turns.select("conv_id").distinct().select(
        path.alias("path"), F.lit("").alias("at"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("step"), F.lit("section").alias("kind"),
        F.lit(0).alias("depth"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("body"), F.lit(0).cast("long").alias("doc_order"),
    )
    return roots.unionByName(sections)


def order_nodes(orders: DataFrame, items: DataFrame) -> DataFrame:
    """orders as records orders/<key>.json: scalar members, and lineitem as a keyed list under /lineitems.

    Columns: path, at, parent, step, kind, value, doc_order. A list item's step is its l_linenumber.
    """
    path = record_path("orders", F.col("o_orderkey"))
    names = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    members = F.array(*(F.struct(F.lit(n).alias("step"), F.col(n).cast("string").alias("value"), F.lit(i).alias("i")) for i, n in enumerate(names)))
    scalars = orders.select(path.alias("path"), F.explode(members).alias("m")).select(
        "path", F.concat(F.lit("/"), "m.step").alias("at"), F.lit("").alias("parent"), "m.step", F.lit("scalar").alias("kind"), "m.value", (F.col("m.i") + 1).cast("long").alias("doc_order"))
    lists = orders.select(path.alias("path"), F.lit("/lineitems").alias("at"), F.lit("").alias("parent"), F.lit("lineitems").alias("step"), F.lit("list").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(5).cast("long").alias("doc_order"))
    number = F.col("l_linenumber").cast("string")
    at = F.concat(F.lit("/lineitems/"), number)
    rows = items.select(record_path("orders", F.col("l_orderkey")).alias("path"), at.alias("at"), number.alias("n"), F.col("l_quantity").cast("string").alias("q"), F.col("l_returnflag").alias("f"), F.col("l_linenumber").cast("long").alias("o"))
    kind = "array<struct<at:string,parent:string,step:string,kind:string,value:string,doc_order:bigint>>"
    none = F.lit(None).cast("string")
    held = F.array(
        F.struct(F.col("at"), F.lit("/lineitems").alias("b"), F.col("n").alias("c"), F.lit("object").alias("d"), none.alias("e"), (10 * F.col("o")).alias("f")),
        F.struct(F.concat("at", F.lit("/l_quantity")).alias("at"), F.col("at").alias("b"), F.lit("l_quantity").alias("c"), F.lit("scalar").alias("d"), F.col("q").alias("e"), (10 * F.col("o") + 1).alias("f")),
        F.struct(F.concat("at", F.lit("/l_returnflag")).alias("at"), F.col("at").alias("b"), F.lit("l_returnflag").alias("c"), F.lit("scalar").alias("d"), F.col("f").alias("e"), (10 * F.col("o") + 2).alias("f")),
    ).cast(kind)
    return scalars.unionByName(lists).unionByName(rows.select("path", F.explode(held).alias("h")).select("path", "h.*"))


def key_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as typed references: ref_id, path, at, raw, target, fragment_kind, steps."""
    none = F.array().cast("array<string>")

    def refs(name: str, folder: str, key: str, foreign: str, other: str) -> DataFrame:
        path, target = record_path(folder, F.col(key)), record_path(other, F.col(foreign))
        return table(spark, sf_dir, name).select(
            F.concat(path, F.lit(f"#{foreign}")).alias("ref_id"), path.alias("path"), F.lit(f"/{foreign}").alias("at"), F.concat(F.lit("../"), target).alias("raw"),
            target.alias("target"), F.lit("root").alias("fragment_kind"), none.alias("steps"),
        )

    parts = [
        refs("orders", "orders", "o_orderkey", "o_custkey", "customer"),
        refs("customer", "customer", "c_custkey", "c_nationkey", "nation"),
        refs("supplier", "supplier", "s_suppkey", "s_nationkey", "nation"),
        refs("nation", "nation", "n_nationkey", "n_regionkey", "region"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_files(spark: SparkSession, sf_dir: str, names: tuple[tuple[str, str], ...] = (("customer", "c_custkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"))) -> DataFrame:
    """Paths of the rows of the keyed tables."""
    parts = [table(spark, sf_dir, n).select(record_path(n, F.col(k)).alias("path")) for n, k in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """Links of HTML pages: page_id, url, position and href, read with one regular expression in the JVM."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(hrefs).alias("position", "href"))
