"""Computed fields of nodes, canonical addresses of parsed records, positions, and formatting for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import resolve

FIELDS = ("@path", "@at", "@address", "@key", "@anchors", "@version", "@source", "@range", "@issues", "@refs", "@collection", "@depth", "@nodes")


def routes(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """nodes (of readable records) with steps, anchor_steps and repeated, as canonical() needs them.

    Keys along a path are collected by exploding each node's ancestors, one equi-join and one aggregation.
    """
    shared = F.count("*").over(Window.partitionBy("path", "parent", "step")) > 1
    base = nodes.select("path", "at", "parent", "step", (F.col("step").isNotNull() & shared).alias("own_repeat"))
    explicit = anchors.where("kind = 'explicit'").groupBy("path", "at").agg(F.min("name").alias("anchor"))
    held = base.select("path", F.col("at").alias("up"), "step", "own_repeat").join(explicit.select("path", F.col("at").alias("up"), "anchor"), ["path", "up"], "left")
    # A section's semantic parent isn't its exact parent: the $sections arrays between them are no steps.
    up = base.select("path", "at", F.explode(resolve.ancestors(F.col("at"))).alias("up")).join(held, ["path", "up"])
    skipped = (F.col("up") != F.col("at")) & F.col("up").endswith("/$sections")
    kept = up.where((F.col("up") != "") & ~skipped)
    link = F.struct(F.length("up").alias("n"), F.col("step").alias("step"), F.col("own_repeat").alias("repeat"), F.col("anchor").alias("anchor"))
    chains = kept.groupBy("path", "at").agg(F.array_sort(F.collect_list(link)).alias("chain"))
    joined = base.join(chains, ["path", "at"], "left").withColumn("chain", F.coalesce("chain", F.array().cast(chains.schema["chain"].dataType)))
    steps = F.transform("chain", lambda c: F.coalesce(c["step"], F.lit("")))
    # The nearest anchored ancestor (not the node itself, never the root).
    above = F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0)))
    last = F.aggregate(F.transform(above, lambda c, i: F.when(c["anchor"].isNotNull(), i + 1).otherwise(F.lit(0))), F.lit(0), lambda a, x: F.greatest(a, x))
    joined = joined.withColumn("last", last)
    tail = F.slice("chain", F.col("last") + 1, F.size("chain"))
    anchor_steps = F.when(F.col("last") > 0, F.concat(F.array(F.get("chain", F.col("last") - 1)["anchor"]), F.transform(tail, lambda c: F.coalesce(c["step"], F.lit("")))))
    return joined.select("path", "at", "parent", "step", steps.alias("steps"), anchor_steps.alias("anchor_steps"), F.exists(tail, lambda c: c["repeat"]).alias("repeated"))


def addresses(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(path, at, address): the canonical address of every node."""
    return resolve.canonical(routes(nodes, anchors), anchors)


def computed(store, fields: list[str]) -> DataFrame:  # noqa: ANN001
    """path, at and the named computed fields of every node; only what a field needs is joined."""
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown computed fields: {', '.join(sorted(unknown))}")
    nodes = store.nodes
    out = nodes.select("path", "at", "kind", "step", "depth", "version", "start", "end")
    if "@address" in fields:
        out = out.join(addresses(nodes, store.anchors).withColumnRenamed("address", "@address"), ["path", "at"], "left")
    if "@anchors" in fields:
        ways = store.anchors.groupBy("path", "at").agg(F.sort_array(F.collect_set(F.struct("name", "kind"))).alias("@anchors"))
        out = out.join(ways, ["path", "at"], "left")
    if "@range" in fields:
        blocks = store.anchors.where("kind = 'block'").groupBy("path", "at").agg(F.sort_array(F.collect_list(F.struct("start", "end", "name"))).alias("@range"))
        out = out.join(blocks, ["path", "at"], "left")
    if "@issues" in fields:
        found = store.check().groupBy("path", "at").agg(F.collect_list(F.struct("code", "severity", "message")).alias("@issues"))
        out = out.join(found, ["path", "at"], "left")
    if "@refs" in fields:
        refs = store.resolved_refs().select("path", F.explode(resolve.ancestors(F.col("at"))).alias("at"), F.struct("raw", "status", "record", "target_at").alias("ref"))
        out = out.join(refs.groupBy("path", "at").agg(F.collect_set("ref").alias("@refs")), ["path", "at"], "left")
    if "@collection" in fields:
        own = store.files.select("path", F.when(F.size("collections") == 1, F.element_at("collections", 1)).alias("@collection"))
        out = out.join(own, "path", "left")
    if "@nodes" in fields:
        below = nodes.where("kind = 'section'").select("path", F.explode(resolve.ancestors(F.col("at"))).alias("up"), "at", "key").where(F.col("up") != F.col("at"))
        held = below.groupBy("path", F.col("up").alias("at")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("at", "key")))).alias("@nodes"))
        out = out.join(held, ["path", "at"], "left")
    made = {
        "@path": F.col("path"), "@at": F.col("at"), "@key": F.col("step"), "@version": F.col("version"), "@source": F.when(F.col("start").isNotNull(), F.struct("start", "end")),
        "@depth": F.when(F.col("kind") == "section", F.col("depth")),
    }
    return out.select(F.col("path"), F.col("at"), *(made[f].alias(f) if f in made else F.col(f"`{f}`") for f in fields if f not in ("@path", "@at")))


def position(content: Column, offset: Column) -> Column:
    """struct(line, column) of a byte offset: lines from 1, columns in code points from 1, a byte order mark is none."""
    before = F.decode(F.substring(content, F.lit(1), offset), "UTF-8")
    lf = F.regexp_replace(F.regexp_replace(before, "^﻿", ""), "\r\n?", "\n")
    return F.struct((F.size(F.split(lf, "\n", -1))).alias("line"), (F.length(F.substring_index(lf, "\n", -1)) + 1).alias("column"))


def format_count(n: int, name: str) -> str:
    return f"{n:,} {name}{'' if n == 1 else 's'}"


def format_tokens(n: int) -> str:
    """~120 tok, ~1.2k tok or ~3.4M tok."""
    for unit, size in (("M", 1_000_000), ("k", 1_000)):
        if n >= size:
            return f"~{n / size:.1f}{unit} tok"
    return f"~{n} tok"


def one_line(text: str, width: int = 100) -> str:
    """A text on one line, cut to a width, with control characters as spaces."""
    flat = " ".join("".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in text).split())
    return flat if len(flat) <= width else flat[: width - 1] + "…"
