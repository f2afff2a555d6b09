"""References: status, aliases, backlinks and counts, as joins over refs, files, nodes and aliases.

refs has (ref_id, path, at, raw, target, fragment_kind, steps, many): target is the store path it names (null when
outside the store). All joins are equi-joins; containment is an exploded set of ancestors, never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpointing import checkpointed
from ..functions import paths
from . import resolve


def alias_chains(aliases: DataFrame, live: DataFrame) -> DataFrame:
    """(source, target) for every alias source whose chain reaches a live path; cycles and dead ends have no row.

    Pointer doubling over the alias table: every round composes the map with itself, each checkpointed to keep the plan small.
    There are log2 of the longest chain's rounds, or log2 n among n aliases if some lead in a circle. The last line of a source
    wins, and a live path's own alias is ignored.
    """
    last = aliases.groupBy("source").agg(F.max_by("target", "line").alias("target"))
    alive = live.select(F.col("path").alias("target")).distinct().withColumn("alive", F.lit(True))
    open_ = last.join(live.select(F.col("path").alias("source")), "source", "left_anti")
    done = F.coalesce("alive", F.lit(False))
    # A chain is over where it reaches a live path (done), or one that has no alias.
    now = checkpointed(open_.join(alive, "target", "left").select("source", "target", done.alias("done"), done.alias("over")))
    for _ in range(now.count().bit_length()):
        if now.where("not over").isEmpty():
            break
        step = now.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("done").alias("next_done"), F.col("over").alias("next_over"))
        onward = ~F.col("over") & F.col("next").isNotNull()
        moved = lambda there, here: F.when(onward, F.col(there)).otherwise(here)
        now = checkpointed(now.join(step, "target", "left").select("source", moved("next", F.col("target")).alias("target"), moved("next_done", F.col("done")).alias("done"), moved("next_over", F.lit(True)).alias("over")))
    return now.where("done").select("source", "target")


def anchor_renames(aliases: DataFrame, chains: DataFrame) -> DataFrame:
    """(path, source, target, line) of anchor aliases (record, source, target, line): those under a record's old paths, whose
    chains (source, target) lead to it, are its own. The last line of an old name wins."""
    led = chains.select(F.col("source").alias("record"), F.col("target").alias("now"))
    own = aliases.join(led, "record", "left").withColumn("path", F.coalesce("now", "record"))
    return own.groupBy("path", "source").agg(F.max_by("target", "line").alias("target"), F.max("line").alias("line"))


def _name_in(record: Column, name: Column) -> Column:
    """A name of a record as one string; no path has a null character."""
    return F.concat(record, F.lit("\0"), name)


def renamed_steps(refs: DataFrame, renames: DataFrame, names: DataFrame) -> DataFrame:
    """refs (of record_status()) whose first step reaches nothing, with the live name in its place that the record's anchor
    aliases lead to, and then as aliased. Remaining steps are kept; an alias that leads nowhere leaves a reference as it is.

    names has (path, name): what first steps reach. Chains are doubled over (record, name), as those of records are over paths.
    """
    key = _name_in(F.col("path"), F.col("name"))
    held = names.join(renames.select("path").distinct(), "path", "left_semi").select(key.alias("path")).distinct()
    moves = renames.select(_name_in(F.col("path"), F.col("source")).alias("source"), _name_in(F.col("path"), F.col("target")).alias("target"), "line")
    chains = alias_chains(moves, held).select(F.col("source").alias("old"), F.substring_index("target", "\0", -1).alias("live_name"))
    asked = F.when(F.col("status").isin("ok", "aliased") & (F.col("fragment_kind") == "semantic"), _name_in(F.col("record"), F.element_at("steps", 1)))
    joined = refs.withColumn("old", asked).join(chains, "old", "left")
    moved = F.col("live_name").isNotNull()
    steps = F.when(moved, F.concat(F.array("live_name"), F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))))).otherwise(F.col("steps"))
    return joined.withColumns({"steps": steps, "status": F.when(moved, "aliased").otherwise(F.col("status"))}).drop("old", "live_name")


def directories(files: DataFrame) -> DataFrame:
    """Every folder that holds a file, at any depth."""
    return files.select(F.explode(F.slice(paths.prefixes(F.col("path")), 1, F.size(F.split("path", "/")) - 1)).alias("path")).distinct()


def record_status(refs: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """refs with `status` of the record part: outside, ok, aliased or dangling, and `record` (where it led).

    files has (path); refs with an existing target never meet the alias table.
    """
    known = files.select(F.col("path").alias("target")).distinct().withColumn("there", F.lit(True))
    joined = refs.join(known, "target", "left")
    if aliases is not None:
        chains = alias_chains(aliases, files).select(F.col("source").alias("target"), F.col("target").alias("moved"))
        joined = joined.join(chains, "target", "left")
    else:
        joined = joined.withColumn("moved", F.lit(None).cast("string"))
    status = F.when(F.col("target").isNull(), "outside").when(F.col("there"), "ok").when(F.col("moved").isNotNull(), "aliased").otherwise("dangling")
    return joined.withColumn("status", status).withColumn("record", F.when(F.col("there"), F.col("target")).otherwise(F.col("moved"))).drop("there", "moved")


def node_status(refs: DataFrame, nodes: DataFrame, anchors: DataFrame, longest: int) -> DataFrame:
    """(ref_id, status, at) of refs whose record part is settled: ok, aliased, ambiguous, dangling or unreadable.

    A reference to a record that has no nodes (it couldn't be read) is unreadable unless it names the root.
    """
    live = refs.where("status in ('ok', 'aliased')")
    addresses = live.select(F.col("ref_id").alias("address_id"), F.col("record").alias("path"), F.col("fragment_kind").alias("kind"), "steps")
    found = resolve.resolve(addresses, nodes, anchors, longest)
    read = nodes.where("at = ''").select(F.col("path").alias("record"), F.lit(True).alias("readable"))
    joined = live.join(read, "record", "left").join(found.select(F.col("address_id").alias("ref_id"), F.col("at").alias("found_at"), F.col("status").alias("found")), "ref_id", "left")
    status = (
        F.when((F.col("fragment_kind") == "root"), F.col("status"))
        .when(F.col("readable").isNull(), "unreadable")
        .when(F.col("found") == "ambiguous", "ambiguous")
        .when(F.col("found") == "not-found", "dangling")
        .otherwise(F.col("status"))
    )
    settled = joined.select("ref_id", status.alias("status"), F.when(status.isin("ok", "aliased"), F.coalesce("found_at", F.lit(""))).alias("at"))
    rest = refs.where("status not in ('ok', 'aliased')").select("ref_id", "status", F.lit(None).cast("string").alias("at"))
    return settled.unionByName(rest).dropDuplicates(["ref_id", "at"])


def backlinks(resolved: DataFrame, path: str, at: str = "") -> DataFrame:
    """References whose target is the node or below it: an equality on the path and a prefix on the exact path."""
    return resolved.where((F.col("record") == path) & resolve.below(F.col("target_at"), F.lit(at)))


def outgoing(resolved: DataFrame, path: str, at: str = "") -> DataFrame:
    """References made in the node's subtree."""
    return resolved.where((F.col("path") == path) & resolve.below(F.col("at"), F.lit(at)))


def counts_into(resolved: DataFrame) -> DataFrame:
    """(record, at, n_refs): distinct references into each node or below it.

    Rows are dealt by record and reference before their ancestors are exploded, so that what is distinct is told in place and
    a reference is moved once, not once an ancestor. A variable-depth path has no rollup.
    """
    dealt = resolved.where("status in ('ok', 'aliased')").select("record", "target_at", "ref_id").repartition("record", "ref_id")
    up = dealt.select("record", F.explode(resolve.ancestors(F.col("target_at"))).alias("at"), "ref_id").distinct()
    return up.groupBy("record", "at").agg(F.count("ref_id").alias("n_refs"))


def shadowed(aliases: DataFrame, files: DataFrame) -> DataFrame:
    """Aliases whose source is a live path again."""
    return aliases.join(files.select(F.col("path").alias("source")), "source", "left_semi")


def shadowed_names(renames: DataFrame, names: DataFrame) -> DataFrame:
    """(path, at, name) of every node that a first step reaches by the old name of one of its record's anchor aliases."""
    return names.join(renames.select("path", F.col("source").alias("name")), ["path", "name"]).select("path", "at", "name").distinct()


def changed_scope(changed: DataFrame, refs: DataFrame) -> DataFrame:
    """Paths to check after a change: the changed ones, and records that cite one or a folder above one."""
    named = changed.select(F.explode(paths.prefixes(F.col("path"))).alias("target")).distinct()
    return changed.select("path").union(refs.join(named, "target", "left_semi").select("path")).distinct()
