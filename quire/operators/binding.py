"""Binding records to their schema: keys of keyed lists, typed references, allowed targets and fragile anchors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..parse.arrow import pieces
from ..schema.spine import Spine, item_keys, typed_refs
from . import resolve
from .checks import issues_of


def bound_nodes(records: DataFrame, schemas: dict[str, object]) -> DataFrame:
    """(path, nodes) of records (path, owner, value, nodes): steps into declared keyed lists are the items' keys.

    An index never names an item of such a list, and items without a key keep no step. Lists are found along each
    record's value, at any depth and in other lists, by the schema of its owner (a collection, or null). One pass in
    Arrow batches for all collections: nothing is parsed twice, joined or shuffled.
    """
    texts = {name: json.dumps(schema) for name, schema in schemas.items()}
    kind = records.schema["nodes"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spines = {name: Spine(json.loads(text)) for name, text in texts.items()}
        for batch in (p for b in batches for p in pieces(b)):
            nodes = batch.column(3)
            keys = [item_keys(spines[owner], json.loads(value)) if owner in spines and value is not None else {} for owner, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            if any(keys):
                named = [[n | {"step": k.get(n["at"], n["step"])} for n in held] for held, k in zip(nodes.to_pylist(), keys, strict=True)]
                nodes = pa.array(named, nodes.type)
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes], names=["path", "nodes"])

    return records.select("path", "owner", "value", "nodes").mapInArrow(run, f"path string, nodes {kind.simpleString()}")


def list_items(nodes: DataFrame, at: str, key: str) -> DataFrame:
    """Items of one declared list as keyed_list_issues() reads them: path, list_at, at, key, doc_order."""
    items = nodes.where(F.col("parent") == at).select("path", F.lit(at).alias("list_at"), "at", "doc_order")
    keys = nodes.where((F.col("step") == key) & (F.col("kind") == "string")).select("path", F.col("parent").alias("at"), F.col("str").alias("key"))
    return items.join(keys, ["path", "at"], "left")


def extract_typed(records: DataFrame, schemas: dict[str, object]) -> DataFrame:
    """Typed references of records (path, owner, value): path, at, raw, many, targets (null if any are allowed), explicit.

    They are found along each record's value, at any depth, in one pass in Arrow batches for all collections.
    """
    texts = {name: json.dumps(schema) for name, schema in schemas.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = {name: json.loads(text) for name, text in texts.items()}
        for batch in (p for b in batches for p in pieces(b)):
            rows = []
            for path, owner, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if owner in roots and value is not None:
                    rows += [(path, r["at"], r["raw"], r["many"], r["targets"], r["anchors"] == "explicit") for r in typed_refs(roots[owner], json.loads(value))]
            c = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(c, kinds, strict=True)], names=["path", "at", "raw", "many", "targets", "explicit"])

    return records.select("path", "owner", "value").mapInArrow(run, "path string, at string, raw string, many boolean, targets array<string>, explicit boolean")


def allowed(record: Column, collections: Column, targets: list[str], names: set[str]) -> Column:
    """Whether a target path is in one of the named collections alone or matches one of the globs; without any, nothing is."""
    test = F.lit(False)
    for t in targets:
        test = test | ((F.size(collections) == 1) & F.array_contains(collections, t) if t in names else paths.glob(t)(record))
    return test


def declared_targets(schema: object) -> set[tuple[str, ...]]:
    """Every list of targets that stands anywhere in a schema."""
    out: set[tuple[str, ...]] = set()
    if isinstance(schema, dict):
        ref = schema.get("x-vmd-ref")
        if isinstance(ref, dict) and isinstance(ref.get("targets"), list):
            out.add(tuple(ref["targets"]))
    for part in schema.values() if isinstance(schema, dict) else schema if isinstance(schema, list) else ():
        out |= declared_targets(part)
    return out


def target_issues(limited: DataFrame, files: DataFrame, lists: set[tuple[str, ...]], names: set[str]) -> DataFrame:
    """ref-target-not-allowed for resolved references (path, at, raw, status, record, targets) that their declaration restricts.

    lists has every list of targets that a declaration can have: schemas are few, so each becomes an expression.
    """
    held = files.select(F.col("path").alias("record"), "collections")
    live = limited.where("status in ('ok', 'aliased')").join(held, "record", "left")
    fits = F.lit(False)
    for targets in sorted(lists):
        own = F.array(*map(F.lit, targets)) if targets else F.array().cast("array<string>")
        fits = fits | ((F.col("targets") == own) & F.coalesce(allowed(F.col("record"), F.col("collections"), list(targets), names), F.lit(False)))
    return issues_of(live.where(F.col("targets").isNotNull() & ~fits).select("path", "at", "raw").distinct(), "ref-target-not-allowed", F.col("at"), F.col("raw"))


def unanchored_issues(limited: DataFrame, anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref-target-not-allowed for references declared with `anchors: explicit` (ref_id, path, at, raw, status, record,
    target_at, fragment_kind, steps, explicit) that a step reaches by a title-derived name or a position alone.

    A target's route is its nearest ancestors, one a step. A step names a section, or the root, soundly only by an explicit or
    block anchor there, and an item of a list without keys only by one too; members and keys of keyed lists are sound.
    """
    asked = limited.where("explicit and status = 'ok' and fragment_kind = 'semantic'").select("ref_id", "path", "at", "raw", "record", "target_at", "steps").distinct()
    held = nodes.where("at = '' or step is not null").select(F.col("path").alias("record"), F.col("at").alias("here"), "kind", F.col("parent").alias("above"))
    route = asked.withColumn("here", F.explode(resolve.ancestors(F.col("target_at")))).join(held, ["record", "here"])
    up = F.row_number().over(Window.partitionBy("ref_id", "target_at").orderBy(F.desc(F.length("here"))))
    route = route.withColumn("up", up).where(F.col("up") <= F.size("steps")).withColumn("name", F.element_at("steps", F.size("steps") - F.col("up") + 1))
    lists = nodes.where("kind = 'array'").select(F.col("path").alias("record"), F.col("at").alias("above"), F.lit(True).alias("listed"))
    sound = anchors.where("kind in ('explicit', 'block')").select(F.col("path").alias("record"), F.col("at").alias("here"), "name", F.lit(True).alias("sound")).distinct()
    told = route.join(lists, ["record", "above"], "left").join(sound, ["record", "here", "name"], "left")
    item = F.col("listed") & (F.substring_index("here", "/", -1) == F.col("name"))
    fragile = F.col("sound").isNull() & ((F.col("here") == "") | (F.col("kind") == "section") | F.coalesce(item, F.lit(False)))
    return issues_of(told.where(fragile).select("path", "at", "raw").distinct(), "ref-target-not-allowed", F.col("at"), F.col("raw"))


def fragile_issues(resolved: DataFrame, anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Warnings for references whose first step is reached by a derived anchor alone: ref-derived-repeat where another
    heading of the record has the same key, else ref-derived-anchor."""
    first = resolved.where("status in ('ok', 'aliased') and fragment_kind = 'semantic'").select("path", "at", "raw", "record", F.element_at("steps", 1).alias("name"))
    ways = anchors.groupBy(F.col("path").alias("record"), "name").agg(F.collect_set("kind").alias("kinds"), F.min("at").alias("target_at"))
    own = nodes.where("parent = '' and kind <> 'section'").select(F.col("path").alias("record"), F.col("step").alias("name")).distinct()
    fragile = first.join(ways, ["record", "name"]).where(F.array_contains("kinds", "derived") & (F.size("kinds") == 1)).join(own, ["record", "name"], "left_anti")
    same = F.count("*").over(Window.partitionBy("path", "key")) > 1
    repeats = nodes.where("kind = 'section'").select(F.col("path").alias("record"), F.col("at").alias("target_at"), same.alias("repeated"))
    told = fragile.join(repeats, ["record", "target_at"], "left")
    code = F.when(F.col("repeated"), "ref-derived-repeat").otherwise("ref-derived-anchor")
    return told.select(code.alias("code"), "path", "at", F.col("raw").alias("message"))


def collection_keys(records: DataFrame, collections: dict[str, dict]) -> DataFrame:
    """(path, collection, key) of records in one collection: a pattern's first group in the file name, or a field."""
    out = F.lit(None).cast("string")
    for name, c in collections.items():
        key = c.get("key")
        if isinstance(key, dict) and "pattern" in key:
            found = F.regexp_extract(paths.last_segment(F.col("path")), key["pattern"], 1)
            value = F.when(found != "", found)
        elif isinstance(key, (str, dict)):
            value = F.get_json_object("value", f"$.{key if isinstance(key, str) else key['field']}")
        else:
            continue
        out = F.when(F.col("collection") == name, value).otherwise(out)
    own = records.where(F.size("collections") == 1).withColumn("collection", F.element_at("collections", 1))
    return own.select("path", "collection", out.alias("key"))
