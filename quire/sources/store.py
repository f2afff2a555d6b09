"""A store: files below a root (or in memory), its configuration, and the canonical tables derived from them.

Every table is a lazy DataFrame over one parse of the record files, which makes only the columns that the table needs; call
cached() to keep the whole parse for a session, or build_index() and open_index() to keep it as Parquet.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpointing import checkpointed
from ..functions import paths, uri
from ..functions.text import git_blob_id
from ..operators import binding, checks, listing, references, resolve
from ..parse.arrow import exploded, parse_files, values_at
from ..plans.query import condition
from ..plans.vql import fields_of, parse
from ..plans.scopes import ValueScope
from ..schema import spine
from ..schema.validate import compile_schema, validate_records
from . import schemas

#: Names that the store format fixes. Fixed values.
CONFIG = ".vmd/config.yaml"
ALIASES = ".vmd/aliases.jsonl"
SCHEMAS = ".vmd/schema/"
#: What checks and references read of the parse. Fixed values.
CHECKED = ("format", "version", "readable", "value", "nodes", "anchors", "tags", "refs", "issues")
MEMBERS = {"vmd", "uniqueness", "yaml_quoting", "issues", "ignore", "collections"}


class ConfigError(ValueError):
    """Everything that is wrong with a configuration, one line each."""


@dataclass
class Config:
    uniqueness: str = "strict"
    yaml_quoting: str = "compatible"
    issues: dict[str, str] = field(default_factory=dict)
    ignore: list[str] = field(default_factory=list)
    collections: dict[str, dict] = field(default_factory=dict)


def read_config(text: str) -> Config:
    """A configuration file; ConfigError lists all its problems."""
    data = yaml.safe_load(text) or {}
    problems = [] if isinstance(data, dict) else ["the configuration is not an object"]
    data = data if isinstance(data, dict) else {}
    problems += [f"unknown member {m}" for m in sorted(set(data) - MEMBERS)]
    if data.get("uniqueness", "strict") not in ("strict", "lenient"):
        problems.append("uniqueness is strict or lenient")
    problems += [f"issues.{c}: {s} is no severity" for c, s in (data.get("issues") or {}).items() if s not in ("error", "warning", "off") and s is not False]
    globs = [("ignore", g) for g in data.get("ignore") or []]
    for name, c in (data.get("collections") or {}).items():
        if not (c or {}).get("match"):
            problems.append(f"collections.{name}: match is missing")
        globs += [(f"collections.{name}", g) for part in ("match", "exclude") for g in (c or {}).get(part) or []]
    for where, g in globs:
        try:
            paths.glob(g)
        except ValueError as e:
            problems.append(f"{where}: {e}")
    if problems:
        raise ConfigError("\n".join(problems))
    chosen = {c: "off" if s is False else s for c, s in (data.get("issues") or {}).items()}
    return Config(data.get("uniqueness", "strict"), data.get("yaml_quoting", "compatible"), chosen, list(data.get("ignore") or []), dict(data.get("collections") or {}))


def memory_files(spark: SparkSession, files: dict[str, str | bytes]) -> DataFrame:
    """A files table from a dict: path, content, size."""
    rows = [(p, c.encode() if isinstance(c, str) else c) for p, c in sorted(files.items())]
    return spark.createDataFrame(rows, "path string, content binary").withColumn("size", F.octet_length("content").cast("long"))


def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """A files table of a folder in any file system that Spark reads; paths are relative to the root.

    Spark's file sources leave out names that start with . or _, so the configuration folder is read on its own, and
    records whose names start with _ aren't seen.
    """
    top = root.rstrip("/")
    bare = top.split("://")[-1].removeprefix("file:").lstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top}/.vmd")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    raw = None
    for folder in [top, f"{top}/.vmd"][: 2 if there else 1]:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        raw = part if raw is None else raw.unionByName(part)
    relative = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z]+:/*", ""), f"^{re.escape(bare)}/", "")
    return raw.select(relative.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(r"(?:^|/)\.git(?:/|$)"))


def _current(index: DataFrame) -> DataFrame:
    """An index as it is; ValueError for one whose candidates repeat what their ancestors have, as they once did."""
    if "above" not in index.schema["candidates"].dataType.elementType.names:
        raise ValueError("the index was built by an earlier version; build it anew in another folder")
    return index


class Store:
    """Files and what they say."""

    def __init__(self, files: DataFrame, config: Config | None = None, parsed: DataFrame | None = None) -> None:
        self.all_files = files
        self.config = config or self._read_config()
        self._parsed = parsed
        self._kept: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        return cls(folder_files(spark, root))

    @classmethod
    def of(cls, spark: SparkSession, files: dict[str, str | bytes]) -> Store:
        return cls(memory_files(spark, files))

    def _bytes(self, path: str) -> bytes | None:
        row = self.all_files.where(F.col("path") == path).select("content").first()
        return None if row is None else bytes(row["content"])

    def _text(self, path: str) -> str | None:
        held = self._bytes(path)
        return None if held is None else held.decode()

    def _read_config(self) -> Config:
        text = self._text(CONFIG)
        return Config() if text is None else read_config(text)

    @cached_property
    def files(self) -> DataFrame:
        """Files that aren't ignored, with kind, collections and version."""
        p = F.col("path")
        shown = self.all_files.where(~paths.ignored(p, self.config.ignore))
        return shown.withColumns({"kind": paths.file_kind(p), "collections": paths.collections_of(p, self.config.collections), "version": git_blob_id(F.col("content"))})

    @cached_property
    def _listed(self) -> DataFrame:
        """files without contents, listed once for all that a check or references ask of them."""
        return checkpointed(self.files.select("path", "kind", "collections"))

    @cached_property
    def parsed(self) -> DataFrame:
        return parse_files(self.files) if self._parsed is None else self._parsed

    def _parse(self, *columns: str) -> DataFrame:
        """The parse with these columns: that of the index or the one that is kept, or else one that makes no others."""
        if self._parsed is not None or ("parsed" in self.__dict__ and self.parsed.is_cached):
            return self.parsed
        if self._kept is not None and set(columns) <= set(CHECKED):
            return self._kept
        return parse_files(self.files, columns)

    def _keep(self) -> None:
        """Keeps what checks and references read of the parse, as they read it a dozen times, unless it is there."""
        if self._parsed is None and self._kept is None and not ("parsed" in self.__dict__ and self.parsed.is_cached):
            self._kept = parse_files(self.files, CHECKED).persist()

    def _only(self, names: list[str]) -> Store:
        """This store with the files and the parse of some records alone."""
        held = F.col("path").isin(names)
        of = self._parse(*CHECKED).where(held) if self._parsed is not None or self._kept is not None or ("parsed" in self.__dict__ and self.parsed.is_cached) else None
        one = Store(self.all_files.where(held), self.config, of)
        one.__dict__.update(loaded_schemas=self.loaded_schemas, schemas=self.schemas)
        return one

    def cached(self) -> Store:
        """Keeps the parse in memory and on disk for this session; what an executor loses is parsed again."""
        if not self.parsed.is_cached:
            self.__dict__["parsed"] = self.parsed.persist()
        return self

    def _part(self, paths_: DataFrame) -> Store:
        """This store with the parse of some records (path) alone; its files are still all there."""
        part = Store(self.all_files, self.config, self._parse(*CHECKED).join(paths_, "path", "left_semi"))
        part.__dict__.update(files=self.files, _listed=self._listed, loaded_schemas=self.loaded_schemas, schemas=self.schemas)
        return part

    @cached_property
    def records(self) -> DataFrame:
        held = self.files.select("path", "collections", "size")
        columns = ("format", "version", "readable", "value")
        return self._parse(*columns).select("path", *columns).join(held, "path")

    @cached_property
    def loaded_schemas(self) -> dict[str, tuple[object, list[str]]]:
        """Collection -> its schema, inline or from the schema folder with the files that it names, and what keeps it from being used."""
        out = {}
        for name, c in self.config.collections.items():
            held = c.get("schema")
            if isinstance(held, str):
                out[name] = schemas.load(held, lambda file: self._bytes(SCHEMAS + file))
            elif held:
                out[name] = held, spine.problems(held)
        return out

    @cached_property
    def schemas(self) -> dict[str, object]:
        """Collection -> its schema, for those that can be used."""
        return {name: schema for name, (schema, found) in self.loaded_schemas.items() if not found}

    def _schema_issues(self) -> DataFrame:
        """One schema-invalid for each collection whose schema can't be used; it belongs to the store, not to a record."""
        rows = [("schema-invalid", None, None, f"the schema of {name} can't be used: {'; '.join(found)}") for name, (_, found) in sorted(self.loaded_schemas.items()) if found]
        return self.all_files.sparkSession.createDataFrame(rows, "code string, path string, at string, message string")

    def require_schemas(self, collection: str | None = None) -> None:
        """SchemaError if a strict read over the collection, or over all, meets a schema that can't be used."""
        for name, (_, found) in self.loaded_schemas.items():
            if found and collection in (None, name):
                raise spine.SchemaError(f"{name}: {'; '.join(found)}")

    def _owner(self) -> Column:
        """The collection that alone claims a row's path, or null."""
        claimed = paths.collections_of(F.col("path"), self.config.collections)
        return F.when(F.size(claimed) == 1, F.element_at(claimed, 1))

    @property
    def nodes(self) -> DataFrame:
        """Nodes of readable records; steps into declared keyed lists are keys."""
        keyed = {name: schema for name, schema in self.schemas.items() if "x-vmd-list" in str(schema)}
        readable = self._parse("readable", "nodes", *(["value"] if keyed else [])).where("readable")
        return exploded(binding.bound_nodes(readable.withColumn("owner", self._owner()), keyed) if keyed else readable, "nodes")

    @property
    def anchors(self) -> DataFrame:
        return exploded(self._parse("readable", "anchors").where("readable"), "anchors")

    @property
    def tags(self) -> DataFrame:
        return exploded(self._parse("readable", "tags").where("readable"), "tags")

    @cached_property
    def alias_lines(self) -> DataFrame | None:
        """Entries of the alias file (kind, record, source, target, line); None for a store without one."""
        if self.all_files.where(F.col("path") == ALIASES).isEmpty():
            return None
        schema = "kind string, `from` string, `to` string, record string"
        lines = listing.file_lines(self.all_files.where(F.col("path") == ALIASES).select("path", F.decode("content", "UTF-8").alias("text")))
        read = lines.select("line", F.from_json("text", schema).alias("a")).select("line", "a.*")
        return checkpointed(read.select("kind", "record", F.col("from").alias("source"), F.col("to").alias("target"), "line"))

    @cached_property
    def aliases(self) -> DataFrame | None:
        """Record aliases (source, target, line) from the alias file."""
        return None if self.alias_lines is None else self.alias_lines.where("kind = 'record'").select("source", "target", "line")

    @cached_property
    def renames(self) -> DataFrame | None:
        """Anchor aliases of live records (path, source, target, line), those under a record's old paths included."""
        if self.alias_lines is None:
            return None
        own = self.alias_lines.where("kind = 'anchor'").select("record", "source", "target", "line")
        return checkpointed(references.anchor_renames(own, references.alias_chains(self.aliases, self._listed)))

    @cached_property
    def typed(self) -> DataFrame | None:
        """References that the schemas of collections declare; None if none does."""
        declared = {name: schema for name, schema in self.schemas.items() if "x-vmd-ref" in str(schema)}
        return binding.extract_typed(self._parse("readable", "value").where("readable").withColumn("owner", self._owner()), declared) if declared else None

    @cached_property
    def refs(self) -> DataFrame:
        """References with their resolved target: ref_id, path, at, kind, raw, start, target, fragment_kind, steps."""
        raw = exploded(self._parse("readable", "refs").where("readable"), "refs")
        if self.typed is not None:
            # A $ref object with a declaration is still one reference.
            fresh = self.typed.select("path", "at", F.lit("typed").alias("kind"), "raw", F.lit(0).cast("long").alias("start")).join(raw.select("path", "at"), ["path", "at"], "left_anti")
            raw = raw.unionByName(fresh)
        u = uri.resolve(F.col("raw"), F.col("path"))
        r = raw.withColumn("u", u).withColumn("ref_id", F.xxhash64("path", "at", "start", "raw"))
        inside = F.col("u.kind").isin("path", "directory")
        fragment = F.coalesce("u.fragment", F.lit(""))
        exact = fragment.startswith("/") | fragment.startswith("%2F")
        decoded = uri.percent_decode(fragment)
        steps = F.when(fragment == "", F.array().cast("array<string>")).when(exact, F.array(decoded)).otherwise(F.transform(F.split(fragment, "/"), uri.percent_decode))
        kind = F.when(fragment == "", "root").when(exact, "exact").otherwise("semantic")
        return r.select("ref_id", "path", "at", "kind", "raw", "start", F.when(inside, F.col("u.target")).alias("target"), kind.alias("fragment_kind"), steps.alias("steps"))

    @cached_property
    def _resolved(self) -> DataFrame:
        self._keep()
        return self._resolve_refs(self.refs)

    def resolved_refs(self, within: DataFrame | None = None) -> DataFrame:
        """refs with status, record and target_at (one row per target); of the records `within` (path) alone, if given.

        Those of the whole store are settled once. Of a part, only the records that its references reach are read.
        """
        return self._resolved if within is None else self._resolve_refs(self.refs.join(within, "path", "left_semi"), part=True)

    def _resolve_refs(self, refs: DataFrame, part: bool = False) -> DataFrame:
        everything = self._listed.select("path").union(references.directories(self._listed))
        settled = checkpointed(references.record_status(refs, everything, self.aliases))
        reached = self._part(settled.select(F.col("record").alias("path")).where("path is not null").distinct()) if part else self
        if self.renames is not None:
            settled = checkpointed(references.renamed_steps(settled, self.renames, resolve.first_names(reached.nodes, reached.anchors)))
        longest = settled.agg(F.max(F.size("steps"))).first()[0] or 1
        told = references.node_status(settled, reached.nodes, reached.anchors, max(1, longest)).select("ref_id", F.col("status").alias("node_status"), F.col("at").alias("target_at"))
        assets = settled.join(told, "ref_id", "left")
        is_record = paths.record_format(F.col("record")).isNotNull()
        status = F.when(F.col("status").isin("ok", "aliased") & is_record, F.col("node_status")).otherwise(F.col("status"))
        return assets.withColumn("status", status).drop("node_status")

    def addresses(self, addresses: list[str]) -> DataFrame:
        """Addresses as rows for resolve()."""
        from urllib.parse import unquote

        rows = []
        for i, a in enumerate(addresses):
            path, _, fragment = a.partition("#")
            kind = "root" if not fragment else "exact" if unquote(fragment).startswith("/") else "semantic"
            steps = [unquote(fragment)] if kind == "exact" else [unquote(s) for s in fragment.split("/")] if fragment else []
            rows.append((i, path, kind, steps))
        return self.all_files.sparkSession.createDataFrame(rows, "address_id long, path string, kind string, steps array<string>")

    def resolve(self, addresses: list[str], singular: bool = True) -> DataFrame:
        """The nodes of addresses: address_id, path, at, status."""
        longest = max((len(a.partition("#")[2].split("/")) for a in addresses), default=1)
        named = self._only(sorted({a.partition("#")[0] for a in addresses}))
        return resolve.resolve(self.addresses(addresses), named.nodes, named.anchors, longest, singular)

    def get(self, address: str, form: str = "value") -> DataFrame:
        """A node as its value (canonical JSON), body or source bytes (singular address)."""
        one = self._only([address.partition("#")[0]])
        found = one.resolve([address]).where("status = 'ok'").join(one.nodes, ["path", "at"])
        if form == "body":
            return found.select("path", "at", F.coalesce("body", F.lit("")).alias("body"))
        if form == "source":
            return found.join(one.all_files.select("path", "content"), "path").select("path", "at", F.decode(F.expr("substring(content, int(start) + 1, int(end - start))"), "UTF-8").alias("source"))
        shown = values_at(found.join(one._parse("value").select("path", "value"), "path").select("path", "at", "value"))
        return found.select("path", "at", "kind", "title", "str", "num", "flag", "version").join(shown, ["path", "at"])

    def outline(self, path: str, at: str = "", depth: int | None = None) -> DataFrame:
        """Sections below a node to a depth, in document order, with sizes and references into each."""
        shown = self.nodes.where((F.col("path") == path) & (F.col("kind") == "section") & resolve.below(F.col("at"), F.lit(at)))
        if depth is not None:
            top = at.count("/$sections/")
            shown = shown.where(F.col("depth") <= top + depth)
        counts = references.counts_into(self.resolved_refs().where(F.col("record") == path))
        return shown.join(counts.select("at", "n_refs"), "at", "left").select("at", "key", "title", "depth", (F.col("end") - F.col("start")).alias("size"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"), "doc_order").orderBy("doc_order")

    def candidates(self, target: str = "records", fields: set[str] | None = None) -> DataFrame:
        """Roots or sections with their values; those of a section include what its ancestors have and it lacks, nearest first.

        With fields, values has only these. A field's nearest holder is found along the places of a candidate's ancestors within
        the record's row, so that no section carries what its siblings have.
        """
        parsed = self._parse("readable", "candidates").where("readable")
        if target == "records":
            shown = F.filter("candidates", lambda c: c["at"] == "")
        else:
            kind = parsed.schema["candidates"].dataType.elementType["values"].dataType.simpleString()
            parsed = parsed.withColumn("own", F.transform("candidates", lambda c: F.struct(c["above"].alias("above"), c["values"].alias("values"))))
            within = lambda i, depth, f: F.aggregate(F.sequence(F.lit(0), depth), i, lambda j, _: F.when(F.try_element_at(F.get("own", j)["values"], f).isNull(), F.coalesce(F.get("own", j)["above"], j)).otherwise(j))
            near = lambda c, i, f: F.try_element_at(F.get("own", within(i, c["depth"], f))["values"], f)
            if fields is None:
                above = lambda c, i: F.aggregate(F.sequence(F.lit(0), c["depth"]), F.struct(i.alias("at"), F.create_map().cast(kind).alias("values")), lambda s, _: F.struct(
                    F.get("own", s["at"])["above"].alias("at"), F.coalesce(F.map_concat(s["values"], F.map_filter(F.get("own", s["at"])["values"], lambda k, v: ~F.map_contains_key(s["values"], k))), s["values"]).alias("values")))["values"]
            else:
                pairs = lambda c, i: [x for f in sorted(fields) for x in (F.lit(f), near(c, i, F.lit(f)))]
                above = lambda c, i: F.create_map(*pairs(c, i)) if fields else F.create_map().cast(kind)
            shown = F.transform("candidates", lambda c, i: c.withField("values", above(c, i)))
        rows = parsed.select("path", F.explode(shown).alias("r")).select("path", "r.*")
        rows = rows.join(self.files.select("path", "collections"), "path").withColumn("collection", F.when(F.size("collections") == 1, F.element_at("collections", 1)))
        return rows if target == "records" else rows.withColumn("strings", F.array().cast("array<string>"))

    def query(self, text: str, target: str = "records", collection: str | None = None) -> DataFrame:
        """Records or sections that match a search."""
        needed = fields_of(parse(text))
        rows = self.candidates(target, {f if f.startswith("/") else f.replace(".", "/") for f in needed if not f.startswith("@")})
        if collection is not None:
            rows = rows.where(F.col("collection") == collection)
        if "@refs" in needed:
            targets = self.resolved_refs().where("status in ('ok', 'aliased')")
            name = F.concat("record", F.when(F.col("target_at") == "", F.lit("")).otherwise(F.concat(F.lit("#"), "target_at")))
            cited = targets.groupBy("path").agg(F.collect_set(name).alias("ref_targets"))
            rows = rows.join(cited, "path", "left").withColumn("ref_targets", F.coalesce("ref_targets", F.array().cast("array<string>")))
        if "@issues" in needed:
            rows = rows.join(self.check().groupBy("path").agg(F.count("*").alias("n_issues")), "path", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))
        return rows.where(condition(text, ValueScope()))

    def projected(self, found: DataFrame, fields: list[str] | None = None) -> DataFrame:
        """Records (path) with collection, key, title and a map of fields by exact path, as text or JSON: those named, or the
        ones that the collection's schema marks for summaries."""
        rows = found.select("path").join(self.records, "path").withColumn("collection", self._owner())
        at = lambda path: F.get_json_object("value", "$" + "".join(f"['{t}']" for t in path.replace("~1", "/").split("/")[1:]))
        shown = lambda chosen: F.create_map(*(x for p in chosen for x in (F.lit(p), at(p)))) if chosen else F.create_map().cast("map<string,string>")
        out = shown(fields or [])
        if fields is None:
            for name, schema in self.schemas.items():
                out = F.when(F.col("collection") == name, shown([r["path"] for r in spine.summary(schema) if r["summary"]])).otherwise(out)
        keys = binding.collection_keys(self.records, self.config.collections).select("path", "key")
        return rows.select("path", "collection", at("/$title").alias("title"), out.alias("fields")).join(keys, "path", "left")

    def validation(self) -> DataFrame:
        """Schema violations of every collection that has an inline or file schema."""
        parts = []
        for name, schema in self.schemas.items():
            own = self.records.where((F.size("collections") == 1) & (F.element_at("collections", 1) == name) & F.col("readable"))
            parts.append(validate_records(own, compile_schema(schema)))
        return checks.union_all(parts) if parts else self.all_files.sparkSession.createDataFrame([], "code string, path string, at string, message string")

    def scope(self, changed: DataFrame) -> DataFrame | None:
        """Records (path) that a check after changes to paths reads: the changed ones and those that cite one or a folder above
        one. None, for the whole store, if the configuration, a schema or the alias file changed, or a path that an alias names.
        """
        own = F.col("path").isin(CONFIG, ALIASES) | F.col("path").startswith(SCHEMAS)
        if not changed.where(own).isEmpty():
            return None
        if self.alias_lines is not None:
            named = self.alias_lines.select(F.explode(F.array("record", F.when(F.col("kind") == "record", F.col("source")), F.when(F.col("kind") == "record", F.col("target")))).alias("path"))
            if not changed.join(named, "path", "left_semi").isEmpty():
                return None
        return checkpointed(references.changed_scope(changed.select("path"), self.refs))

    def check(self, changed: DataFrame | None = None) -> DataFrame:
        """All issues with severities; with changed paths, those of the changed scope and of the store itself.

        The parse is kept, unless it comes from an index. Of a scope, only its own records
        are checked and only the records that they cite are resolved in; over an index, nothing else is parsed or bound.
        """
        p = F.col("path")
        self._keep()
        within = None if changed is None else self.scope(changed)
        part = self if within is None else self._part(within)
        inside = lambda df: df if within is None else df.join(within, "path", "left_semi")
        structural = exploded(part._parse("issues"), "issues").select("code", "path", "at", "message")
        names = inside(self._listed.where(F.col("kind") == "record"))
        parts = [
            structural,
            self._schema_issues(),
            checks.duplicate_keys(part._repeating_nodes().where("kind <> 'array' and not (step is null)")),
            checks.duplicate_anchors(part._repeating("anchors", ["name"], ["at"])),
            checks.duplicate_tags(part._repeating("tags", ["at", "tag"])),
            checks.issues_of(names.where(F.size(paths.path_problems(p)) > 0), "path-invalid", message=F.array_join(paths.path_problems(p), ",")),
            checks.issues_of(names.where(F.size("collections") > 1), "collection-conflict", message=F.array_join("collections", ",")),
            checks.issues_of(inside(listing.case_conflicts(self._listed)), "path-case-conflict", message=F.col("first")),
            part.validation(),
            self._filename_issues(names),
            self._reference_issues(within),
        ]
        return checks.severities(checks.union_all(parts), self.config.uniqueness, self.config.issues)

    def _repeating(self, column: str, by: list[str], beside: list[str] | None = None, where: Callable[[Column], Column] | None = None) -> DataFrame:
        """Rows of a column of the parse, of those records alone that have two of equal `by` (and unlike `beside`, if given).

        It is told in the record's row, so that only the rows of such records are moved to find which they are.
        """
        rows = F.col(column) if where is None else F.filter(column, where)
        keys = lambda names: F.array_distinct(F.transform(rows, lambda r: F.concat_ws("\0", *(r[n] for n in names))))
        most = F.size(keys(by + beside)) if beside else F.size(rows)
        return exploded(self._parse(*CHECKED).where("readable").where(F.size(keys(by)) < most), column)

    def _repeating_nodes(self) -> DataFrame:
        """Nodes of the records that may have two of one key; all nodes where keys come from a schema."""
        if any("x-vmd-list" in str(schema) for schema in self.schemas.values()):
            return self.nodes
        return self._repeating("nodes", ["parent", "step"], where=lambda n: (n["kind"] != "array") & (n["step"] != ""))

    def _filename_issues(self, names: DataFrame) -> DataFrame:
        from ..functions.portable import translate

        test: Column = F.lit(False)
        for name, c in self.config.collections.items():
            if c.get("filename"):
                test = test | (F.array_contains("collections", name) & ~paths.last_segment(F.col("path")).rlike(translate(c["filename"])))
        return checks.issues_of(names.where(test), "filename-mismatch")

    def _reference_issues(self, within: DataFrame | None = None) -> DataFrame:
        resolved = self.resolved_refs(within)
        r = resolved.where("status not in ('ok', 'outside')").select("ref_id", "path", "at", "raw", "status").distinct()
        code = F.when(F.col("status") == "unreadable", "ref-target-unreadable").otherwise(F.concat(F.lit("ref-"), "status"))
        reached, inside = self, lambda df: df
        if within is not None:
            reached = self._part(resolved.select(F.col("record").alias("path")).where("path is not null").distinct())
            inside = lambda df: df.join(within, "path", "left_semi")
        parts = [r.select(code.alias("code"), "path", "at", F.col("raw").alias("message")), binding.fragile_issues(resolved, reached.anchors, reached.nodes)]
        if self.aliases is not None:
            moved = references.shadowed(self.aliases, self._listed.where("kind = 'record'")).select(F.col("source").alias("path")).distinct()
            parts.append(checks.issues_of(inside(moved), "alias-shadowed", message=F.col("path")))
            own = self if within is None else self._part(within)
            parts.append(checks.issues_of(references.shadowed_names(self.renames, resolve.first_names(own.nodes, own.anchors)), "alias-shadowed", F.col("at"), F.col("name")))
        if self.typed is not None:
            lists = set().union(*map(binding.declared_targets, self.schemas.values()))
            limited = resolved.join(self.typed.select("path", "at", "targets", "explicit").where("targets is not null or explicit").distinct(), ["path", "at"])
            refused = binding.target_issues(limited, self._listed, lists, set(self.config.collections)).unionByName(binding.unanchored_issues(limited, reached.anchors, reached.nodes))
            parts.append(refused.distinct())
        return checks.union_all(parts)

    def build_index(self, folder: str) -> None:
        """Appends the parse of every version that the index lacks, as Parquet."""
        spark = self.all_files.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        fresh = self.files
        if there:
            _current(spark.read.parquet(folder))
            fresh = fresh.join(spark.read.parquet(folder).select("version", "path"), ["version", "path"], "left_anti")
        parse_files(fresh).write.mode("append").parquet(folder)

    def open_index(self, folder: str) -> Store:
        """This store with its parse taken from the index: current versions only."""
        kept = _current(self.all_files.sparkSession.read.parquet(folder)).join(self.files.select("path", "version"), ["path", "version"], "left_semi")
        return Store(self.all_files, self.config, kept)
