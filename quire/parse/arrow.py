"""The Arrow driver of the readers: files in, one row a record out, and the canonical tables as explodes of it.

A file is read once; nodes, anchors, tags, references, issues and search candidates come from the same pass. No row
is shuffled: parsing scales with the files, and the canonical tables are generators over the parsed column.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import repeats, slug
from .record import candidates, read_record
from .values import jcs, pointer

NODE = "struct<at:string,parent:string,step:string,kind:string,depth:int,key:string,title:string,body:string,str:string,num:double,flag:boolean,doc_order:bigint,start:bigint,end:bigint,version:string>"
ANCHOR = "struct<name:string,kind:string,at:string,start:bigint,end:bigint,doc_order:bigint>"
TAG = "struct<at:string,tag:string,position:int>"
REF = "struct<at:string,kind:string,raw:string,start:bigint>"
ISSUE = "struct<code:string,at:string,message:string,offset:bigint>"
LEAF = "struct<kind:string,str:string,num:double,flag:boolean>"
#: A candidate's values are its own; those of its ancestors are found through `above`, its parent's place in the record's candidates.
CANDIDATE = f"struct<at:string,depth:int,key:string,title:string,body:string,doc_order:bigint,tags:array<string>,anchors:array<struct<name:string,kind:string>>,above:int,values:map<string,array<{LEAF}>>,strings:array<string>,size:bigint>"
COLUMNS = {
    "format": "string", "version": "string", "readable": "boolean", "value": "string", "nodes": f"array<{NODE}>", "anchors": f"array<{ANCHOR}>", "tags": f"array<{TAG}>", "refs": f"array<{REF}>",
    "issues": f"array<{ISSUE}>", "candidates": f"array<{CANDIDATE}>",
}
PARSED = "path string, " + ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())
#: What a Python worker holds as objects at a time. A record's rows take many times its bytes. Fixed values.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 256


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most PIECE_ROWS rows and about PIECE_BYTES, or of one row, so that a worker's memory is
    bounded by its largest row and not by Spark's batches."""
    if batch.num_rows <= 1 or (batch.num_rows <= PIECE_ROWS and batch.nbytes <= PIECE_BYTES):
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half))
        yield from pieces(batch.slice(half))


def parse_files(files: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """files (path, content) of records -> one row each, as PARSED says. Files of other kinds are left out.

    With columns, only those are made, besides the path.
    """
    spark = files.sparkSession
    chosen = [c for c in COLUMNS if c in columns]
    declared = "path string" + "".join(f", {c} {COLUMNS[c]}" for c in chosen)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], declared).schema)
    make = {
        "format": lambda r: r.format, "version": lambda r: r.version, "readable": lambda r: r.readable, "value": lambda r: None if r.value is None else jcs(r.value),
        "nodes": lambda r: r.nodes, "anchors": lambda r: r.anchors, "tags": lambda r: r.tags, "refs": lambda r: r.refs, "issues": lambda r: [i.__dict__ for i in r.issues],
        "candidates": lambda r: [c | {"values": list(c["values"].items())} for c in candidates(r, inherit=False)],
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                rows = []
                for path, content in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    r = read_record(path, content or b"")
                    rows.append({"path": path} | {c: make[c](r) for c in chosen})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    records = files.where(paths.file_kind(F.col("path")) == "record")
    return records.select("path", "content").mapInArrow(run, declared)


def exploded(parsed: DataFrame, column: str) -> DataFrame:
    """nodes, anchors, tags, refs, issues or candidates as a table with the record's path."""
    return parsed.select("path", F.explode(column).alias("r")).select("path", "r.*")


def derived_anchors(titles: DataFrame) -> DataFrame:
    """(path, doc_order, anchor) from (path, doc_order, title): slugs with repeat suffixes.

    A suffix depends on all earlier headings of the record, so a record's headings are one group; it holds
    titles only, and a record is bounded by the size limit of a file.
    """
    kind = titles.schema["doc_order"].dataType.simpleString()

    def run(key, batch):
        rows = batch.to_pylist()
        rows.sort(key=lambda r: r["doc_order"])
        names = repeats([slug(r["title"] or "") for r in rows])
        return pa.Table.from_pydict({"path": [r["path"] for r in rows], "doc_order": [r["doc_order"] for r in rows], "anchor": names})

    return titles.select("path", "doc_order", "title").groupBy("path").applyInArrow(run, f"path string, doc_order {kind}, anchor string")


def written(values: DataFrame, kind: str) -> DataFrame:
    """(path, content, problem) of records (path, value as JSON) in a format (md, yaml or json); a value that the format can't
    hold has no content and says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .serialize import NotRepresentable, to_json, to_markdown, to_yaml

        writer = {"md": to_markdown, "yaml": to_yaml, "json": to_json}[kind]
        for batch in (p for b in batches for p in pieces(b)):
            texts, problems = [], []
            for value in batch.column(1).to_pylist():
                try:
                    texts.append(None if value is None else writer(json.loads(value)).encode())
                    problems.append(None)
                except NotRepresentable as e:
                    texts.append(None)
                    problems.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(problems, pa.string())], names=["path", "content", "problem"])

    return values.select("path", "value").mapInArrow(run, "path string, content binary, problem string")


def value_of(text: str | None) -> object:
    """A record's value from its canonical JSON."""
    return None if text is None else json.loads(text)


def values_at(rows: DataFrame) -> DataFrame:
    """(path, at, value) with a node's canonical JSON in place of its record's; null where the record's value has no such place."""

    def part(at: str, value: str | None) -> str | None:
        try:
            return None if value is None else jcs(pointer(json.loads(value), at))
        except KeyError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            shown = [part(a, v) for a, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shown, pa.string())], names=["path", "at", "value"])

    return rows.select("path", "at", "value").mapInArrow(run, "path string, at string, value string")
