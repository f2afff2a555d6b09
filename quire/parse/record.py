"""One record's file, read into rows: its nodes, anchors, tags, references and issues."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from ..functions.text import repeats, slug
from .blocks import read_blocks, split_lines
from .inline import LimitError, read_inline
from .json_reader import read_json
from .markdown import ANCHOR_NAME, Section, definitions, prose, read_markdown
from .values import MAX_BYTES, Issue, child, jcs, node_version, pointer
from .yaml_reader import read_yaml

FORMATS = {"md": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json"}
#: Reserved members of a section and the types they must have. Fixed values.
RESERVED = {"$title": str, "$anchor": str, "$body": str, "$tags": list, "$sections": list}


@dataclass
class Record:
    path: str
    format: str
    value: dict | None = None
    version: str = ""
    nodes: list[dict] = field(default_factory=list)
    anchors: list[dict] = field(default_factory=list)
    tags: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    issues: list[Issue] = field(default_factory=list)
    readable: bool = True


def blob_id(content: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def read_record(path: str, content: bytes, most: int = MAX_BYTES) -> Record:
    """A record file in full; what can't be read is reported and leaves the record unreadable, never raises."""
    fmt = FORMATS[path.rsplit(".", 1)[-1]]
    out = Record(path, fmt, version=blob_id(content))
    if len(content) > most:
        return _refuse(out, "larger than the size limit")
    bom = 3 if content.startswith(b"\xef\xbb\xbf") else 0
    try:
        text = content[bom:].decode("utf-8")
    except UnicodeDecodeError as e:
        return _refuse(out, "not UTF-8", bom + e.start)
    if fmt == "markdown":
        _from_markdown(out, text, bom)
    else:
        unit = read_json(text, bom) if fmt == "json" else read_yaml(text, bom)
        out.issues += unit.issues
        if isinstance(unit.value, dict):
            _from_data(out, unit.value, unit.spans)
        elif not unit.issues or unit.value is not None:
            out.issues.append(Issue("root-not-object"))
    out.readable = not any(i.code in STRUCTURAL for i in out.issues)
    if not out.readable:
        out.value = None
    return out


#: Codes that leave a record unreadable. Fixed values.
STRUCTURAL = {
    "syntax-error", "duplicate-member", "unpaired-surrogate", "number-not-representable", "number-not-finite", "yaml-anchor", "yaml-tag",
    "yaml-merge-key", "yaml-key", "yaml-documents", "yaml-version-unsupported", "root-not-object", "data-block-not-object", "data-block-misplaced",
    "dollar-member", "feature-unsupported", "reserved-member-type", "section-title-missing", "anchor-element-invalid", "ref-malformed",
}


def _refuse(out: Record, why: str, at: int = 0) -> Record:
    out.issues.append(Issue("syntax-error", "", why, at))
    out.readable = False
    return out


class _Shredder:
    """Nodes in document order from a value view, with keys and anchors of its sections."""

    def __init__(self, out: Record, spans: dict[str, tuple[int, int]]) -> None:
        self.out, self.spans = out, spans
        self.order = 0
        self.labels: dict[str, str] = {}

    def node(self, at: str, parent: str | None, step: str | None, kind: str, value: object, depth: int, **more) -> dict:
        start, end = self.spans.get(at, (None, None))
        row = {
            "at": at, "parent": parent, "step": step, "kind": kind, "depth": depth, "key": more.get("key"), "title": more.get("title"), "body": more.get("body"),
            "str": value if isinstance(value, str) else None, "num": float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None,
            "flag": value if isinstance(value, bool) else None, "doc_order": self.order, "start": start, "end": end, "version": node_version(value) if kind == "section" else None,
        }
        self.order += 1
        self.out.nodes.append(row)
        return row

    def section(self, value: dict, at: str, parent: str | None, depth: int, key: str | None, derived: str | None = None) -> None:
        title, body = value.get("$title"), value.get("$body")
        self.node(at, parent, key, "section", value, depth, key=key, title=title if isinstance(title, str) else None, body=body if isinstance(body, str) else None)
        if derived:
            self.anchor(derived, "derived", at)
        self.labelled(value, at)
        for name, item in value.items():
            if name == "$sections" and isinstance(item, list):
                continue
            if not name.startswith("$") or name in ("$title", "$body", "$anchor", "$tags", "$schema"):
                self.plain(item, child(at, name), at, name, depth)
            elif at == "" or name not in RESERVED:
                self.out.issues.append(Issue("dollar-member" if name in ("$key", "$schema") else "feature-unsupported", at, name))
        sections = value.get("$sections")
        if isinstance(sections, list):
            top = child(at, "$sections")
            self.node(top, at, "$sections", "array", None, depth)
            for i, s in enumerate(sections):
                here = child(top, i)
                if not isinstance(s, dict):
                    self.out.issues.append(Issue("reserved-member-type", here, "$sections"))
                    continue
                if "$title" not in s:
                    self.out.issues.append(Issue("section-title-missing", here))
                self.section(s, here, at, depth + 1, self.key(s, here))

    def key(self, value: dict, at: str) -> str:
        if isinstance(value.get("$anchor"), str):
            return value["$anchor"]
        title = value.get("$title")
        return slug(read_inline(title, self.labels).visible) if isinstance(title, str) else ""

    def labelled(self, value: dict, at: str) -> None:
        """$anchor and $tags of an object."""
        for name, kind in RESERVED.items():
            if name in value and not isinstance(value[name], kind):
                self.out.issues.append(Issue("reserved-member-type", at, name))
        name = value.get("$anchor")
        if isinstance(name, str):
            self.anchor(name, "explicit", at)
        tags = value.get("$tags")
        if isinstance(tags, list):
            for i, t in enumerate(tags):
                if isinstance(t, str):
                    self.out.tags.append({"at": at, "tag": t, "position": i})
                    if not ANCHOR_NAME.match(t):
                        self.out.issues.append(Issue("anchor-invalid", at, t))
                else:
                    self.out.issues.append(Issue("reserved-member-type", at, "$tags"))

    def anchor(self, name: str, kind: str, at: str, start: int | None = None, end: int | None = None) -> None:
        self.out.anchors.append({"name": name, "kind": kind, "at": at, "start": start, "end": end, "doc_order": self.order - 1})
        if kind != "derived" and not ANCHOR_NAME.match(name):
            self.out.issues.append(Issue("anchor-invalid", at, name))

    def plain(self, value: object, at: str, parent: str, step: str, depth: int) -> None:
        kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
        self.node(at, parent, step, kinds.get(type(value), "number"), value, depth)
        if isinstance(value, dict):
            if "$ref" in value:
                if len(value) == 1 and isinstance(value["$ref"], str):
                    self.out.refs.append({"at": at, "kind": "object", "raw": value["$ref"], "start": 0})
                else:
                    self.out.issues.append(Issue("ref-malformed", at))
            self.labelled(value, at)
            for name, item in value.items():
                self.plain(item, child(at, name), at, name, depth)
        elif isinstance(value, list):
            for i, item in enumerate(value):
                self.plain(item, child(at, i), at, str(i), depth)


def _prose_of(shredder: _Shredder, at: str, body: str) -> None:
    """References and block anchors of a body, in byte offsets into it."""
    found = prose(body, shredder.labels)
    ascii_ = body.isascii()
    byte = lambda i: i if ascii_ else len(body[:i].encode())
    here = child(at, "$body")
    for kind, raw, start in found.links:
        shredder.out.refs.append({"at": here, "kind": kind, "raw": raw, "start": byte(start)})
    for a in found.anchors:
        shredder.anchor(a.name, "block", here, byte(a.start), byte(a.end))
    for code, message in found.issues:
        shredder.out.issues.append(Issue(code, here, message))


def _from_data(out: Record, value: dict, spans: dict[str, tuple[int, int]]) -> None:
    shredder = _Shredder(out, spans)
    bodies: list[tuple[str, str, str | None]] = []

    def collect(section: dict, at: str) -> None:
        body, title = section.get("$body"), section.get("$title")
        bodies.append((at, body if isinstance(body, str) else "", title if isinstance(title, str) else None))
        for i, s in enumerate(section["$sections"] if isinstance(section.get("$sections"), list) else []):
            if isinstance(s, dict):
                collect(s, f"{at}/$sections/{i}")

    collect(value, "")
    try:
        for _, body, _ in bodies:
            for label, target in definitions(read_blocks(split_lines(body))).items():
                shredder.labels.setdefault(label, target)
        shredder.section(value, "", None, 0, None)
        for at, body, title in bodies:
            if title:
                for x in read_inline(title, shredder.labels).links:
                    if x.label is None:
                        out.refs.append({"at": child(at, "$title"), "kind": "image" if x.image else "link", "raw": x.destination, "start": x.start})
            if body:
                _prose_of(shredder, at, body)
    except (LimitError, ValueError, RecursionError) as e:
        out.issues.append(Issue("syntax-error", "", str(e)))
    out.value = value


def _from_markdown(out: Record, text: str, bom: int) -> None:
    try:
        _shred_markdown(out, text, bom)
    except (LimitError, ValueError, RecursionError) as e:
        out.issues.append(Issue("syntax-error", "", str(e)))


def _shred_markdown(out: Record, text: str, bom: int) -> None:
    reader = read_markdown(re.sub(r"\r\n?", "\n", text), bom)
    out.issues += reader.issues
    if any(i.code == "syntax-error" for i in out.issues):
        return
    byte = reader.byte
    spans: dict[str, tuple[int, int]] = {}

    def collect(s: Section) -> None:
        spans[s.at] = (byte(s.start), byte(s.end))
        if s.body is not None:
            spans[child(s.at, "$body")] = (byte(s.body_at), byte(s.body_at + len(s.body)))
        for c in s.sections:
            collect(c)

    collect(reader.root)
    shredder = _Shredder(out, spans)
    shredder.labels = reader.labels
    value = reader.root.value()
    shredder.section(value, "", None, 0, None)
    headed = [s for s in reader.all if s.heading is not None]
    slugs = [slug(s.visible) for s in headed]
    order = {n["at"]: n["doc_order"] for n in out.nodes}
    for s, base, name in zip(headed, slugs, repeats(slugs), strict=True):
        if base:
            out.anchors.append({"name": name, "kind": "derived", "at": s.at, "start": None, "end": None, "doc_order": order[s.at]})
    levels = sum(1 for s in reader.blocks if s.kind == "heading" and s.level == 1)
    if levels > 1:
        out.issues.append(Issue("multiple-h1"))
    for s in reader.all:
        for kind, raw, start in s.title_links:
            out.refs.append({"at": child(s.at, "$title"), "kind": kind, "raw": raw, "start": start})
        if s.body is not None:
            _prose_of(shredder, s.at, s.body)
    out.value = value


def leaves(value: object, at: str = "", exact: str = "") -> list[tuple[str, dict]]:
    """(path, leaf) of every value by semantic and by exact path; an array also gives its items under its own path."""
    out: list[tuple[str, dict]] = []
    if isinstance(value, dict):
        if at:
            out.append((at, {"kind": "object"}))
        for name, item in value.items():
            if name == "$sections":
                continue
            out += leaves(item, f"{at}/{name}" if at else name, child(exact, name))
        return out
    if isinstance(value, list):
        for i, item in enumerate(value):
            inner = leaves(item, f"{at}/{i}", child(exact, i))
            out += inner
            if not isinstance(item, (dict, list)):
                out.append((at, inner[0][1]))
        return out or [(at, {"kind": "array"})]
    leaf = {"kind": "null"}
    if isinstance(value, bool):
        leaf = {"kind": "boolean", "flag": value}
    elif isinstance(value, (int, float)):
        leaf = {"kind": "number", "num": float(value)}
    elif isinstance(value, str):
        leaf = {"kind": "string", "str": value}
    return [(at, leaf), (exact, leaf)]


def strings(value: object) -> list[str]:
    """Every string in a value, at any depth."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for v in value.values() for s in strings(v)]
    return [s for v in value for s in strings(v)] if isinstance(value, list) else []


def candidates(record: Record, inherit: bool = True) -> list[dict]:
    """Search candidates of a record: its root (target records) and every section (target nodes), with their values.

    A section's values include what its ancestors have and it lacks, nearest first. Without `inherit` they are its own, so that
    all candidates together are no larger than the record, and `above` is the place of its parent among them.
    """
    if record.value is None:
        return []
    ways: dict[str, list[dict]] = {}
    for a in record.anchors:
        ways.setdefault(a["at"], []).append({"name": a["name"], "kind": a["kind"]})
    sections: dict[str | None, list[dict]] = {}
    for n in record.nodes:
        if n["kind"] == "section":
            sections.setdefault(n["parent"], []).append(n)
    out = []

    def own(section: dict, at: str) -> dict[str, list[dict]]:
        held: dict[str, list[dict]] = {}
        for path, leaf in leaves(section):
            held.setdefault(path, []).append(leaf)
        for n in sections.get(at, []):
            if n["key"]:
                held.setdefault(n["key"], []).append({"kind": "string", "str": n["body"] or ""})
        return held

    def visit(row: dict, inherited: dict, above: int | None) -> None:
        at = row["at"]
        section = pointer(record.value, at)
        values = {**inherited, **own(section, at)}
        here = len(out)
        out.append({
            "at": at, "depth": row["depth"], "key": row["key"], "title": row["title"], "body": row["body"], "doc_order": row["doc_order"], "tags": section.get("$tags") or [],
            "anchors": ways.get(at, []), "above": above, "values": values, "strings": strings(record.value) if at == "" else [], "size": len(jcs(section).encode()),
        })
        for n in sections.get(at, []):
            visit(n, values if inherit else {}, here)

    visit(sections[None][0], {}, None)
    return out
