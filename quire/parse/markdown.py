"""Markdown records: front matter, sections, data blocks, bodies, anchors and references."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .blocks import Block, Line, inline_text, read_blocks, source_offset, split_lines, walk
from .inline import LimitError, read_inline
from .json_reader import read_json
from .values import Issue, Parsed
from .yaml_reader import read_yaml

DELIMITER = re.compile(r"---[ \t]*$")
ANCHOR = re.compile(r"<a((?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*)\s*>", re.I)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w.:-]*)(?:\s*=\s*([^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?")
ANCHOR_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]*\Z")
DATA = {"yaml", "json", "jsonc"}
SECTION_MEMBERS = ("$title", "$anchor", "$tags", "$body", "$sections")
#: Inline elements whose text counts as heading text without a warning. Fixed values.
HEADING_HTML = {"span", "b", "i", "em", "strong", "code", "kbd", "sup", "sub", "a"}


@dataclass
class BlockAnchor:
    """A named paragraph or list item; start and end are offsets into the body."""

    name: str
    start: int
    end: int


@dataclass
class Prose:
    """A body's references and block anchors, with offsets into the body."""

    links: list = field(default_factory=list)
    anchors: list[BlockAnchor] = field(default_factory=list)
    issues: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Section:
    level: int
    heading: Block | None
    title: str | None = None
    visible: str = ""
    anchor: str | None = None
    tags: list[str] = field(default_factory=list)
    data: dict = field(default_factory=dict)
    body: str | None = None
    body_at: int = 0
    start: int = 0
    end: int = 0
    sections: list[Section] = field(default_factory=list)
    title_links: list = field(default_factory=list)
    at: str = ""

    def value(self) -> dict:
        out: dict = {}
        if self.title is not None:
            out["$title"] = self.title
        if self.anchor is not None:
            out["$anchor"] = self.anchor
        if self.tags:
            out["$tags"] = self.tags
        out |= self.data
        if self.body is not None:
            out["$body"] = self.body
        if self.sections:
            out["$sections"] = [s.value() for s in self.sections]
        return out


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("'\"") for m in ATTRIBUTE.finditer(source)}


def anchor_element(tag: str) -> dict[str, str] | None:
    """The id and class of an opening <a> that has one, with every other attribute under `other`."""
    m = ANCHOR.fullmatch(tag)
    if not m:
        return None
    held = attributes(m[1])
    if not {"id", "class"} & held.keys():
        return None
    out = {k: v for k, v in held.items() if k in ("id", "class")}
    return out | ({"other": "1"} if held.keys() - {"id", "class"} else {})


def definitions(blocks: list[Block]) -> dict[str, str]:
    """Link reference definitions of the blocks, the first of each label."""
    out: dict[str, str] = {}
    for b, _ in walk(blocks):
        if b.kind == "definition":
            out.setdefault(b.label, b.target)
    return out


def prose(body: str, labels: dict[str, str], blocks: list[Block] | None = None) -> Prose:
    """References and block anchors of a body."""
    out = Prose()
    for b, quoted in walk(read_blocks(split_lines(body)) if blocks is None else blocks):
        if b.kind == "definition":
            out.links.append(("definition", b.target, b.start))
        elif b.kind in ("paragraph", "heading"):
            text, marks = inline_text(b)
            found = read_inline(text, labels)
            for x in found.links:
                if x.label is None:
                    out.links.append(("image" if x.image else "link", x.destination, source_offset(marks, x.start)))
            if b.kind == "paragraph" and not quoted:
                first = next((t for t in found.tags if t[0] == 0), None)
                held = anchor_element(first[2]) if first else None
                if held and text.startswith("</a>", first[1]):
                    if "class" in held:
                        out.issues.append(("block-anchor-class", held.get("id", "")))
                    if "id" in held:
                        out.anchors.append(BlockAnchor(held["id"], b.start + len(b.lines[0].text) - len(b.lines[0].text.lstrip()), b.end))
    _widen(out, body)
    out.links.sort(key=lambda x: x[2])
    return out


def _widen(found: Prose, body: str) -> None:
    """An anchor at the start of a list item names the item, from its marker on."""
    for a in found.anchors:
        line = body.rfind("\n", 0, a.start) + 1
        m = re.compile(r"(?:[ \t]*(?:[-+*]|\d{1,9}[.)])[ \t]+)+").match(body, line)
        if m and m.end() >= a.start:
            a.start = line + len(body[line:]) - len(body[line:].lstrip(" \t"))


class MarkdownReader:
    def __init__(self, text: str, bom: int = 0) -> None:
        self.text, self.bom = text, bom
        self.issues: list[Issue] = []
        self.root = Section(0, None)
        self.blocks: list[Block] = []
        self.labels: dict[str, str] = {}
        self.all: list[Section] = []
        self._ascii = text.isascii()

    def byte(self, at: int) -> int:
        return self.bom + (at if self._ascii else len(self.text[:at].encode()))

    def issue(self, code: str, section: Section | None, message: str = "", at: int = 0) -> None:
        self.issues.append(Issue(code, (section or self.root).at, message, self.byte(at)))

    def read(self) -> MarkdownReader:
        lines = split_lines(self.text)
        lines = self._front_matter(lines)
        try:
            self.blocks = read_blocks(lines)
            self.labels = definitions(self.blocks)
            self._sections()
        except (LimitError, ValueError, RecursionError) as e:
            self.issues.append(Issue("syntax-error", "", str(e), 0))
        return self

    def _front_matter(self, lines: list[Line]) -> list[Line]:
        if not lines or not DELIMITER.match(lines[0].text):
            return lines
        end = next((i for i in range(1, len(lines)) if DELIMITER.match(lines[i].text)), None)
        if end is None:
            self.issue("syntax-error", None, "front matter is not closed")
            return []
        start = lines[1].at if end > 1 else lines[0].at
        self._take(self.root, read_yaml(self.text[start : lines[end].at] if end > 1 else "", self.byte(start)), root=True)
        return lines[end + 1 :]

    def _take(self, section: Section, unit: Parsed, root: bool = False) -> None:
        """A unit's members become the section's fields."""
        for i in unit.issues:
            i.at = section.at + i.at
            self.issues.append(i)
        if unit.issues and unit.value is None:
            return
        if not isinstance(unit.value, dict):
            self.issue("data-block-not-object", section)
            return
        for name, value in unit.value.items():
            if name.startswith("$") and not (root and name == "$schema"):
                known = name in SECTION_MEMBERS or name in ("$key", "$schema")
                self.issue("dollar-member" if known else "feature-unsupported", section, name)
            else:
                section.data[name] = value

    def _sections(self) -> None:
        top = self.blocks
        first = next((b for b in top if not self._comment(b)), None)
        h1 = [b for b in top if b.kind == "heading" and b.level == 1]
        title = h1[0] if len(h1) == 1 and first is h1[0] else None
        stack = [self.root]
        last = self.root
        bodies: dict[int, list[Block]] = {id(self.root): []}
        self.all = [self.root]
        for b in top:
            if b.kind != "heading":
                bodies[id(last)].append(b)
                continue
            if b is title:
                self.root.heading = b
                continue
            while stack[-1].level >= b.level:
                stack.pop()
            s = Section(b.level, b, start=b.start)
            s.at = f"{stack[-1].at}/$sections/{len(stack[-1].sections)}"
            stack[-1].sections.append(s)
            stack.append(s)
            bodies[id(s)] = []
            self.all.append(s)
            last = s
        ends = [s.start for s in self.all[1:]] + [len(self.text)]
        for s, end in zip(self.all, ends, strict=True):
            if s.heading is not None:
                self._heading(s)
            blocks = self._data_block(s, bodies[id(s)])
            if blocks:
                start = blocks[0].lines[0].at
                raw = self.text[start:end].rstrip(" \t\n")
                if raw.strip(" \t\n"):
                    s.body, s.body_at = raw, start
        self._ends(self.root, len(self.text))

    def _ends(self, section: Section, end: int) -> None:
        section.end = end
        starts = [s.start for s in section.sections[1:]] + [end]
        for s, e in zip(section.sections, starts, strict=False):
            self._ends(s, e)

    @staticmethod
    def _comment(b: Block) -> bool:
        return b.kind == "html" and re.fullmatch(r"\s*(?:<!--.*?-->\s*)+", "\n".join(x.text for x in b.lines), re.S) is not None

    def _heading(self, s: Section) -> None:
        text, marks = inline_text(s.heading)
        found = read_inline(text, self.labels)
        cuts, seen = [], 0
        for start, end, tag, direct in found.tags:
            held = anchor_element(tag)
            if held is None:
                name = re.match(r"</?([A-Za-z0-9-]+)", tag)
                if not name or name[1].lower() not in HEADING_HTML:
                    pass
                continue
            close = "</a>" if text[end : end + 4].lower() == "</a>" else None
            seen += 1
            if not close or "other" in held or not direct or seen > 1:
                self.issue("anchor-element-invalid", s, tag, source_offset(marks, start))
                continue
            cuts.append((start, end + 4))
            if "id" in held:
                s.anchor = held["id"]
            s.tags = list(dict.fromkeys(held.get("class", "").split()))
        shown = text
        for start, end in reversed(cuts):
            shown = shown[:start] + shown[end:]
        s.title = shown.strip(" \t\n")
        s.visible = read_inline(s.title, self.labels).visible
        s.title_links = [("image" if x.image else "link", x.destination, x.start) for x in found.links if x.label is None]

    def _data_block(self, s: Section, blocks: list[Block]) -> list[Block]:
        """Reads the data block at the start of a section's blocks; returns the rest."""
        place = [b for b in blocks if not (s is self.root and s.heading is None and self._comment(b))]
        if not place or place[0].kind != "fence":
            return blocks
        words = place[0].info.split()
        if len(words) < 2 or words[1] != "data":
            return blocks
        if words[0] not in DATA or len(words) > 2:
            self.issue("feature-unsupported", s, place[0].info, place[0].start)
            return blocks
        if s is self.root:
            self.issue("data-block-misplaced", s, "", place[0].start)
            return blocks
        fence = place[0]
        if not fence.closed:
            self.issue("syntax-error", s, "a data block is not closed", fence.start)
            return []
        inner = fence.lines[1:-1]
        start = inner[0].at if inner else fence.end
        text = self.text[start : fence.lines[-1].at] if inner else ""
        if not text.strip():
            unit = Parsed(value={})
        else:
            unit = read_yaml(text, self.byte(start)) if words[0] == "yaml" else read_json(text, self.byte(start), words[0] == "jsonc")
        self._take(s, unit)
        rest = blocks[blocks.index(fence) + 1 :]
        if rest and rest[0].kind == "fence" and len(w := rest[0].info.split()) == 2 and w[1] == "data" and w[0] in DATA:
            self.issue("data-block-misplaced", s, "", rest[0].start)
        return rest


def read_markdown(text: str, bom: int = 0) -> MarkdownReader:
    """A Markdown record whose line breaks are LF."""
    return MarkdownReader(text, bom).read()
