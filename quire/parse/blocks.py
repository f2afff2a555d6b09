"""Block structure of Markdown: headings, paragraphs, code, HTML, quotes and lists, with offsets of their text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .inline import fold_label, unescape

MAX_CONTAINERS = 256
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})(.*)$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( +)|$|\t)")
HTML_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
#: Start and end conditions of HTML blocks; an end of None is a blank line.
HTML = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile("</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{HTML_TAGS})(?:\s|/?>|$)", re.I), None),
)
HTML_ALONE = re.compile(r" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$")
DEFINITION = re.compile(r"""[ ]{0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(?:<((?:[^<>\\\n]|\\.)*)>|([^\s<][^\s]*))(?:[ \t]*(?:[ \t]|\n[ \t]*)(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""", re.S)


@dataclass
class Line:
    """A line's text (without its break) and the offset of its first character."""

    at: int
    text: str

    def cut(self, n: int) -> Line:
        return Line(self.at + n, self.text[n:])


@dataclass
class Block:
    """kind is heading, paragraph, code, fence, html, rule, quote, item or definition."""

    kind: str
    lines: list[Line]
    level: int = 0
    info: str = ""
    closed: bool = True
    children: list[Block] = field(default_factory=list)
    label: str = ""
    target: str = ""

    @property
    def start(self) -> int:
        return self.lines[0].at

    @property
    def end(self) -> int:
        return self.lines[-1].at + len(self.lines[-1].text)


def split_lines(text: str) -> list[Line]:
    """Lines of a text whose breaks are LF."""
    out, at = [], 0
    for part in text.split("\n"):
        out.append(Line(at, part))
        at += len(part) + 1
    if out and not out[-1].text and text.endswith("\n"):
        out.pop()
    return out


def _indent(text: str) -> int:
    n = 0
    for c in text:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def interrupts(text: str) -> bool:
    """Whether a line ends a paragraph (so that it can't continue one lazily)."""
    item = ITEM.match(text)
    starts_item = item and text[item.end() :].strip() and (not item[2][:-1].isdigit() or item[2][:-1] == "1")
    return bool(marked_heading(text) or RULE.match(text) or FENCE.match(text) or QUOTE.match(text) or starts_item or any(s.match(text) for s, _ in HTML))


def _unindented(text: str) -> tuple[str, int] | None:
    """A line without its indent, and the indent; None if it is that of code."""
    bare = text.lstrip(" ")
    indent = len(text) - len(bare)
    return (bare, indent) if indent < 4 else None


def marked_heading(text: str) -> tuple[int, int, str] | None:
    """Level, start and content of a heading that number signs open (and may close)."""
    bare, indent = _unindented(text) or ("", 0)
    rest = bare.lstrip("#")
    level = len(bare) - len(rest)
    if level not in range(1, 7) or rest[:1] not in ("", " ", "\t"):
        return None
    content = rest.strip(" \t")
    opened = content.rstrip("#")
    if not opened or opened[-1] in " \t":
        content = opened.rstrip(" \t")
    start = indent + level + len(rest) - len(rest.lstrip(" \t"))
    return level, start if content else len(text), content


def underlines(text: str) -> bool:
    """Whether a line makes a heading of the paragraph above: one run of = or of -."""
    bare, _ = _unindented(text) or ("", 0)
    marks = bare.rstrip(" \t")
    return marks != "" and marks in ("=" * len(marks), "-" * len(marks))


def read_blocks(lines: list[Line], depth: int = 0) -> list[Block]:
    """Blocks of a run of lines; containers are read again within."""
    if depth > MAX_CONTAINERS:
        raise ValueError("containers are nested too deeply")
    out: list[Block] = []
    paragraph: list[Line] = []
    i = 0

    def close() -> None:
        nonlocal paragraph
        if paragraph:
            out.extend(_paragraph(paragraph))
            paragraph = []

    while i < len(lines):
        line = lines[i]
        text = line.text
        if not text.strip(" \t"):
            close()
            i += 1
            continue
        if _indent(text) >= 4:
            if paragraph:
                paragraph.append(line)
                i += 1
                continue
            j = i
            while j < len(lines) and (_indent(lines[j].text) >= 4 or not lines[j].text.strip(" \t")):
                j += 1
            while not lines[j - 1].text.strip(" \t"):
                j -= 1
            out.append(Block("code", lines[i:j]))
            i = j
            continue
        m = FENCE.match(text)
        if m:
            close()
            mark = m[2]
            end = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            j = i + 1
            while j < len(lines) and not end.match(lines[j].text):
                j += 1
            out.append(Block("fence", lines[i : j + 1], info=m[3].strip(" \t"), closed=j < len(lines)))
            i = j + 1
            continue
        marked = marked_heading(text)
        if marked:
            close()
            out.append(Block("heading", [line], level=marked[0]))
            i += 1
            continue
        if paragraph and underlines(text):
            held = _paragraph(paragraph)
            if held and held[-1].kind == "paragraph":
                out.extend(held[:-1])
                out.append(Block("heading", [*held[-1].lines, line], level=1 if "=" in text else 2, info="setext"))
                paragraph = []
                i += 1
                continue
        if RULE.match(text):
            close()
            out.append(Block("rule", [line]))
            i += 1
            continue
        if QUOTE.match(text):
            close()
            j, inner = i, []
            while j < len(lines):
                q = QUOTE.match(lines[j].text)
                if q:
                    inner.append(lines[j].cut(q.end()))
                elif lines[j].text.strip() and inner and inner[-1].text.strip() and not interrupts(lines[j].text) and not FENCE.match(inner[-1].text):
                    inner.append(lines[j])
                else:
                    break
                j += 1
            out.append(Block("quote", lines[i:j], children=read_blocks(inner, depth + 1)))
            i = j
            continue
        m = ITEM.match(text)
        if m and (not paragraph or interrupts(text)):
            close()
            i = _item(lines, i, m, out, depth)
            continue
        ends = next((end for start, end in HTML if start.match(text)), False)
        if ends is False and not paragraph and HTML_ALONE.match(text):
            ends = None
        if ends is not False:
            close()
            j = i
            while j < len(lines):
                if ends is None and not lines[j].text.strip():
                    break
                j += 1
                if ends is not None and ends.search(lines[j - 1].text):
                    break
            out.append(Block("html", lines[i:j]))
            i = j
            continue
        paragraph.append(line)
        i += 1
    close()
    return out


def _item(lines: list[Line], i: int, m: re.Match, out: list[Block], depth: int) -> int:
    """One list item from line i; returns the line after it."""
    text = lines[i].text
    rest = text[m.end() :]
    spaces = len(m[3] or "")
    width = m.end() if rest.strip() and spaces <= 4 else len(m[1]) + len(m[2]) + 1
    inner = [lines[i].cut(min(width, len(text)))]
    j, blank = i + 1, not rest.strip()
    while j < len(lines):
        t = lines[j].text
        if not t.strip(" \t"):
            if blank and len(inner) == 1 and not inner[0].text.strip():
                break
            inner.append(Line(lines[j].at + len(t), ""))
            blank = True
        elif _indent(t) >= width:
            inner.append(lines[j].cut(min(width, len(t) - len(t.lstrip(" \t")))))
            blank = False
        elif not blank and not interrupts(t) and not ITEM.match(t):
            inner.append(lines[j].cut(len(t) - len(t.lstrip(" \t"))))
        else:
            break
        j += 1
    last = j
    while last > i + 1 and not lines[last - 1].text.strip(" \t"):
        last -= 1
    out.append(Block("item", lines[i:last], children=read_blocks(inner, depth + 1)))
    return j


def _paragraph(lines: list[Line]) -> list[Block]:
    """Leading link reference definitions, then the rest as a paragraph."""
    text = "\n".join(x.text for x in lines)
    out, at = [], 0
    while m := DEFINITION.match(text, at):
        first, last = text.count("\n", 0, m.start()), text.count("\n", 0, max(m.end() - 1, m.start()))
        target = unescape(m[2] if m[2] is not None else m[3])
        out.append(Block("definition", lines[first : last + 1], label=fold_label(m[1]), target=target))
        at = m.end()
    kept = lines[text.count("\n", 0, at) :] if at < len(text) else []
    if kept:
        out.append(Block("paragraph", kept))
    return out


def inline_text(block: Block) -> tuple[str, list[tuple[int, int]]]:
    """A paragraph's or heading's text with lines joined by LF, and (offset there, offset in the source) per line."""
    lines = block.lines
    if block.kind == "heading" and block.info != "setext":
        _, start, content = marked_heading(lines[0].text)
        return content, [(0, lines[0].at + start)]
    if block.kind == "heading":
        lines = lines[:-1]
    out, marks, at = [], [], 0
    for x in lines:
        cut = len(x.text) - len(x.text.lstrip(" \t"))
        marks.append((at, x.at + cut))
        t = x.text[cut:]
        out.append(t)
        at += len(t) + 1
    return "\n".join(out).rstrip(" \t"), marks


def source_offset(marks: list[tuple[int, int]], at: int) -> int:
    """The source offset of an offset into inline_text()."""
    here = max((m for m in marks if m[0] <= at), key=lambda m: m[0])
    return here[1] + at - here[0]


def walk(blocks: list[Block], quoted: bool = False):
    """Every block in document order with whether a quote is around it."""
    for b in blocks:
        yield b, quoted
        yield from walk(b.children, quoted or b.kind == "quote")
