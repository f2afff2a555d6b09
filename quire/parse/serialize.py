"""Writers of records: JSON, YAML with compatibility quoting, and Markdown where the value can be written as such."""

from __future__ import annotations

import json
import re

from .blocks import read_blocks, split_lines
from .markdown import ANCHOR_NAME, anchor_element
from .inline import TAG
from .values import canonical_number
from .yaml_reader import AMBIGUOUS, BOOL, FLOAT, INTEGER, NOT_FINITE, NULL

ORDER = ("$schema", "$title", "$anchor", "$tags", "$body", "$sections")


class NotRepresentable(ValueError):
    """A value that a format can't hold, with the exact path of the reason."""

    def __init__(self, at: str, why: str) -> None:
        super().__init__(f"{at or '/'}: {why}")
        self.at = at


def _members(value: dict) -> list[tuple[str, object]]:
    """Members in the order the writer uses: reserved ones around the fields."""
    first = [(k, value[k]) for k in ORDER[:4] if k in value]
    last = [(k, value[k]) for k in ORDER[4:] if k in value]
    return first + [(k, v) for k, v in value.items() if k not in ORDER] + last


def to_json(value: object, indent: int = 2) -> str:
    """JSON text with canonical numbers."""

    def write(v: object, pad: str) -> str:
        inner = pad + " " * indent
        if isinstance(v, dict):
            return "{" + ",".join(f"\n{inner}{json.dumps(k, ensure_ascii=False)}: {write(x, inner)}" for k, x in _members(v)) + (f"\n{pad}" if v else "") + "}"
        if isinstance(v, list):
            return "[" + ",".join(f"\n{inner}{write(x, inner)}" for x in v) + (f"\n{pad}" if v else "") + "]"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return canonical_number(float(v))
        return json.dumps(v, ensure_ascii=False)

    return write(value, "") + "\n"


def scalar(text: str, minimal: bool = False) -> str:
    """A YAML string: plain where every reader takes it for the same string, else in double quotes."""
    other = NULL.match(text) or text in BOOL or INTEGER.match(text) or FLOAT.match(text) or NOT_FINITE.match(text) or text == "<<"
    plain = re.fullmatch(r"[A-Za-z0-9_./$À-￼][^\x00-\x1f\x7f-\xa0﻿￾￿:#]*(?<! )", text) and not re.search(r"[\ud800-\udfff]|[,\[\]{}&*!|>'\"%@`]", text) and not text.startswith(("---", "..."))
    if plain and not other and (minimal or not AMBIGUOUS.match(text)):
        return text
    return json.dumps(text, ensure_ascii=not re.fullmatch(r"[\x20-\x7e\xa0-퟿-﻾！-�\U00010000-\U0010ffff]*", text))


def to_yaml(value: dict, minimal: bool = False) -> str:
    """YAML 1.2 text that a 1.1 reader takes for the same value."""

    def write(v: object, pad: str) -> str:
        if isinstance(v, dict):
            if not v:
                return " {}\n"
            return "\n" + "".join(f"{pad}{scalar(k, minimal)}:{write(x, pad + '  ')}" for k, x in _members(v))
        if isinstance(v, list):
            return "\n" + "".join(f"{pad}-{item(x, pad)}" for x in v) if v else " []\n"
        if isinstance(v, str):
            return f" {scalar(v, minimal)}\n"
        if v is None or isinstance(v, bool):
            return f" {json.dumps(v)}\n"
        return f" {canonical_number(float(v))}\n"

    def item(v: object, pad: str) -> str:
        if isinstance(v, (dict, list)) and v:
            return write(v, pad + "  ")
        return write(v, pad)

    return write(value, "").lstrip("\n ") if value else "{}\n"


def representable(value: dict, at: str = "", level: int = 0) -> None:
    """Raises NotRepresentable for a value that Markdown can't hold."""
    title, body = value.get("$title"), value.get("$body")
    if at and not title:
        raise NotRepresentable(at, "a section without a title")
    if title is not None:
        if "\n" in title or title != title.strip() or re.fullmatch("#+", title) or re.search(r"(?:^|[ \t])#+$", title) or not title:
            raise NotRepresentable(f"{at}/$title", "not readable as a heading")
        if any(anchor_element(m[0]) for m in TAG.finditer(title)):
            raise NotRepresentable(f"{at}/$title", "holds an anchor element")
    elif {"$anchor", "$tags"} & value.keys():
        raise NotRepresentable(at, "an anchor or tags without a title")
    for name in [value["$anchor"]] if "$anchor" in value else []:
        if not ANCHOR_NAME.match(name):
            raise NotRepresentable(f"{at}/$anchor", "not an anchor name")
    if body is not None:
        if not body or body != body.rstrip(" \t\n") or re.match(r"[ \t]*\n", body):
            raise NotRepresentable(f"{at}/$body", "empty, or blank at an end")
        blocks = read_blocks(split_lines(body))
        if any(b.kind == "heading" for b in blocks):
            raise NotRepresentable(f"{at}/$body", "holds a heading")
        if blocks and blocks[0].kind == "fence" and blocks[0].info.split()[1:2] == ["data"]:
            raise NotRepresentable(f"{at}/$body", "begins with a data block")
    if level > 5:
        raise NotRepresentable(at, "sections are nested too deeply")
    for i, s in enumerate(value.get("$sections") or []):
        representable(s, f"{at}/$sections/{i}", level + 1)


def to_markdown(value: dict) -> str:
    """A Markdown record that reads back as the value; NotRepresentable if there is none."""
    representable(value)
    deepest = _depth(value)
    # Without a title, sections start at level two, as a lone first heading of level one would be read as the title.
    base = 1 if "$title" in value or deepest < 6 else 0
    lone = base == 0 and len(value["$sections"]) == 1 and "$body" not in value
    if base + deepest > 6 or lone:
        raise NotRepresentable("", "sections are nested too deeply")
    front = {k: v for k, v in value.items() if not k.startswith("$") or k == "$schema"}
    out = f"---\n{to_yaml(front)}---\n" if front else ""
    body = value.get("$body", "")
    if not front and "$title" not in value and re.match(r"---[ \t]*(\n|$)", body):
        out = "---\n---\n"

    def heading(v: dict, level: int) -> str:
        tags = f' class="{" ".join(v["$tags"])}"' if v.get("$tags") else ""
        name = f' id="{v["$anchor"]}"' if "$anchor" in v else ""
        mark = f"<a{name}{tags}></a>" if name or tags else ""
        return f"{'#' * level} {v['$title']}{mark}\n"

    def section(v: dict, level: int) -> str:
        fields = {k: x for k, x in v.items() if not k.startswith("$")}
        text = "\n" + heading(v, level)
        if fields:
            text += f"\n```yaml data\n{to_yaml(fields)}```\n"
        if "$body" in v:
            text += f"\n{v['$body']}\n"
        return text + "".join(section(s, level + 1) for s in v.get("$sections") or [])

    if "$title" in value:
        out += ("\n" if out else "") + heading(value, 1)
    if body:
        out += ("\n" if out else "") + body + "\n"
    return out + "".join(section(s, base + 1) for s in value.get("$sections") or [])


def _depth(value: dict) -> int:
    return max((1 + _depth(s) for s in value.get("$sections") or []), default=0)
