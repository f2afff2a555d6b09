"""Inline Markdown: visible text, links, images and raw HTML of one block's text, with offsets into it."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field

MAX_RUNS = 4096
MAX_NESTING = 256
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
TAG = re.compile(r"<(?:/[A-Za-z][A-Za-z0-9-]*\s*|[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?)>|<!---->|<!--(?!>|->).*?-->|<\?.*?\?>|<![A-Z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S | re.A)
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
TICKS = re.compile(r"`+")
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){1,999})\]", re.S)
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class LimitError(ValueError):
    """Text beyond the limits of a block."""


@dataclass
class Link:
    """A link or image; start and end are offsets into the text, destination is as a reader follows it."""

    image: bool
    destination: str
    start: int
    end: int
    label: str | None = None


@dataclass
class Inline:
    visible: str = ""
    links: list[Link] = field(default_factory=list)
    #: (start, end, source, direct): raw HTML and whether no emphasis or link is around it.
    tags: list[tuple[int, int, str, bool]] = field(default_factory=list)


@dataclass
class _Piece:
    """text shows; a run of delimiters has a mark and how much of it is left."""

    text: str
    at: int
    mark: str = ""
    left: int = 0
    opens: bool = False
    closes: bool = False


def fold_label(label: str) -> str:
    return re.sub(r"\s+", " ", label.strip()).casefold()


def unescape(text: str) -> str:
    """Backslash escapes and character references decoded."""
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: f"\0{ord(m[1]):x};", text)
    text = ENTITY.sub(lambda m: html.unescape(m[0]), text)
    return re.sub("\0([0-9a-f]+);", lambda m: chr(int(m[1], 16)), text)


def destination(text: str, at: int) -> tuple[str, int] | None:
    """An inline link's (destination "title") from the parenthesis at `at`: what it names, and the offset after it."""
    i = re.compile(r"\(\s*").match(text, at).end()
    if text[i : i + 1] == "<":
        found = re.compile(r"<((?:[^<>\\\n]|\\.)*)>").match(text, i)
        if not found:
            return None
        dest, i = found[1], found.end()
    else:
        depth, start = 0, i
        while i < len(text) and not text[i].isspace() and text[i] > "\x1f":
            if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in PUNCTUATION:
                i += 1
            elif text[i] == "(":
                depth += 1
            elif text[i] == ")":
                if not depth:
                    break
                depth -= 1
            i += 1
        if depth:
            return None
        dest = text[start:i]
    title = re.compile(r"""(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""", re.S).match(text, i)
    return (unescape(dest), title.end()) if title else None


class InlineReader:
    def __init__(self, text: str, labels: dict[str, str]) -> None:
        self.text, self.labels = text, labels
        self.out = Inline()
        self.pieces: list[_Piece] = []
        #: Open brackets: (piece index, offset, image, active)
        self.brackets: list[list] = []
        self.runs = 0

    def add(self, text: str, at: int) -> None:
        self.pieces.append(_Piece(text, at))

    def read(self) -> Inline:
        text, i, n = self.text, 0, len(self.text)
        while i < n:
            c = text[i]
            if c == "\\":
                nxt = text[i + 1 : i + 2]
                self.add(nxt if nxt and nxt in PUNCTUATION else ("\n" if nxt == "\n" else "\\" + nxt), i)
                i += 2
            elif c == "`":
                ticks = TICKS.match(text, i)[0]
                close = re.compile(rf"(?<!`){ticks}(?!`)").search(text, i + len(ticks))
                if close:
                    code = text[i + len(ticks) : close.start()].replace("\n", " ")
                    self.add(code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code, i)
                    i = close.end()
                else:
                    self.add(ticks, i)
                    i += len(ticks)
            elif c == "<":
                i = self._angle(i)
            elif c in "*_~":
                i = self._run(i)
            elif c == "[" or text.startswith("![", i):
                image = c == "!"
                self.brackets.append([len(self.pieces), i, image, True])
                self.add("![" if image else "[", i)
                i += 2 if image else 1
            elif c == "]":
                i = self._close(i)
            elif c == "&" and (m := ENTITY.match(text, i)):
                self.add(html.unescape(m[0]), i)
                i = m.end()
            else:
                m = re.compile(r"[^\\`<*_~\[\]!&]+|.", re.S).match(text, i)
                self.add(m[0], i)
                i = m.end()
        self._emphasis(0)
        self.out.visible = re.sub(r" *\n *", "\n", "".join(p.text for p in self.pieces))
        self.out.links.sort(key=lambda x: x.start)
        return self.out

    def _angle(self, i: int) -> int:
        m = AUTOLINK.match(self.text, i)
        if m:
            uri = m[1] if re.match(r"[A-Za-z][A-Za-z0-9+.-]{1,31}:", m[1]) else "mailto:" + m[1]
            self.out.links.append(Link(False, uri, i, m.end()))
            self.add(m[1], i)
            return m.end()
        m = TAG.match(self.text, i)
        if m:
            self.out.tags.append((i, m.end(), m[0], not any(b[3] for b in self.brackets)))
            return m.end()
        self.add("<", i)
        return i + 1

    def _run(self, i: int) -> int:
        c, end = self.text[i], i
        while end < len(self.text) and self.text[end] == c:
            end += 1
        self.runs += 1
        if self.runs > MAX_RUNS:
            raise LimitError("too many emphasis runs")
        before, after = self.text[i - 1 : i] or " ", self.text[end : end + 1] or " "
        punct = lambda ch: unicodedata.category(ch)[0] in "PS"
        left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
        right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
        opens = left and (c != "_" or not right or punct(before))
        closes = right and (c != "_" or not left or punct(after))
        if c == "~" and end - i > 2:
            opens = closes = False
        self.pieces.append(_Piece(c * (end - i), i, c, end - i, opens, closes))
        return end

    def _close(self, i: int) -> int:
        if not self.brackets:
            self.add("]", i)
            return i + 1
        index, start, image, active = self.brackets.pop()
        inner = self.text[start + (2 if image else 1) : i]
        found, label = None, None
        if active or image:
            if self.text[i + 1 : i + 2] == "(":
                found = destination(self.text, i + 1)
            if not found:
                m = LABEL.match(self.text, i + 1)
                short = not m and self.text[i + 1 : i + 3] != "[]"
                label = m[1] if m else inner
                held = self.labels.get(fold_label(label))
                if held is not None:
                    found = (held, m.end() if m else i + (1 if short else 3))
                else:
                    label = None
        if not found:
            self.add("]", i)
            return i + 1
        if len(self.brackets) > MAX_NESTING:
            raise LimitError("links are nested too deeply")
        self.out.links.append(Link(image, found[0], start, found[1], label))
        self._emphasis(index + 1)
        if image:
            del self.pieces[index:]
        else:
            self.pieces[index].text = ""
            for b in self.brackets:
                if not b[2]:
                    b[3] = False
        return found[1]

    def _emphasis(self, bottom: int) -> None:
        """Matches closing runs with the nearest opening ones and takes the matched delimiters out of the text."""
        openers: list[int] = []
        for j in range(bottom, len(self.pieces)):
            p = self.pieces[j]
            if not p.mark:
                continue
            while p.closes and p.left:
                k = next((k for k in reversed(openers) if self._fits(self.pieces[k], p)), None)
                if k is None:
                    break
                o = self.pieces[k]
                used = p.left if p.mark == "~" else (2 if o.left >= 2 and p.left >= 2 else 1)
                for q in (o, p):
                    q.left -= used
                    q.text = q.mark * q.left
                del openers[openers.index(k) + 1 :]
                if not o.left:
                    openers.remove(k)
            if p.opens and p.left:
                openers.append(j)
            if len(openers) > MAX_NESTING:
                raise LimitError("emphasis is nested too deeply")
        for p in self.pieces[bottom:]:
            p.mark = ""

    @staticmethod
    def _fits(o: _Piece, p: _Piece) -> bool:
        if o.mark != p.mark or not o.left:
            return False
        if p.mark == "~":
            return o.left == p.left
        return not ((o.closes or p.opens) and (o.left + p.left) % 3 == 0 and (o.left % 3 or p.left % 3))


def read_inline(text: str, labels: dict[str, str] | None = None) -> Inline:
    """The inline content of a block; labels are the link reference definitions in scope."""
    return InlineReader(text, labels or {}).read()
