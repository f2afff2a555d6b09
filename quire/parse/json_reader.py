"""Strict JSON with byte offsets: duplicate members, lone surrogates, depth and number limits are issues."""

from __future__ import annotations

import re

from .values import MAX_DEPTH, Issue, Parsed, child, read_number

WHITE = re.compile(r"[ \t\n\r]*")
COMMENT = re.compile(r"(?:[ \t\n\r]|//[^\n\r]*|/\*.*?\*/)*", re.S)
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
WORDS = {"true": True, "false": False, "null": None}


class _Stop(Exception):
    def __init__(self, message: str, at: int) -> None:
        self.message, self.at = message, at


class JsonReader:
    """One unit of text; base is the byte offset at which it starts in its file."""

    def __init__(self, text: str, base: int = 0, comments: bool = False) -> None:
        self.text, self.base, self.at = text, base, 0
        self.white = COMMENT if comments else WHITE
        self.out = Parsed()
        self._bytes = text.isascii()

    def byte(self, at: int) -> int:
        return self.base + (at if self._bytes else len(self.text[:at].encode("utf-8", "surrogatepass")))

    def read(self) -> Parsed:
        try:
            self._skip()
            self.out.value = self._value("", 1)
            self._skip()
            if self.at < len(self.text):
                raise _Stop("text after the value", self.at)
        except _Stop as e:
            self.out.issues = [Issue("syntax-error", "", e.message, self.byte(e.at))]
            self.out.value = None
        return self.out

    def _skip(self) -> None:
        self.at = self.white.match(self.text, self.at).end()

    def _value(self, at: str, depth: int) -> object:
        start = self.at
        c = self.text[start : start + 1]
        if c in "{[" and c and depth > MAX_DEPTH:
            raise _Stop("nested too deeply", start)
        if c == "{":
            value = self._object(at, depth)
        elif c == "[":
            value = self._array(at, depth)
        elif c == '"':
            value = self._string(at)
        else:
            value = self._scalar(at)
        self.out.spans[at] = (self.byte(start), self.byte(self.at))
        return value

    def _scalar(self, at: str) -> object:
        for word, value in WORDS.items():
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return value
        found = NUMBER.match(self.text, self.at)
        if not found:
            raise _Stop("a value is expected", self.at)
        value, why = read_number(found[0], found[1] is None and found[2] is None)
        if value is None:
            self.out.issues.append(Issue("number-not-representable", at, why, self.byte(self.at)))
        self.at = found.end()
        return value

    def _string(self, at: str) -> str:
        start = self.at
        self.at += 1
        parts = []
        while True:
            found = PLAIN.match(self.text, self.at)
            parts.append(found[0])
            self.at = found.end()
            c = self.text[self.at : self.at + 1]
            if c == '"':
                self.at += 1
                break
            if c != "\\":
                raise _Stop("a string is not closed" if not c else "a control character in a string", self.at)
            e = self.text[self.at + 1 : self.at + 2]
            if e == "u":
                code = self.text[self.at + 2 : self.at + 6]
                if not re.fullmatch("[0-9A-Fa-f]{4}", code):
                    raise _Stop("a malformed escape", self.at)
                parts.append(chr(int(code, 16)))
                self.at += 6
            elif e in ESCAPES and e:
                parts.append(ESCAPES[e])
                self.at += 2
            else:
                raise _Stop("an unknown escape", self.at)
        text = "".join(parts)
        if re.search("[\ud800-\udfff]", text):
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not re.search("(?<![\ud800-\udbff])[\udc00-\udfff]|[\ud800-\udbff](?![\udc00-\udfff])", text) else text
        if re.search("[\ud800-\udfff]", text):
            self.out.issues.append(Issue("unpaired-surrogate", at, "", self.byte(start)))
            text = re.sub("[\ud800-\udfff]", "�", text)
        return text

    def _object(self, at: str, depth: int) -> dict:
        self.at += 1
        out: dict = {}
        self._skip()
        if self.text[self.at : self.at + 1] == "}":
            self.at += 1
            return out
        while True:
            self._skip()
            if self.text[self.at : self.at + 1] != '"':
                raise _Stop("a member name is expected", self.at)
            start = self.at
            name = self._string(at)
            self._skip()
            if self.text[self.at : self.at + 1] != ":":
                raise _Stop(": is expected", self.at)
            self.at += 1
            self._skip()
            if name in out:
                self.out.issues.append(Issue("duplicate-member", at, name, self.byte(start)))
                JsonReader._value(_Quiet(self), "", depth + 1)
            else:
                out[name] = self._value(child(at, name), depth + 1)
            self._skip()
            c = self.text[self.at : self.at + 1]
            self.at += 1
            if c == "}":
                return out
            if c != ",":
                raise _Stop(", or } is expected", self.at - 1)

    def _array(self, at: str, depth: int) -> list:
        self.at += 1
        out: list = []
        self._skip()
        if self.text[self.at : self.at + 1] == "]":
            self.at += 1
            return out
        while True:
            self._skip()
            out.append(self._value(child(at, len(out)), depth + 1))
            self._skip()
            c = self.text[self.at : self.at + 1]
            self.at += 1
            if c == "]":
                return out
            if c != ",":
                raise _Stop(", or ] is expected", self.at - 1)


class _Quiet(JsonReader):
    """Reads the value of a repeated member: it moves its owner on and keeps nothing of what it reads."""

    def __init__(self, owner: JsonReader) -> None:
        self.__dict__ |= {"owner": owner, "text": owner.text, "base": owner.base, "white": owner.white, "_bytes": owner._bytes, "out": Parsed()}

    @property
    def at(self) -> int:
        return self.owner.at

    @at.setter
    def at(self, value: int) -> None:
        self.owner.at = value


def read_json(text: str, base: int = 0, comments: bool = False) -> Parsed:
    """A JSON (or, with comments, JSONC) unit."""
    return JsonReader(text, base, comments).read()
