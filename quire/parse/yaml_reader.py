"""YAML 1.2 (core schema) over PyYAML's composer, which gives nodes with marks; scalars are resolved here.

Anchors, aliases, explicit tags, merge keys, non-string keys, non-finite numbers and several documents are issues.
"""

from __future__ import annotations

import re

import yaml

from .values import MAX_DEPTH, Issue, Parsed, child, read_number

NULL = re.compile(r"(?:~|null|Null|NULL|)\Z")
BOOL = {w: v for v, words in ((True, ("true", "True", "TRUE")), (False, ("false", "False", "FALSE"))) for w in words}
INTEGER = re.compile(r"(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)\Z")
FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?\Z")
NOT_FINITE = re.compile(r"(?:[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))\Z")
#: Plain strings that a YAML 1.1 reader takes for something else.
AMBIGUOUS = re.compile(r"(?:[yYnN]|yes|Yes|YES|no|No|NO|on|On|ON|off|Off|OFF|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt ].*)?|[-+]?0b[01_]+|[-+]?[0-9][0-9_]*(?::[0-5]?[0-9])+(?:\.[0-9_]*)?|[-+]?[0-9]+_[0-9_]*(?:\.[0-9_]*)?|<<|=)\Z")


class _Loader(yaml.SafeLoader):
    """Composes only: no tag is resolved to a type, so plain scalars stay text."""

    yaml_implicit_resolvers: dict = {}


class _Walk:
    def __init__(self, text: str, base: int) -> None:
        self.text, self.base, self.out = text, base, Parsed()
        self.ascii = text.isascii()

    def byte(self, at: int) -> int:
        return self.base + (at if self.ascii else len(self.text[:at].encode()))

    def issue(self, code: str, at: str, node: yaml.Node, message: str = "") -> None:
        self.out.issues.append(Issue(code, at, message, self.byte(node.start_mark.index)))

    def value(self, node: yaml.Node, at: str, depth: int) -> object:
        self.out.spans[at] = (self.byte(node.start_mark.index), self.byte(node.end_mark.index))
        if isinstance(node, yaml.ScalarNode):
            return self.scalar(node, at)
        if depth > MAX_DEPTH:
            raise yaml.YAMLError("nested too deeply")
        if isinstance(node, yaml.SequenceNode):
            return [self.value(n, child(at, i), depth + 1) for i, n in enumerate(node.value)]
        out: dict = {}
        for key, item in node.value:
            if not isinstance(key, yaml.ScalarNode):
                self.issue("yaml-key", at, key, "a key that is not a string")
                continue
            name = key.value if key.style else self.scalar(key, at)
            if not key.style and key.value == "<<":
                self.issue("yaml-merge-key", at, key)
                continue
            if not isinstance(name, str):
                self.issue("yaml-key", at, key, key.value)
                continue
            if name in out:
                self.issue("duplicate-member", at, key, name)
                continue
            out[name] = self.value(item, child(at, name), depth + 1)
        return out

    def scalar(self, node: yaml.ScalarNode, at: str) -> object:
        text = node.value
        if node.style:
            return text
        if NULL.match(text):
            return None
        if text in BOOL:
            return BOOL[text]
        if NOT_FINITE.match(text):
            self.issue("number-not-finite", at, node, text)
            return None
        if INTEGER.match(text) or FLOAT.match(text):
            value, why = read_number(text if not re.match(r"[+-]?0[0-9]", text) else re.sub(r"^([+-]?)0+(?=[0-9])", r"\1", text), INTEGER.match(text) is not None)
            if value is None:
                self.issue("number-not-representable", at, node, why)
            return value
        return text


def _refused(text: str, walk: _Walk) -> None:
    """What the token stream has that records don't allow."""
    codes = {yaml.AnchorToken: "yaml-anchor", yaml.AliasToken: "yaml-anchor", yaml.TagToken: "yaml-tag"}
    for token in yaml.scan(text, Loader=_Loader):
        code = codes.get(type(token))
        if code:
            walk.out.issues.append(Issue(code, "", "", walk.byte(token.start_mark.index)))
        elif isinstance(token, yaml.DirectiveToken) and token.name == "YAML" and token.value != (1, 2):
            walk.out.issues.append(Issue("yaml-version-unsupported", "", "", walk.byte(token.start_mark.index)))


def read_yaml(text: str, base: int = 0) -> Parsed:
    """A YAML unit; nothing but white space and comments is the empty object."""
    text = re.sub(r"\r(?!\n)", "\n", text)
    walk = _Walk(text, base)
    try:
        if "﻿" in text and re.search("^﻿|\n﻿", text):
            raise yaml.YAMLError("a byte order mark inside the text")
        _refused(text, walk)
        if walk.out.issues:
            return walk.out
        documents = list(yaml.compose_all(text, Loader=_Loader))
        if len(documents) > 1:
            walk.issue("yaml-documents", "", documents[1])
            return walk.out
        if not documents or documents[0] is None:
            bare = re.sub(r"(?m)^\s*#.*$|\s", "", text)
            walk.out.value = None if bare else {}
            walk.out.spans[""] = (base, walk.byte(len(text)))
            return walk.out
        walk.out.value = walk.value(documents[0], "", 1)
    except (yaml.YAMLError, RecursionError, ValueError) as e:
        mark = getattr(e, "problem_mark", None)
        walk.out.issues = [Issue("syntax-error", "", str(e).split("\n")[0], walk.byte(mark.index) if mark else base)]
        walk.out.value = None
    return walk.out


def ambiguous(text: str) -> bool:
    """Whether a plain YAML string means something else to a common reader."""
    return bool(AMBIGUOUS.match(text))
