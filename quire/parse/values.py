"""The value model: JSON values with plain doubles, issues with byte offsets, and canonical JSON."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field

MAX_DEPTH = 256
MAX_BYTES = 16 << 20


@dataclass
class Issue:
    """A problem at an exact path; offset counts bytes of the file."""

    code: str
    at: str = ""
    message: str = ""
    offset: int = 0


@dataclass
class Parsed:
    """What a reader made of a unit: its value, where each node stands (exact path -> (start, end) in bytes), and issues."""

    value: object = None
    spans: dict[str, tuple[int, int]] = field(default_factory=dict)
    issues: list[Issue] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.issues


def escape(token: str) -> str:
    """A reference token of an exact path."""
    return token.replace("~", "~0").replace("/", "~1")


def child(at: str, token: object) -> str:
    return f"{at}/{escape(str(token))}"


def unescape(token: str) -> str:
    return token.replace("~1", "/").replace("~0", "~")


def pointer(value: object, at: str) -> object:
    """The value at an exact path; KeyError if there is none."""
    for token in at.split("/")[1:]:
        t = unescape(token)
        if isinstance(value, dict):
            value = value[t]
        elif isinstance(value, list) and re.fullmatch("0|[1-9][0-9]*", t) and int(t) < len(value):
            value = value[int(t)]
        else:
            raise KeyError(at)
    return value


def read_number(text: str, integer: bool) -> tuple[float | None, str]:
    """The nearest double of a literal, or None and why a double can't hold it. integer: whether its form is one."""
    if integer:
        exact = int(text, 0) if re.match(r"[+-]?0[xo]", text) else int(text)
        try:
            double = float(exact)
        except OverflowError:
            return None, "too large"
        return (double + 0.0, "") if int(double) == exact else (None, "not exact")
    double = float(text)
    if math.isinf(double):
        return None, "too large"
    if double == 0 and re.search("[1-9]", re.split("[eE]", text)[0]):
        return None, "too small"
    return double + 0.0, ""


def es_number(x: float) -> str:
    """A double as ECMAScript writes it, which canonical JSON asks for."""
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, exponent = f"{x!r}".lower(), 0
    sign = "-" if digits[0] == "-" else ""
    digits = digits.lstrip("-")
    if "e" in digits:
        digits, e = digits.split("e")
        exponent = int(e)
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + exponent
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    figures = figures.rstrip("0") or "0"
    k = len(figures)
    if k <= point <= 21:
        return sign + figures + "0" * (point - k)
    if 0 < point <= 21:
        return sign + figures[:point] + "." + figures[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + figures
    e = point - 1
    return sign + figures[0] + ("." + figures[1:] if k > 1 else "") + f"e{'+' if e >= 0 else '-'}{abs(e)}"


def jcs(value: object) -> str:
    """Canonical JSON (RFC 8785): members by UTF-16 order, shortest numbers, no white space."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{jcs(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(jcs, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return es_number(float(value))
    return json.dumps(value, ensure_ascii=False)


def node_version(value: object) -> str:
    """First 16 hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(jcs(value).encode()).hexdigest()[:16]


def canonical_number(x: float) -> str:
    """A double as the writer writes it: exponent form from 2^53 on and below 1e-6, with .0 after a lone digit."""
    if x == 0:
        return "0"
    if 1e-6 <= abs(x) < 2**53:
        return es_number(x)
    mantissa, exponent = f"{x!r}".split("e") if "e" in f"{x!r}" else f"{x:.17e}".split("e")
    if "e" not in f"{x!r}":
        for n in range(17):
            text = f"{x:.{n}e}"
            if float(text) == x:
                mantissa, exponent = text.split("e")
                break
    mantissa = mantissa if "." in mantissa else mantissa + ".0"
    return f"{mantissa}e{'-' if exponent[0] == '-' else '+'}{int(exponent.lstrip('+-'))}"
