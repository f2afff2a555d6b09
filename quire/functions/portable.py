"""A regular expression subset that means the same in RE2, ECMAScript and Python, and its translation to Java."""

from __future__ import annotations

REPEAT = 1000
#: Escapes of the subset that stand for themselves or a class. Fixed values.
CLASSES = {"d": "[0-9]", "D": "[^0-9]", "w": "[0-9A-Za-z_]", "W": "[^0-9A-Za-z_]", "s": "[\\t\\n\\f\\r ]", "S": "[^\\t\\n\\f\\r ]"}
INSIDE = {"d": "0-9", "w": "0-9A-Za-z_", "s": "\\t\\n\\f\\r "}
CONTROL = {"t": "\\t", "n": "\\n", "r": "\\r", "f": "\\f", "v": "\\x0B"}
PUNCTUATION = set("\\^$.|?*+()[]{}/-")


class PortableError(ValueError):
    """A construct that isn't portable, with its offset."""

    def __init__(self, message: str, at: int) -> None:
        super().__init__(f"{message} (at {at})")
        self.at = at


def problems(pattern: str) -> list[PortableError]:
    """The first construct that isn't portable, or none."""
    try:
        translate(pattern)
    except PortableError as e:
        return [e]
    return []


def translate(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for java.util.regex; raises PortableError outside the subset.

    The subset has literals, ., classes, \\d \\w \\s and their negations, \\b \\B, anchors, groups (plain and ?:),
    alternation, and * + ? {n,m} with an optional lazy mark and counts up to 1000. It has no look-around,
    back-references, named groups, inline flags or possessive quantifiers.
    """
    out, i, depth, can_repeat = [], 0, 0, False
    n = len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\":
            text, i = _escape(pattern, i)
            out.append(text)
            can_repeat = pattern[i - 1] not in "bB" or pattern[i - 2] != "\\"
        elif c == "[":
            text, i = _class(pattern, i)
            out.append(text)
            can_repeat = True
        elif c == "(":
            if pattern.startswith("(?", i):
                if not pattern.startswith("(?:", i):
                    raise PortableError("only plain and (?: groups", i)
                out.append("(?:")
                i += 3
            else:
                out.append("(")
                i += 1
            depth, can_repeat = depth + 1, False
        elif c == ")":
            if not depth:
                raise PortableError(") without (", i)
            out.append(c)
            depth, i, can_repeat = depth - 1, i + 1, True
        elif c in "*+?{":
            if not can_repeat:
                raise PortableError("nothing to repeat", i)
            text, i = _repeat(pattern, i)
            out.append(text)
            can_repeat = False
        elif c in "|^$":
            out.append({"|": "|", "^": "^", "$": "\\z"}[c])
            i, can_repeat = i + 1, False
        elif c in "]}":
            raise PortableError(f"{c} must be escaped", i)
        else:
            out.append("[^\\n]" if c == "." else ("\\" + c if c in "#&~ " else c))
            i, can_repeat = i + 1, True
    if depth:
        raise PortableError("( is not closed", n)
    return ("(?iu)" if ignore_case else "") + "".join(out)


def _escape(pattern: str, i: int) -> tuple[str, int]:
    if i + 1 == len(pattern):
        raise PortableError("a lone \\", i)
    c = pattern[i + 1]
    if c in CLASSES:
        return CLASSES[c], i + 2
    if c in "bB":
        ascii_word = "[0-9A-Za-z_]"
        edge = f"(?:(?<={ascii_word})(?!{ascii_word})|(?<!{ascii_word})(?={ascii_word}))"
        return (edge if c == "b" else f"(?!{edge})"), i + 2
    if c in CONTROL:
        return CONTROL[c], i + 2
    if c in PUNCTUATION:
        return "\\" + c, i + 2
    raise PortableError(f"\\{c} isn't portable", i)


def _class(pattern: str, i: int) -> tuple[str, int]:
    start, out = i, "["
    i += 1
    if pattern[i : i + 1] == "^":
        out, i = out + "^", i + 1
    empty = True
    while i < len(pattern) and pattern[i] != "]":
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1 : i + 2]
            if e in INSIDE:
                out += INSIDE[e]
            elif e in CONTROL:
                out += CONTROL[e]
            elif e and e in PUNCTUATION:
                out += "\\" + e
            else:
                raise PortableError(f"\\{e} isn't portable in a class", i)
            i += 2
        else:
            if c == "[":
                raise PortableError("[ must be escaped in a class", i)
            out += "\\" + c if c in "&~^" else c
            i += 1
        empty = False
    if i >= len(pattern) or empty:
        raise PortableError("[ is not closed", start)
    return out + "]", i + 1


def _repeat(pattern: str, i: int) -> tuple[str, int]:
    start = i
    if pattern[i] == "{":
        end = pattern.find("}", i)
        low, comma, high = pattern[i + 1 : max(end, i)].partition(",")
        if end < 0 or not low.isdigit() or (high and not high.isdigit()):
            raise PortableError("{ must be a count or escaped", i)
        if int(low) > REPEAT or (high and (int(high) > REPEAT or int(high) < int(low))):
            raise PortableError(f"counts go up to {REPEAT}", i)
        i = end + 1
    else:
        i += 1
    if pattern[i : i + 1] == "?":
        i += 1
    if pattern[i : i + 1] in ("+", "*", "{"):
        raise PortableError("a repeat of a repeat", i)
    return pattern[start:i], i
