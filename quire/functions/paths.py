"""Store paths: globs, well-formedness, naming rules and classification, all as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension (exact case) -> record format. Fixed values.
FORMATS = {".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json"}
MAX_SEGMENT_BYTES = 255
MAX_PATH_BYTES = 1024
#: Device names that Windows reserves, with or without an extension. Fixed values.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
META = set("*?[]{}\\")


@dataclass(frozen=True)
class Glob:
    """A compiled glob: an anchored regular expression and the literal text that every match starts with."""

    pattern: str
    regex: str
    prefix: str

    def __call__(self, path: Column) -> Column:
        """Whether path matches; the literal prefix is a condition of its own, which a Parquet scan can use."""
        if self.regex == "^" + re.escape(self.prefix) + "$":
            return path == self.prefix
        test = path.rlike(self.regex)
        return path.startswith(self.prefix) & test if self.prefix else test

    def matches(self, path: str) -> bool:
        return re.search(self.regex, path) is not None


def glob(pattern: str) -> Glob:
    """`*` is any run within a segment; a segment `**` is any number of segments, at the end one or more.

    Anything else that other glob dialects give a meaning is refused, and so are empty, `.` and `..` segments.
    """
    segments = pattern.split("/")
    if any(s in ("", ".", "..") for s in segments):
        raise ValueError(f"not a glob: {pattern!r} has an empty or relative segment")
    if any(set(s) & (META - {"*"}) or "\x00" in s for s in segments):
        raise ValueError(f"not a glob: {pattern!r} holds a character that globs don't define")
    if any("**" in s and s != "**" for s in segments):
        raise ValueError(f"not a glob: ** must be a whole segment in {pattern!r}")
    body, literal, open_ = "", "", True
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "**":
            body += "[^/]+(?:/[^/]+)*" if last else "(?:[^/]+/)*"
            open_ = False
            continue
        body += "[^/]*".join(re.escape(x) for x in s.split("*")) + ("" if last else "/")
        if open_:
            literal += s.split("*")[0] + ("/" if "*" not in s and not last else "")
            open_ = "*" not in s
    return Glob(pattern, f"^{body}$", literal)


def any_glob(patterns: list[str], path: Column) -> Column:
    """Whether any of the globs matches; false for none."""
    test = F.lit(False)
    for p in patterns:
        test = test | glob(p)(path)
    return test


def well_formed(path: Column) -> Column:
    """A relative path with no empty, `.` or `..` segment, no backslash and no NUL."""
    return (path != "") & ~path.rlike(r"(?:^|/)(?:\.{0,2})(?:/|$)") & ~path.rlike(r"[\\\x00]")


def ignored(path: Column, globs: list[str] | None = None) -> Column:
    """Dotfiles, anything below a dot folder, and what the ignore globs match."""
    return path.rlike(r"(?:^|/)\.") | any_glob(globs or [], path)


def record_format(path: Column) -> Column:
    """markdown, yaml or json by the exact extension; null for an asset."""
    ext = F.regexp_extract(path, r"[^/](\.[A-Za-z]+)$", 1)
    out = F.lit(None).cast("string")
    for suffix, name in FORMATS.items():
        out = F.when(ext == suffix, F.lit(name)).otherwise(out)
    return out


def file_kind(path: Column, ignore: list[str] | None = None) -> Column:
    """record, asset or ignored."""
    return F.when(ignored(path, ignore), "ignored").when(record_format(path).isNotNull(), "record").otherwise("asset")


def collections_of(path: Column, collections: dict[str, dict]) -> Column:
    """Names of the collections that claim the path: any match glob and no exclude glob. Collections are few, so
    this is one boolean each and not a join."""
    claims = [F.when(any_glob(c.get("match", []), path) & ~any_glob(c.get("exclude", []), path), F.lit(name)) for name, c in sorted(collections.items())]
    return F.array_compact(F.array(*claims)) if claims else F.array().cast("array<string>")


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_problems(path: Column) -> Column:
    """Array of the naming rules that the path breaks; empty if none.

    Segments hold letters, digits, `.`, `-`, `_`, space and marks only, start and end with none of space and `.`,
    have at most 255 bytes and no reserved device name; the path has at most 1024 bytes.
    """
    segments = F.split(path, "/")
    reserved = "|".join(RESERVED)
    rules = (
        ("path-too-long", F.octet_length(path) > MAX_PATH_BYTES),
        ("segment-too-long", F.exists(segments, lambda s: F.octet_length(s) > MAX_SEGMENT_BYTES)),
        ("character", F.exists(segments, lambda s: s.rlike(r"[^\p{L}\p{M}\p{N}._ +@()\[\],=~!-]"))),
        ("edge", F.exists(segments, lambda s: s.rlike(r"^ |[ .]$"))),
        ("reserved", F.exists(segments, lambda s: F.lower(s).rlike(rf"^(?:{reserved})(?:\.|$)"))),
    )
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))


def prefixes(path: Column) -> Column:
    """Every ancestor folder of the path and the path itself: a/b/c -> [a, a/b, a/b/c]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
