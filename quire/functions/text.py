"""Text: lines, case folding, tokens, slugs and digests."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|\n|\r"
#: A token character of full text: letters, marks, numbers and the low line.
TOKEN = r"[\p{L}\p{M}\p{N}_]"
#: Characters whose simple case folding isn't their lower case. Fixed values of the Unicode standard.
FOLD_FROM = "ςſµϐϑϕϖϰϱϵẛιͅ"
FOLD_TO = "σsμβθφπκρεṡιι"


def lines(text: Column) -> Column:
    """The lines of a text by LF, CRLF or CR; a final break starts no line, and a byte order mark is dropped."""
    parts = F.split(F.regexp_replace(text, "^﻿", ""), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_starts(content: Column) -> Column:
    """The byte offset at which each line of a binary content starts; a final break starts no line."""
    @F.pandas_udf("array<long>")
    def starts(contents: pd.Series) -> pd.Series:
        def of(b: bytes | None) -> list[int] | None:
            return None if b is None else [0, *(m.end() for m in re.finditer(LINE_BREAK.encode(), b) if m.end() < len(b))]

        return contents.map(of)

    return starts(content)


def lf(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def fold(text: Column) -> Column:
    """Simple case folding. ASCII texts only need lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(F.lower(text), FOLD_FROM, FOLD_TO))


def fold_text(text: str) -> str:
    """fold() of a Python string, one code point to one."""
    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.translate(str.maketrans(FOLD_FROM, FOLD_TO))


def has_word(text: Column, word: str, prefix: bool = False) -> Column:
    """Whether the folded text has the folded word as whole tokens (or tokens that start with it)."""
    w = fold_text(word)
    folded = fold(text)
    after = "" if prefix else f"(?!{TOKEN})"
    return folded.contains(w) & folded.rlike(f"(?<!{TOKEN}){java_quote(w)}{after}")


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the folded text contains the folded phrase."""
    return fold(text).contains(fold_text(phrase))


def java_quote(text: str) -> str:
    """A Java regular expression that matches exactly this text."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", text, flags=re.ASCII) if text.isascii() else "".join(c if not c.isascii() else re.sub(r"([^\w\s])", r"\\\1", c) for c in text)


def slug_ascii(text: Column) -> Column:
    """slug() for ASCII text, in the JVM."""
    return F.translate(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9_ \t-]", ""), " \t", "--")


IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cn}]")
SPACE = regex.compile(r"\p{White_Space}")
DROPPED = regex.compile(r"[^ \p{L}\p{M}\p{Nd}\p{Pc}-]")


def slug(text: str) -> str:
    """The slug of a heading's visible text: ignorable and unassigned characters out, NFC, lower case one code point
    at a time, trimmed, filtered to letters, marks, digits, connectors, hyphens and spaces, and hyphenated."""
    kept = unicodedata.normalize("NFC", IGNORABLE.sub("", text))
    low = "".join(c.lower() for c in kept)
    spaced = SPACE.sub(" ", low).strip(" ")
    return DROPPED.sub("", spaced).replace(" ", "-")


def repeats(slugs: list[str]) -> list[str]:
    """Derived anchors in document order: a used candidate gets the smallest free suffix -1, -2, ..."""
    used: set[str] = set()
    at: dict[str, int] = {}
    out = []
    for s in slugs:
        name, n = s, at.get(s, 0)
        while name in used:
            n += 1
            name = f"{s}-{n}"
        at[s] = n
        used.add(name)
        out.append(name)
    return out


def git_blob_id(content: Column) -> Column:
    """The id that git gives a file with this (binary) content."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))


def token_estimate(content: Column) -> Column:
    """Bytes divided by four, rounded up."""
    return F.ceil(F.octet_length(content) / 4).cast("long")
