"""URI references: resolution against a citing path, as a Column expression over path segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def percent_decode(text: Column) -> Column:
    """Percent-decoded UTF-8 (+ stays a plus sign); null if an escape is malformed or the bytes aren't UTF-8."""
    plain = ~text.contains("%")
    bad = text.rlike("%(?![0-9A-Fa-f]{2})")
    pieces = F.split(text, "(?=%[0-9A-Fa-f]{2})|(?<=%[0-9A-Fa-f]{2})", -1)
    as_hex = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8")))), "")
    raw = F.unhex(as_hex)
    return F.when(plain, text).when(bad, F.lit(None).cast("string")).otherwise(F.try_validate_utf8(raw.cast("string")))


def remove_dots(segments: Column) -> Column:
    """Array of segments with `.` and `..` applied; null if it climbs above the root."""

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc["out"]) > 0, F.slice(acc["out"], 1, F.size(acc["out"]) - 1)).otherwise(acc["out"])
        out = F.when(s == ".", acc["out"]).when(s == "..", up).otherwise(F.concat(acc["out"], F.array(s)))
        return F.struct((acc["ok"] & ~((s == "..") & (F.size(acc["out"]) == 0))).alias("ok"), out.alias("out"))

    zero = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(segments, zero, step, lambda acc: F.when(acc["ok"], acc["out"]))


def resolve(raw: Column, citing: Column) -> Column:
    """struct(kind, target, fragment): kind is outside, invalid, directory or path.

    A scheme or an authority is outside, and so is a path that climbs above the store; a path that ends in /, . or ..
    is a directory; an empty path is the citing record itself. target is the decoded store path.
    """
    no_fragment = F.substring_index(raw, "#", 1)
    fragment = F.when(raw.contains("#"), F.substring(raw, F.length(no_fragment) + 2, F.length(raw)))
    path = F.substring_index(no_fragment, "?", 1)
    outside = raw.rlike(SCHEME) | raw.startswith("//")
    from_root = path.startswith("/")
    base = F.when(from_root, F.array().cast("array<string>")).otherwise(F.slice(F.split(citing, "/"), 1, F.size(F.split(citing, "/")) - 1))
    own = F.split(F.when(from_root, F.substring(path, 2, F.length(path))).otherwise(path), "/", -1)
    decoded = F.transform(own, percent_decode)
    broken = F.exists(decoded, lambda s: s.isNull() | s.contains("/")) | F.exists(decoded, lambda s: F.coalesce(s.contains("\x00"), F.lit(False)))
    last = F.element_at(own, -1)
    folder = last.isin("", ".", "..")
    kept = F.filter(decoded, lambda s: s != "")
    merged = remove_dots(F.concat(base, kept))
    target = F.array_join(merged, "/")
    kind = F.when(outside, "outside").when(path == "", "path").when(broken, "invalid").when(merged.isNull(), "outside").when(folder, "directory").otherwise("path")
    shown = F.when(kind.isin("path", "directory"), F.when(path == "", citing).otherwise(target))
    return F.struct(kind.alias("kind"), shown.alias("target"), fragment.alias("fragment"))
