"""Listing, reading and line search over a files table: (path, content or text, size, version)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text

#: Page sizes. Fixed values.
LIST_LIMIT, GREP_LIMIT, REFS_LIMIT, ISSUE_LIMIT, MOST = 100, 50, 50, 20, 1_000_000


def bounded(limit: int) -> int:
    if not 1 <= limit <= MOST:
        raise ValueError(f"a limit is from 1 to {MOST}")
    return limit


def select_files(files: DataFrame, glob: str | None = None, exclude: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Files by prefix, glob and excluded globs; literal prefixes stay plain comparisons for the scan."""
    path = F.col("path")
    if prefix:
        files = files.where(path.startswith(prefix))
    if glob:
        files = files.where(paths.glob(glob)(path))
    return files.where(~paths.any_glob(exclude, path)) if exclude else files


def list_page(files: DataFrame, limit: int = LIST_LIMIT, cursor: str | None = None, **chosen) -> DataFrame:
    """One page in UTF-8 byte order after the cursor (the last path of the page before)."""
    found = select_files(files, **chosen)
    if cursor is not None:
        found = found.where(F.col("path") > cursor)
    return found.orderBy("path").limit(bounded(limit))


def remaining(files: DataFrame, cursor: str, **chosen) -> DataFrame:
    """How many listed files come after the cursor, exactly."""
    return select_files(files, **chosen).where(F.col("path") > cursor).agg(F.count("*").alias("remaining"))


def readable(files: DataFrame, most_bytes: int) -> DataFrame:
    """Files within the size bound; decided on `size`, so a larger file's content is never read."""
    return files.where(F.col("size") <= most_bytes)


def read_bytes(files: DataFrame, start: int, end: int) -> DataFrame:
    """The half-open byte range of each file's content."""
    return files.withColumn("content", F.substring(F.col("content"), start + 1, max(0, end - start)))


def file_lines(files: DataFrame, column: str = "text") -> DataFrame:
    """Each file's lines: (the other columns), line (from 1), text. One generator, no shuffle."""
    rest = [c for c in files.columns if c != column]
    return files.select(*rest, F.posexplode(text.lines(F.col(column))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def read_lines(files: DataFrame, start: int, end: int) -> DataFrame:
    """Lines start to end - 1, counted from 1."""
    return file_lines(files).where((F.col("line") >= start) & (F.col("line") < end))


def literal(pattern: str) -> Column:
    """A case-sensitive substring test of `text`."""
    return F.col("text").contains(pattern)


def grep(files: DataFrame, test: Column, limit: int | None = None, cursor: tuple[str, int] | None = None) -> DataFrame:
    """Matching lines (path, line, text) by path, then line; a cursor is the (path, line) of the last one seen."""
    hits = file_lines(files).where(test)
    if cursor is not None:
        hits = hits.where((F.col("path") > cursor[0]) | ((F.col("path") == cursor[0]) & (F.col("line") > cursor[1])))
    hits = hits.select("path", "line", "text")
    return hits.orderBy("path", "line").limit(bounded(limit)) if limit is not None else hits


def grep_context(files: DataFrame, test: Column, around: int) -> DataFrame:
    """Matching lines with the `around` lines before and after, as arrays. Each file's lines stay in one array, so
    context needs no window over exploded lines and no shuffle."""
    whole = files.select("path", text.lines(F.col("text")).alias("lines"))
    hits = whole.select("path", "lines", F.posexplode("lines").alias("at", "text")).where(test)
    low = F.greatest(F.col("at") - around, F.lit(0))
    return hits.select(
        "path", (F.col("at") + 1).alias("line"), "text",
        F.slice("lines", low + 1, F.col("at") - low).alias("before"),
        F.slice("lines", F.col("at") + 2, around).alias("after"),
    )


def case_conflicts(files: DataFrame) -> DataFrame:
    """Paths with a prefix that equals an earlier path's prefix but for case: (path, prefix, first).

    Every path is exploded into its prefixes; the first spelling of each folded prefix is a partial aggregate.
    """
    parts = files.select("path", F.explode(paths.prefixes(F.col("path"))).alias("prefix")).withColumn("folded", F.lower("prefix"))
    spelled = parts.groupBy("folded", "prefix").agg(F.min("path").alias("p"))
    first = spelled.groupBy("folded").agg(F.min(F.struct("p", "prefix")).alias("f"), F.count("*").alias("n")).where("n > 1").select("folded", F.col("f.prefix").alias("first"))
    return parts.join(first, "folded").where(F.col("prefix") != F.col("first")).select("path", "prefix", "first")


def versions(files: DataFrame) -> DataFrame:
    """path and git blob id of each file's content."""
    return files.select("path", text.git_blob_id(F.col("content")).alias("version"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two version tables: added, removed or modified."""
    b, a = before.select("path", F.col("version").alias("was")), after.select("path", F.col("version").alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return b.join(a, "path", "full_outer").select("path", kind.alias("change")).where(F.col("change").isNotNull())


def numbered_lines(files: DataFrame) -> DataFrame:
    """Lines per file."""
    return files.select("path", F.size(text.lines(F.col("text"))).cast("long").alias("n_lines"))


def first_occurrences(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with `repeat`: true on every row of equal `by` after the first in order."""
    return rows.withColumn("repeat", F.row_number().over(Window.partitionBy(*by).orderBy(order)) > 1)
