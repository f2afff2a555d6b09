"""Running a search: filter, sort, projection, caps, pages and totals, as one declarative plan."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scopes import Scope
from .vql import And, Not, Or, Term, Word, parse

#: Page sizes. Fixed values.
DEFAULT_LIMIT, MOST = 20, 200
PER_RECORD = 5
MAX_CHARS = 1_000
EXCERPT = 100


def condition(query: str | object, scope: Scope) -> Column:
    """The query as one boolean Column, never null."""
    tree = parse(query) if isinstance(query, str) else query
    if isinstance(tree, And):
        out = F.lit(True)
        for p in tree.parts:
            out = out & condition(p, scope)
        return out
    if isinstance(tree, Or):
        out = F.lit(False)
        for p in tree.parts:
            out = out | condition(p, scope)
        return out
    if isinstance(tree, Not):
        return ~condition(tree.part, scope)
    if isinstance(tree, Word):
        return scope.word(tree)
    assert isinstance(tree, Term)
    return scope.term(tree)


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.col(self.column).desc_nulls_last() if self.descending else F.col(self.column).asc_nulls_last()


def search(rows: DataFrame, query: str, scope: Scope) -> DataFrame:
    """The rows that match, all of them."""
    return rows.where(condition(query, scope))


def total_order(sort: list[Sort], ties: list[str]) -> list[Sort]:
    """The sort keys followed by the tie breakers that aren't among them: always a total order."""
    named = {s.column for s in sort}
    return [*sort, *(Sort(t) for t in ties if t not in named)]


def _after(keys: list[Sort], last: list) -> Column:
    """Rows that come after the given values in the order (nulls last)."""
    out, equal = F.lit(False), F.lit(True)
    for key, value in zip(keys, last, strict=True):
        c, v = F.col(key.column), F.lit(value)
        if value is None:
            beyond, same = F.lit(False), c.isNull()
        else:
            beyond, same = F.coalesce((c < v) if key.descending else (c > v), F.lit(True)), F.coalesce(c == v, F.lit(False))
        out, equal = out | (equal & beyond), equal & same
    return out


def page(matched: DataFrame, sort: list[Sort], ties: list[str], limit: int = DEFAULT_LIMIT, cursor: str | None = None, query: str = "", head: str = "") -> DataFrame:
    """One page in a total order; with a cursor, the page after it. A keyset filter and one top-k, no offsets."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"a page has 1 to {MOST} results")
    keys = total_order(sort, ties)
    if cursor:
        matched = matched.where(_after(keys, read_cursor(cursor, query, head)))
    return matched.orderBy(*(k.order() for k in keys)).limit(limit)


def make_cursor(last: dict, sort: list[Sort], ties: list[str], query: str = "", head: str = "") -> str:
    """An opaque token for the page after a row; it holds only for the same query and store version."""
    values = [last[k.column] for k in total_order(sort, ties)]
    bound = hashlib.sha256(json.dumps([query, head]).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps([bound, values], default=str).encode()).decode()


def read_cursor(cursor: str, query: str = "", head: str = "") -> list:
    bound, values = json.loads(base64.urlsafe_b64decode(cursor))
    if bound != hashlib.sha256(json.dumps([query, head]).encode()).hexdigest()[:16]:
        raise ValueError("the cursor belongs to another query or store version")
    return values


def per_record(matched: DataFrame, record: str, order: str, shown: int = PER_RECORD) -> DataFrame:
    """At most `shown` matches of each record in document order, with n_matches of the record."""
    by = Window.partitionBy(record)
    return matched.withColumn("n_matches", F.count("*").over(by)).withColumn("match_no", F.row_number().over(by.orderBy(order))).where(F.col("match_no") <= shown)


def totals(matched: DataFrame, record: str) -> DataFrame:
    """n_records and n_matches, exact."""
    counted = matched.groupBy(record).agg(F.count("*").alias("n"))
    return counted.agg(F.count("*").alias("n_records"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"))


def excerpt(body: Column, folded: str, width: int = EXCERPT) -> Column:
    """About `width` characters of the body around the first place where the folded text stands."""
    from ..functions.text import fold

    at = F.instr(fold(body), folded)
    start = F.greatest(at - (width - len(folded)) // 2, F.lit(1))
    return F.when(at > 0, F.substring(body, start, F.lit(width)))
