"""What a search term's field means: a column of a table read as a collection, or a parsed record's value map.

Every condition is two-valued: a missing field makes a term false, so that its negation is true.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schema import logical
from .vql import Term, Word


def certain(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def compare(op: str, a: Column, b: Column) -> Column:
    return {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "eq": a == b}[op]


def number(value: str | None) -> float | None:
    try:
        return None if value is None else float(value)
    except ValueError:
        return None


@dataclass(frozen=True)
class Field:
    """A typed column. kind is string, number, boolean, or a logical type; order is an enum's values, lowest first."""

    column: Column
    kind: str = "string"
    many: bool = False
    order: tuple[str, ...] | None = None

    def test(self, term: Term) -> Column:
        if term.op == "exists":
            return self.column.isNotNull()
        if self.many:
            return certain(F.exists(self.column, lambda x: Field(x, self.kind, False, self.order).test(term)))
        return certain(self._one(term))

    def _one(self, term: Term) -> Column:
        if term.op == "range":
            ends = [Term(term.field, o, v) for o, v in (("ge", term.value), ("le", term.high)) if v is not None]
            test = F.lit(True) & self.column.isNotNull()
            for e in ends:
                test = test & self._one(e)
            return test
        if term.op == "prefix":
            return text.fold(self.column.cast("string")).startswith(text.fold_text(term.value))
        if self.kind == "number":
            n = number(term.value)
            return F.lit(False) if n is None else compare(term.op, self.column, F.lit(n))
        if self.kind == "boolean":
            wanted = {"true": True, "false": False}.get(term.value.lower())
            return F.lit(False) if wanted is None or term.op != "eq" else self.column == F.lit(wanted)
        if self.order and term.op != "eq":
            if term.value not in self.order:
                return F.lit(False)
            rank = F.array_position(F.array(*map(F.lit, self.order)), self.column)
            return (rank > 0) & compare(term.op, rank, F.lit(self.order.index(term.value) + 1))
        if self.kind in logical.NATIVE:
            value = F.lit(term.value).try_cast(logical.NATIVE[self.kind])
            return compare(term.op, self.column.cast(logical.NATIVE[self.kind]), value)
        if self.kind in logical.KEYS and term.op != "eq":
            return compare(term.op, logical.KEYS[self.kind](self.column), logical.KEYS[self.kind](F.lit(term.value)))
        if term.op == "eq":
            return text.fold(self.column) == text.fold_text(term.value)
        return compare(term.op, self.column, F.lit(term.value))


@dataclass
class TableScope:
    """A table as a collection: one record a row, fields by name, `path` as its record path."""

    fields: dict[str, Field]
    path: Column | None = None
    collection: str | None = None
    title: Column | None = None
    body: Column | None = None
    tags: Column | None = None
    #: Texts that full text reads besides title and body; by default every string field.
    texts: list[Column] | None = None
    #: Fields of the ancestors, nearest first, for node targets.
    ancestors: list[dict[str, Field]] = field(default_factory=list)
    #: Further @fields by name.
    computed: dict[str, Field] = field(default_factory=dict)
    prose_only: bool = False

    def term(self, term: Term) -> Column:
        name = term.field
        if name.startswith("@"):
            return self._computed(term)
        levels = [self.fields, *self.ancestors]
        held = [level[name] for level in levels if name in level]
        if not held:
            return F.lit(False)
        test = held[-1].test(term)
        for f in reversed(held[:-1]):
            test = F.when(f.column.isNotNull(), f.test(term)).otherwise(test)
        return test

    def _computed(self, term: Term) -> Column:
        if term.field == "@path" and self.path is not None:
            return certain(paths.glob(term.value)(self.path))
        if term.field == "@collection":
            return F.lit(term.op == "eq" and term.value == self.collection)
        if term.field == "@title" and self.title is not None:
            return Field(self.title).test(term)
        if term.field == "@tags" and self.tags is not None:
            return certain(F.array_contains(self.tags, term.value))
        if term.field == "@text":
            return self._any(self._prose(), lambda c: text.has_word(c, term.value))
        if term.field in self.computed:
            return self.computed[term.field].test(term)
        raise ValueError(f"{term.field} can't be searched here")

    def _prose(self) -> list[Column]:
        return [c for c in (self.title, self.body) if c is not None]

    @staticmethod
    def _any(columns: list[Column], test: Callable[[Column], Column]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | certain(test(c))
        return out

    def word(self, word: Word) -> Column:
        rest = [f.column for f in self.fields.values() if f.kind == "string" and not f.many] if self.texts is None else self.texts
        columns = self._prose() + ([] if self.prose_only else rest)
        if word.phrase:
            return self._any(columns, lambda c: text.has_phrase(c, word.text))
        return self._any(columns, lambda c: text.has_word(c, word.text, word.prefix))


def named(names: Column, term: Term) -> Column:
    """Whether a list of names has any, one that starts so, or exactly this one."""
    if term.op == "exists":
        return certain(F.size(names) > 0)
    if term.op == "prefix":
        return certain(F.exists(names, lambda n: n.startswith(term.value)))
    return certain(F.array_contains(names, term.value))


#: A parsed record or section as a row: its values by semantic path (and exact path), each a list of leaves.
LEAF = "struct<kind:string,str:string,num:double,flag:boolean>"


@dataclass
class ValueScope:
    """Rows with `values` (map of path -> leaves), `title`, `body`, `strings`, `path` and the other record columns.

    types gives a field its logical type or enum order, from the collection's schema.
    """

    types: dict[str, Field] = field(default_factory=dict)
    prose_only: bool = False

    def term(self, term: Term) -> Column:
        name = term.field
        if name.startswith("@"):
            return self._computed(term)
        leaves = F.try_element_at("values", F.lit(name if name.startswith("/") else name.replace(".", "/")))
        if term.op == "exists":
            return leaves.isNotNull()
        declared = self.types.get(name)

        def one(leaf: Column) -> Column:
            if declared is not None:
                shown = Field(leaf["num"] if declared.kind == "number" else leaf["str"], declared.kind, False, declared.order)
                return shown.test(term)
            as_text = certain(Field(leaf["str"]).test(term))
            n = [number(v) for v in (term.value, term.high)]
            if all(v is None for v in n) and term.op != "prefix":
                flag = {"true": True, "false": False, "null": None}.get(term.value.lower(), "") if term.value and term.op == "eq" else ""
                same = F.lit(False) if flag == "" else (leaf["kind"] == "null" if flag is None else leaf["flag"] == F.lit(flag))
                return as_text | certain(same)
            return F.when(leaf["kind"] == "number", Field(leaf["num"], "number").test(term)).otherwise(as_text)

        return certain(F.exists(leaves, one))

    def _computed(self, term: Term) -> Column:
        f = term.field
        if f == "@path":
            return certain(paths.glob(term.value)(F.col("path")))
        if f == "@tags":
            return named(F.col("tags"), term)
        if f == "@anchors":
            return named(F.col("anchors.name"), term)
        if f == "@refs":
            return named(F.col("ref_targets"), term)
        if f == "@issues" and term.op == "exists":
            return F.col("n_issues") > 0
        if f == "@issues":
            return Field(F.col("n_issues").cast("double"), "number").test(term)
        if f == "@depth":
            return Field(F.col("depth").cast("double"), "number").test(term)
        if f == "@text":
            return TableScope._any([F.col("title"), F.col("body")], lambda c: text.has_word(c, term.value))
        if f in ("@title", "@key", "@address", "@at", "@collection"):
            return Field(F.col(f[1:])).test(term)
        raise ValueError(f"{f} can't be searched")

    def word(self, word: Word) -> Column:
        test = (lambda c: text.has_phrase(c, word.text)) if word.phrase else (lambda c: text.has_word(c, word.text, word.prefix))
        prose = TableScope._any([F.col("title"), F.col("body")], test)
        return prose if self.prose_only else prose | certain(F.exists("strings", test))


Scope = TableScope | ValueScope
Rows = DataFrame
