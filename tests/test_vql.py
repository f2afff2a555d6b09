import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.text import fold_text
from quire.plans.query import Sort, condition, make_cursor, page, read_cursor
from quire.plans.scopes import Field, TableScope
from quire.plans.vql import And, Not, Or, Term, VqlError, Word, parse


@pytest.mark.parametrize(("text", "tree"), [
    ("", And(())),
    ("status:open", Term("status", "eq", "open")),
    ("a b", And((Word("a"), Word("b")))),
    ("a AND b OR c", Or((And((Word("a"), Word("b"))), Word("c")))),
    ("-x:1", Not(Term("x", "eq", "1"))),
    ("NOT (a OR b)", Not(Or((Word("a"), Word("b"))))),
    ('"two words"', Word("two words", phrase=True)),
    ('title:"a \\"b\\""', Term("title", "eq", 'a "b"')),
    ("pre*", Word("pre", prefix=True)),
    ("x:pre*", Term("x", "prefix", "pre")),
    ("x:*", Term("x", "exists")),
    ("x:>=5", Term("x", "ge", "5")),
    ("d:2026-10-01..*", Term("d", "range", "2026-10-01", None)),
    ("a.b.c:<2", Term("a.b.c", "lt", "2")),
    ("/a/0:x", Term("/a/0", "eq", "x")),
    ("@path:tickets/*", Term("@path", "eq", "tickets/*")),
    ("ORDER", Word("ORDER")),
])
def test_syntax(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["(", "a )", "x:", "OR", "a OR", "-", "*", "NOT", '"open'])
def test_syntax_errors(text):
    with pytest.raises(VqlError):
        parse(text)


VALUES = [(1, "Open", 5.0, None), (2, "closed", None, "x"), (3, None, -1.0, "Straße"), (4, "OPEN", 10.0, "ΣΑΣ"), (5, "reopen", 0.0, "two words here")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(VALUES, "k long, status string, n double, note string")


def scope():
    return TableScope({"status": Field(F.col("status")), "n": Field(F.col("n"), "number"), "note": Field(F.col("note"))})


@pytest.mark.parametrize(("text", "keys"), [
    ("status:open", [1, 4]), ("-status:open", [2, 3, 5]), ("status:*", [1, 2, 4, 5]), ("-status:*", [3]), ("n:>=0", [1, 4, 5]), ("n:0..5", [1, 5]), ("n:*..0", [3, 5]), ("note:straße", [3]), ("note:STRASSE", []),
    ("note:σας", [4]), ("open", [1, 4]), ("re*", [5]), ('"WORDS he"', [5]), ("n:x", []), ("status:open OR n:<0", [1, 3, 4]), ("missing:1", []), ("-missing:1", [1, 2, 3, 4, 5]), ("status:o*", [1, 4]),
])
def test_semantics(rows, text, keys):
    assert sorted(r["k"] for r in rows.where(condition(text, scope())).collect()) == keys


TERMS = st.sampled_from(["status:open", "n:>0", "note:*", "open", "missing:x"])
QUERIES = st.recursive(TERMS, lambda q: st.one_of(st.tuples(q, q).map(lambda x: f"({x[0]} OR {x[1]})"), st.tuples(q, q).map(lambda x: f"({x[0]} {x[1]})"), q.map(lambda x: f"-({x})")), max_leaves=5)


@settings(max_examples=15, deadline=None)
@given(QUERIES)
def test_negation_is_the_complement(rows, text):
    both = rows.select(condition(text, scope()).alias("a"), condition(f"-({text})", scope()).alias("b")).collect()
    assert all(r["a"] is not None and r["a"] != r["b"] for r in both)


def test_cursors_walk_all_pages(rows):
    sort, ties, seen, cursor = [Sort("status"), Sort("n", True)], ["k"], [], None
    while True:
        got = page(rows, sort, ties, 2, cursor, "q").collect()
        if not got:
            break
        seen += [r["k"] for r in got]
        cursor = make_cursor(got[-1].asDict(), sort, ties, "q")
    assert seen == [r["k"] for r in rows.orderBy(F.col("status").asc_nulls_last(), F.col("n").desc_nulls_last(), "k").collect()]
    with pytest.raises(ValueError, match="another query"):
        read_cursor(cursor, "other")


def test_folding_is_one_to_one():
    assert fold_text("ΑΣ") == fold_text("ας") and fold_text("ẞ") == "ß" and len(fold_text("STRAẞE")) == 6
