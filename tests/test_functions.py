"""Scalar functions against plain Python and fixed examples."""

import hashlib
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import paths, portable, text, uri
from quire.operators import listing, resolve
from quire.parse.values import canonical_number, es_number, jcs, read_number
from quire.schema import logical
from quire.schema.validate import FORMATS


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    ("*.md", ["a.md", ".md", ".x.md"], ["a/b.md", "a.mdx"]),
    ("docs/**", ["docs/a", "docs/a/b"], ["docs", "docs2/a"]),
    ("**/x.md", ["x.md", "a/x.md", "a/b/x.md"], ["ax.md"]),
    ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/xb"]),
    ("a+b(1).md", ["a+b(1).md"], ["aab1.md"]),
    ("t*/0*-*.md", ["t/0-.md", "tasks/0042-x.md"], ["tasks/42-x.md"]),
])
def test_globs(spark, pattern, yes, no):
    g = paths.glob(pattern)
    assert column(spark, yes + no, g) == [True] * len(yes) + [False] * len(no)
    assert [g.matches(p) for p in yes + no] == [True] * len(yes) + [False] * len(no)
    assert all(p.startswith(g.prefix) for p in yes)


@pytest.mark.parametrize("pattern", ["", "/a", "a//b", "a/../b", "a?b", "[ab]", "a**", "{a,b}", "a\\b"])
def test_malformed_globs(pattern):
    with pytest.raises(ValueError, match="not a glob"):
        paths.glob(pattern)


def test_path_rules(spark):
    good = ["a/b.md", "x", "é/ß.md", "a b.md", "a.b.c"]
    bad = ["", "/a", "a/", "a//b", "./a", "a/..", "a\\b", "a\0"]
    assert column(spark, good + bad, paths.well_formed) == [True] * len(good) + [False] * len(bad)
    named = {"a.md": [], "con.md": ["reserved"], "x/aux": ["reserved"], "a./b": ["edge"], " a": ["edge"], "a*b": ["character"], "a:b": ["character"], "z" * 256: ["segment-too-long"], "a/" * 512 + "b": ["path-too-long"]}
    assert column(spark, list(named), paths.path_problems) == list(named.values())


def test_kinds(spark):
    files = {"a.md": "record", "a.MD": "asset", "a.yml": "record", "x/y.json": "record", ".md": "ignored", "a/.b/c.md": "ignored", "a.png": "asset", "md": "asset", "drafts/a.md": "ignored"}
    assert column(spark, list(files), lambda p: paths.file_kind(p, ["drafts/**"])) == list(files.values())


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\r\n"), max_size=12), min_size=1, max_size=8))
def test_lines(spark, texts):
    def brute(t):
        parts = re.split(r"\r\n|\n|\r", t)
        return parts[:-1] if parts[-1] == "" else parts

    assert column(spark, texts, text.lines) == [brute(t) for t in texts]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=8))
def test_blob_ids(spark, blobs):
    want = [hashlib.sha1(b"blob %d\0" % len(b) + b).hexdigest() for b in blobs]
    assert column(spark, blobs, text.git_blob_id, "binary") == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=8))
def test_folding_column_equals_python(spark, texts):
    kept = [t for t in texts if "İ" not in t and all(len(c.lower()) == 1 for c in t) and unicodedata.is_normalized("NFC", t) and all(unicodedata.category(c) not in ("Cn", "Cs") for c in t)]
    got = column(spark, [t for t in kept if t.isascii()] or ["a"], text.fold)
    assert got == [text.fold_text(t) for t in [t for t in kept if t.isascii()] or ["a"]]


@pytest.mark.parametrize(("title", "slug"), [
    ("Known so far", "known-so-far"), ("Bread &  butter", "bread---butter"), ("Maß Übung", "maß-übung"), ("  Trim me  ", "trim-me"), ("ΑΣ", "ασ"), ("e️́", "é"), ("a­b", "ab"), ("C++ & C#", "c--c"), ("x_y-z", "x_y-z"), ("日本 語", "日本-語"), ("!!!", ""), ("a\u0085", "a"), ("½ 5", "-5"),
])
def test_slugs(title, slug):
    assert text.slug(title) == slug


@pytest.mark.parametrize(("slugs", "names"), [
    (["foo", "foo", "foo-1"], ["foo", "foo-1", "foo-1-1"]), (["a", "b", "a", "a"], ["a", "b", "a-1", "a-2"]), (["foo-1", "foo", "foo"], ["foo-1", "foo", "foo-2"]), (["", ""], ["", "-1"]),
])
def test_repeats(slugs, names):
    assert text.repeats(slugs) == names


@pytest.mark.parametrize(("raw", "kind", "target", "fragment"), [
    ("../design/x.md#a", "path", "docs/design/x.md", "a"), ("b.md", "path", "docs/t/b.md", None), ("/top.md", "path", "top.md", None), ("#here", "path", "docs/t/a.md", "here"), ("", "path", "docs/t/a.md", None),
    ("https://x.y/z", "outside", None, None), ("//x.y/z", "outside", None, None), ("../../../up.md", "outside", None, None), ("mailto:a@b.c", "outside", None, None), ("./", "directory", "docs/t", None), ("..", "directory", "docs", None),
    ("a%20b.md", "path", "docs/t/a b.md", None), ("a+b.md", "path", "docs/t/a+b.md", None), ("%E9.md", "invalid", None, None), ("%zz", "invalid", None, None), ("x%2Fy.md", "invalid", None, None), ("b.md?q=1#f", "path", "docs/t/b.md", "f"), ("%C3%A9.md", "path", "docs/t/é.md", None),
])
def test_uri_resolution(spark, raw, kind, target, fragment):
    got = column(spark, [raw], lambda c: uri.resolve(c, F.lit("docs/t/a.md")))[0]
    assert (got["kind"], got["target"]) == (kind, target)
    if kind == "path":
        assert got["fragment"] == fragment


def test_address_encoding(spark):
    steps = {"name with space": "name%20with%20space", "a/b": "a%2Fb", "x:y": "x:y", "é": "%C3%A9", "100%": "100%25", "a?b": "a?b"}
    assert column(spark, list(steps), resolve.encode_step) == list(steps.values())
    assert column(spark, ["a~b/c"], lambda c: resolve.child(F.lit(""), c)) == ["/a~0b~1c"]
    assert column(spark, ["/a/b/c"], resolve.ancestors) == [["", "/a", "/a/b", "/a/b/c"]]


@pytest.mark.parametrize("pattern", ["(?=x)", "(?<n>x)", "\\1", "a**", "a++", "x{1001}", "(", ")", "[", "]", "{", "\\p{L}", "(?i)x", "*a", "a{2}{3}", "[[a]]", "\\"])
def test_not_portable(pattern):
    assert portable.problems(pattern)


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    ("^a.c$", ["abc"], ["a\nc", "abcd"]), ("\\bfoo\\b", ["a foo b"], ["foobar"]), ("[\\d-]+x", ["1-2x"], ["x"]), ("a{2,3}?b", ["aab"], ["ab"]), ("\\s", ["\f", " "], ["\x0b", " "]), ("(?:a|b)+#", ["ab#"], ["#"]), ("\\w", ["_"], ["é"]), ("x$", ["x"], ["x\n"]), ("[&~^]", ["&", "~"], ["a"]),
])
def test_portable(spark, pattern, yes, no):
    assert column(spark, yes + no, lambda c: c.rlike(portable.translate(pattern))) == [True] * len(yes) + [False] * len(no)


LOGICAL = {
    "date": (["2026-10-09", "2024-02-29"], ["2026-02-29", "2026-13-01", "2026-1-1", "x", "0000-01-01"]),
    "time": (["08:00:00Z", "08:00:00.5+02:00", "23:59:60Z", "01:59:60+02:00", "08:00:00-00:00", "08:00:00z"], ["08:00:00", "12:30:60Z", "24:00:00Z", "08:00:61Z", "08:00:00+02", "08:00Z"]),
    "date-time": (["2026-10-09T08:00:00Z", "2015-06-30t23:59:60z", "2015-07-01T04:59:60+05:00"], ["2026-10-09 08:00:00Z", "2026-10-09T08:00:00", "2026-02-30T00:00:00Z", "2015-06-30T18:20:60Z"]),
    "local-date-time": (["2026-10-09T08:00:00", "2031-05-04 21:07:33.987654321", "2015-06-30T18:20:60"], ["2026-10-09T08:00:00Z", "2026-10-09"]),
    "duration": (["PT10M", "P3D", "pt10m", "P1Y2M3D", "P1W", "PT1H2M3S", "P1DT2H"], ["PT1.5S", "P1Y3D", "PT1H30S", "P1W2D", "P", "PT", "P1DT"]),
    "int64": (["42", "-9223372036854775808", "-0", "9223372036854775807"], ["+5", "007", " 42", "9223372036854775808", "1.0"]),
    "bigint": (["9" * 60, "-1"], ["01", "+1", ""]),
    "decimal": (["+1", ".5", "1.", "01", "1.50", "-0"], ["1e3", " 1", ".", "", "+"]),
    "uuid": (["f81d4fae-7dec-11d0-a765-00a0c91e6bf6"], ["f81d4fae7dec11d0a76500a0c91e6bf6"]),
    "email": (["a@b.c", "x+y@m.example.com"], ["a@", "@b", "a b@c.d"]),
    "uri": (["https://x.y/z?a#b", "urn:a:b"], ["x/y", "//x", "http://a b", "http://%zz"]),
    "uri-reference": (["x/y", "#a", "", "//h/p"], ["a b", "%z"]),
}


@pytest.mark.parametrize("kind", sorted(LOGICAL))
def test_logical_types(spark, kind):
    yes, no = LOGICAL[kind]
    assert column(spark, yes + no, logical.ACCEPTS[kind]) == [True] * len(yes) + [False] * len(no)
    if kind in FORMATS:
        assert [FORMATS[kind](t) for t in yes + no] == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(("kind", "ordered"), [
    ("date-time", ["2016-12-31T23:59:59.9Z", "2016-12-31T23:59:60Z", "2016-12-31T23:59:60.5Z", "2017-01-01T02:00:00.01+02:00", "2017-01-01T00:00:00.1Z"]),
    ("time", ["00:00:00Z", "08:00:00+02:00", "07:00:00Z", "23:59:60Z"]),
    ("bigint", ["-100", "-99", "-1", "-0", "7", "10", "9" * 40]),
    ("decimal", ["-10", "-1.55", "-1.5", "-.5", "-0", "+0.05", "0.5", "1", "1.05", "01.5", "10"]),
    ("duration", ["PT1S", "PT61S", "PT2M", "P1D", "P1W"]),
])
def test_logical_order(spark, kind, ordered):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i int, v string").repartition(3)
    assert [r["v"] for r in rows.orderBy(logical.KEYS[kind](F.col("v")), "i").collect()] == ordered


@pytest.mark.parametrize(("value", "shown", "written"), [(0.1, "0.1", "0.1"), (3e22, "3e+22", "3.0e+22"), (2.0**62, "4611686018427387904", "4.611686018427388e+18"), (7e20, "700000000000000000000", "7.0e+20"), (4.75e-8, "4.75e-8", "4.75e-8"), (1e-6, "0.000001", "0.000001"), (-0.0, "0", "0"), (42.0, "42", "42"), (123.456, "123.456", "123.456"), (5e-324, "5e-324", "5.0e-324")])
def test_number_forms(value, shown, written):
    assert (es_number(value), canonical_number(value)) == (shown, written)


@settings(deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_survive_their_forms(x):
    assert float(es_number(x)) == x == float(canonical_number(x))
    assert canonical_number(x).lstrip("-").isdigit() is False or abs(x) < 2**53


@pytest.mark.parametrize(("literal", "integer", "value"), [("9007199254740993", True, None), ("9007199254740992", True, 2.0**53), ("1e400", False, None), ("1e-400", False, None), ("0e-400", False, 0.0), ("1e23", False, 1e23), ("0x1F", True, 31.0), ("0o17", True, 15.0), ("-0", True, 0.0), ("+9007199254740993", True, None)])
def test_number_literals(literal, integer, value):
    assert read_number(literal, integer)[0] == value


def test_canonical_json():
    assert jcs({"b": [1.0, True, None], "a": "é\n", "\U0001f600": 1, "דּ": 2}) == '{"a":"é\\n","b":[1,true,null],"\U0001f600":1,"דּ":2}'


def test_grep_and_context(spark):
    files = spark.createDataFrame([("a", "x\ny\r\nx2"), ("b", "x")], "path string, text string")
    assert [tuple(r) for r in listing.grep(files, listing.literal("x"), 2).collect()] == [("a", 1, "x"), ("a", 3, "x2")]
    assert [tuple(r) for r in listing.grep(files, listing.literal("x"), 9, ("a", 1)).collect()] == [("a", 3, "x2"), ("b", 1, "x")]
    got = {(r["path"], r["line"]): (r["before"], r["after"]) for r in listing.grep_context(files, listing.literal("y"), 1).collect()}
    assert got == {("a", 2): (["x"], ["x2"])}
