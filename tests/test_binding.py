"""Keyed lists, typed references and fragile anchors in a store."""

import pytest

from quire.operators import binding, checks
from quire.sources.store import Store

SCHEMA = """
type: object
properties:
  parent: {type: string, format: uri-reference, x-vmd-ref: {targets: [tickets]}}
  links: {type: array, items: {type: string, format: uri-reference, x-vmd-ref: {targets: ["docs/**"]}}}
  timings: {type: array, x-vmd-list: {type: map, keys: [name], required: [base]}}
"""
FILES = {
    ".vmd/config.yaml": "collections:\n  tickets:\n    match: ['tickets/*']\n    schema: t.yaml\n    key: {pattern: '^0*([0-9]+)'}\n  runs:\n    match: ['runs/*']\n    key: id\n",
    ".vmd/schema/t.yaml": SCHEMA,
    "tickets/001-a.yaml": "parent: 002-b.md\nlinks: [../docs/d.md#part, 002-b.md]\ntimings:\n  - {name: base, ms: 7}\n  - {name: large, ms: 9}\n",
    "tickets/002-b.md": "---\nparent: ../docs/d.md\n---\n# B\n\nsee [p](../docs/d.md#part), [r](../docs/d.md#same), [f](001-a.yaml#timings/large/ms), [i](001-a.yaml#timings/0)\n",
    "docs/d.md": "# D\n\n## Part\n\n## Same\n\nx\n\n### Same\n",
    "runs/r.json": '{"id": "R7"}',
}


@pytest.fixture(scope="module")
def store(spark):
    return Store.of(spark, FILES).cached()


def test_keyed_items_are_named_by_key(store):
    got = {r["address_id"]: (r["at"], r["status"]) for r in store.resolve(["tickets/001-a.yaml#timings/large/ms", "tickets/001-a.yaml#timings/0", "tickets/001-a.yaml#/timings/0/ms"]).collect()}
    assert got == {0: ("/timings/1/ms", "ok"), 1: (None, "not-found"), 2: ("/timings/0/ms", "ok")}
    issues = checks.keyed_list_issues(binding.list_items(store.nodes, "/timings", "name"), ["base", "other"], unique=True)
    assert [(r["code"], r["message"]) for r in issues.collect()] == [("keyed-list-required", "other")]


def test_typed_references_and_warnings(store):
    typed = {(r["path"], r["raw"]): r["status"] for r in store.resolved_refs().where("kind = 'typed'").collect()}
    assert typed == {("tickets/001-a.yaml", "002-b.md"): "ok", ("tickets/001-a.yaml", "../docs/d.md#part"): "ok", ("tickets/002-b.md", "../docs/d.md"): "ok"}
    got = {(r["code"], r["path"], r["message"]) for r in store.check().collect() if r["code"].startswith("ref-")}
    assert ("ref-target-not-allowed", "tickets/002-b.md", "../docs/d.md") in got and ("ref-target-not-allowed", "tickets/001-a.yaml", "002-b.md") in got
    assert ("ref-derived-anchor", "tickets/002-b.md", "../docs/d.md#part") in got and ("ref-derived-repeat", "tickets/002-b.md", "../docs/d.md#same") in got
    assert ("ref-dangling", "tickets/002-b.md", "001-a.yaml#timings/0") in got and not any("large" in m for _, _, m in got)
    assert not any(c == "ref-target-not-allowed" and m == "../docs/d.md#part" for c, _, m in got)


def test_collection_keys(store):
    got = {(r["path"], r["key"]) for r in binding.collection_keys(store.records, store.config.collections).collect()}
    assert got == {("tickets/001-a.yaml", "1"), ("tickets/002-b.md", "2"), ("runs/r.json", "R7")}


NESTED = "{type: object, properties: {plots: {type: array, items: {properties: {rows: {x-vmd-list: {type: map, keys: [crop]}}}}}, %s: {x-vmd-list: {type: map, keys: [id]}}}}"


def test_keyed_lists_of_several_collections_and_depths(spark):
    names = [f"c{i}" for i in range(8)]
    config = "collections:\n" + "".join(f"  {n}:\n    match: ['{n}/*']\n    schema: {NESTED % n}\n" for n in names)
    files = {f"{n}/a.json": '{"plots": [{"rows": [{"crop": "rye", "m": 1}, {"crop": "oat"}, {}]}], "%s": [{"id": "x", "v": 2}], "free": [{"id": "x"}]}' % n for n in names}
    s = Store.of(spark, {".vmd/config.yaml": config} | files)
    asked = [("plots/0/rows/rye/m", "/plots/0/rows/0/m", "ok"), ("plots/0/rows/oat", "/plots/0/rows/1", "ok"), ("plots/0/rows/2", None, "not-found"), ("free/0", "/free/0", "ok"), ("free/x", None, "not-found")]
    for n in names[:2]:
        want = [*asked, (f"{n}/x/v", f"/{n}/0/v", "ok"), (f"{n}/0", None, "not-found")]
        got = {r["address_id"]: (r["at"], r["status"]) for r in s.resolve([f"{n}/a.json#{a}" for a, _, _ in want]).collect()}
        assert got == {i: (at, status) for i, (_, at, status) in enumerate(want)}
    plan = s.nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan and "Union" not in plan


def test_values_of_nodes(spark):
    s = Store.of(spark, {"a.json": '{"x": {"z": [1, 2.5, null], "y": "q"}, "n": true, "e": {}}'})
    got = {a: s.get(f"a.json#{a}").select("value").first()["value"] for a in ("x", "x/z", "x/z/1", "x/z/2", "x/y", "n", "e")}
    assert got == {"x": '{"y":"q","z":[1,2.5,null]}', "x/z": "[1,2.5,null]", "x/z/1": "2.5", "x/z/2": "null", "x/y": '"q"', "n": "true", "e": "{}"}
    assert s.get("a.json").first()["value"] == '{"e":{},"n":true,"x":{"y":"q","z":[1,2.5,null]}}' and s.get("a.json#no").count() == 0


def test_targets_of_deep_references(spark):
    deep = "{x-vmd-ref: {targets: [pens]}}"
    for _ in range(12):
        deep = "{properties: {in: %s}}" % deep
    config = "collections:\n  pens: {match: ['pens/*', 'both/*']}\n  inks: {match: ['inks/*', 'both/*']}\n  pots:\n    match: ['pots/*']\n    schema: {properties: {d: %s, n: {x-vmd-ref: {targets: []}}, any: {x-vmd-ref: {}}}}\n" % deep
    nested = lambda v: '{"in":' * 12 + f'"{v}"' + "}" * 12
    files = {"pens/a.json": "{}", "inks/a.json": "{}", "both/a.json": "{}", **{f"pots/{k}.json": f'{{"d": {nested(v)}}}' for k, v in (("1", "../pens/a.json"), ("2", "../inks/a.json"), ("3", "../both/a.json"))}, "pots/4.json": '{"n": "../pens/a.json", "any": "../inks/a.json"}'}
    issues = Store.of(spark, {".vmd/config.yaml": config} | files).check().where("code = 'ref-target-not-allowed'").collect()
    assert sorted((r["path"], r["message"]) for r in issues) == [("pots/2.json", "../inks/a.json"), ("pots/3.json", "../both/a.json"), ("pots/4.json", "../pens/a.json")]
