"""What keeps work and memory in proportion to the input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.checkpointing import checkpointed
from quire.operators import references


def test_a_checkpoint_keeps_no_constraints(spark):
    """Constraints of a loop's rounds grow with a power of their number, and the driver plans for minutes."""
    df = spark.range(20).where("id > 5").select(F.col("id").alias("a"), (F.col("id") > 7).alias("b"))
    kept = checkpointed(df)
    assert kept._jdf.queryExecution().optimizedPlan().constraints().size() == 0
    assert kept.schema == df.schema
    assert sorted(kept.collect()) == sorted(df.collect())


def test_rounds_of_chains_follow_the_longest_one(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(references, "checkpointed", lambda df: rounds.append(1) or checkpointed(df))
    short = [(f"a{i}", f"live{i}", i) for i in range(200)] + [(f"b{i}", f"none{i}", i) for i in range(200)]
    chain = [(f"c{i}", f"c{i + 1}", i) for i in range(5)] + [("c5", "live0", 5)]
    aliases = spark.createDataFrame(short + chain, "source string, target string, line long")
    live = spark.createDataFrame([(f"live{i}",) for i in range(200)], "path string")
    got = {tuple(r) for r in references.alias_chains(aliases, live).collect()}
    assert got == {(f"a{i}", f"live{i}") for i in range(200)} | {(f"c{i}", "live0") for i in range(6)}
    assert len(rounds) <= 5


def test_chains_in_a_circle_end(spark):
    aliases = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("d", "a", 4), ("e", "f", 5), ("f", "x", 6), ("g", "g", 7)], "source string, target string, line long")
    live = spark.createDataFrame([("x",)], "path string")
    assert sorted(tuple(r) for r in references.alias_chains(aliases, live).collect()) == [("e", "x"), ("f", "x")]


def wide(n: int) -> str:
    return "# Top\n\nlead\n" + "".join(f'\n## Part {i}<a id="p{i}"></a>\n\nbody {i}\n' for i in range(n))


def test_a_batch_is_parsed_in_pieces():
    from quire.parse.arrow import PIECE_BYTES, PIECE_ROWS, pieces

    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(3000)]), pa.array([b"x" * (PIECE_BYTES if i == 7 else 3000) for i in range(3000)])], names=["path", "content"])
    got = list(pieces(batch))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or (p.num_rows <= PIECE_ROWS and p.nbytes <= PIECE_BYTES) for p in got)


def test_candidates_of_a_record_are_no_larger_than_the_record():
    from quire.parse.record import candidates, read_record

    size = lambda n: sum(len(str(c["values"])) for c in candidates(read_record("a.md", wide(n).encode()), inherit=False))
    assert size(400) < 5 * size(100)


@pytest.mark.parametrize("fields", [None, {"turns", "part-1", "x/y", "/turns"}])
def test_sections_inherit_what_their_ancestors_have(spark, fields):
    """In the record's row, as candidates() does it with whole maps."""
    from quire.parse.record import candidates, read_record
    from quire.sources.store import Store

    text = "---\nturns: 4\nx:\n  y: top\n---\n\n" + wide(2) + "\n### Deep\n\n```yaml data\nturns: 9\n```\n\n## Last\n\nend\n"
    files = {"a.md": text, "b.json": '{"turns": 1, "$sections": [{"$title": "A", "x": {"y": null}, "$sections": [{"$title": "B"}]}]}'}
    rows = Store.of(spark, files).candidates("nodes", fields).collect()
    got = {(r["path"], r["at"]): {k: [x.asDict() for x in v] for k, v in r["values"].items() if v is not None} for r in rows}
    leaf = lambda x: {k: x.get(k) for k in ("kind", "str", "num", "flag")}
    want = {(p, c["at"]): {k: [leaf(x) for x in v] for k, v in c["values"].items() if fields is None or k in fields} for p, t in files.items() for c in candidates(read_record(p, t.encode()))}
    assert got == want


def test_a_parse_makes_only_what_is_asked_for(spark, monkeypatch):
    from quire.sources import store

    asked = []
    made = store.parse_files
    monkeypatch.setattr(store, "parse_files", lambda files, columns=None: asked.append(columns) or made(files, columns))
    s = store.Store.of(spark, {"a.md": wide(3), "b.md": "# B\n"})
    assert s.anchors.where("kind = 'explicit'").count() == 3
    assert s.get("a.md#p1", "body").collect()[0]["body"] == "body 1"
    assert all("candidates" not in c for c in asked)
    assert set(s._only(["a.md"]).nodes.select("path").distinct().collect()) == {("a.md",)}
    assert s.check().count() == 0
    assert "candidates" not in s._kept.columns


def test_records_of_a_table_are_written_and_read_by_all_cores(spark, tmp_path):
    """A file of one row group is one task of a scan."""
    from quire import catalogue

    spark.range(3000).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "double(id) AS c_acctbal").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = catalogue.queries()["written_and_read"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert got.count() == 18000


def test_references_are_moved_before_their_ancestors_are_listed(spark):
    rows = [(1, "ok", "a", "/x/1"), (1, "ok", "a", "/x/2"), (2, "aliased", "a", "/x/1"), (3, "dangling", "a", "/x/1"), (None, "ok", "b", "/y"), (2, "aliased", "a", "/x/1")]
    got = references.counts_into(spark.createDataFrame(rows, "ref_id long, status string, record string, target_at string"))
    want = {("a", "", 2), ("a", "/x", 2), ("a", "/x/1", 2), ("a", "/x/2", 1), ("b", "", 0), ("b", "/y", 0)}
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    places = {name: i for i, line in enumerate(plan) for name in ("Generate", "RepartitionByExpression") if name in line}
    assert places["Generate"] < places["RepartitionByExpression"]


@pytest.mark.parametrize("most", [1, 2, 1000])
def test_a_step_joins_only_nodes_with_one_of_its_names(spark, monkeypatch, most):
    from quire.operators import resolve

    monkeypatch.setattr(resolve, "MOST_NAMES", most)
    nodes = spark.createDataFrame(
        [("p", "", None, None, 0), ("p", "/a", "", "a", 1), ("p", "/b", "", "b", 2), ("p", "/a/0", "/a", "x", 3), ("p", "/a/1", "/a", "y", 4), ("p", "/b/0", "/b", "x", 5), ("p", "/b/1", "/b", "x", 6)],
        "path string, at string, parent string, step string, doc_order int",
    )
    anchors = spark.createDataFrame([("p", "t", "/a", "explicit")], "path string, name string, at string, kind string")
    asked = [(1, ["a", "x"]), (2, ["b", "x"]), (3, ["t", "y"]), (4, ["a"]), (5, ["c", "x"]), (6, ["a", None])]
    addresses = spark.createDataFrame([(i, "p", "semantic", s) for i, s in asked], "address_id int, path string, kind string, steps array<string>")
    names = resolve.step_names(addresses, 2)
    # Six names of two steps are beyond 2 * 1 and 2 * 2.
    assert names == ([["a", "b", "c", "t"], ["x", "y"]] if most == 1000 else [None, None])
    got = {(r["address_id"], r["at"], r["status"]) for r in resolve.resolve(addresses, nodes, anchors, 2).collect()}
    assert got == {(1, "/a/0", "ok"), (2, "/b/0", "ambiguous"), (2, "/b/1", "ambiguous"), (3, "/a/1", "ok"), (4, "/a", "ok"), (5, None, "not-found"), (6, None, "not-found")}


def test_only_records_with_repeats_are_moved_to_find_them(spark):
    from quire.sources.store import Store

    files = {f"{i}.md": wide(3) for i in range(4)} | {"same.md": "# T\n\n## A\n\na\n\n## A\n\nb\n", "deep.json": '{"a": {"x": 1, "y": [1, 1]}, "b": {"x": 1}}'}
    s = Store.of(spark, files)
    found = {(r["path"], r["code"], r["at"]) for r in s.check().collect()}
    assert found == {("same.md", "duplicate-key", "/$sections/1")}
    assert {r["path"] for r in s._repeating_nodes().collect()} == {"same.md"}
    assert s._repeating("anchors", ["name"], ["at"]).count() == s._repeating("tags", ["at", "tag"]).count() == 0
