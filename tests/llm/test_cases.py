"""Clashing names, bounds that change no result, and capacities over size classes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_mixing import brute as brute_mix

import corpus_pipeline
from quire.llm import langid, mixing, packing, quality, simhash, url_filter


def test_mixing_beside_columns_of_its_own_names(docs_of):
    rows = [(i, "some words " * (i % 7), "en", f"s{i % 3}") for i in range(40)] + [(50, "long text " * 200_000, "en", "s0")]
    docs = docs_of(rows).withColumn("copy", F.lit("mine")).withColumn("Shuffle_Key", F.lit(1.5)).withColumn("mix_n", F.lit(3))
    got = mixing.mix(docs, extras=True)
    assert got.columns == [*docs.columns, "copy_", "shuffle_key_"]
    assert sorted(((str(r["doc_id"]), r["text"], r["copy_"], r["shuffle_key_"]) for r in got.collect()), key=str) == brute_mix(rows)
    assert {(r["copy"], r["Shuffle_Key"], r["mix_n"]) for r in got.collect()} == {("mine", 1.5, 3)}


@pytest.mark.parametrize("runs", [1_000_000, 3])
def test_no_shard_is_above_its_capacity(docs_of, monkeypatch, runs):
    """Groups of many sizes share a class; the class counts by its largest."""
    monkeypatch.setattr(packing, "BROADCAST_RUNS", runs)
    r, capacity = random.Random(3), 20_000
    rows = [(i, f"{i} " + "z" * r.randint(200, 2000)) for i in range(2500)] + [(9000, "h" * 30_000), *((9100 + i, "g" * 900) for i in range(9))]
    got = packing.shard(docs_of(rows), capacity=capacity).collect()
    used = Counter()
    for x in got:
        used[x["shard"]] += x["size"]
    assert len(got) == len(rows)
    assert sorted(n for n in used.values() if n > capacity) == [30_016]
    assert len(used) <= 1.05 * sum(used.values()) / capacity + 1


def test_equal_sizes_are_shared_out_whole(docs_of):
    rows = [(i, f"{i % 50:04d}") for i in range(200)]
    got = packing.shard(docs_of(rows), 5).collect()
    assert len({(x["text_crc32"], x["shard"]) for x in got}) == 50
    assert sorted(Counter(x["shard"] for x in got).values()) == [40] * 5


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(pages, url_filter.rule_table(spark)).count() == 0


def test_many_shapes_of_rules(spark):
    rules = [("block", f"h{i}.example.org", "/" + "p" * i) for i in range(300)]
    pages = spark.createDataFrame([(i, f"http://a.h{i}.example.org/{'p' * (i + i % 2 * 3)}q") for i in range(300)], "page_id long, url string")
    judged = url_filter.judge(pages, url_filter.rule_table(spark, tuple(rules)))
    assert len(judged._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert {(r["page_id"], r["rule"]) for r in judged.collect()} == {(i, h + p) for i, (_, h, p) in enumerate(rules)}


def test_numbers_are_no_letters(docs_of):
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", ("fr", "en")[i % 2], "s") for i in range(40)]
    rows += [(100, "½ ² ① Ⅳ 〇 ٣", None, "s"), (101, "½ the ² cat", None, "s")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs_of(rows).withColumn("lang_pred", F.lit(1))).collect()}
    assert got[100] == ("und", 0.0) and got[101][0] == "en"
    assert langid.letters("Aⅳb½c²日本ñ_1x") == ["a", "b", "c", "日本ñ", "x"]


def test_every_repeated_word_is_known(docs_of):
    """No cap on entries or on a word's length."""
    words = [f"{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}{'abcdefghij'[i // 1000 % 10]}{'abcdefghij'[i // 10000]}" for i in range(40_000)]
    long = "𐌰" + "longword" * 30
    docs = [(i, " ".join(words[k : k + 4000] * 2) + f" {long}", "xx", "s") for i, k in enumerate(range(0, 40_000, 4000))]
    model = langid.train(docs_of(docs * 1).withColumn("doc_id", F.col("doc_id") + 1))
    trained = [d for d in docs if __import__("zlib").crc32(str(d[0] + 1).encode()) % 5]
    want = {w for _, t, *_ in trained for w in t.split()}
    assert len(want) > 30_000 and want == {e[1:] for e in model["known"] if e[0] == "w"}
    padded = f"<{long}>"
    assert {padded[i : i + 5] for i in range(len(padded) - 4)} <= {e[1:] for e in model["known"] if e[0] == "5"}


def test_ablation_of_an_empty_ledger(docs_of):
    got = quality.ablation(quality.ledger(docs_of([]))).collect()
    assert len(got) == sum(len(p.rules) for p in (quality.BASE, quality.STRICT)) and all(r["n_failed"] == r["n_only"] == 0 for r in got)


@pytest.mark.parametrize("bound", [1_000_000, 2])
def test_stages_beside_clashing_columns(spark, docs_of, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", bound)
    spark.createDataFrame([(1, "a passage of exactly eight or more words here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 7))) for _ in range(60))
    rows = [(i, text()) for i in range(12)]
    rows += [(20, rows[0][1]), (20, rows[0][1]), (1, rows[1][1]), (None, rows[2][1]), (30, text() + " a passage of exactly eight or more words here"), (31, " ".join(text() for _ in range(400)))]
    docs = docs_of(rows)
    for name in ("copy", "shuffle_key", "text_key", "text_bytes", "fp", "root", "node", "n_words", "fail_bits", "token", "size", "shard", "slot", "r", "_w"):
        docs = docs.withColumn(name, F.lit("mine"))
    found = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, found, str(tmp_path))
        assert kept.columns == docs.columns
        found = kept
        assert found.where("copy <> 'mine' or root <> 'mine' or size <> 'mine'").count() == 0
    before = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, docs, ""), "")
    assert sorted(x["doc_id"] for x in before.collect()) == [*range(12), 30, 31]
    assert 30 not in {x["doc_id"] for x in corpus_pipeline.decontamination(spark, before, str(tmp_path)).collect()}
    last = corpus_pipeline.sharding(spark, found, "").collect()
    assert len(last) == found.count()
