"""The pipeline's near-duplicate stage against brute-force Jaccard and SimHash links."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_simhash import EDGES, brute_fingerprint

import corpus_pipeline
from quire.llm import similar, simhash
from quire.llm.common import among


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Ids of the documents that stay; null ids as None, one for each component that has only those."""
    sets, fps = [grams(t) for _, t in rows], [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and ((fps[i] ^ fps[j]).bit_count() <= 4 or both and 5 * both >= 4 * len(sets[i] | sets[j])):
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for (d, _), x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append(d)
    return sorted(map(str, (min((d for d in g if d is not None), default=None) for g in groups.values())))


def near_copies(n, seed):
    """Texts, copies of them with a few words replaced (similarities around 0.8) and a passage that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8)))
    passage, rows = " ".join(word() for _ in range(25)), []
    for i in range(n):
        if rows and r.random() < 0.6:
            words = r.choice(rows)[1].split(" ")
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = word()
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(word() for _ in range(r.choice([3, 30, 60, 150]))) + (" " + passage if r.random() < 0.4 else "")))
    return rows


@pytest.mark.parametrize("rows", [near_copies(150, 1), near_copies(80, 2) + EDGES, EDGES, []])
@pytest.mark.parametrize(("frequent", "pairs"), [(100_000, 1_000_000), (3, 2)])
def test_equals_brute_force(spark, docs_of, monkeypatch, rows, frequent, pairs):
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    monkeypatch.setattr(similar, "BROADCAST_PAIRS", pairs)
    got = corpus_pipeline.near_duplicates(spark, docs_of(rows), "")
    assert sorted(str(x["doc_id"]) for x in got.collect()) == brute_kept(rows)


def test_postings_over_batches(spark, docs_of, monkeypatch):
    """The rows of one shingle can lie in several batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = near_copies(60, 3)
        assert sorted(str(x["doc_id"]) for x in corpus_pipeline.near_duplicates(spark, docs_of(rows), "").collect()) == brute_kept(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def shuffled(spark):
    """Bytes that all shuffles of the session have written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def prose(r, n):
    return [f"{r.randrange(16**8):x}" for _ in range(n)]


def test_pairs_that_meet_move_no_whole_sets(spark, docs_of, monkeypatch):
    """Texts that all share a passage meet in all pairs; what is shuffled for them is far less than their sets."""
    r, passage = random.Random(5), prose(random.Random(6), 60)
    rows = [(i, " ".join(w[: (at := r.randrange(600))] + passage + w[at:])) for i, w in ((i, prose(r, 600)) for i in range(100))]
    rows += [(100 + i, rows[i][1].replace(rows[i][1].split(" ")[-1], "x")) for i in range(10)]
    monkeypatch.setattr(similar, "FREQUENT", 0)
    before = shuffled(spark)
    got = corpus_pipeline.near_duplicates(spark, docs_of(rows), "")
    assert sorted(x["doc_id"] for x in got.collect()) == list(range(100))
    assert shuffled(spark) - before < 10 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("copies", [0, 1, 3])
def test_kept_rows_beyond_the_bound_stay_in_place(spark, docs_of, monkeypatch, copies):
    """Beyond the bound of keys only rows that go, and repeated ones, may be shuffled with their texts."""
    r = random.Random(7)
    rows = [(i, " ".join(prose(r, 500))) for i in range(200)]
    every = rows + [(1000 + i, t) for i, t in rows[:20]] + rows[:7] * copies + [(None, t) for _, t in rows[:3]]
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", 2)
    docs = docs_of(every)
    before = shuffled(spark)
    got = simhash.drop_near_duplicates(docs).collect()
    assert sorted((x["doc_id"], x["text"]) for x in got) == rows
    assert shuffled(spark) - before < 0.5 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("bits", [1, 16])
@pytest.mark.parametrize("found", [True, False])
def test_among_beyond_its_bound(spark, monkeypatch, found, bits):
    monkeypatch.setattr("quire.llm.common.FILTER_BITS", bits)
    df = spark.range(20_000).select(F.when(F.col("id") % 100 != 7, F.col("id")).alias("id"), (F.col("id") % 3).cast("string").alias("maybe"), F.lit(1).alias("block_found"))
    keys = df.where("id % 5 = 0 or id is null").select(F.col("id").alias("k"), F.col("maybe").alias("m")).limit(3000)
    keys.cache()
    want = {(x["k"], x["m"]) for x in keys.collect()}
    got = among(df, {"id": "k", "maybe": "m"}, keys, 10, found)
    assert got.columns == df.columns
    key = lambda x: (x["id"] is None, x["id"] or 0, x["maybe"])
    assert sorted(map(key, got.collect())) == sorted(key(x) for x in df.collect() if ((x["id"], x["maybe"]) in want) == found)


def test_sketches_rule_no_similar_pair_out(spark):
    """Bits that differ are never more than shingles that do, over sets of any sizes that can be similar."""
    r, rows, differ = np.random.default_rng(8), [], []
    for n in [1, 2, 5, 63, 64, 65, 100, 127, 128, 129, 300, 1000, 5000]:
        for cut in (0, 1, n // 9, n // 5):
            a = np.unique(r.integers(-(2**63), 2**63 - 1, n + n // 9))
            x, y = a[: max(1, len(a) - cut)], a[n // 9 :]
            rows += [(similar.sketch(x).tolist(), similar.sketch(y).tolist()), (similar.sketch(y).tolist(), similar.sketch(x).tolist())]
            differ += [len(np.setxor1d(x, y))] * 2
    got = [x[0] for x in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a array<long>, b array<long>").coalesce(1).orderBy("i").select(similar._differing("a", "b")).collect()]
    assert all(g <= d and (g > 0 or d % 2 == 0 or not d) for g, d in zip(got, differ, strict=True))
