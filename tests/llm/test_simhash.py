import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import simhash


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows):
    fps = {i: brute_fingerprint(t) for i, (_, t) in enumerate(rows)}
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d is None, d or 0, f"{fps[i]:016x}", least.get(root(i), -1)) for i, (d, _) in enumerate(rows)))


def sample(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(1, 6))) for _ in range(80)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            words = r.choice(rows)[1].split(" ")
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 4, 40, 300])))))
    return rows


EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "a b c"), (905, "a b c"), (None, "a b c"), (None, "lonely text of a null id"), (906, "É x\x0by z"), (907, "é x y z")]


@pytest.mark.parametrize("rows", [sample(150), sample(60, 2) + EDGES, EDGES, []])
def test_components_equal_brute_force(docs_of, rows):
    got = simhash.near_duplicates(docs_of(rows))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in got.collect()) == brute_components(rows)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(i * i) for i in range(5000))
    monkeypatch.setattr(simhash, "CHUNK", 97)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_tree_finds_all_within_the_radius():
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(50)}
    values |= {v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in values}
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values:
        assert set(tree.within(q, 4)) == {v for v in values if (v ^ q).bit_count() <= 4}


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_links_in_parts_and_at_any_number_of_blocks(spark, monkeypatch, blocks):
    """One dense cluster, cut into many parts, and several block numbers give the same components."""
    r = random.Random(5)
    centre = r.getrandbits(64)
    values = {centre}
    while len(values) < 120:
        values.add(r.choice(sorted(values)) ^ sum({1 << r.randrange(64) for _ in range(3)}))
    values |= {r.getrandbits(64) for _ in range(30)}
    monkeypatch.setattr(simhash, "SHARD_PART", 7)
    monkeypatch.setattr(simhash, "blocks_for", lambda n, radius: blocks)
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {row["node"]: row["root"] for row in simhash.components(simhash.links(fps)).collect()}
    label = {v: v for v in values}
    for _ in range(len(values)):
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
    groups = {}
    for v in values:
        groups.setdefault(label[v], set()).add(simhash.signed(v))
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert got == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_document_of_each_group_stays(docs_of):
    rows = sample(80, 4) + EDGES
    docs = docs_of(rows).withColumn("TEXT_KEY", F.lit("mine")).withColumn("fp", F.lit(1))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    labels = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(x for x in labels if x is not None)
    assert got.count(None) == (1 if None in labels else 0)
