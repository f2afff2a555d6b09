import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import packing


def check(rows, got, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    text_of = defaultdict(set)
    for r in got:
        text_of[(r["text_crc32"], r["size"])].add(r["shard"])
    assert all(len(s) == 1 for s in text_of.values())


def sample(n, seed=0, hot=0):
    r = random.Random(seed)
    rows = [(i, "x" * int(r.paretovariate(1.2) * 40) + str(r.randrange(n // 2))) for i in range(n)]
    return rows + [(n + i, "the hot text " * 5) for i in range(hot)]


@pytest.mark.parametrize(("rows", "shards"), [(sample(400), 8), (sample(300, 1, 200), 5), ([(1, None), (1, None), (2, ""), (None, "a"), (None, "a"), (3, "a")], 4), ([], 3)])
def test_rows_slots_and_groups(docs_of, monkeypatch, rows, shards):
    monkeypatch.setattr(packing, "PART_ROWS", 37)
    docs = docs_of(rows).withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(1))
    check(rows, packing.shard(docs, shards).collect(), shards)


def test_bytes_are_near_equal(docs_of):
    rows = sample(3000, 2)
    total = Counter()
    for r in packing.shard(docs_of(rows), 10).collect():
        total[r["shard"]] += r["size"]
    largest = max(Counter({t: 0 for _, t in rows}) and [(len(t) + 16) * n for t, n in Counter(t for _, t in rows).items()])
    mean = sum(total.values()) / 10
    assert max(total.values()) <= max(mean * 1.01, largest)
    rest = sorted(total.values())[:-1] if largest > mean else sorted(total.values())
    assert max(rest) - min(rest) <= 0.02 * mean


def test_a_group_above_an_even_share_is_alone(docs_of):
    rows = [(i, "hot" * 50) for i in range(60)] + [(100 + i, f"text {i}") for i in range(100)]
    got = packing.shard(docs_of(rows), 4).collect()
    hot = {r["shard"] for r in got if r["doc_id"] < 100}
    assert len(hot) == 1 and not hot & {r["shard"] for r in got if r["doc_id"] >= 100}
    counts = Counter(r["shard"] for r in got if r["doc_id"] >= 100)
    assert len(counts) == 3 and max(counts.values()) - min(counts.values()) <= 2


def brute_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b >= s]
        if fits:
            tightest = min(fits)
            bins.remove(tightest)
            bins.append(tightest - s)
        else:
            bins.append(max(capacity, s) - s)
    return len(bins), sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(20, 100))
def test_best_fit_decreasing_equals_brute_force(sizes, capacity):
    classes = sorted(((s, s, n) for s, n in Counter(sizes).items()), reverse=True)
    runs, bins = packing.best_fit(classes, capacity)
    used = Counter()
    for key, a, b, name in runs:
        used[name] += key * (b - a)
    room = sorted(max(capacity, used[n]) - used[n] for n in range(bins))
    assert (bins, room) == brute_best_fit(sizes, capacity)


def test_fewest_shards_of_a_capacity(docs_of):
    rows = [(i, "y" * 84 + str(i % 10)) for i in range(30)]
    got = packing.shard(docs_of(rows), capacity=303).collect()
    assert len({r["shard"] for r in got}) == 10
