import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing


def uniform(kind, seed, doc_id, i):
    return int(hashlib.md5(f"{kind}:{seed}:{'null' if doc_id is None else doc_id}:{i}".encode()).hexdigest()[:13], 16)


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total < u and k < 2000:
        k += 1
        p *= rate / k
        total += p
    return k


def brute(rows, weights=None, default=1.0, seed=0):
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len((text or "").encode())
    w = {s: (weights or {}).get(s, default) for s, b in size.items() if b}
    rate = {s: w[s] / sum(w.values()) * sum(size.values()) / size[s] for s in w}
    out = []
    for d, text, _, source in rows:
        if not rate.get(source):
            continue
        m = max(1, math.ceil(rate[source] / mixing.RATE_PART))
        n = sum(poisson(rate[source] / m, (uniform("count", seed, d, i) + 0.5) / 2**52) for i in range(1, m + 1))
        out += [(str(d), text, c, uniform("order", seed, d, c)) for c in range(n)]
    return sorted(out, key=str)


ROWS = [(i, f"text {i} " * (1 + i % 7), "en", f"s{i % 3}" if i % 11 else None) for i in range(200)] + [(7, "twice", "en", "s0"), (7, "twice", "en", "s0"), (None, "x", "de", "s1"), (900, None, "en", "s2"), (901, "", "en", "empty")]


@pytest.mark.parametrize(("rows", "weights"), [(ROWS, None), (ROWS, {"s0": 5.0, "s1": 0.0}), ([(1, "a" * 5, "en", "tiny"), (2, "b" * 9000, "en", "big")], {"tiny": 1.0, "big": 1.0}), ([], None)])
def test_counts_and_order_equal_brute_force(docs_of, rows, weights):
    docs = docs_of(rows).withColumn("mix_n", F.lit(1)).withColumn("MIX_KEY", F.lit(2))
    got = mixing.mix(docs, weights, extras=True)
    assert got.columns == [*docs.columns, "copy", "shuffle_key"]
    out = got.collect()
    assert sorted(((str(r["doc_id"]), r["text"], r["copy"], r["shuffle_key"]) for r in out), key=str) == brute(rows, weights)
    keys = [r["shuffle_key"] for r in out]
    assert keys == sorted(keys)


def test_shares_come_near_the_weights(docs_of):
    rows = [(i, "w" * 50, "en", "a" if i % 10 else "b") for i in range(4000)]
    got = Counter(r["source"] for r in mixing.mix(docs_of(rows), {"a": 1.0, "b": 3.0}).collect())
    assert abs(got["b"] / sum(got.values()) - 0.75) < 0.03


def test_many_sources_without_a_broadcast(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    out = mixing.mix(docs_of(ROWS), extras=True).collect()
    assert sorted(((str(r["doc_id"]), r["text"], r["copy"], r["shuffle_key"]) for r in out), key=str) == brute(ROWS)
