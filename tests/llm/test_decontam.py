import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            wins.setdefault(tuple(w[k : k + 8]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                ids = wins.get(tuple(w[k : k + n]))
                if ids is not None:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in ids if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def run(spark, docs_of, docs, items):
    got = decontam.contamination(docs_of(docs), items_of(spark, items))
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()), key=str)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog, again and again."), (2, "fox jumps over the lazy dog again and again"), (10, "Short one"), (11, "Ünïcode É word"), (12, ""), (13, None), (14, "..."), (None, "a nameless item of the benchmark with eight or more words"), (2, "fox jumps over the lazy dog again and again")]
DOCS = [
    (1, "x the QUICK brown-fox jumps over the lazy dog! again and again. y"), (2, "short ONE short one"), (3, "ünïcode É word"), (4, "Ünïcode É WORD Ünïcode É word"), (5, None), (6, ""), (7, "nothing here"),
    (8, "a nameless item of the benchmark with eight or more words"), (8, "a nameless item of the benchmark with eight or more words"), (8, "another text"), (None, "short one"), (9, "short " * 3000 + "one"), (10, "one short"), (11, "quick brown fox jumps over the lazy"),
]


@pytest.mark.parametrize(("docs", "items"), [(DOCS, ITEMS), (DOCS, []), ([], ITEMS), (DOCS, [(1, "short"), (2, "one"), (3, "short short")])])
def test_equals_brute_force(spark, docs_of, docs, items):
    assert run(spark, docs_of, docs, items) == brute(docs, items)


@pytest.mark.parametrize("words_held", [1, 100])
def test_random_texts_beyond_the_broadcast(spark, docs_of, monkeypatch, words_held):
    """Few distinct words, so that windows overlap and repeat; the shuffle gives the same rows."""
    r = random.Random(1)
    text = lambda n: " ".join(r.choices("ab", k=n))
    docs = [(i, text(r.randint(0, 60))) for i in range(60)]
    items = [(i, text(r.choice([1, 3, 8, 9, 12]))) for i in range(12)]
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 5)
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", words_held)
    assert run(spark, docs_of, docs, items) == brute(docs, items)


def test_removal_keeps_clean_documents_and_columns(spark, docs_of):
    docs = docs_of(DOCS).withColumn("Text_Key", F.lit(1)).withColumn("text_bytes", F.lit("b")).withColumn("items", F.lit(2))
    items = items_of(spark, ITEMS)
    kept = decontam.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    want = [d for d, t in DOCS if next(x for x in brute([(d, t)], ITEMS))[3] < 1]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, want))
