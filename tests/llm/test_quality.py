import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 50, "a a a a a a a a a", "é ü # * | <b> naïve\nline\nline\n\n \nline x",
    "the same eight words stand here two times now. the same eight words stand here two times now. tail", "p q r s t u v w x y z " * 3, "BIG!! LOUD!! WORDS!! " * 20,
    " ".join(f"w{i}" for i in range(3000)) + " " + " ".join(f"w{i}" for i in range(100, 140)), "no break\x0b\x0c\rhere \xa0 nbsp", "😀 😀 " * 9,
]


def test_measurements_equal_brute_force(docs_of):
    rows = list(enumerate(TEXTS)) + [(3, "one"), (None, "null id")]
    got = quality.ledger(docs_of(rows)).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in got) == sorted(str((d, *brute(t))) for d, t in rows)
    for r in got:
        bits = (r["n_words"] < 20) + 2 * (100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["fail_bits"] & 3 == bits


def test_empty_table(docs_of):
    assert quality.ledger(docs_of([])).count() == 0
    assert quality.filter_quality(docs_of([])).count() == 0


def test_filter_keeps_columns_and_clean_documents(docs_of):
    clean = "This is a plain text of some length that no rule has anything against, written with ordinary words and marks. It has a second sentence, too."
    docs = docs_of([(1, clean), (2, "short"), (3, clean), (3, clean)]).withColumn("N_WORDS", F.lit("mine")).withColumn("fail_bits", F.lit(9))
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["N_WORDS"], r["fail_bits"]) for r in kept.collect()) == [(1, "mine", 9), (3, "mine", 9), (3, "mine", 9)]


@pytest.mark.parametrize("policy", [quality.BASE, quality.STRICT])
def test_ablation_equals_brute_force(docs_of, policy):
    rows = quality.ledger(docs_of(list(enumerate(TEXTS * 2)))).cache()
    bits = [r["fail_bits"] for r in rows.collect()]
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablation(rows, (policy,)).collect()}
    for rule in policy.rules:
        b = quality.BIT[rule]
        want = (sum(bool(x & b) for x in bits), sum(x & policy.mask == b for x in bits))
        assert got.get(rule, (0, 0)) == want
