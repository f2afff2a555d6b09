"""The pipeline against plain Python, stage by stage and as a whole."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_decontam import brute as brute_decontam  # noqa: E402
from test_mixing import brute as brute_mix  # noqa: E402
from test_quality import brute as brute_quality  # noqa: E402
from test_simhash import brute_components  # noqa: E402


def corpus():
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghijklm", k=r.randint(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, text(20)) for i in range(5)]
    rows = []
    for i in range(120):
        kind = r.random()
        if kind < 0.15 and rows:
            t = r.choice(rows)[1]
        elif kind < 0.25:
            t = text(30) + " " + r.choice(items)[1] + " " + text(30)
        elif kind < 0.35:
            t = text(5)
        elif kind < 0.45:
            t = "again and again the same eight words here " * 9
        else:
            t = text(r.randint(40, 120))
        rows.append((i, t, r.choice(["en", "de"]), f"s{r.choice([0, 0, 0, 1, 2])}"))
    return rows + [(200, None, "en", "s0"), (201, "", None, None), (7, *rows[7][1:])], items


def test_equals_brute_force(spark, docs_of, tmp_path):
    rows, items = corpus()
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    measured = [(x, brute_quality(x[1])) for x in rows]
    kept = [x for x, (n, chars, symbols, lines, repeats) in measured if n >= 20 and 100 * repeats <= 30 * n and chars <= 10 * n and chars >= 2 * n and 10 * symbols <= n and 10 * lines <= 3 * 1 and 10 * x[1].count("!") <= 3 * n]
    least = {}
    for _, d, _, c in brute_components([x[:2] for x in kept]):
        least.setdefault(c, d)
    unique = {x[0]: x for x in kept if x[0] in least}
    clean = [x for x in unique.values() if brute_decontam([x[:2]], items)[0][3] == 0]
    mixed = brute_mix(clean, seed=corpus_pipeline.SEED)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(str(r["doc_id"]) for r in got) == Counter(d for d, *_ in mixed)
    assert 0 < len(clean) < len(unique) < len(kept) < len(rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_stages_keep_the_columns_of_documents(spark, docs_of, tmp_path):
    rows, items = corpus()
    docs = docs_of(rows)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("k", range(5))
def test_empty_input(spark, docs_of, tmp_path, k):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.STAGES[k][1](spark, docs_of([]), str(tmp_path)).count() == 0
