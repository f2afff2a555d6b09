"""Language ID (6): word-first backoff.

A known word scores by its log frequency in each language. An unseen word backs off to its character n-grams,
from the longest length down: the first length at which any of its n-grams is known decides. A text's score is the
mean over its words; the prediction is the best language and the score its share after a softmax.

Training reads a bounded sample: at most about SAMPLE documents a language (drawn by a hash of doc_id at a rate set by
the language's own count) out of the rows with crc32(doc_id as text) mod 5 other than 0 and a known language. Words and
n-grams of the sample are counted in the cluster, and every one that it has LEAST times or more is known; the sample bounds the
model that is broadcast. Prediction reads whole texts, in Arrow batches, with a bounded cache of words.

Defined results: a null text or one without letters is `und` with score 0; null languages and null doc_ids aren't
learned from, and a null doc_id isn't held out; without any labelled row all predictions are `und`; ties go to the
smaller language name; repeated rows are predicted alike. Words are runs of letters (Unicode category L) of any length, in
training and prediction alike; very long ones are scored like others and only kept out of the cache. Only doc_id, text
and lang are read, so further columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import category
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_least_parallel, checkpointed

SAMPLE = 4_000
#: Occurrences in the sample from which a word or n-gram is known; once is no evidence of a language.
LEAST = 2
LENGTHS = (5, 4, 3, 2, 1)
FOLDS = 5
#: Languages up to which their counts are broadcast; beyond, the sample is drawn by a shuffle join.
BROADCAST_LANGUAGES = 10_000
#: Words whose scores a Python worker keeps; it starts over beyond.
CACHE = 300_000
#: Longer words (runs of letters without a break) aren't kept in the cache.
LONG = 64
LETTERS = re.compile(r"[^\W\d_]+")
#: What LETTERS takes beside letters: numbers of the categories No and Nl, all of them below U+20000.
NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x20000)) if category(c) in ("No", "Nl")) + "]")
#: Weight of the prior count of a language for an entry that it lacks.
SMOOTH = 0.5


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of doc_id as text, modulo folds; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """lang and text of about per_language training documents of each language (all, if there are fewer)."""
    rows = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
    counts = checkpointed(counts)
    small = counts.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    counts = F.broadcast(counts) if small else counts
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(1_000_003)) < F.lit(1_000_003.0 * per_language) / F.col("n")
    return rows.join(counts, (F.col("lang") == F.col("l")) & drawn).select("lang", "text")


def train(docs: DataFrame, per_language: int = SAMPLE) -> dict:
    """Sorted languages, known (entry -> row; an entry starts with w or its length) and table (row -> log frequencies)."""
    words = sample(docs, per_language).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))

    def grams(n: int) -> Column:
        """All n-grams, in one pass: each match takes one character and captures n."""
        return F.transform(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), lambda g: F.concat(F.lit(str(n)), g))

    pieces = F.concat(F.array(F.concat(F.lit("w"), F.col("word"))), *map(grams, LENGTHS))
    entries = checkpointed(counted.select("lang", "n", F.explode(pieces).alias("entry")).groupBy("lang", "entry").agg(F.sum("n").alias("n")))
    totals = entries.groupBy("lang", F.substring("entry", 1, 1).alias("kind")).agg(F.sum("n").alias("total"))
    common = entries.groupBy("entry").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST).select("entry")
    top = entries.join(common, "entry")
    total = {(r["lang"], r["kind"]): r["total"] for r in totals.collect()}
    languages = sorted({lang for lang, _ in total})
    at = {lang: i for i, lang in enumerate(languages)}
    known: dict[str, int] = {}
    table = np.zeros((4096, len(languages)), dtype=np.float32)
    for lang, entry, n in top.select("lang", "entry", "n").toLocalIterator(prefetchPartitions=True):
        row = known.setdefault(entry, len(known))
        if row == len(table):
            table = np.vstack([table, np.zeros_like(table)])
        table[row, at[lang]] = n
    table = table[: len(known)]
    for kind in ("w", *map(str, LENGTHS)):
        rows = np.array([i for e, i in known.items() if e[0] == kind], dtype=np.int64)
        sizes = np.array([max(total.get((lang, kind), 0), 1) for lang in languages], dtype=np.float32)
        table[rows] = np.log((table[rows] + SMOOTH) / (sizes + SMOOTH))
    return {"languages": languages, "known": known, "table": table}


def letters(text: str) -> list[str]:
    """The runs of letters in a text, in lower case."""
    words = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return [piece for word in words for piece in NUMBERS.split(word) if piece]


class Scorer(dict):
    """Word -> row of its scores in a growing table. A text's unseen words are scored together and kept."""

    def __init__(self, model: dict) -> None:
        super().__init__()
        self.known = model["known"]
        self.width = len(model["languages"])
        self.scores = np.vstack([model["table"], np.zeros((1, self.width), dtype=np.float32)])
        self.nothing = [len(self.scores) - 1]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.table = np.zeros((1024, self.width), dtype=np.float32)

    def entries(self, word: str) -> list[int]:
        """Rows of the model that score a word: the word's own, else its known n-grams of the longest length that has any."""
        known = self.known.get
        got = known("w" + word)
        if got is not None:
            return [got]
        padded = f"<{word}>"
        for n in LENGTHS:
            label = str(n)
            found = [g for i in range(len(padded) - n + 1) if (g := known(label + padded[i : i + n])) is not None]
            if found:
                return found
        return self.nothing

    def rows_for(self, words: list[str]) -> np.ndarray:
        """Scores of the words: the mean over their entries."""
        found = [self.entries(w) for w in words]
        sizes = np.array([len(f) for f in found])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(self.scores[[i for f in found for i in f]], starts, axis=0) / sizes[:, None]

    def mean(self, text: str) -> np.ndarray | None:
        """Mean score of the words; None without letters."""
        words = letters(text)
        if not words:
            return None
        if len(self) > CACHE:
            self.reset()
        distinct = set(words)
        new = [w for w in distinct if w not in self and len(w) <= LONG]
        if new:
            first, last = len(self), len(self) + len(new)
            while last > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[first:last] = self.rows_for(new)
            self.update(zip(new, range(first, last), strict=True))
        total = np.zeros(self.width)
        if any(len(w) > LONG for w in distinct):
            total += self.rows_for([w for w in words if len(w) > LONG]).sum(axis=0)
            words_kept = [w for w in words if len(w) <= LONG]
        else:
            words_kept = words
        if words_kept:
            total += self.table[list(map(self.__getitem__, words_kept))].sum(axis=0, dtype=np.float64)
        return total / len(words)


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    languages = model["languages"]
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid4().hex

    def judge(scorer: Scorer, text: str | None) -> tuple[str, float]:
        mean = scorer.mean(text) if text and languages else None
        if mean is None:
            return "und", 0.0
        best = int(np.argmax(mean))
        return languages[best], 1.0 / float(np.exp(np.clip(mean - mean[best], -700, 0)).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:  # kept between the tasks of a worker
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer = _SCORERS[name]
        for batch in batches:
            out = [judge(scorer, t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return at_least_parallel(narrow).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """train() on docs, then predict() all of them."""
    return predict(docs, train(docs, per_language))


