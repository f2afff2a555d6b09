"""Benchmark decontamination (10) as a prefix-filtered set join.

A window (eight consecutive item words, or a whole shorter item) can only occur in a document that has all its
words, so one necessary token is enough to find it: the rarest one, by counts over all documents. Document words
meet those tokens in a map-side join, the token's offset in the window bounds where the window can lie, and the
words there are compared one by one. No pair of documents and items is made but where that token occurs. Windows beyond a
broadcast's bound meet the documents' words in a shuffle instead, and the places found return to their texts to be
compared; the documents are read three times then, however many windows there are.

Defined results: null text and texts without words have no words and no hits; an empty benchmark hits nothing;
items without words have no windows; items with a null id hit words but aren't counted as items; equal items are
counted by their ids. Repeated documents each get their row. Very long texts are split in the JVM, one row at a time.
Further columns may have any name; remove_contaminated() returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, free_name, words_of

WINDOW = 8
#: After lower-casing A-Z, all ASCII but digits and a-z separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to which they are broadcast (about 100 bytes each), and distinct words of windows (about 30).
BROADCAST_WINDOWS = 500_000
BROADCAST_WORDS = 1_000_000
#: No word can hold this, so it stands for the document itself in the stream of its words.
SELF = "\x00"


def _words(text: Column) -> Column:
    return words_of(ascii_lower(text), SEPARATORS)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and window (array of words) of every distinct window of every item."""
    n = F.size("w")
    starts = F.when(n >= size, F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))).when(n > 0, F.array(F.lit(1)))
    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), _words(F.col("text")).alias("w"))
        .select("item_id", "w", F.explode(starts).alias("at"))
        .select("item_id", F.slice("w", F.col("at"), size).alias("window"))
        .distinct()
    )


def _tokens(stream: DataFrame, wins: DataFrame) -> DataFrame:
    """token, offset, window and ids of every window: its rarest word over all documents, ties by the word itself."""
    vocabulary = wins.select(F.explode("window").alias("word")).distinct()
    small = vocabulary.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    spoken = stream.select(F.explode("words").alias("word"))
    # Counted before the shuffle either way: with the vocabulary at hand, or all words and the vocabulary afterwards.
    counts = (spoken.join(F.broadcast(vocabulary), "word") if small else spoken).groupBy("word").agg(F.count("*").alias("n_found"))
    ranked = wins.select("window", "ids", F.posexplode("window").alias("offset", "word")).join(counts, "word", "left")
    rare = F.struct(F.coalesce("n_found", F.lit(0)).alias("n"), F.col("word"), F.col("offset"))
    return checkpointed(ranked.groupBy("window").agg(F.first("ids").alias("ids"), F.min(rare).alias("t")).select(F.col("t.word").alias("token"), F.col("t.offset").alias("offset"), "window", "ids"))


KEY = ("doc_id", "text_key", "text_bytes")


def _met(stream: DataFrame, tokens: DataFrame) -> DataFrame:
    """Verified occurrences and the documents themselves, by a broadcast of the windows: one scan."""
    itself = stream.sparkSession.range(1).select(F.lit(SELF), F.lit(0), F.array().cast("array<string>"), F.array().cast("array<string>"))
    placed = stream.select(*KEY, F.size("words").alias("n_words"), "words", F.posexplode(F.concat("words", F.array(F.lit(SELF)))).alias("pos", "word"))
    # Bounds first, then the words one by one; all of it inside the join, so that only verified hits leave it.
    start, n = F.col("pos") - F.col("offset"), F.size("window")
    same = F.slice("words", F.greatest(start + 1, F.lit(1)), n) == F.col("window")
    on = (F.col("word") == F.col("token")) & ((F.col("token") == SELF) | ((start >= 0) & (start + n <= F.col("n_words")) & same))
    span = F.when(n > 0, F.struct(start.alias("start"), n.alias("n")))
    return placed.join(F.broadcast(tokens.union(itself)), on).select(*KEY, "n_words", (F.col("token") == SELF).alias("own"), span.alias("span"), F.when(n > 0, F.col("ids")).alias("ids"))


def _met_by_shuffle(stream: DataFrame, tokens: DataFrame) -> DataFrame:
    """As _met(): words and tokens meet in a shuffle, without the texts, and the places found go back to them."""
    n = F.size("window")
    spoken = stream.select(*KEY, F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word"))
    start = F.col("pos") - F.col("offset")
    near = (F.col("word") == F.col("token")) & (start >= 0) & (start + n <= F.col("n_words"))
    places = spoken.join(tokens, near).select(*KEY, start.alias("start"), "window", "ids").distinct().alias("p")
    texts = stream.dropDuplicates(["doc_id", "text_key", "text_bytes"]).alias("s")
    same_text = F.col("s.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("s.text_key").eqNullSafe(F.col("p.text_key")) & F.col("s.text_bytes").eqNullSafe(F.col("p.text_bytes"))
    found = places.join(texts, same_text & (F.slice("s.words", F.col("p.start") + 1, n) == F.col("window")))
    hit = found.select(*(F.col(f"p.{c}") for c in KEY), F.size("s.words").alias("n_words"), F.lit(False).alias("own"), F.struct("p.start", n.alias("n")).alias("span"), "ids")
    none = F.lit(None)
    return hit.union(stream.select(*KEY, F.size("words"), F.lit(True), none.cast("struct<start:int,n:int>"), none.cast("array<string>")))


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per distinct (doc_id, text): n_copies, n_words, spans (distinct start and length), items (sorted ids)."""
    wins = checkpointed(windows(items, size).groupBy("window").agg(F.collect_set("item_id").alias("ids")))
    stream = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), F.octet_length("text").alias("text_bytes"), _words(F.col("text")).alias("words"))
    tokens = _tokens(stream, wins)
    small = wins.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    found = (_met if small else _met_by_shuffle)(stream, tokens)
    grouped = found.groupBy(*KEY).agg(F.max("n_words").alias("n_words"), F.count_if("own").alias("n_copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("ids").alias("ids"))
    return grouped.select(*KEY, "n_copies", "n_words", "spans", F.array_sort(F.array_distinct(F.flatten("ids"))).alias("items"))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["start"] + s["n"])
        return F.struct((acc["n"] + (end - F.greatest(acc["end"], s["start"]))).alias("n"), end.alias("end"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, min_items: int = 2) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_items = F.size("items").cast("long")
    return (
        hits(docs, items, size)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), _covered(F.col("spans")).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"))
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, min_items: int = 1) -> DataFrame:
    """docs without the rows that have windows of min_items items or more; same columns, no other change."""
    found = hits(docs, items, size).where(F.size("items") >= min_items).select("doc_id", "text_key", "text_bytes").distinct()
    key, size_name = free_name(docs, "text_key"), free_name(docs, "text_bytes")
    keyed = docs.withColumns({key: F.xxhash64("text"), size_name: F.octet_length("text")})
    on = keyed["doc_id"].eqNullSafe(found["doc_id"]) & keyed[key].eqNullSafe(found["text_key"]) & keyed[size_name].eqNullSafe(found["text_bytes"])
    return keyed.join(found, on, "left_anti").select(*(keyed[f"`{c}`"] for c in docs.columns))
