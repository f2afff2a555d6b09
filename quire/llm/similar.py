"""Near duplicates by SimHash and, beyond its radius, by an exact set join: five-word shingles, Jaccard of 0.8 or more.

SimHash at a small radius finds few of the pairs that are just similar enough, so every pair of distinct texts is also
found by prefix filtering: two sets can only reach the similarity if they share one of the first n - ceil(0.8 n) + 1
of their shingles in one total order, so texts meet by those alone, and each pair that meets is verified over both
whole sets. The order puts shingles that are frequent in a sample of texts last. The sample, like what is broadcast of
it, decides how many pairs meet and never which are found: any total order gives all of them.

Few of the pairs that meet are similar, and there are more of them than texts, so whole sets are only fetched for
pairs whose sketches allow the similarity. A sketch has one bit or two for each shingle, parities of the shingles dealt to
them; two sets differ in as many shingles as their sketches in bits, or in more, so no similar pair is left out.

A pair can reach the similarity only if, at the first shingle that they share, both have enough shingles left in that
order for the overlap that their sizes demand; a meeting whose positions leave too few is none.

Only components matter, so texts that are connected already aren't compared. First each text is verified against the
pivot of every shingle, the text that has it at the earliest position: a text of few shingles of its own, as the
origin of near copies is. That takes large groups of near copies in linear time. Then every pair still apart is.

Defined results: shingles are 64-bit hashes of words as SimHash splits them; a text of fewer than five words is one
shingle, one without words has none and is similar to nothing by this rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import among, at_least_parallel, checkpointed

SHINGLE = 5
#: The least similarity as a fraction of whole numbers, so that the bound itself is exact.
LEAST = (4, 5)
#: Texts sampled for frequent shingles, and frequent shingles that are broadcast (16 bytes each).
SAMPLE = 20_000
FREQUENT = 100_000
#: Pairs to verify, and texts in pairs, up to which they are broadcast (32 bytes each); beyond, only texts to verify are shuffled.
BROADCAST_PAIRS = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles, as signed longs."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, simhash.SEED) for w in words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = out * _PRIME + hashes[i : i + n]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _sets(texts: DataFrame) -> DataFrame:
    """id and set (array of shingles) of every row of (id, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py()) for x in batch.column(1)], pa.list_(pa.int64()))], names=["id", "set"])

    return texts.mapInArrow(run, "id long, set array<long>")


def _frequent(texts: DataFrame, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one sampled text, sorted, and in how many each is."""
    share = max(1, n_texts // SAMPLE)
    sets = _sets(texts.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)).dropDuplicates(["id"])
    counts = sets.select(F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    found, n = counts.column("s").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def _postings(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, place, id) of the prefix of every distinct text, of shingles that two texts or more have there.

    place is the shingle's position in its text's order (from 0) in the high 32 bits, the text's size in the low ones.
    """
    sent = texts.sparkSession.sparkContext.broadcast(frequent)
    num, den = LEAST

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, counts), seen = sent.value, set()
        for batch in batches:
            parts, places, ids, lengths = [], [], [], []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                s = shingles(x.as_py())
                if not len(s):
                    continue
                often = np.zeros(len(s), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[at] == s, counts[at], 0)
                first = s[np.lexsort((s, often))][: len(s) - -(-num * len(s) // den) + 1]
                parts.append(first)
                places.append((np.arange(len(first), dtype=np.int64) << 32) + len(s))
                ids.append(key)
                lengths.append(len(first))
            none = [np.empty(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts or none)), pa.array(np.concatenate(places or none)), pa.array(np.repeat(np.array(ids, dtype=np.int64), lengths))], names=["shingle", "place", "id"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shingle, then id; a row leaves if a neighbour has its shingle and another id."""
        last, last_out = None, True
        for batch in batches:
            s, n, i = (batch.column(k).to_numpy() for k in range(3))
            if not len(s):
                continue
            if last is not None:
                s, n, i = np.concatenate([last[0], s]), np.concatenate([last[1], n]), np.concatenate([last[2], i])
            fresh = np.ones(len(s), dtype=bool)
            fresh[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
            s, n, i = s[fresh], n[fresh], i[fresh]
            both = s[1:] == s[:-1]
            keep = np.zeros(len(s), dtype=bool)
            keep[1:] |= both
            keep[:-1] |= both
            if last is not None:
                was_out, last_out = last_out, bool(keep[-1]) or (len(s) == 1 and last_out)
                keep[0] = keep[0] and not was_out
            else:
                last_out = bool(keep[-1])
            last = s[-1:], n[-1:], i[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(n[keep]), pa.array(i[keep])], names=["shingle", "place", "id"])

    kind = "shingle long, place long, id long"
    return at_least_parallel(texts).mapInArrow(prefixes, kind).repartition("shingle").sortWithinPartitions("shingle", "id").mapInArrow(shared, kind)


def _can_reach(one: str, other: str) -> Column:
    """Whether two places leave enough shingles, this one included, for the overlap that the sizes demand.

    A similar pair passes at the first shingle that it shares, as all that it shares is from there on.
    """
    num, den = LEAST
    size = lambda p: F.col(p).bitwiseAND(F.lit((1 << 32) - 1))
    left = lambda p: size(p) - F.shiftright(p, 32)
    enough = lambda p: left(p) * (num + den) >= (size(one) + size(other)) * num
    return enough(one) & enough(other)


def sketch(s: np.ndarray) -> np.ndarray:
    """Longs of bits, a power of two of them and no fewer than shingles: each is the parity of the shingles that have it as their remainder."""
    bits = 64 << ((len(s) - 1) // 64).bit_length()
    odd = np.bincount(s & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketches(texts: DataFrame) -> DataFrame:
    """id, n (shingles) and sketch of every distinct text of (id, text as binary) that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            ids, sizes, found = [], [], []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key not in seen:
                    seen.add(key)
                    if len(s := shingles(x.as_py())):
                        ids.append(key)
                        sizes.append(len(s))
                        found.append(sketch(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "n", "sketch"])

    return at_least_parallel(texts).mapInArrow(run, "id long, n long, sketch array<long>").dropDuplicates(["id"])


def _differing(one: str, other: str) -> Column:
    """Bits in which two sketches differ, the longer one folded to the other's length; null if it is more than twice as long."""
    xor = lambda p, q: p.bitwiseXOR(q)
    half = lambda p: F.zip_with(F.slice(p, 1, (F.size(p) / 2).cast("int")), F.slice(p, (F.size(p) / 2).cast("int") + 1, (F.size(p) / 2).cast("int")), xor)
    fold = lambda p, q: F.when(F.size(p) > F.size(q), half(p)).otherwise(F.col(p))
    return F.aggregate(F.zip_with(fold(one, other), fold(other, one), xor), F.lit(0), lambda n, p: n + F.bit_count(p))


def _promising(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of ids whose sketches don't rule the similarity out: of |A| + |B| shingles, at most a ninth may be in one set only."""
    num, den = LEAST
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = ids.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    sketches = checkpointed(_sketches(texts.join(F.broadcast(ids), "id", "left_semi") if few else texts))
    of = lambda side: sketches.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    possible = _differing("sketch_a", "sketch_b") * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num)
    return pairs.join(of("b"), "b").join(of("a"), "a").where(F.coalesce(possible, F.lit(True))).select("a", "b", "x", "y")


def _verified(every: DataFrame, first: DataFrame, repeated: bool, pairs: DataFrame) -> DataFrame:
    """(a, b) as the roots x and y of those pairs of ids whose whole sets reach the similarity.

    every has (doc_id, id, text) of all rows, first the smallest doc_id of each text; repeated, if there may be several such
    rows. The sets of all b go to their a, which a star has once for many; a broadcast of the pairs, within its bound,
    makes that the only shuffle of sets.
    """
    num, den = LEAST
    pairs = checkpointed(_promising(every.select("id", "text"), checkpointed(pairs)))
    near = F.broadcast if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else lambda df: df

    def wanted(side: str) -> DataFrame:
        """One row of each text is verified: that of its smallest doc_id, once."""
        rows = among(every, {"doc_id": "least", "id": "text_key"}, checkpointed(first.join(near(pairs.select(F.col(side).alias("text_key")).distinct()), "text_key", "left_semi")), BROADCAST_PAIRS).select("id", "text")
        return _sets(rows.dropDuplicates(["id"]) if repeated else rows)

    left = wanted("a").select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = wanted("b").withColumnsRenamed({"id": "b", "set": "sb"}).join(near(pairs), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    reached = both * (num + den) >= (F.size("sa") + F.size("sb")) * num
    return right.join(left, "a").where(reached).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def joined_roots(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (fp, root) with the components joined that hold texts of at least the least similarity."""
    every = docs.select("doc_id", F.xxhash64("text").alias("id"), F.col("text").cast("binary").alias("text"))
    texts = every.select("id", "text")
    first = checkpointed(rows.groupBy("text_key").agg(F.min("doc_id").alias("least")))
    repeated = rows.groupBy("text_key", "doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    met = checkpointed(_postings(texts, _frequent(texts, rows.count())))
    of_text = rows.join(roots, "fp").select(F.col("text_key").alias("id"), "root").distinct()

    def apart(postings: DataFrame, labels: DataFrame) -> DataFrame:
        """Postings with their root, of shingles that more than one component has, and the pivot of each."""
        placed = postings.join(labels, "id")
        of = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct("place", "id", "root")).alias("p")).where("lo < hi")
        return checkpointed(placed.join(of.select("shingle", "p"), "shingle"))

    now = apart(met, of_text)
    star = now.select(F.col("p.id").alias("a"), F.col("p.root").alias("x"), F.col("p.place").alias("i"), F.col("id").alias("b"), F.col("root").alias("y"), F.col("place").alias("j"))
    one = simhash.components(_verified(every, first, repeated, star.where((F.col("x") != F.col("y")) & _can_reach("i", "j")).select("a", "b", "x", "y").distinct()))

    def relabel(labels: DataFrame) -> DataFrame:
        return labels.join(one.withColumnRenamed("node", "old").withColumnRenamed("root", "new"), F.col("root") == F.col("old"), "left").withColumn("root", F.coalesce("new", "root")).drop("old", "new")

    rest = apart(now.drop("root", "p"), relabel(of_text))
    a = rest.select("shingle", F.col("id").alias("a"), F.col("root").alias("x"), F.col("place").alias("i"))
    b = rest.select("shingle", F.col("id").alias("b"), F.col("root").alias("y"), F.col("place").alias("j"))
    two = simhash.components(_verified(every, first, repeated, a.join(b, "shingle").where((F.col("x") < F.col("y")) & _can_reach("i", "j")).select("a", "b", "x", "y").distinct()))
    out = relabel(roots)
    return out.join(two, out["root"] == two["node"], "left").select("fp", F.coalesce(two["root"], out["root"]).alias("root"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of SimHash links and similar texts: the one with the smallest doc_id."""
    rows, roots = simhash.labelled(docs)
    return simhash.keep_one(docs, rows, joined_roots(docs, rows, roots))
