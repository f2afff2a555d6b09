"""SimHash near-duplicates (2): fingerprints, BK-trees over pigeonhole shards, and connected components.

Two fingerprints within `radius` bits agree on all bits of at least m - radius of m blocks, so each fingerprint is
dealt to one shard per choice of m - radius blocks, keyed by those bits. A shard builds a BK-tree (children keyed by
their Hamming distance to the parent) and each fingerprint follows only edges within the radius. Sharing all trees
by broadcast, as the method is often described, would send every executor the fingerprints of the whole corpus; a
shard's tree is instead built where its rows were dealt. A shard that is too large is cut into salted parts, and
every pair of parts is a task of its own, so no link is lost. Links leave a shard as a star (at most one per
fingerprint), never as all pairs.

Defined results: null or wordless texts have fingerprint zero and are linked like any other; equal rows get equal
results, each its own row; rows with a null doc_id keep their component, and a component of such rows only has a null
id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, at_least_parallel, checkpointed, free_name

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Shingles hashed at once; bounds the memory that one very long text takes.
CHUNK = 1 << 16
#: Fingerprints that a shard should have at most on average, and before it is cut into parts.
SHARD_MEAN = 256
SHARD_PART = 2048
#: Keys of rows up to which they are broadcast (about 60 bytes each); beyond, a filter of them is, and only rows that it lets through are shuffled.
BROADCAST_KEYS = 1_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles of a UTF-8 text, repeats counted; a bit is one if set in over half the hashes."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII white space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    width = min(shingle, len(words))
    lasts = ends[width - 1 :]
    ones, n = np.zeros(64, dtype=np.int64), len(lasts)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = zip(starts[at : at + CHUNK], lasts[at : at + CHUNK], strict=False)
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in part], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (hash of the text) and fp (fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(fingerprint(x.as_py(), shingle)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_key", "fp"])

    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return at_least_parallel(narrow).mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


class BKTree:
    """Metric tree of integers; a node is [value, {distance: child}]."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            below = node[1].get(d)
            if below is None:
                node[1][d] = [value, {}]
                return
            node = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Values at most radius away; a child at distance e from its parent can hold one only if |d - e| <= radius."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                yield node[0]
            children = node[1]
            if len(children) > 2 * radius + 1:
                stack += [c for e in range(d - radius, d + radius + 1) if (c := children.get(e))]
            else:
                stack += [c for e, c in children.items() if d - radius <= e <= d + radius]


def _linked(left: list[int], right: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Stars over the links within left (if right is empty), or between left and right."""
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def join(x: int, y: int) -> None:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)

    for x in left:
        if not right:
            for y in tree.within(x, radius):
                join(x, y)
        tree.add(x)
    for x in right:
        for y in tree.within(x, radius):
            join(x, y)
    return ((x, root(x)) for x in parent)


def masks(blocks: int, radius: int, bits: int = 64) -> list[int]:
    """Bit masks of every choice of blocks - radius of the blocks."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose shards have SHARD_MEAN fingerprints or less on average; any number gives all links."""
    blocks = radius + 1
    while blocks < 2 * radius and n > SHARD_MEAN << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect every two distinct values of fps.fp within radius bits, possibly through others."""
    chosen = masks(blocks_for(fps.count(), radius), radius)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(chosen)))
    keyed = fps.select("fp", F.explode(keys).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > SHARD_PART).withColumn("parts", F.ceil(F.col("n") / SHARD_PART))
    cut = keyed.join(large, "shard", "left").select("fp", "shard", F.coalesce("parts", F.lit(1)).alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    dealt = (
        cut.select("fp", "shard", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        .select("fp", "part", F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")).alias("task"), (F.col("part") <= F.col("other")).alias("first"))
        .repartition("task")
        .sortWithinPartitions("task", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, ([], [])

        def flush(out: list[tuple[int, int]]) -> None:
            left, right = held
            if len(left) + len(right) > 1:
                out += _linked(left, right, radius) if left else _linked(right, [], radius)

        for batch in batches:
            out: list[tuple[int, int]] = []
            for fp, t, first in zip(batch.column(0).to_numpy().view(np.uint64).tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if t != task:
                    flush(out)
                    task, held = t, ([], [])
                held[0 if first else 1].append(fp)
            yield _edges(out)
        out = []
        flush(out)
        yield _edges(out)

    return dealt.select("fp", "task", "first").mapInArrow(run, "a long, b long").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    Alternating large and small stars: each round hangs every node's larger (then smaller) neighbours on its
    smallest one, with the minimum pre-aggregated before the shuffle, until the edges no longer change. Rounds are
    checkpointed; only their count and a hash come to the driver.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        before, seen = seen, state(now)
        if before == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def labelled(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, fp), and (fp, root) of every distinct fingerprint."""
    rows = checkpointed(fingerprints(docs, shingle))
    fps = checkpointed(rows.select("fp").distinct())
    linked = components(links(fps, radius))
    return rows, fps.join(linked, fps["fp"] == linked["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (smallest doc_id reachable) of every row."""
    rows, roots = labelled(docs, shingle, radius)
    smallest = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = smallest.join(roots, "fp")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = roots.join(ids, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component: the one with the smallest doc_id (nulls last; ties by the text's hash)."""
    return keep_one(docs, *labelled(docs, shingle, radius))


def keep_one(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id for each root of (fp, root); rows has (doc_id, text_key, fp)."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))
    best = rows.groupBy("fp").agg(F.min(rank).alias("r"))
    kept = checkpointed(best.join(roots, "fp").groupBy("root").agg(F.min("r").alias("r")).select("r.doc_id", "r.text_key").distinct())
    # Texts stay where they are read: keys go to them, those that stay or, beyond a bound, the fewer of those and the others.
    key = free_name(docs, "text_key")
    keyed, on = docs.withColumn(key, F.xxhash64("text")), {"doc_id": "doc_id", key: "text_key"}
    counted = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    n_kept, keys, found = kept.count(), kept, True
    if n_kept > BROADCAST_KEYS:
        gone = checkpointed(among(counted.drop("n"), {"doc_id": "doc_id", "text_key": "text_key"}, kept, BROADCAST_KEYS, found=False))
        if gone.count() < n_kept:
            keys, found = gone, False
    stays = among(keyed, on, keys, BROADCAST_KEYS, found)
    twice = checkpointed(counted.where("n > 1").join(kept.withColumnsRenamed({"doc_id": "d", "text_key": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("t"))).select("doc_id", "text_key"))
    if twice.limit(1).count() == 0:
        return stays.drop(key)
    repeated = among(stays, on, twice, BROADCAST_KEYS).dropDuplicates(["doc_id", key])
    return among(stays, on, twice, BROADCAST_KEYS, found=False).union(repeated).drop(key)
