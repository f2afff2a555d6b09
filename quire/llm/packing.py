"""Sharding (3): best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are summed up in the cluster. What the packing sees is a histogram of a proven size: groups of
at least 1/LARGE of all bytes one by one (at most LARGE of them), smaller ones in size classes of seven significant
bits (at most 128 a power of two). Packing runs over the classes in falling size, each group going to the bin
with the tightest remaining capacity that holds it, found in a balanced tree; groups of a class are interchangeable,
so a class's placement is a few runs of ranks. Runs are joined back by class and rank, and slots are numbered in
parts, so that no task ever holds a whole shard, class or group.

Defined results: a null text has no bytes (size 16, crc32 0) and is grouped with empty texts; equal rows get
slots of their own; a group larger than an even share gets a shard to itself and the others share the rest evenly;
an empty table gives an empty result; columns of the input beyond doc_id and text are not read, so any name may
clash. With a fixed capacity a class counts by its largest group, so that no shard is overfilled: it holds more than
its capacity only if that is one group. Ties between classes and groups are broken by size and hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

OVERHEAD = 16
#: Groups of at least 1/LARGE of all bytes are packed one by one.
LARGE = 4096
#: Rows numbered by one task, on average.
PART_ROWS = 50_000
#: Runs of a plan up to which it is broadcast (32 bytes each); beyond, plan and groups meet in a shuffle by class.
BROADCAST_RUNS = 1_000_000


class CapacityTree:
    """Balanced search tree (a treap with fixed pseudo-random priorities) of (room, bin)."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: tuple | None = None  # (key, priority, left, right), never changed in place

    def add(self, room: int, name: int) -> None:
        low, high = self._split(self.root, (room, name))
        self.root = self._merge(self._merge(low, ((room, name), hash((room, name, 0x9E3779B9)), None, None)), high)

    def pop_at_least(self, room: int) -> tuple[int, int] | None:
        """The smallest (room, bin) with this much room, taken out; None if no bin has it."""
        low, high = self._split(self.root, (room, -1))
        if high is None:
            return None
        least = high
        while least[2] is not None:
            least = least[2]
        key = least[0]
        _, rest = self._split(high, (key[0], key[1] + 1))
        self.root = self._merge(low, rest)
        return key

    @classmethod
    def _split(cls, node: tuple | None, key: tuple) -> tuple:
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        k, p, left, right = node
        if k < key:
            a, b = cls._split(right, key)
            return (k, p, left, a), b
        a, b = cls._split(left, key)
        return a, (k, p, b, right)

    @classmethod
    def _merge(cls, a: tuple | None, b: tuple | None) -> tuple | None:
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], cls._merge(a[3], b))
        return (b[0], b[1], cls._merge(a, b[2]), b[3])


Runs = list[tuple[int, int, int, int]]


def best_fit(classes: list[tuple[int, int, int]], capacity: int, limit: int | None = None) -> tuple[Runs | None, int]:
    """Runs (class, first rank, end rank, bin) for classes (key, size, count) of falling size, and bins used.

    None if more than limit bins of this capacity would be needed. A group above the capacity opens a bin alone.
    """
    tree, runs, bins = CapacityTree(), [], 0
    for key, size, count in classes:
        at = 0
        while at < count:
            got = tree.pop_at_least(size)
            if got is None:
                if limit is not None and bins >= limit:
                    return None, bins
                got, bins = (max(capacity, size), bins), bins + 1
            room, name = got
            take = min(count - at, room // size)
            runs.append((key, at, at + take, name))
            at += take
            if room > take * size:
                tree.add(room - take * size, name)
    return runs, bins


def pack_evenly(classes: list[tuple[int, int, int]], shards: int) -> Runs:
    """best_fit() at the smallest capacity found that needs no more than shards bins.

    Groups above an even share of what remains take a bin each first; they can't be cut.
    """
    classes, alone, left = list(classes), [], shards
    total = sum(s * n for _, s, n in classes)
    at = 0
    placed = [0] * len(classes)
    while at < len(classes) and left > 1 and classes[at][1] * left > total:
        key, size, count = classes[at]
        if placed[at] == count:
            at += 1
            continue
        alone.append((key, placed[at], placed[at] + 1, shards - left))
        placed[at] += 1
        left, total = left - 1, total - size
    rest = [(k, s, n - p, p) for (k, s, n), p in zip(classes, placed, strict=True) if n > p]
    if not rest:
        return alone
    plain = [(k, s, n) for k, s, n, _ in rest]
    low, high, best = -(-total // left), max(total, 1), None
    step = max(1, low // 40_000)  # what is left over adds up in the last bin
    reach = step
    while best is None:  # widen until it fits: usually at once, as small groups come last
        best, _ = best_fit(plain, low + reach, left)
        high, reach = low + reach, reach * 4
    while high - low > step:
        mid = (low + high) // 2
        runs, _ = best_fit(plain, mid, left)
        low, high, best = (low, mid, runs) if runs is not None else (mid, high, best)
    skipped = {k: p for k, _, _, p in rest}
    return alone + [(k, a + skipped[k], b + skipped[k], shards - left + name) for k, a, b, name in best]


def _class_of(size: Column, large: int) -> Column:
    """Groups of at least `large` bytes by their size, others by the seven leading bits of it."""
    shift = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    return F.when(size >= large, size).otherwise(F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift))


def _ranked(df: DataFrame, by: str, order: list[str | Column], salt: Column, rank: str) -> DataFrame:
    """df with a gapless rank from 0 among the rows of equal `by`, numbered in salted parts."""
    salted = df.withColumn("_part", salt)
    counts = salted.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(by, "_part").orderBy(*order)
    return salted.withColumn("_i", F.row_number().over(within) - 1).join(offsets, [by, "_part"]).withColumn(rank, F.col("_base") + F.col("_i")).drop("_part", "_n", "_i", "_base")


def shard(docs: DataFrame, shards: int = 40, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    With a capacity, as few shards of that many bytes as best fit finds; else `shards` shards of near equal bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = checkpointed(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_key")))
    same = ["text_key", "text_crc32", "size"]
    groups = checkpointed(rows.groupBy(*same).agg(F.count("*").alias("copies"), F.sum("size").alias("bytes")))
    n_rows, total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    classed = groups.withColumn("class", _class_of(F.col("bytes"), max(1, total // LARGE)))
    classes = classed.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most")).orderBy(F.desc("class")).collect()
    sized = sorted(((r["class"], r["most"] if capacity else -(-r["bytes"] // r["n"]), r["n"]) for r in classes), key=lambda c: (-c[1], -c[0]))
    runs = best_fit(sized, capacity)[0] if capacity else pack_evenly(sized, shards)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(k, a, b, s) for k, a, b, s in runs], "class long, low long, high long, shard int")
    # As many parts as keep a task to PART_ROWS rows, were all rows in one class or shard.
    parts = max(1, -(-n_rows // PART_ROWS))
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(parts))
    ranked = _ranked(classed, "class", same, salt("text_key", F.lit(1)), "rank").alias("g")
    # For a number of shards the plan has at most (classes x shards) runs, whatever the input.
    on = (F.col("g.class") == F.col("p.class")) & (F.col("g.rank") >= F.col("p.low")) & (F.col("g.rank") < F.col("p.high"))
    placed = ranked.join((F.broadcast(plan) if len(runs) <= BROADCAST_RUNS else plan).alias("p"), on).select("text_key", "text_crc32", "size", "shard")
    sharded = checkpointed(rows.join(placed, same).select("doc_id", "size", "text_crc32", "text_key", "shard"))
    return _ranked(sharded, "shard", ["doc_id", "text_key", "text_crc32", "size"], salt("doc_id", "text_key", F.lit(2)), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
