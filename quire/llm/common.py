"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpointing import checkpointed  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Words as runs of bytes other than the six ASCII white space characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a broadcast filter for each of its keys, and of all of it (32 MB); fewer for each let more rows through.
FILTER_BITS = 16
MOST_BITS = 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in sf_dir; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda variable is never inlined, a projected column may be."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; pure ASCII texts take the cheaper function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, separators: str = SPACE) -> Column:
    """Array of the non-empty pieces between separators; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators, -1), "")


def spread(*keys: Column) -> Column:
    """A 64-bit hash for dealing rows out; equal keys get equal values."""
    return F.xxhash64(*keys)


def at_least_parallel(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer (one file with one row group, say).

    Only a plan without a shuffle is asked: an adaptive one would have to run to know.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores added until df has no such column (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def may_be_among(df: DataFrame, name: str, hashed: Column, keys: DataFrame) -> DataFrame:
    """df with a boolean column `name`, false only where the hash of the row is none of keys.h: a broadcast of bits, in place of keys."""
    bits = min(MOST_BITS, 1 << (FILTER_BITS * max(1, keys.count()) - 1).bit_length())
    place = lambda h: F.pmod(F.xxhash64(h), F.lit(bits))
    block, word, bit = (lambda at: F.shiftright(at, 12)), (lambda at: F.shiftright(at, 6).bitwiseAND(F.lit(63)).cast("int")), (lambda at: at.bitwiseAND(F.lit(63)).cast("int"))
    at, found = place(F.col("h")), free_name(df, "block_found")
    words = keys.groupBy(block(at).alias(found), word(at).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(at))).alias("bits"))
    held = free_name(df, "block_words")
    blocks = words.groupBy(found).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of")).select(found, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("of")[i], F.lit(0).cast("long"))).alias(held))
    here = free_name(df, "block_place")
    placed = df.withColumn(here, place(hashed))
    maybe = F.coalesce(F.getbit(F.col(held)[word(F.col(here))], bit(F.col(here))) == 1, F.lit(False))
    return placed.join(F.broadcast(blocks), block(F.col(here)) == F.col(found), "left").withColumn(name, maybe).drop(here, found, held)


def among(df: DataFrame, on: dict[str, str], keys: DataFrame, bound: int, found: bool = True) -> DataFrame:
    """Rows of df whose columns equal (nulls too) those of a row of keys, or of none of them if not found.

    on names the columns of keys by those of df. Rows stay where they are up to bound keys, which are broadcast; beyond,
    only rows that have a key move, and as few others as a filter of the keys' hashes lets through.
    """

    def met(rows: DataFrame, side: DataFrame) -> DataFrame:
        same = [rows[a].eqNullSafe(side[b]) for a, b in on.items()]
        return rows.join(side, reduce(Column.__and__, same), "left_semi" if found else "left_anti")

    if keys.limit(bound + 1).count() <= bound:
        return met(df, F.broadcast(keys))
    maybe = free_name(df, "maybe")
    marked = may_be_among(df, maybe, F.xxhash64(*on), keys.select(F.xxhash64(*on.values()).alias("h")))
    moved = met(marked.where(maybe).drop(maybe), keys)
    return moved if found else moved.union(marked.where(~F.col(maybe)).drop(maybe))


def matches(text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column, Column], Column] | None = None, group: int | None = None, hint: str | None = None) -> Column:
    """Array of struct(start, rank, end, kind, hit) for the leftmost non-overlapping matches of a Java pattern.

    Offsets count code points, end exclusive. The pieces between matches come from split() and the matches from
    regexp_extract_all(), so each offset is a running sum of lengths. keep(hit, part) drops failing matches after
    the offsets are known; part is the capturing group, or the hit itself. A text without hint has no match.
    """
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>")

    def located(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), parts.alias("part"))

        def step(acc: Column, row: Column) -> Column:
            start = acc["at"] + F.length(row["gap"])
            end = start + F.length(F.coalesce(row["hit"], F.lit("")))
            found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), row["hit"].alias("hit"))
            good = row["hit"].isNotNull() if keep is None else row["hit"].isNotNull() & F.coalesce(keep(row["hit"], row["part"]), F.lit(False))
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(rows, zero, step, lambda acc: acc["out"])

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if hint is not None:
        hits = F.when(F.contains(text, F.lit(hint)), hits).otherwise(F.array().cast("array<string>"))
    return let(hits, lambda h: F.when(F.size(h) > 0, located(h)).otherwise(empty))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
