"""Mixing sources to target weights (1) by Poisson replication.

A source's rate is the number of times its bytes must be repeated, on average, for its share of the mixture to be
its weight. A document's count is drawn by inverting the Poisson distribution of that rate at a number hashed from
the seed and its doc_id, so a rerun or a lost executor gives the same counts. Copies are put in a global order by a
second hash. Only the per-source sums (one row a source) are gathered; the rest is one join, one explode and one
range-partitioned sort.

Defined results: a null source is a source of its own; a null text has no bytes; a source without bytes or with
weight zero gets rate zero; rows with equal doc_id draw the same count, and each is repeated; a null doc_id draws
as the text 'null'; an empty table gives an empty mixture. Rates above RATE_PART are drawn as sums of smaller ones.
Columns may have any name: those that mix() adds get underscores where docs has such a name. A text is only measured
and moved with its row, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name

#: Hash numbers are the first 13 hexadecimal digits of an MD5: 52 bits, exact in a double.
DIGITS = 13
#: The largest rate that is inverted at once; exp(-rate) stays far from underflow.
RATE_PART = 256
#: Sources up to which their table is broadcast (its distributions have at most TERMS + 1 numbers each, mostly a few
#: dozen); beyond, documents and sources are shuffled, and the adaptive join splits hot sources.
BROADCAST_SOURCES = 10_000
#: Terms of a distribution that are stored; beyond them a double's sum no longer grows for rates up to RATE_PART.
TERMS = 512


def hash_number(*parts: Column) -> Column:
    """A whole number from 0 to 2^52 - 1 from the colon-joined parts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the sum stops growing in double precision."""
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        total = acc["sum"] + p
        grown = (total > acc["sum"]) | (k < rate)
        return F.struct(p.alias("p"), total.alias("sum"), F.when(grown, F.concat(acc["out"], F.array(total))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda acc: acc["out"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, source: str = "source") -> DataFrame:
    """source, rate, parts and cdf (of rate / parts), one row a source. Weights are relative; bytes in = bytes out."""
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    weighed = checkpointed(sums.select("source", "bytes", weight.alias("w")).where("bytes > 0"))
    all_w, all_bytes = weighed.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if not all_w:
        weighed, all_w = weighed.limit(0), 1.0
    rate = F.col("w") / F.lit(all_w) * F.lit(float(all_bytes)) / F.col("bytes")
    parts = F.greatest(F.ceil(F.col("rate") / RATE_PART), F.lit(1))
    return (
        weighed.select("source", rate.alias("rate")).where("rate > 0")
        .select("source", "rate", parts.alias("parts"))
        .select("source", "rate", "parts", _cumulative(F.col("rate") / F.col("parts")).alias("cdf"))
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, seed: int = 0, extras: bool = False) -> DataFrame:
    """docs repeated to the target weights, in a global order by hash; with extras also copy and shuffle_key (copy_ and so on, if docs has those)."""
    columns = docs.columns
    per = rates(docs, weights, default_weight)
    names = {n: free_name(docs, f"mix_{n}") for n in ("source", "rate", "parts", "cdf", "n", "copy", "key")}
    small = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    per = per.select(*(F.col(c).alias(names[c]) for c in ("source", "rate", "parts", "cdf")))
    per = F.broadcast(per) if small else per
    scale = F.lit(float(1 << (4 * DIGITS)))

    def drawn(i: Column) -> Column:
        u = (hash_number(F.lit("count"), F.lit(seed), F.col("doc_id"), i) + F.lit(0.5)) / scale
        return F.size(F.filter(F.col(names["cdf"]), lambda p: p < u))

    count = F.aggregate(F.transform(F.sequence(F.lit(1).cast("long"), F.col(names["parts"])), drawn), F.lit(0), lambda a, x: a + x)
    joined = docs.join(per, docs["source"].eqNullSafe(per[names["source"]])).select(*(docs[f"`{c}`"] for c in columns), count.alias(names["n"]))
    copies = joined.where(F.col(names["n"]) > 0).withColumn(names["copy"], F.explode(F.sequence(F.lit(0), F.col(names["n"]) - 1)))
    keyed = copies.withColumn(names["key"], hash_number(F.lit("order"), F.lit(seed), F.col("doc_id"), F.col(names["copy"])))
    shuffled = keyed.orderBy(names["key"], "doc_id", names["copy"])
    extra = [F.col(names["copy"]).alias(free_name(docs, "copy")), F.col(names["key"]).alias(free_name(docs, "shuffle_key"))] if extras else []
    return shuffled.select(*(F.col(f"`{c}`") for c in columns), *extra)
