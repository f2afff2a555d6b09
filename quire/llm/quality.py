"""Quality rules (7) as a bitmask ledger: every rule is evaluated once per document, its measurement and failure
bit are stored, and versioned policies and ablations are then bitwise operations on the stored bits.

Everything is a JVM expression over one scan; no row is shuffled. Defined results: a null or empty text has no
words (all measurements zero) and fails few_words; repeated rows are judged alike; an empty table gives an empty
ledger; columns of the input that are called like a ledger column are left out of the ledger, all others may be kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

WINDOW = 8
#: The rules in bit order. Each is (name, failing condition over the measurements).
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "10 * n_marks > 3 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of what is enforced: a document is kept if none of these rules failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("v1", tuple(BIT))


def _repeated(words: Column, n: Column) -> Column:
    """Words that are in a window of eight that the text has twice or more.

    Windows are compared by a 64-bit hash over their words. Only a text that repeats a window is sorted: equal
    neighbours give the repeated starts, and the union of [start, start + 8) is summed over the gaps between them.
    """

    def covered(keys: Column) -> Column:
        tagged = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            same = lambda row, j: F.coalesce(F.get(rows, j)["k"] == row["k"], F.lit(False))
            kept = F.filter(rows, lambda row, j: same(row, j - 1) | same(row, j + 1))
            return F.sort_array(F.transform(kept, lambda row: row["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(tagged, starts), total)

    def of(hashes: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0).cast("long")))

    # F.sequence(0, negative) would count down, so short texts never reach it.
    return F.when(n < 2 * WINDOW - (WINDOW - 1), F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of))


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default doc_id) with the measurements that the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [c for c in (["doc_id"] if keep is None else keep)]
    words = words_of(F.col("text"))

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            _repeated(w, n).alias("n_repeat_words"),
        )

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    worded = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select(*kept, let(words, of).alias("_w"), let(worded, lines).alias("_l"), *(F.char_length(F.regexp_replace(text, p, "")).cast("long").alias(c) for c, p in (("n_symbols", r"[^#*$%&|<>]+"), ("n_marks", r"[^!]+"))))
        .select(*kept, "_w.*", "_l.*", "n_symbols", "n_marks")
    )


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """measure() with fail_bits: bit i is set if rule i failed. No policy is applied yet."""
    bits = [F.when(F.expr(test), F.lit(BIT[name])).otherwise(F.lit(0)) for name, test in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, keep).withColumn("fail_bits", total.cast("long"))


def failed(policy: Policy, bits: str = "fail_bits") -> Column:
    """True where the policy rejects."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = (BASE, STRICT)) -> DataFrame:
    """What each rule adds to each policy: documents it fails, and those that it alone rejects.

    The ledger is first counted by its bits (at most 2^rules rows whatever the input), and only those counts are
    compared with the masks. A rule that fails nothing, as in an empty ledger, has zeros.
    """
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    plan = spark.createDataFrame([(p.version, p.mask, r, BIT[r]) for p in policies for r in p.rules], "policy string, mask long, rule string, bit long")
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    keyed = counts.select(F.explode(F.sequence(F.lit(0), F.lit(len(RULES) - 1))).alias("i"), "fail_bits", "n").withColumn("bit", F.expr("shiftleft(1L, i)"))
    sums = keyed.join(F.broadcast(plan), "bit").groupBy("policy", "rule").agg(F.sum(F.when(hit, F.col("n"))).alias("n_failed"), F.sum(F.when(alone, F.col("n"))).alias("n_only"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return plan.select("policy", "rule").join(F.broadcast(sums), ["policy", "rule"], "left").select("policy", "rule", none("n_failed"), none("n_only"))


def filter_quality(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The documents that the policy keeps, with the columns of docs and nothing else. Repeated names aren't allowed."""
    columns = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_doc"), F.col("text"))
    return ledger(packed, keep=["_doc"]).where(~failed(policy)).select("_doc.*")
