"""Secret scans (4): fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is a JVM expression over one scan; no row is shuffled. A candidate is a run of token characters. Its
windows are scored by character class with counts that each step changes by one character in and one out, and its
span is added if its most random window passes the class's threshold, no allow-list pattern fits, and no span of the
fixed patterns overlaps it. Pieces between separators that have a placeholder's word are left out before that, so they
hide nothing beside them. A window is 20 characters, the least length of a candidate; shorter ones are none.

Defined results: a null or empty text has no spans; repeated rows are scanned alike; offsets are code points, end
exclusive; spans of one start are in the order of KINDS; an empty table gives an empty result; further columns of
the input are kept only if named.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, matches, span_text

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: Runs below the least length would be dropped anyway, and no later start in such a run is longer.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class pattern and the least entropy in bits a character of a window; the first pattern that fits counts.
CLASSES: tuple[tuple[str, float], ...] = (
    ("^[0-9]+$", 9.0),  # plain numbers are no secrets by randomness alone
    ("^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("^[A-Za-z]+$", 4.1),  # long words
    ("", 3.7),
)
#: Strings that look random and aren't secret.
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[A-Za-z0-9]+(?:[-_/][A-Za-z]+){3,}$",
    "^[=_/+-]+$",
)
#: Words and runs of placeholders; a piece between separators that has one is left out of its candidate, and the rest is scored.
PLACEHOLDER = "(?i:example|sample|placeholder|changeme|dummy|redacted|x{6}|abcdefghij)|0123456789"
SEPARATORS = "[/=_-]+"
#: Entropies are kept as whole numbers: c log2 c in units of 2^-20, so that steps in and out cancel exactly.
UNIT = 1 << 20
COSTS = [round(c * log2(c) * UNIT) if c else 0 for c in range(WINDOW + 2)]


def most_bound(entropy: float, window: int = WINDOW) -> int:
    """The largest sum of c log2 c that a window of at least this entropy can have."""
    return int(window * (log2(window) - entropy) * UNIT)


def least_sum(text: Column, window: int = WINDOW) -> Column:
    """The smallest sum of c log2 c over all windows of the string, by incremental counts."""
    costs = F.array(*map(F.lit, COSTS))
    codes = F.transform(F.filter(F.split(text, "", -1), lambda ch: ch != ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(1 << 62).alias("least"))

    def over(code: Column) -> Column:
        steps = F.transform(code, lambda c, i: F.struct(c.alias("new"), F.coalesce(F.get(code, i - window), F.lit(-1)).alias("old"), i.alias("i")))

        def step(acc: Column, s: Column) -> Column:
            change = lambda c, by: F.get(costs, F.get(acc["n"], c) + by) - F.get(costs, F.get(acc["n"], c))
            moved = F.when(s["new"] == s["old"], F.lit(0)).otherwise(change(s["new"], 1) + F.when(s["old"] >= 0, change(s["old"], -1)).otherwise(F.lit(0)))
            counts = F.transform(acc["n"], lambda v, k: v + (k == s["new"]).cast("int") - (k == s["old"]).cast("int"))
            total = acc["sum"] + moved
            least = F.when(s["i"] >= window - 1, F.least(acc["least"], total)).otherwise(acc["least"])
            return F.struct(counts.alias("n"), total.cast("long").alias("sum"), least.cast("long").alias("least"))

        return F.aggregate(steps, zero, step, lambda acc: acc["least"])

    return let(codes, over)


def _random(hit: Column, _: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | hit.rlike(pattern)

    def over(rest: Column) -> Column:
        bound = F.lit(most_bound(CLASSES[-1][1]))
        for pattern, entropy in reversed(CLASSES[:-1]):
            bound = F.when(rest.rlike(pattern), F.lit(most_bound(entropy))).otherwise(bound)
        return least_sum(rest) <= bound

    kept = F.filter(F.split(hit, SEPARATORS, -1), lambda piece: ~piece.rlike(PLACEHOLDER))
    rest = F.when(hit.rlike(PLACEHOLDER), F.array_join(kept, "-")).otherwise(hit)
    return ~allowed & let(rest, over)


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default doc_id) with spans: array of struct(start, rank, end, kind, hit) by start, then kind."""
    kept = ["doc_id"] if keep is None else keep
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(
        matches(text, ASSIGN, "assign", 0, lambda _, part: F.length(part) >= ASSIGN_LEAST, group=2),
        matches(text, ACCESS, "access", 1, hint="AKIA"),
        matches(text, HEX, "hex", 2),
    )
    added = matches(text, CANDIDATE, "entropy", 3, _random)
    return docs.select(*kept, F.array_sort(found).alias("base"), added.alias("more")).select(
        *kept,
        F.array_sort(F.concat("base", F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))).alias("spans"),
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts of each fixed kind, a digest of the fixed spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return scan(docs).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
