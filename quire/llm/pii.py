"""PII (8): fixed patterns, and information-theoretic sanitisation of the words around them.

The fixed patterns find protected entities (addresses and numbers). Words of the documents that have an entity are
counted over the whole corpus, against each entity and its class: a word reveals one if most documents with the word
have it, and if seeing the word tells many bits about it (pointwise mutual information), both from a share that is
smoothed towards none by the number of different contexts. Two contexts are enough for a word that is in no other
document; one never is, as each word of a page of its own would then reveal whatever is on it. Such words are added as
spans of kind `term` wherever any document has them; sanitise() generalises or removes them.

The main path is one scan of the texts for patterns and contexts, a count of candidate words over all documents (map
side against a checked broadcast, or a shuffle join beyond), and joins of candidates only. Counts are of
distinct texts, and copies of one context count once as evidence, so a page copied a thousand times reveals nothing by
that.

Defined results: a null or empty text has no spans; repeated rows get equal results; offsets are code points, end
exclusive; spans of one start are in the order of KINDS; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let, matches, span_text

KINDS = ("email", "ip", "card", "phone", "term")
#: Each starts where a run starts, or where the previous match ended; quantifiers that need no way back have none.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Chains of digits are whole, so one of fewer than 14 would be dropped anyway.
CARD = r"[0-9](?:[\x20-]?+[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Code points on either side of a span that are its context, by which copies are told.
CONTEXT = 80
WORD = r"\p{L}++"
#: A word reveals an entity or a class from this smoothed share of its documents and these bits on.
#: Smoothing: contexts / (contexts + PRIOR) is the weight of what was counted, as if PRIOR more contexts were without it.
PRIOR = 2
LEAST_SHARE = 0.5
LEAST_BITS = 4.0
#: From so many bits on, sanitise() removes a word; below, it generalises it.
REMOVE_BITS = 10.0
#: Candidate words up to which they are broadcast (about 50 bytes each); beyond, the count is a shuffle join.
BROADCAST_WORDS = 500_000

SPAN = "struct<start:int,rank:int,end:int,kind:string,hit:string>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check: every second one from the right doubled, its digits summed."""
    values = F.transform(F.split(F.reverse(digits), "", -1), lambda ch: ch.cast("int"))
    doubled = F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four fixed kinds, by start, then kind."""
    card = lambda hit, _: F.length(_digits(hit)).between(14, 19) & _luhn(_digits(hit))
    phone = lambda hit, _: F.length(_digits(hit)).between(10, 15)
    found = F.concat(
        matches(text, EMAIL, "email", 0, hint="@"),
        matches(text, IP, "ip", 1, lambda hit, _: hit.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")),
        matches(text, CARD, "card", 2, card),
        matches(text, PHONE, "phone", 3, phone, hint="+"),
    )
    return F.array_sort(found)


def _lower_words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _context(text: Column, spans: Column) -> Column:
    """For each span its entity, then for each its class, and a hash of the text around it: struct(entity, seen).

    Classes: an e-mail's domain, an address's first three numbers, a card's issuer (six digits), a phone number
    without its last four digits.
    """

    def wider(s: Column) -> Column:
        digits = _digits(s["hit"])
        name = (
            F.when(s["kind"] == "email", F.substring_index(F.lower(s["hit"]), "@", -1)).when(s["kind"] == "ip", F.substring_index(s["hit"], ".", 3))
            .when(s["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 4))
        )
        return F.xxhash64(F.lit("class"), s["kind"], name)

    def of(s: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before, after = F.substring(text, low + 1, s["start"] - low), F.substring(text, s["end"] + 1, F.lit(CONTEXT))
        seen = F.xxhash64(F.lower(before), F.lower(after)).alias("seen")
        return F.array(F.struct(F.xxhash64(s["kind"], F.lower(s["hit"])).alias("entity"), seen), F.struct(wider(s).alias("entity"), seen))

    return F.flatten(F.transform(spans, of))


def disclosures(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(entity, word, bits) of every word that reveals an entity, by counts over all documents."""
    weight = lambda n: F.col(n) / (F.col(n) + PRIOR)
    smoothed = lambda n: F.col("together") / F.col(n) * weight("contexts")
    n_docs = scanned.select("text_key").distinct().count()
    # Copies count once, whatever their ids.
    texts = checkpointed(scanned.where(F.size("context") > 0).groupBy("text_key").agg(F.first("context").alias("context"), F.first("words").alias("words")))
    near = texts.select("text_key", F.explode("context").alias("c")).groupBy("text_key", "c.entity").agg(F.min("c.seen").alias("seen"))
    # Bounds that follow from the two conditions, so that nothing that could meet them is left out: a pair has no more
    # contexts than its entity or its word, its share is 1 at most, and its word has n_near documents or more.
    entities = near.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("seen").alias("n_seen"))
    entities = checkpointed(entities.where((weight("n_seen") >= LEAST_SHARE) & (F.log2(n_docs / F.col("n_entity")) >= LEAST_BITS)))
    words = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_near")).where(weight("n_near") >= LEAST_SHARE)
    words = checkpointed(words.join(entities.agg(F.max("n_entity").alias("most")), F.col("n_near") * LEAST_SHARE <= F.col("most")).drop("most"))
    small = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    placed = texts.select("text_key", F.explode("words").alias("word")).join(F.broadcast(words) if small else words, "word")
    pairs = near.join(entities, "entity").join(placed, "text_key").where(F.col("n_near") * LEAST_SHARE <= F.col("n_entity") * weight("n_seen"))
    joint = pairs.groupBy("entity", "word").agg(F.count_distinct("seen").alias("contexts"), F.count("*").alias("together"), F.max("n_near").alias("n_near"))
    joint = checkpointed(joint.where(smoothed("n_near") >= LEAST_SHARE).drop("n_near"))
    vocabulary = joint.select("word").distinct()
    with_word = _spoken(docs, vocabulary).groupBy("word").agg(F.count_distinct("text_key").alias("n_word"))
    share = smoothed("n_word")
    bits = F.log2(share / (F.col("n_entity") / F.lit(n_docs)))
    return (
        joint.join(with_word, "word").join(entities, "entity").where(share >= LEAST_SHARE)
        .select("entity", "word", bits.alias("bits")).where(F.col("bits") >= LEAST_BITS)
    )


def _spoken(docs: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, text_key and the columns of words for every row of docs and each of those words in its text."""
    small = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    spoken = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(_lower_words(F.coalesce("text", F.lit("")))).alias("word"))
    return spoken.join(F.broadcast(words) if small else words, "word")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and spans (array of struct(start, rank, end, kind, hit, bits)) of every row.

    A word that reveals an entity is a term wherever it is written, with the entity or without it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = lambda s: F.when(F.size(s) > 0, _lower_words(text)).alias("words")
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), let(base_spans(text), lambda s: F.struct(s.alias("base"), _context(text, s).alias("context"), words(s))).alias("f"))
    scanned = checkpointed(found.select("doc_id", "text_key", "f.base", "f.context", "f.words"))
    told = checkpointed(disclosures(docs, scanned).groupBy("word").agg(F.max("bits").alias("bits")))
    key = ["doc_id", "text_key"]
    # Only texts that have such words are read for their places.
    said = _spoken(docs, told).groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("word", "bits"))).alias("told"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("d")
    same = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & F.col(f"{x}.text_key").eqNullSafe(F.col(f"{y}.text_key"))
    placed = keyed.join(said.alias("w"), same("d", "w")).select("d.doc_id", "d.text_key", "told", matches(F.col("d.text"), WORD, "term", 4, lambda hit, _: F.map_contains_key("told", F.lower(hit))).alias("terms"))
    term = lambda t: F.struct(t["start"], t["rank"], t["end"], t["kind"], F.lower(t["hit"]).alias("hit"), F.element_at("told", F.lower(t["hit"])).alias("bits"))
    terms = placed.select(*key, F.transform("terms", term).alias("terms")).dropDuplicates(key)
    joined = scanned.alias("s").join(terms.alias("t"), same("s", "t"), "left")
    base = F.transform("s.base", lambda b: F.struct(b["start"], b["rank"], b["end"], b["kind"], b["hit"], F.lit(None).cast("double").alias("bits")))
    free = F.filter(F.coalesce("t.terms", F.array().cast(terms.schema["terms"].dataType)), lambda t: ~F.exists("s.base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select("s.doc_id", "s.text_key", F.array_sort(F.concat(base, free)).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Counts of each fixed kind, a digest of the fixed spans, and all spans as text."""
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 4)
    return scan(docs).select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with their texts sanitised: entities become [kind], terms are generalised to [term] or removed.

    Overlapping spans are joined first; the joined span is written as its first one. Null texts stay null.
    """
    from .common import free_name

    spans = scan(docs).dropDuplicates(["doc_id", "text_key"])
    key, out = free_name(docs, "text_key"), free_name(docs, "pii_text")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["doc_id"]) & keyed[key].eqNullSafe(spans["text_key"]), "left")
    text = keyed["text"]
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["kind"] != "term", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["bits"] >= REMOVE_BITS, F.lit("")).otherwise(F.lit("[term]"))
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(fresh).alias("out"))

    tail = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.when(F.size(spans["spans"]) > 0, F.aggregate(spans["spans"], zero, step, tail)).otherwise(text)
    made = joined.select(*(keyed[f"`{c}`"].alias(c) for c in docs.columns), clean.alias(out))
    return made.select(*(F.col(out).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
