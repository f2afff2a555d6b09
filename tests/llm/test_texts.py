"""URL filters, language ID and token counts."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import langid, token_count, url_filter


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:at])
    path = rest[at:]
    return host, path[: min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]


def judged(url, rules):
    host, path = url_parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


URLS = [
    None, "", "no scheme/en/", "http://", "http:///x", "https://www.Example.COM/en/1", "http://example.com/en/x?y#z", "http://m.www.example.com/en/", "http://example.com", "http://example.com?a://b/en/", "http://notexample.com/en/", "http://a.b.net/es/1", "http://net/fr/", "http://net/fr",
    "ftp://X.net/de/", "http://com/", "http://.com/x", "http://user@example.com:80/en/", "http://example.com/EN/", "http://É.com/en/", "http://a.com#/en/", "http://" + "a." * 400 + "net/es/" + "x" * 3000, "http://example.org/a://b",
]


@pytest.mark.parametrize("rules", [url_filter.RULES, (("block", "com", ""), ("allow", "example.com", "/e"), ("block", "a.b.net", "/es/1")), ()])
def test_urls_equal_brute_force(spark, rules):
    rows = [*enumerate(URLS), (5, URLS[5]), (None, URLS[6])]
    pages = spark.createDataFrame([(i, u, "<p>", "mine") for i, u in rows], "page_id long, url string, html string, rule string")
    table = url_filter.rule_table(spark, rules) if rules else spark.createDataFrame([], "verdict string, host string, path string")
    got = sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in url_filter.judge(pages, table).collect()), key=str)
    assert got == sorted(((i, *judged(u, rules)) for i, u in rows), key=str)


def test_rules_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 2)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()}
    assert got == {i: judged(u, url_filter.RULES) for i, u in enumerate(URLS)}


SYLLABLES = {"en": "the ing tion er an ou".split(), "fr": "le eau que ou ré tion".split(), "de": "ein sch ung ver ich tz".split(), "es": "ción os la ar do ez".split()}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(n))


def test_held_out_languages(docs_of):
    rows = [(i, prose(lang, 40, i), lang, "s") for i, lang in enumerate(["en", "fr", "de", "es"] * 60)]
    rows += [(1000, None, "en", "s"), (1001, "123 456 !", "en", "s"), (1002, "", None, "s"), (1003, prose("de", 30, 1), None, "s"), (None, prose("fr", 30, 2), "fr", "s"), (1004, "x" * 5000, "en", "s"), (5, rows[5][1], "fr", "s")]
    got = langid.identify(docs_of(rows).withColumn("score", F.lit("mine"))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [d for d, *_ in rows[:240] if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(by[d]["held_out"] == (d in held) for d in range(240))
    assert sum(by[d]["lang_pred"] == rows[d][2] for d in held) >= 0.95 * len(held)
    assert [by[d]["lang_pred"] for d in (1000, 1001, 1002)] == ["und"] * 3 and by[1000]["score"] == 0
    assert by[1003]["lang_pred"] == "de" and by[None]["lang_pred"] == "fr" and not by[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_no_labels_and_no_rows(docs_of):
    assert [r["lang_pred"] for r in langid.identify(docs_of([(1, "some words", None, "s")])).collect()] == ["und"]
    assert langid.identify(docs_of([])).count() == 0


def test_backoff_goes_to_shorter_pieces():
    model = {"languages": ["a", "b"], "known": {"wknown": 0, "3zzz": 1, "1q": 2}, "table": __import__("numpy").array([[-1.0, -2.0], [-3.0, -1.0], [-1.0, -5.0]], dtype="float32")}
    scorer = langid.Scorer(model)
    assert scorer.rows_for(["known", "xzzzx", "aqa", "###"]).tolist() == [[-1.0, -2.0], [-3.0, -1.0], [-1.0, -5.0], [0.0, 0.0]]
    assert scorer.mean("Known, known aqa").tolist() == [-1.0, -3.0] and scorer.mean("known " + "q" * 80).tolist() == [-1.0, -3.5] and scorer.mean("1 2") is None


def brute_tokens(word, pieces, byte):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            piece = word[start:end]
            if piece in pieces:
                options.append((-(best[start][0] + pieces[piece]), best[start][1] + 1))
        if word[end - 1] not in pieces:
            n = len(word[end - 1].encode())
            options.append((-(best[end - 1][0] + byte * n), best[end - 1][1] + n))
        score, count = min(options)
        best.append((-score, count))
    return best[-1][1]


def test_trie_equals_plain_dynamic_programming():
    pieces = token_count.pieces_of()
    r = random.Random(2)
    words = ["▁" + "".join(r.choices("etaoinshrdlu", k=r.randint(1, 12))) for _ in range(300)] + ["▁" + x for x in ("naïve", "😀", "日本語", "the", "there", "therefore", "", "x" * 200, "ab" * 90)]
    for limit in (10**6, 50):
        trie = token_count.Trie(pieces, limit)
        for w in words * 2:
            assert trie.count(w) == brute_tokens(w, pieces, trie.byte), w


def test_token_counts_of_documents(docs_of):
    rows = [(1, "the cat sat"), (1, "the cat sat"), (2, None), (3, ""), (None, " \n"), (4, "wörd " * 2000), (5, "y" * 3000)]
    pieces = token_count.pieces_of()
    byte = min(pieces.values()) - 1
    got = sorted((str(r["doc_id"]), r["n_pretokens"], r["n_tokens"], r["n_bytes"]) for r in token_count.count_tokens(docs_of(rows).withColumn("n_tokens", F.lit(0))).collect())
    want = []
    for d, t in rows:
        words = (t or "").split()
        known = {w: brute_tokens("▁" + w, pieces, byte) for w in set(words)}
        want.append((str(d), len(words), sum(known[w] for w in words), len((t or "").encode())))
    assert got == sorted(want)
    assert token_count.count_tokens(docs_of([])).count() == 0
