"""Whole stores: conversations written as Markdown records, read, checked, searched and resolved as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from ..parse.arrow import exploded, parse_files
from ..sources.store import ALIASES, Config, Store
from ..sources.tables import record_path, spread, table
from .registry import query


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown record per conversation: front matter, a title heading, a section a turn with a link to the one before."""
    turn = F.struct("turn", "role", "text")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    prior = lambda t: F.when(t["turn"] > 0, F.concat(F.lit("\n\n[before]("), (F.col("conv_id") - 1).cast("string"), F.lit(".md#"), t["role"], F.lit(")"))).otherwise(F.lit(""))
    sections = F.transform("turns", lambda t: F.concat(F.lit("\n## "), t["role"], F.lit(" "), t["turn"].cast("string"), F.lit('<a id="t'), t["turn"].cast("string"), F.lit('"></a>\n\n'), t["text"], prior(t), F.lit("\n")))
    head = F.concat(F.lit("---\nid: "), F.col("conv_id").cast("string"), F.lit("\nturns: "), F.size("turns").cast("string"), F.lit("\n---\n\n# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"))
    text = F.concat(head, F.array_join(sections, ""))
    return talks.select(record_path("talks", F.col("conv_id"), "md").alias("path"), F.encode(text, "UTF-8").alias("content")).withColumn("size", F.octet_length("content").cast("long"))


def store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(markdown_files(spark, sf_dir), Config(collections={"talks": {"match": ["talks/*"], "schema": {"type": "object", "required": ["id"], "properties": {"turns": {"type": "integer", "maximum": 5}}}}}))


@query("""SELECT 'talks/' || conv_id || '.md' AS path, '/$sections/' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS "at", role || ' ' || turn AS title, 't' || turn AS key,
octet_length(encode(regexp_replace(text, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g'))) + CASE WHEN turn > 0 THEN octet_length(encode('\n\n[before](' || (conv_id - 1) || '.md#' || role || ')')) ELSE 0 END AS body_bytes FROM conversations""")
def store_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section of every record, from the parse of its file."""
    nodes = store(spark, sf_dir).nodes.where("kind = 'section' and depth = 1")
    return nodes.select("path", "at", "title", "key", F.octet_length("body").cast("long").alias("body_bytes"))


@query("""SELECT 'talks/' || conv_id || '.md' AS path, code, count(*) AS n FROM (
SELECT conv_id, 'ref-dangling' AS code FROM conversations WHERE turn > 0
UNION ALL SELECT DISTINCT conv_id, 'schema-violation' FROM conversations GROUP BY conv_id HAVING count(*) > 5) GROUP BY ALL""")
def store_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole-store check. No section is called by its role alone, so every link is dangling."""
    return store(spark, sf_dir).check().groupBy("path", "code").agg(F.count("*").alias("n"))


@query("""SELECT 'talks/' || conv_id || '.md' AS path, '/$sections/' || (n - 1) AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations)
WHERE c >= 4 AND list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), 'the')""")
def store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with a word, in records whose root has enough turns."""
    return store(spark, sf_dir).query("turns:>=4 the", target="nodes").where("at <> ''").select("path", "at")


@query("""SELECT 'talks/3.md' AS path, "at", title FROM (SELECT '/$sections/' || (row_number() OVER (ORDER BY turn) - 1) AS "at", role || ' ' || turn AS title FROM conversations WHERE conv_id = 3)
UNION ALL SELECT DISTINCT 'talks/3.md', '', 'Conversation 3' FROM conversations WHERE conv_id = 3""")
def store_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record's outline: only its file is read."""
    s = store(spark, sf_dir)
    one = Store(s.all_files.where("path = 'talks/3.md'"), s.config)
    return one.outline("talks/3.md").select(F.lit("talks/3.md").alias("path"), "at", "title")


@query("""SELECT 'talks/' || conv_id || '.md' AS path, 't' || turn AS name, 'explicit' AS kind FROM conversations
UNION ALL SELECT 'talks/' || conv_id || '.md', role || '-' || turn, 'derived' FROM conversations
UNION ALL SELECT DISTINCT 'talks/' || conv_id || '.md', 'conversation-' || conv_id, 'derived' FROM conversations""")
def store_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).anchors.select("path", "name", "kind")


@query("""SELECT 'talks/' || conv_id || '.md' AS path, '/$sections/' || turn || '/$body' AS "at", (conv_id - 1) || '.md#' || role AS raw FROM conversations WHERE turn > 0""")
def store_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).refs.select("path", "at", "raw")


@query("SELECT count(DISTINCT conv_id) AS n_records, 0 AS n_unreadable, (SELECT count(*) FROM conversations WHERE turn > 0) + (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 5)) AS n_issues, (SELECT count(*) FROM conversations WHERE turn > 0) + (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 5)) AS n_errors FROM conversations")
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    issues = s.check()
    return checks.summary(s.records, issues)


@query("""SELECT 'notes/' || doc_id || '.md' AS path, unnest([lang, source]) AS tag FROM documents""")
def store_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of records written with them: a class on each title heading."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").select(record_path("notes", F.col("doc_id"), "md").alias("path"), F.concat(F.lit('# Note<a class="'), "lang", F.lit(" "), "source", F.lit('"></a>\n')).alias("t"))
    return exploded(parse_files(docs.select("path", F.encode("t", "UTF-8").alias("content")), ("tags",)), "tags").select("path", "tag")


def linked_store(spark: SparkSession, sf_dir: str, config: Config | None = None) -> Store:
    """A record for each conversation that 5 doesn't divide, with links to the next one in every state that a link can have.

    Some missing records have moved to the next number, some have not. Anchor aliases are recorded under live and under
    old paths, some files can't be read, and some aliases name what is live again.
    """
    c = F.col("conv_id")
    every = table(spark, sf_dir, "conversations").select(c.cast("long").alias("conv_id")).distinct()
    live = every.where(c % 5 != 0)
    to = (c + 1).cast("string")
    links = F.concat(*(F.concat(F.lit(" [x]("), to, F.lit(f".md{part})")) for part in ("", "#t0", "#same", "#old", "#older", "#none")), F.lit(" [j]("), c.cast("string"), F.lit(".json#a) [o](https://e.org/)\n"))
    text = F.concat(F.lit("# Talk "), c.cast("string"), F.lit("\n\n"), links, F.lit('\n## First <a id="t0"></a>\n\na\n\n## Same\n\nb\n\n## Same\n\nc\n'))
    path = lambda n: F.concat(F.lit("talks/"), n.cast("string"), F.lit(".md"))
    records = live.select(path(c).alias("path"), F.encode(text, "UTF-8").alias("content"))
    unreadable = live.where(c % 5 == 2).select(F.concat(F.lit("talks/"), c.cast("string"), F.lit(".json")).alias("path"), F.encode(F.lit('{"a": 1, "a": 2}'), "UTF-8").alias("content"))
    entry = lambda **k: F.to_json(F.struct(*((v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in k.items())))
    lines = [
        F.when((c % 10 == 0) | (c % 5 == 3), entry(kind="record", **{"from": path(c), "to": path(c + 1)})), F.when((c % 5 != 0) & (c % 2 == 0), entry(kind="anchor", record=path(c), **{"from": "old", "to": "t0"})),
        F.when(c % 10 == 0, entry(kind="anchor", record=path(c), **{"from": "older", "to": "t0"})), F.when(c % 5 == 4, entry(kind="anchor", record=path(c), **{"from": "t0", "to": "same"})),
    ]
    # The format holds all aliases in one file, so they are one row.
    listed = every.select(F.explode(F.array_compact(F.array(*lines))).alias("line")).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))
    aliases = listed.select(F.lit(ALIASES).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return Store(records.unionByName(unreadable).unionByName(aliases).withColumn("size", F.octet_length("content").cast("long")), config or Config())


#: Each link of linked_store() with its state: t is the record that it names, d the one that it reaches.
LINKED = """WITH every AS (SELECT DISTINCT conv_id AS c FROM conversations), live AS (SELECT c FROM every WHERE c % 5 <> 0),
reach AS (SELECT l.c, l.c + 1 AS t, CASE WHEN n.c IS NOT NULL THEN n.c WHEN m.c IS NOT NULL AND o.c IS NOT NULL THEN m.c END AS d
  FROM live l LEFT JOIN live n ON n.c = l.c + 1 LEFT JOIN live m ON m.c = l.c + 2 AND (l.c + 1) % 10 = 0 LEFT JOIN every o ON o.c = l.c + 1),
base AS (SELECT *, CASE WHEN d IS NULL THEN 'dangling' WHEN d = t THEN 'ok' ELSE 'aliased' END AS s FROM reach),
links AS (SELECT c, t || '.md' AS raw, s AS status, d, '' AS hit FROM base
  UNION ALL SELECT c, t || '.md#t0', s, d, '/$sections/0' FROM base
  UNION ALL SELECT c, t || '.md#same', CASE WHEN d IS NULL THEN 'dangling' ELSE 'ambiguous' END, d, NULL FROM base
  UNION ALL SELECT c, t || '.md#old', CASE WHEN d % 2 = 0 THEN 'aliased' ELSE 'dangling' END, d, '/$sections/0' FROM base
  UNION ALL SELECT c, t || '.md#older', CASE WHEN d <> t THEN 'aliased' ELSE 'dangling' END, d, '/$sections/0' FROM base
  UNION ALL SELECT c, t || '.md#none', 'dangling', d, NULL FROM base
  UNION ALL SELECT c, c || '.json#a', CASE WHEN c % 5 = 2 THEN 'unreadable' ELSE 'dangling' END, NULL, NULL FROM base
  UNION ALL SELECT c, 'https://e.org/', 'outside', NULL, NULL FROM base)
"""


@query(LINKED + "SELECT 'talks/' || c || '.md' AS path, raw, status, CASE WHEN status IN ('ok', 'aliased') THEN 'talks/' || d || '.md' END AS record, CASE WHEN status IN ('ok', 'aliased') THEN hit END AS target_at FROM links")
def store_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of a store of parsed records: ok, aliased by record and by anchor, ambiguous, dangling, unreadable, outside."""
    held = F.col("status").isin("ok", "aliased")
    return linked_store(spark, sf_dir).resolved_refs().select("path", "raw", "status", F.when(held, F.col("record")).alias("record"), F.when(held, F.col("target_at")).alias("target_at")).distinct()


#: Every issue of linked_store() with its default severity.
ISSUES = LINKED + """, found AS (
SELECT c, 'talks/' || c || '.md' AS path, CASE WHEN status = 'unreadable' THEN 'ref-target-unreadable' ELSE 'ref-' || status END AS code FROM links WHERE status NOT IN ('ok', 'outside')
UNION ALL SELECT c, 'talks/' || c || '.md', 'duplicate-key' FROM live
UNION ALL SELECT c, 'talks/' || c || '.json', 'duplicate-member' FROM live WHERE c % 5 = 2
UNION ALL SELECT c, 'talks/' || c || '.md', 'alias-shadowed' FROM live WHERE c % 5 IN (3, 4)),
issues AS (SELECT *, CASE WHEN code IN ('ref-aliased', 'ref-target-unreadable', 'alias-shadowed') THEN 'warning' ELSE 'error' END AS severity FROM found)
"""


@query(ISSUES + "SELECT path, code, count(*) AS n FROM issues GROUP BY ALL")
def store_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole-store check of the same store, with aliases that name what is live again."""
    return linked_store(spark, sf_dir).check().groupBy("path", "code").agg(F.count("*").alias("n"))
