"""Checks, searches by computed fields, reading forms and writers over stores of parsed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks
from ..parse.arrow import exploded, parse_files, written
from ..sources.store import Config, Store
from ..sources.tables import record_path, spread, table
from .registry import query
from .stores import ISSUES, LINKED, linked_store, markdown_files, store

LENIENT = "CASE WHEN code = 'duplicate-key' THEN 'warning' ELSE severity END"
COLLECTIONS = {"notes": {"match": ["talks/*.md"]}, "ones": {"match": ["talks/1*"]}}


@query(ISSUES + f"SELECT path, code, {LENIENT} AS severity, count(*) AS n FROM issues GROUP BY ALL")
def check_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lenient store's whole check."""
    return linked_store(spark, sf_dir, Config(uniqueness="lenient")).check().groupBy("path", "code", "severity").agg(F.count("*").alias("n"))


@query(ISSUES + "SELECT code, severity, count(*) AS n FROM issues GROUP BY ALL")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.counts(linked_store(spark, sf_dir).check())


@query(ISSUES + "SELECT code, CASE WHEN code = 'ref-dangling' THEN 'warning' ELSE severity END AS severity, count(*) AS n FROM issues WHERE code <> 'ref-ambiguous' GROUP BY ALL")
def severity_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.counts(linked_store(spark, sf_dir, Config(issues={"ref-ambiguous": "off", "ref-dangling": "warning"})).check())


@query("SELECT 'talks/' || conv_id || '.md' AS path FROM conversations GROUP BY conv_id HAVING count(*) <= 5")
def strict_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a strict reader gets: those that their schema accepts."""
    s = store(spark, sf_dir)
    issues = s.check()
    return checks.strict(s.records.where("readable").select("path"), issues)


@query(ISSUES + f"SELECT (SELECT count(*) FROM live) + (SELECT count(*) FROM live WHERE c % 5 = 2) AS n_records, (SELECT count(*) FROM live WHERE c % 5 = 2) AS n_unreadable, count(*) AS n_issues, count_if({LENIENT} = 'error') AS n_errors FROM issues")
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = linked_store(spark, sf_dir, Config(uniqueness="lenient"))
    issues = s.check()
    return checks.summary(s.records, issues)


@query(LINKED + """SELECT CASE WHEN one AND md THEN '(conflict)' WHEN one THEN 'ones' WHEN md THEN 'notes' ELSE '(none)' END AS collection, count(*) AS n_records, count_if(NOT md) AS n_unreadable
FROM (SELECT c::VARCHAR LIKE '1%' AS one, unnest(CASE WHEN c % 5 = 2 THEN [true, false] ELSE [true] END) AS md FROM live) GROUP BY ALL""")
def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.collection_summary(linked_store(spark, sf_dir, Config(collections=COLLECTIONS)).records)


@query(LINKED + "SELECT 'talks/' || c || '.json' AS path, 'json' AS format FROM live WHERE c % 5 = 2")
def unreadable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_store(spark, sf_dir).records.where("not readable").select("path", "format")


@query(ISSUES + "SELECT path, code, severity, count(*) AS n FROM issues WHERE c % 5 = 2 GROUP BY ALL")
def check_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check after the unreadable files changed: they, and the records that cite them."""
    s = linked_store(spark, sf_dir)
    changed = s.files.where(F.col("path").endswith(".json")).select("path")
    return s.check(changed).groupBy("path", "code", "severity").agg(F.count("*").alias("n"))


@query("SELECT CAST(NULL AS VARCHAR) AS path, 'schema-invalid' AS code, 'error' AS severity UNION ALL SELECT 'talks/' || conv_id || '.md', 'ref-dangling', 'error' FROM conversations WHERE turn > 0")
def check_unusable_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with a schema that can't be used: one issue for it, and no record is validated against it."""
    schema = {"properties": {"turns": {"type": "integer", "maximum": 0}, "id": {"type": "nothing"}}}
    return Store(markdown_files(spark, sf_dir), Config(collections={"talks": {"match": ["talks/*"], "schema": schema}})).check().select("path", "code", "severity")


@query("SELECT 'refs/' || conv_id || '.json' AS path, '/to/1' AS \"at\", '../talks/' || conv_id || '.md#' || role || '-0' AS message FROM conversations WHERE turn = 0")
def check_explicit_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that ask for explicit anchors: the one by a title-derived name is refused, the one by the anchor isn't."""
    one = {"type": "string", "format": "uri-reference", "x-vmd-ref": {"anchors": "explicit"}}
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    to = lambda fragment: F.concat(F.lit("../talks/"), F.col("conv_id").cast("string"), F.lit(".md#"), fragment)
    value = F.to_json(F.struct(F.array(to(F.lit("t0")), to(F.concat("role", F.lit("-0")))).alias("to")))
    citing = first.select(record_path("refs", F.col("conv_id")).alias("path"), F.encode(value, "UTF-8").alias("content")).withColumn("size", F.octet_length("content").cast("long"))
    s = Store(citing.unionByName(markdown_files(spark, sf_dir)), Config(collections={"refs": {"match": ["refs/*"], "schema": {"properties": {"to": {"type": "array", "items": one}}}}}))
    return s.check().where("code = 'ref-target-not-allowed'").select("path", "at", "message")


@query(LINKED + "SELECT 'talks/' || c || '.md' AS path, '/$sections/0' AS \"at\" FROM live")
def vql_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by an anchor's name, explicit or derived."""
    return linked_store(spark, sf_dir).query("@anchors:t0 @anchors:fir*", "nodes").select("path", "at")


@query(LINKED + "SELECT DISTINCT 'talks/' || c || '.md' AS path FROM links WHERE status IN ('ok', 'aliased')")
def vql_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a reference that reaches something."""
    return linked_store(spark, sf_dir).query("@refs:*").select("path")


@query(LINKED + "SELECT DISTINCT 'talks/' || c || '.md' AS path FROM links WHERE status IN ('ok', 'aliased') AND hit = '/$sections/0' AND 'talks/' || d || '.md' LIKE 'talks/1%'")
def vql_refs_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that cite a record whose name starts with 1 or something in one."""
    return linked_store(spark, sf_dir).query("@refs:talks/1*").select("path")


@query(ISSUES + "SELECT path FROM issues WHERE path LIKE '%.md' GROUP BY path HAVING count(*) > 5")
def vql_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with more than five issues."""
    return linked_store(spark, sf_dir).query("@issues:>5").select("path")


@query("SELECT 'notes/' || doc_id || '.md' AS path FROM documents WHERE lang = 'en' AND source <> 'src0'")
def vql_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one tag and without another."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").select(record_path("notes", F.col("doc_id"), "md").alias("path"), F.concat(F.lit('# Note<a class="'), "lang", F.lit(" "), "source", F.lit('"></a>\n')).alias("t"))
    return Store(docs.select("path", F.encode("t", "UTF-8").alias("content"), F.length("t").cast("long").alias("size")), Config()).query("@tags:en -@tags:src0").select("path")


#: A turn's body as it stands in its record, and its section.
BODY = "regexp_replace(text, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') || CASE WHEN turn > 0 THEN '\n\n[before](' || (conv_id - 1) || '.md#' || role || ')' ELSE '' END"


@query(f"SELECT 'talks/3.md' AS path, '/$sections/1' AS \"at\", {BODY} AS body FROM conversations WHERE conv_id = 3 AND turn = 1")
def get_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).get("talks/3.md#t1", "body")


@query(f"SELECT 'talks/3.md' AS path, '{{\"$anchor\":\"t1\",\"$body\":' || to_json({BODY}) || ',\"$title\":' || to_json(role || ' 1') || '}}' AS value FROM conversations WHERE conv_id = 3 AND turn = 1")
def get_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section as canonical JSON."""
    return store(spark, sf_dir).get("talks/3.md#t1").select("path", "value")


@query("SELECT '## ' || role || ' 1<a id=\"t1\"></a>\n\n' || text || '\n\n[before](' || (conv_id - 1) || '.md#' || role || ')\n' || CASE WHEN (SELECT max(turn) FROM conversations WHERE conv_id = 3) > 1 THEN '\n' ELSE '' END AS source FROM conversations WHERE conv_id = 3 AND turn = 1")
def get_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's bytes."""
    return store(spark, sf_dir).get("talks/3.md#t1", "source").select("source")


@query("SELECT 'talks/' || conv_id || '.md' AS path, 'talks' AS collection, CAST(conv_id AS VARCHAR) AS key, 'Conversation ' || conv_id AS title, CAST(count(*) AS VARCHAR) AS turns FROM conversations GROUP BY conv_id")
def default_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search shows of a record unless told otherwise: key, title and the fields that its schema marks."""
    schema = {"properties": {"turns": {"type": "integer", "x-vmd-summary": True}, "id": {"type": "integer"}}}
    s = Store(markdown_files(spark, sf_dir), Config(collections={"talks": {"match": ["talks/*"], "key": "id", "schema": schema}}))
    found = s.projected(s.query("id:*"))
    return found.select("path", "collection", "key", "title", F.try_element_at("fields", F.lit("/turns")).alias("turns"))


@query("""SELECT path, format, "at", str, num FROM (SELECT c_custkey AS k, unnest(['json', 'yaml', 'md']) AS format, c_name, c_acctbal FROM customer), LATERAL (SELECT 'c/' || k || '.' || format AS path, unnest(['/name', '/balance']) AS "at", unnest([c_name, NULL]) AS str, unnest([NULL, c_acctbal]) AS num)""")
def written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as JSON, YAML and Markdown records and read back: leaves by exact path."""
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
    value = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    files = None
    for kind in ("json", "yaml", "md"):
        part = written(rows.select(record_path("c", F.col("c_custkey"), kind).alias("path"), value.alias("value")), kind)
        files = part if files is None else files.unionByName(part)
    nodes = exploded(parse_files(files.select("path", "content"), ("nodes",)), "nodes").where("at in ('/name', '/balance')")
    return nodes.select("path", F.substring_index("path", ".", -1).alias("format"), "at", "str", "num")


@query("""SELECT doc_id, line, start FROM (SELECT doc_id, line, t, coalesce(sum(octet_length(encode(t)) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, count(*) OVER (PARTITION BY doc_id) AS n
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)) WHERE NOT (t = '' AND line = n AND n > 1)""")
def line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of every line of every text."""
    starts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.line_starts(F.encode("text", "UTF-8"))).alias("i", "start"))
    return starts.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "start")
