"""Addresses, references, uniqueness, schemas, checks and increments over tables read as stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, uri
from ..operators import checks, listing, references, resolve
from ..schema import logical
from ..sources.tables import conversation_nodes, document_files, key_files, key_refs, order_nodes, page_links, record_path, table
from .registry import query
from .storage import KEYS


def order_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_nodes(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def no_anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, name string, at string, kind string")


@query("SELECT o_orderkey, CAST(o_orderpriority AS VARCHAR) AS value FROM orders")
def exact_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exact address a record, all resolved by one equi-join."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("address_id"), record_path("orders", F.col("o_orderkey")).alias("path"), F.lit("exact").alias("kind"), F.array(F.lit("/o_orderpriority")).alias("steps"))
    nodes = order_store(spark, sf_dir)
    found = resolve.exact(asked, nodes)
    return found.join(nodes.select("path", "at", "value"), ["path", "at"]).select(F.col("address_id").alias("o_orderkey"), "value")


@query("SELECT l_orderkey, count(*) AS n, min(l_quantity) AS quantity FROM lineitem WHERE l_linenumber = 2 GROUP BY l_orderkey HAVING count(*) = 1")
def keyed_list_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders/K.json#lineitems/2/l_quantity: a keyed list's item by key, then its member, where the key is unique."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("address_id"), record_path("orders", F.col("o_orderkey")).alias("path"), F.lit("semantic").alias("kind"), F.array(F.lit("lineitems"), F.lit("2"), F.lit("l_quantity")).alias("steps"))
    nodes = order_store(spark, sf_dir)
    found = resolve.semantic(asked, nodes, no_anchors(spark), 3).where("status = 'ok'")
    # No address goes on by anchors here, so that a node is reached by its own step.
    values = found.join(nodes.where("step = 'l_quantity'").select("path", "at", "value"), ["path", "at"]).distinct()
    return values.groupBy(F.col("address_id").alias("l_orderkey")).agg(F.count("*").alias("n"), F.min(F.col("value").cast("double")).alias("quantity"))


TURNS = "(SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations)"


def turn_addresses(spark: SparkSession, sf_dir: str, step: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select(F.col("conv_id").alias("address_id"), record_path("conversations", F.col("conv_id")).alias("path"), F.lit("semantic").alias("kind"), F.array(F.lit(step)).alias("steps"))


@query(f"""SELECT c.conv_id, coalesce(s.status, 'not-found') AS status, s.at FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, '/$sections/' || turn AS "at" FROM {TURNS} WHERE role = 'assistant') s ON c.conv_id = s.conv_id""".replace("s.at", 's."at"'))
def ambiguous_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#assistant as a singular address: ambiguous where the role repeats, with every candidate."""
    nodes = conversation_nodes(table(spark, sf_dir, "conversations"))
    found = resolve.resolve(turn_addresses(spark, sf_dir, "assistant"), nodes, no_anchors(spark), 1)
    return found.select(F.col("address_id").alias("conv_id"), "status", "at")


@query("""SELECT conv_id, 'ok' AS status, '/$sections/' || turn AS "at" FROM conversations WHERE role = 'assistant'
UNION ALL SELECT DISTINCT conv_id, 'not-found', NULL FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant')""")
def semantic_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#assistant as a selector: every match."""
    nodes = conversation_nodes(table(spark, sf_dir, "conversations"))
    found = resolve.resolve(turn_addresses(spark, sf_dir, "assistant"), nodes, no_anchors(spark), 1, singular=False)
    return found.select(F.col("address_id").alias("conv_id"), "status", "at")


@query("""SELECT 'conversations/' || conv_id || '.json' AS path, '/$sections/' || turn AS "at", '#anchor-' || turn AS address FROM conversations WHERE turn % 2 = 0
UNION ALL SELECT 'conversations/' || conv_id || '.json', '/$sections/' || turn, CASE WHEN n = 1 THEN '#' || role ELSE '#/$sections/' || turn END FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations) WHERE turn % 2 = 1
UNION ALL SELECT DISTINCT 'conversations/' || conv_id || '.json', '', '' FROM conversations""")
def canonical_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit anchors on even turns; other turns by their key if it is unique, else by exact path."""
    from pyspark.sql import Window

    nodes = conversation_nodes(table(spark, sf_dir, "conversations"))
    shared = F.count("*").over(Window.partitionBy("path", "parent", "step")) > 1
    steps = F.when(F.col("at") == "", F.array().cast("array<string>")).otherwise(F.array("step"))
    nodes = nodes.select("path", "at", "parent", "step", steps.alias("steps"), F.lit(None).cast("array<string>").alias("anchor_steps"), (F.col("step").isNotNull() & shared).alias("repeated"))
    turn = F.regexp_extract("at", "([0-9]+)$", 1)
    anchors = nodes.where((F.col("at") != "") & (turn.try_cast("int") % 2 == 0)).select("path", F.concat(F.lit("anchor-"), turn).alias("name"), "at", F.lit("explicit").alias("kind"))
    return resolve.canonical(nodes, anchors)


@query("""WITH r AS (SELECT 'orders/' || o_orderkey || '.json#o_custkey' AS ref_id, o_custkey AS k, 'customer' AS t FROM orders
UNION ALL SELECT 'customer/' || c_custkey || '.json#c_nationkey', c_nationkey, 'nation' FROM customer
UNION ALL SELECT 'supplier/' || s_suppkey || '.json#s_nationkey', s_nationkey, 'nation' FROM supplier
UNION ALL SELECT 'nation/' || n_nationkey || '.json#n_regionkey', n_regionkey, 'region' FROM nation)
SELECT ref_id, CASE WHEN k IS NULL THEN 'outside' WHEN t = 'customer' AND k IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) OR t = 'nation' AND k IN (SELECT n_nationkey FROM nation) OR t = 'region' AND k IN (SELECT r_regionkey FROM region) THEN 'ok' ELSE 'dangling' END AS status FROM r""")
def refs_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as references, with every seventh customer's file gone."""
    files = key_files(spark, sf_dir).where(~(F.col("path").startswith("customer/") & (F.regexp_extract("path", "([0-9]+)", 1).try_cast("long") % 7 == 0)))
    return references.record_status(key_refs(spark, sf_dir), files).select("ref_id", "status")


def resolved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.record_status(key_refs(spark, sf_dir), key_files(spark, sf_dir)).withColumn("target_at", F.lit(""))


@query("SELECT 'customer/' || c_custkey || '.json#c_nationkey' AS ref_id FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'supplier/' || s_suppkey || '.json#s_nationkey' FROM supplier WHERE s_nationkey = 7")
def refs_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.backlinks(resolved_keys(spark, sf_dir), "nation/7.json").select("ref_id")


@query("SELECT 'orders/' || o_orderkey || '.json#o_custkey' AS ref_id, 'customer/' || o_custkey || '.json' AS target FROM orders WHERE o_orderkey = 7")
def refs_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.outgoing(resolved_keys(spark, sf_dir), "orders/7.json").select("ref_id", "target")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
SELECT record, "at", CAST(count(DISTINCT ref_id) AS BIGINT) AS n_refs FROM (
  SELECT 'orders/' || l_orderkey || '.json' AS record, l_partkey || '-' || l_suppkey || '-' || l_orderkey || '-' || l_linenumber AS ref_id, unnest(['', '/lineitems', '/lineitems/' || l_linenumber]) AS "at" FROM t
) GROUP BY ALL""")
def refs_in_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References into each node or below it: items cited by (part, supplier) records."""
    items = table(spark, sf_dir, "lineitem")
    ref_id = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")))
    refs = items.select(ref_id.alias("ref_id"), F.lit("ok").alias("status"), record_path("orders", F.col("l_orderkey")).alias("record"), F.concat(F.lit("/lineitems/"), F.col("l_linenumber").cast("string")).alias("target_at"))
    return references.counts_into(refs)


@query("""WITH RECURSIVE a AS (SELECT c_custkey AS s, c_custkey // 2 AS t FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey // 2 > 0), live AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 = 0),
w AS (SELECT s, t, 1 AS n FROM a UNION ALL SELECT w.s, a.t, n + 1 FROM w JOIN a ON w.t = a.s WHERE w.t NOT IN (SELECT k FROM live) AND n < 40)
SELECT 'customer/' || s || '.json' AS source, 'customer/' || t || '.json' AS target FROM w WHERE t IN (SELECT k FROM live)""")
def alias_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old paths that lead, over any number of aliases, to a live one."""
    k = F.col("c_custkey")
    half = F.floor(k / 2).cast("long")
    customers = table(spark, sf_dir, "customer")
    aliases = customers.where((k % 5 != 0) & (half > 0)).select(record_path("customer", k).alias("source"), record_path("customer", half).alias("target"), k.alias("line"))
    live = customers.where(k % 5 == 0).select(record_path("customer", k).alias("path"))
    return references.alias_chains(aliases, live)


@query("SELECT 'customer/' || c_custkey || '.json' AS source FROM customer WHERE c_custkey % 4 = 0")
def alias_shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    aliases = table(spark, sf_dir, "customer").where(k % 2 == 0).select(record_path("customer", k).alias("source"))
    files = table(spark, sf_dir, "customer").where(k % 4 == 0).select(record_path("customer", k).alias("path"))
    return references.shadowed(aliases, files)


@query("""SELECT page_id, position, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(href, '//') THEN 'outside' WHEN href = '/' OR ends_with(href, '/') THEN 'directory' ELSE 'path' END AS kind
FROM (SELECT page_id, CAST(i - 1 AS INTEGER) AS position, h[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS h FROM pages), unnest(range(1, len(h) + 1)) AS u(i))""")
def uri_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, resolved against the page's own path."""
    links = page_links(table(spark, sf_dir, "pages"))
    citing = F.regexp_replace("url", "^[a-z]+://", "")
    return links.select("page_id", "position", "href", uri.resolve(F.col("href"), citing)["kind"].alias("kind"))


@query("SELECT 'conversations/' || conv_id || '.json' AS path, 'duplicate-key' AS code, '/$sections/' || turn AS \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n > 1")
def duplicate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_keys(conversation_nodes(table(spark, sf_dir, "conversations"))).select("path", "code", "at")


@query("SELECT 'docs/' || source AS path, 'duplicate-anchor' AS code, CAST(doc_id AS VARCHAR) AS \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def duplicate_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source that share a length, as anchors of one record."""
    docs = table(spark, sf_dir, "documents")
    anchors = docs.select(F.concat(F.lit("docs/"), "source").alias("path"), F.col("n_chars").cast("string").alias("name"), F.col("doc_id").cast("string").alias("at"), F.col("doc_id").alias("doc_order"))
    return checks.duplicate_anchors(anchors).select("path", "code", "at")


@query("""WITH i AS (SELECT 'orders/' || l_orderkey || '.json' AS path, '/lineitems/' || l_linenumber AS "at", l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)
SELECT path, 'duplicate-key' AS code, l_suppkey::VARCHAR AS message, count(*) AS n FROM i WHERE n > 1 GROUP BY ALL""")
def map_vs_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items keyed by supplier: a map forbids repeats, and a multimap (here, no check) would allow them."""
    items = table(spark, sf_dir, "lineitem").select(record_path("orders", F.col("l_orderkey")).alias("path"), F.lit("/lineitems").alias("list_at"), F.concat(F.lit("/lineitems/"), F.col("l_linenumber").cast("string")).alias("at"), F.col("l_suppkey").cast("string").alias("key"), F.struct("l_linenumber", "l_partkey").alias("doc_order"))
    found = checks.keyed_list_issues(items, [], unique=True)
    return found.groupBy("path", "code", "message").agg(F.count("*").alias("n"))


@query("""SELECT 'orders/' || l_orderkey || '.json' AS path, k AS message FROM (SELECT DISTINCT l_orderkey FROM lineitem) o, unnest(['1', '2', '3']) AS u(k)
WHERE (o.l_orderkey, k) NOT IN (SELECT (l_orderkey, CAST(l_linenumber AS VARCHAR)) FROM lineitem)""")
def required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(record_path("orders", F.col("l_orderkey")).alias("path"), F.lit("/lineitems").alias("list_at"), F.lit("").alias("at"), F.col("l_linenumber").cast("string").alias("key"), F.lit(0).alias("doc_order"))
    return checks.keyed_list_issues(items, ["1", "2", "3"], unique=False).where("code = 'keyed-list-required'").select("path", "message")


def order_rules() -> dict[str, Column]:
    c = F.col
    return {"o_orderstatus": c("o_orderstatus").isin("F", "O"), "o_totalprice": c("o_totalprice").between(1000, 400000), "o_orderpriority": c("o_orderpriority").rlike("^[1-5]-[A-Z ]+$")}


VIOLATIONS = """(SELECT 'orders/' || o_orderkey || '.json' AS path, unnest(list_filter([CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN '/o_orderstatus' END, CASE WHEN NOT o_totalprice BETWEEN 1000 AND 400000 THEN '/o_totalprice' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$') THEN '/o_orderpriority' END], lambda x: x IS NOT NULL)) AS "at" FROM orders)"""


@query(f'SELECT path, "at", \'schema-violation\' AS code FROM {VIOLATIONS}')
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("path", record_path("orders", F.col("o_orderkey")))
    return checks.violations(rows, order_rules()).select("path", "at", "code")


@query("""SELECT event_id, ts_text, regexp_matches(ts_text, '^\\d{4}-\\d{2}-\\d{2}$') AS is_date, regexp_matches(ts_text, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$') AS is_date_time,
regexp_matches(v, '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$') AS is_decimal, regexp_matches(v, '^-?(0|[1-9][0-9]*)$') AS is_int64
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y/%m/%d') END AS ts_text, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE '1.5' END AS v FROM events)""")
def logical_type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    shown = F.when(e % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(e % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy/MM/dd"))
    rows = table(spark, sf_dir, "events").select("event_id", shown.alias("ts_text"), F.when(e % 2 == 0, e.cast("string")).otherwise(F.lit("1.5")).alias("v"))
    t, v, ok = F.col("ts_text"), F.col("v"), logical.ACCEPTS
    return rows.select("event_id", "ts_text", ok["date"](t).alias("is_date"), ok["date-time"](t).alias("is_date_time"), ok["decimal"](v).alias("is_decimal"), ok["int64"](v).alias("is_int64"))


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100")
def logical_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-times with offsets in text form, sorted by instant through the key struct."""
    e = F.col("event_id")
    # The same instant written in UTC or with an offset of two hours.
    local = F.date_format(F.when(e % 2 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 2 HOURS")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shown = F.concat(local, F.when(e % 2 == 0, "Z").otherwise("+02:00"))
    rows = table(spark, sf_dir, "events").select("event_id", logical.KEYS["date-time"](shown).alias("key"))
    return rows.orderBy("key", "event_id").limit(100).select("event_id")


@query("""SELECT DISTINCT path FROM (SELECT 'nation/' || n_nationkey || '.json' AS path FROM nation WHERE n_regionkey = 2
UNION SELECT 'customer/' || c_custkey || '.json' FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)
UNION SELECT 'supplier/' || s_suppkey || '.json' FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))""")
def changed_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to check again after some nations changed: they and the records that cite them."""
    changed = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(record_path("nation", F.col("n_nationkey")).alias("path"))
    return references.changed_scope(changed, key_refs(spark, sf_dir))


@query("SELECT page_id, slug, n FROM (SELECT page_id, slug, count(*) OVER (PARTITION BY slug) AS n FROM (SELECT page_id, regexp_replace(lower(trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[^ -~]', '', 'g'))), '[^a-z0-9_-]', '', 'g') AS slug FROM pages))")
def slug_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    h1 = F.trim(F.regexp_replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), "[^ -~]", ""))
    slug = F.regexp_replace(text.slug_ascii(F.regexp_replace(h1, " ", "")), " ", "")
    rows = table(spark, sf_dir, "pages").select("page_id", slug.alias("slug"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("slug")))


@query("SELECT 'conversations/' || conv_id || '.json' AS path, '/$sections/' || turn AS \"at\", role AS title, octet_length(encode(text)) AS size FROM conversations WHERE conv_id = 3")
def outline_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's sections to depth one: titles and sizes without content."""
    nodes = conversation_nodes(table(spark, sf_dir, "conversations"))
    return nodes.where((F.col("path") == "conversations/3.json") & (F.col("depth") == 1)).select("path", "at", "title", F.octet_length("body").cast("long").alias("size"))


@query("SELECT role AS kind, substr(sha256('{\"$body\":' || to_json(text) || ',\"$title\":' || to_json(role) || '}'), 1, 16) AS version FROM conversations")
def node_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 of the section's canonical JSON."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)
    item = lambda c: F.regexp_replace(quoted(F.col(c)), r"\]$", "")
    canonical = F.concat(F.lit('{"$body":'), item("text"), F.lit(',"$title":'), item("role"), F.lit("}"))
    return table(spark, sf_dir, "conversations").select(F.col("role").alias("kind"), F.substring(F.sha2(canonical, 256), 1, 16).alias("version"))


@query("SELECT 'docs/' || source || '/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 10 = 0")
def incremental_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content has not been parsed before: one anti join on the content's id."""
    from ..streaming.incremental import unseen

    docs = table(spark, sf_dir, "documents")
    files = document_files(docs.withColumn("text", F.concat_ws(":", F.col("doc_id").cast("string"), "text"))).withColumn("version", text.git_blob_id(F.col("content")))
    known = files.where(F.regexp_extract("path", r"([0-9]+)\.md$", 1).try_cast("long") % 10 != 0).select("version")
    return unseen(files, known).select("path")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed folded to each record's last state."""
    from ..streaming.incremental import latest

    feed = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.struct("ts", "event_id").alias("seq"), "event_id", "value")
    return latest(feed).select(F.col("path").alias("user_id"), "event_id", "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member of a JSON unit by its pointer."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k")).where("k is not null")


@query(f"SELECT path FROM {KEYS} WHERE path > 'nation/' ORDER BY path LIMIT 10")
def byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_page(key_files(spark, sf_dir), 10, "nation/")


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..parse.arrow import derived_anchors

    turns = table(spark, sf_dir, "conversations").select(record_path("conversations", F.col("conv_id")).alias("path"), F.col("turn").alias("doc_order"), F.col("role").alias("title"))
    return derived_anchors(turns)


@query("SELECT 'conversations/' || conv_id || '.json' AS path, turn AS doc_order, CASE WHEN n = 1 THEN role ELSE role || '-' || (n - 1) END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)")
def derived_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of the turns' titles, with suffixes for repeats."""
    return _derived(spark, sf_dir).select("path", "doc_order", "anchor")
