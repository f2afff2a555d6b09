"""Keys, bindings, allowed targets, history, writes, windows and schema summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug_ascii
from ..operators import binding, checks, meta
from ..schema import logical
from ..schema.spine import summary_table
from ..sources import snapshot
from ..sources.tables import record_path, table
from ..streaming import incremental
from .records import resolved_keys
from .registry import query
from .stores import store

SCHEMA = {
    "type": "object",
    "required": ["o_orderkey"],
    "properties": {
        "o_orderkey": {"type": "integer", "format": "int64"},
        "o_orderpriority": {"enum": ["5-LOW", "3-MEDIUM", "1-URGENT"], "x-vmd-ordered": True, "x-vmd-summary": True},
        "lineitems": {"type": "array", "x-vmd-list": {"type": "map", "keys": ["l_linenumber"]}, "items": {"type": "object", "properties": {"l_quantity": {"type": "number"}}}},
    },
}


@query("""SELECT * FROM (VALUES ('/o_orderkey', 'integer', true, '', 'int64', '', false, false), ('/o_orderpriority', '', false, '5-LOW,3-MEDIUM,1-URGENT', '', '', true, true),
('/lineitems', 'array', false, '', '', 'l_linenumber', false, false), ('/lineitems/*/l_quantity', 'integer,number', false, '', '', '', false, false)) t(path, types, required, enum, format, list_key, summary, ordered)""")
def schema_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return summary_table(spark, SCHEMA).select("path", join("types"), "required", join("enum"), F.coalesce("format", F.lit("")).alias("format"), F.coalesce("list_key", F.lit("")).alias("list_key"), "summary", "ordered")


@query("SELECT 'orders/' || o_orderkey || '.json' AS path, 'orders' AS collection, CAST(o_orderkey AS VARCHAR) AS key FROM orders UNION ALL SELECT 'customer/' || c_custkey || '.json', 'customers', c_mktsegment FROM customer")
def collection_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's collection key: from its file name, or from a field."""
    o = table(spark, sf_dir, "orders").select(record_path("orders", F.col("o_orderkey")).alias("path"), F.array(F.lit("orders")).alias("collections"), F.lit("{}").alias("value"))
    c = table(spark, sf_dir, "customer").select(record_path("customer", F.col("c_custkey")).alias("path"), F.array(F.lit("customers")).alias("collections"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("value"))
    return binding.collection_keys(o.unionByName(c), {"orders": {"key": {"pattern": r"^(\d+)\.json$"}}, "customers": {"key": "segment"}})


@query("SELECT 'orders/' || o_orderkey || '.json' AS path, 'ref-target-not-allowed' AS code FROM orders UNION ALL SELECT 'nation/' || n_nationkey || '.json', 'ref-target-not-allowed' FROM nation")
def ref_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that point outside their declared targets: here, only nations are allowed."""
    refs = resolved_keys(spark, sf_dir)
    files = refs.select(F.col("record").alias("path"), F.array(F.lit("any")).alias("collections")).distinct()
    return binding.target_issues(refs.withColumn("targets", F.array(F.lit("nation/*"))), files, {("nation/*",)}, set()).select("path", "code")


@query("SELECT user_id AS path, arg_max(value, event_id) AS value FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'")
def at_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a store at half its versions: each path's last entry up to then, without removed ones."""
    history = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("revision"), "value", (F.col("event_type") == "click").alias("removed"))
    head = snapshot.head(history.select("revision")).first()["head"] or 0
    return snapshot.at_revision(history, head // 2)


@query("SELECT max(event_id) AS head FROM events")
def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.head(table(spark, sf_dir, "events").select(F.col("event_id").alias("revision")))


@query("SELECT c_custkey AS path, CASE WHEN c_custkey % 3 = 1 THEN 'new' ELSE c_name END AS version FROM customer WHERE c_custkey % 3 <> 2 UNION ALL SELECT 1000000 + c_custkey, 'added' FROM customer WHERE c_custkey % 10 = 0")
def apply_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaces, deletes and adds records in one step, each checked against the version that its writer saw."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(k.alias("path"), F.col("c_name").alias("version"))
    replaced = base.where("path % 3 = 1").select("path", F.col("version").alias("expected"), F.lit("new").alias("version"))
    deleted = base.where("path % 3 = 2").select("path", F.col("version").alias("expected"), F.lit(None).cast("string").alias("version"))
    added = base.where("path % 10 = 0").select((F.col("path") + 1000000).alias("path"), F.lit(None).cast("string").alias("expected"), F.lit("added").alias("version"))
    return incremental.apply(base, replaced.unionByName(deleted).unionByName(added))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the windowed stream, over the whole feed at once."""
    return incremental.windowed_counts(table(spark, sf_dir, "events"), "event_type")


@query("""SELECT 'talks/' || conv_id || '.md' AS path, '/$sections/' || turn AS "at", '#t' || turn AS address FROM conversations
UNION ALL SELECT 'talks/' || conv_id || '.md', '/$sections/' || turn || '/$body', '#t' || turn || '/$body' FROM conversations
UNION ALL SELECT DISTINCT 'talks/' || conv_id || '.md', '/turns', '#turns' FROM conversations""")
def store_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical addresses of parsed sections, their bodies and a field."""
    s = store(spark, sf_dir)
    found = meta.addresses(s.nodes, s.anchors)
    return found.where(F.col("at").rlike(r"^/\$sections/[0-9]+(/\$body)?$") | (F.col("at") == "/turns"))


@query("""SELECT 'talks/' || conv_id || '.md' AS path, '/$sections/' || turn AS "at", 't' || turn AS key, 1 AS depth, 'talks' AS collection FROM conversations""")
def store_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed fields of sections: only what is asked for is joined."""
    found = meta.computed(store(spark, sf_dir), ["@key", "@depth", "@collection"])
    return found.where(F.col("at").rlike(r"^/\$sections/[0-9]+$")).select("path", "at", F.col("`@key`").alias("key"), F.col("`@depth`").alias("depth"), F.col("`@collection`").alias("collection"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def decimal_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals as texts, in numeric order by their key."""
    price = F.format_string("%.2f", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", logical.KEYS["decimal"](price).alias("key"))
    return rows.orderBy(F.desc("key"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber")


@query("SELECT role AS title, regexp_replace(lower(role), '[^a-z0-9_-]', '', 'g') AS key, count(*) AS n FROM conversations GROUP BY 1, 2")
def section_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("title"), slug_ascii(F.col("role")).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT source AS path, doc_id AS position, lang AS tag, 'duplicate-tag' AS code FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def duplicate_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.lit("").alias("at"), F.col("lang").alias("tag"), F.col("doc_id").alias("position"))
    again = checks.repeated(tags, ["path", "at", "tag"], "position")
    return again.select("path", "position", "tag", F.lit("duplicate-tag").alias("code"))
