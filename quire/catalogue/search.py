"""The search language over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, has_word
from ..plans.query import Sort, excerpt, page, per_record, search, totals
from ..plans.scopes import Field, TableScope
from ..sources.tables import conversation_nodes, record_path, table
from .registry import query

PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def order_scope() -> TableScope:
    c = F.col
    return TableScope(
        {
            "o_orderkey": Field(c("o_orderkey").cast("double"), "number"), "o_custkey": Field(c("o_custkey").cast("double"), "number"),
            "o_orderstatus": Field(c("o_orderstatus")), "o_totalprice": Field(c("o_totalprice"), "number"),
            "o_orderdate": Field(c("o_orderdate"), "date"), "o_orderpriority": Field(c("o_orderpriority"), order=PRIORITIES),
        },
        path=record_path("orders", c("o_orderkey")), collection="orders",
    )


def orders(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return search(table(spark, sf_dir, "orders"), text, order_scope()).select(*ORDER_COLUMNS)


COLS = ", ".join(ORDER_COLUMNS)


@query(f"SELECT {COLS} FROM orders WHERE lower(o_orderstatus) = 'o' AND o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def vql_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter, a sort and a page."""
    found = search(table(spark, sf_dir, "orders"), "o_orderstatus:o o_totalprice:>200000", order_scope())
    return page(found, [Sort("o_totalprice", True)], ["o_orderkey"], 50).select(*ORDER_COLUMNS)


@query(f"SELECT {COLS} FROM orders WHERE lower(o_orderstatus) = 'f'")
def vql_eq_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_orderstatus:F")


@query(f"SELECT {COLS} FROM orders WHERE starts_with(lower(o_orderpriority), '1-urg')")
def vql_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_orderpriority:1-URG*")


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def vql_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = TableScope({"lang": Field(F.col("lang"))})
    return search(table(spark, sf_dir, "documents"), "lang:*", scope).select("doc_id", "lang")


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(quality = 1, false)")
def vql_negation_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing field makes the term false, so that its negation holds."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return search(rows, "-quality:1", TableScope({"quality": Field(F.col("quality").cast("double"), "number")}))


@query(f"SELECT {COLS} FROM orders WHERE o_totalprice >= 150000 AND o_totalprice < 200000")
def vql_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_totalprice:>=150000 o_totalprice:<200000")


@query(f"SELECT {COLS} FROM orders WHERE o_totalprice >= 300000 OR o_totalprice <= 20000")
def vql_range_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_totalprice:300000..* OR o_totalprice:*..20000")


@query(f"SELECT {COLS} FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'")
def vql_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_orderdate:1995-01-01..1995-06-30")


@query(f"SELECT {COLS} FROM orders WHERE list_position({list(PRIORITIES)!r}, o_orderpriority) >= 3")
def vql_enum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_orderpriority:>=3-MEDIUM")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (lower(l_returnflag) = 'r' OR l_quantity > 45) AND NOT (lower(l_linestatus) = 'o' AND l_discount >= 0.05)")
def vql_bool_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    scope = TableScope({"flag": Field(c("l_returnflag")), "status": Field(c("l_linestatus")), "quantity": Field(c("l_quantity"), "number"), "discount": Field(c("l_discount"), "number")})
    return search(table(spark, sf_dir, "lineitem"), "(flag:R OR quantity:>45) NOT (status:O AND discount:>=0.05)", scope).select("l_orderkey", "l_linenumber")


def text_scope(prose: bool = False) -> TableScope:
    return TableScope({"lang": Field(F.col("lang")), "source": Field(F.col("source"))}, body=F.col("text"), prose_only=prose)


TOKENS = r"list_contains(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), 'thereof')"


@query(r"SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), 'idiot')")
def vql_fulltext_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), "Idiot", text_scope()).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), lambda w: starts_with(w, 'worthl'))) > 0")
def vql_fulltext_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), "worthl*", text_scope()).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the and attion')")
def vql_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), '"The and attion"', text_scope()).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), 'en') AND lower(lang) <> 'en'")
def vql_text_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text limited to prose: the language field doesn't count."""
    return search(table(spark, sf_dir, "documents"), "@text:en -lang:en", text_scope(prose=True)).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE regexp_matches('docs/' || source || '/' || doc_id || '.md', '^docs/src1[^/]*/[^/]*\\.md$') AND lower(lang) = 'de'")
def vql_path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = text_scope()
    scope.path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return search(table(spark, sf_dir, "documents"), "@path:docs/src1*/*.md lang:de", scope).select("doc_id", "source")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_nodes(table(spark, sf_dir, "conversations"))


@query("SELECT 'conversations/' || conv_id || '.json' AS path, '/$sections/' || turn AS \"at\", role AS title FROM conversations WHERE lower(role) = 'user'")
def vql_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(turns(spark, sf_dir), "@title:USER", TableScope({}, title=F.col("title"), body=F.col("body"))).select("path", "at", "title")


@query("SELECT 'conversations/' || conv_id || '.json' AS path, '/$sections/' || turn AS \"at\" FROM conversations WHERE turn + 1 >= 3 AND lower(role) = 'assistant'")
def vql_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed fields beside stored ones: depth, key and position."""
    scope = TableScope({"order": Field(F.col("doc_order").cast("double"), "number")}, title=F.col("title"), computed={"@depth": Field(F.col("depth").cast("double"), "number"), "@key": Field(F.col("step"))})
    return search(turns(spark, sf_dir), "@depth:1 @key:assistant order:>=3", scope).select("path", "at")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity > 40")
def vql_nodes_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item has no priority of its own; the term is resolved on its order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    scope = TableScope({"quantity": Field(F.col("l_quantity"), "number")}, ancestors=[{"priority": Field(F.col("o_orderpriority"))}])
    return search(rows, "priority:1-urgent quantity:>40", scope).select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("SELECT path, \"at\", n_matches, match_no FROM (SELECT 'conversations/' || conv_id || '.json' AS path, '/$sections/' || turn AS \"at\", count(*) OVER (PARTITION BY conv_id) AS n_matches, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS match_no FROM conversations WHERE lower(role) = 'user') WHERE match_no <= 2")
def vql_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(turns(spark, sf_dir), "@title:user", TableScope({}, title=F.col("title"), body=F.col("body")))
    return per_record(found, "path", "doc_order", 2).select("path", "at", "n_matches", "match_no")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 49")
def vql_any_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array field matches if any element does."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("quantities"))
    return search(rows, "quantities:>=49", TableScope({"quantities": Field(F.col("quantities"), "number", many=True)})).select("l_orderkey")


@query(f"SELECT {COLS} FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderpriority, o_orderkey LIMIT 100")
def vql_sort_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "orders"), "o_totalprice:>100000", order_scope())
    return page(found, [Sort("o_orderpriority")], ["o_orderkey"], 100).select(*ORDER_COLUMNS)


@query(f"SELECT {COLS} FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderpriority, o_orderkey LIMIT 30 OFFSET 30")
def vql_cursor_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a cursor, by a keyset filter."""
    from ..plans.query import make_cursor

    text = "o_totalprice:>100000"
    found = search(table(spark, sf_dir, "orders"), text, order_scope())
    sort, ties = [Sort("o_orderpriority")], ["o_orderkey"]
    last = page(found, sort, ties, 30, query=text).orderBy(F.desc("o_orderpriority"), F.desc("o_orderkey")).first()
    cursor = make_cursor(last.asDict(), sort, ties, text) if last else None
    return page(found, sort, ties, 30, cursor, text).select(*ORDER_COLUMNS)


@query("SELECT count(DISTINCT conv_id) AS n_records, count(*) AS n_matches FROM conversations WHERE lower(role) = 'user'")
def vql_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(turns(spark, sf_dir), "@title:user", TableScope({}, title=F.col("title"), body=F.col("body")))
    return totals(found, "path")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS match_quantity, o_orderstatus AS record_status FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 50")
def vql_project_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection from the match and from its record."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = search(rows, "quantity:50", TableScope({"quantity": Field(F.col("l_quantity"), "number")}))
    return found.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("match_quantity"), F.col("o_orderstatus").alias("record_status"))


@query("SELECT doc_id, CASE WHEN strpos(lower(text), 'idiot') > 0 THEN substr(text, greatest(strpos(lower(text), 'idiot') - 47, 1), 100) END AS excerpt FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), 'idiot')")
def vql_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(has_word(F.col("text"), "idiot"))
    return docs.select("doc_id", excerpt(F.col("text"), "idiot").alias("excerpt"))


@query("SELECT lower(lang) AS folded, count(*) AS n FROM documents GROUP BY 1")
def fold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(fold(F.col("lang")).alias("folded")).agg(F.count("*").alias("n"))
