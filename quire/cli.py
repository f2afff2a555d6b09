"""The command line: ls, cat, grep, outline, get, refs, schema, check, index and query over a store's folder.

Exit codes: 0 done, 1 issues with severity error, 2 wrong use, 3 the store can't be read, 4 nothing at the address.
"""

from __future__ import annotations

import argparse
import json
import sys

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.portable import PortableError, translate
from .functions.text import git_blob_id, java_quote
from .operators import checks, listing, meta, references
from .plans.query import Sort, page, per_record
from .plans.vql import VqlError
from .schema.spine import SchemaError, summary_table
from .session import session
from .sources import git
from .sources.store import ConfigError, Store

OK, ISSUES, USAGE, STORE, NOT_FOUND = range(5)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("--store", default=".")
    p.add_argument("--json", action="store_true")
    p.add_argument("--strict", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, limit: int | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in positional:
            c.add_argument(a.rstrip("?"), **({"nargs": "?"} if a.endswith("?") else {}))
        if limit:
            c.add_argument("-n", type=int, default=limit)
            c.add_argument("--cursor")
        return c

    command("ls", "glob?", limit=listing.LIST_LIMIT)
    command("cat", "path").add_argument("--lines")
    g = command("grep", "pattern", "glob?", limit=listing.GREP_LIMIT)
    g.add_argument("-F", dest="fixed", action="store_true")
    g.add_argument("-i", dest="ignore_case", action="store_true")
    g.add_argument("-C", dest="context", type=int, default=0)
    command("outline", "address").add_argument("--depth", type=int)
    g = command("get", "address")
    g.add_argument("--body", action="store_true")
    g.add_argument("--value", action="store_true")
    g.add_argument("--max-chars", type=int, default=20_000)
    g.add_argument("--meta", default="")
    g = command("refs", "address", limit=listing.REFS_LIMIT)
    g.add_argument("--from", dest="outgoing", action="store_true")
    g.add_argument("--to", dest="incoming", action="store_true")
    command("schema", "collection?")
    g = command("check", limit=listing.ISSUE_LIMIT)
    g.add_argument("paths", nargs="*")
    g.add_argument("--all", action="store_true")
    g.add_argument("--changed", metavar="REV")
    command("index", "folder")
    g = command("query", "vql", limit=20)
    g.add_argument("--collection")
    g.add_argument("--nodes", action="store_true")
    g.add_argument("--per-record", type=int, default=5)
    g.add_argument("--sort", default="")
    return p


def shown(df: DataFrame, as_json: bool) -> list[str]:
    rows = df.toJSON().collect()  # a page: bounded by its limit
    if as_json:
        return rows
    return ["  ".join("" if v is None else meta.one_line(str(v)) for v in json.loads(r).values()) for r in rows]


def run(args: argparse.Namespace, store: Store) -> tuple[int, list[str]]:
    """Exit code and output lines of a command."""
    out = lambda df: shown(df, args.json)
    if args.command == "ls":
        return OK, out(listing.list_page(store.files.select("path", "kind", "size"), args.n, args.cursor, glob=args.glob))
    texts = store.files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    if args.command == "cat":
        one = texts.where(F.col("path") == args.path)
        if args.lines:
            low, _, high = args.lines.partition(":")
            one = listing.read_lines(one, int(low or 1), int(high) + 1 if high else 1 << 30).orderBy("line")
        lines = [r["text"] for r in one.select("text").collect()]
        return (OK if lines else NOT_FOUND), lines
    if args.command == "grep":
        pattern = java_quote(args.pattern) if args.fixed else translate(args.pattern)
        test = F.col("text").rlike(("(?iu)" if args.ignore_case else "") + pattern)
        chosen = listing.select_files(texts, glob=args.glob)
        if args.context:
            return OK, out(listing.grep_context(chosen, test, args.context).orderBy("path", "line").limit(args.n))
        cursor = args.cursor.split(":", 1) if args.cursor else None
        return OK, out(listing.grep(chosen, test, args.n, (cursor[1], int(cursor[0])) if cursor else None))
    if args.command == "outline":
        found = store.resolve([args.address]).where("status = 'ok'").first()
        if found is None:
            return NOT_FOUND, []
        return OK, out(store.outline(found["path"], found["at"], args.depth))
    if args.command == "get":
        fields = [f for f in args.meta.split(",") if f]
        form = "body" if args.body else "value" if args.value else "source"
        got = store.get(args.address, form)
        if fields:
            got = got.select("path", "at").join(meta.computed(store, fields), ["path", "at"])
        elif form != "value":
            got = got.select(F.substring(form, 1, args.max_chars).alias(form))
        lines = out(got)
        return (OK if lines else NOT_FOUND), lines
    if args.command == "refs":
        found = store.resolve([args.address]).where("status = 'ok'").first()
        if found is None:
            return NOT_FOUND, []
        refs = store.resolved_refs().select("path", "at", "raw", "status", "record", "target_at")
        chosen = references.outgoing(refs, found["path"], found["at"]) if args.outgoing else references.backlinks(refs, found["path"], found["at"])
        return OK, out(chosen.orderBy("path", "at", "raw").limit(listing.bounded(args.n)))
    if args.command == "schema":
        if not args.collection:
            return OK, out(checks.collection_summary(store.records).orderBy("collection"))
        held = store.config.collections.get(args.collection)
        if held is None:
            return USAGE, [f"no collection {args.collection}"]
        text = store._text(f".vmd/schema/{held['schema']}") if isinstance(held.get("schema"), str) else None
        return OK, out(summary_table(store.all_files.sparkSession, yaml.safe_load(text) if text else held.get("schema") or {}))
    if args.command == "check":
        spark = store.all_files.sparkSession
        if args.paths and args.changed:
            raise ValueError("check takes paths or --changed, not both")
        changed = spark.createDataFrame([(p,) for p in args.paths], "path string") if args.paths else None
        if args.changed:
            versioned = store.all_files.select("path", git_blob_id(F.col("content")).alias("version"))
            changed = git.changed_since_revision(versioned, args.store, args.changed)
        issues = store.check(changed).cache()
        errors = issues.where("severity = 'error'").limit(1).count()
        listed = checks.ordered(issues) if args.all else checks.ordered(issues).limit(listing.bounded(args.n))
        return (ISSUES if errors else OK), out(listed) + out(checks.counts(issues).orderBy("code"))
    if args.command == "index":
        store.build_index(args.folder)
        return OK, []
    rows = store.query(args.vql, "nodes" if args.nodes else "records", args.collection)
    if args.strict:
        store.require_schemas(args.collection)
        rows = checks.strict(rows, store.check())
    sort = [Sort(s.lstrip("-"), s.startswith("-")) for s in args.sort.split(",") if s]
    if args.nodes:
        rows = per_record(rows, "path", "doc_order", args.per_record)
    return OK, out(page(rows.select("path", "at", "title", "key", "depth", "doc_order", "size"), sort, ["path", "doc_order"], args.n, args.cursor, args.vql))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session(**{"spark.ui.showConsoleProgress": "false"})
    try:
        code, lines = run(args, Store.open(spark, args.store).cached())
    except (VqlError, PortableError, ValueError, git.GitError) as e:
        print(e, file=sys.stderr)
        return STORE if isinstance(e, (ConfigError, git.GitError, SchemaError)) else USAGE
    print("\n".join(lines))
    return code


if __name__ == "__main__":
    sys.exit(main())
