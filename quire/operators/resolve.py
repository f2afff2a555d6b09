"""Addresses over a nodes table: (path, at, parent, step, kind, doc_order, ...) and anchors (path, name, at, kind).

An address table has (address_id, path, kind, steps): kind is exact (steps[0] is the pointer), semantic, or root.
Steps are resolved by equi-joins on (path, parent, step), one join a step up to the longest address, so a million
addresses cost the same plan as one. Singular evaluation stops at the first step with several matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escape(token: Column) -> Column:
    """A reference token of an exact path."""
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def child(at: Column, token: Column) -> Column:
    """The exact path of a member or item."""
    return F.concat(at, F.lit("/"), escape(token.cast("string")))


def exact(addresses: DataFrame, nodes: DataFrame) -> DataFrame:
    """address_id and the node at each exact path; an address without one has no row."""
    wanted = addresses.where("kind = 'exact'").select("address_id", "path", F.element_at("steps", 1).alias("at"))
    return wanted.join(nodes.select("path", "at", "doc_order"), ["path", "at"])


#: Names of one step up to which nodes are filtered by them before a join. Fixed value.
MOST_NAMES = 1_000


def step_names(addresses: DataFrame, longest: int) -> list[list[str] | None]:
    """For each step, the names that semantic addresses have there; None for a step with more than MOST_NAMES."""
    pairs = addresses.where("kind = 'semantic'").select(F.posexplode(F.slice("steps", 1, longest)).alias("n", "name")).distinct()
    held: list[list[str] | None] = [[] for _ in range(longest)]
    for r in pairs.where("name is not null").limit(longest * MOST_NAMES + 1).collect():
        held[r["n"]].append(r["name"])
    # Beyond the limit in all, names of any step may be missing.
    return [None] * longest if sum(map(len, held)) > longest * MOST_NAMES else [sorted(names) if len(names) <= MOST_NAMES else None for names in held]


def named(rows: DataFrame, column: str, names: list[str] | None) -> DataFrame:
    """rows whose column has one of the names; all of them without names."""
    return rows if names is None else rows.where(F.col(column).isin(names))


def first_step(addresses: DataFrame, nodes: DataFrame, anchors: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Nodes that the first step reaches: a member or key of the root, or an anchor of the record, each node once,
    with `ways` (key, explicit, derived, block). names has all first steps, if they are few."""
    nodes, anchors = named(nodes, "step", names), named(anchors, "name", names)
    wanted = addresses.where("kind = 'semantic'").select("address_id", "path", "steps", F.element_at("steps", 1).alias("name"))
    by_key = wanted.join(nodes.where("parent = ''").select("path", F.col("step").alias("name"), "at"), ["path", "name"]).withColumn("way", F.lit("key"))
    by_anchor = wanted.join(anchors.select("path", "name", "at", F.col("kind").alias("way")), ["path", "name"])
    both = by_key.select("address_id", "path", "steps", "at", "way").unionByName(by_anchor.select("address_id", "path", "steps", "at", "way"))
    return both.groupBy("address_id", "path", "steps", "at").agg(F.array_sort(F.collect_set("way")).alias("ways"))


def first_names(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(path, name, at): every name that a first step reaches in a record, and where."""
    keys = nodes.where("parent = '' and step is not null").select("path", F.col("step").alias("name"), "at")
    return keys.unionByName(anchors.select("path", "name", "at")).distinct()


def semantic(addresses: DataFrame, nodes: DataFrame, anchors: DataFrame, longest: int, singular: bool = True) -> DataFrame:
    """(address_id, path, at, status, step): the nodes reached, with status ok or ambiguous and the step reached.

    longest is the greatest number of steps among the addresses. In singular mode a step with several matches ends
    its address there as ambiguous; a selector goes on with every match. Ended rows ride along, so that the plan is
    one chain of a join and a window a step. Where a step has few names in all addresses, only nodes with one of them are joined.
    """
    names = step_names(addresses, longest)
    now = first_step(addresses, nodes, anchors, names[0]).select("address_id", "path", "steps", "at")
    now = now.withColumn("status", F.lit(None).cast("string")).withColumn("step", F.lit(None).cast("int"))
    links = nodes.select("path", F.col("parent").alias("at"), F.col("step").alias("name"), F.col("at").alias("next"))
    for n in range(1, longest + 1):
        several = F.count("*").over(Window.partitionBy("address_id")) > 1 if singular else F.lit(False)
        ended = F.when(several, "ambiguous").when(F.size("steps") == n, "ok")
        now = now.withColumn("now", F.coalesce("status", ended)).withColumn("step", F.coalesce("step", F.when(F.col("now").isNotNull(), F.lit(n)))).drop("status").withColumnRenamed("now", "status")
        if n < longest:
            asked = now.withColumn("name", F.when(F.col("status").isNull(), F.get("steps", F.lit(n))))
            now = asked.join(named(links, "name", names[n]), ["path", "at", "name"], "left").where(F.col("status").isNotNull() | F.col("next").isNotNull())
            now = now.select("address_id", "path", "steps", F.coalesce("next", "at").alias("at"), "status", "step")
    return now.where("status is not null").select("address_id", "path", "at", "status", "step")


def resolve(addresses: DataFrame, nodes: DataFrame, anchors: DataFrame, longest: int, singular: bool = True) -> DataFrame:
    """Every address with status ok, ambiguous or not-found, and one row per node (at null if none).

    Only the kinds that some address has are looked for: each reads the nodes, an exact path all of them.
    """
    kinds = {r["kind"] for r in addresses.select("kind").distinct().collect()}
    roots = addresses.where("kind = 'root'").join(nodes.where("at = ''").select("path"), "path", "left_semi").select("address_id", F.lit("").alias("at"), F.lit("ok").alias("status"))
    by_path = exact(addresses, nodes).select("address_id", "at", F.lit("ok").alias("status"))
    found = roots if "exact" not in kinds else roots.unionByName(by_path)
    if "semantic" in kinds:
        found = found.unionByName(semantic(addresses, nodes, anchors, longest, singular).select("address_id", "at", "status"))
    return addresses.select("address_id", "path").join(found, "address_id", "left").select("address_id", "path", "at", F.coalesce("status", F.lit("not-found")).alias("status"))


def ancestors(at: Column) -> Column:
    """Exact paths of all ancestors and the node itself, root ('') first."""
    parts = F.split(at, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def below(at: Column, top: Column) -> Column:
    """Whether a node is `top` or below it."""
    return (at == top) | at.startswith(F.concat(top, F.lit("/")))


def canonical(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(path, at, address) of every node: the first form that names it alone.

    Forms in order: its explicit anchor; the keys from the nearest anchored ancestor, or from the root; its derived
    anchor; its exact path. A form is safe if its first step names one node and no sibling shares a later key, both
    counted once for all nodes by aggregation; nothing is resolved node by node.
    """
    # nodes has: path, at, parent, step, steps (keys from the root), anchor_steps (keys below the nearest anchored
    # ancestor, headed by its anchor) or null, repeated (whether any of its own or ancestors' keys is shared by a sibling).
    uses = (
        nodes.where("parent = '' and at <> ''").select("path", F.col("step").alias("name"), "at")
        .unionByName(anchors.select("path", "name", "at")).distinct()
        .groupBy("path", "name").agg(F.count("*").alias("uses"))
    )
    own = anchors.where("kind = 'explicit'").groupBy("path", "at").agg(F.min("name").alias("own"))
    derived = anchors.where("kind = 'derived'").groupBy("path", "at").agg(F.min("name").alias("derived"))
    n = nodes.join(own, ["path", "at"], "left").join(derived, ["path", "at"], "left")
    n = n.withColumn("route", F.coalesce("anchor_steps", "steps")).withColumn("head", F.when(F.size("route") > 0, F.element_at("route", 1)))

    def unique(name: str, label: str) -> DataFrame:
        return uses.where("uses = 1").select("path", F.col("name").alias(name), F.lit(True).alias(label))

    n = n.join(unique("own", "own_ok"), ["path", "own"], "left").join(unique("head", "head_ok"), ["path", "head"], "left").join(unique("derived", "derived_ok"), ["path", "derived"], "left")
    encode = lambda s: encode_step(s)
    route_ok = F.col("head_ok") & ~F.col("repeated") & ~F.exists("route", lambda s: s == "")
    address = (
        F.when(F.col("at") == "", F.lit(""))
        .when(F.col("own_ok"), F.concat(F.lit("#"), encode(F.col("own"))))
        .when(route_ok, F.concat(F.lit("#"), F.array_join(F.transform("route", encode), "/")))
        .when(F.col("derived_ok"), F.concat(F.lit("#"), encode(F.col("derived"))))
        .otherwise(F.concat(F.lit("#"), encode_pointer(F.col("at"))))
    )
    return n.select("path", "at", address.alias("address"))


def _percent(text: Column, keep: str) -> Column:
    """UTF-8 percent-encoding of every character outside `keep` (a character class body)."""
    chars = F.filter(F.split(text, "", -1), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(f"^[{keep}]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")


def encode_step(step: Column) -> Column:
    """A step as it stands in a fragment: pchar and ? stay, all else is percent-encoded."""
    return F.when(step.rlike(r"^[A-Za-z0-9_-]*$"), step).otherwise(_percent(step, r"A-Za-z0-9._~!$&'()*+,;=:@?-"))


def encode_pointer(at: Column) -> Column:
    """An exact path as it stands in a fragment; its ~ escapes are already there."""
    return F.when(at.rlike(r"^[A-Za-z0-9_/-]*$"), at).otherwise(_percent(at, r"A-Za-z0-9._~!$&'()*+,;=:@?/-"))
