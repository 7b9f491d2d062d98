"""Reachability, ownership and the knowledge graph, as joins over edge tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.select import first_wins
from cairn.plans.durable import materialize, measured


def reachable(seeds: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(source, node, depth): every node that a source reaches, itself included, with its least depth.

    ``seeds`` is (source, node), ``edges`` (a, b). Breadth first: the frontier
    joins the edges, what was visited is taken away, and each round is a
    written table, so lineage stays short. Cycles end by themselves.

    Sources travel together: they are numbered in their order, 64 to a word,
    and a row (node, word, bits) stands for those of a word that meet at a
    node. Pairs are made once, from the settled rows. A row stays in the
    comparison as long as steps can still end at its node.
    """
    edges = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).where("node is not null and next is not null").distinct()
    edges = materialize(edges, "reach-edges")
    last = _last_steps(edges, rounds)
    edges = edges.join(last.withColumnRenamed("node", "next"), "next").join(last.withColumnRenamed("__last", "__from"), "node", "left")
    edges = materialize(edges.select("node", "next", "__last", F.coalesce("__from", F.lit(0)).alias("__from")), "reach-edges")
    seeds = materialize(seeds.select("source", "node").distinct(), "reach-seeds")
    places = _places(seeds.select("source").distinct())
    bits = F.bit_or(F.expr("shiftleft(1L, __bit)"))
    placed = seeds.join(places.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of")))
    first = placed.groupBy("node", "__word").agg(bits.alias("__bits")).join(last, "node", "left").withColumn("depth", F.lit(0))
    frontier = materialize(first.select("node", "__word", "__bits", F.coalesce("__last", F.lit(0)).alias("__last"), "depth"), "frontier")
    visited = frontier
    none = F.lit(0).cast("bigint")
    for depth in range(1, rounds + 1):
        onward = frontier.drop("__last").join(edges.where(F.col("__from") >= depth - 1), "node")
        found = onward.select(F.col("next").alias("node"), "__word", "__bits", none.alias("__seen"), "__last")
        before = visited.where(F.col("__last") >= depth).select("node", "__word", none.alias("__bits"), F.col("__bits").alias("__seen"), "__last")
        met = found.unionByName(before).groupBy("node", "__word").agg(F.bit_or("__bits").alias("__bits"), F.bit_or("__seen").alias("__seen"), F.max("__last").alias("__last"))
        fresh = met.select("node", "__word", F.expr("__bits & ~__seen").alias("__bits"), "__last", F.lit(depth).alias("depth")).where("__bits <> 0")
        frontier, made = measured(fresh, "frontier")
        if not made["n"]:
            return _unpacked(visited, places)
        visited = visited.unionByName(frontier)
        if depth % 8 == 0:  # few tables to read, however deep the graph
            visited = materialize(visited, "visited")
    raise RuntimeError(f"reachability goes deeper than {rounds} steps")


def _last_steps(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, __last) of the nodes that edges (node, next) lead to: how many steps a way may have that ends there.

    Edges whose start no way of that many steps reaches fall away, round by
    round. Where a cycle leads, or a way longer than ``rounds``, ``__last``
    has no bound.
    """
    live, left, steps = edges, None, None
    for step in range(1, rounds + 1):
        ends = live.select(F.col("next").alias("node"), F.lit(step).alias("__last"))
        steps = ends if steps is None else steps.unionByName(ends)
        live, made = measured(live.join(ends.select("node").distinct(), "node", "left_semi"), "reach-live")
        if made["n"] in (0, left):
            break
        left = made["n"]
    unbounded = live.select(F.col("next").alias("node"), F.lit(2**31 - 1).alias("__last"))
    return materialize(steps.unionByName(unbounded).groupBy("node").agg(F.max("__last").alias("__last")), "reach-last")


def _places(sources: DataFrame) -> DataFrame:
    """(source, __word, __bit) of distinct sources: neighbours in their order share a word of 64 bits."""
    dealt = sources.repartitionByRange("source").sortWithinPartitions("source").withColumn("__id", F.monotonically_increasing_id())
    return materialize(dealt.selectExpr("source", "__id >> 6 as __word", "cast(__id & 63 as int) as __bit"), "reach-places")


def _unpacked(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(source, node, depth) of rows (node, __word, __bits, depth, ...): a row for each bit that is set."""
    words = places.groupBy("__word").agg(F.collect_list(F.struct("__bit", "source")).alias("__sources"))
    each = F.explode(F.expr("filter(__sources, s -> getbit(__bits, s.__bit) = 1)")).alias("__s")
    return rows.join(words, "__word").select(each, "node", "depth").select("__s.source", "node", "depth")


def unique_owner(reach: DataFrame) -> DataFrame:
    """(node, owner) of the nodes that exactly one source reaches."""
    by = reach.groupBy("node").agg(F.min("source").alias("owner"), F.max("source").alias("__last"))
    return by.where(F.col("owner") == F.col("__last")).select("node", "owner")


def with_unique_source(rows: DataFrame, key: str, reached: DataFrame, values: list[str]) -> DataFrame:
    """Fills ``values`` of the rows whose ``key`` is reached from exactly one source; others keep what they have."""
    same = [(F.min(v) == F.max(v)) & (F.count(v) == F.count(F.lit(1))) for v in values]
    one = reached.groupBy(key).agg(*[F.when(same[0], F.min(v)).alias(f"__{v}") for v in values])
    joined = rows.join(one, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in values else c for c in rows.columns])


def graph_nodes(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """(id, type, name, table_ord, row_ord), first-wins by id, from (table with id, name, row_ord; type)."""
    stacked = None
    for k, (table, kind) in enumerate(tables):
        part = table.select("id", F.lit(kind).alias("type"), "name", F.lit(k).alias("table_ord"), F.col("row_ord").cast("bigint").alias("row_ord"))
        stacked = part if stacked is None else stacked.unionByName(part)
    ordered = stacked.withColumn("ord", F.struct("table_ord", "row_ord"))
    return first_wins(ordered, ["id"], "ord").drop("ord")


def graph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (source, target, type, table_ord) whose both ends exist by the time the edge's table is read; one for each (source, type, target)."""
    known = nodes.select("id", F.col("table_ord").alias("__since"))
    ends = edges
    for side in ("source", "target"):
        k = known.withColumnsRenamed({"id": side, "__since": f"__{side}"})
        ends = ends.join(k, side).where(F.col(f"__{side}") <= F.col("table_ord")).drop(f"__{side}")
    return ends.groupBy("source", "type", "target").agg(F.min("table_ord").alias("table_ord"))


#: The indexes of a repository trio in the order that they are read, each with its layer, its node's type, id and label, and its edges:
#: (type, source, target, confidence, properties). A * is the node itself, <layer> its layer's repository; null ends make no edge.
_FILE = "safe_file(file)"
INDEXES = [
    ("repos", None, "Repo", "id", "label", [("CONTAINS_REPO", "'system'", "if(id = 'system', null, id)", None, None)]),
    ("ui.files", "ui", "File", _FILE, "file", [("HAS_FILE", "'repo:ui'", "*", None, None)]),
    ("ui.pages", "ui", "ReactPage", "concat('ui:page:', page)", "page", [("DEFINED_IN", "*", _FILE, None, None)]),
    ("ui.components", "ui", "ReactComponent", "concat('ui:component:', component)", "component",
     [("DEFINED_IN", "*", _FILE, None, None), ("ROUTE_TO", "if(route is null, null, concat('ui:page:', component))", "*", "'medium'", "route")]),
    ("ui.interactions", "ui", "UiInteraction", "concat('ui:interaction:', hash16)", "concat(coalesce(label, 'interaction'), ' -> ', coalesce(handler, ''))",
     [("HANDLES", "coalesce(concat('ui:page:', page), concat('ui:component:', component))", "*", "'medium'", None)]),
    ("ui.api-calls", "ui", "ApiCall", "concat('ui:api:', hash16)", "concat(coalesce(http_method, 'GET'), ' ', coalesce(path, ''))",
     [("DEFINED_IN", "*", _FILE, None, None), ("CALLS_API", "explode_outer(transform(filter(used_by, u -> instr(u, '/') = 0), u -> concat('ui:page:', u)))", "*", "'medium'", None)]),
    *[row for layer, kind in (("bff", "BffEndpoint"), ("be", "BeEndpoint")) for row in (
        (f"{layer}.files", layer, "File", _FILE, "file", [("HAS_FILE", f"'repo:{layer}'", "*", None, None)]),
        (f"{layer}.endpoints", layer, kind, f"concat('{layer}:endpoint:', http_method, ':', path)", "concat(http_method, ' ', path)", [("DEFINED_IN", "*", _FILE, None, None)]),
        (f"{layer}.components", layer, "SpringComponent", f"concat('{layer}:component:', class_name)", "class_name", [("DEFINED_IN", "*", _FILE, None, None)]),
        (f"{layer}.entities", layer, "Entity", f"concat('{layer}:entity:', entity)", "entity", [("DEFINED_IN", "*", _FILE, None, None)]),
    )],
    ("bff.outbound", "bff", "BffClient", "concat('bff:client-call:', hash16)", "concat(coalesce(client, 'client'), '.', coalesce(method, 'method'))", [("HAS_OUTBOUND_CALL", "'repo:bff'", "*", "confidence", None)]),
    ("bff.dtos", "bff", "BffDto", "concat('bff:dto:', class_name)", "class_name", [("DEFINED_IN", "*", _FILE, None, None)]),
    ("be.repository-methods", "be", "RepositoryMethod", "concat('be:repo-method:', repository, '.', method)", "concat(repository, '.', method)", [("DEFINED_IN", "*", _FILE, None, None)]),
    ("be.validations", "be", "Validation", "concat('be:validation:', hash16)", "concat(annotation, ' ', field)", []),
    ("be.exceptions", "be", "Exception", "concat('be:exception:', hash16)", "concat(type, ': ', detail)", []),
    ("be.service-flows", "be", "BeServiceFlow", "concat('be:service-flow:', hash16)", "endpoint", []),
    ("be.dtos", "be", "BeDto", "concat('be:dto:', class_name)", "class_name", [("DEFINED_IN", "*", _FILE, None, None)]),
    ("be.method-calls", "be", "JavaMethodCall", "concat('be:method-call:', hash16)", "concat(class_name, '.', method, ' -> ', coalesce(target_type, target_variable), '.', target)",
     [("DEFINED_IN", "*", _FILE, None, None), ("CALLS_CLASS", "*", "concat('be:component:', target_type)", "confidence", None)]),
    ("trace.ui-to-bff", "traceability", "ApiCall", "concat('trace:ui-api:', hash_of(call))", "call", []),
    ("trace.ui-to-bff", "traceability", "BffEndpoint", "concat('trace:bff-endpoint:', hash_of(endpoint))", "endpoint", [("MATCHES_ENDPOINT", "concat('trace:ui-api:', hash_of(call))", "*", "confidence", "reason")]),
    ("trace.bff-to-be", "traceability", "BffEndpoint", "concat('trace:bff-out:', hash_of(call))", "call", []),
    ("trace.bff-to-be", "traceability", "BeEndpoint", "concat('trace:be-endpoint:', hash_of(endpoint))", "endpoint", [("CALLS_ENDPOINT", "concat('trace:bff-out:', hash_of(call))", "*", "confidence", "reason")]),
    ("trace.page-flows", "traceability", "PageFlow", "concat('trace:page-flow:', hash16)", "concat(coalesce(page, 'Page'), ' ', coalesce(call, ''))", []),
]


def _of_rule(rule: str, layer: str | None, node: str) -> str:
    """A rule's expression in Spark's SQL."""
    safe = f"left(regexp_replace(regexp_replace(lower(concat('{layer}:file:', file)), '[^a-z0-9._-]+', '-'), '^-+|-+$', ''), 160)"
    out = node if rule == "*" else rule.replace(_FILE, safe)
    return re.sub(r"hash_of\((\w+)\)", r"left(sha2(\1, 256), 16)", out)


def knowledge_graph(indexes: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the indexes that are given, by name: 19 types of nodes, 10 of edges.

    Each index has the columns of its rule and ``row_ord``; records without an
    identity of their own are told apart by the hash of their JSON. Of nodes
    with one id the first stays; an edge stays if both its ends exist by the
    time its index is read, once for each type, ends and properties.
    """
    nodes, edges = None, None
    for at, (index, layer, kind, id_, label, rules) in enumerate(INDEXES):
        if index not in indexes:
            continue
        rows = indexes[index]
        record = F.to_json(F.struct(*[c for c in rows.columns if c != "row_ord"]))
        rows = rows.withColumn("hash16", F.left(F.sha2(record, 256), F.lit(16)))
        if dict(rows.dtypes).get("file") is None:
            rows = rows.withColumn("file", F.lit(None).cast("string"))
        rows = rows.withColumn("__id", F.expr(_of_rule(id_, layer, "id"))).where("__id is not null")
        own_layer = F.lit(layer) if layer else F.col("layer")
        part = rows.select(F.col("__id").alias("id"), F.lit(kind).alias("type"), F.expr(label).cast("string").alias("label"), own_layer.alias("layer"), F.lit(at).alias("table_ord"), F.col("row_ord").cast("bigint").alias("row_ord"))
        nodes = part if nodes is None else nodes.unionByName(part)
        for type_, source, target, confidence, properties in rules:
            level = F.expr(confidence) if confidence else F.lit(None).cast("string")
            level = F.when(level.isin("high", "medium", "low"), level).otherwise("unknown")
            made = rows.select(F.lit(type_).alias("type"), F.expr(_of_rule(source, layer, "__id")).alias("source"), F.expr(_of_rule(target, layer, "__id")).alias("target"), level.alias("confidence"), (F.col(properties).cast("string") if properties else F.lit(None).cast("string")).alias("properties"), F.lit(at).alias("table_ord"), F.col("row_ord").cast("bigint").alias("row_ord"))
            made = made.where("source is not null and target is not null")
            edges = made if edges is None else edges.unionByName(made)
    nodes = first_wins(nodes.withColumn("ord", F.struct("table_ord", "row_ord")), ["id"], "ord").drop("ord")
    known = nodes.select("id", F.col("table_ord").alias("__since"))
    for side in ("source", "target"):
        k = known.withColumnsRenamed({"id": side, "__since": f"__{side}"})
        edges = edges.join(k, side).where(F.col(f"__{side}") <= F.col("table_ord")).drop(f"__{side}")
    keyed = edges.withColumns({"ord": F.struct("table_ord", "row_ord"), "__p": F.coalesce("properties", F.lit(""))})
    edges = first_wins(keyed, ["type", "source", "target", "__p"], "ord").select("type", "source", "target", "confidence", "properties")
    return nodes.select("id", "type", "label", "layer", "table_ord", "row_ord"), edges


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n) of both tables."""
    count = lambda df, kind: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def graph_density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges and edges per node, null without nodes."""
    n, e = nodes.agg(F.count(F.lit(1)).alias("n_nodes")), edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e).select("n_nodes", "n_edges", F.when(F.col("n_nodes") > 0, F.col("n_edges") / F.col("n_nodes")).alias("density"))  # one row each
