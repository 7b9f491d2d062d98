"""The whole knowledge graph over indexes made of the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cairn.operators import graph
from cairn.queries import table

#: Each index as SQL that both engines read; {name} is a table. Nulls, repeats and ends that don't exist are among the rows.
INDEXES = {
    "repos": "SELECT CASE r_regionkey WHEN 0 THEN 'system' WHEN 1 THEN 'repo:ui' WHEN 2 THEN 'repo:bff' WHEN 3 THEN 'repo:be' END AS id, r_name AS label, CASE r_regionkey WHEN 0 THEN 'system' WHEN 1 THEN 'ui' WHEN 2 THEN 'bff' ELSE 'be' END AS layer, r_regionkey AS row_ord FROM {region} WHERE r_regionkey < 4",
    "ui.files": "SELECT concat('src/F ', p_partkey, '.tsx') AS file, p_partkey AS row_ord FROM {part} WHERE p_partkey % 5 = 0",
    "ui.pages": "SELECT concat('P', n_nationkey) AS page, concat('src/F ', n_nationkey, '.tsx') AS file, n_nationkey AS row_ord FROM {nation}",
    "ui.components": "SELECT concat('P', s_suppkey) AS component, concat('src/F ', s_suppkey, '.tsx') AS file, CASE WHEN s_suppkey % 2 = 0 THEN concat('/r', s_suppkey) END AS route, s_suppkey AS row_ord FROM {supplier}",
    "ui.interactions": "SELECT c_mktsegment AS label, concat('h', c_custkey % 7) AS handler, CASE WHEN c_custkey % 3 = 0 THEN concat('P', c_nationkey) END AS page, CASE WHEN c_custkey % 3 = 1 THEN concat('P', c_custkey % 200) END AS component, c_custkey AS row_ord FROM {customer}",
    "ui.api-calls": "SELECT CASE WHEN o_orderkey % 3 > 0 THEN 'POST' END AS http_method, concat('/o/', o_orderkey % 500) AS path, concat('src/F ', o_orderkey % 50, '.tsx') AS file, array(concat('P', o_orderkey % 40), 'src/x.tsx') AS used_by, o_orderkey AS row_ord FROM {orders}",
    "bff.files": "SELECT concat('B', s_suppkey, '.java') AS file, s_suppkey AS row_ord FROM {supplier}",
    "bff.endpoints": "SELECT 'GET' AS http_method, concat('/n/', n_nationkey) AS path, concat('B', n_nationkey * 9, '.java') AS file, n_nationkey AS row_ord FROM {nation}",
    "bff.components": "SELECT concat('Svc', n_regionkey) AS class_name, concat('B', n_nationkey, '.java') AS file, n_nationkey AS row_ord FROM {nation}",
    "bff.entities": "SELECT r_name AS entity, concat('B', r_regionkey, '.java') AS file, r_regionkey AS row_ord FROM {region}",
    "bff.outbound": "SELECT concat('C', s_nationkey) AS client, CASE WHEN s_suppkey % 3 > 0 THEN 'call' END AS method, CASE s_suppkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'odd' END AS confidence, s_suppkey AS row_ord FROM {supplier}",
    "bff.dtos": "SELECT concat('D', r_regionkey) AS class_name, concat('B', r_regionkey, '.java') AS file, r_regionkey AS row_ord FROM {region}",
    "be.files": "SELECT concat('E/', n_nationkey, '.java') AS file, n_nationkey AS row_ord FROM {nation}",
    "be.endpoints": "SELECT 'PUT' AS http_method, concat('/r/', r_regionkey) AS path, concat('E/', r_regionkey, '.java') AS file, r_regionkey AS row_ord FROM {region}",
    "be.components": "SELECT concat('K', n_nationkey) AS class_name, concat('E/', n_nationkey, '.java') AS file, n_nationkey AS row_ord FROM {nation}",
    "be.entities": "SELECT n_name AS entity, concat('E/', n_nationkey * 2, '.java') AS file, n_nationkey AS row_ord FROM {nation}",
    "be.repository-methods": "SELECT concat('R', s_suppkey % 10) AS repository, concat('find', s_suppkey % 3) AS method, concat('E/', s_suppkey % 30, '.java') AS file, s_suppkey AS row_ord FROM {supplier}",
    "be.validations": "SELECT 'Size' AS annotation, concat('f', p_size) AS field, p_partkey AS row_ord FROM {part}",
    "be.exceptions": "SELECT event_type AS type, concat('d', user_id % 4) AS detail, event_id AS row_ord FROM {events}",
    "be.service-flows": "SELECT concat('PUT /r/', n_regionkey) AS endpoint, n_nationkey AS row_ord FROM {nation}",
    "be.dtos": "SELECT concat('D', r_regionkey) AS class_name, concat('E/', r_regionkey * 100, '.java') AS file, r_regionkey AS row_ord FROM {region}",
    "be.method-calls": "SELECT concat('K', s_nationkey) AS class_name, 'm' AS method, 'v' AS target_variable, CASE WHEN s_suppkey % 2 = 0 THEN concat('K', s_suppkey) END AS target_type, concat('t', s_suppkey) AS target, concat('E/', s_nationkey, '.java') AS file, 'high' AS confidence, s_suppkey AS row_ord FROM {supplier}",
    "trace.ui-to-bff": "SELECT concat('GET /o/', o_orderkey % 90) AS call, CASE WHEN o_orderkey % 4 > 0 THEN concat('GET /n/', o_orderkey % 25) END AS endpoint, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, o_orderstatus AS reason, o_orderkey AS row_ord FROM {orders}",
    "trace.bff-to-be": "SELECT concat('GET /n/', n_nationkey) AS call, CASE WHEN n_nationkey % 3 > 0 THEN concat('PUT /r/', n_regionkey) END AS endpoint, 'low' AS confidence, CAST(NULL AS VARCHAR(5)) AS reason, n_nationkey AS row_ord FROM {nation}",
    "trace.page-flows": "SELECT CASE WHEN c_custkey % 2 = 0 THEN concat('P', c_nationkey) END AS page, concat('GET /c/', c_custkey % 30) AS call, c_custkey AS row_ord FROM {customer}",
}


def _graph(spark, sf):
    frames = {}
    for name, sql in INDEXES.items():
        used = set(re.findall(r"\{(\w+)\}", sql))
        frames[name] = spark.sql(sql.replace("VARCHAR(5)", "STRING"), **{t: table(spark, sf, t) for t in used})
    return graph.knowledge_graph(frames)


def knowledge_nodes(spark, sf):
    return _graph(spark, sf)[0].select("id", "type", "label", "layer")


def knowledge_edges(spark, sf):
    return _graph(spark, sf)[1]


def knowledge_summary(spark, sf):
    return graph.graph_summary(*_graph(spark, sf)).orderBy("kind", F.col("n").desc(), "type")


QUERIES = {f.__name__: f for f in (knowledge_nodes, knowledge_edges, knowledge_summary)}


def _view(name: str) -> str:
    return "x_" + name.replace(".", "_").replace("-", "_")


def _json(*columns: str) -> str:
    """The first 16 digits of the hash of a record's JSON without nulls; lists are arrays of strings."""
    one = lambda c: f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || CAST(to_json({c}) AS VARCHAR) END"
    return f"substr(sha256('{{' || concat_ws(',', {', '.join(one(c) for c in columns)}) || '}}'), 1, 16)"


def _safe(layer: str) -> str:
    return f"left(regexp_replace(regexp_replace(lower('{layer}:file:' || file), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 160)"


#: (index, layer, type, id, label) of the nodes in order, and their edges, in the other engine's SQL.
_N = [
    ("repos", None, "Repo", "id", "label"), ("ui.files", "ui", "File", _safe("ui"), "file"), ("ui.pages", "ui", "ReactPage", "'ui:page:' || page", "page"), ("ui.components", "ui", "ReactComponent", "'ui:component:' || component", "component"),
    ("ui.interactions", "ui", "UiInteraction", "'ui:interaction:' || " + _json("label", "handler", "page", "component"), "label || ' -> ' || handler"),
    ("ui.api-calls", "ui", "ApiCall", "'ui:api:' || " + _json("http_method", "path", "file", "used_by"), "coalesce(http_method, 'GET') || ' ' || path"),
    ("bff.files", "bff", "File", _safe("bff"), "file"), ("bff.endpoints", "bff", "BffEndpoint", "'bff:endpoint:GET:' || path", "'GET ' || path"), ("bff.components", "bff", "SpringComponent", "'bff:component:' || class_name", "class_name"), ("bff.entities", "bff", "Entity", "'bff:entity:' || entity", "entity"),
    ("be.files", "be", "File", _safe("be"), "file"), ("be.endpoints", "be", "BeEndpoint", "'be:endpoint:PUT:' || path", "'PUT ' || path"), ("be.components", "be", "SpringComponent", "'be:component:' || class_name", "class_name"), ("be.entities", "be", "Entity", "'be:entity:' || entity", "entity"),
    ("bff.outbound", "bff", "BffClient", "'bff:client-call:' || " + _json("client", "method", "confidence"), "client || '.' || coalesce(method, 'method')"), ("bff.dtos", "bff", "BffDto", "'bff:dto:' || class_name", "class_name"),
    ("be.repository-methods", "be", "RepositoryMethod", "'be:repo-method:' || repository || '.' || method", "repository || '.' || method"), ("be.validations", "be", "Validation", "'be:validation:' || " + _json("annotation", "field"), "annotation || ' ' || field"),
    ("be.exceptions", "be", "Exception", "'be:exception:' || " + _json("type", "detail"), "type || ': ' || detail"), ("be.service-flows", "be", "BeServiceFlow", "'be:service-flow:' || " + _json("endpoint"), "endpoint"), ("be.dtos", "be", "BeDto", "'be:dto:' || class_name", "class_name"),
    ("be.method-calls", "be", "JavaMethodCall", "'be:method-call:' || " + _json("class_name", "method", "target_variable", "target_type", "target", "file", "confidence"), "class_name || '.m -> ' || coalesce(target_type, 'v') || '.' || target"),
    ("trace.ui-to-bff", "traceability", "ApiCall", "'trace:ui-api:' || substr(sha256(call), 1, 16)", "call"), ("trace.ui-to-bff", "traceability", "BffEndpoint", "'trace:bff-endpoint:' || substr(sha256(endpoint), 1, 16)", "endpoint"),
    ("trace.bff-to-be", "traceability", "BffEndpoint", "'trace:bff-out:' || substr(sha256(call), 1, 16)", "call"), ("trace.bff-to-be", "traceability", "BeEndpoint", "'trace:be-endpoint:' || substr(sha256(endpoint), 1, 16)", "endpoint"),
    ("trace.page-flows", "traceability", "PageFlow", "'trace:page-flow:' || " + _json("page", "call"), "coalesce(page, 'Page') || ' ' || call"),
]
_DEFINED = ["ui.pages", "ui.components", "ui.api-calls", "bff.endpoints", "bff.components", "bff.entities", "bff.dtos", "be.endpoints", "be.components", "be.entities", "be.repository-methods", "be.dtos", "be.method-calls"]
_PLACE = {n[0]: (k, n[1], n[3]) for k, n in enumerate(_N)}


def _edges() -> str:
    def one(index: str, kind: str, source: str, target: str, confidence: str = "'unknown'", properties: str = "CAST(NULL AS VARCHAR)", of: str = "") -> str:
        return f"SELECT '{kind}' AS type, {source} AS source, {target} AS target, {confidence} AS confidence, {properties} AS properties, {_PLACE[index][0]} AS t, row_ord AS r FROM {of or _view(index)}"

    level = "CASE WHEN confidence IN ('high', 'medium', 'low') THEN confidence ELSE 'unknown' END"
    out = [one("repos", "CONTAINS_REPO", "'system'", "CASE WHEN id <> 'system' THEN id END")]
    out += [one(f"{layer}.files", "HAS_FILE", f"'repo:{layer}'", _safe(layer)) for layer in ("ui", "bff", "be")]
    out += [one(i, "DEFINED_IN", _PLACE[i][2], _safe(_PLACE[i][1])) for i in _DEFINED]
    out.append(one("ui.components", "ROUTE_TO", "CASE WHEN route IS NOT NULL THEN 'ui:page:' || component END", "'ui:component:' || component", "'medium'", "route"))
    out.append(one("ui.interactions", "HANDLES", "coalesce('ui:page:' || page, 'ui:component:' || component)", _PLACE["ui.interactions"][2], "'medium'"))
    out.append(one("ui.api-calls", "CALLS_API", "'ui:page:' || used_by[1]", _PLACE["ui.api-calls"][2], "'medium'"))
    out.append(one("bff.outbound", "HAS_OUTBOUND_CALL", "'repo:bff'", _PLACE["bff.outbound"][2], level))
    out.append(one("be.method-calls", "CALLS_CLASS", _PLACE["be.method-calls"][2], "'be:component:' || target_type", level))
    out.append(one("trace.ui-to-bff", "MATCHES_ENDPOINT", "'trace:ui-api:' || substr(sha256(call), 1, 16)", "'trace:bff-endpoint:' || substr(sha256(endpoint), 1, 16)", level, "reason"))
    out.append(one("trace.bff-to-be", "CALLS_ENDPOINT", "'trace:bff-out:' || substr(sha256(call), 1, 16)", "'trace:be-endpoint:' || substr(sha256(endpoint), 1, 16)", level, "reason"))
    return " UNION ALL ".join(out)


_VIEWS = ", ".join(f"{_view(n)} AS ({re.sub(r'array[(](.*?), (.src/x.tsx.)[)]', r'[\1, \2]', re.sub(r'[{](\w+)[}]', r'\1', sql))})" for n, sql in INDEXES.items())
_GRAPH = f"""WITH {_VIEWS}, a AS ({" UNION ALL ".join(f"SELECT {i} AS id, '{kind}' AS type, {label} AS label, {'layer' if layer is None else chr(39) + layer + chr(39)} AS layer, {k} AS t, row_ord AS r FROM {_view(index)}" for k, (index, layer, kind, i, label) in enumerate(_N))}),
    nodes AS (SELECT id, arg_min(type, (t, r)) AS type, arg_min(label, (t, r)) AS label, arg_min(layer, (t, r)) AS layer, min(t) AS t FROM a WHERE id IS NOT NULL GROUP BY id),
    e AS ({_edges()}),
    edges AS (SELECT e.type, source, target, arg_min(confidence, (e.t, e.r)) AS confidence, e.properties FROM e JOIN nodes s ON s.id = source AND s.t <= e.t JOIN nodes g ON g.id = target AND g.t <= e.t GROUP BY e.type, source, target, e.properties)"""
ORACLE_SQL = {
    "knowledge_nodes": f"{_GRAPH} SELECT id, type, label, layer FROM nodes",
    "knowledge_edges": f"{_GRAPH} SELECT type, source, target, confidence, properties FROM edges",
    "knowledge_summary": f"{_GRAPH} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY 2",
}
