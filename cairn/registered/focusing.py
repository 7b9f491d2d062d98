"""Windows, evidence, canonical artifacts, table functions and incremental scans over files assembled from table rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.functions import tables
from cairn.functions.canonical import canonical_artifact
from cairn.operators import extract, focus
from cairn.plans.durable import shared_folder
from cairn.queries import table
from cairn.registered import varied
from cairn.sources import incremental, jsonl_source

# Canonical artifacts -----------------------------------------------------------------------

#: By event modulo 8: an artifact's kind, its source, its text and its canonical text; <k> is the key, <p> the properties, <n> their number.
ARTIFACTS = [
    ("json", "a/b.json", '{"z": <p>, "metadata": {"generatedAt": 5, "viewInputHash": "a", "keep": <k>, "inner": {"updatedAt": 1}}, "generatedAt": 7, "10": 1.50, "2": 1e-7}',
     '{\n  "2": 1e-7,\n  "10": 1.5,\n  "z": {\n    "k": <n>\n  },\n  "metadata": {\n    "keep": <k>,\n    "inner": {\n      "updatedAt": 1\n    }\n  },\n  "generatedAt": 7\n}\n'),
    ("json", "c.json", '{"Pipeline-Version": 2, "generated_at": "x", "a": [[1.0, {"startedAt": null}], []], "b": {}, "extraMetadata": [{"completedAt": 1, "é": "\\n"}]}',
     '{\n  "Pipeline-Version": 2,\n  "a": [\n    [\n      1,\n      {\n        "startedAt": null\n      }\n    ],\n    []\n  ],\n  "b": {},\n  "extraMetadata": [\n    {\n      "é": "\\n"\n    }\n  ]\n}\n'),
    ("json", "runs\\Page-Flow.json", '{"updatedAt": 1, "t": {"updatedAt": <k>}}', '{\n  "t": {\n    "updatedAt": <k>\n  }\n}\n'),
    ("jsonl", "x.jsonl", '{"sourceArtifacts": [], "uiInputHash": 1, "k": <k>}\r\n  not json: <n>\n\nUpdated at: yesterday\n[<k>, {"generatedAt": 1}]\n',
     '{"sourceArtifacts":[],"k":<k>}\nnot json: <n>\nUpdated at: [VOLATILE_METADATA_OMITTED]\n[<k>,{"generatedAt":1}]'),
    ("markdown", "m.md", '# T <k>\r\n- Generated  at: x\n  Input hash : y\n```\nUpdated: kept\n```\nUpdatedly: no\n## Artifact Metadata\nfound <k>\n```json\n{"updatedAt": 1, "z": {"updatedAt": [<n>]}}\n```\nStarted: 5',
     '# T <k>\n- Generated  at: [VOLATILE_METADATA_OMITTED]\n  Input hash : [VOLATILE_METADATA_OMITTED]\n```\nUpdated: kept\n```\nUpdatedly: no\n## Artifact Metadata\nfound <k>\n```json\n{\n  "z": {\n    "updatedAt": [\n      <n>\n    ]\n  }\n}\n```\nStarted: [VOLATILE_METADATA_OMITTED]'),
    ("markdown", "n.md", '## metadata\n```json\n{"updatedAt": <k>,\n```\n## Metadata\n```json\n{"updatedAt": <k>}\n```', '## metadata\n```json\n{"updatedAt": <k>,\n```\n## Metadata\n```json\n{}\n```'),
    ("json", "broken.json", '{"a": <k>', None),
    ("jsonl", "deep.jsonl", "[" * 200 + "<k>" + "]" * 200, "[" * 200 + "<k>" + "]" * 200),
]


def canonical_artifacts(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props", F.get_json_object("props", "$.k").alias("n"))
    values = {"k": F.col("event_id"), "p": F.col("props"), "n": F.col("n")}
    parts = [varied._case(F.col("event_id"), [a[i] for a in ARTIFACTS], **values) for i in (0, 1, 2)]
    made = e.select("event_id", *[p.alias(c) for p, c in zip(parts, ("kind", "source", "text"), strict=True)])
    return made.select("event_id", "kind", canonical_artifact("text", "kind", "source").alias("canonical"))


# Table functions ------------------------------------------------------------------------------


def endpoints_in_sql(spark, sf):
    tables.register(spark)
    # a controller's file grows with the table
    query = "SELECT path, class_name, handler, http_method, endpoint FROM java_endpoints_of(TABLE(SELECT path, content FROM {files}))"
    return spark.sql(query, files=varied.varied_controllers(spark, sf))


def method_calls_in_sql(spark, sf):
    tables.register(spark)
    query = "SELECT f.path, c.class_name, c.method, c.receiver, c.receiver_type, c.target, c.confidence FROM {files} f, LATERAL java_method_calls(f.content) c"
    return spark.sql(query, files=varied.varied_classes(spark, sf))


def interactions_in_sql(spark, sf):
    tables.register(spark)
    query = "SELECT f.path, i.element, i.event, i.handler, i.label FROM {files} f, LATERAL script_interactions(f.content) i"
    return spark.sql(query, files=varied.varied_pages(spark, sf))


def first_orders_in_sql(spark, sf):
    tables.register(spark)
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return spark.sql("SELECT * FROM first_rows(TABLE(SELECT * FROM {rows}) PARTITION BY o_custkey ORDER BY (o_orderkey), 3)", rows=rows)


def marks_in_sql(spark, sf):
    tables.register(spark)
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")).alias("mark"))
    return spark.sql("SELECT o_custkey, o_orderkey, last_mark FROM as_of_marks(TABLE(SELECT * FROM {rows}) PARTITION BY o_custkey ORDER BY (o_orderkey), 'mark')", rows=rows)


# Windows and evidence --------------------------------------------------------------------------


def focused_declarations(spark, sf):
    f = varied.varied_classes(spark, sf)
    shown = focus.rendered_focus(f, focus.focused_windows(f, focus.found_places(f, r"repo\.")), 400)
    return shown.select("path", "ord", "form", "chunk")


def focused_lines(spark, sf):
    """Files whose hits all stand outside of functions show lines, the others their functions."""
    f = varied.varied_scripts(spark, sf)
    shown = focus.rendered_focus(f, focus.focused_windows(f, focus.found_places(f, "'/same'"), 1, 2, lines_gap=1), 300)
    return shown.select("path", "ord", "form", "chunk")


def _wanted(spark, sf):
    """Records of a page's slice, by order: what evidence they ask for."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    k, c = F.col("k"), F.col("c")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    java, script = text("be/src/main/java/p/K", c, ".java"), text("ui/src/calls/file", c, ".ts")
    none = F.lit(None).cast("string")
    rules = [
        ("BFF Service Evidence", java, F.array(text("pub", k), text("plain", k), F.lit("nope")), none, F.lit("high")),
        ("React API Client Evidence", script, F.array(text("plain", k)), F.lit("'/same'"), none),
        ("Entity / DTO / Validation Evidence", java, F.array(F.when(k % 5 == 0, "repo").otherwise("absent")), text("Inner", k), F.lit("low")),
        ("React Route Evidence", script, F.array(F.lit("none")), text("'/p/", k), F.lit("high")),
        ("Backend Endpoint Evidence", text("be/missing", k, ".java"), F.array(F.lit("x")), none, F.lit("high")),
    ]
    out = None
    for n, (group, path, symbols, needle, level) in enumerate(rules):
        part = o.select(c, k, F.lit(group).alias("group"), (k * 8 + n).alias("ord"), path.alias("path"), symbols.alias("symbols"), needle.alias("needle"), level.alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out


def _evidence(spark, sf, most):
    files = varied.varied_classes(spark, sf).unionByName(varied.varied_scripts(spark, sf))
    return focus.evidence(files, _wanted(spark, sf), most)


def page_evidence(spark, sf):
    return _evidence(spark, sf, 300).select("c", "k", "group", "path", "confidence", "code", "uncertainty")


def packed_evidence(spark, sf):
    """A customer's evidence within its budget, a group's first four by confidence."""
    found = _evidence(spark, sf, 300).select("c", "group", "ord", "confidence", "code")
    return focus.packed_evidence(found, "c", 1000, F.col("group"), least=500).select("c", "group", F.col("ord").cast("bigint").alias("ord"), "chosen")


# Incremental scans --------------------------------------------------------------------------------


def incremental_scan(spark, sf):
    """Calls after a quarter of the files went, a quarter changed and some came: only what changed is read again."""
    old = varied.varied_classes(spark, sf)
    c = F.regexp_extract("path", r"K(\d+)\.java", 1).try_cast("long") % 4
    new = old.where(c != 0).withColumn("content", F.when(c == 1, F.replace("content", F.lit("repo.load"), F.lit("repo.fetch"))).otherwise(F.col("content")))
    new = new.unionByName(table(spark, sf, "nation").select(F.concat(F.lit("be/New"), "n_nationkey", F.lit(".java")).alias("path"), F.lit("class New { private Repo repo; public void a() { repo.x(); } }").alias("content")))
    found = incremental.rescan(new, incremental.manifest_of(old), extract.method_calls(old), extract.method_calls)
    return found.select("path", "method", "receiver", "target", "fresh")


def file_changes(spark, sf):
    o = table(spark, sf, "orders")
    manifest = lambda rows, text: incremental.manifest_of(rows.select(F.concat(F.lit("f"), "o_orderkey").alias("path"), text.alias("content")))
    return incremental.changes(manifest(o.where("o_orderkey % 5 <> 0"), F.col("o_orderstatus")), manifest(o.where("o_orderkey % 7 <> 0"), F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))))


def strict_records(spark, sf):
    """Turns written as strict JSON lines, whole or not at all, and read again by ranges of lines."""
    jsonl_source.register(spark)
    folder = f"{shared_folder(spark)}/cairn-strict-{uuid.uuid4().hex}"
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    c.write.format("strict_jsonl").mode("overwrite").save(folder)
    back = spark.read.format("strict_jsonl").schema(c.schema).options(required="conv_id,turn", rangeBytes=str(1 << 16)).load(folder)
    return back.select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        strict_records, canonical_artifacts, endpoints_in_sql, method_calls_in_sql, interactions_in_sql, first_orders_in_sql, marks_in_sql, focused_declarations, focused_lines,
        page_evidence, packed_evidence, incremental_scan, file_changes,
    )
}


def _text(x: str | None) -> str:
    """A Python text as a SQL literal."""
    if x is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + x.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


def _values(templates: list[str], *names: str) -> str:
    return f"(VALUES {', '.join(f'({k}, {_text(t)})' for k, t in enumerate(templates))}) {names[0]}({', '.join(names[1:])})"


def _files(name: str, templates: list[str], head: str, tail: str) -> str:
    """CTEs: ``name``_s, the statements with their line, offset and text, and ``name``, the files (c, content)."""
    return f"""{name}_t AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % {len(templates)} AS m, replace(replace(v.t, '<k>', CAST(o_orderkey AS VARCHAR)), '<s>', lower(o_orderstatus)) AS s
            FROM orders JOIN {_values(templates, "v", "m", "t")} ON v.m = o_orderkey % {len(templates)}),
        {name}_s AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(length(s) + 1) OVER (PARTITION BY c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_t WINDOW w AS (PARTITION BY c ORDER BY k)),
        {name} AS (SELECT c, {head} || string_agg(s, chr(10) ORDER BY k) || {_text(tail)} AS content FROM {name}_t GROUP BY c)"""


_JAVA = _files("j", varied.JAVA, f"replace({_text('package p;' + chr(10) + 'class K<c> {' + chr(10) + '  public Repo<Long> repo;' + chr(10) + '  K<c>(final Client<String> client, Map<String, Long> m) { client.open(); }' + chr(10))}, '<c>', CAST(c AS VARCHAR))", "\n}\n")
_SCRIPT = _files("t", varied.SCRIPT, "''", "\n")
_BY_KEY = "replace(replace(replace(x, '<k>', CAST(event_id AS VARCHAR)), '<p>', props), '<n>', json_extract_string(props, '$.k'))"
_PREFIX = """g AS (SELECT *, sum(length(chunk)) OVER w AS used, row_number() OVER w AS ord FROM r WHERE length(chunk) <= {most} WINDOW w AS (PARTITION BY path ORDER BY start ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT path, min(ord) AS stop FROM g WHERE used > {most} GROUP BY path)
        SELECT g.path, g.ord, g.form, g.chunk FROM g LEFT JOIN f USING (path) WHERE f.stop IS NULL OR g.ord < f.stop"""
_CUT = "CASE WHEN length(code) > 300 THEN left(code, 300) || chr(10) || '[SNIPPET_TRUNCATED]' ELSE code END"
#: What the evidence of the five groups is, before it is cut.
_FOUND = f"""WITH {_JAVA}, {_SCRIPT},
        a AS (SELECT j_s.c, j_s.k, CASE j_s.m WHEN 0 THEN ltrim(j_s.s) WHEN 1 THEN ltrim(j_s.s) END AS code FROM j_s),
        w AS (SELECT c, instr(content, '''/same''') AS pos, content FROM t),
        b AS (SELECT t_s.c, t_s.k, CASE WHEN t_s.m = 0 THEN t_s.s END AS own, CASE WHEN w.pos > 0 THEN substr(content, greatest(w.pos - 700, 1), w.pos + 1199 - greatest(w.pos - 700, 1) + 1) END AS win FROM t_s JOIN w USING (c)),
        e AS (SELECT c, k, CASE WHEN k % 5 = 0 THEN 'public Repo<Long> repo;' WHEN m = 3 THEN ltrim(s) END AS code FROM j_s),
        p AS (SELECT t_s.c, t_s.k, instr(t.content, '''/p/' || t_s.k) AS pos, t.content FROM t_s JOIN t USING (c)),
        z AS (SELECT c, k, 0 AS n, 'BFF Service Evidence' AS "group", 'be/src/main/java/p/K' || c || '.java' AS path, 'high' AS confidence, code, 'pub' || k || '|plain' || k || '|nope' AS asked FROM a
          UNION ALL SELECT c, k, 1, 'React API Client Evidence', 'ui/src/calls/file' || c || '.ts', 'medium', concat_ws({_text(focus.JOINT)}, own, win), 'plain' || k FROM b
          UNION ALL SELECT c, k, 2, 'Entity / DTO / Validation Evidence', 'be/src/main/java/p/K' || c || '.java', 'low', code, CASE WHEN k % 5 = 0 THEN 'repo' ELSE 'absent' END FROM e
          UNION ALL SELECT c, k, 3, 'React Route Evidence', 'ui/src/calls/file' || c || '.ts', 'high', CASE WHEN pos > 0 THEN substr(content, greatest(pos - 500, 1), pos + 999 - greatest(pos - 500, 1) + 1) END, 'none' FROM p
          UNION ALL SELECT o_custkey, o_orderkey, 4, 'Backend Endpoint Evidence', 'be/missing' || o_orderkey || '.java', 'high', NULL, NULL FROM orders),
        y AS (SELECT c, k, n, "group", path, confidence, {_CUT.replace("code", "nullif(code, '')")} AS code,
          CASE WHEN nullif(code, '') IS NOT NULL THEN NULL WHEN n = 4 THEN "group" || ': ' || path || ' is not readable.' ELSE "group" || ': ' || asked || ' was not found in ' || path || '.' END AS uncertainty FROM z)"""

ORACLE_SQL = {
    "strict_records": "SELECT conv_id, turn, role, sha256(coalesce(text, '')) AS sha256 FROM conversations",
    "canonical_artifacts": f"""WITH v AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{a[0]}', {_text(a[3])})" for i, a in enumerate(ARTIFACTS))}) v(m, kind, x))
        SELECT event_id, kind, {_BY_KEY} AS canonical FROM events JOIN v ON v.m = event_id % {len(ARTIFACTS)}""",
    "endpoints_in_sql": f"SELECT path, class_name, handler, http_method, endpoint FROM ({varied.ORACLE_SQL['syntax_endpoints']})",
    "method_calls_in_sql": varied.ORACLE_SQL["nested_method_calls"],
    "interactions_in_sql": f"SELECT path, element, event, handler, label FROM ({varied.ORACLE_SQL['owned_interactions']})",
    "first_orders_in_sql": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3",
    "marks_in_sql": "SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS last_mark FROM orders",
    "focused_declarations": f"""WITH {_JAVA}, r AS (SELECT 'be/src/main/java/p/K' || c || '.java' AS path, before AS start, 'declaration' AS form,
            '[lines ' || (nth + 4) || '-' || (nth + 4) || ']' || chr(10) || CASE m WHEN 3 THEN substr(s, instr(s, 'public void in'), length(s) - instr(s, 'public void in') - 1) ELSE ltrim(s) END AS chunk FROM j_s WHERE m IN (0, 1, 2, 3)),
        {_PREFIX.format(most=400)}""",
    "focused_lines": f"""WITH {_SCRIPT}, d AS (SELECT c, count(*) AS n, bool_or(m = 0) AS inside FROM t_s GROUP BY c),
        h AS (SELECT c, nth, greatest(nth - 1, 1) AS a, least(nth + 2, n + 1) AS b FROM t_s JOIN d USING (c) WHERE m = 1 AND NOT inside),
        i AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY c ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM h),
        l AS (SELECT c, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY c ORDER BY nth ROWS UNBOUNDED PRECEDING) AS island FROM i) GROUP BY c, island),
        r AS (SELECT 'ui/src/calls/file' || c || '.ts' AS path, a AS start, 'lines' AS form, '[lines ' || a || '-' || b || ']' || chr(10) || array_to_string(string_split(content, chr(10))[a : b], chr(10)) AS chunk FROM l JOIN t USING (c)
          UNION ALL SELECT 'ui/src/calls/file' || c || '.ts', min(nth), 'declaration', '[lines ' || min(nth) || '-' || max(nth) || ']' || chr(10) || string_agg(s, chr(10) ORDER BY nth)
            FROM (SELECT *, nth - row_number() OVER (PARTITION BY c ORDER BY nth) AS run FROM t_s WHERE m = 0) GROUP BY c, run),
        {_PREFIX.format(most=300)}""",
    "page_evidence": f'{_FOUND} SELECT c, k, "group", path, confidence, code, uncertainty FROM y',
    "packed_evidence": f"""{_FOUND.replace("WITH ", "WITH RECURSIVE ", 1)}, q AS (SELECT c, "group", k * 8 + n AS ord, length(code) + length("group") AS size, list_position({list(focus.GROUPS)}, "group") AS g,
            row_number() OVER (PARTITION BY c, "group" ORDER BY list_position(['high', 'medium', 'low'], confidence), k) AS r FROM y WHERE code IS NOT NULL),
        s AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY g, r) AS nth FROM q WHERE r <= 4),
        x AS (SELECT c, nth, CASE WHEN size <= 720 THEN size ELSE 0 END AS used, size <= 720 AS taken FROM s WHERE nth = 1
          UNION ALL SELECT s.c, s.nth, CASE WHEN used + size <= 720 THEN used + size ELSE used END, used + size <= 720 FROM x JOIN s ON s.c = x.c AND s.nth = x.nth + 1)
        SELECT y.c, y."group", y.k * 8 + y.n AS ord, CASE WHEN x.taken THEN 'included' WHEN x.nth IS NOT NULL THEN 'over-budget' WHEN y.code IS NOT NULL THEN 'not-first' ELSE 'missing' END AS chosen
        FROM y LEFT JOIN s ON s.c = y.c AND s."group" = y."group" AND s.ord = y.k * 8 + y.n LEFT JOIN x ON x.c = s.c AND x.nth = s.nth""",
    "incremental_scan": f"""SELECT path, method, receiver, CASE WHEN c % 4 = 1 THEN replace(target, 'load', 'fetch') ELSE target END AS target, c % 4 = 1 AND bool_or(target LIKE 'load%') OVER (PARTITION BY path) AS fresh
        FROM (SELECT *, CAST(regexp_extract(path, 'K(\\d+)', 1) AS BIGINT) AS c FROM ({varied.ORACLE_SQL['nested_method_calls']})) WHERE c % 4 <> 0
        UNION ALL SELECT 'be/New' || n_nationkey || '.java', 'a', 'repo', 'x', true FROM nation""",
    "file_changes": """SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'removed' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'same' END AS change
        FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 7 <> 0""",
}
