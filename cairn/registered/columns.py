"""Column functions over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import labels as L
from cairn.functions import text as T
from cairn.queries import table


def path_names(spark, sf):
    p = table(spark, sf, "pages")
    path = T.http_path("url")
    called = F.concat(F.when(F.col("page_id") % 3 == 0, "POST ").otherwise("get "), path)
    return p.select(
        "page_id",
        T.endpoint_parts(called)["method"].alias("method"),
        T.endpoint_parts(called)["path"].alias("path"),
        T.last_segment("url").alias("last"),
        T.file_stem("url").alias("stem"),
        T.url_identity("url").alias("identity"),
        T.url_without_credentials("url").alias("plain"),
        L.page_name(path).alias("page"),
        L.needs_interaction(called).alias("needs"),
        L.likely_http_path("url").alias("http_path"),
        L.looks_like_source(path).alias("source"),
    )


def page_contexts(spark, sf):
    e = table(spark, sf, "events")
    page = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("src/pages/"), "event_type", F.lit(".tsx"))).when(F.col("event_id") % 4 == 1, "app/Layout.jsx")
    function = F.when(F.col("event_id") % 8 == 2, "refreshCart").when(F.col("event_id") % 8 == 3, F.concat("event_type", F.lit("ApiRequest")))
    context = L.page_context(page, F.concat(F.lit("GET /"), "event_type"), function)
    return e.select("event_id", context["page"].alias("page"), context["flow_type"].alias("flow_type"), T.action_name(function).alias("action"), T.without_generics(F.concat(F.lit("List<"), "event_type", F.lit(">"))).alias("raw"))


def handler_names(spark, sf):
    p = table(spark, sf, "part")
    word = F.regexp_extract("p_name", r"(\w+)\z", 1)
    handler = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("(e) => "), word, F.lit("(e.id)"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("{"), word, F.lit("}"))).otherwise(word)
    flow = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("GET /x via a.b."), word, F.lit(".run now"))).otherwise(F.concat(F.lit("A.b -> C."), word, F.lit("(x)")))
    return p.select("p_partkey", L.handler_name(handler).alias("handler"), L.flow_method(flow).alias("method"), T.similar(F.concat(word, F.lit("Service")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.regexp_extract("p_name", r"\A(\w+)", 1))).alias("alike"))


def diagram_labels(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("html").alias("h"))
    digest = lambda c: F.sha2(c, 256)
    return p.select("page_id", digest(L.plain_label("h")).alias("plain"), digest(L.diagram_label("h")).alias("diagram"), digest(L.sequence_label("h")).alias("sequence"), digest(L.xml_text("h")).alias("xml"), digest(L.without_closing_tag("h", "nav")).alias("kept"), digest(T.label_text("h")).alias("text"))


def model_texts(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.coalesce("text", F.lit(""))
    answer = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" <think>let me\nsee</think>\n```json\n"), said, F.lit("\n```\n")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("```\n"), said, F.lit("\n```")))
        .otherwise(F.concat(F.lit("  "), said))
    )
    return c.select("conv_id", "turn", F.sha2(L.model_text(answer), 256).alias("sha256"))


def legacy_masks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.sha2(L.legacy_mask("text"), 256).alias("sha256"), L.masks_in(L.legacy_mask("text")).alias("n_masks"))


def lenient_json(spark, sf):
    e = table(spark, sf, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Answer: "), "props", F.lit(" done"))).otherwise("none")
    value = L.lenient_json(said)
    return e.select("event_id", F.try_variant_get(value, "$.k", "bigint").alias("k"), L.as_record(value).isNotNull().alias("record"))


def canonical_json(spark, sf):
    e = table(spark, sf, "events")
    raw = F.concat(F.lit('{"z": '), "props", F.lit(', "generatedAt": 5, "modelInputHash": "x", "a": "'), "event_type", F.lit('", "list": [2, {"y": 1, "b": null}]}'))
    return e.select("event_id", L.canonical_json(raw).alias("json"), F.array_join(L.as_strings(F.parse_json(F.concat(F.lit('["'), "event_type", F.lit('", "", "b"]')))), "|").alias("items"))


def text_metadata(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit("# Title\n<!-- run {\"kind\": \""), "event_type", F.lit("\", \"used\": "), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("} -->\nbody"))
    text = F.when(F.col("event_id") % 5 == 0, "no comment").otherwise(text)
    found = L.text_metadata(text, "run", "kind string, used boolean")
    return e.select("event_id", found["kind"].alias("kind"), found["used"].alias("used"))


def identity_hashes(spark, sf):
    s = table(spark, sf, "supplier")
    part = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name"))
    return s.select("s_suppkey", L.identity_hash(repo=part, branch=F.lit("main"), nation=F.col("s_nationkey")).alias("identity"), T.safe_segment("s_name").alias("segment"), T.safe_name("s_name").alias("safe"))


def model_budgets(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 2500).alias("window"), (F.col("p_partkey") % 7 * 1000 + 256).alias("output"))
    b = L.model_budget("window", "output", F.lit(400_000).cast("bigint"))
    return p.select("p_partkey", b["input"].alias("input"), b["chunk"].alias("chunk"), b["source"].alias("source"), L.section_output_tokens(F.col("p_partkey") % 7, "output").alias("tokens"))


def section_weights(spark, sf):
    p = table(spark, sf, "part")
    words = F.element_at(F.array(*[F.lit(w) for w in ("Feign calls", "Entity list", "API notes", "Route table", "History", "BE")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", L.section_weight(F.concat(F.lit("## "), words)).alias("weight"), T.ascii_fold(F.concat(words, F.lit(" Çağrı"))).alias("folded"))


def source_paths(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat(F.regexp_extract("p_name", r"(\w+)\z", 1), F.lit(".java"))
    k = F.col("p_partkey") % 5
    said = (
        F.when(k == 0, F.concat(F.lit("`repo\\src\\main\\"), name, F.lit("`,")))
        .when(k == 1, F.concat(F.lit("src/main/"), name))
        .when(k == 2, F.concat(F.lit("https://h/src/"), name))
        .when(k == 3, F.concat(F.lit("/opt/"), name, F.lit(".")))
        .otherwise(F.lit(" "))
    )
    return p.select("p_partkey", L.relative_source(said).alias("path"), F.array_join(L.type_names(F.concat(F.lit("ResponseEntity<List<"), F.initcap(F.regexp_extract("p_name", r"(\w+)\z", 1)), F.lit("Dto>, String>"))), ",").alias("types"))


def integration_keys(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.explode(F.array(F.concat("event_type", F.lit(".url")), F.concat("event_type", F.lit(".size")), F.lit("kafka.topic"))).alias("key"))
    return e.where(L.integration_signal("key")).select("event_id", "key")


def http_receivers(spark, sf):
    p = table(spark, sf, "part")
    receiver = F.when(F.col("p_partkey") % 3 == 0, "this. orderApi").when(F.col("p_partkey") % 3 == 1, "store.items").otherwise("map")
    path = F.when(F.col("p_partkey") % 2 == 0, "api/x").otherwise("/x")
    kind = F.when(F.col("p_partkey") % 10 == 7, "api-client").otherwise("page")
    return p.select("p_partkey", L.likely_http_receiver(receiver, kind, path).alias("likely"))


def line_numbers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = F.floor(F.length("text") / 2).cast("int")
    return d.select("doc_id", T.line_at(F.col("text"), at).cast("bigint").alias("line"), F.size(T.source_references("text")).cast("bigint").alias("n_references"))


def even_excerpts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.sha2(T.head_and_tail_even("text", 118), 256).alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        path_names, page_contexts, handler_names, diagram_labels, model_texts, legacy_masks, lenient_json, canonical_json, text_metadata, identity_hashes,
        model_budgets, section_weights, source_paths, integration_keys, http_receivers, line_numbers, even_excerpts,
    )
}

_H = "html"
_PLAIN = rf"left(trim(regexp_replace(regexp_replace(regexp_replace({_H}, '%%\s*\{{', '% {{', 'g'), '[\x00-\x1f\x7f]+', ' ', 'g'), '\s+', ' ', 'g')), 220)"
_DIAGRAM = f"translate(replace({_PLAIN}, '&', 'and'), '\"`<>[{{]}}', '''''''''(())')"
_WORD = r"regexp_extract(p_name, '(\w+)$', 1)"
_LEGACY = (
    r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)(password|token|secret|api[_-]?key|client[_-]?secret)\s*[:=]\s*[\"'']?[^\"''\s]+', '\1=[MASKED_SECRET]', 'g'),"
    r" '(?i)(authorization:\s*)(?:bearer\s+)?[A-Za-z0-9._~+/=-]+', '\1[MASKED_SECRET]', 'g'), '(?s)-----BEGIN [^-]+PRIVATE KEY-----.*?-----END [^-]+PRIVATE KEY-----', '[MASKED_SECRET]', 'g')"
)
from cairn.oracles import _path  # noqa: E402

ORACLE_SQL = {
    "path_names": rf"""WITH p AS (SELECT *, {_path("url")} AS path FROM pages)
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, path, regexp_extract(url, '([^.$]*)$', 1) AS last,
          regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', '') AS stem, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS identity,
          regexp_replace(url, '[?#].*$', '') AS plain, nullif(regexp_extract(path, '([^/]*)$', 1), '') AS page, page_id % 3 = 0 AS needs, true AS http_path,
          regexp_matches(path, '\.(java|kt|tsx?|jsx?|properties|ya?ml|xml|json)$') AS source FROM p""",
    "page_contexts": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'Layout' ELSE CASE WHEN event_id % 8 = 2 THEN 'SessionBackground' ELSE 'UnknownPage' END END AS page,
        CASE WHEN event_id % 4 = 1 THEN 'layout' WHEN event_id % 8 = 2 THEN 'session-background' ELSE 'page' END AS flow_type,
        CASE event_id % 8 WHEN 2 THEN 'refreshCart' WHEN 3 THEN event_type END AS action, 'List' AS raw FROM events""",
    "handler_names": f"""SELECT p_partkey, {_WORD} AS handler, CASE WHEN p_partkey % 2 = 0 THEN 'run' ELSE {_WORD} END AS method, p_partkey % 2 = 0 OR contains(lower(regexp_extract(p_name, '^(\\w+)', 1)), lower(regexp_extract(p_name, '(\\w+)$', 1))) OR contains(lower(regexp_extract(p_name, '(\\w+)$', 1)), lower(regexp_extract(p_name, '^(\\w+)', 1))) AS alike FROM part""",
    "diagram_labels": rf"""SELECT page_id, sha256({_PLAIN}) AS plain, sha256({_DIAGRAM}) AS diagram, sha256(replace(replace({_DIAGRAM}, ':', ' -'), ';', ',')) AS sequence,
        sha256(replace(replace(replace(replace(replace({_H}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS xml,
        sha256(replace({_H}, '</nav', '<\/nav')) AS kept, sha256(trim(regexp_replace(regexp_replace(regexp_replace({_H}, '<[^>]+>', ' ', 'g'), '\{{[^}}]+\}}', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM pages""",
    "model_texts": "SELECT conv_id, turn, sha256(trim(coalesce(text, ''))) AS sha256 FROM conversations",
    "legacy_masks": f"SELECT doc_id, sha256({_LEGACY}) AS sha256, CAST((length({_LEGACY}) - length(replace({_LEGACY}, '[MASKED_SECRET]', ''))) / 15 AS BIGINT) AS n_masks FROM documents",
    "lenient_json": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 3 < 2 AS record FROM events",
    "canonical_json": """SELECT event_id, '{"a":"' || event_type || '","list":[2,{"b":null,"y":1}],"z":' || replace(props, ' ', '') || '}' AS json, event_type || '|b' AS items FROM events""",
    "text_metadata": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 5 <> 0 THEN event_id % 2 = 0 END AS used FROM events",
    "identity_hashes": """SELECT s_suppkey, sha256('{"branch":"main","nation":' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ',"repo":"' || s_name || '"' ELSE '' END || '}') AS identity,
        replace(lower(s_name), '#', '-') || '-' || substr(sha256(s_name), 1, 10) AS segment, replace(lower(s_name), '#', '-') AS safe FROM supplier""",
    "model_budgets": """WITH p AS (SELECT p_partkey, p_size * 2500 AS w, p_partkey % 7 * 1000 + 256 AS o FROM part), g AS (SELECT *, least(240000, (w - o - 2048) * 3) AS i FROM p),
        c AS (SELECT *, least(180000, i - 12000) AS c FROM g)
        SELECT p_partkey, CASE WHEN i > 8000 THEN CAST(i AS BIGINT) END AS input, CASE WHEN i > 8000 THEN CAST(c AS BIGINT) END AS chunk,
          CASE WHEN i > 8000 THEN CAST(least(400000, greatest(30000, 12 * greatest(1000, least(60000, c - 1000)))) AS BIGINT) END AS source,
          CAST(least(o, 512 + 900 * (p_partkey % 7)) AS BIGINT) AS tokens FROM c""",
    "section_weights": """SELECT p_partkey, CAST([6, 6, 5, 4, 2, 6][p_partkey % 6 + 1] AS BIGINT) AS weight,
        ['feign calls', 'entity list', 'api notes', 'route table', 'history', 'be'][p_partkey % 6 + 1] || ' cagri' AS folded FROM part""",
    "source_paths": f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'src/main/' || {_WORD} || '.java' WHEN 1 THEN 'src/main/' || {_WORD} || '.java' WHEN 3 THEN 'opt/' || {_WORD} || '.java' END AS path,
        {_WORD} || 'dto' AS types FROM part""",
    "integration_keys": "SELECT event_id, unnest([event_type || '.url', 'kafka.topic']) AS key FROM events",
    "http_receivers": "SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 10 = 7 OR p_partkey % 2 = 0 AS likely FROM part",
    "line_numbers": r"""SELECT doc_id, CAST(len(string_split(left(coalesce(text, ''), CAST(floor(length(coalesce(text, '')) / 2) AS BIGINT)), chr(10))) AS BIGINT) AS line,
        CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), 'src/[A-Za-z0-9_./-]+\.(?:java|tsx?|jsx?|ya?ml|properties)'))) AS BIGINT) AS n_references FROM documents""",
    "even_excerpts": """SELECT doc_id, sha256(CASE WHEN length(text) > 118 THEN left(text, 50) || chr(10) || '...[omitted]...' || chr(10) || right(text, 51) ELSE coalesce(text, '') END) AS sha256 FROM documents""",
}
