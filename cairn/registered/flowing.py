"""Flows, lookups and containment joins over driver tables and the generated source tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import extract, flows, match
from cairn.oracles import _CALLS
from cairn.plans.running import as_of
from cairn.queries import _calls_and_endpoints, table
from cairn.registered.sources import _files, joined


def service_flow_resolution(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    end = lambda c: F.concat(F.lit("GET /n/"), F.col(c).cast("string")).alias("endpoint")
    matches = s.select(F.col("s_suppkey").alias("match_ord"), end("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "Auto-Mobile").otherwise("building").alias("controller"), F.lit("h").alias("handler"))
    known = c.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("flow_ord"), end("c_nationkey"), F.col("c_mktsegment").alias("controller"), F.lit("H").alias("handler"))
    return flows.resolved_flow(matches, known)


def first_of_either(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    rows = s.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"))
    others = c.select(F.col("c_custkey").alias("o"), (F.col("c_nationkey") + 1).alias("other_nation"), (F.col("c_custkey") - 5).alias("other_key"), F.col("c_name").alias("found"))
    return flows.first_of_either(rows, others, [("nation", "other_nation"), ("key", "other_key")], "o", "found").select("s_suppkey", "found")


def tiered_lookup(spark, sf):
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    known = s.select((F.col("s_suppkey") % 13).cast("string").alias("brand"), F.lit(1).alias("size"), (F.col("s_suppkey") % 50).cast("int").alias("type"), "s_name")
    rows = p.select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).alias("brand"), (F.col("p_size") % 2).alias("size"), F.col("p_size").cast("int").alias("type"))
    return flows.looked_up(rows, known, [["brand", "size"], ["type"]], "s_name").select("p_partkey", "s_name")


def repository_entities(spark, sf):
    repositories = extract.components(_files(spark, sf)).where("type = 'repository'")
    generic = F.nullif(F.regexp_extract("extended", r"<\s*([\w.]+)", 1), F.lit(""))
    index = extract.entities(_files(spark, sf)).select("entity")
    plain = repositories.select(F.col("class_name").alias("repository"), F.when(F.col("class_name").rlike("[02468]Repository"), generic).alias("generic"))
    return flows.entity_of(plain, index)


def containing_names(spark, sf):
    d, s = table(spark, sf, "documents"), table(spark, sf, "supplier")
    records = d.select(F.col("doc_id").alias("record"), F.concat("source", F.lit("/"), "lang").alias("name"))
    pages = s.select(F.col("s_suppkey").alias("page"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("SRC"), "s_suppkey")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("src"), "s_suppkey", F.lit("/enormous"))).otherwise("e-n").alias("needle"))
    return flows.matching_pages(records, pages)


def containing_everything(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    records = n.select(F.col("n_nationkey").alias("record"), F.col("n_name").alias("name"))
    pages = r.select(F.col("r_regionkey").alias("page"), F.when(F.col("r_regionkey") == 0, "/").otherwise(F.left("r_name", F.lit(2))).alias("needle"))
    return flows.matching_pages(records, pages, strict=False)


def page_slices(spark, sf):
    c, o, li = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    pages = table(spark, sf, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_nationkey").alias("nation"))
    found = flows.page_slice(
        pages,
        {
            "customers": (c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer")), ["nation"], "pages"),
            "orders": (o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order")), ["customer"], "customers"),
            "lines": (li.select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part")), ["order"], "orders"),
        },
        "pages",
    )
    return found["lines"].groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"))


def evidence_files(spark, sf):
    o = table(spark, sf, "orders")
    f = o.select("o_custkey", "o_orderstatus", F.concat(F.lit("ui/"), "o_orderpriority").alias("ui"), F.concat(F.lit("bff/"), "o_orderkey").alias("bff"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("bff/x"), "o_orderkey")).alias("client"))
    return flows.evidence_files(f, {"ui": ["ui"], "bff": ["bff", "client"]}, "o_custkey", F.col("o_orderstatus") != "P", 8)


def uncertainty_notes(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.lit("bff").alias("role"), F.col("o_orderpriority").alias("subject"), F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "low").alias("confidence"))
    return flows.uncertainty_notes(o, "o_custkey")


def _endpoints(spark, sf):
    e = extract.endpoints(_files(spark, sf))
    return e.select(T.endpoint_key("http_method", "path").alias("endpoint_ord"), F.col("class_name").alias("controller"), "handler")


def service_flows(spark, sf):
    f = _files(spark, sf)
    named = lambda kind: extract.components(f).where(F.col("type") == kind).select(F.col("class_name").alias("name"))
    entities = flows.entity_of(extract.components(f).where("type = 'repository'").select(F.col("class_name").alias("repository"), F.nullif(F.regexp_extract("extended", r"<\s*([\w.]+)", 1), F.lit("")).alias("generic")), extract.entities(f).select("entity"))
    found = flows.service_flows(_endpoints(spark, sf), extract.method_calls(f), named("service"), named("repository"), entities)
    return found.select("endpoint_ord", joined("services").alias("services"), joined("repositories").alias("repositories"), joined("entities").alias("entities"), joined("repository_methods").alias("methods"), F.size("method_calls").cast("bigint").alias("n_calls"), "confidence")


def outbound_flows(spark, sf):
    """What endpoints call outside: reached through the calls, or guessed from alike names."""
    f = _files(spark, sf)
    e = extract.endpoints(f)
    ends = e.select(T.endpoint_key("http_method", "path").alias("endpoint_ord"), F.col("class_name").alias("controller"), "handler", "path")
    audit = spark.createDataFrame([("AuditImpl", "note", "POST", "/audit")], "client string, method string, http_method string, target_path string")
    outbound = extract.outbound_calls(f).select("client", "method", "http_method", "target_path").unionByName(audit)
    services = extract.components(f).where("type = 'service'").select(F.col("class_name").alias("name"))
    found = flows.outbound_flows(ends, extract.method_calls(f), outbound, services)
    return found.select("endpoint_ord", *[joined(c).alias(c) for c in ("services", "clients", "outbound", "method_calls")], "confidence")


def reachable_evidence(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.array(F.concat(F.lit("web.A"), "o_custkey", F.lit(".m -> B.n")), F.lit("B.n -> C.k")).alias("calls"), "o_custkey")
    types = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("x.B"), F.lit("c"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("Web"))).otherwise(F.array(F.lit("A"), F.lit("n")))
    return o.select("o_orderkey", joined(flows.reachable_evidence(F.col("calls"), types)).alias("nodes"))


def diagram_flows(spark, sf):
    o = table(spark, sf, "orders")
    f = o.select("o_custkey", F.concat(F.lit("GET /"), "o_orderpriority").alias("call"), F.col("o_orderstatus").alias("bff_endpoint"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("be_endpoint"))
    m = spark.createDataFrame([("F", "Zed"), ("F", "Abe"), ("O", "Cat")], "bff_endpoint string, client string")
    s = spark.createDataFrame([("F", "orders"), ("P", "parts")], "be_endpoint string, target string")
    return flows.diagram_flows(f, m, s, "o_custkey", 5)


def outbound_match(spark, sf):
    calls, ends = _calls_and_endpoints(spark, sf)
    source = F.floor(F.col("ord") / 10).cast("bigint")
    endpoints = calls.unionByName(ends).select((F.col("ord") % 40).alias("source"))
    return match.outbound_match(endpoints, calls.withColumn("source", source), ends.withColumn("file", F.concat(F.lit("f"), "ord")))


def page_flows(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    word = F.initcap(F.lower(F.regexp_extract("o_orderpriority", "([A-Z]+)$", 1)))
    file = F.when(k % 3 > 0, F.concat(F.lit("src/pages/"), word, F.lit("Page.tsx")))
    calls = o.select(k.alias("ord"), file.alias("file"), F.concat(F.lit("GET /"), "o_orderstatus").alias("call"), F.when(k % 2 == 0, "refreshAll").alias("function"), F.nullif(F.col("o_orderstatus"), F.when(k % 5 == 0, "O")).alias("bff_endpoint"), F.when(k % 7 == 0, "medium").otherwise("high").alias("confidence"))
    targets = spark.createDataFrame([(2, "F", "GET /zz", "Q", "q", "low"), (1, "F", "GET /be/f", "A", "x", "high"), (1, "O", "GET /be/o", "B", "y", "high")], "ord int, bff_endpoint string, be_endpoint string, controller string, handler string, confidence string")
    routes = spark.createDataFrame([(1, "UrgentPage", "/u"), (2, "Page", "/p")], "ord int, component string, route string")
    known = spark.createDataFrame([(1, "GET /be/f", "A", "x"), (2, "GET /be/o", "C", "y"), (3, "GET /be/o", "D", "z")], "flow_ord int, endpoint string, controller string, handler string")
    return flows.page_flows(calls, targets, routes, known).withColumn("uncertainties", joined("uncertainties"))


def first_items(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return flows.first_items(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", "event_id", 3)


PLAN = [("overview", "part", "true"), ("overview", "supplier", "true"), ("promo", "part", "text like 'PROMO%'"), ("poor", "supplier", "amount < 0")]


def selected_indexes(spark, sf):
    p = table(spark, sf, "part").select(F.lit("part").alias("index"), F.col("p_type").alias("text"), F.col("p_retailprice").alias("amount"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("index"), F.col("s_name").alias("text"), F.col("s_acctbal").alias("amount"))
    return flows.selected_indexes(p.unionByName(s), PLAN).groupBy("document", "index").agg(F.count(F.lit(1)).alias("n"))


def _slices(spark, sf):
    c, s, o, p, n, r = (table(spark, sf, t) for t in ("customer", "supplier", "orders", "part", "nation", "region"))
    text = lambda prefix, key: F.concat(F.lit(prefix), key.cast("string"))
    ck, sk, ok, pk, nk = F.col("c_custkey"), F.col("s_suppkey"), F.col("o_orderkey"), F.col("p_partkey"), F.col("n_nationkey")
    own = {
        "components": s.select(F.col("s_nationkey").alias("page"), text("f", sk % 15).alias("file"), sk.alias("row")),
        "page_flows": c.where(ck % 9 == 0).select(F.col("c_nationkey").alias("page"), text("GET /c", ck % 50).alias("call"), F.when(ck % 4 > 0, text("b", ck % 30)).alias("bff_endpoint"), F.when(ck % 5 == 0, text("e", ck % 20)).alias("be_endpoint"), ck.alias("row")),
    }
    indexes = {
        "ui_calls": o.where(ok % 10 == 0).select(text("get /C", ok % 60).alias("call"), text("F", F.floor(ok / 10) % 40).alias("file"), ok.alias("row")),
        "ui_to_bff": p.where(pk % 5 == 0).select(text("GET /c", pk % 60).alias("call"), text("b", pk % 45).alias("bff_endpoint"), pk.alias("row")),
        "bff_to_be": s.select(text("b", sk % 45).alias("bff_endpoint"), text("b", sk % 7 * 10).alias("outbound"), text("e", sk % 25).alias("be_endpoint"), sk.alias("row")),
        "be_flows": n.select(text("e", nk).alias("endpoint"), F.when(nk % 3 == 0, "low").when(nk % 3 == 1, "high").alias("confidence"), text("Ctl", nk).alias("controller"), F.array(text("S", nk), text("S", nk + 50)).alias("services"), F.array(text("R", nk % 5)).alias("repositories"), F.array(text("E", nk % 4)).alias("entities"), F.array(F.concat(text("R", nk % 5), F.lit(".find"))).alias("methods"), nk.alias("row")),
        "be_components": s.select(F.when(sk % 2 == 0, text("S", sk)).otherwise(text("R", sk % 10)).alias("class_name"), sk.alias("row")).unionByName(n.select(text("ctl", nk).alias("class_name"), (nk + 1000).cast("long").alias("row"))),
        "entities": r.select(text("E", F.col("r_regionkey")).alias("entity"), F.col("r_regionkey").alias("row")),
        "repositories": s.select(F.concat(text("R", sk % 10), F.lit(".find")).alias("method_key"), text("E", sk % 6).alias("entity"), sk.alias("row")),
    }
    return flows.page_slice_rows(own, indexes)


def whole_page_slices(spark, sf):
    """Every page's rows of seven indexes, grown step by step; low flows name no parts."""
    out = None
    for name, rows in _slices(spark, sf).items():
        part = rows.select(F.lit(name).alias("index"), F.col("page").cast("bigint").alias("page"), F.col("row").cast("bigint").alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def locale_order(spark, sf):
    """Names with accents and capitals, whose order by bytes is another."""
    k = F.col("p_partkey")
    accented = F.when(k % 5 == 0, F.translate("p_name", "aeo", "áéö")).when(k % 5 == 1, F.initcap("p_name")).when(k % 5 == 2, F.upper("p_name")).otherwise(F.col("p_name"))
    return flows.by_locale(table(spark, sf, "part").select("p_partkey", F.regexp_replace(accented, "[^\\p{L}]", "").alias("name")), "name").select("p_partkey", "name", "place")


def containing_alike(spark, sf):
    """Names and needles that all begin with the same eleven characters."""
    names = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("src/shared/"), F.lower("c_mktsegment"), F.lit("/"), "c_name", F.lit(".tsx")).alias("name"))
    k = F.col("s_suppkey")
    needle = F.when(k % 4 == 0, F.concat(F.lit("src/shared/building/Customer#"), F.lpad((k / 4).cast("int").cast("string"), 9, "0"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit("."))).when(k % 4 == 2, F.concat(F.lit("/absent"), k)).otherwise(F.right(k.cast("string"), F.lit(2)))
    return flows.containing(names, table(spark, sf, "supplier").select("s_suppkey", needle.alias("needle")), share=100).select("c_custkey", "s_suppkey")


def last_purchase(spark, sf):
    """Each event with the last purchase of its user at or before it."""
    e = table(spark, sf, "events")
    marks = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return as_of(e.select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", ["purchase"]).select("event_id", "purchase")


def last_event_of_type(spark, sf):
    """Each purchase with what came before it of any user, in six hot groups."""
    e = table(spark, sf, "events").withColumn("shard", F.col("event_id") % 6)
    marks = e.where("event_type <> 'purchase'").select("shard", "ts", F.struct("event_id", "event_type").alias("before"))
    points = e.where("event_type = 'purchase'").select("event_id", "shard", "ts")
    return as_of(points, marks, ["shard"], "ts", ["before"], strict=True).select("event_id", F.col("before.event_id").alias("before"), F.col("before.event_type").alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        service_flow_resolution, first_of_either, tiered_lookup, repository_entities, containing_names, containing_everything, page_slices, evidence_files,
        uncertainty_notes, service_flows, outbound_flows, reachable_evidence, diagram_flows, outbound_match, page_flows, first_items, selected_indexes, locale_order,
        whole_page_slices, containing_alike, last_purchase, last_event_of_type,
    )
}

_S = "WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_suppkey AS n FROM supplier)"
ORACLE_SQL = {
    "service_flow_resolution": """WITH f AS (SELECT c_custkey AS o, c_nationkey AS n, lower(c_mktsegment) AS c FROM customer WHERE c_custkey % 7 = 0),
        m AS (SELECT s_suppkey AS match_ord, s_nationkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'automobile' ELSE 'building' END AS c FROM supplier),
        r AS (SELECT match_ord, (SELECT count(*) FROM f WHERE f.n = m.n) AS n1, (SELECT min(o) FROM f WHERE f.n = m.n) AS o1,
              (SELECT count(*) FROM f WHERE f.n = m.n AND f.c = m.c) AS n2, (SELECT min(o) FROM f WHERE f.n = m.n AND f.c = m.c) AS o2 FROM m)
        SELECT match_ord, CASE WHEN n1 = 1 THEN o1 WHEN n2 = 1 THEN o2 END AS flow_ord, n1 > 1 AND n2 <> 1 AS ambiguous FROM r""",
    "first_of_either": "SELECT s_suppkey, (SELECT arg_min(c_name, c_custkey) FROM customer WHERE c_nationkey + 1 = s_nationkey OR c_custkey - 5 = s_suppkey) AS found FROM supplier",
    "tiered_lookup": r"""SELECT p_partkey, coalesce((SELECT min(s_name) FROM supplier WHERE p_size % 2 = 1 AND CAST(s_suppkey % 13 AS VARCHAR) = regexp_extract(p_brand, '(\d+)', 1)),
        (SELECT min(s_name) FROM supplier WHERE s_suppkey % 50 = p_size)) AS s_name FROM part""",
    "repository_entities": f"{_S} SELECT 'C' || k || 'Repository' AS repository, 'C' || k AS entity FROM s",
    "containing_names": r"""WITH r AS (SELECT doc_id AS record, regexp_replace(lower(source || lang), '[^a-z0-9]', '', 'g') AS a FROM documents),
        p AS (SELECT s_suppkey AS page, CASE s_suppkey % 3 WHEN 0 THEN 'src' || s_suppkey WHEN 1 THEN 'src' || s_suppkey || 'enormous' ELSE 'en' END AS b FROM supplier)
        SELECT record, page FROM r JOIN p ON a <> '' AND (contains(a, b) OR contains(b, a))""",
    "containing_everything": r"""WITH r AS (SELECT n_nationkey AS record, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS a FROM nation),
        p AS (SELECT r_regionkey AS page, CASE WHEN r_regionkey = 0 THEN '' ELSE lower(left(r_name, 2)) END AS b FROM region)
        SELECT record, page FROM r JOIN p ON contains(a, b) OR contains(b, a)""",
    "page_slices": """SELECT c_nationkey AS page, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE o_orderstatus <> 'F' AND c_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY 1""",
    "evidence_files": """WITH f AS (SELECT o_custkey, 'ui' AS role, 'ui/' || o_orderpriority AS file FROM orders WHERE o_orderstatus <> 'P'
        UNION SELECT o_custkey, 'bff', 'bff/' || o_orderkey FROM orders WHERE o_orderstatus <> 'P' UNION SELECT o_custkey, 'bff', 'bff/x' || o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 2 = 0)
        SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey, role ORDER BY file) <= 8""",
    "uncertainty_notes": """SELECT DISTINCT o_custkey, 'bff: ' || o_orderpriority || ' has ' || CASE o_orderstatus WHEN 'O' THEN 'low' ELSE 'medium' END || ' confidence.' AS note FROM orders WHERE o_orderstatus <> 'F'""",
    "service_flows": f"""{_S}, g AS (SELECT a.k, list('C' || b.k ORDER BY 'C' || b.k || 'R')[:5] AS names FROM s a JOIN s b ON starts_with(a.k, b.k) OR starts_with(b.k, a.k) GROUP BY a.k),
        h AS (SELECT k, array_to_string(list_transform(names, lambda x: x || 'Service'), ',') AS gs, array_to_string(list_transform(names, lambda x: x || 'Repository'), ',') AS gr FROM g)
        SELECT 'GET /api/c' || k || '/{{param}}' AS endpoint_ord, 'C' || k || 'Service' AS services, 'C' || k || 'Repository' AS repositories, 'C' || k AS entities, 'C' || k || 'Repository.findById' AS methods, CAST(2 AS BIGINT) AS n_calls, 'high' AS confidence FROM s WHERE n % 3 <> 0
        UNION ALL SELECT 'GET /api/c' || k || '/{{param}}', gs, gr, '', '', 0, 'low' FROM s JOIN h USING (k) WHERE n % 3 = 0
        UNION ALL SELECT 'POST /api/c' || k, 'C' || k || 'Service', gr, '', '', CAST(3 AS BIGINT), 'medium' FROM s JOIN h USING (k)
        UNION ALL SELECT 'PUT /api/c' || k || '/x', gs, gr, '', '', 0, 'low' FROM s JOIN h USING (k)""",
    "outbound_flows": f"""{_S}, o AS (SELECT k, 'C' || k || 'Client' AS client, unnest(CASE n % 3 WHEN 0 THEN ['GET /be/c' || k || '/{{id}} via C' || k || 'Client.get']
            WHEN 1 THEN ['GET /be/c' || k || '/a via C' || k || 'Client.a', 'POST /be/c' || k || '/b via C' || k || 'Client.b', 'PUT /be/c' || k || '/x/y via C' || k || 'Client.c']
            ELSE ['GET /be/c' || k || '/{{id}} via C' || k || 'Client.a', 'DELETE /be/c' || k || ' via C' || k || 'Client.a'] END) AS t FROM s),
        g AS (SELECT s.k, array_to_string(list_sort(list(DISTINCT o.client))[:5], ',') AS clients, array_to_string(list_sort(list(DISTINCT o.t))[:20], ',') AS outbound FROM s JOIN o ON starts_with(s.k, o.k) GROUP BY s.k),
        v AS (SELECT a.k, array_to_string(list('C' || b.k || 'Service' ORDER BY 'C' || b.k || 'Service')[:5], ',') AS alike FROM s a JOIN s b ON starts_with(a.k, b.k) OR starts_with(b.k, a.k) GROUP BY a.k)
        SELECT 'GET /api/c' || k || '/{{param}}' AS endpoint_ord, CASE WHEN n % 3 = 0 THEN alike ELSE 'C' || k || 'Service' END AS services, clients, outbound,
          CASE WHEN n % 3 = 0 THEN '' ELSE 'C' || k || 'Controller.one -> C' || k || 'Service.find,C' || k || 'Service.find -> C' || k || 'Repository.findById' END AS method_calls, 'low' AS confidence FROM s JOIN g USING (k) JOIN v USING (k)
        UNION ALL SELECT 'POST /api/c' || k, 'C' || k || 'Service', 'AuditImpl', 'POST /audit via AuditImpl.note', 'C' || k || 'Controller.add -> C' || k || 'Service.add,C' || k || 'Controller.add -> C' || k || 'Service.check,C' || k || 'Service.check -> Audit.note', 'high' FROM s
        UNION ALL SELECT 'PUT /api/c' || k || '/x', alike, clients, outbound, '', 'low' FROM s JOIN g USING (k) JOIN v USING (k)""",
    "reachable_evidence": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'B.n,C.k' WHEN 1 THEN 'web.A' || o_custkey || '.m' ELSE '' END AS nodes FROM orders",
    "diagram_flows": """WITH f AS (SELECT DISTINCT o_custkey, concat_ws(' > ', 'GET /' || o_orderpriority, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'Abe' WHEN 'O' THEN 'Cat' END,
          CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'orders' WHEN 'P' THEN 'parts' END END) AS steps FROM orders)
        SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY steps) AS ord, steps FROM f QUALIFY ord <= 5""",
    "outbound_match": f"""WITH {_CALLS}, o AS (SELECT CAST(floor(call_ord / 10) AS BIGINT) AS source, call_ord, call, endpoint_ord, CASE WHEN n_candidates = 1 THEN 'f' || endpoint_ord END AS file, confidence, match_reason FROM matched)
        SELECT * FROM o UNION ALL SELECT source, NULL, NULL, NULL, NULL, 'unmatched', 'no outbound calls' FROM (SELECT DISTINCT page_id % 40 AS source FROM pages) WHERE source NOT IN (SELECT source FROM o)""",
    "page_flows": r"""WITH c AS (SELECT o_orderkey AS ord, o_orderkey % 3 > 0 AS named, o_orderkey % 2 = 0 AS refresh, upper(left(regexp_extract(o_orderpriority, '([A-Z]+)$', 1), 1)) || lower(substr(regexp_extract(o_orderpriority, '([A-Z]+)$', 1), 2)) || 'Page' AS p,
          'GET /' || o_orderstatus AS call, CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS bff_endpoint, o_orderkey % 7 > 0 AS high FROM orders),
        d AS (SELECT *, CASE WHEN named THEN p WHEN refresh THEN 'SessionBackground' ELSE 'UnknownPage' END AS page, CASE bff_endpoint WHEN 'F' THEN 'GET /be/f' WHEN 'O' THEN 'GET /be/o' END AS be FROM c),
        n AS (SELECT *, concat_ws(',', CASE WHEN bff_endpoint IS NULL THEN 'no endpoint of the call' END, CASE WHEN be IS NULL THEN 'no backend endpoint' END, CASE WHEN be = 'GET /be/o' THEN 'several service flows' END, CASE WHEN page = 'UnknownPage' THEN 'page unknown' END) AS notes FROM d)
        SELECT ord, page, CASE page WHEN 'SessionBackground' THEN 'session-background' ELSE 'page' END AS flow_type, CASE page WHEN 'UrgentPage' THEN '/u' WHEN 'SessionBackground' THEN NULL ELSE '/p' END AS route, call, bff_endpoint,
          be AS be_endpoint, CASE WHEN be = 'GET /be/f' THEN 1 END AS flow_ord, notes AS uncertainties, CASE WHEN notes <> '' THEN 'partial' WHEN high THEN 'high' ELSE 'medium' END AS confidence FROM n""",
    "first_items": """WITH b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
        SELECT user_id, event_id, event_type FROM events e WHERE event_type = 'purchase' OR (event_type = 'view' AND user_id NOT IN (SELECT user_id FROM b))
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3""",
    "selected_indexes": """SELECT 'overview' AS document, 'part' AS "index", count(*) AS n FROM part UNION ALL SELECT 'overview', 'supplier', count(*) FROM supplier
        UNION ALL SELECT 'promo', 'part', count(*) FROM part WHERE p_type LIKE 'PROMO%' HAVING count(*) > 0 UNION ALL SELECT 'poor', 'supplier', count(*) FROM supplier WHERE s_acctbal < 0 HAVING count(*) > 0""",
    "locale_order": r"""WITH p AS (SELECT p_partkey, regexp_replace(CASE p_partkey % 5 WHEN 0 THEN translate(p_name, 'aeo', 'áéö') WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
            WHEN 2 THEN upper(p_name) ELSE p_name END, '[^\p{L}]', '', 'g') AS name FROM part)
        SELECT p_partkey, name, dense_rank() OVER (ORDER BY strip_accents(lower(name)), lower(name), list_transform(string_split(name, ''), lambda c: c <> lower(c)), name) AS place FROM p""",
    "whole_page_slices": """WITH comp AS (SELECT s_nationkey AS page, 'f' || s_suppkey % 15 AS file, s_suppkey AS r FROM supplier),
        pf AS (SELECT c_nationkey AS page, 'c' || c_custkey % 50 AS call, CASE WHEN c_custkey % 4 > 0 THEN 'b' || c_custkey % 30 END AS b, CASE WHEN c_custkey % 5 = 0 THEN 'e' || c_custkey % 20 END AS e, c_custkey AS r FROM customer WHERE c_custkey % 9 = 0),
        uc AS (SELECT DISTINCT page, 'c' || o_orderkey % 60 AS call, o_orderkey AS r FROM orders JOIN comp ON comp.file = 'f' || (o_orderkey // 10) % 40 WHERE o_orderkey % 10 = 0),
        k1 AS (SELECT page, call FROM uc UNION SELECT page, call FROM pf),
        ub AS (SELECT DISTINCT page, 'b' || p_partkey % 45 AS b, p_partkey AS r FROM part JOIN k1 ON k1.call = 'c' || p_partkey % 60 WHERE p_partkey % 5 = 0),
        k2 AS (SELECT page, b FROM ub UNION SELECT page, b FROM pf WHERE b IS NOT NULL),
        bb AS (SELECT DISTINCT page, 'e' || s_suppkey % 25 AS e, s_suppkey AS r FROM supplier JOIN k2 ON k2.b IN ('b' || s_suppkey % 45, 'b' || s_suppkey % 7 * 10)),
        k3 AS (SELECT page, e FROM bb UNION SELECT page, e FROM pf WHERE e IS NOT NULL),
        bf AS (SELECT DISTINCT page, n_nationkey AS n, n_nationkey % 3 <> 0 AS trusted FROM nation JOIN k3 ON k3.e = 'e' || n_nationkey),
        k4 AS (SELECT page, 'ctl' || n AS x FROM bf UNION SELECT page, 's' || n FROM bf WHERE trusted UNION SELECT page, 's' || (n + 50) FROM bf WHERE trusted UNION SELECT page, 'r' || n % 5 FROM bf WHERE trusted),
        cs AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey ELSE 'r' || s_suppkey % 10 END AS x, s_suppkey AS r, 'supplier' AS origin FROM supplier UNION ALL SELECT 'ctl' || n_nationkey, n_nationkey + 1000, 'nation' FROM nation)
        SELECT 'components' AS "index", page, r AS row FROM comp UNION ALL SELECT 'page_flows', page, r FROM pf UNION ALL SELECT 'ui_calls', page, r FROM uc UNION ALL SELECT 'ui_to_bff', page, r FROM ub UNION ALL SELECT 'bff_to_be', page, r FROM bb
        UNION ALL SELECT 'be_flows', page, n FROM bf UNION ALL SELECT 'be_components', page, r FROM (SELECT DISTINCT page, r, origin FROM cs JOIN k4 USING (x))
        UNION ALL SELECT DISTINCT 'entities', page, r_regionkey FROM region JOIN bf ON trusted AND n % 4 = r_regionkey
        UNION ALL SELECT DISTINCT 'repositories', page, s_suppkey FROM supplier JOIN bf ON trusted AND (n % 5 = s_suppkey % 10 OR n % 4 = s_suppkey % 6)""",
    "containing_alike": """WITH n AS (SELECT c_custkey, 'src/shared/' || lower(c_mktsegment) || '/' || c_name || '.tsx' AS name FROM customer),
        d AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'src/shared/building/Customer#' || lpad(CAST(s_suppkey // 4 AS VARCHAR), 9, '0') WHEN 1 THEN s_suppkey || '.' WHEN 2 THEN '/absent' || s_suppkey ELSE right(CAST(s_suppkey AS VARCHAR), 2) END AS needle FROM supplier)
        SELECT c_custkey, s_suppkey FROM n JOIN d ON contains(name, needle)""",
    "last_purchase": """SELECT e.event_id, (SELECT arg_max(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS purchase FROM events e""",
    "last_event_of_type": """WITH b AS (SELECT event_id, ts, event_id % 6 AS shard, event_type FROM events), p AS (SELECT * FROM b WHERE event_type = 'purchase'),
        m AS (SELECT shard, ts, max(event_id) AS before FROM b WHERE event_type <> 'purchase' GROUP BY ALL)
        SELECT p.event_id, m.before, x.event_type AS kind FROM p ASOF LEFT JOIN m ON p.shard = m.shard AND p.ts > m.ts LEFT JOIN events x ON x.event_id = m.before""",
}
