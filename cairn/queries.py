"""Registered queries: each applies operators of this package to whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import allocate, documents, graph, match, select, state

LANGUAGE = r"\A/(en|fr|de|es)(?=/|\z)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Paths, names, text -----------------------------------------------------------------------


def normalize_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.http_path("url").alias("path"), T.url_parts("url")["host"].alias("host"))


def record_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.short_hash("source", "lang", "doc_id", size=12).alias("gap_id"), T.short_hash("text").alias("record_hash"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def excerpts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select(
        "doc_id",
        F.sha2(T.head("text", 100), 256).alias("head"),
        F.sha2(T.head_within("text", 100), 256).alias("within"),
        F.sha2(T.head_and_tail("text", 117), 256).alias("both"),
        F.sha2(T.tail("text", 100), 256).alias("tail"),
        T.token_estimate(F.length("text")).alias("tokens"),
        T.token_estimate_safe(F.length("text")).alias("safe_tokens"),
    )


def mask_secrets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.sha2(T.mask_secrets("text"), 256).alias("masked_sha256"), T.mask_count("text").alias("n_masked"))


def config_keys_masked(spark, sf):
    keys = table(spark, sf, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    return keys.select("event_id", T.mask_sensitive_key(F.concat(F.lit("token_"), "key")).alias("masked"), T.mask_sensitive_key("key").alias("plain"))


def classify_documents(spark, sf):
    text = F.coalesce("text", F.lit(""))
    kind = (
        F.when(F.trim(text) == "", "empty")
        .when(text.rlike(r"(?i)(password|secret|token)\s*[:=]"), "config")
        .when(text.rlike("(?i)license|copyright"), "license")
        .when(text.rlike("https?://"), "reference")
        .when(F.length(text) < 200, "note")
        .when(F.col("lang") != "en", "translation")
        .otherwise("prose")
    )
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"))


#: What is put behind a document by its key, so that every count has something to find.
SAID = ["UI -> BFF, BFF to Backend; see src/a/B.java", "GET /x/{id} and @PostMapping\n## Empty\n\n## empty\n", "service - Repository, entity, table", "src/a/B.java src\\c.tsx` src/a/B.java", "```mermaid\nbff be\n```\nnot visible\n# Title", ""]


def _said(spark, sf):
    k = F.col("doc_id") % len(SAID)
    chain = F.lit("")
    for n, text in enumerate(SAID):
        chain = F.when(k == n, text).otherwise(chain)
    return table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), chain).alias("text"))


def doc_assessment(spark, sf):
    counts = documents.assess(F.col("text"))
    return _said(spark, sf).select("doc_id", *[c.alias(k) for k, c in counts.items()])


def score_differences(spark, sf):
    counts = documents.assess(F.col("text"))
    d = _said(spark, sf).select("doc_id", counts["n_references"].alias("n"), F.length("text").cast("bigint").alias("size"))
    told = F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 3), F.when(F.col("doc_id") % 5 > 0, F.col("size") - F.col("doc_id") % 2)
    return d.select("doc_id", documents.score_differences(F.col("n"), F.col("size"), *told).alias("said"))


def recommended_actions(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < -900).alias("a"), F.count_if(F.col("c_custkey") % 97 == 0).alias("b"), F.count_if(F.col("c_acctbal") > 9900).alias("c"))
    return c.select("c_nationkey", F.explode(documents.recommended_actions(F.col("a"), F.col("b"), F.col("c"))).alias("action"))


def analysis_warnings(spark, sf):
    n = F.col("s_suppkey")
    counts = {k: n % m for k, m in (("controllers", 2), ("endpoints", 3), ("unclassified", 4), ("unclear_paths", 5), ("unparsed", 6), ("lone_controllers", 7), ("lone_services", 8))}
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(documents.analysis_warnings(counts)).alias("w")).select("s_suppkey", "w.level", "w.message")


def scores_of_repositories(spark, sf):
    """A repository for each nation: artifacts by supplier, missing, empty, weak or good, critical or of flows."""
    k = F.col("s_suppkey")
    rated = table(spark, sf, "supplier").select("s_nationkey", documents.artifact_rating(F.when(k % 5 > 0, k % 4), F.when(k % 3 == 0, k % 7).otherwise(0), 2).alias("rating"), (k % 2 == 0).alias("critical"), (k % 3 == 0).alias("flow"))
    scored = rated.groupBy("s_nationkey").agg(documents.repository_score(flow="flow").alias("score"))
    return scored.select("s_nationkey", "score", documents.score_grade(F.col("score")).alias("grade"))


def source_kinds(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(
        F.bool_or(F.col("text").contains("http")).alias("links"), F.bool_or(F.col("n_chars") > 5000).alias("long"), F.count_if(F.col("lang") == "en").alias("english")
    )
    kind = F.when(F.col("links") & F.col("long"), "mixed").when(F.col("links"), "linked").when(F.col("long"), "long").otherwise("plain")
    facts = select.messages((F.col("links"), "links"), (F.col("long"), "long"), (F.col("english") > 0, "english"))
    return d.select("source", kind.alias("kind"), F.array_join(facts, ",").alias("facts"))


def extract_links(spark, sf):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.posexplode(found).alias("ord", "href")).select("page_id", F.col("ord").cast("bigint"), "href")


def distinct_tags(spark, sf):
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(tags), ",").alias("tags"), F.size(tags).cast("bigint").alias("n_tags"), select.with_overflow(tags).alias("shown"))


# Matching and flows ---------------------------------------------------------------------------


def _calls_and_endpoints(spark, sf):
    """Pages as calls and endpoints: a third of them call; odd calls lack their language segment."""
    path = F.regexp_replace(T.http_path("url"), r"\.html\z", "")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("ord"), path.alias("path"))
    p = p.withColumn("method", F.regexp_extract("path", LANGUAGE, 1))
    called = F.when(F.col("ord") % 2 == 1, F.regexp_replace("path", LANGUAGE, "")).otherwise(F.col("path"))
    return p.where("ord % 3 = 0").withColumn("path", called), p.where("ord % 3 <> 0")


def two_tier_match(spark, sf):
    return match.two_tier_match(*_calls_and_endpoints(spark, sf))


def match_unresolved(spark, sf):
    return match.unresolved(two_tier_match(spark, sf)).select("call_ord", "call", "match_reason")


def match_summary(spark, sf):
    return match.match_summary(two_tier_match(spark, sf))


def scored_best_or_none(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("band"), "c_acctbal")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("band"), "s_acctbal")
    apart = F.abs(F.col("c_acctbal") - F.col("s_acctbal"))
    score = F.when(apart <= 5, 100).when(apart <= 20, 85).when(apart <= 60, 60).otherwise(40)
    return match.best_or_none(s.join(c, ["nation", "band"]), ["s_suppkey"], score, 60, ["c_custkey"])


def unique_value_lookup(spark, sf):
    return match.unique_value(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


def flow_assembly(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.max("l_returnflag").alias("flag"))
    joined = (
        o.join(lines, "o_orderkey", "left")
        .join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal"), "o_custkey", "left")
        .join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    )
    notes = select.messages(
        (F.col("n_lines").isNull(), "no lines"), (F.col("n_name").isNull(), "no nation"), (F.col("c_acctbal") < 0, "negative balance"), (F.col("flag") == "R", "returned")
    )
    uncertain = F.size(notes) > 0
    level = lambda x: F.when(x, "high").otherwise("medium")
    return joined.select(
        "o_orderkey",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        "n_name",
        F.array_join(notes, "; ").alias("uncertainties"),
        match.flow_confidence(level(F.col("o_orderstatus") == "F"), level(F.col("o_totalprice") > 1000), F.lit(None).cast("string"), uncertain).alias("confidence"),
    )


def page_list_upsert(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit(None).cast("double").alias("balance"))
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.min("c_name").alias("name"), F.max("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.lit(None).cast("string").alias("name"), F.max("s_acctbal").alias("balance"))
    return match.merged_by_priority([n, c, s], "key", ["name", "balance"])


def match_status_rollup(spark, sf):
    level = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    o = table(spark, sf, "orders").withColumn("confidence", level)
    return o.groupBy("o_custkey").agg(match.match_status(F.col("confidence") == "high").alias("status"), match.rolled_up_confidence().alias("confidence"), F.count(F.lit(1)).alias("n"))


def semi_cascade(spark, sf):
    r, n, c, o, li = (table(spark, sf, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    n = n.join(r.where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    c = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    li = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def either_semi(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    returned = p.join(li.where("l_returnflag = 'R' and l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    cheap = p.join(li.where("l_discount >= 0.1 and l_quantity < 5"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return returned.select("p_partkey", "p_brand").union(cheap.select("p_partkey", "p_brand")).distinct()


def anti_quality(spark, sf):
    c, o, s, li = (table(spark, sf, t) for t in ("customer", "orders", "supplier", "lineitem"))
    o, li = o.where("o_orderpriority = '1-URGENT'"), li.where("l_quantity = 50 and l_returnflag = 'R'")
    idle = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"))
    unused = s.join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"))
    return idle.unionByName(unused)


# Aggregation, ordering, sets ----------------------------------------------------------------------


def count_by(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


def module_map(spark, sf):
    by = table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))
    return by


def artifact_rating(spark, sf):
    rated = None
    weak = {"customer": "c_acctbal < -990", "orders": "o_totalprice < 0", "lineitem": "l_quantity <= 0", "supplier": "s_acctbal < 0", "events": "value < 0", "part": "p_size > 100"}
    for name, rule in weak.items():
        one = table(spark, sf, name).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(rule)).alias("n_weak")).withColumn("artifact", F.lit(name))
        rated = one if rated is None else rated.unionByName(one)
    return rated.select("artifact", "n", "n_weak", documents.artifact_rating(F.col("n"), F.col("n_weak")).alias("rating"))


def repository_score(spark, sf):
    rated = artifact_rating(spark, sf).withColumn("critical", F.col("artifact").isin("orders", "lineitem"))
    return rated.agg(documents.repository_score().alias("score"), F.count_if(F.col("rating") == "weak").alias("weak"))


def top_k_per_source(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return select.top_k(d, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 4).withColumn("rank", F.col("rank").cast("bigint"))


def priority_rank(spark, sf):
    order = [select.priority(F.col("o_orderstatus"), ["P", "O", "F"]), select.priority(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]), F.col("o_orderkey")]
    return select.top_k(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_custkey"], order, 3).withColumn("rank", F.col("rank").cast("bigint"))


def scan_budget_violation(spark, sf):
    d = table(spark, sf, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("n_chars").alias("size"))
    return select.scan_violations(d, ["source"], 40, 30_000, 60_000)


def resume_prefix(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return select.valid_prefix(e, ["user_id"], "event_id", F.col("event_type") != "error")


def first_wins(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "lang", "doc_id", F.col("doc_id").alias("ord"))
    return select.first_wins(d, ["sha256", "lang"], "ord").drop("ord")


def keep_others_upsert(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return select.upsert(c, c.where("role = 'system'").withColumn("role", F.lit("replaced")), ["conv_id"])


def set_operations(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"))
    tag = lambda df, kind: df.select("key", F.lit(kind).alias("kind"))
    return tag(c.intersect(s), "both").unionByName(tag(c.subtract(s), "left")).unionByName(tag(s.subtract(c), "right"))


def merged_sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"))
    return select.merged_intervals(e.withColumn("end", F.col("start") + 1800), ["user_id"], "start", "end", F.lit(600))


def usage_all_or_null(spark, sf):
    tokens = F.when(F.col("event_type") != "error", F.col("event_id"))
    return table(spark, sf, "events").withColumn("tokens", tokens).groupBy("user_id", "event_type").agg(F.sum("event_id").alias("total"), select.sum_if_complete("tokens").alias("tokens"))


# Graph ---------------------------------------------------------------------------------------------


def _part_edges(spark, sf):
    p = table(spark, sf, "part")
    step = lambda by: F.floor(F.col("p_partkey") / by).cast("bigint").alias("b")
    a = F.col("p_partkey").alias("a")
    return p.select(a, step(2 + F.col("p_size") % 3)).union(p.select(a, step(F.lit(5))))


def closure_reach(spark, sf):
    seeds = table(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.col("p_partkey").alias("node"))
    return graph.reachable(seeds, _part_edges(spark, sf)).select("source", "node")


def unique_owner(spark, sf):
    seeds = table(spark, sf, "part").where("p_size = 50").select(F.col("p_partkey").alias("source"), F.col("p_partkey").alias("node"))
    return graph.unique_owner(graph.reachable(seeds, _part_edges(spark, sf)))


def backprop_unique(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = table(spark, sf, "orders").select("o_orderkey", F.lit(None).cast("bigint").alias("supplier"))
    return graph.with_unique_source(rows, "o_orderkey", li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("supplier")), ["supplier"])


def _graph(spark, sf):
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    r, n, c, s = (table(spark, sf, t) for t in ("region", "nation", "customer", "supplier"))
    nodes = graph.graph_nodes(
        [
            (r.select(key("region", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("row_ord")), "Region"),
            (n.select(key("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("row_ord")), "Nation"),
            (c.select(key("segment", "c_mktsegment").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("row_ord")), "Segment"),
            (s.select(key("supplier", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("row_ord")), "Supplier"),
        ]
    )
    edge = lambda df, a, b, kind, at: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), F.lit(at).alias("table_ord"))
    edges = (
        edge(n, key("region", "n_regionkey"), key("nation", "n_nationkey"), "CONTAINS", 1)
        .unionByName(edge(c, key("nation", "c_nationkey"), key("segment", "c_mktsegment"), "HAS", 2))
        .unionByName(edge(c, key("nation", "c_nationkey"), key("segment", "c_mktsegment"), "EARLY", 1))
        .unionByName(edge(s, key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "HAS", 3))
    )
    return nodes, graph.graph_edges(nodes, edges)


def graph_nodes(spark, sf):
    return _graph(spark, sf)[0].select("id", "type", "name")


def graph_edges(spark, sf):
    return _graph(spark, sf)[1].select("source", "type", "target")


def graph_summary(spark, sf):
    return graph.graph_summary(*_graph(spark, sf))


# Budgets ---------------------------------------------------------------------------------------------


def sequential_budget(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return select.sequential_budget(d, ["source"], "doc_id", "n_chars", 24_000)


def admission_skip(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return select.admitted(d, ["source"], "doc_id", "n_chars", 24_000, wrapper=50)


def block_packing(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return select.packed(d, ["source"], "doc_id", "n_chars", 6_000)


def fair_allocation(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return allocate.fair_allocation(d, ["source"], "doc_id", "n_chars", 24_000)


def weighted_allocation(spark, sf):
    weight = F.when(F.col("lang") == "en", 6.0).when(F.col("lang") == "fr", 4.0).otherwise(2.0)
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars", weight.alias("weight"))
    return allocate.weighted_allocation(d, ["source"], "doc_id", "n_chars", "weight", 24_000)


def role_split(spark, sf):
    return allocate.split_evenly(table(spark, sf, "documents").select("source", "doc_id"), "source", 240_000, 700)


def source_windows(spark, sf):
    return allocate.windows(table(spark, sf, "documents"), "doc_id", "text", 900)


# Documents ---------------------------------------------------------------------------------------------

REQUIRED = ["user 0", "assistant 1", "user 2", "assistant 3", "user 4"]


def _markdown(spark, sf):
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    turns = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))  # a conversation's turns
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(turns["part"], "\n").alias("text"))


def section_split(spark, sf):
    s = documents.sections(_markdown(spark, sf), "conv_id")
    return s.select("conv_id", F.col("ord").cast("bigint").alias("ord"), "heading", "name", F.sha2(F.regexp_replace("body", r"\n+\z", ""), 256).alias("body_sha256"))


def gap_detect(spark, sf):
    return documents.find_gaps(documents.sections(_markdown(spark, sf), "conv_id"), REQUIRED, id_col="conv_id")


def gap_plan(spark, sf):
    return documents.gap_plan(gap_detect(spark, sf), "conv_id")


def section_merge(spark, sf):
    s = documents.sections(_markdown(spark, sf), "conv_id")
    repairs = s.where("heading like 'assistant%'").withColumn("body", F.concat(F.lit("repaired "), F.col("ord").cast("string")))
    added = s.where("ord = 0").withColumns({"name": F.lit("added"), "body": F.lit("new"), "ord": F.lit(99)})
    merged = documents.merge_repairs(s, repairs.unionByName(added), "conv_id")
    return merged.select("conv_id", "name", F.sha2(F.regexp_replace("body", r"\n+\z", ""), 256).alias("body_sha256"), F.size("lost").cast("bigint").alias("n_lost"))


def _ledger(spark, sf):
    kind = F.when(F.col("role") == "assistant", "reference").when(F.col("role") == "user", "finding").otherwise("uncertainty")
    c = table(spark, sf, "conversations")
    items = c.select("conv_id", F.when(F.col("turn") < 2, "1. Opening").when(F.col("turn") < 5, "Middle").otherwise("other").alias("heading"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("ord"))
    return documents.normal_ledger(items, ["Opening", "Middle"], "conv_id")


def ledger_normalize(spark, sf):
    return _ledger(spark, sf).select("conv_id", "heading", "kind", F.sha2("text", 256).alias("item"), "ord")


def ledger_ground(spark, sf):
    first = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("content"))
    return documents.grounded(_ledger(spark, sf), first, "conv_id").select("conv_id", "heading", "kind", F.sha2("text", 256).alias("item"))


def _scored(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    parts = {
        "sections": documents.share(F.length("text"), F.col("n_chars")),
        "references": F.col("quality").cast("double"),
        "ui_api": F.when(F.col("toxic") == 0, 1.0).when(F.col("toxic") == 1, 0.0),
        "length": documents.length_score(F.col("n_chars")),
    }
    score = documents.coverage_score(parts, documents.WEIGHTS, F.when(F.col("lang") != "en", 1).otherwise(0))
    unknown = F.when(F.col("quality").isNull(), 1).otherwise(0)
    return d.join(labels, "doc_id", "left").select("doc_id", "source", score.alias("score"), documents.grade(score).alias("grade"), unknown.alias("unknown"))


def page_score(spark, sf):
    return _scored(spark, sf).select("doc_id", "score", "grade")


def page_score_rollup(spark, sf):
    by = _scored(spark, sf).groupBy("source")
    return by.agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("score") + 0.5).cast("bigint").alias("mean"), F.count_if(F.col("grade").isin("A", "B")).alias("good"), F.count_if(F.col("unknown") > 0).alias("unknown"))


def mention_coverage(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    terms = d.select("doc_id", F.explode(F.array("lang", "source", F.lit("the"), F.lit("x"))).alias("term"))
    return documents.mention_coverage(terms, d)


# State -----------------------------------------------------------------------------------------------------


def staleness(spark, sf):
    e = table(spark, sf, "events")
    times = e.groupBy(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("name")).agg(F.max("ts").alias("mtime"))
    users = e.select(F.col("user_id").cast("string").alias("u")).distinct()
    return state.staleness(users.select(F.concat(F.lit("view:"), "u").alias("target"), F.concat(F.lit("click:"), "u").alias("dependency")), times)


def fingerprint_diff(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    before = state.fingerprints(d.where("lang <> 'es'"), "name", F.col("text"))
    after = state.fingerprints(d.where("lang <> 'de'").withColumn("text", F.regexp_replace("text", "license", "licence")), "name", F.col("text"))
    return state.changed(before, after)


def cache_hit_miss(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    cache = d.where("lang = 'fr'").groupBy("key").agg(F.lit("cached").alias("value"))
    return state.through_cache(d.select("doc_id", "key"), cache, "key", lambda m: m.select("key", F.substring("key", 1, 8).alias("value")))[0]


QUERIES = {
    f.__name__: f
    for f in (
        normalize_path, record_ids, excerpts, mask_secrets, config_keys_masked, classify_documents, doc_assessment, score_differences, recommended_actions, analysis_warnings, scores_of_repositories, source_kinds, extract_links, distinct_tags,
        two_tier_match, match_unresolved, match_summary, scored_best_or_none, unique_value_lookup, flow_assembly, page_list_upsert, match_status_rollup,
        semi_cascade, either_semi, anti_quality, count_by, module_map, artifact_rating, repository_score, top_k_per_source, priority_rank,
        scan_budget_violation, resume_prefix, first_wins, keep_others_upsert, set_operations, merged_sessions, usage_all_or_null, closure_reach,
        unique_owner, backprop_unique, graph_nodes, graph_edges, graph_summary, sequential_budget, admission_skip, block_packing, fair_allocation,
        weighted_allocation, role_split, source_windows, section_split, gap_detect, gap_plan, section_merge, ledger_normalize, ledger_ground,
        page_score, page_score_rollup, mention_coverage, staleness, fingerprint_diff, cache_hit_miss,
    )
}
