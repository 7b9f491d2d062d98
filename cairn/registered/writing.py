"""Documents, ledgers, gaps, reports, freshness and scores over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import documents as D
from cairn.operators import graph, match, select, state
from cairn.queries import _graph, _ledger, _markdown, _scored, table

CANON = ["user 0", "assistant 1", "user 2", "Summary"]


def actionable_gaps(spark, sf):
    s = D.sections(_markdown(spark, sf), "conv_id")
    gaps = D.find_gaps(s, ["user 0", "assistant 9", "Uncertainties"], id_col="conv_id", parameters="assistant1$")
    grounded = s.where("ord < 2").select("conv_id", F.col("name").alias("section")).union(s.select("conv_id", F.lit("document")))
    return D.actionable_gaps(gaps, "conv_id", grounded).select("conv_id", "section", "gap_type", "severity")


def gap_repair_order(spark, sf):
    gaps = D.find_gaps(D.sections(_markdown(spark, sf), "conv_id"), ["assistant 9"], id_col="conv_id", parameters="assistant1$")
    return select.top_k(gaps, ["conv_id"], D.gap_order(), 2).select("conv_id", "section", "gap_type", F.col("rank").cast("bigint").alias("rank"))


def relevant_text(spark, sf):
    m = _markdown(spark, sf)
    targets = m.where("conv_id % 2 = 0").select("conv_id", F.lit("User 0").alias("heading"))
    words = m.where("conv_id % 4 = 1").select("conv_id", F.lit("ASSISTANT").alias("word"))
    return D.relevant_text(m, targets, words, "conv_id").select("conv_id", F.regexp_count("text", F.lit("(?m)^## ")).cast("bigint").alias("n_sections"))


def repair_groups(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.concat_ws(" ", "role", "turn").alias("heading"))
    return D.repair_groups(c, CANON, 2, "conv_id")


def canonical_repairs(spark, sf):
    s = D.sections(_markdown(spark, sf), "conv_id")
    twice = s.unionByName(s.withColumn("ord", F.col("ord") + 100)).unionByName(s.withColumns({"ord": F.col("ord") + 200, "body": F.lit("more")}))
    targets = s.select("conv_id", "name").union(s.select("conv_id", F.lit("absent")))
    made = D.canonical_repairs(twice, targets, "conv_id")
    return made.select("conv_id", "name", F.sha2("body", 256).alias("sha256"), "missing")


def canonical_document(spark, sf):
    s = D.sections(_markdown(spark, sf), "conv_id")
    warnings = s.where("ord < 2").select("conv_id", F.concat(F.lit("w"), "ord").alias("warning"))
    made = D.canonical_document(s, CANON, warnings, "conv_id")
    return made.select("conv_id", F.col("place").cast("bigint").alias("place"), "heading", F.sha2("body", 256).alias("sha256"))


def heading_blocks(spark, sf):
    b = D.heading_blocks(_markdown(spark, sf).select("conv_id", F.regexp_replace("text", "\n## ", "\n\n## ").alias("text")), "conv_id")
    return b.select("conv_id", F.col("ord").cast("bigint").alias("ord"), F.regexp_extract("block", r"^## ([^\n]*)", 1).alias("heading"))


def fenced_outline(spark, sf):
    c = table(spark, sf, "conversations")
    part = F.concat(F.lit("# "), "role", F.when(F.col("turn") % 3 == 1, F.lit("\n```\n## hidden\n```\n")).otherwise(F.lit("\n## shown\n")), F.lit("#none"))
    texts = c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", part.alias("p"))))["p"], "\n").alias("text"))
    return D.outline(texts, "conv_id").groupBy("conv_id", F.col("level").cast("bigint").alias("level"), "heading").agg(F.count(F.lit(1)).alias("n"))


def demoted_findings(spark, sf):
    some = _ledger(spark, sf).where("heading = 'Opening' or kind <> 'reference'")
    return D.demoted(some, "conv_id").groupBy("conv_id", "heading", "kind").agg(F.count(F.lit(1)).alias("n"))


def grounded_sections(spark, sf):
    return D.grounded_sections(_ledger(spark, sf), "conv_id")


def split_ledgers(spark, sf):
    """Every part with its items and the references that it shares."""
    parts = D.split_ledger(_ledger(spark, sf), 900, "conv_id")
    return parts.select("conv_id", F.col("part").cast("bigint").alias("part"), "heading", "kind", F.sha2("text", 256).alias("item"))


def projected_ledger(spark, sf):
    """What three writers see: of a section and all references, of all uncertainties with a section as spine, of a section alone."""
    ledger, aggregates = _ledger(spark, sf), {"reference": "Sources", "uncertainty": "Open"}
    out = None
    for name, requested, spine in (("a", ["Opening", "Sources"], []), ("b", ["Open"], ["Middle"]), ("c", ["Middle"], ["Open"])):
        part = D.projected(ledger, requested, spine, aggregates, "conv_id").select(F.lit(name).alias("writer"), "conv_id", "heading", "kind", F.sha2("text", 256).alias("item"), "ord")
        out = part if out is None else out.unionByName(part)
    return out


def reduced_ledgers(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("batch"), F.col("event_id").alias("ledger"), F.concat(F.lit("u"), "user_id").alias("text"), F.col("event_id").alias("ord"))
    return D.reduce_until(e, ["batch"], "ledger", 10**9, 16, 6).select("batch", "kind", "text", "ord")


def section_groups(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", D.section_groups(F.col("turn"), 4).alias("whole"), D.section_groups(F.col("turn"), 4, 1).alias("halved"))


def packed_ledgers(spark, sf):
    sizes = _ledger(spark, sf).groupBy("conv_id").agg(F.sum(F.length("text")).alias("size")).withColumn("batch", F.lit(0))
    return select.packed(sizes, ["batch"], "conv_id", "size", 4000, 1).select("conv_id", "chunk")


def record_coverage(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    values = d.where("doc_id % 5 > 0").select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("record"), F.col("lang").alias("value")), F.struct(F.lit(0).alias("record"), F.lit("the").alias("value")), F.struct(F.lit(1).alias("record"), F.col("source").alias("value")), F.struct(F.lit(2).alias("record"), F.lit("x").alias("value")))).alias("v"))
    return D.record_coverage(values.select("doc_id", "v.*"), d)


def document_counts(spark, sf):
    text = F.col("text")
    c = D.assess(text)
    agrees = D.score_agrees(F.col("conv_id") % 100, c["n_unresolved"], c["n_empty"])
    return _markdown(spark, sf).select("conv_id", c["n_headings"].alias("n_headings"), c["n_duplicates"].alias("n_duplicates"), c["n_empty"].alias("n_empty"), c["has_diagram"].alias("diagram"), c["n_words"].alias("n_words"), agrees.alias("agrees"))


def cross_findings(spark, sf):
    o, li, c = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    counts = o.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("o_orderstatus") == "X").alias("matches"), F.count_if(F.col("o_orderstatus") == "P").alias("unresolved"))
    more = li.agg(F.count(F.lit(1)).alias("outbound"), F.count_if(F.col("l_quantity") > 25).alias("outbound_matches"), F.count_if(F.col("l_returnflag") == "R").alias("partial_flows"))
    last = c.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("c_acctbal") < 0).alias("edges"))
    one = counts.join(more).join(last)  # three rows of one
    columns = {k: F.col(k) for k in ("calls", "matches", "unresolved", "outbound", "outbound_matches", "partial_flows", "nodes", "edges")}
    found = D.cross_findings(columns | {"unknown_pages": F.lit(0), "semantics": F.lit(0)})
    cost = F.greatest(100 - D.findings_cost(F.col("found")), F.lit(0)).cast("bigint")
    return one.withColumn("found", found).select(F.explode("found").alias("f"), cost.alias("score")).select("f.severity", "f.message", "score")


def offending_rows(spark, sf):
    rules = [
        ("negative customer", table(spark, sf, "customer"), "c_custkey", F.col("c_acctbal") < 0),
        ("large part", table(spark, sf, "part"), "p_partkey", F.col("p_size") > 48),
        ("late line", table(spark, sf, "lineitem"), "l_orderkey", F.col("l_quantity") > 49),
    ]
    return D.offending_rows(rules)


def module_report(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return D.report(p, ["p_brand"], ["p_partkey"], F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")), F.col("p_brand"), 5)


def page_score_full(spark, sf):
    """All fifteen parts of a page's score."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    parts = {k: D.share(F.col("doc_id") % (i + 2), F.lit(i + 1) if i % 4 else F.when(F.col("doc_id") % 3 > 0, F.lit(i + 1))) for i, k in enumerate(D.WEIGHTS)}
    parts["length"] = D.length_score(F.col("n_chars"))
    score = D.coverage_score(parts, D.WEIGHTS, (F.col("doc_id") % 7).cast("int"))
    return d.select("doc_id", score.alias("score"), D.grade(score).alias("grade"))


def graph_density(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.graph_density(nodes, edges)


def artifact_freshness(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    meta = F.when(k % 4 == 1, F.lit("oops")).otherwise(F.concat(F.lit('{"inputs": {"a": "'), F.when(k % 4 == 2, F.lit("old")).otherwise(F.lit("new")), F.lit('"}}')))
    artifacts = s.select(k.alias("artifact"), F.when(k % 4 > 0, F.when(k % 8 == 7, 5).otherwise(10)).alias("mtime"), meta.alias("metadata"))
    return state.artifact_freshness(artifacts, s.select(k.alias("artifact"), F.lit("a").alias("input"), F.lit(7).alias("mtime"), F.lit("new").alias("sha256")))


def _pipeline(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    expected = s.select(F.col("s_name").alias("name"), F.when(k % 3 == 0, "base").when(k % 3 == 1, "optional").otherwise("derived").alias("role"))
    return state.pipeline_freshness(expected, s.where("s_suppkey % 5 > 0").select(F.col("s_name").alias("name"), k.alias("mtime")))


def pipeline_freshness(spark, sf):
    return _pipeline(spark, sf)[0]


def pipeline_rebuild(spark, sf):
    return _pipeline(spark, sf)[1]


def identity_mismatches(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("role"), F.col("s_name").alias("repo"), F.lit("main").alias("branch"))
    found = s.where("role % 3 > 0").withColumn("repo", F.when(F.col("role") % 3 == 1, F.lit("other")).otherwise(F.col("repo"))).withColumn("branch", F.when(F.col("role") % 2 == 0, F.lit("dev")).otherwise("main"))
    return state.identity_mismatches(s, found, ["repo", "branch"]).select("role", F.array_join("mismatches", ",").alias("mismatches"))


def commit_check(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    prints = state.fingerprints(d, "name", F.col("text"))
    outputs = prints.select("name", F.when(F.col("n_bytes") > 0, F.col("sha256")).alias("sha256"))
    return state.committed(prints, prints.where("name <> '3'"), outputs)


def reusable_steps(spark, sf):
    o = table(spark, sf, "orders")
    steps = o.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.col("o_orderpriority").alias("input_hash"), F.col("o_orderstatus").alias("output_hash"))
    inputs = o.select(F.col("o_orderkey").alias("step"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("x").alias("sha256"))
    outputs = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("step"), F.col("o_orderstatus").alias("sha256"))
    return state.reusable_steps(steps, inputs, outputs).select("run", "step", "reusable")


def bounded_cache(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(":", F.lit("v1"), "lang", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 2)).alias("key"))
    cache = d.where("key like 'v1:fr%'").groupBy("key").agg(F.lit("cached").alias("value"))
    return state.through_cache(d, cache, "key", lambda m: m.select("key", F.lit("made").alias("value")), at_most=50)[0].select("doc_id", "key", "value")


def first_by_order(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return match.first_by(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def json_record_hash(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brand"), F.col("p_size").alias("size")).alias("r"))
    return p.select("p_partkey", F.substring(F.sha2(F.to_json("r"), 256), 1, 16).alias("record_hash"), T.short_hash(F.lit("v2"), F.lit("model"), "r.name", size=64).alias("cache_key"))


def repository_addresses(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey").cast("string")
    u = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("ssh://git@Host.org/proj/r"), k, F.lit(".git"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("https://me:pw@host.org/proj/r"), k, F.lit("/?x=1"))).otherwise(F.concat(F.lit("git@host.org:proj/r"), k, F.lit(".git")))
    parts = T.url_parts(u)
    return s.select("s_suppkey", parts["host"].alias("host"), parts["project"].alias("project"), parts["repository"].alias("repository"), T.url_identity(u).alias("identity"), T.url_for_storage(u).alias("stored"), T.has_credentials(u).alias("credentials"))


def parts_of_sources(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return select.part_of(d, ["source"], [F.col("doc_id")])


def array_utilities(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role")))["role"].alias("roles"))
    return c.select("conv_id", F.array_join(F.array_distinct("roles"), ",").alias("roles"), F.array_join(F.slice("roles", 2, 2), ",").alias("middle"), F.exists("roles", lambda r: r == "assistant").alias("any"), F.forall("roles", lambda r: r == "user").alias("all"))


def canonical_order(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.concat_ws(" ", "role", "turn").alias("heading"))
    order = F.array(*[F.lit(h) for h in CANON])
    place = F.coalesce(F.nullif(F.array_position(order, F.col("heading")), F.lit(0)), F.lit(len(CANON) + 1))
    return select.top_k(c, ["conv_id"], [place, F.col("heading")], 100).select("conv_id", "heading", F.col("rank").cast("bigint").alias("rank"))


def full_findings_score(spark, sf):
    return _scored(spark, sf).groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


QUERIES = {
    f.__name__: f
    for f in (
        actionable_gaps, gap_repair_order, relevant_text, repair_groups, canonical_repairs, canonical_document, heading_blocks, fenced_outline, demoted_findings,
        grounded_sections, split_ledgers, projected_ledger, reduced_ledgers, section_groups, packed_ledgers, record_coverage, document_counts, cross_findings,
        offending_rows, module_report, page_score_full, graph_density, artifact_freshness, pipeline_freshness, pipeline_rebuild, identity_mismatches, commit_check,
        reusable_steps, bounded_cache, first_by_order, json_record_hash, repository_addresses, parts_of_sources, array_utilities, canonical_order, full_findings_score,
    )
}

from cairn.oracles import _GRADE, _LEDGER, _SCORED  # noqa: E402

_REFS = r"'src/[A-Za-z0-9_./-]+\.(?:java|tsx?|jsx?|ya?ml|properties)'"
_S = "s AS (SELECT conv_id, turn, role || turn AS name, role || ' ' || turn AS heading, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM conversations)"
_OPEN = "(?i)(not visible|not available|could not be determined|unknown)"
_KINDS = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 3 END, CASE gap_type WHEN 'empty-section' THEN 0 WHEN 'parameter' THEN 3 WHEN 'source-reference' THEN 4 ELSE 5 END, section"


def _gaps(required: dict[str, str]) -> str:
    wanted = ", ".join(f"'{n}'" for n in required)
    return f"""{_S}, r AS (SELECT conv_id, unnest([{wanted}]) AS section FROM (SELECT DISTINCT conv_id FROM s)),
      gaps AS (SELECT r.conv_id, section, 'empty-section' AS gap_type, 'high' AS severity FROM r LEFT JOIN s ON s.conv_id = r.conv_id AND s.name = r.section
        WHERE s.body IS NULL OR regexp_matches(s.body, '^\\s*(?i:tbd|todo|n/?a|none|-|\\.\\.\\.)?\\s*$')
      UNION ALL SELECT conv_id, name, 'not-visible', 'medium' FROM s WHERE regexp_matches(body, '{_OPEN}')
      UNION ALL SELECT conv_id, name, 'parameter', 'medium' FROM s WHERE name = 'assistant1' AND NOT regexp_matches(body, {_REFS})
      UNION ALL SELECT conv_id, 'document', 'source-reference', 'high' FROM s GROUP BY conv_id HAVING sum(len(list_distinct(regexp_extract_all(body, {_REFS})))) < 3)"""


_FULL = " + ".join(
    f"coalesce(CASE WHEN {'doc_id % 3 > 0' if i % 4 == 0 else 'true'} THEN (doc_id % {i + 2}) / {i + 1}.0 END, 0) * {w}.0"
    for i, w in enumerate([20, 12, 12, 8, 6, 7, 7, 5, 5, 4, 4, 2, 2, 1])
)
_CASE_CANON = "CASE heading WHEN 'user 0' THEN 1 WHEN 'assistant 1' THEN 2 WHEN 'user 2' THEN 3 ELSE 5 END"
ORACLE_SQL = {
    "actionable_gaps": f"""WITH {_gaps({'user0': '', 'assistant9': '', 'uncertainties': ''})} SELECT conv_id, section, gap_type, severity FROM gaps g WHERE gap_type <> 'not-visible' AND section <> 'uncertainties'
        AND (section = 'document' OR EXISTS (SELECT 1 FROM s WHERE s.conv_id = g.conv_id AND s.name = g.section AND ord < 2))""",
    "gap_repair_order": f"""WITH {_gaps({'assistant9': ''})} SELECT conv_id, section, gap_type, row_number() OVER (PARTITION BY conv_id ORDER BY {_KINDS}) AS rank FROM gaps QUALIFY rank <= 2""",
    "relevant_text": """SELECT conv_id, CAST(CASE WHEN conv_id % 2 = 0 AND count(*) FILTER (WHERE role = 'user' AND turn = 0) > 0 THEN 1 WHEN conv_id % 4 = 1 AND count(*) FILTER (WHERE a) > 0 THEN count(*) FILTER (WHERE a)
        ELSE count(*) END AS BIGINT) AS n_sections FROM (SELECT *, role = 'assistant' OR contains(lower(left('## ' || role || ' ' || turn || chr(10) || coalesce(text, ''), 1200)), 'assistant') AS a FROM conversations) GROUP BY conv_id""",
    "repair_groups": """WITH c AS (SELECT DISTINCT conv_id, role || turn AS name, CASE role || turn WHEN 'user0' THEN 0 WHEN 'assistant1' THEN 1 WHEN 'user2' THEN 2 ELSE 4 END AS p FROM conversations)
        SELECT conv_id, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY p, name) - 1) / 2) + 1 AS BIGINT) AS "group", name FROM c""",
    "canonical_repairs": f"""WITH {_S} SELECT conv_id, name, sha256(CASE WHEN trim(body) = '' THEN 'more' ELSE regexp_replace(body, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'more' END) AS sha256, false AS missing FROM s
        UNION ALL SELECT DISTINCT conv_id, 'absent', NULL, true FROM s""",
    "canonical_document": f"""WITH {_S}, w AS (SELECT conv_id, string_agg('- w' || ord, chr(10) ORDER BY ord) AS w FROM s WHERE ord < 2 GROUP BY conv_id),
        p AS (SELECT conv_id, unnest([0, 1, 2, 3]) AS place, unnest(['user 0', 'assistant 1', 'user 2', 'Summary']) AS heading FROM (SELECT DISTINCT conv_id FROM s))
        SELECT p.conv_id, CAST(place AS BIGINT) AS place, p.heading, sha256(CASE WHEN trim(coalesce(body, '')) = '' THEN 'Not visible.' ELSE regexp_replace(body, '^\\s+|\\s+$', '', 'g') END || CASE WHEN place = 3 THEN chr(10) || w ELSE '' END) AS sha256
        FROM p JOIN w USING (conv_id) LEFT JOIN s ON s.conv_id = p.conv_id AND s.heading = p.heading""",
    "heading_blocks": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, role || ' ' || turn AS heading FROM conversations",
    "fenced_outline": """SELECT conv_id, CAST(1 AS BIGINT) AS level, role AS heading, count(*) AS n FROM conversations GROUP BY conv_id, role
        UNION ALL SELECT conv_id, CAST(2 AS BIGINT), 'shown', count(*) FROM conversations WHERE turn % 3 <> 1 GROUP BY conv_id""",
    "demoted_findings": f"""WITH {_LEDGER}, l AS (SELECT * FROM ledger WHERE heading = 'Opening' OR kind <> 'reference'), b AS (SELECT DISTINCT conv_id, heading FROM l WHERE kind = 'reference')
        SELECT l.conv_id, l.heading, CASE WHEN kind = 'finding' AND b.conv_id IS NULL THEN 'uncertainty' ELSE kind END AS kind, count(*) AS n FROM l LEFT JOIN b ON b.conv_id = l.conv_id AND b.heading = l.heading GROUP BY 1, 2, 3""",
    "grounded_sections": f"WITH {_LEDGER} SELECT conv_id, heading FROM ledger GROUP BY 1, 2 HAVING bool_or(kind = 'finding') AND bool_or(kind = 'reference')",
    "split_ledgers": f"""WITH RECURSIVE {_LEDGER}, l AS (SELECT *, CASE heading WHEN 'Opening' THEN 0 ELSE 1 END AS place, length(text) AS n FROM ledger),
        i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, ord) AS k FROM l WHERE kind <> 'reference'),
        r AS (SELECT conv_id, k, n AS used, CAST(1 AS BIGINT) AS part FROM i WHERE k = 1
          UNION ALL SELECT i.conv_id, i.k, CASE WHEN used = 0 OR used + 1 + n > 630 THEN n ELSE used + 1 + n END, CASE WHEN used = 0 OR used + 1 + n > 630 THEN part + 1 ELSE part END FROM r JOIN i ON i.conv_id = r.conv_id AND i.k = r.k + 1),
        p AS (SELECT conv_id, part, heading, place, kind, text FROM i JOIN r USING (conv_id, k)),
        f AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, place ORDER BY ord ROWS UNBOUNDED PRECEDING) AS upto FROM l WHERE kind = 'reference')
        SELECT conv_id, part, heading, kind, sha256(text) AS item FROM p
        UNION ALL SELECT f.conv_id, x.part, f.heading, f.kind, sha256(f.text) FROM f JOIN (SELECT DISTINCT conv_id, place, part FROM p) x USING (conv_id, place) WHERE upto <= 270""",
    "projected_ledger": f"""WITH {_LEDGER}, l AS (SELECT conv_id, heading, kind, sha256(text) AS item, ord FROM ledger)
        SELECT 'a' AS writer, * FROM l WHERE heading = 'Opening' UNION ALL SELECT 'a', conv_id, 'Sources', kind, item, min(ord) FROM l WHERE kind = 'reference' GROUP BY ALL
        UNION ALL SELECT 'b', * FROM l WHERE heading = 'Middle' UNION ALL SELECT 'b', conv_id, 'Open', kind, item, min(ord) FROM l WHERE kind = 'uncertainty' GROUP BY ALL
        UNION ALL SELECT 'c', * FROM l WHERE heading = 'Middle'""",
    "reduced_ledgers": "SELECT user_id % 3 AS batch, event_type AS kind, 'u' || user_id AS text, min(event_id) AS ord FROM events GROUP BY 1, 2, 3",
    "section_groups": "SELECT conv_id, turn, CAST(floor(turn / 4) AS BIGINT) AS whole, CAST(floor(turn / 2) AS BIGINT) AS halved FROM conversations",
    "packed_ledgers": f"""WITH RECURSIVE {_LEDGER}, z AS (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n, row_number() OVER (ORDER BY conv_id) AS k FROM ledger GROUP BY conv_id),
        r AS (SELECT conv_id, k, n AS used, CAST(1 AS BIGINT) AS chunk FROM z WHERE k = 1
          UNION ALL SELECT z.conv_id, z.k, CASE WHEN used = 0 OR used + 1 + n > 4000 THEN n ELSE used + 1 + n END, CASE WHEN used = 0 OR used + 1 + n > 4000 THEN chunk + 1 ELSE chunk END FROM r JOIN z ON z.k = r.k + 1)
        SELECT conv_id, chunk FROM r""",
    "record_coverage": """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lang, source FROM documents), v AS (SELECT doc_id, CAST(CASE WHEN contains(t, lang) OR contains(t, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(t, source) THEN 1 ELSE 0 END AS BIGINT) AS m FROM d)
        SELECT doc_id, CAST(CASE WHEN doc_id % 5 > 0 THEN 3 ELSE 0 END AS BIGINT) AS n_records, CASE WHEN doc_id % 5 > 0 THEN m ELSE 0 END AS n_mentioned, CASE WHEN doc_id % 5 > 0 THEN m / 3.0 END AS coverage FROM v""",
    "document_counts": f"""WITH c AS (SELECT conv_id, count(*) AS n, sum(len(regexp_extract_all(coalesce(text, ''), '\\S+'))) + 3 * count(*) AS words, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS e,
          sum(len(regexp_extract_all(coalesce(text, ''), '{_OPEN}'))) AS o FROM conversations GROUP BY conv_id)
        SELECT conv_id, n AS n_headings, CAST(0 AS BIGINT) AS n_duplicates, e AS n_empty, false AS diagram, CAST(words AS BIGINT) AS n_words,
          CASE WHEN conv_id % 100 >= 75 THEN o + e <= 3 WHEN conv_id % 100 < 45 THEN o + e > 0 ELSE true END AS agrees FROM c""",
    "cross_findings": """WITH n AS (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS u, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS p, (SELECT count(*) FILTER (WHERE c_acctbal < 0) / count(*) FROM customer) AS d),
        f AS (SELECT 'critical' AS severity, 'calls without any match' AS message, 10 AS c UNION ALL SELECT 'warning', u || ' unresolved matches', 4 FROM n WHERE u > 0 UNION ALL SELECT 'warning', p || ' partial flows', 4 FROM n WHERE p > 0
          UNION ALL SELECT 'warning', 'low edge density', 4 FROM n WHERE d > 0 AND d < 0.5 UNION ALL SELECT 'info', 'no semantic records', 1)
        SELECT severity, message, CAST(100 - sum(c) OVER () AS BIGINT) AS score FROM f""",
    "offending_rows": """SELECT 'negative customer' AS rule, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'large part', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 48
        UNION ALL SELECT 'late line', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity > 49""",
    "module_report": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
        SELECT p_brand, '## ' || p_brand || chr(10) || chr(10) || string_agg('- ' || p_name || ' ' || p_partkey, chr(10) ORDER BY k) FILTER (WHERE k <= 5) || CASE WHEN max(n) > 5 THEN chr(10) || '- and ' || (max(n) - 5) || ' more' ELSE '' END AS text FROM p GROUP BY p_brand""",
    "page_score_full": f"""WITH t AS (SELECT doc_id, ({_FULL} + CASE WHEN n_chars < 2000 THEN 0.0 WHEN n_chars < 6000 THEN 0.5 ELSE 1.0 END * 5.0) AS total, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END AS unknown FROM documents),
        x AS (SELECT doc_id, CAST(least(greatest(floor(total - least(2 * unknown, 12) - least(2 * (doc_id % 7), 10) + 0.5), 0), 100) AS BIGINT) AS score FROM t) SELECT doc_id, score, {_GRADE} AS grade FROM x""",
    "graph_density": None,
    "artifact_freshness": """SELECT s_suppkey AS artifact, CASE s_suppkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid-metadata' WHEN 2 THEN 'stale' ELSE CASE WHEN s_suppkey % 8 = 7 THEN 'stale' ELSE 'fresh' END END AS state FROM supplier""",
    "pipeline_freshness": """WITH b AS (SELECT max(s_suppkey) AS newest FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 > 0)
        SELECT s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN ['missing-base', 'missing-optional', 'missing-derived'][s_suppkey % 3 + 1] ELSE 'stale-derived' END AS problem,
          CASE WHEN s_suppkey % 5 > 0 THEN 'low' WHEN s_suppkey % 3 = 0 THEN 'high' ELSE 'medium' END AS severity FROM supplier, b WHERE s_suppkey % 5 = 0 OR (s_suppkey % 3 = 2 AND s_suppkey < newest)""",
    "pipeline_rebuild": "SELECT false AS rebuild",
    "identity_mismatches": """SELECT s_suppkey AS role, CASE WHEN s_suppkey % 3 = 0 THEN 'missing' ELSE concat_ws(',', CASE WHEN s_suppkey % 3 = 1 THEN 'repo' END, CASE WHEN s_suppkey % 2 = 0 THEN 'branch' END) END AS mismatches FROM supplier""",
    "commit_check": "SELECT CAST(1 AS BIGINT) AS n_changed, count(*) FILTER (WHERE coalesce(text, '') = '') AS n_missing, false AS committed FROM documents",
    "reusable_steps": "SELECT o_custkey AS run, o_orderkey AS step, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 AS reusable FROM orders",
    "bounded_cache": """WITH d AS (SELECT doc_id, 'v1:' || lang || ':' || substr(sha256(coalesce(text, '')), 1, 2) AS key FROM documents), m AS (SELECT DISTINCT key FROM d WHERE key NOT LIKE 'v1:fr%' ORDER BY key LIMIT 50)
        SELECT doc_id, key, CASE WHEN key LIKE 'v1:fr%' THEN 'cached' WHEN key IN (SELECT key FROM m) THEN 'made' END AS value FROM d""",
    "first_by_order": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "json_record_hash": """SELECT p_partkey, substr(sha256('{"name":"' || p_name || '"' || CASE WHEN p_partkey % 2 = 0 THEN ',"brand":"' || p_brand || '"' ELSE '' END || ',"size":' || p_size || '}'), 1, 16) AS record_hash,
        sha256('v2:model:' || p_name) AS cache_key FROM part""",
    "repository_addresses": """SELECT s_suppkey, 'host.org' AS host, 'proj' AS project, 'r' || s_suppkey AS repository, CASE WHEN s_suppkey % 3 = 1 THEN 'https' ELSE 'ssh' END || '://host.org/proj/r' || s_suppkey AS identity,
        CASE s_suppkey % 3 WHEN 0 THEN 'ssh://git@Host.org/proj/r' || s_suppkey || '.git' WHEN 1 THEN 'https://host.org/proj/r' || s_suppkey || '/' ELSE 'git@host.org:proj/r' || s_suppkey || '.git' END AS stored, s_suppkey % 3 = 1 AS credentials FROM supplier""",
    "parts_of_sources": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS part, count(*) OVER (PARTITION BY source) AS parts FROM documents",
    "array_utilities": """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
        SELECT conv_id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS roles, array_to_string(r[2:3], ',') AS middle, list_contains(r, 'assistant') AS "any", len(list_filter(r, lambda x: x <> 'user')) = 0 AS "all" FROM c""",
    "canonical_order": f"""WITH c AS (SELECT conv_id, role || ' ' || turn AS heading FROM conversations) SELECT conv_id, heading, row_number() OVER (PARTITION BY conv_id ORDER BY {_CASE_CANON}, heading) AS rank FROM c QUALIFY rank <= 100""",
    "full_findings_score": f"WITH {_SCORED} SELECT {_GRADE} AS grade, count(*) AS n, max(score) AS best FROM scored GROUP BY 1",
}
from cairn.oracles import _NODES  # noqa: E402

ORACLE_SQL["graph_density"] = f"WITH {_NODES} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes) AS density"
