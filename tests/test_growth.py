"""Work that grows with the tables only: hot names meet once, a file is read once, small tables are dealt over all tasks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cairn.functions import java, scan
from cairn.operators import flows, focus, graph
from cairn.registered import sources, varied

SF = "/root/testdata/sf0.001"


def test_pairs_of_hot_names_are_made_once(spark):
    """records and pages meet by class; the pairs themselves are neither compared nor made distinct."""
    rng = random.Random(5)
    names = ["en", "src1/en", "src2/de", "a", "", None, "src12"]
    r = [(k % 90, rng.choice(names)) for k in range(200)]
    p = [(k % 70, rng.choice(["e-n", "SRC1", "src1/enormous", "b", "", None])) for k in range(160)]
    plain = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    records, pages = spark.createDataFrame(r, "record int, name string"), spark.createDataFrame(p, "page int, needle string")
    for strict in (True, False):
        want = {(i, j) for i, a in r for j, b in p for a, b in [(plain(a), plain(b))] if a and (b or not strict) and (a in b or b in a)}
        found = flows.matching_pages(records, pages, strict)
        got = [(x.record, x.page) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan.split("Join")[0]


def test_pairs_come_from_arrays_of_pages(spark, monkeypatch):
    """F1 of round 4: a join makes a row for a record and an array of pages; before, one for each pair."""
    monkeypatch.setattr(flows, "PAIRS", 50)
    monkeypatch.setattr(flows, "CHUNK", 7)
    r = [*[(k, "src/en") for k in range(90)], (None, "src/en"), (3, "other"), (200, "abc")]
    p = [*[(k, "e-n") for k in range(40)], (None, "EN"), (5, "oth"), (50, "srcenlarge"), (None, "x")]
    found = flows.matching_pages(spark.createDataFrame(r, "record int, name string"), spark.createDataFrame(p, "page int, needle string"))
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, a in r for j, b in p if a == "src/en" and b in ("e-n", "EN", "srcenlarge") or (a, b) == ("other", "oth")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan.split("Join")[0]


def test_alike_calls_of_hot_names_are_their_first_ones(spark):
    """each endpoint meets the first texts and clients of its stems, not every call that is alike."""
    ends = spark.range(60).select(F.col("id").alias("endpoint_ord"), F.lit("load").alias("handler"), F.lit("/none").alias("path"))
    calls = spark.range(300).select(F.concat(F.lit("t"), F.lpad("id", 4, "0")).alias("text"), F.concat(F.lit("zz"), F.lpad("id", 4, "0")).alias("client"), F.lit("loadAll").alias("method"))
    found = flows._similar_calls(ends, calls, 20, 5).collect()
    assert len(found) == 60 * 25
    assert {x.text for x in found if x.text} == {f"t{k:04}" for k in range(20)} and {x.client for x in found if x.client} == {f"zz{k:04}" for k in range(5)}


def test_files_are_dealt_over_tasks(spark):
    assert len(sources.tree(spark, SF).inputFiles()) > 1
    assert all(f.split("/")[-2].startswith("cairn-files") for f in varied.varied_classes(spark, SF).inputFiles())


def test_a_file_is_read_once_for_all_its_records(monkeypatch):
    """F3, F4"""
    read = []
    whole = java.Source.__init__
    monkeypatch.setattr(java.Source, "__init__", lambda self, text: (read.append(1), whole(self, text))[1])
    text = "class A { int x = 1; void m() { x(); } void m(int n) { } class x { } enum B { Y } } /* read once */"
    spans = [focus._block(t, text, s, n, 0, 0) for t, s, n in (("method", "m", None), ("field", "x", None), ("type", None, "x"), ("type", None, "B"), ("method", "absent", None)) for _ in range(3)][::3]
    assert spans == ["void m() { x(); }", "int x = 1;", "class x { }", "enum B { Y }", None] and len(read) == 1


def test_outbound_calls_of_a_file_are_read_once(spark, monkeypatch):
    """F2 of round 4: one pass for all forms of calls, and nothing is dealt; before, five passes and a sort of all chains and assignments."""
    from cairn.functions import calls
    from cairn.operators import extract

    text = """@FeignClient interface Api {
  RestClient rest; WebClient web;
  @GetMapping("/f") Out feign();
  Out a() { url = "/one"; return rest.get().uri(url).retrieve(); }
  Out b() { url = "/two"; Runnable r = new Runnable() { public void run() { web.put().uri(url).retrieve(); } }; return rest.post().uri(none).retrieve(); }
  void c() { restTemplate.delete("/t/{param}"); rest.patch().uri(late).retrieve(); late = "/late"; }
}"""
    want = [("a", 5, "GET", "/one", "high"), ("b", 6, "PUT", "/two", "high"), ("feign", 4, "GET", "/f", "high"), ("c", 7, "DELETE", "/t/{param}", "low")]
    found = extract.outbound_calls(spark.createDataFrame([("A.java", "\n" + text), ("B.java", None), ("c.txt", text)], "path string, content string"))
    assert sorted((r.method, r.line, r.http_method, r.target_path, r.confidence) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and plan.split("== Physical Plan ==")[1].count("MapInPandas") == 1
    read = []
    whole = java.Source.__init__
    monkeypatch.setattr(java.Source, "__init__", lambda self, text: (read.append(1), whole(self, text))[1])
    assert len(list(extract._outbound_calls(text))) == 4 and len(read) == 1
    assert calls.assigned_paths("a = f(';', \"/x\"); // b = 1;\n") == [(16, "a", "/x")]


def test_places_meet_the_innermost_span():
    spans = [(0, 100, "a"), (10, 50, "b"), (20, 30, "c"), (30, 40, "d"), (120, 130, "e")]
    inside = java.innermost(spans)
    for at in range(-1, 140):
        assert inside(at) == min(((b - a, n) for a, b, n in spans if a <= at < b), default=(0, None))[1]
    assert java.innermost([])(3) is None


def test_rows_of_a_large_file_leave_sql_functions_few_at_a_time(spark, monkeypatch):
    """F3 of round 4: a lateral call hands over all rows of a file at once."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from cairn.functions import tables
    from cairn.operators import extract, syntax
    from cairn.registered import focusing

    plan = focusing.endpoints_in_sql(spark, SF)._jdf.queryExecution().toString()
    assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPythonUDTF" not in plan
    text = "@RestController class C {\n" + "\n".join(varied.CONTROLLER[0].replace("<k>", str(k)) for k in range(9000)) + "\n}\n"
    assert len(text) > java.SMALL
    fn, columns = tables.TABLES["java_endpoints"]
    rows = tables._of_table(fn, to_arrow_schema(StructType.fromDDL(f"path string, {columns}")))().eval(pa.RecordBatch.from_pydict({"path": ["a", "none", "b"], "content": [text, None, text[:900]]}))
    tracemalloc.start()
    sizes = [(b.num_rows, set(b.column(0).to_pylist())) for b in rows]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(n <= extract.ROWS for n, _ in sizes) and sum(n for n, p in sizes if p == {"a"}) == 18_000 and sizes[-1][1] == {"b"}
    assert peak < 20 * len(text)  # the declarations alone took more
    held = list(syntax._endpoints(text))
    monkeypatch.setattr(syntax, "SMALL", 1 << 30)
    assert list(syntax._endpoints(text)) == held


def test_functions_of_tables_give_what_lateral_calls_give(spark):
    from cairn.functions import tables

    tables.register(spark)
    java_files = varied.varied_controllers(spark, SF).unionByName(varied.varied_clients(spark, SF).limit(20))
    scripts = varied.varied_scripts(spark, SF).limit(20).unionByName(varied.varied_pages(spark, SF).limit(20))
    for name in tables.TABLES:
        files = (java_files if name.startswith("java") else scripts).orderBy("path")
        one = spark.sql(f"SELECT f.path, t.* FROM {{files}} f, LATERAL {name}(f.content) t", files=files)
        two = spark.sql(f"SELECT * FROM {name}_of(TABLE(SELECT path, content FROM {{files}}))", files=files)
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect())), name


def test_declarations_by_name_are_the_first(spark):
    text = "export default async function one(a) { return 2; }\nconst one = 3;\nconst async function two() { }\nlet $x = 1;\npublic void m() { }\npublic int m(int n) { return n; }\nclass oneMore { }"
    got = {n: text[slice(*scan.declaration(text, n))] for n in ("one", "two", "m", "oneMore")}
    assert got == {"one": "export default async function one(a) { return 2; }", "two": "async function two() { }", "m": "public void m() { }", "oneMore": "class oneMore { }"}
    assert scan.declaration(text, "on") is None and scan.declaration(text, "x.y") is None


def test_large_files_are_read_in_little_memory():
    """tokens and places are small, rows come one at a time."""
    import tracemalloc
    from collections.abc import Iterator

    from cairn.operators import syntax

    text = "@RestController class C {\n" + "\n".join(varied.CONTROLLER[0].replace("<k>", str(k)) for k in range(2000)) + "\n}\n"
    rows = syntax._endpoints(text)
    assert isinstance(rows, Iterator)
    tracemalloc.start()
    assert sum(1 for _ in rows) == 4000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35 * len(text)  # lists of tuples took 56 times the text


def test_a_split_seeks_its_cut_once(spark):
    """the plan holds few searches for the cut, not one for each use of it in each other (there were 432)."""
    from cairn.operators import packs

    docs = spark.createDataFrame([(1, "ab\n" * 900)], "i int, t string")
    plan = packs.adaptive_split(docs, "i", "t", 1000, 300, 50, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") < 30


def test_owners_of_files_need_no_reach(spark, monkeypatch):
    from cairn.operators import graph
    from cairn.registered import sources

    monkeypatch.setattr(graph, "reachable", None)
    assert sources.file_owners(spark, "/root/testdata/sf0.001").count() > 0


def test_calls_meet_names_without_a_group_for_each_file(spark):
    from cairn.operators import extract

    text = "const B = '/api';\nexport function a() { return fetch(B + '/x'); }\nconst b = () => fetch('/y');\n"
    found = extract.api_calls(spark.createDataFrame([("ui/src/api/a.ts", text)], "path string, content string"))
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    assert {(r["function"], r["target"]) for r in found.collect()} == {("a", "/api/x"), ("b", "/y")}


def _plain_reach(seeds, edges):
    best = {}
    for source, node in seeds:
        level, depth = {node}, 0
        while level:
            level = {n for n in level if best.get((source, n), depth + 1) > depth}
            best |= {(source, n): depth for n in level}
            level, depth = {b for a, b in edges if a in level and a is not None and b is not None}, depth + 1
    return {(s, n, d) for (s, n), d in best.items()}


def test_sources_reach_nodes_together(spark, monkeypatch):
    """a round holds a row for each node and word of 64 sources, not one for each source."""
    rows, inner = [], graph.measured

    def counted(*args):
        table, made = inner(*args)
        rows.append(made["n"])
        return table, made

    monkeypatch.setattr(graph, "measured", counted)
    seeds = spark.range(0, 6400, 1, 4).selectExpr("id as source", "0L as node")
    reach = graph.reachable(seeds, spark.range(10).selectExpr("id as a", "id + 1 as b"))
    assert reach.count() == 6400 * 11 and reach.distinct().count() == 6400 * 11
    assert max(rows) <= 6400 // 64 + 4  # a part's last word may be short; before, 6,400 rows a round


def test_reach_of_any_sources_in_cycles(spark):
    rng = random.Random(14)
    names = [*[f"s{k}" for k in range(150)], None]
    nodes = list(range(40))
    seeds = [(s, rng.choice([*nodes, None, 99])) for s in names for _ in range(rng.randint(1, 3))] + [("s0", 1), ("s0", 1)]
    edges = [(rng.choice(nodes), rng.choice([*nodes, 77])) for _ in range(70)] + [(3, 3), (None, 4), (5, None)]
    reach = graph.reachable(spark.createDataFrame(seeds, "source string, node int"), spark.createDataFrame(edges, "a long, b long"))
    got = [tuple(r) for r in reach.collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_reach(seeds, edges)
    assert reach.columns == ["source", "node", "depth"]
    empty = graph.reachable(spark.createDataFrame([], "source string, node int"), spark.createDataFrame(edges, "a long, b long"))
    assert empty.count() == 0


def test_settled_nodes_leave_the_comparison(spark):
    """a node is compared only as long as ways can end there; before, all visited rows were in every round."""
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (10, 11), (11, 10), (11, 12), (4, 12)]
    last = graph._last_steps(spark.createDataFrame(edges, "node long, next long"), 64)
    assert {tuple(r) for r in last.collect()} == {(2, 1), (3, 2), (4, 3), *[(n, 2**31 - 1) for n in (10, 11, 12)]}
    short = graph._last_steps(spark.createDataFrame(edges[:4], "node long, next long"), 2)  # no bound where ways are longer than was looked
    assert {tuple(r) for r in short.collect()} == {(2, 1), (3, 2), (4, 2**31 - 1)}


def test_reach_without_cycles(spark):
    rng = random.Random(41)
    edges = [(a, a + rng.randint(1, 9)) for a in range(60) for _ in range(rng.randint(0, 2))]
    seeds = [(k, rng.randint(0, 30)) for k in range(0, 900, 7)]
    reach = graph.reachable(spark.createDataFrame(seeds, "source int, node long"), spark.createDataFrame(edges, "a long, b long"))
    got = [tuple(r) for r in reach.collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_reach(seeds, edges)
