"""Extractors on small source files, sources and sinks, text functions, streams, allocation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.functions import scan
from cairn.functions import text as T
from cairn.operators import allocate, extract, graph, match, select, state
from cairn.plans.running import running_totals
from cairn.sources import files as source
from cairn.streaming import incremental

CONTROLLER = """package shop.web;
import shop.svc.OrderService;
import java.util.List;
@RestController
@RequestMapping("/api/orders")
public class OrderController {
  private final OrderService orders;
  @GetMapping("/{id}")
  public OrderDto one(@PathVariable("id") Long id, @RequestParam(name = "full", required = false) boolean full) { return orders.find(id); }
  @PostMapping
  public OrderDto add(@RequestBody OrderRequest body) { orders.check(body); return orders.add(body); }
}
"""
ENTITY = """package shop.data;
@Entity
@Table(name = "orders")
public class Order { @Id private Long id; private String code; @ManyToOne private Customer customer; }
"""
REPOSITORY = """package shop.data;
public interface OrderRepository extends JpaRepository<Order, Long> {
  @Query("select o from Order o") List<Order> everything();
  List<Order> findByCode(String code);
}
"""
PAGE = """import { api } from '../api';
export default function OrderPage() {
  const [order, setOrder] = useState(null);
  return <form onSubmit={save}><input name="code"/><OrderTable/><button onClick={load}>Load order</button></form>;
}
"""
API = "const BASE_PATH = '/api/orders';\nexport const load = (id) => apiClient.get(`/api/orders/${id}`);\nfetch('/api/ping', { method: 'POST' });\n"
ROUTES = '<Route path="/orders" element={<Guard><OrderPage/></Guard>} />\n'
FILES = [
    ("bff/src/main/java/shop/OrderController.java", CONTROLLER),
    ("bff/src/main/java/shop/Order.java", ENTITY),
    ("bff/src/main/java/shop/OrderRepository.java", REPOSITORY),
    ("bff/src/main/resources/application.properties", "server.port=1\ndb.password=x\n"),
    ("ui/src/pages/OrderPage.tsx", PAGE),
    ("ui/src/api/orderApi.ts", API),
    ("ui/src/AppRoutes.tsx", ROUTES),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def test_java_records(files):
    by = {r["class_name"]: r for r in extract.components(files).collect()}
    c = by["OrderController"]
    assert (c["type"], c["base_path"], c["annotations"], c["constructor_dependencies"]) == ("controller", "/api/orders", ["RestController", "RequestMapping"], ["OrderService"])
    assert by["OrderRepository"]["extended"] == "JpaRepository<Order" and by["Order"]["type"] == "entity"
    ends = extract.endpoints(files)
    assert {(r["http_method"], r["path"], r["handler"]) for r in ends.collect()} == {("GET", "/api/orders/{id}", "one"), ("POST", "/api/orders", "add")}
    assert {(r["source"], r["name"], r["required"]) for r in extract.parameters(ends).collect()} == {("path", "id", True), ("query", "full", False), ("body", "body", True)}
    e = extract.entities(files).first()
    assert (e["table_name"], e["id_field"], e["relations"]) == ("orders", "id", ["customer"])
    assert {(r["method"], r["entity"], r["confidence"]) for r in extract.repository_methods(files).collect()} == {("everything", "Order", "high"), ("findByCode", "Order", "medium")}
    assert {(r["method"], r["receiver_type"], r["target"]) for r in extract.method_calls(files).collect()} >= {("one", "OrderService", "find"), ("add", "OrderService", "add"), ("add", "OrderService", "check")}
    assert ("OrderController", "OrderService") in {(r["from"], r["to"]) for r in extract.imports(files).collect()}
    assert {r["key"] for r in extract.config_keys(files).collect()} == {"server.port", "db.password=[MASKED_SECRET]"}


def test_script_records(files):
    routes = extract.routes(files)
    assert [(r["route"], r["component"]) for r in routes.collect()] == [("/orders", "OrderPage")]
    page = extract.ui_components(files, routes).where("component = 'OrderPage'").first()
    assert page["classification"] == "page" and "OrderTable" in page["children"]
    assert {(r["event"], r["handler"]) for r in extract.interactions(files).collect()} == {("onSubmit", "save")}  # the button stands in the form's own text
    assert {(r["http_method"], r["target"]) for r in extract.api_calls(files).collect()} == {("GET", "/api/orders/{id}"), ("POST", "/api/ping")}
    assert [r["state"] for r in extract.state_hooks(files).collect()] == ["order"]
    assert [r["field"] for r in extract.form_fields(files).collect()] == ["code"]
    assert [(r["name"], r["value"]) for r in extract.shared_constants(files).collect()] == [("BASE_PATH", "'/api/orders'")]


def test_calls_of_the_page_meet_the_controller(files):
    calls = extract.api_calls(files).select(F.monotonically_increasing_id().alias("ord"), F.col("http_method").alias("method"), F.col("target").alias("path"))
    ends = extract.endpoints(files).select("ord", F.col("http_method").alias("method"), "path")
    found = {r["call"]: r["confidence"] for r in match.two_tier_match(calls, ends).collect()}
    assert found == {"GET /api/orders/{param}": "high", "POST /api/ping": "unmatched"}


def test_paths(spark):
    rows = ["/a//b/", "a/:id?x=1", "https://h.x/a/{id}#f", "/a/${id}/c", "", None, "HTTP://h"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "p string").select(T.http_path("p")).collect()]
    assert got == ["/a/b", "/a/{param}", "/a/%7Bid%7D", "/a/{param}/c", "/", "/", "/"]


def test_masks(spark):
    rows = ['"password": "a\\"b", x', "'token' : 'v'", '"secret": 12, y', 'api_key = "v"', "secret: 'v'", "password=hunter2", "Authorization: Bearer abc.def", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "nothing"]
    got = [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "t string").select(T.mask_secrets("t"), T.mask_count("t")).collect()]
    assert [n for _, n in got] == [1] * 8 + [0]
    assert got[0][0] == '"password": "[MASKED_SECRET]", x' and got[5][0] == "password=[MASKED_SECRET]" and got[8][0] == "nothing"


def test_scan_and_jsonl(spark, tmp_path):
    for path, content in FILES + [("bff/node_modules/x/a.js", "skip"), ("bff/pom.xml", "<project/>")]:
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(content)
    (tmp_path / "src/bff/binary.java").write_bytes(b"a\0b")
    scanned = source.scan_files(spark, str(tmp_path / "src"))
    rows = {r["path"]: r for r in scanned.collect()}
    assert set(rows) == {p for p, _ in FILES} | {"bff/pom.xml"}
    assert (rows[FILES[0][0]]["module_path"], rows[FILES[0][0]]["source_set"]) == ("bff", "main")
    assert scanned.agg(source.build_tool()).first()[0] == "Maven"
    (tmp_path / "ok.jsonl").write_text('﻿{"a": 1}\r\n\n{"a": 2, "b": "x"}\n')
    schema = StructType().add("a", "long").add("b", "string")
    assert sorted(r["a"] for r in source.read_jsonl(spark, str(tmp_path / "ok.jsonl"), schema, ["a"]).collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception, match="JSONL_INVALID_JSON"):
        source.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    with pytest.raises(Exception, match="JSONL_INVALID_RECORD"):
        source.read_jsonl(spark, str(tmp_path / "ok.jsonl"), schema, ["b"]).collect()


def test_repositories_are_scanned_within_their_limits(spark, tmp_path):
    names = ["pom.xml", "src/main/java/a/B.java", "src/test/java/a/BTest.java", "other/C.java", "src/main/resources/application-dev.yml", "src/main/resources/data.yml", "target/src/main/java/X.java", "ui/App.tsx", "ui/vite.config.ts", "ui/coverage/x.js", "ui/package.json"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x" * len(n))
    paths = lambda df: [r["path"] for r in df.collect()]
    assert paths(source.scan_repository(spark, str(tmp_path))) == ["pom.xml", "src/main/java/a/B.java", "src/main/resources/application-dev.yml", "src/test/java/a/BTest.java"]
    assert paths(source.scan_repository(spark, str(tmp_path), user_interface=True)) == ["ui/App.tsx", "ui/package.json", "ui/vite.config.ts"]
    with pytest.raises(ValueError, match="file-count: ui/vite.config.ts"):
        source.scan_repository(spark, str(tmp_path), True, (2, 100, 1000))
    with pytest.raises(ValueError, match="file-size: src/main/resources/application-dev.yml"):
        source.scan_repository(spark, str(tmp_path), limits=(10, 30, 1000))


def test_reachability_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 5)], "a long, b long")
    seeds = spark.createDataFrame([(1, 1), (4, 4)], "source long, node long")
    got = {(r["source"], r["node"], r["depth"]) for r in graph.reachable(seeds, edges).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0), (4, 3, 1), (4, 1, 2), (4, 2, 3)}
    assert [tuple(r) for r in graph.unique_owner(graph.reachable(seeds, edges)).collect()] == [(4, 4)]


def plain_fair(wants, budget):
    got, open_ = [0] * len(wants), list(range(len(wants)))
    while open_:
        each, more = divmod(budget, len(open_))
        met = [k for k in open_ if wants[k] <= each]
        if not met:
            for place, k in enumerate(open_):
                got[k] = each + (place < more)
            return got
        for k in met:
            got[k], budget = wants[k], budget - wants[k]
        open_ = [k for k in open_ if k not in met]
    return got


def plain_weighted(wants, weights, budget):
    got = [min(192, budget // len(wants), w) for w in wants]
    left = budget - sum(got)
    while left > 0 and (open_ := [k for k, w in enumerate(wants) if w > got[k]]):
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if wants[k] - got[k] <= left * weights[k] // total]
        if full:
            left -= wants[full[0]] - got[full[0]]
            got[full[0]] = wants[full[0]]
            continue
        rest = left
        for k in open_:
            give = min(wants[k] - got[k], rest if k == open_[-1] else left * weights[k] // total)
            got[k], rest = got[k] + give, rest - give
        left = rest
        if left > 0 and (open_ := [k for k in open_ if wants[k] > got[k]]):
            got[open_[0]], left = got[open_[0]] + 1, left - 1
    return got


def test_shares(spark):
    rng = random.Random(8)
    groups = {"known": ([955, 2148, 996, 1850, 686, 51, 2715, 892], [2, 2, 2, 6, 6, 4, 4, 4])}
    for k in range(250):
        n = rng.randrange(1, 9)
        groups[f"g{k}"] = ([rng.choice([0, 1, 50, rng.randrange(3000), rng.randrange(3000)]) for _ in range(n)], [rng.choice([2, 4, 5, 6]) for _ in range(n)])
    groups["none"] = ([0, 0], [2, 2])
    rows = [(g, k, w, c) for g, (wants, weights) in groups.items() for k, (w, c) in enumerate(zip(wants, weights, strict=True))]
    items = spark.createDataFrame(rows, "g string, k long, want long, w long")
    fair, weighted = {}, {}
    for r in allocate.fair_allocation(items, ["g"], "k", "want", 5386).collect():
        fair.setdefault(r["g"], {})[r["k"]] = r["granted"]
    for r in allocate.weighted_allocation(items, ["g"], "k", "want", "w", 5386).collect():
        weighted.setdefault(r["g"], {})[r["k"]] = r["granted"]
    for g, (wants, weights) in groups.items():
        assert [fair[g][k] for k in range(len(wants))] == plain_fair(wants, 5386), g
        assert [weighted[g][k] for k in range(len(wants))] == plain_weighted(wants, weights, 5386), g


def test_running_totals_of_a_hot_group(spark):
    rows = [("hot", k, k % 7) for k in range(5000)] + [(None, 1, 5), (None, 2, 6)]
    made = running_totals(spark.createDataFrame(rows, "g string, k long, n long").repartition(6), ["g"], [F.col("k")], {"upto": F.col("n"), "ord": F.lit(1)})
    got = {(r["g"], r["k"]): (r["upto"], r["ord"]) for r in made.collect()}
    want, total = {(None, 1): (5, 1), (None, 2): (11, 2)}, 0
    for k in range(5000):
        total += k % 7
        want["hot", k] = (total, k + 1)
    assert got == want


def test_scanners():
    assert scan.split_top("a, b(c, d), 'x,y', {e, f}") == ["a", "b(c, d)", "'x,y'", "{e, f}"]
    assert scan.split_top("Map<String, List<X>> a, int b", angles=True) == ["Map<String, List<X>> a", "int b"]
    values = {"B": "'/api'", "P": "`${B}/x`", "L": "L", "M": "N", "N": "M + '/z'", "O.q": "B + '/q'"}.get
    resolved = {"`${P}/${order.id}`": "/api/x/{id}", "O.q": "/api/q", "L": None, "N": "{M}/z", "env.x ?? P": "/api/x", "B + '/' + id": "/api/{id}", "a ? '/x/1' : '/x/2'": "/x/{choice}", "(('/k'))": "/k", "foo()": None}
    assert {e: scan.resolve_path(e, values) for e in resolved} == resolved
    text = "class A { public int f(int a) throws X { if (a) { g('}'); } return 1; } private void h() { } }"
    assert [(n, text[a:b]) for n, a, b in scan.java_methods(text)] == [("f", text[10:71]), ("h", text[72:92])]
    script = "const load = async (id) => { return api.get(`/x/${id}`); }\nexport function Foo({a}) { return 1 }\nconst X = '/y';\n"
    spans = {n: script[slice(*scan.declaration(script, n))] for n in ("load", "Foo", "X")}
    assert spans == {"load": script.split("\n")[0], "Foo": script.split("\n")[1], "X": script.split("\n")[2]}
    assert scan.declaration(script, "absent") is None and scan.close_of("(a", 0) == 2


def test_sources_and_sinks_of_documents(spark, tmp_path):
    assert source.read_optional_text(spark, str(tmp_path / "none.txt")).first()["value"] == ""
    (tmp_path / "some.txt").write_text("a\nb")
    assert source.read_optional_text(spark, str(tmp_path / "some.txt")).first()["value"] == "a\nb"
    with pytest.raises(FileNotFoundError, match="JSONL_NOT_FOUND"):
        source.read_required_jsonl(spark, str(tmp_path / "none.jsonl"), StructType().add("a", "long"))
    paths = ["src/a.java", "../a", "/etc/x", "a/./b", "C:\\x", "ok\\b.ts", "a/..b"]
    kept = source.contained(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r["path"] for r in kept.collect()} == {"src/a.java", "ok\\b.ts", "a/..b"}
    for k in range(2):
        source.append_audit(spark.createDataFrame([(k, "password=hunter2 " + "x" * 5000)], "k long, error string"), str(tmp_path / "audit"))
    audit = spark.read.json(str(tmp_path / "audit")).collect()
    assert {r["k"] for r in audit} == {0, 1} and all(len(r["error"]) == 4000 and "hunter2" not in r["error"] for r in audit)
    source.write_markdown(spark.createDataFrame([("one", "## Body")], "name string, body string"), str(tmp_path / "md"), "T", "repo", "main")
    lines = "".join((next((tmp_path / "md" / "name=one").glob("*.txt"))).read_text())
    assert lines.startswith("# T\n") and "- Branch: main" in lines and lines.rstrip().endswith("## Body")
    source.write_json_documents(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "json"))
    assert "".join(f.read_text() for f in (tmp_path / "json").glob("*.txt")).strip() == '{\n  "a" : 1\n}'
    source.commit_manifest(spark, str(tmp_path / "tables"), {"t": spark.range(3).toDF("k")})
    assert spark.read.json(str(tmp_path / "tables/_manifest")).first()["n_rows"] == 3


def test_cache_bounds_what_is_computed(spark):
    rows = spark.createDataFrame([(k, f"k{k % 4}") for k in range(8)], "id long, key string")
    cache = spark.createDataFrame([("k0", "old")], "key string, value string")
    out, made = state.through_cache(rows, cache, "key", lambda m: m.withColumn("value", F.lit("new")), at_most=2)
    assert sorted((r["id"], r["value"]) for r in out.collect()) == [(k, {0: "old", 1: "new", 2: "new", 3: None}[k % 4]) for k in range(8)]
    assert made.count() == 2


def test_stream_upsert(spark, tmp_path):
    schema = "k long, v long, at long"
    spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1)], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing new
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.upsert_stream(stream, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "check")).awaitTermination(60)
    spark.createDataFrame([(2, 9, 3)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), ["k"], "at", str(tmp_path / "check")).awaitTermination(60)
    got = incremental.current_rows(spark.read.parquet(str(tmp_path / "out")), ["k"])
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, 2), (2, 9)]


def test_packing_carries_its_chunk_over_long_groups(spark):
    sizes = [(k * 37) % 290 for k in range(25_000)]
    rows = [("hot", k, n) for k, n in enumerate(sizes)] + [(None, k, 40) for k in range(3)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, n_chars long").repartition(5)
    want, used, chunk = {}, 0, 0
    for k, n in enumerate(sizes):
        if used == 0 or used + 7 + n > 600:
            used, chunk = n, chunk + 1
        else:
            used += 7 + n
        want["hot", k] = chunk
    want |= {(None, k): 1 for k in range(3)}
    got = {(r["source"], r["doc_id"]): r["chunk"] for r in select.packed(docs, ["source"], "doc_id", "n_chars", 600).collect()}
    assert got == want


def test_shares_below_one_unit(spark):
    """More items than budget: as many rounds as items are met, more than any limit of rounds, and settled all the same."""
    rng = random.Random(4)
    groups = {"ones": ([1] * 400, [2] * 400), "ends": ([3] + [1] * 500, [2, 4] * 250 + [6]), **{f"g{k}": ([rng.choice([0, 1, 2, 40]) for _ in range(900)], [rng.choice([2, 4, 6]) for _ in range(900)]) for k in range(6)}}
    rows = [(g, k, w, c) for g, (wants, weights) in groups.items() for k, (w, c) in enumerate(zip(wants, weights, strict=True))]
    got = {}
    for r in allocate.weighted_allocation(spark.createDataFrame(rows, "g string, k long, want long, w long"), ["g"], "k", "want", "w", 190).collect():
        got.setdefault(r["g"], {})[r["k"]] = r["granted"]
    for g, (wants, weights) in groups.items():
        assert [got[g][k] for k in range(len(wants))] == plain_weighted(wants, weights, 190), g
