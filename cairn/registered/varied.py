"""Extractors over source files that Spark assembles from table rows: what a file holds, in what order and how nested differs from file to file.

A customer is a file, its orders are statements in order of their key, whose
form goes by the order's own values; a part is a class. SQL says from the
same rows what has to be found where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import extract, syntax
from cairn.plans.durable import materialize, spread
from cairn.queries import table
from cairn.sources import files


def _filled(template: str, **values: Column) -> Column:
    """``template`` with each <name> replaced by its value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value.cast("string"))
    return out


def _case(key: Column, ways: list[str], **values: Column) -> Column:
    """The filled template whose number is ``key`` modulo their count."""
    chain = None
    for k, template in enumerate(ways):
        hit, made = key % len(ways) == k, _filled(template, **values)
        chain = F.when(hit, made) if chain is None else chain.when(hit, made)
    return chain


def _assembled(rows: DataFrame, by: str, order: str, path: Column, head: Column, statement: Column, tail: str) -> DataFrame:
    """(path, content): a file for each group, its statements in order between head and tail."""
    lists = spread(rows.withColumns({"__s": statement}), by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__s").alias("s"))))["s"].alias("s"))
    # written once: extractors scan the files several times
    return materialize(lists.select(path.alias("path"), F.concat(head, F.array_join("s", "\n"), F.lit(tail)).alias("content")), "files")


#: Statements of a script by order: repeated calls, calls behind another function, wrappers in all their forms.
SCRIPT = [
    "export function plain<k>(id) { return apiClient.get('/same'); }",
    "apiClient.get('/same');",
    "export const arrow<k> = async (a, b) => fetch('/o/<k>', { method: 'POST', headers: { 'X-Id': a }, body: JSON.stringify(b) });",
    "const table<k> = { load<k>(x) { return this.http.delete(`/o/${x.id}/<s>`); } };",
    "sendRequest({ method: 'PUT', url: '/p/<k>', data: body });",
    "const named<k>: Loader = (x) => postJson('/j/' + x.code, { params: filter });",
    "cache.get('/not-http'); /* a call only where the file is a client */ list.delete(<k>); map.get(key);",
    "saveRequest('PATCH', '/q/<k>', { query: q<k> });",
]


def varied_scripts(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lower("o_orderstatus").alias("s"))
    statement = _case(F.col("o_orderkey"), SCRIPT, k=F.col("o_orderkey"), s=F.col("s"))
    return _assembled(o, "o_custkey", "o_orderkey", F.concat(F.lit("ui/src/calls/file"), "o_custkey", F.lit(".ts")), F.lit(""), statement, "\n")


def repeated_api_calls(spark, sf):
    """Every call with the function it stands behind, also where texts repeat or begin alike."""
    c = extract.api_calls(varied_scripts(spark, sf))
    return c.select("path", "function", "http_method", "target", F.array_join("parameters", ",").alias("parameters"), "confidence")


#: Members of a class by order: nested types, methods without modifier, braces in strings and comments, receivers of all kinds.
JAVA = [
    "  public void pub<k>() { repo.load<k>(); repo.load<k>(); }",
    "  void plain<k>() { repo.hidden<k>(); }",
    '  private String quoted<k>(int n) { String s = "}"; /* repo.note<k>(); { */ return repo.quoted<k>(s); }',
    "  public static class Inner<k> { private Audit audit; public void in<k>() { audit.write<k>(); repo.outer<k>(); } }",
    "  protected List<Map<String, Long>> generic<k>(Map<String, List<Long>> m) throws IOException { if (m.isEmpty()) { log.info(\"x\"); return Helper.none<k>(); } return m.values<k>(); }",
    "  @Deprecated(since = \"{\") public int field<k> = client.count<k>();",
]


def varied_classes(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    statement = _case(F.col("o_orderkey"), JAVA, k=F.col("o_orderkey"))
    head = _filled("package p;\nclass K<c> {\n  public Repo<Long> repo;\n  K<c>(final Client<String> client, Map<String, Long> m) { client.open(); }\n", c=F.col("o_custkey"))
    return _assembled(o, "o_custkey", "o_orderkey", F.concat(F.lit("be/src/main/java/p/K"), "o_custkey", F.lit(".java")), head, statement, "\n}\n")


def nested_method_calls(spark, sf):
    return extract.method_calls(varied_classes(spark, sf)).select("path", "class_name", "method", "receiver", "receiver_type", "target", "confidence")


#: Statements of a client's methods by order: variables assigned anew, builders, bodies, headers before and behind the exchange.
CLIENT = [
    '  void a<k>() { url = "/v/<k>"; }',
    "  Out b<k>() { return rest.post().uri(url).header(\"X-Key\", key).contentType(JSON).body(toBody(x, <k>), T.class).retrieve().header(\"X-Late\", v); }",
    '  Out c<k>() { return web.method(HttpMethod.PATCH).uri(b -> b.path("/w").pathSegment("<k>", "z").queryParam("q", f(1, 2)).build()).headers(h -> { h.set("X-Set", a); h.setBearerAuth(t); }).bodyValue(dto).exchange(); }',
    '  Out d<k>() { String other = base + "/d/<k>?x=1"; return this.rest.get()\n      .uri(other)\n      .accept(JSON)\n      .retrieve(); }',
    '  void e<k>() { restTemplate.exchange("http://host/e/<k>", HttpMethod.DELETE, entity(a, b), X.class); cart.get().uri("/no"); }',
    '  Out f<k>() { return web.put().uri(u -> u.path("/old").replacePath("${base}/n/<k>").build()).retrieve(); }',
    "  Out g<k>() { return rest.delete().uri(unknown<k>).retrieve(); }",
]


def varied_clients(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    statement = _case(F.col("o_orderkey"), CLIENT, k=F.col("o_orderkey"))
    head = _filled("package c;\nclass Client<c> {\n  private final RestClient rest; private final WebClient web; private String url;\n", c=F.col("o_custkey"))
    return _assembled(o, "o_custkey", "o_orderkey", F.concat(F.lit("bff/src/main/java/c/Client"), "o_custkey", F.lit(".java")), head, statement, "\n}\n")


def chained_outbound_calls(spark, sf):
    """Chains with what they send; a variable's path is the one assigned last before the call."""
    c = extract.outbound_calls(varied_clients(spark, sf))
    return c.select("path", "client", F.col("line").cast("bigint").alias("line"), "method", "http_method", "target_path", F.array_join(F.coalesce("headers", F.array()), ",").alias("headers"), "body", "confidence")


#: A page's elements by order: labels with tags and values, self-closed ones, several handlers, long labels, forms.
ELEMENTS = [
    "<button onClick={() => load(<k>)}>Load <b>{order.<s>}</b> now</button>",
    "<input onChange={set<k>} value={x}/>",
    "<a href=\"/x\" onClick={go<k>} onChange={pick<k>}>  two\n words </a>",
    "<form className=\"f\" onSubmit={save<k>}><p>LONGTEXT</p></form>",
    "<Fancy.Button onClick={() => { a(); b<k>(); }}>{label}</Fancy.Button>",
    "<div onClick={outer<k>}><span onClick={inner<k>}>in</span></div>",
    "<option value=\"<k>\">none</option>",
]


def varied_pages(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lower("o_orderstatus").alias("s"))
    statement = _case(F.col("o_orderkey"), [e.replace("LONGTEXT", "long text " * 15) for e in ELEMENTS], k=F.col("o_orderkey"), s=F.col("s"))
    c = F.col("o_custkey")
    name = F.when(c % 3 == 0, F.concat(F.lit("Orders"), c, F.lit("Page"))).otherwise(F.concat(F.lit("Orders"), c))
    head = F.concat(F.lit("import React from 'react';\nfunction Helper() { return <i/>; }\nexport default function "), name, F.lit("() {\n  return <section>\n"))
    folder = F.when(c % 3 == 0, "pages").otherwise("components")
    return _assembled(o, "o_custkey", "o_orderkey", F.concat(F.lit("ui/src/"), folder, F.lit("/"), name, F.lit(".tsx")), head, statement, "\n  </section>;\n}\n")


def owned_interactions(spark, sf):
    f = varied_pages(spark, sf)
    return extract.interactions(f, extract.ui_components(f, extract.routes(f))).select("path", "element", "event", "handler", "label", "component", "page")


#: Components by order: what is one, what isn't, and how it is exported.
COMPONENTS = [
    "export function Plain<k>(props: Plain<k>Props) { return <Box/>; }",
    "const Quiet<k> = memo((props) => <Row/>);",
    "export const LIMIT<k> = 12; const Config<k> = { a: 1 };",
    "export const Arrow<k>: React.FC<Props> = ({ a }) => { return <Box a={a}/>; };",
    "function lower<k>() { return null; }",
    "const Late<k> = React.forwardRef(function Inner(props, ref) { return <Cell ref={ref}/>; });\nexport { Late<k> as Renamed<k> };",
]


def varied_components(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    c = F.col("o_custkey")
    name = F.when(c % 2 == 0, F.concat(F.lit("Main"), c)).otherwise(F.concat(F.lit("main"), c))
    head = F.concat(F.lit("import React from 'react';\nimport { Box } from \"../box\";\n"), F.when(c % 3 == 0, F.lit("export default () => <Main/>;\n")).otherwise(""))
    statement = _case(F.col("o_orderkey"), COMPONENTS, k=F.col("o_orderkey"))
    return _assembled(o, "o_custkey", "o_orderkey", F.concat(F.lit("ui/src/"), F.when(c % 5 == 0, "views/").otherwise("parts/"), name, F.lit(".tsx")), head, statement, "\n")


def exported_components(spark, sf):
    f = varied_components(spark, sf)
    found = extract.ui_components(f, extract.routes(f))
    return found.select("path", "component", "classification", "export", F.array_join(F.array_sort("children"), ",").alias("children"), F.array_join("imports", ",").alias("imports"), "confidence")


#: One rule of a file's kind each, and neighbours that it mustn't take: path, content.
KINDS = [
    ("be/src/test/java/A<k>.java", "class A<k> { }"), ("be/src/main/java/A<k>.java", "@WebMvcTest class A<k> { }"), ("be/src/main/java/B<k>.java", "class B<k>Tests { }"),
    ("be/src/main/java/controller/C<k>.java", "class C<k> { }"), ("be/src/main/java/D<k>.java", "@Controller class D<k>Service { }"), ("be/src/main/java/E<k>.java", "class E<k>Service { }"),
    ("be/src/main/java/service/F<k>.java", "class F<k> { }"), ("be/src/main/java/G<k>.java", "interface G<k> extends CrudRepository<A, B> { }"), ("be/src/main/java/H<k>.java", "@Entity class H<k> { }"),
    ("be/src/main/java/entity/I<k>.java", "enum I<k> { X }"), ("be/src/main/java/J<k>.java", "class J<k>Config { }"), ("be/src/main/java/K<k>.java", "class K<k>Response { }"),
    ("be/src/main/java/mapper/L<k>.java", "class L<k> { }"), ("be/src/main/java/M<k>.java", "@FeignClient interface M<k> { }"), ("be/src/main/java/N<k>.java", "class N<k>Exception { }"),
    ("be/src/main/java/exception/O<k>.java", "class O<k> { }"), ("be/src/main/java/P<k>.java", "class P<k>Model { }"), ("be/src/main/java/Q<k>.java", "class Q<k>Utils { }"),
    ("be/src/main/java/domain/R<k>.java", "@RestControllerAdvice class R<k> { }"), ("be/src/main/java/SController<k>.java", "class S<k> { }"),
    ("ui/vite.config.<k>.ts", ""), ("ui/src/__tests__/a<k>.ts", ""), ("ui/src/b<k>.spec.tsx", ""), ("ui/src/views/c<k>.tsx", "fetch('/x')"), ("ui/src/D<k>Page.tsx", ""), ("ui/src/homepage.<k>.ts", ""),
    ("ui/src/e<k>.ts", "const x = createApi({})"), ("ui/src/api/f<k>.ts", ""), ("ui/src/g<k>.tsx", "useRoutes(all)"), ("ui/src/hooks/h<k>.ts", ""), ("ui/src/useThing<k>.ts", ""),
    ("ui/src/i<k>.ts", "import create from 'zustand'"), ("ui/src/j<k>.ts", "export interface J<k> { a: string }"), ("ui/src/types/k<k>.ts", ""), ("ui/src/lib/l<k>.ts", ""), ("ui/src/m<k>.ts", "<Box/>"),
    ("ui/src/n<k>.ts", "import x from 'react'"), ("ui/src/o<k>.ts", "const a = 1"),
]
KIND_NAMES = (
    "test test test controller controller service service repository entity entity config dto mapper client exception exception model util unknown unknown "
    "config test test page page unknown api-client api-client route hook unknown store model/type model/type util component component unknown"
).split()


def classified_files(spark, sf):
    """A file for each rule of both classifiers and each supplier."""
    k = F.col("s_suppkey")
    structs = F.array(*[F.struct(F.lit(i).alias("rule"), _filled(p, k=k).alias("path"), _filled(c, k=k).alias("content")) for i, (p, c) in enumerate(KINDS)])
    f = table(spark, sf, "supplier").select(F.explode(structs).alias("f")).select("f.*")
    kind = F.when(F.col("path").endswith(".java"), extract.java_class(F.col("path"), F.col("content"))).otherwise(extract.script_class(F.col("path"), F.col("content")))
    return f.select(F.col("rule").cast("bigint").alias("rule"), "path", kind.alias("kind"))


def indexed_files(spark, sf):
    """The index of files of all kinds: no content, but kind and size."""
    k = F.col("s_suppkey")
    structs = F.array(*[F.struct(F.lit(i).cast("bigint").alias("rule"), _filled(p, k=k).alias("path"), _filled(c, k=k).alias("content")) for i, (p, c) in enumerate([*KINDS, ("README<k>.md", "é<k>")])])
    f = table(spark, sf, "supplier").select(F.explode(structs).alias("f")).select("f.*")
    return extract.file_index(f)


#: Paths by supplier and whether a Spring scan reads them.
SCANNED = [
    ("pom.xml", True), ("a<k>/Build.Gradle.kts", True), ("settings.gradle", True), ("package.json", False), ("m<k>/src/main/java/p/A<k>.java", True), ("src/test/java/B<k>.JAVA", True), ("src/main/kotlin/C<k>.java", False),
    ("xsrc/main/java/D<k>.java", False), ("src/main/resources/application.yml", True), ("src/main/resources/x/bootstrap-dev.<k>.yaml", True), ("src/main/resources/application-.yml", False), ("src/main/resources/applications<k>.yml", False),
    ("src/test/resources/application.yml", False), ("src/main/resources/logback.xml", False), ("target/src/main/java/E<k>.java", False), ("m/.vscode/pom.xml", False), ("BIN/src/main/java/F<k>.java", True), ("Node_Modules/pom.xml", False),
    (".mvn/pom.xml", True), (".ai-docs/<k>/pom.xml", False), ("targets/pom.xml", True), ("out/<k>/build.gradle", False),
]


def scanned_paths(spark, sf):
    """Which paths a Spring scan reads: folders that it passes over, then names."""
    k = F.col("s_suppkey")
    structs = F.array(*[F.struct(F.lit(i).cast("bigint").alias("rule"), _filled(p, k=k).alias("path")) for i, (p, _) in enumerate(SCANNED)])
    f = table(spark, sf, "supplier").select("s_suppkey", F.explode(structs).alias("f")).select("s_suppkey", "f.*")
    return f.where(files.below_ignored(F.col("path"), files.IGNORED) | ~files.spring_relevant(F.col("path"))).select("s_suppkey", "rule", "path")


#: A controller's members by part: what the syntax has to tell apart.
CONTROLLER = [
    '  @GetMapping({"/a<k>", "/b<k>"}) public List<Map<String, Dto>> read<k>(@PathVariable("id") @NotNull Long id) { return x; }',
    '  @PreAuthorize("hasRole(\'A\') and (true)")\n  @RequestMapping(value = "/m<k>", method = {RequestMethod.PUT, RequestMethod.PATCH})\n  public void write<k>(@RequestBody @Valid Body body, @RequestParam(name = "q", required = false) String q) { String s = "}"; }',
    '  static class Nested<k> { @GetMapping("/hidden<k>") public void no<k>() { } }',
    '  // @GetMapping("/comment<k>") public void no() { }\n  /* @PostMapping("/block<k>") */ String text<k> = "@GetMapping(\\"/text<k>\\")";',
    '  @RestController @RequestMapping("/inner<k>") static class Inner<k> { @Secured("X") @DeleteMapping("") Dto drop<k>(@RequestHeader(value = "X-T", defaultValue = "a,b") String t, int n) { return null; } }',
    "  void helper<k>() { }",
]


def varied_controllers(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").select("p_brand", "p_partkey")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1)
    statement = _case(F.col("p_partkey"), CONTROLLER, k=F.col("p_partkey"))
    head = F.concat(F.lit('package w;\n@RestController\n@Validated\n@RequestMapping({"/one'), brand, F.lit('", "/two'), brand, F.lit('"})\npublic class C'), brand, F.lit(" {\n"))
    return _assembled(p, "p_brand", "p_partkey", F.concat(F.lit("bff/src/main/java/w/C"), brand, F.lit(".java")), head, statement, "\n}\n")


def syntax_endpoints(spark, sf):
    """All paths with all methods of each mapping, by the syntax of nested classes; lines and columns count from 1."""
    e = syntax.endpoints(varied_controllers(spark, sf))
    shown = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["source"], p["name"], p["type"], p["default"])), ";")
    return e.select(
        "path", "class_name", "handler", "http_method", "endpoint", "response_type", shown.alias("parameters"), F.array_join("validations", ",").alias("validations"), F.array_join("security", ",").alias("security"),
        *[F.col(c).cast("bigint").alias(c) for c in ("start_line", "start_column", "end_line", "end_column")], "confidence", "parser",
    )


def syntax_divergence(spark, sf):
    return syntax.divergence(varied_controllers(spark, sf))


QUERIES = {f.__name__: f for f in (repeated_api_calls, nested_method_calls, chained_outbound_calls, owned_interactions, exported_components, classified_files, indexed_files, scanned_paths, syntax_endpoints, syntax_divergence)}


def _cases(values: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({k}, {v})" for k, v in enumerate(values)) + ")"


_ORDERS = "o AS (SELECT o_custkey AS c, o_orderkey AS k, lower(o_orderstatus) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line FROM orders)"
#: By part modulo 6: lines of a controller's member, and what it yields.
_SPAN = "p AS (SELECT regexp_extract(p_brand, '(\\d+)', 1) AS b, p_partkey AS k, p_partkey % 6 AS m, sum(CASE p_partkey % 6 WHEN 1 THEN 3 WHEN 3 THEN 2 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - CASE p_partkey % 6 WHEN 1 THEN 3 WHEN 3 THEN 2 ELSE 1 END + 6 AS line FROM part)"
ORACLE_SQL = {
    "repeated_api_calls": f"""WITH {_ORDERS}, h AS (SELECT *, CASE k % 8 WHEN 0 THEN 'plain' || k WHEN 2 THEN 'arrow' || k WHEN 3 THEN 'load' || k WHEN 5 THEN 'named' || k END AS head FROM o),
        f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING) AS fn, bool_or(k % 8 = 2) OVER (PARTITION BY c) AS with_fetch FROM h)
        SELECT 'ui/src/calls/file' || c || '.ts' AS path, fn AS "function", v.m AS http_method, replace(replace(v.t, '<k>', CAST(k AS VARCHAR)), '<s>', s) AS target, replace(v.p, '<k>', CAST(k AS VARCHAR)) AS parameters, v.conf AS confidence
        FROM f JOIN (VALUES (0, 'GET', '/same', '', 'high'), (1, 'GET', '/same', '', 'high'), (2, 'POST', '/o/<k>', 'JSON,b,header:X-Id', 'high'), (6, 'GET', '/not-http', '', 'high'), (3, 'DELETE', '/o/{{id}}/<s>', 'id', 'high'),
          (4, 'PUT', '/p/<k>', 'body', 'medium'), (5, 'POST', '/j/{{code}}', 'code,filter', 'medium'), (7, 'PATCH', '/q/<k>', 'q<k>', 'medium')) v(n, m, t, p, conf) ON v.n = k % 8
        WHERE v.n <> 6 OR with_fetch""",
    "nested_method_calls": f"""WITH {_ORDERS}, v AS (SELECT * FROM (VALUES (0, 'pub', 'repo', 'Repo', 'load', 'high'), (0, 'pub', 'repo', 'Repo', 'load', 'high'), (2, 'quoted', 'repo', 'Repo', 'quoted', 'high'),
          (3, 'in', 'audit', 'Audit', 'write', 'high'), (3, 'in', 'repo', 'Repo', 'outer', 'high'), (4, 'generic', 'm', 'Map', 'isEmpty', 'high'), (4, 'generic', 'Helper', 'Helper', 'none', 'high'), (4, 'generic', 'm', 'Map', 'values', 'high')) v(n, m, r, t, x, conf))
        SELECT 'be/src/main/java/p/K' || c || '.java' AS path, 'K' || c AS class_name, v.m || k AS method, v.r AS receiver, v.t AS receiver_type, CASE WHEN v.x = 'isEmpty' THEN v.x ELSE v.x || k END AS target, v.conf AS confidence FROM o JOIN v ON v.n = k % 6""",
    "chained_outbound_calls": f"""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, 3 + sum(CASE WHEN o_orderkey % 7 = 3 THEN 4 ELSE 1 END) OVER w - CASE WHEN o_orderkey % 7 = 3 THEN 4 ELSE 1 END + 1 AS line,
            last_value(CASE WHEN o_orderkey % 7 = 0 THEN '/v/' || o_orderkey END IGNORE NULLS) OVER w AS url FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
        SELECT 'bff/src/main/java/c/Client' || c || '.java' AS path, 'Client' || c AS client, CAST(line AS BIGINT) AS line, v.f || k AS method, v.m AS http_method, coalesce(replace(v.t, '<k>', CAST(k AS VARCHAR)), url) AS target_path,
          v.h AS headers, replace(v.b, '<k>', CAST(k AS VARCHAR)) AS body, v.conf AS confidence
        FROM o JOIN (VALUES (1, 'b', 'POST', NULL, 'X-Key,Content-Type', 'toBody(x, <k>)', 'high'), (2, 'c', 'PATCH', '/w/<k>/z', 'X-Set,Authorization', 'dto', 'high'), (3, 'd', 'GET', '/d/<k>?x=1', 'Accept', NULL, 'high'),
          (4, 'e', 'DELETE', '/e/<k>', '', NULL, 'medium'), (5, 'f', 'PUT', '/n/<k>', '', NULL, 'high')) v(n, f, m, t, h, b, conf) ON v.n = k % 7
        WHERE v.n <> 1 OR url IS NOT NULL""",
    "owned_interactions": f"""WITH {_ORDERS}, n AS (SELECT *, CASE WHEN c % 3 = 0 THEN 'Orders' || c || 'Page' ELSE 'Orders' || c END AS name FROM o)
        SELECT 'ui/src/' || CASE WHEN c % 3 = 0 THEN 'pages' ELSE 'components' END || '/' || name || '.tsx' AS path, v.e AS element, v.ev AS event, replace(v.h, '<k>', CAST(k AS VARCHAR)) AS handler, v.l AS label,
          CASE WHEN c % 3 = 0 THEN name ELSE 'Helper' END AS component, CASE WHEN c % 3 = 0 THEN name END AS page
        FROM n JOIN (VALUES (0, 'button', 'onClick', '() => load(<k>)', 'Load now'), (2, 'a', 'onChange', 'pick<k>', 'two words'), (3, 'form', 'onSubmit', 'save<k>', 'form submit'),
          (4, 'Fancy.Button', 'onClick', '() => {{ a(); b<k>(); }}', 'Not visible'), (5, 'div', 'onClick', 'outer<k>', 'in')) v(n, e, ev, h, l) ON v.n = k % 7""",
    "exported_components": f"""WITH {_ORDERS}, f AS (SELECT c, 'ui/src/' || CASE WHEN c % 5 = 0 THEN 'views/' ELSE 'parts/' END || CASE WHEN c % 2 = 0 THEN 'Main' ELSE 'main' END || c || '.tsx' AS path,
            list_distinct(flatten([CASE WHEN c % 3 = 0 THEN ['Main'] ELSE [] END, CASE WHEN bool_or(k % 6 IN (0, 3)) THEN ['Box'] ELSE [] END, CASE WHEN bool_or(k % 6 = 1) THEN ['Row'] ELSE [] END, CASE WHEN bool_or(k % 6 = 3) THEN ['Props'] ELSE [] END, CASE WHEN bool_or(k % 6 = 5) THEN ['Cell'] ELSE [] END])) AS children FROM o GROUP BY c),
        n AS (SELECT c, v.n || k AS component, v.e AS export FROM o JOIN (VALUES (0, 'Plain', 'named'), (1, 'Quiet', 'unknown'), (3, 'Arrow', 'named'), (5, 'Late', 'named')) v(m, n, e) ON v.m = k % 6
          UNION ALL SELECT DISTINCT c, 'Inner', 'unknown' FROM o WHERE k % 6 = 5 UNION ALL SELECT DISTINCT c, 'Main' || c, 'default' FROM o WHERE c % 6 = 0)
        SELECT path, component, CASE WHEN c % 5 = 0 AND (component = 'Main' || c OR count(*) OVER (PARTITION BY c) = 1) THEN 'page' ELSE 'component' END AS classification, CASE WHEN c % 3 = 0 THEN 'default' ELSE export END AS export,
          array_to_string(list_sort(children), ',') AS children, 'react,../box' AS imports, 'medium' AS confidence FROM n JOIN f USING (c)""",
    "classified_files": f"""SELECT CAST(v.i AS BIGINT) AS rule, replace(v.p, '<k>', CAST(s_suppkey AS VARCHAR)) AS path, v.kind FROM supplier,
        (VALUES {", ".join(f"({i}, '{p}', '{kind}')" for i, ((p, _), kind) in enumerate(zip(KINDS, KIND_NAMES, strict=True)))}) v(i, p, kind)""",
    "indexed_files": f"""SELECT CAST(v.i AS BIGINT) AS rule, replace(v.p, '<k>', CAST(s_suppkey AS VARCHAR)) AS path, CAST(strlen(replace(v.c, '<k>', CAST(s_suppkey AS VARCHAR))) AS BIGINT) AS size, v.kind AS classification FROM supplier,
        (VALUES {", ".join("({}, '{}', '{}', {})".format(i, p, c.replace("'", "''"), f"'{kind}'" if kind else "NULL") for i, ((p, c), kind) in enumerate(zip([*KINDS, ("README<k>.md", "é<k>")], [*KIND_NAMES, None], strict=True)))}) v(i, p, c, kind)""",
    "scanned_paths": f"""SELECT s_suppkey, CAST(v.i AS BIGINT) AS rule, replace(v.p, '<k>', CAST(s_suppkey AS VARCHAR)) AS path FROM supplier,
        (VALUES {", ".join(f"({i}, '{p}')" for i, (p, read) in enumerate(SCANNED) if not read)}) v(i, p)""",
    "syntax_endpoints": f"""WITH {_SPAN}, v AS (SELECT * FROM (VALUES
          (0, 'C', 'read', 'GET', '/a<k>', true, 'List<Map<String, Dto>>', 'path:id:Long', 'Validated,NotNull', '', 0, 3, 0, 'read'), (0, 'C', 'read', 'GET', '/b<k>', true, 'List<Map<String, Dto>>', 'path:id:Long', 'Validated,NotNull', '', 0, 3, 0, 'read'),
          (1, 'C', 'write', 'PUT', '/m<k>', true, 'void', 'body:body:Body;query:q:String', 'Validated,Valid', 'PreAuthorize', 0, 3, 2, 'write'), (1, 'C', 'write', 'PATCH', '/m<k>', true, 'void', 'body:body:Body;query:q:String', 'Validated,Valid', 'PreAuthorize', 0, 3, 2, 'write'),
          (4, 'Inner', 'drop', 'DELETE', '', false, 'Dto', 'header:X-T:String:a,b;request:n:int', '', 'Secured', 0, 0, 0, 'drop')) v(n, cls, h, m, t, outside, r, ps, val, sec, a, c1, z, kind)),
        e AS (SELECT p.*, v.*, CASE m WHEN 0 THEN '  @GetMapping({{"/a' || k || '", "/b' || k || '"}}) public List<Map<String, Dto>> read' || k || '(@PathVariable("id") @NotNull Long id) {{ return x; }}'
            WHEN 1 THEN '  public void write' || k || '(@RequestBody @Valid Body body, @RequestParam(name = "q", required = false) String q) {{ String s = "}}"; }}'
            ELSE '  @RestController @RequestMapping("/inner' || k || '") static class Inner' || k || ' {{ @Secured("X") @DeleteMapping("") Dto drop' || k || '(@RequestHeader(value = "X-T", defaultValue = "a,b") String t, int n) {{ return null; }}' END AS last_line FROM p JOIN (SELECT n, cls, h, m AS verb, t, outside, r, ps, val, sec, z FROM v) v ON v.n = p.m)
        SELECT 'bff/src/main/java/w/C' || b || '.java' AS path, CASE WHEN outside THEN 'C' || b ELSE 'C' || b || '.Inner' || k END AS class_name, h || k AS handler, verb AS http_method,
          CASE WHEN outside THEN base || replace(t, '<k>', CAST(k AS VARCHAR)) ELSE '/inner' || k END AS endpoint, r AS response_type, ps AS parameters, val AS validations, sec AS security,
          CAST(line AS BIGINT) AS start_line, CAST(CASE WHEN outside THEN 3 ELSE instr(last_line, '@Secured') END AS BIGINT) AS start_column, CAST(line + z AS BIGINT) AS end_line, CAST(length(last_line) + 1 AS BIGINT) AS end_column, 'high' AS confidence, 'syntax' AS parser
        FROM e JOIN LATERAL (SELECT unnest(CASE WHEN outside THEN ['/one' || b, '/two' || b] ELSE ['x'] END) AS base) x ON true""",
    "syntax_divergence": """WITH n AS (SELECT regexp_extract(p_brand, '(\\d+)', 1) AS b, count(*) FILTER (WHERE p_partkey % 6 = 0) AS n0, count(*) FILTER (WHERE p_partkey % 6 = 1) AS n1, count(*) FILTER (WHERE p_partkey % 6 = 2) AS n2,
          count(*) FILTER (WHERE p_partkey % 6 = 3) AS n3, count(*) FILTER (WHERE p_partkey % 6 = 4) AS n4 FROM part GROUP BY 1)
        SELECT 'bff/src/main/java/w/C' || b || '.java' AS path, 3 * n0 + 3 * n1 + n4 AS syntax_only, n2 + n3 + CAST(n4 > 0 AS BIGINT) AS pattern_only FROM n WHERE n0 + n1 + n2 + n3 + n4 > 0""",
}
