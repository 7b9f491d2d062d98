"""Extractors over a source tree with a dozen files for each supplier, so that SQL knows every record they have to find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import extract, graph, select
from cairn.plans.durable import materialize, spread
from cairn.queries import table
from cairn.sources import files as source

JAVA = {
    "web/C@Controller": """package shop.web;
import shop.svc.C@Service;
import java.util.List;
@RestController
@RequestMapping(%BASE%)
public class C@Controller {
  private final C@Service service;
  @GetMapping({"/{id}", "/by/{id}"})
  %PUBLIC% C@Dto one(@PathVariable("id") Long id, @RequestParam(name = "full", required = false) boolean full, HttpServletRequest request) { return service.find(id); }
  @PostMapping(consumes = "application/json")
  @PreAuthorize("hasRole('A') and (true)")
  public List<C@Dto> add(@RequestBody C@Request body, @RequestHeader(value = "X-Tenant", defaultValue = "a,b") String tenant, int n) { service.check(body); return service.add(body); }
  @RequestMapping(value = "/x", method = {RequestMethod.PUT, RequestMethod.PATCH})
  public void put() { }
}
""",
    "svc/C@Service": """package shop.svc;
@Service
public class C@Service extends Base implements Finder, Adder {
  private final C@Repository repository;
  @Autowired private Audit audit;
  public C@Dto find(Long id) { if (id == null) { throw new MissingException(); } return repository.findById(id); }
  private void check(C@Request r) { String s = "}"; audit.note(r); }
}
""",
    "data/C@Repository": """package shop.data;
public interface C@Repository extends JpaRepository<C@, Long> {
  @Query("select c from C@ c") List<C@> everything();
  List<C@> findByCode(String code);
}
""",
    "data/C@": """package shop.data;
@Entity
@Table(uniqueConstraints = @UniqueConstraint(name = "uk"), name = "t@")
public class C@ { @Id @GeneratedValue protected Long id; private String code = "x"; @ManyToOne(fetch = LAZY) private Owner owner; }
""",
    "dto/C@Dto": """package shop.dto;
public class C@Dto { @NotNull private Long id; @Size(max = 3, message = "a,b") @NotBlank private Map<String, List<Long>> parts; static int N = 1; public Long getId() { return id; } }
""",
    "dto/C@Request": """package shop.dto;
public record C@Request(@Valid @NotNull(groups = {A.class, B.class}) C@Dto body, List<Map<String, Long>> rest) { }
""",
    "client/C@Client": "%CLIENT%",
    "web/C@Advice": """package shop.web;
@RestControllerAdvice
public class C@Advice { @ExceptionHandler(MissingException.class) public void on() { throw new OtherException(); } }
""",
}
FEIGN = '@FeignClient(name = "c")\npublic interface C@Client { @GetMapping("/be/c@/{id}") C@Dto get(Long id); }\n'
FLUENT = """public class C@Client {
  private final RestClient rest; private final WebClient web;
  C@Dto a() { return rest.get().uri("/be/c@/a").retrieve(); }
  C@Dto b() { String where = "/be/c@/b"; return rest.post().headers(h -> h.add("x")).uri(where).retrieve(); }
  C@Dto c() { return web.put().uri(u -> u.path("/be/c@").pathSegment("x", "y").build()).retrieve(); }
}
"""
TEMPLATE = """public class C@Client { void a() { restTemplate.getForObject("/be/c@/{id}", X.class); restTemplate.exchange("/be/c@", HttpMethod.DELETE, null, X.class); } }
"""
TEST = "class C@Test {\n  @Test void finds() { }\n  @Test\n  void adds() { } // junit mockito\n}\n"
UI = {
    "pages/P@Page.tsx": """import { loadC@ } from '../api/c@Api';
import F@ from '../components/F@';
export default function P@Page() {
  const [order, setOrder] = useState(null);
  const [form, dispatch] = useReducer(reducer, initial);
  return <form onSubmit={save}><input name="code@"/><F@/><p>Orders that are still open stand here until they are shipped, those that were shipped before today stand on the next page of this list.</p><button onClick={() => loadC@(1)}>Load {order}</button></form>;
}
const initial = { code: '', total: 0 };
""",
    "components/F@.tsx": """import React from 'react';
export const F@ = () => {
  return <div><input aria-label="label@"/><select value={form.kind} onChange={pick}/><input {...register('reg@')}/></div>;
};
""",
    "config/paths@.ts": "export const ROOT@ = import.meta.env.ROOT ?? '/api';\nexport const PATHS@ = { list: '/c@', deep: `/deep/c@` };\n",
    "api/c@Api.ts": """import { ROOT@ as BASE, PATHS@ } from '../config/paths@';
const own = '/own@';
export const loadC@ = (id) => apiClient.get(`${BASE}${PATHS@.list}/${id}`, { params: query, headers: { 'X-Trace-Id': trace } });
export function saveC@(body) { return fetch(own + '/save', { method: 'POST', body: payload }); }
export const dropC@ = (id) => request('DELETE', `/c@/${order.id}`);
export const findC@ = () => httpRequest({ method: 'PUT', url: PATHS@.deep });
""",
    "App@Routes.tsx": """export const App@ = () => <Routes><Route path="/p@" element={<Guard><P@Page/></Guard>} /></Routes>;
const more = [{ path: '/q@', element: <F@/> }];
""",
}


def tree(spark, sf) -> DataFrame:
    """(k, path, content): the files of each supplier."""
    k = F.col("s_suppkey")
    fill = lambda c: F.replace(F.replace(F.replace(c, F.lit("%BASE%"), F.when(k % 2 == 0, F.lit('"/api/c@"')).otherwise(F.lit('{"/api/c@", "/v2/c@"}'))), F.lit("%PUBLIC%"), F.when(k % 3 == 0, "").otherwise("public")), F.lit("%CLIENT%"), F.when(k % 3 == 0, F.lit(FEIGN)).when(k % 3 == 1, F.lit(FLUENT)).otherwise(F.lit(TEMPLATE)))
    files = [(f"bff/src/main/java/shop/{name}.java", text) for name, text in JAVA.items()]
    files += [("bff/src/test/java/shop/C@Test.java", TEST), ("bff/src/main/resources/application-@.properties", "server.port=1@\ndb.password=x\nlist.url = http://h\n")]
    files += [(f"ui/src/{name}", text) for name, text in UI.items()]
    structs = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("content")) for p, t in files])
    rows = spread(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select(k.alias("k"), "s_suppkey", F.explode(structs).alias("f")).select("s_suppkey", "f.path", fill(F.col("f.content")).alias("content"))
    # an @ behind a letter or digit stands for the key; annotations stand behind spaces and brackets
    key = lambda c: F.regexp_replace(c, r"(?<=[A-Za-z0-9_-])@", k.cast("string"))
    # written once: every pattern of every extractor would make the content anew
    return materialize(rows.select(k.alias("k"), key(F.col("path")).alias("path"), key(F.col("content")).alias("content")), "tree")


def _files(spark, sf) -> DataFrame:
    return tree(spark, sf).select("path", "content")


def joined(c):
    return F.array_join(c, ",")


def source_kinds_of_files(spark, sf):
    f = _files(spark, sf)
    kind = F.when(F.col("path").endswith(".java"), extract.java_class(F.col("path"), F.col("content"))).otherwise(extract.script_class(F.col("path"), F.col("content")))
    layout = T.source_layout("path")
    return f.select("path", source.file_kind(F.col("path")).alias("file_kind"), kind.alias("kind"), layout["module_path"].alias("module"), layout["source_set"].alias("source_set"))


def java_components(spark, sf):
    c = extract.components(_files(spark, sf))
    return c.select("class_name", "package_name", "type", joined("annotations").alias("annotations"), "base_path", joined("constructor_dependencies").alias("constructor"), joined("field_dependencies").alias("fields"), joined("implemented").alias("implemented"), "extended")


def java_endpoints(spark, sf):
    return extract.endpoints(_files(spark, sf)).select("class_name", "http_method", "path", "handler", "response_type")


def java_all_endpoints(spark, sf):
    return extract.all_endpoints(_files(spark, sf)).select("class_name", "http_method", "path", "handler")


def endpoint_divergence(spark, sf):
    return extract.endpoint_divergence(_files(spark, sf))


def endpoint_parameters(spark, sf):
    return extract.parameters(extract.endpoints(_files(spark, sf))).select("file", "handler", F.col("ord").cast("bigint").alias("ord"), "source", "name", "type", "required", "default")


def java_entities(spark, sf):
    return extract.entities(_files(spark, sf)).select("entity", "table_name", "id_field", joined("fields").alias("fields"), joined("relations").alias("relations"), joined("targets").alias("targets"))


def java_imports(spark, sf):
    return extract.imports(_files(spark, sf)).select("from", "to")


def config_keys(spark, sf):
    return extract.config_keys(_files(spark, sf)).select("path", "key")


def java_tests(spark, sf):
    return extract.tests(_files(spark, sf)).select("class_name", joined("frameworks").alias("frameworks"), joined("test_methods").alias("methods"))


def java_method_calls(spark, sf):
    return extract.method_calls(_files(spark, sf)).select("class_name", "method", "receiver", "receiver_type", "target", "confidence")


def repository_methods(spark, sf):
    return extract.repository_methods(_files(spark, sf)).select("repository", "entity", "method", "query", "confidence")


def field_validations(spark, sf):
    return extract.validations(_files(spark, sf)).select("class_name", "field", "annotation")


def exception_flow(spark, sf):
    return extract.exceptions(_files(spark, sf)).select("class_name", "type", "detail")


def java_dtos(spark, sf):
    return extract.dtos(_files(spark, sf)).select("class_name", F.col("ord").cast("bigint").alias("ord"), "field", "type", joined("validations").alias("validations"))


def outbound_calls(spark, sf):
    return extract.outbound_calls(_files(spark, sf)).select("client", "http_method", "target_path", "confidence")


def enclosing_methods(spark, sf):
    """The method around each call of a service, by its offset."""
    f = _files(spark, sf)
    ranges = extract.method_ranges(f)
    mentions = f.where("path like '%Service.java'").select("path", "content", F.explode(F.array(F.lit("repository.findById"), F.lit("audit.note"))).alias("mention"))
    points = mentions.select("path", "mention", (F.instr("content", F.col("mention")) - 1).alias("at"))
    return select.innermost(points, ranges, ["path"], "at", "start", "stop").select("path", "mention", "method", F.col("start_line").cast("bigint").alias("start_line"))


def ui_routes(spark, sf):
    return extract.routes(_files(spark, sf)).select("path", "route", "component", "confidence")


def ui_components(spark, sf):
    f = _files(spark, sf)
    return extract.ui_components(f, extract.routes(f)).select("component", "route", "classification", joined("children").alias("children"), joined("imports").alias("imports"), "export", "confidence")


def ui_interactions(spark, sf):
    f = _files(spark, sf)
    return extract.interactions(f, extract.ui_components(f, extract.routes(f))).select("path", "element", "event", "handler", "label", "component", "page")


def ui_constants(spark, sf):
    return extract.shared_constants(_files(spark, sf))


def ui_api_calls(spark, sf):
    return extract.api_calls(_files(spark, sf)).select("path", "function", "http_method", "target", joined("parameters").alias("parameters"), "confidence")


def _components(spark, sf):
    f = _files(spark, sf)
    return f, extract.ui_components(f, extract.routes(f)).select("path", "component", "classification", "children")


def _owned(spark, sf):
    f, found = _components(spark, sf)
    found = materialize(found, "ui-components")  # read several times
    pages = found.where("classification = 'page' and path like '%/pages/%'")
    edges = found.select(F.col("component").alias("a"), F.explode("children").alias("b"))
    reach = graph.reachable(pages.select(F.col("component").alias("source"), F.col("component").alias("node")), edges)
    return f, found, graph.unique_owner(reach)


def ui_api_consumers(spark, sf):
    f, found, owners = _owned(spark, sf)
    calls = extract.api_calls(f).where("function is not null")
    return extract.api_consumers(f, calls, owners, found).select("function", joined("consumers").alias("consumers"))


def ui_form_fields(spark, sf):
    f, found, owners = _owned(spark, sf)
    return extract.form_fields(f.where("path like '%/pages/%' or path like '%/components/%'"), found.where("path not like '%Routes.tsx'"), owners).select("path", "field", "source", "page")


def ui_state(spark, sf):
    return extract.state_hooks(_files(spark, sf)).select("path", "state", "setter", "initial")


def file_owners(spark, sf):
    _, found = _components(spark, sf)
    ordered = found.withColumn("rank", F.when(F.col("classification") == "page", 0).otherwise(1))
    return select.first_wins(ordered.select("path", "component", F.struct("rank", "component").alias("o")), ["path"], "o").select("path", "component")


def framework_indicators(spark, sf):
    """What tells the framework and the build tool of a repository for each supplier, whose files go by its key."""
    k = F.col("s_suppkey")
    rules = [
        (k % 2 == 1, "ui/package.json", '{"dependencies": {"react": "19"}}'), (k % 2 == 0, "ui/package.json", '{"dependencies": {"vue": "3"}}'), (k % 3 == 0, "ui/Vite.config.ts", ""), (k % 5 == 0, "next.config.js", ""),
        (k % 7 == 0, "ui/src/main.tsx", ""), (k % 7 == 1, "ui/src/maintain.tsx", ""), (k % 4 == 0, "be/pom.xml", ""), (k % 6 == 0, "be/build.gradle.kts", ""), (k % 11 == 0, "be/pom.xml.bak", ""),
    ]
    files = F.filter(F.array(*[F.when(test, F.struct(F.lit(p).alias("path"), F.lit(c).alias("content"))) for test, p, c in rules]), lambda x: x.isNotNull())
    f = table(spark, sf, "supplier").select("s_suppkey", F.explode(files).alias("f")).select("s_suppkey", "f.*")
    return f.groupBy("s_suppkey").agg(F.array_join(source.ui_indicators(), ";").alias("indicators"), source.build_tool().alias("tool"))


def matching_files(spark, sf):
    return source.files_matching(_files(spark, sf), [r"Controller\.java$", r"/pages/.*\.tsx$"]).select("path")


def evidence_snippets(spark, sf):
    f = tree(spark, sf)
    wanted = f.where("path like '%Service.java'").select("path", F.lit("Service").alias("group"), F.lit("check").alias("symbol"))
    wanted = wanted.unionByName(f.where("path like '%Api.ts'").select("path", F.lit("Client").alias("group"), F.concat(F.lit("saveC"), F.col("k").cast("string")).alias("symbol")))
    wanted = wanted.unionByName(f.where("path like '%Routes.tsx'").select("path", F.lit("Route").alias("group"), F.concat(F.lit("/q"), F.col("k").cast("string")).alias("symbol")))
    wanted = wanted.unionByName(f.where("path like '%Dto.java'").select("path", F.lit("Dto").alias("group"), F.lit("absent").alias("symbol")))
    wanted = wanted.unionByName(f.where("path like '%Dto.java'").select(F.concat("path", F.lit("x")).alias("path"), F.lit("Lost").alias("group"), F.lit("absent").alias("symbol")))
    return extract.snippets(f.select("path", "content"), wanted, most=40, before=5, after=10).select("path", "group", "symbol", "code", "confidence", "uncertainty")


QUERIES = {
    f.__name__: f
    for f in (
        source_kinds_of_files, java_components, java_endpoints, java_all_endpoints, endpoint_divergence, endpoint_parameters, java_entities, java_imports,
        config_keys, java_tests, java_method_calls, repository_methods, field_validations, exception_flow, java_dtos, outbound_calls, enclosing_methods,
        ui_routes, ui_components, ui_interactions, ui_constants, ui_api_calls, ui_api_consumers, ui_form_fields, ui_state, file_owners,
        framework_indicators, matching_files, evidence_snippets,
    )
}

_K = "WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_suppkey AS n FROM supplier)"
_W, _P = "'bff/src/main/java/shop/' ||", "'ui/src/' ||"


def _rows(*rows: str) -> str:
    return f"{_K} " + " UNION ALL ".join(f"SELECT {r} FROM s" if " WHERE " not in r else f"SELECT {r.split(' WHERE ')[0]} FROM s WHERE {r.split(' WHERE ')[1]}" for r in rows)


_M = "'bff' AS module, 'main' AS source_set"
ORACLE_SQL = {
    "source_kinds_of_files": _rows(
        f"{_W} 'web/C' || k || 'Controller.java' AS path, 'java' AS file_kind, 'controller' AS kind, {_M}",
        *[f"{_W} '{folder}/C' || k || '{name}.java', 'java', '{kind}', 'bff', 'main'" for folder, name, kind in (("svc", "Service", "service"), ("data", "Repository", "repository"), ("data", "", "entity"), ("dto", "Dto", "dto"), ("dto", "Request", "dto"), ("client", "Client", "client"), ("web", "Advice", "unknown"))],
        "'bff/src/test/java/shop/C' || k || 'Test.java', 'java', 'test', 'bff', 'test'", "'bff/src/main/resources/application-' || k || '.properties', 'config', 'unknown', 'bff', 'main'",
        *[f"{_P} {path}, 'script', '{kind}', NULL, NULL" for path, kind in (("'pages/P' || k || 'Page.tsx'", "page"), ("'components/F' || k || '.tsx'", "component"), ("'config/paths' || k || '.ts'", "unknown"), ("'api/c' || k || 'Api.ts'", "api-client"), ("'App' || k || 'Routes.tsx'", "route"))],
    ),
    "java_components": _rows(
        """'C' || k || 'Controller' AS class_name, 'shop.web' AS package_name, 'controller' AS type, 'RestController,RequestMapping' AS annotations, '/api/c' || k AS base_path,
           'C' || k || 'Service' AS constructor, '' AS fields, '' AS implemented, NULL AS extended""",
        "'C' || k || 'Service', 'shop.svc', 'service', 'Service', NULL, 'C' || k || 'Repository', 'Audit', 'Finder,Adder', 'Base'",
        "'C' || k || 'Repository', 'shop.data', 'repository', '', NULL, '', '', '', 'JpaRepository<C' || k", "'C' || k, 'shop.data', 'entity', 'Entity,Table,UniqueConstraint', NULL, '', '', '', NULL",
        "'C' || k || 'Dto', 'shop.dto', 'dto', '', NULL, '', '', '', NULL", "'C' || k || 'Request', 'shop.dto', 'dto', '', NULL, '', '', '', NULL", "'C' || k || 'Advice', 'shop.web', 'exception', 'RestControllerAdvice', NULL, '', '', '', NULL",
        "'C' || k || 'Client', '', 'client', CASE WHEN n % 3 = 0 THEN 'FeignClient' ELSE '' END, NULL, CASE WHEN n % 3 = 1 THEN 'RestClient,WebClient' ELSE '' END, '', '', NULL", "'C' || k || 'Test', '', 'test', '', NULL, '', '', '', NULL",
    ),
    "java_endpoints": _rows(
        "'C' || k || 'Controller' AS class_name, 'GET' AS http_method, '/api/c' || k || '/{id}' AS path, 'one' AS handler, 'C' || k || 'Dto' AS response_type",
        "'C' || k || 'Controller', 'POST', '/api/c' || k, 'add', 'List<C' || k || 'Dto>'",
        "'C' || k || 'Controller', 'PUT', '/api/c' || k || '/x', 'put', 'void'",
    ),
    "java_all_endpoints": f"""{_K}, b AS (SELECT k, '/api/c' || k AS b FROM s UNION ALL SELECT k, '/v2/c' || k FROM s WHERE n % 2 = 1)
        SELECT 'C' || k || 'Controller' AS class_name, m AS http_method, b || p AS path, h AS handler FROM b,
          (VALUES ('GET', '/{{id}}', 'one'), ('GET', '/by/{{id}}', 'one'), ('POST', '', 'add'), ('PUT', '/x', 'put'), ('PATCH', '/x', 'put')) v(m, p, h)""",
    "endpoint_divergence": "SELECT 'both' AS kind, 3 * count(*) AS n FROM supplier UNION ALL SELECT 'first-only', CAST(0 AS BIGINT) UNION ALL SELECT 'all-only', CAST(sum(CASE WHEN s_suppkey % 2 = 1 THEN 7 ELSE 2 END) AS BIGINT) FROM supplier",
    "endpoint_parameters": f"""{_K} SELECT {_W} 'web/C' || k || 'Controller.java' AS file, h AS handler, CAST(o AS BIGINT) AS ord, src AS source, nm AS name, replace(ty, '@', k) AS type, req AS required, df AS "default" FROM s,
        (VALUES ('one', 0, 'path', 'id', 'Long', true, NULL), ('one', 1, 'query', 'full', 'boolean', false, NULL), ('one', 2, 'request', 'request', 'HttpServletRequest', true, NULL),
                ('add', 0, 'body', 'body', 'C@Request', true, NULL), ('add', 1, 'header', 'X-Tenant', 'String', false, 'a,b'), ('add', 2, 'unknown', 'n', 'int', true, NULL)) v(h, o, src, nm, ty, req, df)""",
    "java_entities": _rows("'C' || k AS entity, 't' || k AS table_name, 'id' AS id_field, 'id,code,owner' AS fields, 'owner' AS relations, 'Owner' AS targets"),
    "java_imports": _rows("""'C' || k || 'Controller' AS "from", 'C' || k || 'Service' AS "to" """, "'C' || k || 'Controller', 'List'"),
    "config_keys": _rows(
        "'bff/src/main/resources/application-' || k || '.properties' AS path, 'server.port' AS key", "'bff/src/main/resources/application-' || k || '.properties', 'db.password=[MASKED_SECRET]'",
        "'bff/src/main/resources/application-' || k || '.properties', 'list.url'",
    ),
    "java_tests": _rows("'C' || k || 'Test' AS class_name, 'junit,mockito' AS frameworks, 'finds,adds' AS methods"),
    "java_method_calls": _rows(
        "'C' || k || 'Controller' AS class_name, 'one' AS method, 'service' AS receiver, 'C' || k || 'Service' AS receiver_type, 'find' AS target, 'high' AS confidence WHERE n % 3 <> 0",
        "'C' || k || 'Controller', 'add', 'service', 'C' || k || 'Service', 'check', 'high'", "'C' || k || 'Controller', 'add', 'service', 'C' || k || 'Service', 'add', 'high'",
        "'C' || k || 'Service', 'find', 'repository', 'C' || k || 'Repository', 'findById', 'high'", "'C' || k || 'Service', 'check', 'audit', 'Audit', 'note', 'high'",
    ),
    "repository_methods": _rows(
        "'C' || k || 'Repository' AS repository, 'C' || k AS entity, 'everything' AS method, 'select c from C' || k || ' c' AS query, 'high' AS confidence",
        "'C' || k || 'Repository', 'C' || k, 'findByCode', NULL, 'medium'",
    ),
    "field_validations": _rows("'C' || k || 'Dto' AS class_name, 'id' AS field, 'NotNull' AS annotation", "'C' || k || 'Dto', 'parts', 'Size'", "'C' || k || 'Dto', 'parts', 'NotBlank'", "'C' || k || 'Request', 'body', 'Valid'", "'C' || k || 'Request', 'body', 'NotNull'"),
    "exception_flow": _rows("'C' || k || 'Advice' AS class_name, 'advice' AS type, 'C' || k || 'Advice' AS detail", "'C' || k || 'Advice', 'handler', 'MissingException'", "'C' || k || 'Advice', 'throw', 'OtherException'", "'C' || k || 'Service', 'throw', 'MissingException'"),
    "java_dtos": _rows(
        "'C' || k || 'Dto' AS class_name, CAST(0 AS BIGINT) AS ord, 'id' AS field, 'Long' AS type, 'NotNull' AS validations", "'C' || k || 'Dto', 1, 'parts', 'Map<String, List<Long>>', 'Size,NotBlank'",
        "'C' || k || 'Request', 0, 'body', 'C' || k || 'Dto', 'Valid,NotNull'", "'C' || k || 'Request', 1, 'rest', 'List<Map<String, Long>>', ''",
    ),
    "outbound_calls": _rows(
        "'C' || k || 'Client' AS client, 'GET' AS http_method, '/be/c' || k || '/{id}' AS target_path, 'high' AS confidence WHERE n % 3 = 0",
        "'C' || k || 'Client', 'GET', '/be/c' || k || '/a', 'high' WHERE n % 3 = 1", "'C' || k || 'Client', 'POST', '/be/c' || k || '/b', 'high' WHERE n % 3 = 1", "'C' || k || 'Client', 'PUT', '/be/c' || k || '/x/y', 'high' WHERE n % 3 = 1",
        "'C' || k || 'Client', 'GET', '/be/c' || k || '/{id}', 'medium' WHERE n % 3 = 2", "'C' || k || 'Client', 'DELETE', '/be/c' || k, 'medium' WHERE n % 3 = 2",
    ),
    "enclosing_methods": _rows(
        f"{_W} 'svc/C' || k || 'Service.java' AS path, 'repository.findById' AS mention, 'find' AS method, CAST(6 AS BIGINT) AS start_line", f"{_W} 'svc/C' || k || 'Service.java', 'audit.note', 'check', CAST(7 AS BIGINT)",
    ),
    "ui_routes": _rows(
        f"{_P} 'App' || k || 'Routes.tsx' AS path, '/p' || k AS route, 'P' || k || 'Page' AS component, 'high' AS confidence", f"{_P} 'App' || k || 'Routes.tsx', '/q' || k, 'F' || k, 'medium'",
    ),
    "ui_components": _rows(
        "'P' || k || 'Page' AS component, '/p' || k AS route, 'page' AS classification, 'F' || k AS children, '../api/c' || k || 'Api,../components/F' || k AS imports, 'default' AS export, 'high' AS confidence",
        "'F' || k, '/q' || k, 'page', '', 'react', 'named', 'high'", "'App' || k, NULL, 'component', 'Routes,Route,Guard,P' || k || 'Page,F' || k, '', 'named', 'medium'",
    ),
    "ui_interactions": _rows(
        f"{_P} 'pages/P' || k || 'Page.tsx' AS path, 'form' AS element, 'onSubmit' AS event, 'save' AS handler, 'form submit' AS label, 'P' || k || 'Page' AS component, 'P' || k || 'Page' AS page",
        f"{_P} 'pages/P' || k || 'Page.tsx', 'button', 'onClick', '() => loadC' || k || '(1)', 'Load', 'P' || k || 'Page', 'P' || k || 'Page'",
    ),
    "ui_constants": _rows("'ROOT' || k AS name, 'import.meta.env.ROOT ?? ''/api''' AS value", "'PATHS' || k || '.list', '''/c' || k || ''''", "'PATHS' || k || '.deep', '`/deep/c' || k || '`'", "DISTINCT 'initial.code', ''''''"),
    "ui_api_calls": _rows(
        f"{_P} 'api/c' || k || 'Api.ts' AS path, 'loadC' || k AS \"function\", 'GET' AS http_method, '/api/c' || k || '/{{id}}' AS target, 'id,query,header:X-Trace-Id' AS parameters, 'high' AS confidence".replace("{{id}}", "{id}"),
        f"{_P} 'api/c' || k || 'Api.ts', 'saveC' || k, 'POST', '/own' || k || '/save', 'payload', 'high'",
        f"{_P} 'api/c' || k || 'Api.ts', 'dropC' || k, 'DELETE', '/c' || k || '/{{id}}', 'id', 'medium'".replace("{{id}}", "{id}"),
        f"{_P} 'api/c' || k || 'Api.ts', 'findC' || k, 'PUT', '/deep/c' || k, '', 'medium'",
    ),
    "ui_api_consumers": _rows("'loadC' || k AS \"function\", 'P' || k || 'Page' AS consumers"),
    "ui_form_fields": _rows(
        f"{_P} 'pages/P' || k || 'Page.tsx' AS path, 'code' || k AS field, 'name' AS source, 'P' || k || 'Page' AS page", f"{_P} 'components/F' || k || '.tsx', 'label' || k, 'aria-label', 'F' || k",
        f"{_P} 'components/F' || k || '.tsx', 'form.kind', 'controlled', 'F' || k", f"{_P} 'components/F' || k || '.tsx', 'reg' || k, 'register', 'F' || k",
    ),
    "ui_state": _rows(
        f"{_P} 'pages/P' || k || 'Page.tsx' AS path, 'order' AS state, 'setOrder' AS setter, 'null' AS initial", f"{_P} 'pages/P' || k || 'Page.tsx', 'form.code', 'dispatch', ''''''", f"{_P} 'pages/P' || k || 'Page.tsx', 'form.total', 'dispatch', '0'",
    ),
    "file_owners": _rows(f"{_P} 'pages/P' || k || 'Page.tsx' AS path, 'P' || k || 'Page' AS component", f"{_P} 'components/F' || k || '.tsx', 'F' || k", f"{_P} 'App' || k || 'Routes.tsx', 'App' || k"),
    "framework_indicators": """SELECT s_suppkey, concat_ws(';', CASE WHEN s_suppkey % 2 = 1 THEN 'react dependency' END, CASE WHEN s_suppkey % 3 = 0 THEN 'vite config' END, CASE WHEN s_suppkey % 5 = 0 THEN 'next config' END, CASE WHEN s_suppkey % 7 = 0 THEN 'entry file' END) AS indicators,
        CASE WHEN s_suppkey % 4 = 0 THEN 'Maven' WHEN s_suppkey % 6 = 0 THEN 'Gradle' ELSE 'Unknown' END AS tool FROM supplier""",
    "matching_files": _rows(f"{_W} 'web/C' || k || 'Controller.java' AS path", f"{_P} 'pages/P' || k || 'Page.tsx'"),
    "evidence_snippets": _rows(
        _W + """ 'svc/C' || k || 'Service.java' AS path, 'Service' AS "group", 'check' AS symbol, left('private void check(C' || k || 'Request r) { String s = "}"; audit.note(r); }', 40) || chr(10) || '[SNIPPET_TRUNCATED]' AS code, 'high' AS confidence, CAST(NULL AS VARCHAR) AS uncertainty""",
        _P + " 'api/c' || k || 'Api.ts', 'Client', 'saveC' || k, left('export function saveC' || k || '(body) { return fetch(own', 40) || chr(10) || '[SNIPPET_TRUNCATED]', 'high', NULL",
        f"{_P} 'App' || k || 'Routes.tsx', 'Route', '/q' || k, 'th: ''' || left('/q' || k || ''', element: <', 10), 'medium', NULL",
        f"{_W} 'dto/C' || k || 'Dto.java', 'Dto', 'absent', NULL, 'low', 'absent is not visible'", f"{_W} 'dto/C' || k || 'Dto.javax', 'Lost', 'absent', NULL, 'low', 'the file is missing'",
    ),
}
