"""Calls, functions and declarations by offsets and brackets."""

from __future__ import annotations

import pytest

from cairn.functions import calls
from cairn.functions.java import Source
from cairn.operators import extract, syntax


def names(text):
    return [n for _, n in calls.script_functions(text)]


def test_script_functions_in_all_their_forms():
    text = """function a(x) { }
export const b = async (y) => y;
const c: Loader = z => z;
const d = { e(x) { return 1; }, f: async (q) => 2, g: h => 3 };
  async i(x: number): Promise<void> { }
if (x) { } for (k of y) { } items.map((v) => v); const j = 5;
"""
    assert names(text) == ["a", "b", "c", "e", "f", "g", "i"]


def test_script_calls_and_their_arguments():
    text = """client.get<Out<A, B>>(`/a/${id}`, { params: filter });
fetch(url + '/b)', { "method": Method.PUT, body: JSON.stringify(dto) });
axios({ url: '/c', method: 'delete' }); axios('/d'); loadData('/no'); getJson('/e');
api.get; api.get (path); sendRequest("PATCH", "/f", { headers: { 'X-A': 1 } }); runExecute({ path: `/g` }); callApi()
"""
    got = [(r, m, e, o, c) for _, r, m, e, o, c in calls.script_calls(text)]
    assert got == [
        ("client", "GET", "`/a/${id}`", ["filter"], "high"),
        (None, "PUT", "url + '/b)'", ["JSON", "dto"], "high"),
        (None, "DELETE", "'/c'", [], "high"),
        (None, "GET", "'/e'", [], "medium"),
        ("api", "GET", "path", [], "high"),
        (None, "PATCH", '"/f"', ["header:X-A"], "medium"),
        (None, "GET", "`/g`", [], "medium"),
    ]
    assert [at for at, *_ in calls.script_calls("a.get('/x'); a.get('/x');")] == [0, 13]
    assert calls.script_calls("") == calls.script_calls("get(") == calls.script_calls("a.get('/x'") == []


def test_interactions_of_odd_tags():
    assert calls.interactions("<a onClick={}>x</a><b onClick={f}") == []
    assert [r[1:] for r in calls.interactions("<B onClick={() => { x(); }}>a<i>b</i></B>")] == [("B", "onClick", "() => { x(); }", "a b")]
    assert [r[1:3] for r in calls.interactions("<form onSubmit={s}>" + "x" * 121 + "</form><a onChange={c} onClick={d}>y</a>")] == [("form", "onSubmit"), ("a", "onClick")]


JAVA = """package p;
@interface Mark { int n() default 1; }
public sealed class A<T extends Comparable<T>> extends B<T> implements C, D permits E {
  static { int x = 1; }
  private final Map<String, List<T>> map = new HashMap<>() {{ put("}", null); }}, other;
  @Inject A(@Named("x") Repo<T> repo, final int... n) { super(); }
  public <R> R apply(Function<T, R> f) throws IOException { return new Object() { public void inner() { } }.x; }
  enum Kind { ONE("{") { void a() { } }, TWO; private int k; Kind() { } int k() { return k; } }
  record Pair<L, R>(@NotNull L left, R right) implements X { Pair { check(left); } static Pair<?, ?> of() { return null; } }
  interface Sub { void call(int a, String[] b); default int twice() { return 2; } }
  abstract int last();
}
"""


def test_java_declarations_with_their_nesting():
    source = Source(JAVA)
    got = [(d.kind, d.owner, d.name, d.type, [(p.name, p.type) for p in d.parameters], d.body is not None) for d in source.declarations]
    assert source.sound and got == [
        ("interface", "", "Mark", "", [], True),
        ("method", "Mark", "n", "int", [], False),
        ("class", "", "A", "", [], True),
        ("field", "A", "map", "Map<String, List<T>>", [], False),
        ("method", "A", "A", "", [("repo", "Repo<T>"), ("n", "int...")], True),
        ("method", "A", "apply", "R", [("f", "Function<T, R>")], True),
        ("enum", "A", "Kind", "", [], True),
        ("field", "A.Kind", "k", "int", [], False),
        ("method", "A.Kind", "Kind", "", [], True),
        ("method", "A.Kind", "k", "int", [], True),
        ("record", "A", "Pair", "", [("left", "L"), ("right", "R")], True),
        ("method", "A.Pair", "of", "Pair<?, ?>", [], True),
        ("interface", "A", "Sub", "", [], True),
        ("method", "A.Sub", "call", "void", [("a", "int"), ("b", "String[]")], False),
        ("method", "A.Sub", "twice", "int", [], True),
        ("method", "A", "last", "int", [], False),
    ]
    apply = next(d for d in source.declarations if d.name == "apply")
    assert source.place(apply.start) == (7, 3) and JAVA[apply.stop - 1] == "}" and "protected" not in apply.modifiers


@pytest.mark.parametrize("text", ["", "class", "class A", "class A {", "class A { void f( }", "}}}", "@", "@A(", "class A { int x = ; ( }", 'class A { String s = "', "enum E", "record R(", "class A { <T"])
def test_broken_java_is_read_as_far_as_it_goes(text):
    Source(text)


def test_broken_files_have_medium_confidence_and_patterns_step_in(spark):
    whole = '@RestController class A { @GetMapping("/a") public String a() { return ""; } }'
    rows = [("A.java", whole), ("B.java", whole.replace(" A ", " B ") + " }"), ("C.java", "@RestController\npublic class C\n{ { { @GetMapping(\"/c\") public String c() { return x; }"), ("D.txt", whole), ("E.java", None)]
    got = {(r["path"], r["endpoint"], r["confidence"], r["parser"]) for r in syntax.endpoints(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {("A.java", "/a", "high", "syntax"), ("B.java", "/a", "medium", "syntax"), ("C.java", "/c", "medium", "pattern")}


def test_calls_after_a_method_without_modifier_keep_their_owner(spark):
    text = "class A { private Repo repo; public void b() { repo.x(); } void c() { repo.z(); } public void d() { repo.x(); repo.x(); } }"
    got = extract.method_calls(spark.createDataFrame([("A.java", text), ("B.java", ""), ("C.java", None)], "path string, content string")).collect()
    assert [(r["method"], r["target"]) for r in sorted(got, key=lambda r: r["ord"])] == [("b", "x"), ("d", "x"), ("d", "x")]


def test_extractors_of_no_files(spark):
    none = spark.createDataFrame([], "path string, content string")
    for fn in (extract.api_calls, extract.method_calls, extract.outbound_calls, extract.interactions, syntax.endpoints, syntax.divergence, lambda f: extract.ui_components(f, extract.routes(f))):
        assert fn(none).collect() == []
