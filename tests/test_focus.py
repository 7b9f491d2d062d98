"""Canonical artifacts, table functions, windows and evidence, incremental scans."""

from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import tables
from cairn.functions.canonical import canonical, canonical_artifact, canonical_lines
from cairn.operators import extract, focus, syntax
from cairn.registered import varied
from cairn.sources import incremental
from tests.oracle import rows as counted

SF = "/root/testdata/sf0.001"

KEYS = st.sampled_from(["a", "metadata", "generatedAt", "x-InputHash", "pipelineVersion", "updated_at", "7", "b"])
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(KEYS, x, max_size=4), max_leaves=20)


def plain(value, inside):
    if isinstance(value, list):
        return [plain(v, inside) for v in value]
    if not isinstance(value, dict):
        return value
    keys = {"".join(c for c in k.lower() if c.isalnum()) for k in value}
    drop = inside or ("pipelineversion" in keys and ("generatedat" in keys or any(k.endswith("inputhash") for k in keys)))
    out = {}
    for k, v in value.items():
        name = "".join(c for c in k.lower() if c.isalnum())
        if not (drop and (name in ("generatedat", "updatedat") or name.endswith("inputhash"))):
            out[k] = plain(v, name.endswith("metadata"))
    return out


@given(VALUES)
def test_values_lose_volatile_keys_of_metadata_only(value):
    text = json.dumps(value)
    assert json.loads(canonical(text, "json", "x.json")) == plain(value, False)
    assert json.loads(canonical(text, "json", "a/page-flow.json")) == plain(value, True)
    once = canonical(text, "jsonl")
    assert canonical(once, "jsonl") == once and json.loads(once) == plain(value, False)


def test_numbers_and_order_as_doubles_are_written():
    assert canonical('{"b": 1e21, "1": 0.1, "0": -0.0, "a": 12345678901234567890, "01": 1e-7}', "jsonl") == '{"0":0,"1":0.1,"b":1e+21,"a":12345678901234567000,"01":1e-7}'


def test_artifacts_that_are_none(spark):
    rows = [("json", "{", None), ("json", None, None), ("jsonl", "", ""), ("markdown", "", ""), ("jsonl", None, None), ("json", "NaN", None)]
    df = spark.createDataFrame([(k, t, None) for k, t, _ in rows], "kind string, text string, source string")
    assert [r[0] for r in df.select(canonical_artifact("text", "kind", "source")).collect()] == [w for _, _, w in rows]
    assert canonical_lines("```\nUpdated: a\n```\nUpdated: b") == "```\nUpdated: a\n```\nUpdated: [VOLATILE_METADATA_OMITTED]"


def test_table_functions_give_what_the_operators_give(spark):
    assert len(tables.register(spark)) >= 12
    java = varied.varied_controllers(spark, SF).unionByName(varied.varied_classes(spark, SF)).unionByName(varied.varied_clients(spark, SF))
    script = varied.varied_scripts(spark, SF).unionByName(varied.varied_pages(spark, SF)).unionByName(varied.varied_components(spark, SF))
    operators = {
        "java_endpoints": (java, lambda f: extract.scanned(f, ["path"], syntax.ENDPOINT, syntax._endpoints)),
        "java_method_calls": (java, extract.method_calls),
        "java_methods": (java, extract.method_ranges),
        "script_interactions": (script, extract.interactions),
    }
    for name, (fn, columns) in tables.TABLES.items():
        files, operator = operators.get(name, (java if name.startswith("java") else script, lambda f, fn=fn, columns=columns: extract.scanned(f, ["path"], columns, fn)))
        in_sql = spark.sql(f"SELECT f.path, t.* FROM {{files}} f, LATERAL {name}(f.content) t", files=files)
        frame = operator(files).select(in_sql.columns)
        one, two = counted(in_sql.columns, in_sql.collect()), counted(frame.columns, frame.collect())
        assert one == two and (one or name in ("java_fields", "java_template_calls")), name


def test_table_functions_refuse_other_arguments(spark):
    tables.register(spark)
    with pytest.raises(Exception, match="first_rows takes"):
        spark.sql("SELECT * FROM first_rows(1, 2)").collect()
    none = spark.createDataFrame([], "k int, o int")
    assert spark.sql("SELECT * FROM first_rows(TABLE(SELECT * FROM {none}) PARTITION BY k ORDER BY (o), 2)", none=none).collect() == []


def test_windows_choose_the_smallest_block_and_merge(spark):
    java = "class A {\n  void a() { hit(); }\n  void b() { hit(); }\n\n\n  void c() { if (x) { hit(); } }\n  int d = hit();\n}\n"
    script = "hit();\n" + "x\n" * 40 + "hit();\nhit();\n"
    files = spark.createDataFrame([("A.java", java), ("b.ts", script), ("c.txt", "no\nhit"), ("d.ts", ""), ("e.ts", None)], "path string, content string")
    windows = focus.focused_windows(files, focus.found_places(files, r"hit\(?"))
    shown = {(r["path"], r["form"]): r["chunk"] for r in focus.rendered_focus(files, windows, 10_000).collect()}
    assert shown["A.java", "declaration"] == "[lines 1-8]\n" + java.rstrip()  # the field's hit shows the class, which holds the others
    windows = focus.focused_windows(files, focus.found_places(files, r"hit\(\); \}"), gap=4).where("path = 'A.java'")
    assert [(java[r["start"] : r["stop"]]) for r in windows.orderBy("start").collect()] == ["void a() { hit(); }\n  void b() { hit(); }", "void c() { if (x) { hit(); } }"]
    lines = focus.rendered_focus(files, focus.focused_windows(files, focus.found_places(files, "hit"), 2, 3), 10_000).where("path = 'b.ts'").orderBy("ord").collect()
    assert [(r["first_line"], r["last_line"]) for r in lines] == [(1, 4), (40, 44)]
    assert focus.rendered_focus(files, windows, 5).collect() == []


def test_evidence_tells_what_is_missing(spark):
    files = spark.createDataFrame([("A.java", "class A { /** c */ @Get\n  int f(int x) { return 1; }\n  private @Id Long id; }"), ("p.tsx", "export function Page() { return <b onClick={go}>Go</b>; }\nconst go = () => { x(); };\n")], "path string, content string")
    wanted = [
        ("Repository Evidence", "A.java", ["f", "g"], None, None), ("Repository Evidence", "A.java", ["g"], None, "low"), ("Backend Endpoint Evidence", "B.java", ["f"], None, "high"),
        ("Entity / DTO / Validation Evidence", "A.java", ["id"], "A", "high"), ("Entity / DTO / Validation Evidence", "A.java", ["no"], "A", "odd"), ("React Page Evidence", "p.tsx", ["Page"], None, "low"),
        ("React Interaction Evidence", "p.tsx", ["go"], None, None), ("React Route Evidence", "p.tsx", [], "onClick", None), ("React API Client Evidence", "p.tsx", None, None, None),
    ]
    df = spark.createDataFrame([(k, *w) for k, w in enumerate(wanted)], "k int, group string, path string, symbols array<string>, needle string, confidence string")
    got = {r["k"]: (r["code"], r["confidence"], r["uncertainty"]) for r in focus.evidence(files, df).collect()}
    method = "@Get\n  int f(int x) { return 1; }"
    assert got[0] == (method, "medium", None)
    assert got[1] == (None, "low", "Repository Evidence: g was not found in A.java.")
    assert got[2] == (None, "high", "Backend Endpoint Evidence: B.java is not readable.")
    assert got[3][0] == "private @Id Long id;" and got[4][0].startswith("class A {") and got[4][1] == "medium"
    assert got[5][0].startswith("export function Page()") and got[5][1] == "high"
    assert got[6][0] == "const go = () => { x(); }" + focus.JOINT + "<b onClick={go}>Go</b>"
    assert got[7][0].startswith("export function") and got[8][0] is None
    cut = focus.evidence(files, df.where("k = 0"), most=5).first()
    assert cut["code"] == "@Get\n\n[SNIPPET_TRUNCATED]"


def test_a_rescan_reads_what_changed(spark):
    schema = "path string, content string"
    old = spark.createDataFrame([("a.java", "class A { private R r; public void a() { r.x(); } }"), ("b.java", "class B { private R r; public void b() { r.y(); } }"), ("c.java", None)], schema)
    new = spark.createDataFrame([("a.java", "class A { private R r; public void a() { r.z(); r.z(); } }"), ("c.java", None), ("d.java", "class D { private R r; public void d() { r.w(); } }")], schema)
    read = []

    def extractor(files):
        read.append({r["path"] for r in files.select("path").collect()})
        return extract.method_calls(files)

    found = incremental.rescan(new, incremental.manifest_of(old), extract.method_calls(old), extractor)
    assert sorted((r["path"], r["target"], r["fresh"]) for r in found.collect()) == [("a.java", "z", True), ("a.java", "z", True), ("d.java", "w", True)]
    assert read == [{"a.java", "d.java"}]
    assert {(r["path"], r["change"]) for r in incremental.changes(incremental.manifest_of(old), incremental.manifest_of(new)).collect()} == {("a.java", "changed"), ("b.java", "removed"), ("c.java", "same"), ("d.java", "added")}


def test_a_stream_reads_new_files_once(spark, tmp_path):
    root, records, checkpoint = tmp_path / "src", str(tmp_path / "records"), str(tmp_path / "state")
    root.mkdir()
    (root / "A.java").write_text("class A { private R r; public void a() { r.x(); } }")
    (root / "no.txt").write_text("x")

    def scan():
        incremental.scan_stream(spark, str(root), "*.java", records, checkpoint, extract.method_calls).awaitTermination(120)
        return spark.read.parquet(records)

    assert [r["target"] for r in scan().collect()] == ["x"]
    (root / "sub").mkdir()
    (root / "sub" / "B.java").write_text("class B { private R r; public void b() { r.y(); } }")
    assert sorted(r["target"] for r in scan().collect()) == ["x", "y"]
    assert sorted((r["target"], r["batch"]) for r in scan().collect()) == [("x", 0), ("y", 1)]
    gone = spark.read.parquet(records).where(F.col("path").contains("B.java")).select("path")
    assert [r["target"] for r in incremental.current_records(spark.read.parquet(records), gone).collect()] == ["y"]
