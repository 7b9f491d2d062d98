"""Strict JSON lines as a data source: ranges of lines, errors, all-or-nothing writes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairn.sources import jsonl_source

SCHEMA = "id long, name string, tags array<string>, inner struct<x:double,y:boolean>"


@pytest.fixture
def source(spark):
    jsonl_source.register(spark)
    return lambda path, **options: spark.read.format("strict_jsonl").schema(SCHEMA).options(**options).load(str(path))


def records(n):
    return [{"id": k, "name": "né " * (k % 5), "tags": ["a"] * (k % 3), "inner": {"x": k / 2, "y": k % 2 == 0}, "more": k} for k in range(n)]


def test_ranges_of_any_size_read_every_line_once(source, tmp_path):
    lines = [json.dumps(r, ensure_ascii=False) for r in records(200)]
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + "\n".join(lines[:120]).encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jsonl").write_text("\n\n" + "\r\n".join(lines[120:]) + "\n \n")
    (tmp_path / "_staged").mkdir()
    (tmp_path / "_staged" / "c.jsonl").write_text("not read")
    for size in (1 << 20, 1000, 97, 7):
        got = source(tmp_path, rangeBytes=str(size)).collect()
        assert sorted(r["id"] for r in got) == list(range(200))
        assert all(r["name"] == "né " * (r["id"] % 5) and r["inner"]["x"] == r["id"] / 2 for r in got)
    assert source(tmp_path / "a.jsonl").count() == 120


@pytest.mark.parametrize(
    ("line", "message"),
    [("{", "JSONL_INVALID_JSON"), ("[1]", "no object"), ('{"name": "x"}', "lacks id"), ('{"id": null}', "lacks id"), ('{"id": "one"}', "JSONL_INVALID_RECORD"), ('{"id": 1, "tags": 5}', "JSONL_INVALID_RECORD")],
)
def test_a_bad_line_is_an_error(source, tmp_path, line, message):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n' + line + "\n")
    with pytest.raises(Exception, match=message):
        source(tmp_path, required="id").collect()


def test_folders_without_data_and_missing_ones(source, tmp_path, spark):
    assert source(tmp_path).collect() == []
    (tmp_path / "empty.jsonl").write_text("")
    assert source(tmp_path).collect() == []
    with pytest.raises(Exception, match="JSONL_NOT_FOUND"):
        source(tmp_path / "none").collect()
    with pytest.raises(Exception, match="needs a schema"):
        spark.read.format("strict_jsonl").load(str(tmp_path)).collect()


def test_writes_are_published_whole_or_not_at_all(source, spark, tmp_path):
    rows = spark.createDataFrame([(r["id"], r["name"], r["tags"], r["inner"]) for r in records(50)], SCHEMA).repartition(4)
    folder = tmp_path / "out"
    rows.write.format("strict_jsonl").mode("overwrite").save(str(folder))
    assert sorted(r["id"] for r in source(folder).collect()) == list(range(50))
    manifest = json.loads((folder / "_manifest.json").read_text())
    assert sum(manifest.values()) == 50 and set(manifest) == {p.name for p in folder.glob("part-*")} and not list(folder.glob("_staged/*"))

    broken = rows.withColumn("id", F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.col("id") + 1000))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("strict_jsonl").mode("append").save(str(folder))
    assert json.loads((folder / "_manifest.json").read_text()) == manifest
    assert sorted(r["id"] for r in source(folder).collect()) == list(range(50)) and not list(folder.glob("_staged/*"))

    rows.limit(5).write.format("strict_jsonl").mode("append").save(str(folder))
    assert source(folder).count() == 55 and sum(json.loads((folder / "_manifest.json").read_text()).values()) == 55
    rows.where("id < 3").write.format("strict_jsonl").mode("overwrite").save(str(folder))
    assert source(folder).count() == 3 and sum(json.loads((folder / "_manifest.json").read_text()).values()) == 3
