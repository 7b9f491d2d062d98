"""Every registered query outside ``llm`` against its SQL, or by invariants."""

from __future__ import annotations

import pytest

from cairn import oracles, queries, registered
from tests.oracle import database, differences

QUERIES = queries.QUERIES | registered.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | registered.ORACLE_SQL
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), ORACLE_SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_allocations_spend_the_budget(spark):
    for name in ("fair_allocation", "weighted_allocation"):
        groups: dict = {}
        for r in QUERIES[name](spark, SF).collect():
            assert 0 <= r["granted"] <= r["n_chars"]
            groups.setdefault(r["source"], []).append((r["n_chars"], r["granted"]))
        for parts in groups.values():
            assert sum(g for _, g in parts) == min(24_000, sum(n for n, _ in parts))


def test_windows_cover_their_texts(spark):
    size = {r["doc_id"]: len(r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    spans: dict = {}
    for r in QUERIES["source_windows"](spark, SF).orderBy("doc_id", "part").collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    assert set(spans) == set(size)
    for k, parts in spans.items():
        assert parts[0][0] == 0 and parts[-1][1] == size[k]
        assert all(b - a <= 900 for a, b in parts)
        for (a, b), (c, d) in zip(parts, parts[1:], strict=False):
            assert a < c <= b < d and b - c <= 90


def test_allocations_keep_all_documents_of_a_large_source(spark):
    large = "/root/testdata/sf0.1"  # hundreds of documents a source
    want = sorted(r["doc_id"] for r in spark.read.parquet(f"{large}/documents.parquet").select("doc_id").collect())
    for name in ("fair_allocation", "weighted_allocation"):
        rows = QUERIES[name](spark, large).collect()
        assert sorted(r["doc_id"] for r in rows) == want
        assert all(0 <= r["granted"] <= r["n_chars"] for r in rows)


def test_blocks_and_splits_keep_the_text(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    blocks: dict = {}
    for r in QUERIES["blocks_within"](spark, SF).orderBy("doc_id", "piece").collect():
        assert len(r["text"]) <= 700
        blocks[r["doc_id"]] = blocks.get(r["doc_id"], "") + r["text"]
    assert blocks == texts
    parts: dict = {}
    for r in QUERIES["adaptive_split"](spark, SF).collect():
        parts.setdefault(r["doc_id"], []).append((r["path"], r["n"]))
    assert set(parts) == set(texts)
    for k, found in parts.items():
        assert sum(n for _, n in found) >= len(texts[k]) and sum(n for _, n in found) <= len(texts[k]) + 2 * 200 * (len(found) - 1)
        assert len(found) == 1 or all(n >= 1000 for _, n in found)
        assert len(texts[k]) > 3000 or found == [("", len(texts[k]))]


def test_balanced_contexts_stay_within_their_budget(spark):
    size = {r["doc_id"]: len(r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total: dict = {}
    for r in QUERIES["balanced_context"](spark, SF).collect():
        assert (r["n_sent"] is None) == (r["selection"] not in ("included", "truncated"))
        assert r["n_sent"] is None or r["n_sent"] <= size[r["doc_id"]]
        assert r["selection"] != "included" or r["n_sent"] == size[r["doc_id"]]
        total[r["source"]] = total.get(r["source"], 0) + (r["n_sent"] or 0) + len(f"## Document {r['doc_id']}\n```\n\n```\n")
    assert all(n <= 24_000 for n in total.values())
