"""Groups of any size: packing in parallel, as-of joins, containment by rarest grams, language order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import flows, packs, select
from cairn.plans.running import as_of, numbered


def plain_chunks(rows, most, separator):
    groups: dict = {}
    for g, o, n in rows:
        groups.setdefault(g, []).append((o, n or 0))
    out = {}
    for g, blocks in groups.items():
        used, chunk = 0, 0
        for o, n in sorted(blocks):
            if used == 0 or used + separator + n > most:
                used, chunk = n, chunk + 1
            else:
                used += separator + n
            out[g, o] = chunk
    return out


@pytest.mark.parametrize(
    ("sizes", "most", "separator"),
    [([0, 1, 5, 900, 50, 3000], 1000, 7), ([1, 2, 0], 50, 0), ([10, 20, 30], 100, 1), ([0, None, 4], 9, 0), ([5000, 1], 10, 3), ([0], 5, 0), ([1], 100_000, 7)],
)
def test_parallel_packing_is_greedy_packing(spark, sizes, most, separator):
    rng = random.Random(str(sizes))
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice(sizes)) for k in range(1200)] + [("alone", 1, 3)]
    df = spark.createDataFrame(rows, "g string, o long, n long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shares a group
    try:
        got = {(r.g, r.o): r.chunk for r in select.packed(df, ["g"], "o", "n", most, separator).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_chunks(rows, most, separator)


def test_packing_of_nothing(spark):
    assert select.packed(spark.createDataFrame([], "g string, o long, n long"), ["g"], "o", "n", 10).collect() == []


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_is_the_last_mark(spark, strict):
    rng = random.Random(8)
    points = [(rng.choice(["a", "a", None, "b"]), rng.choice([None, *range(300)]), k) for k in range(700)]
    marks = [(rng.choice(["a", "a", None, "c"]), rng.choice([None, *range(300)]), f"m{k:03}") for k in range(200)]

    def plain(g, t):
        held = [(mt, v) for mg, mt, v in marks if mg == g and mt is not None and t is not None and (mt < t or (mt == t and not strict))]
        return max(held, default=(0, None))[1]

    p, m = spark.createDataFrame(points, "g string, t int, k int"), spark.createDataFrame(marks, "g string, t int, v string")
    got = {r.k: r.v for r in as_of(p.repartition(3), m, ["g"], "t", ["v"], strict).collect()}
    assert got == {k: plain(g, t) for g, t, k in points}
    assert as_of(p, m.limit(0), ["g"], "t", ["v"]).where("v is not null").count() == 0
    assert as_of(p.limit(0), m, ["g"], "t", ["v"]).collect() == []
    with pytest.raises(ValueError, match="both"):
        as_of(p.withColumn("v", F.lit(1)), m, ["g"], "t", ["v"])


def test_containment_of_names_that_begin_alike(spark):
    rng = random.Random(3)
    names = [(k, "src/shared/" + "".join(rng.choice("abc/") for _ in range(rng.randrange(9)))) for k in range(300)] + [(301, None), (302, ""), (303, "ab"), (304, "ab")]
    needles = [(k, "".join(rng.choice("abc/s") for _ in range(rng.randrange(6)))) for k in range(120)] + [(200, "src/shared/"), (201, None), (202, "src/absent")]
    n, d = spark.createDataFrame(names, "i int, name string"), spark.createDataFrame(needles, "j int, needle string")
    for strict in (True, False):
        want = sorted((i, j) for i, a in names for j, b in needles if a is not None and b is not None and b in a and (b or not strict))
        for share in (10_000, 7):
            assert sorted((r.i, r.j) for r in flows.containing(n, d, strict, share).collect()) == want


def test_few_candidates_for_names_that_begin_alike(spark):
    """Rows that the join makes stay near the true matches: every needle visits the names of its rarest gram only."""
    names = spark.range(2000).select(F.concat(F.lit("src/shared/n"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("x")).alias("name"))
    needles = spark.range(2000).select(F.concat(F.lit("src/shared/n"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("needle"))
    found = flows.containing(names, needles)
    assert found.count() == 2000
    grams = names.select("name", F.explode(flows._grams(F.col("name"), 3)).alias("g")).groupBy("g").count().collect()
    assert max(r["count"] for r in grams) == 2000  # anchoring on beginnings would meet all with all


def test_language_order_and_numbers(spark):
    words = ["zebra", "Äpfel", "apfel", "Apfel", "éclair", "eclair", "Zoo", "öl", "ol", None, "apfel"]
    got = {r.w: r.place for r in flows.by_locale(spark.createDataFrame([(w,) for w in words], "w string").repartition(4), "w").collect()}
    order = sorted((w for w in got if w), key=lambda w: got[w])
    assert order == ["apfel", "Apfel", "Äpfel", "eclair", "éclair", "ol", "öl", "zebra", "Zoo"] and got[None] is None
    placed = numbered(spark.range(50).withColumn("g", F.col("id") % 3), ["g"], [-F.col("id")]).collect()
    assert all(r.place == sum(1 for s in placed if s.g == r.g and s.id >= r.id) for r in placed)


def test_splits_overlap_on_both_sides(spark):
    texts = ["x" * 30, "a\n" * 15, "x" * 14 + "\n" + "y" * 15, " " * 40, "ab" * 4, "x" * 9 + "\n" + "y" * 30, ""]

    def plain(t, least, overlap):
        if len(t) < 2 * least:
            return [t]
        middle = len(t) // 2
        cuts = [c for c in (t.rfind("\n", 0, middle + 1), t.find("\n", middle)) if c >= least and len(t) - c >= least]
        cut = min(cuts, key=lambda c: abs(c - middle)) if cuts else middle
        over = min(overlap, least // 2)
        left, right = t[: cut + over], t[max(0, cut - over) :]
        return [left, right] if left.strip() and right.strip() and max(len(left), len(right)) < len(t) else [t]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for least, overlap in ((10, 3), (4, 100), (20, 0), (1, 5)):
        got = {r.k: r.p for r in df.select("k", packs.split_once(F.col("t"), least, overlap).alias("p")).collect()}
        assert got == {k: plain(t, least, overlap) for k, t in enumerate(texts)}


def plain_windows(value, most):
    """The rule as it reads: breaks behind lines, the last one far enough, overlap from a line's start."""
    import re

    structural, lines, starts, line_start = [], [], [0], 0
    for k, c in enumerate(value):
        if c == "\n":
            lines.append(k + 1)
            bare = value[line_start : k + 1].strip()
            if not bare or re.fullmatch(r"[}\])]+[;,]?", bare) or re.match(r"(end|fi|done)\b", bare, re.IGNORECASE):
                structural.append(k + 1)
            starts.append(k + 1)
            line_start = k + 1
    starts = [x for x in starts if x < len(value)] or [0]
    budget = min(800, max(1, most // 10)) if most >= 40 else 0
    out, start, covered = [], 0, 0
    while True:
        hard = start + most
        if hard >= len(value):
            end, kind = len(value), "end-of-source"
        else:
            one = [x for x in structural if max(covered + 1, start + int(most * 0.4)) <= x <= hard]
            two = [x for x in lines if max(covered + 1, start + int(most * 0.25)) <= x <= hard]
            # the last break within the hard end decides, also where it is too early
            last = [[x for x in xs if x <= hard][-1:] for xs in (structural, lines)]
            end, kind = (last[0][0], "structure") if one and last[0][0] in one else (last[1][0], "line") if two and last[1][0] in two else (hard, "character")
        out.append((start, end, max(0, covered - start), kind, value[:start].count("\n") + 1, value[: max(end - 1, 0)].count("\n") + 1))
        if end >= len(value):
            return out
        covered, minimum = end, max(start + 1, end - budget)
        start = end if budget <= 0 else next((x for x in starts if minimum <= x < end), min(end, minimum))


def test_windows_and_their_ranges(spark):
    from cairn.operators import allocate

    rng = random.Random(6)
    pieces = ["}\n", "});\n", "]]],\n", "end if\n", "Done\n", "ending\n", "\n", "  \n", "x = 1;\n", "some longer line of code here\n", "y" * 90, "\n\n", "};;\n"]
    texts = ["", "\n", "a", *["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(80)]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(999, None)], "i int, t string")
    for most in (7, 39, 60, 200):
        got: dict = {}
        for r in allocate.windows(docs, "i", "t", most).orderBy("i", "part").collect():
            got.setdefault(r["i"], []).append((r["start"], r["stop"], r["overlap"], r["boundary"], r["start_line"], r["end_line"]))
        assert got.pop(999) == [(0, 0, 0, "end-of-source", 1, 1)]
        assert got == {k: plain_windows(t, most) for k, t in enumerate(texts)}
    found = allocate.windows(docs, "i", "t", 60)
    blocks = allocate.source_evidence(found, docs, "i", "t", F.concat(F.lit("File "), F.col("i"))).where("i = 5").orderBy("part").collect()
    assert blocks[0]["block"].startswith("## File 5\n- Window: 1/") and blocks[0]["block"].endswith("\n```") and len({b["block"] for b in blocks}) == len(blocks)


def test_components_of_a_slice_whose_numbers_meet_are_two_rows(spark, tmp_path):
    """From a thousand suppliers on, a supplier and a nation's controller may have one number: the SQL counts both, as the query does."""
    from cairn.registered import flowing
    from tests.oracle import TABLES, database, differences

    small = "/root/testdata/sf0.001"
    for name in TABLES:
        rows = spark.read.parquet(f"{small}/{name}.parquet")
        if name == "supplier":
            rows = spark.range(1000, 1100).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), (F.col("id") % 25).cast("int").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal"))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    found = flowing.whole_page_slices(spark, str(tmp_path))
    assert found.count() > found.distinct().count()
    assert differences(found, flowing.ORACLE_SQL["whole_page_slices"], database(str(tmp_path))) == ""
