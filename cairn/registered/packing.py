"""Budgets, blocks and chunks over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import allocate, packs
from cairn.queries import _markdown, table


def _texts(spark, sf):
    return table(spark, sf, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def budgeted_texts(spark, sf):
    d = packs.budgeted_texts(_texts(spark, sf), ["source"], "doc_id", "text", 20_000)
    return d.select("source", "doc_id", F.sha2("sent", 256).alias("sent"), "status")


def balanced_context(spark, sf):
    """Weighted shares of what titles and fences leave, excerpts of them, and what became of each part."""
    weight = F.when(F.col("lang") == "en", 6.0).when(F.col("lang") == "fr", 4.0).otherwise(2.0)
    d = table(spark, sf, "documents").select("source", "doc_id", "text", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"), weight.alias("weight"))
    titled = d.drop("text").withColumn("overhead", F.length(F.concat(F.lit("## Document "), "doc_id", F.lit("\n```\n\n```\n"))))
    shared = allocate.weighted_allocation(titled, ["source"], "doc_id", "size", "weight", 24_000, overhead="overhead")
    parts = d.select("doc_id", "text").join(shared.select("source", "doc_id", "size", "granted"), "doc_id")
    audit = packs.selection_audit(parts.withColumns({"stale": F.col("doc_id") % 11 == 0, "enabled": F.col("doc_id") % 13 != 0}))
    sent = F.when(F.col("selection").isin("included", "truncated"), packs.excerpt(F.coalesce("text", F.lit("")), F.col("granted")))
    return audit.select("source", "doc_id", "selection", F.length(sent).cast("bigint").alias("n_sent"))


def selection_audits(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("n_chars")).alias("size"), (F.col("doc_id") % 5 * 300).alias("granted"), (F.col("doc_id") % 11 == 0).alias("stale"), (F.col("doc_id") % 13 != 0).alias("enabled"))
    return packs.selection_audit(d).select("doc_id", "selection")


def excerpts_of_room(spark, sf):
    d = _texts(spark, sf).select("doc_id", "text", (F.col("doc_id") % 200).alias("room"))
    return d.select("doc_id", F.sha2(packs.excerpt(F.col("text"), F.col("room")), 256).alias("sha256"))


def weighted_rooms(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("size"), F.when(F.col("role") == "user", 6).otherwise(2).alias("weight"))
    return packs.weighted_rooms(c, ["conv_id"], "turn", "size", "weight", 1000)


def role_rooms(spark, sf):
    used = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("used"), F.countDistinct("lang").alias("roles"))
    return packs.role_rooms(used, ["source"], "roles", 60_000)


def json_blocks(spark, sf):
    e = table(spark, sf, "events")
    made = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"z": '), "props", F.lit(', "a": "'), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit("["), "props", F.lit(', "x"]')))
    return packs.json_blocks(e.select("event_id", made.alias("json")), "event_id", "json").select("event_id", F.col("ord").cast("bigint").alias("ord"), "label", "block")


def line_blocks(spark, sf):
    b = packs.line_blocks(table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text")), "id", "text")
    return b.select("id", F.col("ord").cast("bigint").alias("ord"), F.sha2("block", 256).alias("sha256"))


def blocks_within(spark, sf):
    w = packs.within(_texts(spark, sf).select("doc_id", F.lit(0).alias("ord"), "text"), "doc_id", "ord", "text", 700)
    return w.select("doc_id", F.col("piece").cast("bigint").alias("piece"), F.col("text"))


def chunk_identity(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("kind"), F.concat(F.lit("Part "), (F.col("doc_id") % 40).cast("string")).alias("label"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    c = packs.identified_chunks(d.withColumn("text", F.regexp_replace("text", "(?i)password|token|secret|key|authorization|BEGIN", "x")), "kind", "label", "doc_id", "text")
    return c.select("id", "part", "parts", "kind", "label")


def adaptive_split(spark, sf):
    s = packs.adaptive_split(_texts(spark, sf), "doc_id", "text", 3000, 1000, 200, 2)
    return s.select("doc_id", "path", F.length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("sha256"))


def snippet_windows(spark, sf):
    return packs.snippet_windows(_markdown(spark, sf), "conv_id", "text", "^## user", 0, 1, 1).select("conv_id", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), "hits")


def rendered_windows(spark, sf):
    m = _markdown(spark, sf)
    w = packs.snippet_windows(m, "conv_id", "text", "^## user", 0, 1, 1)
    return packs.rendered_windows(m, w, "conv_id", "text", 600).select("conv_id", F.col("start").cast("bigint").alias("start"), F.sha2("code", 256).alias("sha256"), "status")


QUERIES = {
    f.__name__: f
    for f in (
        budgeted_texts, balanced_context, selection_audits, excerpts_of_room, weighted_rooms, role_rooms, json_blocks, line_blocks, blocks_within, chunk_identity, adaptive_split, snippet_windows, rendered_windows,
    )
}

_AUDIT = """CASE WHEN doc_id % 13 = 0 THEN 'disabled' WHEN size IS NULL THEN 'missing' WHEN doc_id % 11 = 0 THEN 'skipped-stale' WHEN granted <= 0 AND size > 0 THEN 'omitted-budget'
    WHEN granted < size THEN 'truncated' ELSE 'included' END"""


def _split(level: int, most: int, least: int, over: int) -> str:
    """Level ``level`` of the adaptive split: each part over ``most`` in two, as index arithmetic on newlines."""
    return f"""a{level} AS (SELECT *, length(text) AS n, length(text) // 2 AS mid FROM s{level - 1}),
        b{level} AS (SELECT *, CASE WHEN contains(left(text, mid + 1), chr(10)) THEN mid + 1 - instr(reverse(left(text, mid + 1)), chr(10)) END AS d0,
            CASE WHEN contains(substr(text, mid + 1), chr(10)) THEN mid + instr(substr(text, mid + 1), chr(10)) - 1 END AS u0 FROM a{level}),
        c{level} AS (SELECT *, CASE WHEN d0 >= {least} AND n - d0 >= {least} THEN d0 END AS d, CASE WHEN u0 >= {least} AND n - u0 >= {least} THEN u0 END AS u FROM b{level}),
        d{level} AS (SELECT *, CASE WHEN d IS NOT NULL AND (u IS NULL OR mid - d <= u - mid) THEN d WHEN u IS NOT NULL THEN u ELSE mid END AS cut FROM c{level}),
        e{level} AS (SELECT *, left(text, least(cut + {over}, n)) AS l, substr(text, greatest(cut - {over}, 0) + 1) AS r FROM d{level}),
        f{level} AS (SELECT *, n > {most} AND n >= {2 * least} AND regexp_matches(l, '\\S') AND regexp_matches(r, '\\S') AND length(l) < n AND length(r) < n AS two FROM e{level}),
        s{level} AS (SELECT doc_id, path, text FROM f{level} WHERE NOT two UNION ALL SELECT doc_id, path || '0', l FROM f{level} WHERE two UNION ALL SELECT doc_id, path || '1', r FROM f{level} WHERE two)"""


_LINES = """l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM m),
        h AS (SELECT conv_id, i AS a, least(i + 1, n - 1) AS b FROM l WHERE x LIKE '## user%'),
        f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY conv_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS fresh FROM h),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM f),
        w AS (SELECT conv_id, min(a) AS start, max(b) AS stop, count(*) AS hits FROM g GROUP BY conv_id, island)"""
_MARK = "m AS (SELECT conv_id, string_agg('## ' || role || ' ' || turn || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
ORACLE_SQL = {
    "budgeted_texts": """WITH d AS (SELECT source, doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
        t AS (SELECT *, greatest(20000 - coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS r FROM d)
        SELECT source, doc_id, sha256(CASE WHEN r >= n THEN text WHEN r > 0 THEN left(text, CAST(r AS BIGINT)) || chr(10) || '...[truncated]' ELSE '' END) AS sent,
          CASE WHEN r >= n THEN 'included' WHEN r > 0 THEN 'truncated' ELSE 'omitted' END AS status FROM t""",
    "selection_audits": f"SELECT doc_id, {_AUDIT} AS selection FROM (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN n_chars END AS size, doc_id % 5 * 300 AS granted FROM documents)",
    "excerpts_of_room": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 200 AS r FROM documents)
        SELECT doc_id, sha256(CASE WHEN length(t) <= r THEN t WHEN r - 13 <= 2 THEN left(t, r) ELSE left(t, CAST(ceil((r - 13) * 0.75) AS BIGINT)) || chr(10) || '[TRUNCATED]' || chr(10)
          || right(t, r - 13 - CAST(ceil((r - 13) * 0.75) AS BIGINT)) END) AS sha256 FROM d""",
    "weighted_rooms": """WITH RECURSIVE c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, CASE WHEN role = 'user' THEN 6 ELSE 2 END AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
          count(*) OVER (PARTITION BY conv_id) AS parts, sum(CASE WHEN role = 'user' THEN 6 ELSE 2 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM conversations),
        r AS (SELECT conv_id, turn, k, parts, CASE WHEN parts = 1 THEN 1000 ELSE floor(greatest(0, 1000 - (parts - 1) * 7) * w / ws) END AS room, 1000 - least(CASE WHEN parts = 1 THEN 1000 ELSE floor(greatest(0, 1000 - (parts - 1) * 7) * w / ws) END, n) AS rest FROM c WHERE k = 1
          UNION ALL SELECT conv_id, turn, k, parts, room, rest - 7 - least(room, n) FROM (
            SELECT c.conv_id, c.turn, c.k, c.parts, c.n, r.rest, CASE WHEN c.k = c.parts THEN greatest(0, r.rest - 7) ELSE floor(greatest(0, r.rest - 7 - (c.parts - c.k) * 7) * c.w / c.ws) END AS room
            FROM r JOIN c ON c.conv_id = r.conv_id AND c.k = r.k + 1))
        SELECT conv_id, turn, CAST(room AS BIGINT) AS room FROM r""",
    "role_rooms": "SELECT source, CAST(greatest(1000, floor(greatest(1000, 60000 - sum(n_chars) - 1200) / count(DISTINCT lang))) AS BIGINT) AS room FROM documents GROUP BY source",
    "json_blocks": """SELECT event_id, CAST(0 AS BIGINT) AS ord, 'a' AS label, '"' || event_type || '"' AS block FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 1, 'z', replace(props, ' ', '') FROM events WHERE event_id % 2 = 0
        UNION ALL SELECT event_id, 0, 'item 1', replace(props, ' ', '') FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, 1, 'item 2', '"x"' FROM events WHERE event_id % 2 = 1""",
    "line_blocks": """WITH l AS (SELECT conv_id || ':' || turn AS id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS x FROM conversations)
        SELECT id, CAST(unnest(range(len(x))) AS BIGINT) AS ord, sha256(unnest(x)) AS sha256 FROM l""",
    "adaptive_split": f"""WITH s0 AS (SELECT doc_id, '' AS path, coalesce(text, '') AS text FROM documents), {_split(1, 3000, 1000, 200)}, {_split(2, 3000, 1000, 200)}
        SELECT doc_id, path, length(text) AS n, sha256(text) AS sha256 FROM s2""",
    "chunk_identity": r"""WITH d AS (SELECT lang AS kind, 'Part ' || doc_id % 40 AS label, doc_id, sha256(regexp_replace(coalesce(text, ''), '(?i)password|token|secret|key|authorization|BEGIN', 'x', 'g')) AS h FROM documents),
        f AS (SELECT kind, label, h, min(doc_id) AS o FROM d GROUP BY ALL)
        SELECT 'part-' || substr(label, 6) || '-' || row_number() OVER w || '-' || substr(h, 1, 12) AS id, row_number() OVER w AS part, count(*) OVER (PARTITION BY kind, label) AS parts, kind, label FROM f
        WINDOW w AS (PARTITION BY kind, label ORDER BY o)""",
    "snippet_windows": f"WITH {_MARK}, {_LINES} SELECT conv_id, start, stop, hits FROM w",
    "rendered_windows": f"""WITH {_MARK}, {_LINES}, c AS (SELECT conv_id, start, array_to_string(string_split(text, chr(10))[start + 1 : stop + 1], chr(10)) AS code FROM w JOIN m USING (conv_id)),
        t AS (SELECT *, greatest(600 - coalesce(sum(length(code)) OVER (PARTITION BY conv_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS r FROM c)
        SELECT conv_id, start, sha256(CASE WHEN r >= length(code) THEN code WHEN r > 0 THEN left(code, CAST(r AS BIGINT)) || chr(10) || '...[truncated]' ELSE '' END) AS sha256,
          CASE WHEN r >= length(code) THEN 'included' WHEN r > 0 THEN 'truncated' ELSE 'omitted' END AS status FROM t""",
}
