"""DuckDB SQL with the same rows as the registered queries, where SQL can express them."""

from __future__ import annotations


def _path(c: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({c}), '[?#].*$', ''), '^(?i:https?)://[^/]*', '')"
    p = f"regexp_replace(regexp_replace('/' || {bare}, '/+', '/', 'g'), '/$', '')"
    for pattern in (r":\w+", r"\$\{[^}]+\}", r"\{[^}]+\}"):
        p = f"regexp_replace({p}, '{pattern}', '{{param}}', 'g')"
    return f"coalesce(nullif({p}, ''), '/')"


_CALLS = rf"""
  p AS (SELECT page_id, regexp_replace({_path("url")}, '\.html$', '') AS path FROM pages),
  q AS (SELECT page_id, coalesce(nullif(upper(regexp_extract(path, '^/(en|fr|de|es)(/|$)', 1)), ''), 'GET') AS m, path FROM p),
  calls AS (SELECT page_id AS call_ord, m,
              CASE WHEN page_id % 2 = 1 THEN coalesce(nullif(regexp_replace(path, '^/(en|fr|de|es)(/|$)', '/'), ''), '/') ELSE path END AS path
            FROM q WHERE page_id % 3 = 0),
  ends AS (SELECT page_id AS ord, m, path FROM q WHERE page_id % 3 <> 0),
  exact AS (SELECT call_ord, count(*) AS n, min(ord) AS f FROM calls c JOIN ends e ON c.m = e.m AND c.path = e.path GROUP BY 1),
  suffix AS (SELECT call_ord, count(*) AS n, min(ord) AS f FROM calls c
             JOIN ends e ON c.m = e.m AND (ends_with(c.path, e.path) OR ends_with(e.path, c.path))
             WHERE call_ord NOT IN (SELECT call_ord FROM exact) GROUP BY 1),
  matched AS (
    SELECT c.call_ord, c.m || ' ' || c.path AS call, coalesce(x.f, s.f) AS endpoint_ord,
           CASE WHEN x.n = 1 THEN 'high' WHEN s.n = 1 THEN 'medium' WHEN coalesce(x.n, s.n) IS NULL THEN 'unmatched' ELSE 'low' END AS confidence,
           coalesce(x.n, s.n, 0) AS n_candidates,
           CASE WHEN x.n = 1 THEN 'exact path' WHEN x.n > 1 THEN 'ambiguous exact path: ' || x.n || ' endpoints'
                WHEN s.n = 1 THEN 'path suffix' WHEN s.n > 1 THEN 'ambiguous path suffix: ' || s.n || ' endpoints'
                ELSE 'no endpoint by method and path' END AS match_reason
    FROM calls c LEFT JOIN exact x USING (call_ord) LEFT JOIN suffix s USING (call_ord))
"""

_EDGES = """
  e AS (SELECT DISTINCT a, b FROM (
          SELECT p_partkey AS a, CAST(floor(p_partkey / (2 + p_size % 3)) AS BIGINT) AS b FROM part
          UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 5) AS BIGINT) FROM part))
"""

_NODES = """
  nodes AS (
    SELECT 'region:' || r_regionkey AS id, 'Region' AS type, r_name AS name, 0 AS t FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, 1 FROM nation
    UNION ALL SELECT 'segment:' || c_mktsegment, 'Segment', arg_min(c_name, c_custkey), 2 FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, 3 FROM supplier),
  edges AS (
    SELECT DISTINCT source, type, target FROM (
      SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'CONTAINS' AS type, 1 AS t FROM nation
      UNION ALL SELECT 'nation:' || c_nationkey, 'segment:' || c_mktsegment, 'HAS', 2 FROM customer
      UNION ALL SELECT 'nation:' || c_nationkey, 'segment:' || c_mktsegment, 'EARLY', 1 FROM customer
      UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'HAS', 3 FROM supplier) x
    WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.id = x.source AND n.t <= x.t) AND EXISTS (SELECT 1 FROM nodes n WHERE n.id = x.target AND n.t <= x.t))
"""

_GAPS = """
  w AS (SELECT unnest(['user0', 'assistant1', 'user2', 'assistant3', 'user4']) AS section),
  c AS (SELECT DISTINCT conv_id FROM conversations),
  s AS (SELECT conv_id, role || turn AS section, coalesce(text, '') AS body FROM conversations),
  gaps AS (
    SELECT c.conv_id, w.section, 'empty-section' AS gap_type, 'high' AS severity FROM c CROSS JOIN w
    LEFT JOIN s ON s.conv_id = c.conv_id AND s.section = w.section
    WHERE s.body IS NULL OR regexp_matches(s.body, '^\\s*(?i:tbd|todo|n/?a|none|-|\\.\\.\\.)?\\s*$')
    UNION ALL SELECT conv_id, section, 'not-visible', 'medium' FROM s WHERE regexp_matches(body, '(?i)(not visible|not available|could not be determined|unknown)')
    UNION ALL SELECT conv_id, 'document', 'source-reference', 'high' FROM s GROUP BY conv_id
      HAVING sum(len(list_distinct(regexp_extract_all(body, 'src/[A-Za-z0-9_./-]+\\.(java|tsx?|jsx?|ya?ml|properties)')))) < 3)
""".replace("\\\\", "\\")

_LEDGER = """
  items AS (SELECT conv_id, CASE WHEN turn < 2 THEN 'Opening' ELSE 'Middle' END AS heading,
              CASE role WHEN 'assistant' THEN 'reference' WHEN 'user' THEN 'finding' ELSE 'uncertainty' END AS kind,
              trim(coalesce(text, '')) AS text, turn FROM conversations WHERE turn < 5),
  ledger AS (SELECT conv_id, heading, kind, text, min(turn) AS ord FROM items WHERE text <> '' GROUP BY ALL)
"""

_SCORED = """
  scored AS (
    SELECT doc_id, source, quality IS NULL AS no_label,
      CAST(least(greatest(floor(
        (coalesce(CASE WHEN n_chars > 0 THEN CAST(length(text) AS DOUBLE) / n_chars END, 0) * 20 + coalesce(quality, 0) * 12
         + coalesce(CASE WHEN toxic = 0 THEN 1.0 WHEN toxic = 1 THEN 0.0 END, 0) * 12
         + CASE WHEN n_chars < 2000 THEN 0 WHEN n_chars < 6000 THEN 0.5 ELSE 1 END * 5) * (100.0 / 49)
        - least(2 * ((CASE WHEN text IS NULL OR coalesce(n_chars, 0) <= 0 THEN 1 ELSE 0 END) + (CASE WHEN quality IS NULL THEN 1 ELSE 0 END)
                     + (CASE WHEN toxic IS NULL OR toxic NOT IN (0, 1) THEN 1 ELSE 0 END)), 12)
        - least(2 * (CASE WHEN lang <> 'en' THEN 1 ELSE 0 END), 10) + 0.5), 0), 100) AS BIGINT) AS score
    FROM documents LEFT JOIN labels USING (doc_id))
"""
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END"
_PLAIN = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_SECRET = r"(?i)((?:password|token|secret|api[_-]?key|client[_-]?secret|authorization)\s*[:=]\s*)\"(?:\\.|[^\"\\\r\n])*\"".replace('\\"', '"')

ORACLE_SQL = {
    "normalize_path": f"SELECT page_id, {_path('url')} AS path, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages",
    "record_ids": """SELECT doc_id, substr(sha256(concat_ws(':', source, lang, CAST(doc_id AS VARCHAR))), 1, 12) AS gap_id,
                     substr(sha256(concat_ws(':', text)), 1, 16) AS record_hash, sha256(coalesce(text, '')) AS sha256 FROM documents""",
    "excerpts": f"""{_PLAIN} SELECT doc_id,
        sha256(CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || '...[truncated]' ELSE text END) AS head,
        sha256(CASE WHEN length(text) > 100 THEN left(text, 85) || chr(10) || '...[truncated]' ELSE text END) AS within,
        sha256(CASE WHEN length(text) > 117 THEN left(text, 75) || chr(10) || '...[omitted]...' || chr(10) || right(text, 25) ELSE text END) AS both,
        sha256(CASE WHEN length(text) > 100 THEN '[earlier text omitted]' || chr(10) || right(text, 100) ELSE text END) AS tail,
        CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CAST(ceil(length(text) / 3) + 512 AS BIGINT) AS safe_tokens FROM d""",
    "mask_secrets": f"""{_PLAIN} SELECT doc_id, sha256(regexp_replace(text, '{_SECRET}', '\\1"[MASKED_SECRET]"', 'g')) AS masked_sha256,
        CAST(len(regexp_extract_all(text, '{_SECRET}')) AS BIGINT) AS n_masked FROM d""",
    "config_keys_masked": """SELECT event_id, 'token_' || k || '=[MASKED_SECRET]' AS masked, k AS plain
        FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)""",
    "classify_documents": rf"""{_PLAIN} SELECT doc_id, CASE WHEN trim(d.text) = '' THEN 'empty'
        WHEN regexp_matches(d.text, '(?i)(password|secret|token)\s*[:=]') THEN 'config' WHEN regexp_matches(d.text, '(?i)license|copyright') THEN 'license'
        WHEN regexp_matches(d.text, 'https?://') THEN 'reference' WHEN length(d.text) < 200 THEN 'note' WHEN lang <> 'en' THEN 'translation' ELSE 'prose' END AS kind
        FROM d JOIN documents USING (doc_id)""",
    "source_kinds": """SELECT source, CASE WHEN links AND long THEN 'mixed' WHEN links THEN 'linked' WHEN long THEN 'long' ELSE 'plain' END AS kind,
        concat_ws(',', CASE WHEN links THEN 'links' END, CASE WHEN long THEN 'long' END, CASE WHEN english > 0 THEN 'english' END) AS facts
        FROM (SELECT source, bool_or(contains(text, 'http')) AS links, bool_or(n_chars > 5000) AS long, count(*) FILTER (WHERE lang = 'en') AS english FROM documents GROUP BY source)""",
    "extract_links": """SELECT page_id, i - 1 AS ord, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i
        FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))""",
    "distinct_tags": """SELECT page_id, array_to_string(list_sort(list_distinct(t)), ',') AS tags, CAST(len(list_distinct(t)) AS BIGINT) AS n_tags,
        array_to_string(f[1:4], ', ') || CASE WHEN len(f) > 4 THEN ' (+' || (len(f) - 4) || ')' ELSE '' END AS shown
        FROM (SELECT page_id, t, list_filter(t, lambda x, i: list_position(t, x) = i) AS f FROM (SELECT page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) AS t FROM pages))""",
    "two_tier_match": f"WITH {_CALLS} SELECT * FROM matched",
    "match_unresolved": f"WITH {_CALLS} SELECT call_ord, call, match_reason FROM matched WHERE confidence IN ('unmatched', 'low')",
    "match_summary": f"""WITH {_CALLS} SELECT count(*) AS calls, count(*) FILTER (WHERE confidence IN ('high', 'medium')) AS resolved,
        count(*) FILTER (WHERE confidence = 'low') AS ambiguous, count(*) FILTER (WHERE confidence = 'unmatched') AS unmatched FROM matched""",
    "scored_best_or_none": """WITH p AS (SELECT s_suppkey, c_custkey, CASE WHEN abs(c_acctbal - s_acctbal) <= 5 THEN 100 WHEN abs(c_acctbal - s_acctbal) <= 20 THEN 85
          WHEN abs(c_acctbal - s_acctbal) <= 60 THEN 60 ELSE 40 END AS score
          FROM supplier JOIN customer ON s_nationkey = c_nationkey AND floor(s_acctbal / 100) = floor(c_acctbal / 100)),
        b AS (SELECT *, rank() OVER (PARTITION BY s_suppkey ORDER BY score DESC) AS r FROM p WHERE score >= 60)
        SELECT s_suppkey, max(score) AS score, max(c_custkey) AS c_custkey FROM b WHERE r = 1 GROUP BY s_suppkey HAVING count(*) = 1""",
    "unique_value_lookup": "SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1",
    "flow_assembly": """WITH li AS (SELECT l_orderkey, count(*) AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY 1),
        j AS (SELECT o.*, li.n, li.flag, c_acctbal, n_name FROM orders o LEFT JOIN li ON l_orderkey = o_orderkey
              LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey),
        u AS (SELECT *, concat_ws('; ', CASE WHEN n IS NULL THEN 'no lines' END, CASE WHEN n_name IS NULL THEN 'no nation' END,
              CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN flag = 'R' THEN 'returned' END) AS notes FROM j)
        SELECT o_orderkey, coalesce(n, 0) AS n_lines, n_name, notes AS uncertainties,
          CASE WHEN notes <> '' THEN 'partial' WHEN o_orderstatus = 'F' AND o_totalprice > 1000 THEN 'high' ELSE 'medium' END AS confidence FROM u""",
    "page_list_upsert": """SELECT n_nationkey AS key, coalesce(c.name, n_name) AS name, coalesce(s.b, c.b) AS balance FROM nation
        LEFT JOIN (SELECT c_nationkey, min(c_name) AS name, max(c_acctbal) AS b FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS b FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""",
    "match_status_rollup": """SELECT o_custkey, CASE WHEN f = 0 THEN 'none' WHEN f = n THEN 'matched' ELSE 'partial' END AS status,
        CASE WHEN f > 0 THEN 'high' WHEN o > 0 THEN 'medium' ELSE 'low' END AS confidence, n
        FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1)""",
    "semi_cascade": """SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN
        (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'))) GROUP BY 1""",
    "either_semi": """SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey
        AND ((l_returnflag = 'R' AND l_quantity > 45) OR (l_discount >= 0.1 AND l_quantity < 5)))""",
    "anti_quality": """SELECT 'customer' AS kind, c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
        UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_returnflag = 'R')""",
    "count_by": "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2",
    "module_map": "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS names, count(*) AS n FROM part GROUP BY 1",
    "artifact_rating": "SELECT artifact, n, n_weak, CASE WHEN n = 0 THEN 'empty' WHEN n_weak > 0 THEN 'weak' ELSE 'good' END AS rating FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS artifact, count(*) AS n, count(*) FILTER (WHERE {r}) AS n_weak FROM {t}"
        for t, r in {"customer": "c_acctbal < -990", "orders": "o_totalprice < 0", "lineitem": "l_quantity <= 0", "supplier": "s_acctbal < 0", "events": "value < 0", "part": "p_size > 100"}.items()
    ) + ")",
    "top_k_per_source": """SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank
        FROM documents QUALIFY rank <= 4""",
    "priority_rank": """SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY
          CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END,
          CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderkey) AS rank FROM orders QUALIFY rank <= 3""",
    "scan_budget_violation": """WITH d AS (SELECT source, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, n_chars, count(*) OVER w AS ord, sum(n_chars) OVER w AS total
          FROM documents WINDOW w AS (PARTITION BY source ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0') ROWS UNBOUNDED PRECEDING)),
        v AS (SELECT *, CASE WHEN ord > 40 THEN 'file-count' WHEN n_chars > 30000 THEN 'file-size' WHEN total > 60000 THEN 'total-size' END AS violation FROM d)
        SELECT source, arg_min(path, ord) AS path, min(ord) AS ord, arg_min(violation, ord) AS violation FROM v WHERE violation IS NOT NULL GROUP BY source""",
    "resume_prefix": """SELECT user_id, event_id, event_type FROM (SELECT *, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events)
        WHERE stop IS NULL OR event_id < stop""",
    "first_wins": "SELECT sha256(coalesce(text, '')) AS sha256, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2",
    "keep_others_upsert": """WITH s AS (SELECT conv_id, turn FROM conversations WHERE role = 'system')
        SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM s) UNION ALL SELECT conv_id, turn, 'replaced' FROM s""",
    "set_operations": """SELECT key, 'both' AS kind FROM (SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT key, 'left' FROM (SELECT c_nationkey AS key FROM customer EXCEPT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT key, 'right' FROM (SELECT s_nationkey AS key FROM supplier EXCEPT SELECT c_nationkey FROM customer)""",
    "merged_sessions": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a FROM events),
        f AS (SELECT *, CASE WHEN a > max(a + 1800) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600 THEN 1 ELSE 0 END AS fresh FROM e),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM f)
        SELECT user_id, min(a) AS start, max(a) + 1800 AS "end", count(*) AS n FROM g GROUP BY user_id, island""",
    "usage_all_or_null": """SELECT user_id, event_type, CAST(sum(event_id) AS BIGINT) AS total, CAST(CASE WHEN event_type <> 'error' THEN sum(event_id) END AS BIGINT) AS tokens
        FROM events GROUP BY 1, 2""",
    "closure_reach": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS source, p_partkey AS node FROM part UNION SELECT r.source, e.b FROM r JOIN e ON e.a = r.node)
        SELECT source, node FROM r""",
    "unique_owner": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS source, p_partkey AS node FROM part WHERE p_size = 50
          UNION SELECT r.source, e.b FROM r JOIN e ON e.a = r.node)
        SELECT node, min(source) AS owner FROM r GROUP BY node HAVING count(*) = 1""",
    "backprop_unique": """SELECT o_orderkey, s AS supplier FROM orders LEFT JOIN
        (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) ON l_orderkey = o_orderkey""",
    "graph_nodes": f"WITH {_NODES} SELECT id, type, name FROM nodes",
    "graph_edges": f"WITH {_NODES} SELECT * FROM edges",
    "graph_summary": f"WITH {_NODES} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY 2",
    "sequential_budget": """SELECT source, doc_id, n_chars, CAST(least(n_chars, greatest(24000 - coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS BIGINT) AS taken FROM documents""",
    "admission_skip": """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars + 50 AS need, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents QUALIFY k <= 80),
        r AS (SELECT source, doc_id, k, CASE WHEN need <= 24000 THEN need ELSE 0 END AS used, need <= 24000 AS ok FROM o WHERE k = 1
          UNION ALL SELECT o.source, o.doc_id, o.k, CASE WHEN used + need <= 24000 THEN used + need ELSE used END, used + need <= 24000
          FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1)
        SELECT source, doc_id FROM r WHERE ok""",
    "block_packing": """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
        r AS (SELECT source, doc_id, k, n_chars AS used, CAST(1 AS BIGINT) AS chunk FROM o WHERE k = 1
          UNION ALL SELECT o.source, o.doc_id, o.k, CASE WHEN used = 0 OR used + 7 + n_chars > 6000 THEN n_chars ELSE used + 7 + n_chars END,
            CASE WHEN used = 0 OR used + 7 + n_chars > 6000 THEN chunk + 1 ELSE chunk END
          FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1)
        SELECT source, doc_id, chunk FROM r""",
    "fair_allocation": """WITH a AS (SELECT source, doc_id, n_chars, n_chars * (count(*) OVER (PARTITION BY source) - row_number() OVER w + 1) <= 24000 - (sum(n_chars) OVER w - n_chars) AS met FROM documents
          WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)),
        g AS (SELECT source, 24000 - coalesce(sum(n_chars) FILTER (WHERE met), 0) AS rest, greatest(count(*) FILTER (WHERE NOT met), 1) AS open FROM a GROUP BY source)
        SELECT a.source, doc_id, n_chars, CAST(CASE WHEN met THEN n_chars ELSE floor(rest / open) + CASE WHEN sum(CASE WHEN met THEN 0 ELSE 1 END) OVER (PARTITION BY a.source ORDER BY doc_id) <= rest % open THEN 1 ELSE 0 END END AS BIGINT) AS granted
        FROM a JOIN g USING (source)""",
    "role_split": """SELECT source, doc_id, CAST(least(floor(floor(240000 / (SELECT count(DISTINCT source) FROM documents)) / count(*) OVER (PARTITION BY source)), 700) AS BIGINT) AS granted
        FROM documents""",
    "section_split": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, role || ' ' || turn AS heading, role || turn AS name,
        sha256(regexp_replace(coalesce(text, ''), '\\n+$', '')) AS body_sha256 FROM conversations""",
    "gap_detect": f"WITH {_GAPS} SELECT * FROM gaps",
    "gap_plan": f"""WITH {_GAPS} SELECT conv_id, count(*) AS n_gaps, array_to_string(list_sort(list(DISTINCT section)), ',') AS sections,
        array_to_string(list_sort(list(DISTINCT CASE WHEN section LIKE '%user%' THEN 'components' ELSE 'page-flow' END)), ',') AS evidence FROM gaps GROUP BY conv_id""",
    "section_merge": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM conversations)
        SELECT conv_id, role || turn AS name, sha256(CASE WHEN role = 'assistant' THEN 'repaired ' || ord ELSE regexp_replace(coalesce(text, ''), '\\n+$', '') END) AS body_sha256, CAST(0 AS BIGINT) AS n_lost FROM s
        UNION ALL SELECT DISTINCT conv_id, 'added', sha256('new'), CAST(0 AS BIGINT) FROM s""",
    "ledger_normalize": f"WITH {_LEDGER} SELECT conv_id, heading, kind, sha256(text) AS item, ord FROM ledger",
    "ledger_ground": f"""WITH {_LEDGER}, src AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY text) AS content FROM conversations GROUP BY conv_id),
        kept AS (SELECT l.* FROM ledger l JOIN src USING (conv_id) WHERE kind = 'reference' AND contains(content, l.text)),
        backed AS (SELECT DISTINCT conv_id, heading FROM kept)
        SELECT conv_id, heading, kind, sha256(text) AS item FROM kept
        UNION ALL SELECT l.conv_id, l.heading, CASE WHEN kind = 'finding' AND b.conv_id IS NULL THEN 'uncertainty' ELSE kind END, sha256(text)
        FROM ledger l LEFT JOIN backed b ON b.conv_id = l.conv_id AND b.heading = l.heading WHERE kind <> 'reference'""",
    "page_score": f"WITH {_SCORED} SELECT doc_id, score, {_GRADE} AS grade FROM scored",
    "page_score_rollup": f"""WITH {_SCORED} SELECT source, count(*) AS n, CAST(floor(avg(score) + 0.5) AS BIGINT) AS mean, count(*) FILTER (WHERE score >= 75) AS good,
        count(*) FILTER (WHERE no_label) AS unknown FROM scored GROUP BY source""",
    "mention_coverage": """SELECT doc_id, count(*) AS n_terms, count(*) FILTER (WHERE contains(text, term)) AS n_mentioned
        FROM (SELECT doc_id, lower(coalesce(text, '')) AS text, unnest([lang, source, 'the', 'x']) AS term FROM documents) WHERE length(term) >= 2 GROUP BY doc_id""",
    "staleness": """WITH t AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'view') AS v, max(ts) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1)
        SELECT 'view:' || user_id AS target, 'click:' || user_id AS dependency,
          CASE WHEN v IS NULL THEN 'missing-target' WHEN c IS NULL THEN 'missing-dependency' ELSE 'stale-target' END AS problem FROM t WHERE v IS NULL OR c IS NULL OR v < c""",
    "fingerprint_diff": """SELECT CAST(doc_id AS VARCHAR) AS name, CASE lang WHEN 'es' THEN 'added' WHEN 'de' THEN 'removed' ELSE 'modified' END AS change
        FROM documents WHERE lang IN ('es', 'de') OR contains(text, 'license')""",
    "cache_hit_miss": """WITH d AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS key FROM documents), c AS (SELECT DISTINCT key FROM d WHERE lang = 'fr')
        SELECT d.key, doc_id, CASE WHEN c.key IS NULL THEN substr(d.key, 1, 8) ELSE 'cached' END AS value, c.key IS NOT NULL AS hit FROM d LEFT JOIN c ON c.key = d.key""",
}
ORACLE_SQL["repository_score"] = f"SELECT CAST(100 - 4 * count(*) FILTER (WHERE rating = 'weak') AS BIGINT) AS score, count(*) FILTER (WHERE rating = 'weak') AS weak FROM ({ORACLE_SQL['artifact_rating']})"

from cairn.operators.documents import COUNTED  # noqa: E402
from cairn.queries import SAID  # noqa: E402


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_SAID = f"""WITH v AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_literal(t)})" for k, t in enumerate(SAID))}) v(k, said)),
    d AS (SELECT doc_id, k, coalesce(text, '') || chr(10) || said AS text FROM documents JOIN v ON v.k = doc_id % {len(SAID)})"""
_HITS = lambda p: f"len(regexp_extract_all(text, {_literal(p)}))"
ORACLE_SQL |= {
    "doc_assessment": f"""{_SAID} SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, {_HITS(r"[^ \t\n\x0B\f\r]+")} AS n_words,
        {_HITS("(?i)(not visible|not available|could not be determined|unknown)")} AS n_unresolved, {", ".join(f"{_HITS(p)} AS {name}" for name, p in COUNTED.items())},
        len(list_distinct(regexp_extract_all(text, {_literal(COUNTED["n_references"])}))) AS n_sources, {_HITS(r"(?m)^#{1,3}[ \t]+[^ \n]")} AS n_headings,
        CAST(k = 1 AS BIGINT) AS n_duplicates, CASE WHEN k = 1 THEN 2 ELSE 0 END AS n_empty, k = 4 AS has_diagram FROM d""",
    "score_differences": f"""{_SAID}, x AS (SELECT doc_id, {_HITS(COUNTED["n_references"])} AS n, length(text) AS size FROM d),
        y AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'references missing from score' WHEN doc_id % 3 <> n THEN 'references file=' || n || ', score=' || doc_id % 3 END AS a,
          CASE WHEN doc_id % 5 = 0 THEN 'length missing from score' WHEN doc_id % 2 = 1 THEN 'length file=' || size || ', score=' || (size - 1) END AS b FROM x)
        SELECT doc_id, CASE WHEN a IS NULL AND b IS NULL THEN 'consistent' ELSE 'mismatch: ' || concat_ws('; ', a, b) END AS said FROM y""",
    "recommended_actions": """WITH c AS (SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal < -900) AS a, count(*) FILTER (WHERE c_custkey % 97 = 0) AS b, count(*) FILTER (WHERE c_acctbal > 9900) AS c FROM customer GROUP BY 1)
        SELECT c_nationkey, 'Clarify the path constants and owners of calls that match no endpoint or match one weakly.' AS action FROM c WHERE a > 0
        UNION ALL SELECT c_nationkey, 'Review target, method and path of outbound calls that match no endpoint or match one weakly.' FROM c WHERE b > 0
        UNION ALL SELECT c_nationkey, 'Close the uncertainties of partial page flows with source evidence.' FROM c WHERE c > 0
        UNION ALL SELECT c_nationkey, 'All local matches are complete; have rules and permissions confirmed before publishing.' FROM c WHERE a + b + c = 0""",
    "analysis_warnings": """WITH w AS (SELECT * FROM (VALUES (2, true, 'warning', 'no controller found'), (3, true, 'warning', 'no endpoint found'), (4, false, 'warning', NULL), (4, false, 'action', 'check package, annotations and names of files of unknown kind'), (5, false, 'action', 'review endpoints with a missing or unclear path'),
          (6, false, 'action', 'review signatures whose parameters were not parsed'), (7, false, 'action', 'review controllers without a service'), (8, false, 'action', 'review services without a repository or client')) w(m, none, level, message))
        SELECT s_suppkey, level, coalesce(message, s_suppkey % 4 || ' files of unknown kind') AS message FROM supplier, w WHERE (s_suppkey % m = 0) = none
        UNION ALL SELECT s_suppkey, 'action', 'have the results reviewed' FROM supplier WHERE s_suppkey % 840 = 0""",
    "scores_of_repositories": """WITH r AS (SELECT s_nationkey AS n, s_suppkey % 2 = 0 AS c, s_suppkey % 3 = 0 AS f, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN s_suppkey % 4 = 0 THEN 'empty' WHEN (s_suppkey % 3 = 0 AND s_suppkey % 7 > 0) OR s_suppkey % 4 < 2 THEN 'weak' ELSE 'good' END AS r FROM supplier),
        s AS (SELECT n, CAST(greatest(least(100 - sum(CASE WHEN r = 'missing' AND c THEN 12 WHEN r = 'empty' AND c THEN 15 WHEN r = 'empty' AND f THEN 6 WHEN r = 'weak' THEN 4 ELSE 0 END), 100), 0) AS BIGINT) AS score FROM r GROUP BY n)
        SELECT n AS s_nationkey, score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 65 THEN 'needs-attention' ELSE 'poor' END AS grade FROM s""",
}
