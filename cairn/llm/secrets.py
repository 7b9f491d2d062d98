"""Secret scanning with multipart credential linking.

Strong spans (assignments with long values, access identifiers, long hex runs)
are reported on their own. Weak candidates are parts that mean little alone:
account identifiers, high-entropy strings or short assigned values, and
service endpoints. They are interval-joined within a scope, a distance of
``scope`` code points in one text, and reported only when a complementary part
stands in it:

* an identifier needs a secret (weak or strong),
* a secret needs an identifier (weak or strong) or an endpoint,
* an endpoint needs a secret.

A scope holds a bounded number of parts (each takes at least six code points),
so the join's work per part is bounded as well: no text, however long, is
compared with itself as a whole.

Nulls and edges: a null text is empty and has no span; rows that repeat
identifier and text link each for itself with equal results; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tasks import id_and_text, map_columns
from cairn.plans.durable import materialize

#: The kinds in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

IDENTIFIER = re.compile(
    r"(?:access_?key_?id|client_?id|account_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{4,})", re.IGNORECASE | re.ASCII
)
IDENTIFIER_WORDS = ("id", "username", "user_name", "login")
BLOB = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"(?:https?|s3|gs|ftp|jdbc:[a-z]+|postgres(?:ql)?|mongodb)://[^\s\"'<>]+", re.ASCII)

MADE = (
    "key string, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "base array<struct<kind:int,start:int,end:int>>, weak array<struct<kind:int,start:int,end:int>>"
)


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by start, then kind; matches leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def mixed(value: str) -> bool:
    """Upper case, lower case and digits all occur: unlike a word or a number."""
    return any(c.isdigit() for c in value) and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)


def weak_candidates(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    low, found = text.lower(), []
    if any(w in low for w in IDENTIFIER_WORDS):
        found += [(3, m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    if "AKIA" in text:
        found += [(3, m.start(), m.end()) for m in ACCESS.finditer(text) if 12 <= len(m[0]) < 18]
    if any(w in low for w in ASSIGN_WORDS):
        found += [(4, m.start(), m.end()) for m in ASSIGN.finditer(text) if 6 <= len(m[2]) < 12]
    found += [(4, m.start(), m.end()) for m in BLOB.finditer(text) if mixed(m[0])]
    if "://" in text:
        found += [(5, m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    return outside(found, strong)


def outside(found: list[tuple[int, int, int]], strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``found`` that overlap no strong span."""
    ends = list(accumulate((s[2] for s in strong), max))
    starts = [s[1] for s in strong]
    return [x for x in found if not (n := bisect_left(starts, x[2])) or ends[n - 1] <= x[1]]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Strong spans and weak candidates of every row; ``key`` names the rows that have weak candidates."""
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def scan(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("key", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak")}
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            strong = strong_spans(text)
            weak = weak_candidates(text, strong)
            out["key"].append(hashlib.sha1(f"{i}|{text}".encode("utf-8", "surrogatepass")).hexdigest() if weak else None)
            for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                out[c].append(sum(s[0] == k for s in strong))
            out["base_sha256"].append(hashlib.sha256(joined(strong).encode()).hexdigest())
            out["base"].append(as_rows(strong))
            out["weak"].append(as_rows(weak))
        return out

    return map_columns(id_and_text(docs, id_col, text_col), ["id"], MADE, scan)


def linked(found: DataFrame, scope: int = 512) -> DataFrame:
    """(key, links): the weak candidates of each key that a complementary part stands near."""
    group = F.when(F.col("p.kind").isin(1, 3), "identifier").when(F.col("p.kind") == 5, "endpoint").otherwise("secret")
    weak = found.where(F.col("key").isNotNull()).dropDuplicates(["key"])
    parts = weak.select("key", F.explode(F.concat("base", "weak")).alias("p")).select(
        "key", group.alias("part"), F.col("p.kind").alias("kind"), F.col("p.start").alias("start"), F.col("p.end").alias("end")
    )
    # a part lies in the blocks that it touches; the other side looks one scope further to either side
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    near = parts.select("key", "part", "start", "end", blocks(F.col("start"), F.col("end")).alias("block")).alias("n")
    asks = (
        parts.where("kind >= 3")
        .select("*", blocks(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("block"))
        .alias("a")
    )
    complementary = ((F.col("a.part") == "secret") & (F.col("n.part") != "secret")) | (
        (F.col("a.part") != "secret") & (F.col("n.part") == "secret")
    )
    apart = F.greatest(F.col("n.start") - F.col("a.end"), F.col("a.start") - F.col("n.end"))
    hits = asks.join(
        near,
        (F.col("a.key") == F.col("n.key")) & (F.col("a.block") == F.col("n.block")) & complementary & (apart <= scope),
        "left_semi",
    )
    return hits.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("links"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 512) -> DataFrame:
    """One row per input row: id, counts of strong spans, their digest, all ``spans`` and the number of linked ones."""
    found = materialize(candidates(docs, id_col, text_col), "secrets")
    links = linked(found, scope)
    plain = found.where(F.col("key").isNull()).withColumn("links", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)"))
    rest = found.where(F.col("key").isNotNull()).join(links, "key", "left").select(*found.columns, "links")
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    by_start = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    spans = F.array_sort(F.transform(F.concat("base", F.coalesce("links", none)), by_start))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return plain.unionByName(rest).select(
        F.col("id").alias(id_col),
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.array_join(shown, ",").alias("spans"),
        F.size(F.coalesce("links", none)).cast("long").alias("n_linked"),
    )
