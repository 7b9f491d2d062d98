"""What of a file to show: the declarations around its hits, else lines around them, until a budget is full; what evidence a page's records have."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.functions import calls, java, scan
from cairn.operators.extract import scanned
from cairn.operators.select import innermost, merged_intervals
from cairn.plans.durable import materialize, spread

if TYPE_CHECKING:
    import pandas as pd

JOINT = "\n\n...\n\n"


def _java_blocks(text: str) -> list[tuple[int, int]]:
    return [(d.start, d.stop) for d in java.Source(text).declarations if d.body]


def _script_blocks(text: str) -> list[tuple[int, int]]:
    """Named functions from the line that they begin on to their closing brace."""
    out = []
    for at, _ in calls.script_functions(text):
        head = text.rfind("\n", 0, at) + 1
        at = scan.close_of(text, at - 1) if text[at - 1] == "(" else at - (text[at - 1] == "{")
        brace = scan.re.compile(r"[^;{]*\{").match(text, at)
        if brace:
            out.append((head, scan.close_of(text, brace.end() - 1)))
    return out


def declaration_blocks(files: DataFrame) -> DataFrame:
    """(path, start, stop): declarations with a body, nested ones too, by their brackets; offsets count from 0."""
    one = scanned(files.where("path like '%.java'"), ["path"], "start int, stop int", _java_blocks)
    return one.unionByName(scanned(files.where(F.col("path").rlike(r"\.[jt]sx?\z")), ["path"], "start int, stop int", _script_blocks))


def found_places(files: DataFrame, pattern: str) -> DataFrame:
    """(path, at): the offset of each match of a Python pattern."""
    return scanned(files, ["path"], "at int", lambda text: [(m.start(),) for m in scan.re.finditer(pattern, text)])


def focused_windows(files: DataFrame, hits: DataFrame, before: int = 8, after: int = 18, gap: int = 2, lines_gap: int = 3) -> DataFrame:
    """(path, start, stop, form): what to show of each file with hits (path, at); offsets in characters.

    A hit shows the smallest declaration around it; declarations at most
    ``gap`` characters apart are one. In files where no hit stands in a
    declaration whole lines around the hits are shown, windows with at most
    ``lines_gap`` lines between them as one.
    """
    hits = materialize(hits.select("path", "at"), "hits")  # hits and declarations are read twice, the files are scanned once for them
    blocks = innermost(hits, declaration_blocks(files), ["path"], "at", "start", "stop")
    merged = merged_intervals(blocks.select("path", "start", "stop"), ["path"], "start", "stop", F.lit(gap)).withColumn("form", F.lit("declaration"))
    merged = materialize(merged, "declarations")
    rest = hits.join(merged.select("path").distinct(), "path", "left_anti")
    lines = F.split("content", "\n")
    placed = rest.join(files.select("path", "content"), "path").select("path", F.size(F.split(F.left("content", F.col("at")), "\n")).alias("line"), F.size(lines).alias("lines"))
    spans = placed.select("path", F.greatest(F.col("line") - before, F.lit(1)).alias("start"), F.least(F.col("line") + after, F.col("lines")).alias("stop"))
    windows = merged_intervals(spans, ["path"], "start", "stop", F.lit(lines_gap)).join(files.select("path", "content"), "path")
    upto = lambda n: F.length(F.array_join(F.slice(lines, F.lit(1), n), "\n"))
    begin = F.when(F.col("start") > 1, upto(F.col("start") - 1) + 1).otherwise(0)
    windows = windows.select("path", begin.cast("int").alias("start"), upto(F.col("stop")).cast("int").alias("stop"), F.lit("lines").alias("form"))
    return merged.select("path", "start", "stop", "form").unionByName(windows)


def rendered_focus(files: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """(path, ord, form, first_line, last_line, chunk): windows as text under their lines, in order, until a file's budget is full.

    A chunk larger than the whole budget is passed over; the first that no
    longer fits ends the file.
    """
    joined = windows.join(files.select("path", "content"), "path")
    line = lambda at: F.length(F.left("content", at)) - F.length(F.replace(F.left("content", at), F.lit("\n"), F.lit(""))) + 1
    code = F.substring("content", F.col("start") + 1, F.col("stop") - F.col("start"))
    rows = joined.select("path", "start", "form", line(F.col("start")).alias("first_line"), line(F.col("stop")).alias("last_line"), code.alias("code"))
    rows = rows.withColumn("chunk", F.concat(F.lit("[lines "), "first_line", F.lit("-"), "last_line", F.lit("]\n"), "code")).drop("code")
    # a file's windows, of which its content is the bound, lie where the join has put them; totals only grow, so those within the budget come first
    upto = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    fits = rows.where(F.length("chunk") <= most).withColumns({"used": F.sum(F.length("chunk")).over(upto), "ord": F.count(F.lit(1)).over(upto)})
    return fits.where(F.col("used") <= most).select("path", "ord", "form", "first_line", "last_line", "chunk")


# Evidence ------------------------------------------------------------------------------------

#: By group of evidence, the tiers that are tried, and the window's characters before and behind the needle.
GROUPS = {
    "React Page Evidence": (("declaration",), 0, 0),
    "React Interaction Evidence": (("declaration", "element"), 0, 0),
    "React Route Evidence": (("window",), 500, 1000),
    "React API Client Evidence": (("declaration", "window"), 700, 1200),
    "BFF Endpoint Evidence": (("method",), 0, 0),
    "BFF Service Evidence": (("method",), 0, 0),
    "BFF Outbound Client Evidence": (("method",), 0, 0),
    "Backend Endpoint Evidence": (("method",), 0, 0),
    "Backend Service Evidence": (("method",), 0, 0),
    "Repository Evidence": (("method",), 0, 0),
    "Entity / DTO / Validation Evidence": (("field", "type"), 0, 0),
}
#: Groups whose later tiers are tried only where the ones before find nothing; the others join what all tiers find.
FIRST_WINS = {"Entity / DTO / Validation Evidence"}


#: The tier that finds a declaration of each kind.
_TIER_OF = {"method": "method", "field": "field", "class": "type", "interface": "type", "enum": "type", "record": "type"}


@lru_cache(maxsize=1)
def _java_spans(text: str) -> dict[tuple[str, str], tuple[int, int]]:
    """The span of the first declaration of each tier and name; those of the last file are kept."""
    spans: dict[tuple[str, str], tuple[int, int]] = {}
    for d in java.Source(text).declarations:
        spans.setdefault((_TIER_OF.get(d.kind, d.kind), d.name), (d.start, d.stop))
    return spans


def _block(tier: str, text: str, symbol: str | None, needle: str | None, before: int, after: int) -> str | None:
    """What one tier finds in a file."""
    if tier == "declaration":
        span = scan.declaration(text, symbol) if symbol else None
    elif tier == "window":
        at = text.find(needle) if needle else -1
        at = text.find(symbol) if at < 0 and symbol else at
        span = (max(0, at - before), min(len(text), at + after)) if at >= 0 else None
    elif tier == "element":
        found = next((r for r in calls.interactions(text) if symbol and scan.re.search(rf"\b{scan.re.escape(symbol)}\b", r[3])), None)
        span = (found[0], scan.close_tag(text, found[0], found[1])) if found else None
    else:
        name = needle if tier == "type" else symbol
        span = _java_spans(text).get((tier, name)) if name else None
    return text[span[0] : span[1]] if span else None


def evidence(files: DataFrame, wanted: DataFrame, most: int = 5000) -> DataFrame:
    """(wanted..., code, confidence, uncertainty) for ``wanted`` (group, path, symbols, needle, confidence, ...).

    A group's tiers say how it is found: a declaration or method by its
    brackets, an element by its handler, a window around the needle. Code of
    several symbols and tiers is joined; a group without any says why. Long
    code is cut, with a mark. The confidence is the record's own, medium where
    it has none; declarations of pages are certain. Records of a file come
    together, so that it is read once for all of them.
    """
    joined = wanted.join(files.select("path", "content"), "path", "left")
    keep = [c for c in wanted.columns if c != "confidence"]
    out = StructType([f for f in wanted.schema if f.name != "confidence"])
    for c in ("confidence", "code", "uncertainty"):
        out = out.add(c, "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            made = []
            for group, symbols, needle, level, text, path in zip(*[batch[c] for c in ("group", "symbols", "needle", "confidence", "content", "path")], strict=True):
                tiers, before, after = GROUPS[group]
                names = [s for s in (symbols if symbols is not None else []) if s]
                blocks: list[str] = []
                for tier in tiers if text else ():
                    if group in FIRST_WINS and blocks:
                        break
                    for symbol in (names[:1] or [None]) if tier in ("window", "type") else names:
                        block = _block(tier, text, symbol, needle, before, after)
                        if block and block not in blocks:
                            blocks.append(block)
                code = JOINT.join(blocks)
                why = None if code else f"{group}: {path} is not readable." if not text else f"{group}: {'|'.join(names) or needle} was not found in {path}."
                given = level if level in ("high", "low") else "medium"
                made.append(("high" if group == "React Page Evidence" else given, (code if len(code) <= most else code[:most] + "\n[SNIPPET_TRUNCATED]") or None, why))
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame(made, columns=["confidence", "code", "uncertainty"], dtype=object)], axis=1)

    together = spread(joined.select(*wanted.columns, "content"), "path").sortWithinPartitions("path")
    return together.mapInPandas(run, out)


def packed_evidence(found: DataFrame, by: str, most: int, heading: Column, share: float = 0.72, least: int = 3000, of_group: int = 4) -> DataFrame:
    """``found`` (by, group, ord, code, confidence, ...) with ``chosen``: included, over-budget, or not among the group's first four.

    Groups come in their fixed order, a group's snippets by confidence, at most
    ``of_group``. Exact snippets may take ``share`` of ``most`` (at least
    ``least``) characters, ``heading`` included; one that doesn't fit is left
    out and the next is tried. A page has a few dozen candidates, which the
    fold holds.
    """
    from cairn.operators.select import admitted, priority, top_k

    found = materialize(found, "evidence")  # it is read twice
    rank = priority(F.col("confidence"), ["high", "medium", "low"])
    rows = found.where("code is not null").withColumn("__size", (F.length("code") + F.length(heading)).cast("bigint"))
    few = top_k(rows, [by, "group"], [rank, F.col("ord")], of_group).withColumn("__place", priority(F.col("group"), list(GROUPS)) * of_group + F.col("rank"))
    taken = admitted(few.select(by, "__place", "__size"), [by], "__place", "__size", max(least, int(most * share)), at_most=len(GROUPS) * of_group)
    chosen = few.join(taken.withColumn("__in", F.lit(True)), [by, "__place"], "left").select(by, "group", "ord", F.when(F.col("__in"), "included").otherwise("over-budget").alias("chosen"))
    return found.join(chosen, [by, "group", "ord"], "left").withColumn("chosen", F.coalesce("chosen", F.when(F.col("code").isNotNull(), "not-first").otherwise("missing")))
