"""Markdown documents as section tables: splitting, gaps, repair, ledgers and scores.

A coverage without a denominator is null, never zero: it adds nothing to a
score and costs a penalty of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import heading_name, source_references
from cairn.operators.select import first_wins, messages, packed, priority, sequential_budget, top_k
from cairn.plans.durable import materialize

PLACEHOLDER = r"(?i)\A\s*(tbd|todo|n/?a|none|-|\.\.\.)?\s*\z"
NOT_VISIBLE = r"(?i)(not visible|not available|could not be determined|unknown)"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"\A\s+|\s+\z", "")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, heading, name, body) of the ## sections; what stands before the first one has no heading."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?m)^(?=##\s)")
    rows = docs.select(F.col(id_col), F.posexplode(parts).alias("ord", "part"))
    heading = F.regexp_extract("part", r"\A##\s+([^\r\n]*)", 1)
    out = rows.select(id_col, "ord", F.trim(heading).alias("heading"), F.regexp_replace("part", r"\A##\s[^\n]*\n?", "").alias("body"))
    return out.withColumn("name", heading_name("heading")).where((F.col("name") != "") | (F.trim("body") != ""))


def merged_sections(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document and heading: bodies of repeated headings joined in order, the first spelling kept."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "heading", "body")))
    by = rows.groupBy(id_col, "name").agg(parts.alias("p"))
    return by.select(id_col, "name", F.col("p")[0]["ord"].alias("ord"), F.col("p")[0]["heading"].alias("heading"), F.array_join(F.col("p")["body"], "\n").alias("body"))


def evidence_for(section: Column) -> Column:
    """Where to look for what a section lacks; the first keyword decides."""
    rules = [("api|endpoint", "api-calls"), ("param|valid", "parameters"), ("service|repositor", "services"), ("entit|table|data", "entities"), ("user|page|screen", "components")]
    chain = F.lit("page-flow")
    for keys, kind in reversed(rules):
        chain = F.when(section.rlike(keys), kind).otherwise(chain)
    return chain


def _expected(docs: DataFrame, headings: list[str], id_col: str) -> DataFrame:
    """(id, place, heading, name): every document with each of the headings."""
    listed = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(h).alias("heading")) for k, h in enumerate(headings)])
    rows = docs.select(id_col).distinct().select(id_col, F.explode(listed).alias("__h"))
    return rows.select(id_col, F.col("__h.place").alias("place"), F.col("__h.heading").alias("heading"), heading_name("__h.heading").alias("name"))


def find_gaps(rows: DataFrame, required: list[str], least_references: int = 3, id_col: str = "doc_id", parameters: str = "param") -> DataFrame:
    """(id, section, gap_type, severity): required sections that are empty (high), unresolved phrases (medium),
    parameter sections without a source reference (medium), too few references in a document (high)."""
    merged = merged_sections(rows, id_col)
    held = _expected(merged, required, id_col).join(merged.select(id_col, "name", "body"), [id_col, "name"], "left")
    gap = lambda df, section, kind, severity: df.select(id_col, section.alias("section"), F.lit(kind).alias("gap_type"), F.lit(severity).alias("severity"))
    empty = gap(held.where(F.col("body").isNull() | F.col("body").rlike(PLACEHOLDER)), F.col("name"), "empty-section", "high")
    unresolved = gap(merged.where(F.col("body").rlike(NOT_VISIBLE)), F.col("name"), "not-visible", "medium")
    unsourced = gap(merged.where(F.col("name").rlike(parameters) & (F.size(source_references("body")) == 0)), F.col("name"), "parameter", "medium")
    few = merged.groupBy(id_col).agg(F.sum(F.size(source_references("body"))).alias("n")).where(F.col("n") < least_references)
    return empty.unionByName(unresolved).unionByName(unsourced).unionByName(gap(few, F.lit("document"), "source-reference", "high"))


#: Gaps that a repair can close.
ACTIONABLE = ["empty-section", "match", "service", "parameter", "source-reference"]


def actionable_gaps(gaps: DataFrame, id_col: str = "doc_id", grounded_in: DataFrame | None = None, excluded: str = "uncertainties") -> DataFrame:
    """Gaps worth a repair: not low, of an actionable kind, not in the section of uncertainties, and in a grounded section (id, section) if these are given."""
    kept = gaps.where((F.col("severity") != "low") & F.col("gap_type").isin(ACTIONABLE) & (heading_name("section") != heading_name(F.lit(excluded))))
    return kept if grounded_in is None else kept.join(grounded_in.select(id_col, "section").distinct(), [id_col, "section"], "left_semi")


def gap_order() -> list[Column]:
    """Repair order: severity, kind of gap, section."""
    kinds = ["empty-section", "match", "service", "parameter", "source-reference"]
    return [priority(F.col("severity"), ["high", "medium", "low"]), priority(F.col("gap_type"), kinds), F.col("section")]


def gap_plan(gaps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_gaps, sections, evidence): what a repair of the document has to look at."""
    sorted_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return gaps.where("severity <> 'low'").groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_gaps"), sorted_set(F.col("section")).alias("sections"), sorted_set(evidence_for(F.col("section"))).alias("evidence")
    )


def merge_repairs(old: DataFrame, repairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, name, body, lost): repaired sections replace their old ones (the first repair wins), others stay, new ones are added.

    ``lost`` holds the source references of the old body that the repair dropped.
    """
    once = first_wins(repairs.select(id_col, "name", "ord", "body"), [id_col, "name"], "ord")
    o, r = merged_sections(old, id_col).alias("o"), once.alias("r")
    both = o.join(r, (F.col(f"o.{id_col}") == F.col(f"r.{id_col}")) & (F.col("o.name") == F.col("r.name")), "full")
    replaced = F.col("r.body").isNotNull() & F.col("o.body").isNotNull()
    lost = F.when(replaced, F.array_except(source_references("o.body"), source_references("r.body"))).otherwise(F.expr("cast(array() as array<string>)"))
    return both.select(
        F.coalesce(f"o.{id_col}", f"r.{id_col}").alias(id_col),
        F.coalesce("o.name", "r.name").alias("name"),
        F.coalesce("r.body", "o.body").alias("body"),
        lost.alias("lost"),
    )


def relevant_text(docs: DataFrame, targets: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text", seen: int = 1200) -> DataFrame:
    """(id, text): the sections that are targets (id, heading) or mention a keyword (id, word) in their beginning; the whole text where none does."""
    s = sections(docs, id_col, text_col).where("heading <> ''").withColumn("section", F.concat(F.lit("## "), "heading", F.lit("\n"), F.rtrim("body")))
    named = s.join(targets.select(id_col, heading_name("heading").alias("name")).distinct(), [id_col, "name"], "left_semi")
    start = F.lower(F.concat_ws("\n", "heading", F.left("section", F.lit(seen))))
    found = s.withColumn("__start", start).join(keywords.select(id_col, F.lower("word").alias("word")).distinct(), id_col).where(F.col("__start").contains(F.col("word")))
    chosen = named.select(id_col, "ord", "section").union(found.select(id_col, "ord", "section")).distinct()
    texts = chosen.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "section")))["section"], "\n\n").alias("__chosen"))
    return docs.select(id_col, text_col).join(texts, id_col, "left").select(id_col, F.coalesce("__chosen", text_col).alias(text_col))


def repair_groups(targets: DataFrame, canonical: list[str], per_request: int, id_col: str = "doc_id") -> DataFrame:
    """(id, group, name): a document's target sections (id, heading), each once, in canonical order with unknown ones last, ``per_request`` a group."""
    names = targets.sparkSession.createDataFrame([(h,) for h in canonical], "h string").select(heading_name("h").alias("n")).collect()  # the canonical list
    place = priority(F.col("name"), [r["n"] for r in names])
    once = targets.select(id_col, heading_name("heading").alias("name")).where("name <> ''").distinct()
    by = once.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "name"))).alias("s"))  # a document's sections
    return by.select(id_col, F.posexplode("s").alias("k", "s")).select(id_col, (F.floor(F.col("k") / per_request) + 1).alias("group"), F.col("s.name").alias("name"))


def canonical_repairs(repairs: DataFrame, targets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, name, body, missing): each target section (id, name) with the distinct bodies that a repair gave it, in order."""
    some = repairs.withColumn("body", _stripped(F.col("body"))).where("body <> ''").groupBy(id_col, "name", "body").agg(F.min("ord").alias("ord"))
    bodies = some.groupBy(id_col, "name").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "body")))["body"], "\n\n").alias("body"))
    return targets.select(id_col, "name").distinct().join(bodies, [id_col, "name"], "left").withColumn("missing", F.col("body").isNull())


def canonical_document(rows: DataFrame, canonical: list[str], warnings: DataFrame | None = None, id_col: str = "doc_id", most: int = 8000, placeholder: str = "Not visible.") -> DataFrame:
    """(id, place, heading, body): every canonical section of each document, a placeholder where it has none; warnings (id, warning) end the last one."""
    merged = merged_sections(rows, id_col)
    out = _expected(merged, canonical, id_col).join(merged.select(id_col, "name", "body"), [id_col, "name"], "left")
    body = F.coalesce(F.nullif(_stripped(F.col("body")), F.lit("")), F.lit(placeholder))
    out = out.withColumn("body", body)
    if warnings is not None:
        text = F.left(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "warning"))), "\n"), F.lit(most))
        out = out.join(warnings.groupBy(id_col).agg(text.alias("__w")), id_col, "left")
        last = (F.col("place") == len(canonical) - 1) & F.col("__w").isNotNull()
        out = out.withColumn("body", F.when(last, F.concat_ws("\n", "body", "__w")).otherwise(F.col("body")))
    return out.select(id_col, "place", "heading", "body")


def heading_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, block): a text cut before each ## heading that follows a blank line."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n\n(?=## )")).alias("ord", "block"))


def outline(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, level, heading): the headings of levels 1 to 3 that stand outside code fences.

    Of a document's own lines those between an odd fence and the next are code.
    """
    line = F.struct(F.regexp_extract("x", r"^(#{1,3})\s+\S", 1).alias("mark"), F.regexp_extract("x", r"^#{1,3}\s+(.*?)\s*$", 1).alias("heading"), F.col("x").rlike(r"^\s*(```|~~~)").alias("fence"))
    rows = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n")).alias("line", "x")).select(id_col, "line", line.alias("l"))
    kept = rows.where("l.mark <> '' or l.fence")
    by = kept.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("line", "l"))).alias("lines"))
    fences = F.filter("lines", lambda x: x["l"]["fence"])
    outside = F.filter("lines", lambda x: ~x["l"]["fence"] & (F.size(F.filter(F.col("fences"), lambda f: f["line"] < x["line"])) % 2 == 0))
    found = by.withColumn("fences", fences).select(id_col, F.explode(outside).alias("h"))
    return found.select(id_col, F.col("h.line").alias("line"), F.length("h.l.mark").alias("level"), F.col("h.l.heading").alias("heading"))


# Ledgers: (id, heading, kind, ord, text), kind one of finding, reference, uncertainty ----


def normal_ledger(items: DataFrame, headings: list[str], id_col: str = "doc_id") -> DataFrame:
    """Items under canonical headings, trimmed, each once, the first one's ordinal kept."""
    spark = items.sparkSession
    canon = spark.createDataFrame([(k, h) for k, h in enumerate(headings)], "place int, canonical string").withColumn("name", heading_name("canonical"))
    named = items.withColumn("name", heading_name("heading")).withColumn("text", F.trim("text")).where("text <> ''")
    joined = named.join(F.broadcast(canon), "name")
    return joined.groupBy(id_col, "place", F.col("canonical").alias("heading"), "kind", "text").agg(F.min("ord").alias("ord"))


def grounded(ledger: DataFrame, sources: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """References stay if they stand in the source text (id, content); findings of a section without any become uncertainties."""
    refs = ledger.where("kind = 'reference'").join(sources, id_col)
    kept = refs.where(F.col("content").contains(F.col("text"))).select(ledger.columns)
    backed = kept.select(id_col, "heading").distinct().withColumn("__backed", F.lit(True))
    rest = ledger.where("kind <> 'reference'").join(backed, [id_col, "heading"], "left")
    kind = F.when((F.col("kind") == "finding") & F.col("__backed").isNull(), "uncertainty").otherwise(F.col("kind"))
    return rest.withColumn("kind", kind).select(ledger.columns).unionByName(kept)


def demoted(ledger: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings of a section without any reference become uncertainties; references are taken as they are."""
    backed = ledger.where("kind = 'reference'").select(id_col, "heading").distinct().withColumn("__backed", F.lit(True))
    kind = F.when((F.col("kind") == "finding") & F.col("__backed").isNull(), "uncertainty").otherwise(F.col("kind"))
    return ledger.join(backed, [id_col, "heading"], "left").withColumn("kind", kind).select(ledger.columns)


def split_ledger(ledger: DataFrame, most: int, id_col: str = "doc_id", share: float = 0.3) -> DataFrame:
    """``ledger`` with ``part``: a document's items packed by section and order into parts of at most ``most`` characters.

    References repeat in every part of their section, as far as ``share`` of
    the room goes; findings and uncertainties fill what is left.
    """
    room = int(most * share)
    refs = sequential_budget(ledger.where("kind = 'reference'").withColumn("__n", F.length("text")), [id_col, "place"], "ord", "__n", room)
    kept = refs.where("taken = __n").drop("__n", "taken")
    rest = ledger.where("kind <> 'reference'").withColumns({"__n": F.length("text"), "__o": F.col("place") * 1_000_000_000 + F.col("ord")})
    parts = packed(rest, [id_col], "__o", "__n", most - room, 1)
    items = rest.join(parts.dropDuplicates([id_col, "__o"]), [id_col, "__o"]).withColumnRenamed("chunk", "part").select(*ledger.columns, "part")
    shared = kept.join(items.select(id_col, "place", "part").distinct(), [id_col, "place"]).select(*ledger.columns, "part")
    return items.unionByName(shared)


def projected(ledger: DataFrame, requested: list[str], spine: list[str], aggregates: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """(id, heading, kind, text, ord): what a writer of the ``requested`` headings sees of a ledger.

    Items of requested headings and of the ``spine``, which goes through all
    layers, stay as they are. A requested heading that ``aggregates`` names for
    a kind holds that kind's items of the whole document instead, each once.
    """
    gathered = {kind: heading for kind, heading in aggregates.items() if heading in requested}
    shown = [h for h in [*requested, *spine] if h not in gathered.values()]
    out = ledger.where(F.col("heading").isin(shown)).select(id_col, "heading", "kind", "text", "ord")
    for kind, heading in gathered.items():
        once = ledger.where(F.col("kind") == kind).groupBy(id_col, "text").agg(F.min("ord").alias("ord"))
        out = out.unionByName(once.select(id_col, F.lit(heading).alias("heading"), F.lit(kind).alias("kind"), "text", "ord"))
    return out


def section_groups(place: Column, size: int, halved: int = 0) -> Column:
    """A section's group of ``size`` neighbours; each failure for size halves it."""
    return F.floor(place / max(1, size >> halved)).cast("bigint")


def reduce_until(ledgers: DataFrame, by: list[str], ordinal: str, most: int, fan_in: int = 8, levels: int = 3) -> DataFrame:
    """Levels of :func:`reduce_ledgers` until one ledger is left of each group, or a level brings none below ``most`` characters together, ``levels`` at most."""
    for _ in range(levels):
        merged = materialize(reduce_ledgers(ledgers, by, ordinal, fan_in), "ledgers")
        state = merged.groupBy(*by).agg(F.countDistinct(ordinal).alias("n"), F.sum(F.length("text")).alias("size")).agg(F.max("n").alias("n"), F.max("size").alias("size")).first()
        ledgers = merged
        if (state["n"] or 1) <= 1 or (state["size"] or 0) > most * (state["n"] or 1):
            break
    return ledgers


def grounded_sections(ledger: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, heading) with at least one finding and one reference."""
    by = ledger.groupBy(id_col, "heading").agg(F.bool_or(F.col("kind") == "finding").alias("f"), F.bool_or(F.col("kind") == "reference").alias("r"))
    return by.where("f and r").select(id_col, "heading")


def reduce_ledgers(ledgers: DataFrame, by: list[str], ordinal: str, fan_in: int = 8) -> DataFrame:
    """One level of a tree reduction: items of ``fan_in`` neighbouring ledgers become one ledger's, repeated items once."""
    rest = [c for c in ledgers.columns if c not in (ordinal, "ord")]
    level = ledgers.withColumn(ordinal, F.floor(F.col(ordinal) / fan_in).cast("bigint"))
    return level.groupBy(ordinal, *rest).agg(F.min("ord").alias("ord"))


# Scores ---------------------------------------------------------------------------------

#: Parts of a page's score and their weights, 100 in all.
WEIGHTS = {
    "sections": 20, "references": 12, "ui_api": 12, "bff_match": 8, "be_match": 6, "service_flow": 7, "parameters": 7, "validations": 5,
    "repositories": 5, "entities": 4, "gaps": 4, "high_gaps": 2, "interactions": 2, "diagram": 1, "length": 5,
}


def share(part: Column, whole: Column) -> Column:
    """part / whole, or null where there is nothing to cover."""
    return F.when(whole > 0, part.cast("double") / whole)


def coverage_score(parts: dict[str, Column], weights: dict[str, int], n_stale: Column = None) -> Column:
    """0 to 100: weighted shares, less 2 for each unknown part and each stale input (12 and 10 at most)."""
    scale = 100.0 / sum(weights[k] for k in parts)
    total = sum((F.coalesce(c, F.lit(0.0)) * float(weights[k]) for k, c in parts.items()), F.lit(0.0)) * scale
    unknown = sum((F.when(c.isNull(), 1).otherwise(0) for c in parts.values()), F.lit(0))
    stale = n_stale if n_stale is not None else F.lit(0)
    score = F.floor(total - F.least(2 * unknown, F.lit(12)) - F.least(2 * stale, F.lit(10)) + 0.5)
    return F.greatest(F.least(score, F.lit(100)), F.lit(0)).cast("bigint")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")


def length_score(chars: Column) -> Column:
    return F.when(chars < 2000, 0.0).when(chars < 6000, 0.5).otherwise(1.0)


def mention_coverage(terms: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_terms, n_mentioned): how many of a document's own terms (id, term) of two and more characters stand in its text."""
    pairs = terms.where(F.length("term") >= 2).join(docs.select(id_col, F.lower("text").alias("text")), id_col)
    return pairs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("text").contains(F.lower("term"))).alias("n_mentioned"))


def record_coverage(values: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_records, n_mentioned, coverage): records (id, record, value) with any value of two or more characters in their document's text; coverage is null without records."""
    known = values.join(docs.select(id_col, F.lower("text").alias("text")), id_col)
    said = (F.length("value") >= 2) & F.col("text").contains(F.lower("value"))
    by = known.groupBy(id_col, "record").agg(F.coalesce(F.bool_or(said), F.lit(False)).alias("said"))
    counts = by.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_records"), F.count_if("said").alias("n_mentioned"))
    return docs.select(id_col).join(counts, id_col, "left").select(id_col, F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_mentioned", F.lit(0)).alias("n_mentioned"), share(F.col("n_mentioned"), F.col("n_records")).alias("coverage"))


#: What a document's linter counts, by name.
COUNTED = {
    "n_references": r"src[\\/][^\s)`]+?\.(?:java|kt|tsx|ts|jsx|js|properties|yaml|yml|json)",
    "n_endpoints": r"(?i)\b(?:GET|POST|PUT|PATCH|DELETE)\s+/[A-Za-z0-9_{}:/.$?=&-]+|@(?:Get|Post|Put|Patch|Delete|Request)Mapping\b",
    "n_bff": r"(?i)\bBFF\b",
    "n_backend": r"(?i)\b(?:BE|Backend)\b",
    "n_flows": r"(?i)(?:UI\s*(?:->|→|to|-)\s*BFF|BFF\s*(?:->|→|to|-)\s*(?:BE|Backend)|(?:servis|service)\s*(?:->|→|to|-)\s*(?:repository|repozitory))",
    "n_repositories": r"(?i)\b(?:Repository|repozitory)\b",
    "n_entities": r"(?i)\b(?:Entity|table|tablo)\b",
}


def _edged(pattern: str) -> str:
    """A word's edge by ASCII letters, before what opens a pattern and behind what ends it; Java's own sees letters with accents as well."""
    return pattern.replace(r"(?i)\b", r"(?i)(?<!\w)").replace(r"\b", r"(?!\w)")


def assess(text: Column) -> dict[str, Column]:
    """Counts that a document linter reports."""
    count = lambda p: F.regexp_count(text, F.lit(_edged(p))).cast("bigint")
    titles = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^##\s+([^\n]*)$"), F.lit(1)), lambda t: heading_name(t))
    references = F.regexp_extract_all(text, F.lit(COUNTED["n_references"]), F.lit(0))
    return {
        "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint"),
        "n_words": count(r"\S+"),
        "n_unresolved": count(NOT_VISIBLE),
        **{name: F.size(references).cast("bigint") if name == "n_references" else count(pattern) for name, pattern in COUNTED.items()},
        "n_sources": F.size(F.array_distinct(references)).cast("bigint"),
        "n_headings": count(r"(?m)^#{1,3}\s+\S"),
        "n_duplicates": (F.size(titles) - F.size(F.array_distinct(titles))).cast("bigint"),
        "n_empty": count(r"(?m)^##\s[^\n]*\n(?:\s*\n)*(?=##\s|\z)"),
        "has_diagram": text.rlike(r"(?i)```[ \t]*(?:plantuml|mermaid)|@startuml"),
    }


def score_differences(n_references: Column, n_chars: Column, told_references: Column, told_chars: Column) -> Column:
    """What a stored score says otherwise than its document: consistent, or the differences; null figures are missing ones."""
    one = lambda told, n, name, what: F.when(told.isNull(), f"{name} missing from score").when(told != n, F.concat(F.lit(f"{what} file="), n.cast("string"), F.lit(", score="), told.cast("string")))
    found = F.filter(F.array(one(told_references, n_references, "references", "references"), one(told_chars, n_chars, "length", "length")), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, "consistent").otherwise(F.concat(F.lit("mismatch: "), F.array_join(found, "; ")))


def recommended_actions(unclear_calls: Column, unclear_outbound: Column, open_flows: Column) -> Column:
    """What to do about a traceability report: one sentence for each kind of open place, else that nothing is left."""
    texts = messages(
        (unclear_calls > 0, "Clarify the path constants and owners of calls that match no endpoint or match one weakly."),
        (unclear_outbound > 0, "Review target, method and path of outbound calls that match no endpoint or match one weakly."),
        (open_flows > 0, "Close the uncertainties of partial page flows with source evidence."),
    )
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit("All local matches are complete; have rules and permissions confirmed before publishing.")))


def analysis_warnings(counts: dict[str, Column]) -> Column:
    """(level, message) of an analysis: ``counts`` of controllers, endpoints, unclassified, unclear_paths, unparsed, lone_controllers, lone_services."""
    c = counts
    text = lambda n, rest: F.concat(n.cast("string"), F.lit(f" {rest}"))
    rules = [
        ("warning", c["controllers"] == 0, F.lit("no controller found")), ("warning", c["endpoints"] == 0, F.lit("no endpoint found")), ("warning", c["unclassified"] > 0, text(c["unclassified"], "files of unknown kind")),
        ("action", c["unclassified"] > 0, F.lit("check package, annotations and names of files of unknown kind")), ("action", c["unclear_paths"] > 0, F.lit("review endpoints with a missing or unclear path")),
        ("action", c["unparsed"] > 0, F.lit("review signatures whose parameters were not parsed")), ("action", c["lone_controllers"] > 0, F.lit("review controllers without a service")),
        ("action", c["lone_services"] > 0, F.lit("review services without a repository or client")),
    ]
    made = F.filter(F.array(*[F.when(test, F.struct(F.lit(level).alias("level"), message.alias("message"))) for level, test, message in rules]), lambda x: x.isNotNull())
    rest = F.array(F.struct(F.lit("action").alias("level"), F.lit("have the results reviewed").alias("message")))
    return F.when(F.exists(made, lambda x: x["level"] == "action"), made).otherwise(F.concat(made, rest))


def score_agrees(score: Column, n_unresolved: Column, n_empty: Column) -> Column:
    """A high score goes with few open places, a low one with some."""
    return F.when(score >= 75, (n_unresolved + n_empty) <= 3).when(score < 45, (n_unresolved + n_empty) > 0).otherwise(True)


def artifact_rating(n: Column, n_weak: Column, least: int = 1) -> Column:
    """missing, empty, weak or good."""
    return F.when(n.isNull(), "missing").when(n == 0, "empty").when((n_weak > 0) | (n < least), "weak").otherwise("good")


#: What a finding costs a repository's score.
FINDING_COSTS = {"critical": 10, "warning": 4, "info": 1}


def cross_findings(counts: dict[str, Column]) -> Column:
    """(severity, message) of the rules over table sizes that hold, in order.

    ``counts``: calls, matches, outbound, outbound_matches, unresolved,
    unknown_pages, partial_flows, nodes, edges, semantics.
    """
    c = counts
    text = lambda n, rest: F.concat(n.cast("string"), F.lit(f" {rest}"))
    rules = [
        ("critical", (c["calls"] > 0) & (c["matches"] == 0), F.lit("calls without any match")),
        ("critical", (c["outbound"] > 0) & (c["outbound_matches"] == 0), F.lit("outbound calls without any match")),
        ("warning", c["unresolved"] > 0, text(c["unresolved"], "unresolved matches")),
        ("warning", c["unknown_pages"] > 0, text(c["unknown_pages"], "flows of an unknown page")),
        ("warning", c["partial_flows"] > 0, text(c["partial_flows"], "partial flows")),
        ("warning", (c["nodes"] > 0) & (c["edges"] > 0) & (c["edges"] / c["nodes"] < 0.5), F.lit("low edge density")),
        ("info", c["semantics"] == 0, F.lit("no semantic records")),
    ]
    made = [F.when(test, F.struct(F.lit(severity).alias("severity"), message.alias("message"))) for severity, test, message in rules]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def findings_cost(findings: Column) -> Column:
    """What an array of findings takes off a repository's score."""
    cost = lambda f: sum((F.when(f["severity"] == s, n).otherwise(0) for s, n in FINDING_COSTS.items()), F.lit(0))
    return F.aggregate(findings, F.lit(0), lambda total, f: total + cost(f)).cast("bigint")


def offending_rows(rules: list[tuple[str, DataFrame, str, Column]]) -> DataFrame:
    """(rule, key): the rows that break a rule, from (name, rows, key column, what breaks it); their counts are a ``groupBy`` away."""
    out = None
    for name, rows, key, broken in rules:
        part = rows.where(broken).select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def report(rows: DataFrame, by: list[str], order: list[str], line: Column, title: Column, most: int = 100) -> DataFrame:
    """(by, text): a Markdown list under a title for each group, its first ``most`` lines in order and how many there are more."""
    numbered = top_k(rows.withColumn("__line", F.concat(F.lit("- "), line)), by, [F.col(c) for c in order], most)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    lists = numbered.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "__line")))["__line"].alias("__lines"))
    more = F.when(F.col("__n") > most, F.array(F.concat(F.lit("- and "), (F.col("__n") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("## "), title), F.lit("")), "__lines", more), "\n")
    return lists.join(counts, by).select(*by, text.alias("text"))


def repository_score(rating: str = "rating", critical: str = "critical", flow: str | None = None) -> Column:
    """Aggregate over artifacts: 100 less what missing and empty critical, empty flow (``flow``) and weak ones cost."""
    r, c, f = F.col(rating), F.col(critical), F.col(flow) if flow else F.lit(True)
    cost = F.when((r == "missing") & c, 12).when((r == "empty") & c, 15).when((r == "empty") & f, 6).when(r == "weak", 4).otherwise(0)
    return F.greatest(F.least(100 - F.sum(cost), F.lit(100)), F.lit(0)).cast("bigint")


def score_grade(score: Column) -> Column:
    return F.when(score >= 85, "good").when(score >= 65, "needs-attention").otherwise("poor")
