"""Packing texts into budgets: excerpts with audit, weighted assembly, blocks, chunks, adaptive splits, snippet windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import mask_secrets, safe_name
from cairn.operators.select import first_wins, merged_intervals, part_of, sequential_budget
from cairn.plans.running import same_group


def budgeted_texts(sections: DataFrame, by: list[str], order: str, text: str, most: int, marker: str = "\n...[truncated]") -> DataFrame:
    """``sections`` with ``sent`` and ``status``: each takes what its predecessors leave of ``most`` characters.

    The one that doesn't fit is cut and marked (the mark comes on top), those
    behind it are left out; every section has a row, so the result is the audit.
    """
    sized = sequential_budget(sections.withColumn("__n", F.length(F.coalesce(text, F.lit("")))), by, order, "__n", most)
    cut = F.col("taken") < F.col("__n")
    sent = F.when(~cut, F.coalesce(text, F.lit(""))).when(F.col("taken") > 0, F.concat(F.left(text, F.col("taken").cast("int")), F.lit(marker))).otherwise("")
    status = F.when(~cut, "included").when(F.col("taken") > 0, "truncated").otherwise("omitted")
    return sized.withColumn("sent", sent).withColumn("status", status).drop("__n", "taken")


def selection_audit(parts: DataFrame, granted: str = "granted", size: str = "size", stale: str = "stale", enabled: str = "enabled") -> DataFrame:
    """``parts`` with ``selection``: disabled, missing, skipped-stale, omitted-budget, truncated or included, the first that holds."""
    n, g = F.col(size), F.coalesce(granted, F.lit(0))
    chosen = (
        F.when(~F.col(enabled), "disabled").when(n.isNull(), "missing").when(F.col(stale), "skipped-stale")
        .when((g <= 0) & (n > 0), "omitted-budget").when(g < n, "truncated").otherwise("included")
    )
    return parts.withColumn("selection", chosen)


def excerpt(text: Column, room: Column, marker: str = "\n[TRUNCATED]\n", share: float = 0.75) -> Column:
    """At most ``room`` characters: all, or head and tail around a marker, or the bare head where the marker doesn't fit."""
    left = room - len(marker)
    first = F.ceil(left * F.lit(share)).cast("int")
    both = F.concat(F.left(text, first), F.lit(marker), F.right(text, (left - first).cast("int")))
    return F.when(F.length(text) <= room, text).when(left <= 2, F.left(text, F.greatest(room, F.lit(0)).cast("int"))).otherwise(both)


def weighted_rooms(parts: DataFrame, by: list[str], order: str, size: str, weight: str, most: int, separator: int = 7) -> DataFrame:
    """(by, order, room): one pass in order; each part may use its weight's share of what is left, the last one all of it.

    What a part doesn't need goes to those behind it. The fold runs over a
    document's own parts, which its headings bound.
    """
    item = F.struct(F.col(order).alias("o"), F.col(size).cast("bigint").alias("n"), F.col(weight).cast("bigint").alias("w"))
    lists = parts.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum(weight).cast("bigint").alias("weights"), F.count(F.lit(1)).alias("parts"))
    none = F.expr("cast(array() as array<struct<o:bigint,room:bigint>>)")
    start = F.struct(F.lit(most).cast("bigint").alias("left"), F.col("weights").alias("weights"), F.col("parts").alias("rest"), none.alias("rooms"))

    def step(a: Column, x: Column) -> Column:
        first = F.size(a["rooms"]) == 0
        left = a["left"] - F.when(first, 0).otherwise(separator)
        usable = F.greatest(F.lit(0), left - (a["rest"] - 1) * separator)
        room = F.when(a["rest"] == 1, usable).otherwise(F.floor(usable * x["w"] / F.greatest(a["weights"], F.lit(1)))).cast("bigint")
        return F.struct(
            (left - F.least(room, x["n"])).alias("left"), (a["weights"] - x["w"]).alias("weights"), (a["rest"] - 1).alias("rest"),
            F.concat(a["rooms"], F.array(F.struct(x["o"].cast("bigint").alias("o"), room.alias("room")))).alias("rooms"),
        )

    return lists.select(*by, F.explode(F.aggregate("items", start, step)["rooms"]).alias("r")).select(*by, F.col("r.o").alias(order), F.col("r.room").alias("room"))


def evidence_budget(most: int, share: float = 0.72, least: int = 3000) -> int:
    """What exact snippets may take of an evidence pack; roles share the rest."""
    return max(least, int(most * share))


def role_rooms(used: DataFrame, by: list[str], roles: str, most: int, reserve: int = 1200, least: int = 1000) -> DataFrame:
    """(by, room): what a pack leaves for each of its ``roles`` after ``used`` characters."""
    left = F.greatest(F.lit(least), F.lit(most) - F.col("used") - reserve)
    return used.select(*by, F.greatest(F.lit(least), F.floor(left / F.greatest(F.col(roles), F.lit(1)))).cast("bigint").alias("room"))


# Blocks and chunks -----------------------------------------------------------------------------


def json_blocks(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, ord, label, block): one block a top-level key of an object, one an item of an array."""
    parsed = docs.select(id_col, json_col, F.from_json(json_col, "map<string,variant>").alias("fields"), F.from_json(json_col, "array<variant>").alias("items"))
    as_object = F.ltrim(json_col).startswith("{")
    keys = parsed.where(as_object).select(id_col, F.posexplode(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("label"), F.to_json(e["value"]).alias("block"))))).alias("ord", "b"))
    items = parsed.where(~as_object).select(id_col, F.posexplode("items").alias("ord", "v"))
    return keys.select(id_col, "ord", F.col("b.label").alias("label"), F.col("b.block").alias("block")).unionByName(items.select(id_col, "ord", F.concat(F.lit("item "), (F.col("ord") + 1).cast("string")).alias("label"), F.to_json("v").alias("block")))


def line_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, label, block): one block a line that isn't blank."""
    lines = F.filter(F.split(text_col, r"\r?\n"), lambda x: F.trim(x) != "")
    return docs.select(id_col, F.posexplode(lines).alias("ord", "block")).select(id_col, "ord", F.concat(F.lit("line "), (F.col("ord") + 1).cast("string")).alias("label"), "block")


def within(blocks: DataFrame, id_col: str, order: str, text: str, most: int) -> DataFrame:
    """Blocks of at most ``most`` characters: longer ones are cut at line ends, lines that are longer still into pieces.

    (id, order, piece, text). Lines are packed greedily inside their block, an
    array of the block's own lines.
    """
    lines = F.split(text, r"(?<=\n)")
    pieces = F.flatten(F.transform(lines, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / most) - 1, F.lit(0)).cast("int")), lambda k: F.substring(x, k * most + 1, F.lit(most)))))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"))

    def step(a: Column, x: Column) -> Column:
        full = (F.length(a["open"]) > 0) & (F.length(a["open"]) + F.length(x) > most)
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(full, x).otherwise(F.concat(a["open"], x)).alias("open"))

    packed = F.aggregate(pieces, start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    cut = F.when(F.length(text) <= most, F.array(F.col(text))).otherwise(packed)
    return blocks.select(id_col, order, F.posexplode(cut).alias("piece", text))


def identified_chunks(chunks: DataFrame, kind: str, label: str, order: str, text: str) -> DataFrame:
    """(id, part, parts, kind, label, hash, text): masked chunks with an identity, the first of equal kind, label and text.

    The identity is the label's slug, the part's number and the first 12 digits
    of the text's hash; parts are numbered within kind and label.
    """
    masked = chunks.select(F.col(kind).alias("kind"), F.col(label).alias("label"), F.col(order).alias("ord"), mask_secrets(text).alias("text")).withColumn("hash", F.sha2("text", 256))
    once = first_wins(masked, ["kind", "label", "hash"], "ord")
    placed = part_of(once.select("kind", "label", "hash", "ord"), ["kind", "label"], [F.col("ord"), F.col("hash")])
    texts = once.select("kind", "label", "hash", "text")
    joined = placed.alias("p").join(texts.alias("t"), same_group("p", "t", ["kind", "label", "hash"])).select("p.*", "t.text")
    identity = F.concat_ws("-", F.substring(safe_name("label"), 1, 80), F.col("part").cast("string"), F.substring("hash", 1, 12))
    return joined.select(identity.alias("id"), "part", "parts", "kind", "label", "hash", "text")


def _cut(text: Column, least: int) -> Column:
    """Where a text is cut: at the newline nearest its middle that leaves both parts ``least`` characters, else at its middle."""
    n = F.length(text)
    middle = F.floor(n / 2).cast("int")
    before = F.instr(F.reverse(F.left(text, middle + 1)), "\n")
    after = F.locate("\n", F.substring(text, middle + 1, n))
    return F.transform(F.array(F.struct(n.alias("n"), middle.alias("m"), before.alias("b"), after.alias("a"))), lambda x: _nearest(x, least))[0]


def _nearest(x: Column, least: int) -> Column:
    """The cut of a text by its length, its middle and how far newlines are before and behind that; each is computed once."""
    fits = lambda c: F.when((c >= least) & (x["n"] - c >= least), c)
    down, up = fits(F.when(x["b"] > 0, x["m"] + 1 - x["b"])), fits(F.when(x["a"] > 0, x["m"] + x["a"] - 1))
    nearest = F.when(down.isNotNull() & (up.isNull() | (x["m"] - down <= up - x["m"])), down)
    return F.coalesce(nearest, up, x["m"]).cast("int")


def _parted(text: Column, cut: Column, least: int, overlap: int) -> Column:
    """The two parts of a text, each reaching over the cut, or the whole where one would be blank or as long as it."""
    over = min(overlap, least // 2)
    halves = F.array(F.left(text, F.least(cut + over, F.length(text))), F.substring(text, F.greatest(cut - over, F.lit(0)) + 1, F.length(text)))
    whole = lambda x: F.exists(x, lambda p: ~p.rlike(r"\S") | (F.length(p) >= F.length(text)))
    return F.transform(F.array(halves), lambda x: F.when(whole(x), F.array(text)).otherwise(x))[0]


def split_once(text: Column, least: int, overlap: int) -> Column:
    """A text in two at the newline nearest its middle (at its middle without one), or the whole where that can't be.

    Without their overlap both parts have at least ``least`` characters. Each
    reaches over the cut by ``overlap``, half of ``least`` at most. A text
    whose parts would be blank or as long as itself stays whole.
    """
    return F.when(F.length(text) >= 2 * least, _parted(text, _cut(text, least), least, overlap)).otherwise(F.array(text))


def adaptive_split(docs: DataFrame, id_col: str, text: str, most: int, least: int = 4000, overlap: int = 600, depth: int = 2) -> DataFrame:
    """(id, path, text): texts over ``most`` characters split in two, and those parts again, up to ``depth`` times; ``path`` tells left (0) from right (1)."""
    rows = docs.select(id_col, F.lit("").alias("path"), F.col(text).alias(text))
    for _ in range(depth):
        # the cut is a column of its own: inside the parts it would be sought for each use of it
        cut = F.when((F.length(text) > most) & (F.length(text) >= 2 * least), _cut(F.col(text), least))
        placed = rows.withColumn("__cut", cut)
        parts = F.when(F.col("__cut").isNotNull(), _parted(F.col(text), F.col("__cut"), least, overlap)).otherwise(F.array(F.col(text)))
        rows = placed.withColumn("__parts", parts).select(id_col, "path", F.size("__parts").alias("__n"), F.posexplode("__parts").alias("__k", text))
        rows = rows.select(id_col, F.when(F.col("__n") > 1, F.concat("path", F.col("__k").cast("string"))).otherwise(F.col("path")).alias("path"), text)
    return rows


def snippet_windows(docs: DataFrame, id_col: str, text: str, pattern: str, before: int = 8, after: int = 18, gap: int = 3) -> DataFrame:
    """(id, start, stop, hits): line windows around the lines that match, merged where at most ``gap`` lines lie between them."""
    lines = docs.select(id_col, F.size(F.split(text, "\n")).alias("__lines"), F.posexplode(F.split(text, "\n")).alias("__line", "__text"))
    hits = lines.where(F.col("__text").rlike(pattern))
    spans = hits.select(id_col, F.greatest(F.col("__line") - before, F.lit(0)).alias("start"), F.least(F.col("__line") + after, F.col("__lines") - 1).alias("stop"))
    return merged_intervals(spans, [id_col], "start", "stop", F.lit(gap + 1)).withColumnRenamed("n", "hits")


def rendered_windows(docs: DataFrame, windows: DataFrame, id_col: str, text: str, most: int) -> DataFrame:
    """(id, start, stop, code, status): the windows' lines in order, until a document's budget is full."""
    joined = windows.join(docs.select(id_col, text), id_col)
    code = F.array_join(F.slice(F.split(text, "\n"), F.col("start") + 1, F.col("stop") - F.col("start") + 1), "\n")
    filled = budgeted_texts(joined.select(id_col, "start", "stop", code.alias("code")), [id_col], "start", "code", most)
    return filled.select(id_col, "start", "stop", F.col("sent").alias("code"), "status")


