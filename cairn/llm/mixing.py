"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow that sends its shuffled documents, again from the start
when it has sent them all, up to ``max_epochs`` times. A copy's virtual finish
time is the number of tokens its source has sent with it, divided by the
source's weight. Sending all copies by finish time and stopping at the total
budget serves every source in proportion to its weight while it has documents
left and shares out what an exhausted source leaves: the amounts served are
the water-filling targets, to within a document.

Nothing is ordered in one task. Cumulative tokens within a source come from
4,096 hash buckets per source (a sum per bucket, then the rows inside each
bucket); the global cut from 4,096 ranges of finish time, of which only the
one that holds the cut is ordered row by row.

Nulls and edges: a null text has size 0; the null source is a source of its
own, ordered last; a null identifier hashes as the empty string. Rows that
repeat an identifier are separate documents, shuffled next to each other. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.durable import materialize

RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, budget: int | None = None, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, size[, weight]).

    Weights default to 1, 2, 3, repeating in code point order. Targets share
    the budget (default: the sum of all sizes) by weight, none above
    ``max_epochs`` times its source's size; what that leaves over is shared
    again by weight. With the sources in order of max_epochs * size / weight,
    the first ones are at their limit; the level of the others follows from
    running sums. One row per source passes through here.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = totals.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", ((F.col("rank") - 1) % 3 + 1).cast("double")
    )
    everything = Window.partitionBy(F.lit(0))
    cap = (F.col("source_size") * max_epochs).cast("double")
    totals = totals.withColumn("cap", cap).withColumn(
        "budget", (F.sum("source_size").over(everything) if budget is None else F.lit(budget)).cast("double")
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    )
    totals = totals.withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return totals.withColumn("water", level).select(
        "source",
        "source_size",
        "rank",
        "weight",
        F.when(F.col("water").isNull() | (F.col("cap") / F.col("weight") < F.col("water")), F.col("cap"))
        .otherwise(F.col("water") * F.col("weight"))
        .alias("target"),
    )


def finish_times(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_epochs: int = 3
) -> DataFrame:
    """Each row's size, its source's totals and ``finish``, the virtual finish times of its copies."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        shuffle_key(id_col, seed).alias("h"),
    ).withColumn("bucket", F.substring("h", 1, 3))
    rows = materialize(rows, "sizes")
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(by_bucket, max_epochs=max_epochs)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0))).drop("size")
    o, t = offsets.alias("o"), targets.alias("t")
    offsets = o.join(t, F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.*", *[f"t.{c}" for c in targets.columns[1:]])
    r, o = rows.alias("r"), offsets.alias("o")
    joined = r.join(o, F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.bucket") == F.col("o.bucket"))).select(
        "r.*", *[f"o.{c}" for c in offsets.columns[2:]]
    )
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    sent = F.col("before") + F.sum("size").over(inside)
    return joined.withColumn("sent", sent).withColumn(
        "finish",
        F.transform(
            F.sequence(F.lit(0), F.lit(max_epochs - 1)),
            lambda e: (e * F.col("source_size") + F.col("sent")).cast("double") / F.col("weight"),
        ),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_epochs: int = 3) -> DataFrame:
    """One row per document with ``kept``, the finish times of its copies that the mix takes."""
    rows = materialize(finish_times(docs, id_col, text_col, source_col, seed, max_epochs), "finish")
    ends = rows.agg(F.max(F.element_at("finish", -1)).alias("last"), F.sum("size").alias("budget")).first()
    last, budget = ends["last"] or 0.0, ends["budget"] or 0
    place = lambda f: F.least(F.floor(f * F.lit(RANGES / last if last else 0.0)), F.lit(RANGES - 1)).cast("int")
    copies = rows.select("rank", "h", "size", F.posexplode("finish").alias("epoch", "f")).withColumn("range", place(F.col("f")))
    steps = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = copies.groupBy("range").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(steps))
    cut = ranges.where(F.col("upto") > budget).orderBy("range").select("range", (F.col("upto") - F.col("size")).alias("before")).first()
    if cut is None:
        return rows.withColumn("kept", F.col("finish"))
    order = ["f", "rank", "h", "size", "epoch"]
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        copies.where(F.col("range") == cut["range"])
        .withColumn("upto", F.sum("size").over(running) + cut["before"])
        .where(F.col("upto") <= budget)
        .agg(F.max(F.struct(*order)).alias("last"))
    )
    at = edge.first()["last"]
    point = lambda f, e: F.struct(f, F.col("rank"), F.col("h"), F.col("size"), e)
    inside = (
        (lambda f, e: (place(f) < cut["range"]))
        if at is None
        else (
            lambda f, e: (place(f) < cut["range"])
            | (
                (place(f) == cut["range"])
                & (point(f, e) <= F.struct(F.lit(at["f"]), F.lit(at["rank"]), F.lit(at["h"]), F.lit(at["size"]).cast("long"), F.lit(at["epoch"])))
            )
        )
    )
    return rows.withColumn("kept", F.filter("finish", inside))


def mixture(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix as a table: ``docs``' columns, a row per taken copy, range-sorted by finish time.

    Rows that repeat an identifier are taken together: each as often as the
    identifier's copies with the most repeats.
    """
    taken = mix(docs, id_col, **options).where(F.size("kept") > 0)
    times = taken.groupBy(F.col("id").alias("__id")).agg(F.max_by("kept", F.size("kept")).alias("__kept"))
    d = docs.alias("d")
    out = d.join(times, F.col(f"d.{id_col}").eqNullSafe(F.col("__id"))).select("d.*", F.explode("__kept").alias("__finish"))
    return out.repartitionByRange("__finish").sortWithinPartitions("__finish", id_col).drop("__finish")
