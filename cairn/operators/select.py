"""Row selection and ordering: firsts, top-k, priorities, running limits, set operations, upserts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.plans.durable import materialize
from cairn.plans.running import numbered, running_totals, same_group


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``order``, with their ``rank``; the limit is pushed below the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key, the one with the least ordinal; combines in the task before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new``, and what ``old`` has under other keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def priority(value: Column, ranked: list[str]) -> Column:
    """Position in a list of values; all others after them."""
    chain = F.lit(len(ranked))
    for k, v in reversed(list(enumerate(ranked))):
        chain = F.when(value == v, k).otherwise(chain)
    return chain


def scan_violations(files: DataFrame, by: list[str], max_files: int, max_size: int, max_total: int) -> DataFrame:
    """The first file of each group, in path order, that breaks a budget: (by, path, ord, violation).

    Limits are inclusive. A scan may be of any size: its running sums are
    those of :func:`~cairn.plans.running.running_totals`.
    """
    counted = running_totals(files, by, [F.col("path")], {"ord": F.lit(1).cast("bigint"), "total": F.col("size")})
    violation = (
        F.when(F.col("ord") > max_files, "file-count").when(F.col("size") > max_size, "file-size").when(F.col("total") > max_total, "total-size")
    )
    found = counted.withColumn("violation", violation).where("violation is not null")
    first = found.groupBy(*by).agg(F.min(F.struct("ord", "path", "violation")).alias("f"))
    return first.select(*by, F.col("f.path").alias("path"), F.col("f.ord").alias("ord"), F.col("f.violation").alias("violation"))


def valid_prefix(steps: DataFrame, by: list[str], ordinal: str, valid: Column) -> DataFrame:
    """Steps before the first invalid one of their group; that one and all later ones go."""
    first = steps.groupBy(*by).agg(F.min(F.when(~valid, F.col(ordinal))).alias("__stop"))
    return steps.join(first, by).where(F.col("__stop").isNull() | (F.col(ordinal) < F.col("__stop"))).drop("__stop")


def merged_intervals(rows: DataFrame, by: list[str], start: str, end: str, gap: Column) -> DataFrame:
    """(by, start, end, n): intervals that overlap or lie at most ``gap`` apart, merged (gaps and islands)."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    reach = rows.withColumn("__reach", F.max(end).over(before))
    fresh = F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + gap), 1).otherwise(0)
    islands = reach.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(upto))
    return islands.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("__island")


def innermost(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, stop: str, block: int = 1024) -> DataFrame:
    """Each point with the narrowest range of its group that holds it (start <= at < stop); points in none go.

    Ranges explode into the blocks of ``block`` units that they touch, so that
    the range join is an equi-join on group and block.
    """
    cut = ranges.withColumn("__block", F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.col(stop) - 1) / block))))
    p = points.withColumn("__block", F.floor(F.col(at) / block)).withColumn("__point", F.struct(*points.columns))
    held = p.join(cut, [*by, "__block"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(stop)))
    rest = [c for c in ranges.columns if c not in by]
    best = held.groupBy("__point").agg(F.min_by(F.struct(*rest), F.struct(F.col(stop) - F.col(start), F.col(start))).alias("__range"))
    return best.select("__point.*", *[F.col(f"__range.{c}").alias(c) for c in rest if c not in points.columns])


def part_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``part``, their number in their group, and ``parts``, the group's size; groups may be of any size."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("parts"))
    joined = numbered(rows, by, order, "part").alias("r").join(sizes.alias("s"), same_group("r", "s", by))
    return joined.select("r.*", "s.parts")


def sum_if_complete(value: str) -> Column:
    """The sum, or null unless every row has the value."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def with_overflow(values: Column, shown: int = 4) -> Column:
    """The first distinct values joined, and how many more there are."""
    d = F.array_distinct(values)
    more = F.when(F.size(d) > shown, F.concat(F.lit(" (+"), (F.size(d) - shown).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.array_join(F.slice(d, 1, shown), ", "), more)


def messages(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in rules]), lambda x: x.isNotNull())


def sequential_budget(sections: DataFrame, by: list[str], order: str, size: str, most: int) -> DataFrame:
    """``taken``: sections in order take what is left of ``most``; one is cut, those behind it get nothing."""
    upto = running_totals(sections, by, [F.col(order)], {"__upto": F.coalesce(F.col(size), F.lit(0))})
    left = F.greatest(F.lit(most) - (F.col("__upto") - F.coalesce(F.col(size), F.lit(0))), F.lit(0))
    return upto.withColumn("taken", F.least(F.col(size), left).cast("bigint")).drop("__upto")


def admitted(items: DataFrame, by: list[str], order: str, size: str, most: int, wrapper: int = 0, reserve: int | None = None, at_most: int = 80) -> DataFrame:
    """(by, order) of the items that a budget admits: one that doesn't fit is skipped, later ones may still fit.

    The fold runs over an array of at most ``at_most`` candidates a group,
    which top-k leaves; admission by ``reserve`` charges no more than that.
    """
    charge = F.col(size) if reserve is None else F.least(F.col(size), F.lit(reserve))
    few = top_k(items, by, [F.col(order).asc()], at_most)
    lists = few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order), (charge + wrapper).cast("bigint").alias("need")))).alias("__list"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.expr(f"cast(array() as array<{dict(items.dtypes)[order]}>)").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["need"] <= most
        return F.struct(
            F.when(fits, acc["used"] + x["need"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["taken"], F.array(x[order]))).otherwise(acc["taken"]).alias("taken"),
        )

    return lists.select(*by, F.explode(F.aggregate("__list", start, step)["taken"]).alias(order))


def packed(blocks: DataFrame, by: list[str], order: str, size: str, most: int, separator: int = 7) -> DataFrame:
    """(by, order, chunk): greedy packing in order, a chunk holding at most ``most`` characters with separators.

    A block of a size beyond ``most`` is a chunk of its own; one of size 0 (or
    null) that opens a chunk stays alone in it. Groups of any size are packed
    in parallel. Running totals tell for every block how far a chunk that
    starts there reaches. Where a share of the group may be entered is known
    too: at a block that lies within ``most`` characters of the share's
    beginning. Each share follows its chunks from all these places, a table of
    these ways (a few rows a share) is walked from the group's first block,
    and the shares number their blocks from the place where they are entered.
    """
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    rows = blocks.select(*by, F.col(order), n.alias("__n"))
    rows = running_totals(rows, by, [F.col(order), F.col("__n")], {"__upto": F.col("__n") + separator, "__place": F.lit(1).cast("bigint")}, share="__in")
    rows = materialize(rows, "totals")
    keys = [rows.schema[c] for c in by]

    def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """A share's rows in order, their totals, the total that a chunk from each may not exceed, and the row where the next one starts."""
        table = table.sort_by("__place")
        upto, n = table["__upto"].to_numpy(), table["__n"].to_numpy()
        # a chunk of nothing ends behind its block, also where the next total is the same
        reach = np.where(n == 0, upto - 1, np.maximum(upto - n + most, upto))
        return table, upto, reach, np.maximum(np.searchsorted(upto, reach, side="right"), np.arange(len(n)) + 1)

    def ways(table: pa.Table) -> pa.Table:
        table, upto, leaves, at = in_order(table)
        place = table["__place"].to_numpy()
        chunks, last = np.ones(len(place), np.int64), place.copy()
        while (inside := at < len(place)).any():
            here = at[inside]
            chunks[inside] += chunks[here]
            leaves[inside], last[inside] = leaves[here], last[here]
            at[inside] = at[here]
        doors = np.flatnonzero(upto - table["__n"].to_numpy() <= upto[0] - table["__n"][0].as_py() + most + separator)
        taken = table.select([*by, "__in", "__place", "__upto"]).take(doors)
        for name, x in (("leaves", leaves), ("last", last), ("chunks", chunks)):
            taken = taken.append_column(name, pa.array(x[doors]))
        return taken

    walk = StructType([*keys, rows.schema["__in"], rows.schema["__place"], rows.schema["__upto"]])
    for c in ("leaves", "last", "chunks"):
        walk = walk.add(c, "long")

    def entered(table: pa.Table) -> pa.Table:
        """By share of a group: chunks before it, and the place of the block where it is entered."""
        table = table.sort_by("__place")
        found, reach, behind, count = [], -1, 0, 0
        for share, place, upto, leaves, last, chunks in zip(*[table[c].to_pylist() for c in ("__in", "__place", "__upto", "leaves", "last", "chunks")], strict=True):
            if not found or found[-1][0] != share:
                found.append([share, count, None])
            if found[-1][2] is None and upto > reach and place > behind:
                found[-1][2] = place
                reach, behind, count = leaves, last, count + chunks
        columns = [pa.concat_arrays([table[c].combine_chunks().slice(0, 1)] * len(found)) for c in by]
        columns += [pa.array([f[0] for f in found], pa.int32()), *[pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)]]
        return pa.Table.from_arrays(columns, names=door.names)

    door = StructType([*keys, rows.schema["__in"]]).add("__count", "long").add("__door", "long")

    def numbers(table: pa.Table) -> pa.Table:
        table, _, _, following = in_order(table)
        count, opened = table["__count"][0].as_py(), table["__door"][0].as_py()
        starts = np.zeros(len(following), np.int64)
        at = len(starts) if opened is None else opened - table["__place"][0].as_py()
        while at < len(starts):
            starts[at] = 1
            at = following[at]
        return table.select([*by, order]).append_column("chunk", pa.array(count + np.cumsum(starts)))

    summary = materialize(rows.groupBy(*by, "__in").applyInArrow(ways, walk), "ways")
    doors = summary.groupBy(*by).applyInArrow(entered, door)
    same = (F.col("r.__in") == F.col("d.__in")) & same_group("r", "d", by)
    joined = rows.alias("r").join(doors.alias("d"), same).select("r.*", "d.__count", "d.__door")
    out = StructType([*keys, rows.schema[order]]).add("chunk", "long")
    return joined.groupBy(*by, "__in").applyInArrow(numbers, out)
