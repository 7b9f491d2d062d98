"""Running totals and last values without a task that holds a whole group.

Rows are dealt by range of group and order, so that a group of any size spreads
over partitions, its shares. What a share needs of the shares before it comes
from a table with a row for each share; inside a share the rows' own order
decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.durable import materialize


def dealt_shares(rows: DataFrame, by: list[str], order: list[Column], share: str = "__share") -> tuple[DataFrame, list[str]]:
    """``rows`` written by range of group and order with their ``share``, and the columns that hold the order."""
    places = [f"__o{k}" for k in range(len(order))]
    keyed = rows.withColumns(dict(zip(places, order, strict=True)))
    return materialize(keyed.repartitionByRange(*by, *places).withColumn(share, F.spark_partition_id()), "dealt"), places


def same_group(left: str, right: str, columns: list[str]) -> Column:
    """Equality of all ``columns`` of two aliases, nulls included."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def running_totals(rows: DataFrame, by: list[str], order: list[Column], totals: dict[str, Column], share: str | None = None) -> DataFrame:
    """``rows`` with each of ``totals`` summed over the group's rows up to and with this one, by ``order``.

    ``order`` ascends, nulls first (negate numbers to descend). Rows that tie
    come in any order, the same for all totals.
    With ``share``, a column of that name tells the share that a row is in.
    """
    dealt, places = dealt_shares(rows.withColumns({f"__v_{name}": value for name, value in totals.items()}), by, order)
    inside = Window.partitionBy(*by, "__share").orderBy(*places).rowsBetween(Window.unboundedPreceding, 0)
    shares = dealt.groupBy(*by, "__share").agg(*[F.sum(f"__v_{name}").alias(f"__s_{name}") for name in totals])
    earlier = Window.partitionBy(*by).orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(*by, "__share", *[F.coalesce(F.sum(f"__s_{name}").over(earlier), F.lit(0)).alias(f"__b_{name}") for name in totals])
    same = (F.col("d.__share") == F.col("s.__share")) & same_group("d", "s", by)
    joined = dealt.alias("d").join(shares.alias("s"), same).select("d.*", *[f"s.__b_{name}" for name in totals])
    for name in totals:
        joined = joined.withColumn(name, F.col(f"__b_{name}") + F.coalesce(F.sum(f"__v_{name}").over(inside), F.lit(0)))
    return joined.select(*rows.columns, *totals, *([F.col("__share").alias(share)] if share else []))


def as_of(points: DataFrame, marks: DataFrame, by: list[str], at: str, values: list[str], strict: bool = False) -> DataFrame:
    """``points`` with ``values`` of the last mark of their group at or before them (``strict``: before them), nulls where there is none.

    Both tables have the columns ``by`` and ``at``; a point without a place
    has no mark. Of marks at one place the greatest by ``values`` counts.
    Points and marks are sorted together, so a hot group spreads over shares
    and no pair of rows is formed.
    """
    for c in values:
        if c in points.columns:
            raise ValueError(f"both tables have the column {c}")
    first, last = (1, 0) if strict else (0, 1)
    p = points.select(*by, F.col(at).alias("__at"), F.lit(last).alias("__kind"), F.struct(*points.columns).alias("__point"))
    m = marks.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("__at"), F.lit(first).alias("__kind"), F.struct(*values).alias("__mark"))
    both = p.unionByName(m, allowMissingColumns=True)
    dealt, places = dealt_shares(both, by, [F.col("__at"), F.col("__kind"), F.col("__mark")])
    upto = Window.partitionBy(*by, "__share").orderBy(*places).rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.where("__mark is not null").groupBy(*by, "__share").agg(F.max_by("__mark", F.struct(*places)).alias("__end"))
    # every share of a group, with the last mark of those before it
    every = dealt.groupBy(*by, "__share").agg(F.count(F.lit(1)).alias("__n"))
    with_end = every.alias("e").join(ends.alias("d"), (F.col("e.__share") == F.col("d.__share")) & same_group("e", "d", by), "left").select("e.*", "d.__end")
    earlier = Window.partitionBy(*by).orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    carried = with_end.select(*by, "__share", F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    inside = dealt.withColumn("__inside", F.last("__mark", ignorenulls=True).over(upto)).where("__point is not null")
    same = (F.col("i.__share") == F.col("c.__share")) & same_group("i", "c", by)
    joined = inside.alias("i").join(carried.alias("c"), same).select("i.__point", "i.__at", F.coalesce("i.__inside", "c.__carried").alias("__found"))
    found = F.when(F.col("__at").isNotNull(), F.col("__found"))
    return joined.select("__point.*", *[found[c].alias(c) for c in values])


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their number from 1 in their group's order; without ``by`` in that of the whole table."""
    if by:
        return running_totals(rows, by, order, {name: F.lit(1).cast("bigint")})
    return running_totals(rows.withColumn("__all", F.lit(0)), ["__all"], order, {name: F.lit(1).cast("bigint")}).drop("__all")
