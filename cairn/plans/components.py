"""Connected components of an edge table, in tables only.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014): every node hangs its larger
neighbours, then its smaller ones, under the least node it knows of. The edge
table never grows, and a few rounds bring every component to a star around
its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.durable import materialize, measured, scratch


def _hang(neighbours: DataFrame) -> DataFrame:
    """(u, v) to (v, least) and (u, least), with ``least`` the smallest of u and its neighbours."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return neighbours.join(least, "u")


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an edge (a, b); ``component`` is its least node.

    Loops and repeated edges do no harm; edges with a null end are ignored; an
    empty table has no node.
    """
    with scratch(edges.sparkSession):
        return materialize(_stars(edges, rounds), "components", kept=True)


def _stars(edges: DataFrame, rounds: int) -> DataFrame:
    """The settled stars, over tables that last as long as the caller's block."""
    current = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null")
        .where("u <> v")
        .distinct()
    )
    current = materialize(current, "edges")
    state = None
    for _ in range(rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _hang(large.distinct())
        current = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        current, seen = measured(current, "edges", sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
