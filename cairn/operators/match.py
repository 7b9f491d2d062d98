"""Resolving calls to endpoints, and the flows that grow out of it.

Ambiguity is a result, never an error: every call comes out exactly once, with
a confidence and a reason. Every "first" is by an explicit ordinal column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import http_method, http_path, path_suffixes, without_api_prefix


def two_tier_match(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One row per call (ord, method, path): call_ord, call, endpoint_ord, confidence, n_candidates, match_reason.

    Tier 1 joins on method and normalised path. What it leaves (anti-join)
    goes to tier 2: after dropping /api one path is a suffix of the other. All
    suffixes begin at a slash, so each side explodes into its own and tier 2
    is two equi-joins. One candidate resolves a call; several leave it low,
    with the first by ordinal. Candidates are counted before they are joined
    back, so a popular path never gathers its calls in a list.
    """
    calls = calls.select(F.col("ord").alias("call_ord"), http_method("method").alias("method"), http_path("path").alias("path"))
    ends = endpoints.select(F.col("ord").alias("endpoint_ord"), http_method("method").alias("method"), http_path("path").alias("path"))
    by_path = ends.groupBy("method", "path").agg(F.count(F.lit(1)).alias("n"), F.min("endpoint_ord").alias("first"))
    exact = calls.join(by_path, ["method", "path"])
    rest = calls.join(by_path, ["method", "path"], "left_anti").withColumn("short", without_api_prefix("path"))
    # endpoints by their own short path, and by each of its suffixes
    short = by_path.withColumn("short", without_api_prefix("path"))
    whole = short.groupBy("method", "short").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    ending = (
        whole.select("method", F.explode(path_suffixes("short")).alias("suffix"), "short", "n", "first")
        .groupBy("method", "suffix")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )
    distinct = rest.select("method", "short").distinct()
    longer = distinct.join(ending.withColumnRenamed("suffix", "short"), ["method", "short"])
    # those equal to the call's path are in ``ending`` already
    own = distinct.select("method", "short", F.explode(path_suffixes("short")).alias("suffix")).where("suffix <> short")
    shorter = own.join(whole.withColumnRenamed("short", "suffix"), ["method", "suffix"]).select("method", "short", "n", "first")
    second = longer.select("method", "short", "n", "first").union(shorter)
    second = second.groupBy("method", "short").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    matched = exact.withColumn("tier", F.lit("exact")).unionByName(
        rest.join(second, ["method", "short"], "left").withColumn("tier", F.when(F.col("n").isNotNull(), "suffix")).drop("short")
    )
    one = F.col("n") == 1
    confidence = (
        F.when(F.col("tier").isNull(), "unmatched").when(~one, "low").when(F.col("tier") == "exact", "high").otherwise("medium")
    )
    many = F.concat(F.col("n").cast("string"), F.lit(" endpoints"))
    reason = (
        F.when(F.col("tier").isNull(), "no endpoint by method and path")
        .when((F.col("tier") == "exact") & one, "exact path")
        .when(F.col("tier") == "exact", F.concat(F.lit("ambiguous exact path: "), many))
        .when(one, "path suffix")
        .otherwise(F.concat(F.lit("ambiguous path suffix: "), many))
    )
    return matched.select(
        "call_ord",
        F.concat_ws(" ", "method", "path").alias("call"),
        F.col("first").alias("endpoint_ord"),
        confidence.alias("confidence"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_candidates"),
        reason.alias("match_reason"),
    )


def outbound_match(endpoints: DataFrame, outbound: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per outbound call, and one for each endpoint (source) that makes none.

    ``outbound`` is (ord, source, method, path), ``targets`` (ord, method, path,
    file). A target's file is known only where the target is the only one. An
    endpoint's own path is never evidence for a target.
    """
    matched = two_tier_match(outbound, targets)
    calls = outbound.select(F.col("ord").alias("call_ord"), "source")
    files = targets.select(F.col("ord").alias("endpoint_ord"), "file")
    found = matched.join(calls, "call_ord").join(files, "endpoint_ord", "left").withColumn("file", F.when(F.col("n_candidates") == 1, F.col("file")))
    columns = ["source", "call_ord", "call", "endpoint_ord", "file", "confidence", "match_reason"]
    silent = endpoints.select("source").distinct().join(calls.select("source").distinct(), "source", "left_anti")
    none = [F.lit(None).cast(dict(found.dtypes)[c]).alias(c) for c in columns[1:5]]
    silent = silent.select("source", *none, F.lit("unmatched").alias("confidence"), F.lit("no outbound calls").alias("match_reason"))
    return found.select(columns).unionByName(silent)


def unresolved(matches: DataFrame) -> DataFrame:
    """Unmatched rows, and low ones for ambiguity."""
    low = (F.col("confidence") == "low") & F.col("match_reason").startswith("ambiguous")
    return matches.where((F.col("confidence") == "unmatched") | low)


def match_summary(matches: DataFrame) -> DataFrame:
    resolved = ~F.col("confidence").isin("unmatched", "low")
    return matches.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(resolved).alias("resolved"),
        F.count_if(F.col("confidence") == "low").alias("ambiguous"),
        F.count_if(F.col("confidence") == "unmatched").alias("unmatched"),
    )


def best_or_none(pairs: DataFrame, by: list[str], score: Column, least: int, result: list[str]) -> DataFrame:
    """The pair with the highest score of at least ``least`` for each ``by``, or none where that score is tied.

    Aggregates before it decides: no window holds a group's pairs.
    """
    top = F.max("__score")
    scored = pairs.withColumn("__score", score).where(F.col("__score") >= least)
    by_score = scored.groupBy(*by, "__score").agg(F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(c) for c in result])
    best = by_score.groupBy(*by).agg(top.alias("score"), F.max_by(F.struct("__n", *result), "__score").alias("__best"))
    return best.where("__best.__n = 1").select(*by, "score", *[F.col(f"__best.{c}").alias(c) for c in result])


def unique_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that have exactly one distinct value."""
    by = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__last"))
    return by.where(F.col(value) == F.col("__last")).select(key, value)


def flow_confidence(upper: Column, lower: Column, flow: Column, uncertain: Column) -> Column:
    """partial where anything is uncertain, high where all parts are, else medium."""
    return (
        F.when(uncertain, "partial")
        .when((upper == "high") & (lower == "high") & (F.coalesce(flow, F.lit("high")) == "high"), "high")
        .otherwise("medium")
    )


def rolled_up_confidence(confidence: str = "confidence") -> Column:
    """Aggregate: any high, else any medium, else any low or partial, else unknown."""
    c = F.col(confidence)
    return (
        F.when(F.bool_or(c == "high"), "high")
        .when(F.bool_or(c == "medium"), "medium")
        .when(F.bool_or(c.isin("low", "partial")), "low")
        .otherwise("unknown")
    )


def match_status(matched: Column) -> Column:
    """Aggregate over a group's rows: none, matched or partial."""
    return F.when(F.count_if(matched) == 0, "none").when(F.count_if(matched) == F.count(F.lit(1)), "matched").otherwise("partial")


def first_by(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merged_by_priority(parts: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Upsert of tables in order: for each key and column the last value that is not null."""
    stacked = None
    for k, part in enumerate(parts):
        part = part.select(key, *columns).withColumn("__part", F.lit(k))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__part"))).alias(c) for c in columns])
