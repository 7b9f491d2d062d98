"""Freshness, fingerprints, caches and run state as joins between tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staleness(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """(target, dependency, problem) from pairs (target, dependency) and times (name, mtime).

    A missing target is its own problem, a missing dependency another; a
    target is stale if it is strictly older than its dependency.
    """
    t = times.select(F.col("name").alias("target"), F.col("mtime").alias("__t"))
    d = times.select(F.col("name").alias("dependency"), F.col("mtime").alias("__d"))
    joined = pairs.join(t, "target", "left").join(d, "dependency", "left")
    problem = (
        F.when(F.col("__t").isNull(), "missing-target").when(F.col("__d").isNull(), "missing-dependency").when(F.col("__t") < F.col("__d"), "stale-target")
    )
    return joined.select("target", "dependency", problem.alias("problem")).where("problem is not null")


def fingerprints(files: DataFrame, name: str, content: Column) -> DataFrame:
    """(name, sha256, n_bytes)."""
    return files.select(F.col(name).alias("name"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("n_bytes"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change) between two fingerprint tables: added, removed or modified."""
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, F.col("b.name") == F.col("a.name"), "full")
    change = (
        F.when(F.col("b.name").isNull(), "added")
        .when(F.col("a.name").isNull(), "removed")
        .when((F.col("a.sha256") != F.col("b.sha256")) | (F.col("a.n_bytes") != F.col("b.n_bytes")), "modified")
    )
    return both.select(F.coalesce("a.name", "b.name").alias("name"), change.alias("change")).where("change is not null")


def through_cache(rows: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], at_most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, new cache rows): ``rows`` meet ``cache`` (key, value); ``compute`` sees each missing key once.

    ``at_most`` bounds how many missing keys are computed in a run, in key
    order; rows of the others come out with a null value.
    """
    missing = rows.select(key).distinct().join(cache, key, "left_anti")
    if at_most is not None:
        missing = missing.orderBy(key).limit(at_most)
    made = compute(missing)
    known = cache.select(key, "value", F.lit(True).alias("hit")).unionByName(made.select(key, "value", F.lit(False).alias("hit")))
    return rows.join(known, key, "left"), made


def reusable_steps(steps: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Steps (run, ord, step, status, input_hash, output_hash) that are completed, with both hashes still true."""
    i = inputs.select("step", F.col("sha256").alias("__in"))
    o = outputs.select("step", F.col("sha256").alias("__out"))
    same = (F.col("status") == "completed") & (F.col("input_hash") == F.col("__in")) & (F.col("output_hash") == F.col("__out"))
    return steps.join(i, "step", "left").join(o, "step", "left").withColumn("reusable", F.coalesce(same, F.lit(False))).drop("__in", "__out")


def artifact_freshness(artifacts: DataFrame, inputs: DataFrame) -> DataFrame:
    """(artifact, state): missing, invalid-metadata, stale or fresh.

    ``artifacts`` (artifact, mtime, metadata JSON, null if there is no file),
    ``inputs`` (artifact, input, mtime, sha256); metadata hold the inputs'
    hashes under ``inputs``. Stale is what is strictly older than an input or
    was made from another version of it.
    """
    parsed = F.from_json("metadata", "inputs map<string,string>")["inputs"]
    a = artifacts.select("artifact", F.col("mtime").alias("made"), parsed.alias("known"))
    i = inputs.groupBy("artifact").agg(F.max("mtime").alias("newest"), F.map_from_entries(F.collect_list(F.struct("input", "sha256"))).alias("now"))  # an artifact's own inputs
    j = a.join(i, "artifact", "left")
    differs = F.exists(F.map_keys(F.coalesce("now", F.expr("cast(map() as map<string,string>)"))), lambda k: ~F.element_at("now", k).eqNullSafe(F.try_element_at("known", k)))
    state = F.when(F.col("made").isNull(), "missing").when(F.col("known").isNull(), "invalid-metadata").when((F.col("made") < F.col("newest")) | differs, "stale").otherwise("fresh")
    return j.select("artifact", state.alias("state"))


def pipeline_freshness(expected: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, problem, severity) of a pipeline's files, and one row of whether a rebuild helps.

    ``expected`` (name, role: base, optional or derived), ``files`` (name,
    mtime). A missing base is high; a missing optional or derived file medium; a
    derived file older than the newest base low. A rebuild needs all bases.
    """
    j = expected.join(files, "name", "left")
    newest = j.where("role = 'base'").agg(F.max("mtime").alias("newest"))
    missing = F.col("mtime").isNull()
    stale = (F.col("role") == "derived") & (F.col("mtime") < F.col("newest"))
    problem = F.when(missing, F.concat(F.lit("missing-"), "role")).when(stale, "stale-derived")
    severity = F.when(missing & (F.col("role") == "base"), "high").when(missing, "medium").otherwise("low")
    found = j.join(F.broadcast(newest)).select("name", "role", problem.alias("problem"), severity.alias("severity")).where("problem is not null")  # one row
    ready = found.agg(F.count_if(F.col("problem") == "missing-base").alias("bases"), F.count_if(F.col("role") == "derived").alias("derived"))
    return found.select("name", "problem", "severity"), ready.select(((F.col("bases") == 0) & (F.col("derived") > 0)).alias("rebuild"))


def identity_mismatches(manifest: DataFrame, artifacts: DataFrame, fields: list[str]) -> DataFrame:
    """(role, mismatches): for each role of the manifest the fields in which its artifact's identity differs; ``missing`` where there is none."""
    m, a = manifest.alias("m"), artifacts.withColumn("__there", F.lit(True)).alias("a")
    j = m.join(a, F.col("m.role") == F.col("a.role"), "left")
    different = F.filter(F.array(*[F.when(~F.col(f"m.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return j.select("m.role", F.when(F.col("a.__there").isNull(), F.array(F.lit("missing"))).otherwise(different).alias("mismatches"))


def committed(before: DataFrame, after: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row: whether a run counts. Its inputs' fingerprints must be the same before and after it, and every output must be there.

    ``outputs`` (name, sha256), null where an output is missing.
    """
    changes = changed(before, after).agg(F.count(F.lit(1)).alias("n_changed"))
    gone = outputs.agg(F.count_if(F.col("sha256").isNull()).alias("n_missing"))
    return changes.join(gone).select("n_changed", "n_missing", ((F.col("n_changed") == 0) & (F.col("n_missing") == 0)).alias("committed"))  # one row each
