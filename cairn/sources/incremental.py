"""Scans that read again only what changed: by manifest, and as a stream of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Extractor = Callable[[DataFrame], DataFrame]


def manifest_of(files: DataFrame) -> DataFrame:
    """(path, size, digest) of files (path, content)."""
    return files.select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two manifests: added, removed, changed or same."""
    o, n = old.select("path", F.struct("size", "digest").alias("o")), new.select("path", F.struct("size", "digest").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "same").otherwise("changed")
    return o.join(n, "path", "full").select("path", change.alias("change"))


def rescan(files: DataFrame, old_manifest: DataFrame, old_records: DataFrame, extractor: Extractor) -> DataFrame:
    """The records of ``files``: extracted anew for added and changed ones, the old ones for the others; those of removed files go.

    Records carry their ``path``; ``fresh`` tells which are new.
    """
    diff = changes(old_manifest, manifest_of(files))
    again = files.join(diff.where("change in ('added', 'changed')"), "path", "left_semi")
    kept = old_records.join(diff.where("change = 'same'"), "path", "left_semi")
    return kept.withColumn("fresh", F.lit(False)).unionByName(extractor(again).withColumn("fresh", F.lit(True)))


def scan_stream(spark: SparkSession, root: str, pattern: str, records: str, checkpoint: str, extractor: Extractor) -> StreamingQuery:
    """Extract from every file below ``root`` that the stream hasn't seen, then end; a batch's records replace what an earlier try of it wrote.

    Files are told by their path: one that changes under its path is a matter
    of :func:`rescan`.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)

    def write(batch: DataFrame, number: int) -> None:
        texts = batch.select("path", F.decode("content", "UTF-8").alias("content"))
        extractor(texts).write.mode("overwrite").parquet(f"{records.rstrip('/')}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_records(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Of a stream's ``records`` (path, batch, ...) each path's from its last batch, without files that ``listing`` (path) no longer has."""
    last = records.groupBy("path").agg(F.max("batch").alias("batch"))
    return records.join(last, ["path", "batch"], "left_semi").join(listing.select("path").distinct(), "path", "left_semi")
