"""Intermediate tables that outlive executors.

A lost executor takes its shuffle files and cached blocks along. What a later
job reads again is therefore written to the folder that ``spark.checkpoint.dir``
names, which every node of the cluster sees.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What a Python task gets at once, so that its copies of a batch stay small.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="cairn-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys over the session's shuffle partitions, for work that is large against its rows.

    A small table is one split of its file, and adaptive plans join small
    partitions; what is made of its rows would then run in one task. A number
    that is asked for stays.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounded Arrow batches for the jobs inside; the session's own setting comes back afterwards."""
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Paths written inside each open :func:`scratch` block, the innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go when the block ends, except those that are ``kept``: they belong to the block around it."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.pop()
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)


def materialize(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    around = _SCRATCH[:-1] if kept else _SCRATCH
    if around:
        around[-1].append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize`, with aggregates of the rows (``n``: their number) taken while they are written, so that no job reads them for it."""
    seen = Observation(f"cairn-{name}-{uuid.uuid4().hex}")
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()]), name)
    found = seen.get
    return table, {"n": 0} | dict(found or {})
