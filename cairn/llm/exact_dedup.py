"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition reduces its rows to a run: one entry per distinct text,
in digest order, with the best identifier and the number of copies. Runs then
meet in binomial rounds: in round j, runs that differ in bit j of their number
exchange their entries by digest, are merged in digest order, and form one run
of the next level, until a single run remains after log2(partitions) rounds. A
round ships one entry per run and distinct text, never one per copy, so a text
that a third of all rows repeat costs a round at most one entry per run. The
decision travels back along the same tree: to the first-level runs, and from
there to the rows of each partition, so that no join key gathers all copies of
a text, whatever the number of partitions.

Entries match on SHA-256, byte length and a second 64-bit hash of another
family at every level, so a kept identifier is verified by three witnesses.

Nulls and edges: a null text counts as the empty text. Identifiers compare
with nulls ignored; a class whose identifiers are all null keeps null, and its
rows count as kept. Rows that repeat both text and identifier are all marked
kept by :func:`find_copies`; :func:`drop_copies` leaves one of them. An empty
table gives an empty result. Other columns are never looked at by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.durable import materialize

KEY = ["sha", "n_bytes", "check"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(run, id, sha, n_bytes, check), one row per input row; ``run`` is the partition the row was read in."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.spark_partition_id().alias("run"),
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )


def merge_runs(rows: DataFrame, fan_in: int = 2, keep: str = "max") -> tuple[DataFrame, DataFrame]:
    """First-level runs and the single last run: (run, key..., keep_id, group_size).

    Runs are sorted as they are exchanged, so a merge reads its entries of one
    digest one after the other and holds no table of them.
    """
    best = F.max if keep == "max" else F.min
    level = rows.groupBy("run", *KEY).agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    first, width = level, (rows.agg(F.max("run").alias("last")).first()["last"] or 0) + 1
    while width > 1:
        width = -(-width // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition("run", *KEY)
            .sortWithinPartitions("run", *KEY)
            .groupBy("run", *KEY)
            .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
    return first, level


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 2, keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(digest_rows(docs, id_col, text_col), "digests")
    first, last = merge_runs(rows, fan_in, keep)
    decided = first.select("run", *KEY).join(last.drop("run"), KEY)
    return rows.join(decided, ["run", *KEY]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the rows that :func:`find_copies` does not keep, one row for each distinct text."""
    copies = materialize(find_copies(docs, id_col, text_col, keep=keep), "copies")
    kept = copies.where("kept").groupBy(F.col("text_sha256").alias("__keep_sha")).agg(
        F.max(id_col).alias("__keep_id"), F.count(F.lit(1)).alias("__rows")
    )
    repeated = kept.where("__rows > 1").limit(1).count() > 0
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumn("__sha", F.sha2(text, 256))
    out = marked.join(
        kept, (F.col("__sha") == F.col("__keep_sha")) & F.col(id_col).eqNullSafe(F.col("__keep_id")), "left_semi"
    )
    if repeated:  # the same identifier and text in several rows
        order = F.xxhash64(*[F.to_json(F.struct(docs.columns))])
        out = (
            out.withColumn("__order", order)
            .groupBy("__sha")
            .agg(F.min_by(F.struct(*docs.columns), "__order").alias("__row"))
            .select("__row.*")
        )
    return out.select(*docs.columns)
