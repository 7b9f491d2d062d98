"""Vector codes from per-part codebooks, assigned through a VA-file.

A vector's components become integers and fall into equal parts; a part's code
is the index of its codebook's nearest entry. The codebook is searched as a
vector approximation file: each coordinate of an entry is quantised to a few
bits (cells of about equally many entries, with their least and greatest
value), a query part makes a table of its least and greatest squared distance
to every cell of every coordinate, and the entries' cells look their bounds up
in it. Only entries whose lower bound doesn't exceed the least upper bound are
refined with integer distances.

Codebooks are as large as their number of entries, so they pass through the
driver; a training round sends one row for each entry and part out of each
task, sums of its members, never the members.

Nulls and edges: vectors that are null or hold a null or non-finite component
are left out, as are none besides. Vectors of other lengths, or of a length
that the parts don't divide, count as if zeros followed up to the next
multiple of the longest; zeros add no distance. Integers beyond 2^24 count as
2^24 (either sign), so that sums stay exact. The first entries are those of
the least ids, null ids last, ties by components; with fewer vectors than
entries there are as many entries as vectors. Null labels count as one label.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.tasks import map_columns
from cairn.plans.durable import materialize, measured, scratch

LARGEST = 1 << 24


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of ``floor(256 * x)``, with zeros behind shorter vectors."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.clip(np.floor(lists.flatten().to_numpy(zero_copy_only=False) * 256), -LARGEST, LARGEST).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class CellFile:
    """One part's codebook behind its cells."""

    def __init__(self, entries: np.ndarray, bits: int = 4):
        self.entries = entries
        n, dims = entries.shape
        cells = min(1 << bits, n)
        self.low = np.zeros((dims, cells), np.int64)
        self.high = np.zeros((dims, cells), np.int64)
        self.cell = np.zeros((n, dims), np.int64)
        for d in range(dims):
            order = np.argsort(entries[:, d], kind="stable")
            self.cell[order, d] = np.arange(n) * cells // n
            for c in range(cells):
                inside = entries[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = inside.min(), inside.max()

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each part to each entry, by table lookups."""
        below, above = self.low - parts[:, :, None], parts[:, :, None] - self.high
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lower = np.zeros((len(parts), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(parts.shape[1]):
            lower += least[:, d, self.cell[:, d]]
            upper += most[:, d, self.cell[:, d]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part's nearest entry, the lower index at ties."""
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        # candidates stand by row, then by entry: the first of the least is wanted
        starts = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(distance, starts) if len(parts) else distance
        hits = np.flatnonzero(distance == least[row])
        first = hits[np.unique(row[hits], return_index=True)[1]]
        return entry[first], least


def _assigned(books: list[CellFile], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) of indexes and of squared distances."""
    each = np.split(vectors, len(books), axis=1)
    found = [book.nearest(part) for book, part in zip(books, each, strict=True)]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _blocks(column: pa.Array, width: int, most: int = 4096) -> Iterator[np.ndarray]:
    for at in range(0, len(column), most):
        yield integers(column.slice(at, most), width)


def first_entries(kept: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, components) from the rows of the least ids."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    column = pa.array([r["vector"] for r in rows], pa.list_(pa.float64()))
    return integers(column, width).reshape(len(rows), parts, width // parts).transpose(1, 0, 2)


def trained_round(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry replaced by the floored mean of the parts nearest to it, if there are any."""
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [CellFile(b) for b in books]
        sums, counts = np.zeros((parts * entries, dims), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for vectors in _blocks(batch.column("vector"), parts * dims):
                at = (_assigned(files, vectors)[0] + np.arange(parts) * entries).ravel()
                np.add.at(sums, at, vectors.reshape(-1, dims))
                counts += np.bincount(at, minlength=len(counts))
        used = np.flatnonzero(counts)
        columns = [pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "n", "sums"])

    shares = kept.select("vector").mapInArrow(run, "at int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(dims)]
    out = books.copy().reshape(parts * entries, dims)
    for row in shares.groupBy("at").agg(F.sum("n").alias("n"), *totals).collect():  # a row for each entry and part
        out[row["at"]] = [int(row[f"s{k}"]) // row["n"] for k in range(dims)]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_totals(coded: DataFrame, n: int, heavy_share: int = 1024) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over the rows of the same label.

    Labels that hold more than one row in ``heavy_share`` are fewer than that,
    so their totals are broadcast; no label of the others makes a hot key.
    """
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    totals = materialize(totals, "totals")
    heavy = totals.where(F.col("rows") * heavy_share > n)
    light = totals.where(F.col("rows") * heavy_share <= n)
    same = F.col("label").eqNullSafe(F.col("of"))
    common = coded.join(F.broadcast(heavy.select("of", "label_error")), same)
    rare = coded.join(F.broadcast(heavy.select("of")), same, "left_anti").join(light.select("of", "label_error"), same)
    return common.unionByName(rare)


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2
) -> DataFrame:
    """One row per vector kept: id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    kept = vectors.where(finite(F.col(vector_col)))
    kept = kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    with scratch(vectors.sparkSession):
        books = first_entries(kept, width, parts, entries)
        for _ in range(rounds if books.size else 0):
            books = trained_round(kept, books)

        def run(batch: pa.RecordBatch) -> dict:
            files = [CellFile(b) for b in books]
            codes, errors = [], []
            for block in _blocks(batch.column("vector"), width):
                index, distance = _assigned(files, block)
                codes += [bytes(r).hex() for r in index.astype(np.uint8)]
                errors.append(distance.sum(axis=1))
            return {"code": pa.array(codes, pa.string()), "error": pa.array(np.concatenate(errors) if errors else [], pa.int64())}

        coded, seen = measured(map_columns(kept, ["id", "label"], "code string, error long", run), "codes")
        out = label_totals(coded, seen["n"])
        out = out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
        return materialize(out, "vectors", kept=True)
