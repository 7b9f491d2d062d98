"""Arrow-batched work inside tasks that keeps key columns as they are."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def hand_back() -> None:
    """Memory that a task has freed goes back to the system: its worker stays for later tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def map_columns(rows: DataFrame, keep: list[str], made: str, fn: Callable[[pa.RecordBatch], dict], most: int | None = None) -> DataFrame:
    """``keep``'s columns unchanged, beside those that ``fn`` makes of each batch (``made``: their DDL).

    With ``most`` batches come, and go on, in slices of about so many bytes of text.
    """
    new = StructType.fromDDL(made)
    out = StructType([rows.schema[c] for c in keep] + list(new))
    types = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=most) if most else [whole]:
                columns = fn(batch)
                arrays = [batch.column(c) for c in keep]
                arrays += [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in types]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out])
        hand_back()

    return rows.mapInArrow(run, out)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that text operators read, as ``id`` and ``text``; a null text becomes empty."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose text has about ``most`` bytes, so that arrays made from it stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
