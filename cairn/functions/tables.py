"""The extractors as table functions, for SQL: ``FROM files f, LATERAL java_endpoints(f.content)``.

Each takes one file's content and gives the rows that the DataFrame operators
give, without the path. A lateral call hands over all rows of a file at once;
where files are large, ``java_endpoints_of(TABLE(SELECT path, content FROM
files))`` and its like give the same rows with the path, few at a time.
``first_rows`` and ``as_of_marks`` take a table by
partition, as ``TABLE(x) PARTITION BY k ORDER BY (o)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, arrow_udtf, udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from cairn.functions import calls, scan
from cairn.operators import extract, syntax

#: Name to the function of a text and the columns of its rows.
TABLES: dict[str, tuple[Callable[[str], Iterable[tuple]], str]] = {
    "java_endpoints": (syntax._endpoints, syntax.ENDPOINT),
    "java_method_calls": (extract._method_calls, "class_name string, method string, ord int, receiver string, receiver_type string, target string, confidence string"),
    "java_methods": (lambda t: [(n, a, b, scan.line_of(t, a)) for n, a, b in scan.java_methods(t)], "method string, start int, stop int, start_line int"),
    "java_fields": (extract._members, "class_name string, ord int, field string, type string, validations array<string>"),
    "java_client_calls": (calls.fluent_calls, "ord int, http_method string, target_path string, name string, headers array<string>, body string"),
    "java_template_calls": (calls.template_calls, "ord int, operation string, http_method string, target_path string"),
    "java_assigned_paths": (calls.assigned_paths, "ord int, name string, value string"),
    "script_calls": (calls.script_calls, "ord int, receiver string, http_method string, expression string, options array<string>, confidence string"),
    "script_functions": (calls.script_functions, "ord int, function string"),
    "script_components": (calls.script_components, "ord int, component string, export string, children array<string>, imports array<string>, props_type string"),
    "script_interactions": (calls.interactions, "ord int, element string, event string, handler string, label string"),
}


def _lateral(fn: Callable[[str], Iterable[tuple]]) -> type:
    class Rows:
        def eval(self, content: str) -> Iterator[tuple]:
            yield from fn(content or "")

    return Rows


def _of_table(fn: Callable[[str], Iterable[tuple]], schema: pa.Schema) -> type:
    class Rows:
        def eval(self, files: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for path, content in zip(files.column("path"), files.column("content"), strict=True):
                for rows in batched(fn(content.as_py() or ""), extract.ROWS):
                    made = [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(path, len(rows)), *made], schema=schema)

    return Rows


class FirstRows:
    """The first ``n`` rows of each partition, in the order that the call gives; nothing but a counter is held."""

    def __init__(self):
        self.seen = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or n.isTable:
            raise ValueError("first_rows takes a table and a number")
        return AnalyzeResult(rows.dataType)

    def eval(self, rows: Row, n: int) -> Iterator[tuple]:
        self.seen += 1
        if self.seen <= n:
            yield tuple(rows)


class AsOfMarks:
    """Rows of each partition with ``last_mark``: the named column's last value that isn't null, up to this row."""

    def __init__(self):
        self.last = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        fields = StructType([*rows.dataType.fields]).add("last_mark", StringType())
        return AnalyzeResult(fields)

    def eval(self, rows: Row, column: str) -> Iterator[tuple]:
        if rows[column] is not None:
            self.last = str(rows[column])
        yield (*rows, self.last)


def register(spark: SparkSession) -> list[str]:
    """Register all table functions in the session; their names."""
    for name, (fn, columns) in TABLES.items():
        spark.udtf.register(name, udtf(_lateral(fn), returnType=columns))
        whole = f"path string, {columns}"
        spark.udtf.register(f"{name}_of", arrow_udtf(_of_table(fn, to_arrow_schema(StructType.fromDDL(whole))), returnType=whole))
    spark.udtf.register("first_rows", udtf(FirstRows))
    spark.udtf.register("as_of_marks", udtf(AsOfMarks))
    return [*TABLES, *(f"{name}_of" for name in TABLES), "first_rows", "as_of_marks"]
