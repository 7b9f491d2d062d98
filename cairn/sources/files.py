"""Sources and sinks: file trees, strict JSON lines, committed tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.functions.text import mask_secrets, source_layout
from cairn.operators.select import scan_violations

#: Directories that a scan never reads, and its inclusive limits.
IGNORED = [".git", ".idea", ".vscode", ".ai-docs", "node_modules", "target", "build", "dist", "out", ".gradle"]
UI_IGNORED = [".git", ".idea", ".vscode", ".ai-docs", "node_modules", "dist", "build", "coverage", "out", ".next", ".turbo"]
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 50_000, 5 << 20, 512 << 20

#: Build files of a Spring repository, and what begins the names of its settings.
BUILD_FILES = ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"]
SETTINGS = ["application", "bootstrap"]


def _name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def file_kind(path: Column) -> Column:
    return F.when(path.endswith(".java"), "java").when(_name(path).isin(*BUILD_FILES, "package.json"), "build").when(path.rlike(r"\.(properties|ya?ml)\z"), "config").when(
        path.rlike(r"\.[jt]sx?\z"), "script"
    )


def below_ignored(path: Column, ignored: list[str]) -> Column:
    """Whether a file lies below a directory of one of these names, in any case."""
    folders = F.transform(F.split(path, "/"), F.lower)
    return F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*[F.lit(n) for n in ignored]))


def scan_files(spark: SparkSession, root: str, ignored: list[str] | None = None) -> DataFrame:
    """(path, kind, size, content, module_path, source_set, source_root) of the relevant text files below ``root``, whose paths are relative to it.

    Paths are filtered before contents are decoded; a file with a NUL byte is
    binary and goes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    at = F.instr("path", base)
    relative = F.when(at > 0, F.substr("path", at + len(base))).otherwise(F.col("path"))
    files = raw.withColumn("path", relative).where(~below_ignored(F.col("path"), ignored or IGNORED)).withColumn("kind", file_kind(F.col("path"))).where("kind is not null")
    layout = source_layout("path")
    text = F.decode("content", "UTF-8")
    return files.where(F.instr(F.col("content"), F.lit("\0")) == 0).select(
        "path", "kind", F.col("length").alias("size"), text.alias("content"), layout["module_path"].alias("module_path"), layout["source_set"].alias("source_set"), layout["source_root"].alias("source_root")
    )


def spring_relevant(path: Column) -> Column:
    """Build files, Java sources of both source sets, and the settings among the resources, in any case."""
    p, name = F.concat(F.lit("/"), F.lower(path)), _name(path)
    inside = lambda source_set, folder: p.contains(f"/src/{source_set}/{folder}/")
    parts = F.split(name, "[.]")
    stem = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ".")
    called = F.lit(False)
    for s in SETTINGS:
        called = called | (stem == s) | (stem.startswith(f"{s}-") & (F.length(stem) > len(s) + 1))
    settings = inside("main", "resources") & called & F.element_at(parts, -1).isin("properties", "yml", "yaml")
    return name.isin(*BUILD_FILES) | ((inside("main", "java") | inside("test", "java")) & name.endswith(".java")) | settings


def ui_relevant(path: Column) -> Column:
    """Scripts, the package and the bundler's settings."""
    return path.rlike(r"(?i)\.[tj]sx?\z") | path.rlike(r"(?i)(\A|/)(package\.json|(vite|webpack|next)\.config\.[^/]*)\z")


def scan_repository(spark: SparkSession, root: str, user_interface: bool = False, limits: tuple[int, int, int] = (MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES)) -> DataFrame:
    """The relevant text files of a repository in path order; an error names the first file beyond the limits on number, size and total."""
    files = scan_files(spark, root, UI_IGNORED if user_interface else IGNORED)
    files = files.where((ui_relevant if user_interface else spring_relevant)(F.col("path")))
    broken = scan_violations(files.select(F.lit(0).alias("scan"), "path", "size"), ["scan"], *limits).first()
    if broken:
        raise ValueError(f"{broken['violation']}: {broken['path']}")
    return files.orderBy("path")


def build_tool() -> Column:
    """Aggregate over a scan's paths: Maven wins over Gradle."""
    maven, gradle = F.bool_or(F.col("path").rlike(r"(\A|/)pom\.xml\z")), F.bool_or(F.col("path").rlike(r"(\A|/)(build|settings)\.gradle(\.kts)?\z"))
    return F.when(maven, "Maven").when(gradle, "Gradle").otherwise("Unknown")


def ui_indicators() -> Column:
    """Aggregate over a scan's (path, content): what tells the user interface's framework, in a fixed order."""
    any_of = lambda path, content=None: F.bool_or(F.col("path").rlike(path) & (F.lit(True) if content is None else F.col("content").rlike(content)))
    facts = [
        (any_of(r"(?i)(\A|/)package\.json\z", r'"react"\s*:'), "react dependency"),
        (any_of(r"(?i)(\A|/)vite\.config\."), "vite config"),
        (any_of(r"(?i)(\A|/)next\.config\."), "next config"),
        (any_of(r"(?i)(\A|/)src/(App\.[tj]sx|main\.tsx|index\.tsx)\z"), "entry file"),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in facts]), lambda x: x.isNotNull())


def files_matching(files: DataFrame, patterns: list[str]) -> DataFrame:
    """The files whose path matches one of the patterns."""
    return files.where(F.col("path").rlike("|".join(f"(?:{p})" for p in patterns)))


def contained(files: DataFrame, path: str = "path") -> DataFrame:
    """Files whose path stays inside the root: relative, without . and .. segments."""
    p = F.regexp_replace(F.col(path), r"\\", "/")
    return files.where(~p.rlike(r"(?i)\A(/|[a-z]:|~)") & ~p.rlike(r"(\A|/)\.{1,2}(/|\z)"))


def read_optional_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): the whole text at ``path``, one row; empty where nothing is there."""
    try:
        found = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([("",)], "value string")
    return found


def read_required_jsonl(spark: SparkSession, path: str, schema: StructType, required: list[str] | None = None) -> DataFrame:
    """:func:`read_jsonl`, with a missing path as its own error."""
    try:
        return read_jsonl(spark, path, schema, required)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"JSONL_NOT_FOUND: {path}") from error
        raise


def read_jsonl(spark: SparkSession, path: str, schema: StructType, required: list[str] | None = None) -> DataFrame:
    """Strict JSON lines under an explicit schema: blank lines and a byte-order mark are skipped, anything malformed is an error.

    A record that lacks one of ``required`` is an error as well. Checks are
    expressions of the plan, so no second pass reads the file.
    """
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", "")).where(F.trim("value") != "")
    wide = StructType([*schema.fields]).add("__bad", "string")
    parsed = lines.select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    lacks = F.lit(False)
    for c in required or []:
        lacks = lacks | F.col(f"r.{c}").isNull()
    error = F.when(bad, F.raise_error(F.concat(F.lit("JSONL_INVALID_JSON: "), F.left("value", F.lit(120))))).when(
        lacks, F.raise_error(F.concat(F.lit("JSONL_INVALID_RECORD: "), F.left("value", F.lit(120))))
    )
    checked = parsed.withColumn("r", F.when(error.isNull(), F.col("r")))
    return checked.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_audit(rows: DataFrame, path: str, error: str = "error", most: int = 4000) -> None:
    """Appends one JSON line a row; errors are masked and cut."""
    kept = rows.withColumn(error, F.left(mask_secrets(error), F.lit(most))) if error in rows.columns else rows
    kept.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def write_markdown(docs: DataFrame, path: str, title: str, repository: str, branch: str) -> None:
    """One text row a document (name, body): a header of title, repository and branch, then the body; partitioned by name."""
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.lit(title)), F.lit(""), F.concat(F.lit("- Repository: "), F.lit(repository)), F.concat(F.lit("- Branch: "), F.lit(branch)), F.concat(F.lit("- Generated: "), F.current_timestamp().cast("string")), F.lit(""))
    docs.select("name", F.concat(head, F.lit("\n"), "body").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def write_json_documents(docs: DataFrame, path: str) -> None:
    """One pretty JSON document a row, nulls left out."""
    docs.select(F.to_json(F.struct(*docs.columns), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def commit_manifest(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> None:
    """Writes each table under ``folder`` and, last, a manifest of names and row counts: what it lists is whole."""
    counts = []
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts.append((name, spark.read.parquet(f"{folder}/{name}").count()))
    spark.createDataFrame(counts, "name string, n_rows long").coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
