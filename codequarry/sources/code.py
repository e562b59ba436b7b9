"""Reading code and documents from files and from line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that hold no sources of the project (fixed values).
SKIPPED = r"(^|/)(build|vendor|third_party|node_modules|__pycache__|\.[^/.][^/]*)/"


def read_texts(spark: SparkSession, root: str, pattern: str = "*", lines: bool = False) -> DataFrame:
    """(file_path, text) of every file below ``root`` that matches, or (file_path, line_no, text).

    Paths are relative to ``root``. Directories of builds, copies and hidden
    ones are skipped; files are found and read by the executors.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace(F.expr("_metadata.file_path"), "^file:/*", "/"), "^" + "\\Q" + base + "\\E/", "")
    out = raw.select(path.alias("file_path"), F.col("value").alias("text")).where(~F.col("file_path").rlike(SKIPPED))
    return explode_lines(out) if lines else out


def explode_lines(texts: DataFrame) -> DataFrame:
    k = texts.select("file_path", F.posexplode(F.split("text", "\r?\n")).alias("k", "text"))
    return k.select("file_path", (F.col("k") + 1).alias("line_no"), "text")


def read_sources(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("c", "cc", "cpp", "cxx", "h", "hpp", "py")) -> DataFrame:
    """Sources in order of kind (implementations, then headers) and path: (file_path, is_header, text)."""
    files = read_texts(spark, root, "*.{" + ",".join(suffixes) + "}")
    return files.withColumn("is_header", F.col("file_path").rlike(r"\.(h|hpp)$")).orderBy("is_header", "file_path")


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the translation units in a compile_commands.json."""
    return spark.read.json(path, multiLine=True).select("file").distinct()


def read_markdown(spark: SparkSession, root: str, most_lines: int = 3000, denied: str = r"(?i)(changelog|\.github/|release)") -> DataFrame:
    docs = read_texts(spark, root, "*.md")
    return docs.where(~F.col("file_path").rlike(denied) & (F.size(F.split("text", "\n")) <= most_lines))


def read_records(spark: SparkSession, path: str, kind: str, items: str | None = None, schema: str | None = None) -> DataFrame:
    """Benchmark and result files: json (one document, rows below ``items``), jsonl or csv.

    With a ``schema`` only its fields are parsed and no file is read twice to infer them.
    """
    if kind == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = spark.read.json(path, schema=schema, multiLine=kind == "json")
    return df.select(F.explode(items).alias("r")).select("r.*") if items else df


def numbered(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, code): the lines with their numbers in front, in order; for spans of a bounded length."""
    row = F.struct("line_no", F.concat(F.lpad(F.col("line_no").cast("string"), 4, " "), F.lit(" | "), "text").alias("t"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["t"]), "\n").alias("code"))


def read_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, code) of the spans (id, file_path, start_line, end_line), both ends included."""
    each = spans.where("start_line <= end_line").select("id", "file_path", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    return numbered(each.join(lines, ["file_path", "line_no"]), "id")


def implementation_text(headers: DataFrame, sources: DataFrame, least: int = 150) -> DataFrame:
    """(file_path, text): a short header's text, or its implementation's where that is longer.

    The implementation of the same directory and stem is tried first, then any
    of the same stem; the longest text wins, ties by path.
    """
    stem: Column = F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.[^.]*$", "")
    place: Column = F.regexp_replace("file_path", r"\.[^.]*$", "")
    s = sources.where(~F.col("file_path").rlike(r"\.(h|hpp)$")).select(stem.alias("stem"), place.alias("place"), F.col("text").alias("impl"), F.col("file_path").alias("p"))
    near = s.groupBy("place").agg(F.max(F.struct(F.length("impl"), "impl")).alias("near"))
    far = s.groupBy("stem").agg(F.max(F.struct(F.length("impl"), "p", "impl")).alias("far"))
    h = headers.withColumns({"stem": stem, "place": place}).join(near, "place", "left").join(far, "stem", "left")
    other = F.coalesce(F.col("near.impl"), F.col("far.impl"))
    return h.select("file_path", F.when((F.length("text") < least) & (F.length(other) > F.length("text")), other).otherwise(F.col("text")).alias("text"))


def project_files(files: DataFrame) -> DataFrame:
    """(file_path, is_header) of the project's own sources, each once."""
    own = files.where(F.col("file_path").isNotNull() & ~F.col("file_path").rlike(SKIPPED)).select("file_path").distinct()
    return own.withColumn("is_header", F.col("file_path").rlike(r"\.(h|hpp)$"))
