"""Tables that the queries derive from the test data, for both engines.

``functions`` holds the newest state of every extracted function. ``nodes`` has
one row per function name with its first place. ``calls`` has the directed
edges between names that follow each other in a retrieval trace; it has hubs
and cycles. ``lines`` are the source lines of the retrieved bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.hotkeys import latest_by_id
from codequarry.session import table

QUERIES: dict = {}
ORACLE: dict = {}

COLS = ["id", "name", "signature", "file_path", "start_line", "end_line", "parent_class", "param_count", "fan_in", "fan_out"]


def functions(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "function_nodes")
    v = ["extracted_at", "ingested_at"]
    return latest_by_id(df, "id", v, [*COLS, *v]).select(*COLS)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return (
        functions(spark, d)
        .where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.min("file_path").alias("file_path"), F.min("start_line").alias("start_line"))
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform("retrieved_functions", lambda x: x["name"])
    later = F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))
    steps = table(spark, d, "qa_results").where("retrieved_functions IS NOT NULL").select(F.explode(F.arrays_zip(names.alias("src"), later.alias("dst"))).alias("e"))
    return steps.select("e.src", "e.dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(file, line_no, text): the body of the first row of each path, if any."""
    rf = table(spark, d, "retrieved_functions").where("file_path IS NOT NULL AND body IS NOT NULL AND rf_id IS NOT NULL")
    one = rf.select("rf_id", "file_path", "body").dropDuplicates(["rf_id"])
    parts = one.select("rf_id", "file_path", F.posexplode(F.split("body", "\n")).alias("k", "text"))
    return parts.select("rf_id", "file_path", (F.col("k") + 1).alias("line_no"), F.rtrim(F.regexp_replace("text", "\r$", "")).alias("text"))


SQL_FUNCTIONS = """functions AS (SELECT id, name, signature, file_path, start_line, end_line, parent_class, param_count, fan_in, fan_out
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY extracted_at DESC NULLS LAST, ingested_at DESC NULLS LAST, name DESC NULLS LAST) AS rn
        FROM function_nodes WHERE id IS NOT NULL) z WHERE rn = 1)"""
SQL_NODES = SQL_FUNCTIONS + """, nodes AS (SELECT name, min(file_path) AS file_path, min(start_line) AS start_line
  FROM functions WHERE name IS NOT NULL GROUP BY name)"""
SQL_CALLS = """calls AS (SELECT DISTINCT src, dst FROM (
  SELECT retrieved_functions[i].name AS src, retrieved_functions[i + 1].name AS dst
  FROM (SELECT retrieved_functions, unnest(range(1, len(retrieved_functions))) AS i FROM qa_results) y) z
  WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"""
SQL_LINES = """lines AS (SELECT rf_id, file_path, i AS line_no, rtrim(regexp_replace(parts[i], '\\r$', '')) AS text FROM (
  SELECT rf_id, file_path, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT rf_id, any_value(file_path) AS file_path, string_split(any_value(body), chr(10)) AS parts FROM retrieved_functions
    WHERE file_path IS NOT NULL AND body IS NOT NULL AND rf_id IS NOT NULL GROUP BY rf_id) y) z)"""
