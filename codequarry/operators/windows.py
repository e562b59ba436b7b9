"""Ranking, running and state-like operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import materialize


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def two_stage(chunks: DataFrame, query: str, files: int, per_file: int) -> DataFrame:
    """The best ``per_file`` chunks of each of the ``files`` best files of every query (score, file_path, name)."""
    best = chunks.groupBy(query, "file_path").agg(F.max("score").alias("file_score"))
    best = top_per_group(best, [query], [F.desc("file_score"), "file_path"], files)
    return top_per_group(chunks.join(best, [query, "file_path"]), [query, "file_path"], [F.desc("score"), "name"], per_file)


def offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, n, offset): how many items lie before each key in key order.

    Prefix sums in two levels: within range partitions, then over the
    partitions' totals, so no single task orders all keys.
    """
    parts = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = counts.select(key, n).repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id())
    rows = materialize(rows)
    totals = rows.groupBy("_p").agg(F.sum(n).alias("_t"))
    over = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = totals.select("_p", F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_b"))
    inner = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_c", F.coalesce(F.sum(n).over(inner), F.lit(0))).join(F.broadcast(base), "_p")
    return out.select(key, n, (F.col("_b") + F.col("_c")).alias("offset"))


def pack(rows: DataFrame, group: str, order: list, size: str, budget: int) -> DataFrame:
    """The rows of each group, in order, until the first one that would exceed the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # sizes are not negative, so the running sum never comes back under the budget
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def information_gain(steps: DataFrame, group: str) -> DataFrame:
    """(group, step, gain, stop): items first seen at each step (group, step, item).

    ``stop`` is set from the third step on where this and the step before
    gained at most one.
    """
    first = steps.groupBy(group, "item").agg(F.min("step").alias("step"))
    gain = first.groupBy(group, "step").agg(F.count("*").alias("_g"))
    every = steps.select(group, "step").distinct().join(gain, [group, "step"], "left").withColumn("gain", F.coalesce("_g", F.lit(0)))
    w = Window.partitionBy(group).orderBy("step")
    last = F.greatest(F.col("gain"), F.lag("gain").over(w))
    return every.select(group, "step", "gain", F.coalesce((F.row_number().over(w) >= 3) & (last <= 1), F.lit(False)).alias("stop"))


def with_context(lines: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """(rf_id, hit, line_no, text): each hit's line with the ``n`` lines on either side."""
    around = hits.select("rf_id", F.col("line_no").alias("hit"), F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("line_no"))
    return around.join(lines.select("rf_id", "line_no", "text"), ["rf_id", "line_no"])
