"""Aggregates of retrieval runs and graphs, and exact order statistics without a gathered column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import materialize


def ranked(results: DataFrame) -> DataFrame:
    """(result_id, name, file_path, score, source, rank) of the retrieved functions, best score first.

    A repeated result counts once.
    """
    once = results.where("result_id IS NOT NULL").select("result_id", "retrieved_functions").dropDuplicates(["result_id"])
    each = once.select("result_id", F.explode("retrieved_functions").alias("u")).select("result_id", "u.name", "u.file_path", "u.score", "u.source")
    w = Window.partitionBy("result_id").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("file_path"), F.asc_nulls_last("name"))
    return each.withColumn("rank", F.row_number().over(w))


def share(condition: Column) -> Column:
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 6)


def recall_at(ranks: DataFrame, gold: Column, ks: list[int]) -> DataFrame:
    """(k, recall, hit_rate): share of gold rows, and of results with one, within the first k."""
    grid = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    g = ranks.where(gold).select("result_id", "rank", grid)
    per = g.groupBy("k", "result_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("rank") <= F.col("k"), 1).otherwise(0)).alias("found"))
    return per.groupBy("k").agg(F.round(F.sum("found") / F.sum("n"), 6).alias("recall"), share(F.col("found") > 0).alias("hit_rate"))


def coverage(ranks: DataFrame, gold: Column, k: int) -> DataFrame:
    """(result_id, covered): the share of a result's gold rows within the first k."""
    hit = F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    return ranks.where(gold).groupBy("result_id").agg(F.avg(hit).alias("covered"))


def values_at(df: DataFrame, col: str, ranks: dict[str, Column]) -> DataFrame:
    """One row with the column's values at the wanted places (from 1) of its ascending order.

    ``ranks`` maps names to expressions over ``n``, the number of non-null
    values. The values are range-partitioned; counts per partition tell where a
    place lies, and only that partition is sorted.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(col).alias("v")).where("v IS NOT NULL").repartitionByRange(parts, "v")
    rows = materialize(rows.withColumn("p", F.spark_partition_id()))
    sizes = {r["p"]: r["n"] for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    n = sum(sizes.values())
    places = spark.range(1).select(F.lit(n).alias("n")).select(*[e.cast("long").alias(k) for k, e in ranks.items()]).first()
    out = None
    for name in ranks:
        want, before = max(1, min(places[name], n)), 0
        for p in sorted(sizes):
            if want <= before + sizes[p]:
                break
            before += sizes[p]
        else:
            p = -1
        at = rows.where(F.col("p") == p).orderBy("v").limit(want - before).agg(F.max("v").alias(name))
        out = at if out is None else out.crossJoin(at)  # one row each
    return out


def bins(col: str, edges: list[float]) -> Column:
    """The number of the half-open bin; the last one is closed."""
    c = F.col(col)
    out = F.when(F.lit(False), 0)
    for k in range(len(edges) - 1):
        top = c <= edges[k + 1] if k == len(edges) - 2 else c < edges[k + 1]
        out = out.when((c >= edges[k]) & top, k)
    return out


def missing_penalty_rank(ranks: DataFrame, runs: int, k: int) -> DataFrame:
    """(name, score): mean rank over ``runs`` runs; where a name is missing, it counts k + 1."""
    agg = ranks.groupBy("name").agg(F.sum("rank").alias("s"), F.count("*").alias("n"))
    return agg.select("name", F.round((F.col("s") + (runs - F.col("n")) * (k + 1)) / runs, 6).alias("score"))


def top_list(df: DataFrame, group: str, value: str, most: int, out: str) -> DataFrame:
    """(group, out): the group's first ``most`` distinct values, joined by |; no group is gathered."""
    d = df.where(F.col(value).isNotNull()).select(group, value).distinct()
    w = Window.partitionBy(group).orderBy(value)
    kept = d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return kept.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(value)), "|").alias(out))


def run_deltas(base: DataFrame, new: DataFrame) -> DataFrame:
    """One row that compares two runs (ok boolean, latency_ms): shares of sound answers and the differences."""

    def one(df: DataFrame, run: str) -> DataFrame:
        return df.agg(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias(f"{run}_ok"), F.avg("latency_ms").alias(f"{run}_ms"), F.count("*").alias(f"{run}_n"))

    both = one(base, "base").crossJoin(one(new, "new"))  # one row each
    delta = lambda c, k: F.round(F.col(f"new_{c}") - F.col(f"base_{c}"), k)
    return both.select(F.round("base_ok", 6).alias("base_ok"), F.round("new_ok", 6).alias("new_ok"), delta("ok", 6).alias("ok_delta"), delta("ms", 4).alias("latency_delta"), (F.col("new_n") - F.col("base_n")).alias("count_delta"))
