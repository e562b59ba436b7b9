"""Context for an answer: expansion, budgets, buckets, templates and recorded decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of expansion from the least to the most code (fixed values).
LEVELS = ("SIGNATURE", "BODY", "CLASS", "FULL_FILE")


def level_rank(col: str) -> Column:
    rank = F.when(F.lit(False), 0)
    for k, level in enumerate(LEVELS):
        rank = rank.when(F.col(col) == level, k + 1)
    return rank.otherwise(0)


def widest(hits: DataFrame, key: list[str]) -> DataFrame:
    """The row of each key with the widest expansion, then the best score, then the smallest id."""
    w = Window.partitionBy(*key).orderBy(level_rank("expand_level").desc(), F.desc_nulls_last("score"), "rf_id")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_steps(steps: DataFrame, group: str) -> DataFrame:
    """(group, name, step): what each step adds to what the steps before found; a repeated action adds nothing."""
    return steps.groupBy(group, "name").agg(F.min("step").alias("step"))


def context(hits: DataFrame, group: str, budget: int, priority: Column) -> DataFrame:
    """Bodies of each group within 80 % of the budget, priority names first, until the first overflow."""
    w = Window.partitionBy(group).orderBy(priority.desc(), F.desc_nulls_last("score"), "rf_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("used", F.sum("size").over(w)).where(F.col("used") <= int(budget * 0.8))


#: Buckets of the context and how many hits each takes (fixed values).
BUCKETS = {"high": 5, "embedding": 5, "grep": 3, "graph": 10, "call_chain": 5}


def bucketed(hits: DataFrame, group: str) -> DataFrame:
    """(group, bucket, name): a hit's bucket is high from 0.5 on, else its source; each takes its best hits."""
    bucket = F.when(F.col("score") > 0.5, "high").otherwise(F.col("source"))
    one = hits.withColumn("bucket", bucket).groupBy(group, "bucket", "name").agg(F.max("score").alias("score"))
    w = Window.partitionBy(group, "bucket").orderBy(F.desc_nulls_last("score"), "name")
    most = F.when(F.lit(False), 0)
    for b, n in BUCKETS.items():
        most = most.when(F.col("bucket") == b, n)
    return one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most.otherwise(3)).drop("_r")


def whole_or_best(bodies: DataFrame, budget: int) -> DataFrame:
    """(file_path, whole, rf_id): a file whose bodies fit the budget is taken whole, of others the best bodies that fit."""
    total = bodies.groupBy("file_path").agg(F.sum("size").alias("total"))
    w = Window.partitionBy("file_path").orderBy(F.desc_nulls_last("score"), "rf_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = bodies.withColumn("used", F.sum("size").over(w)).join(total, "file_path")
    return rows.where((F.col("total") <= budget) | (F.col("used") <= budget)).select("file_path", (F.col("total") <= budget).alias("whole"), "rf_id")


def query_analysis(col: str) -> Column:
    """A recorded analysis as a struct, its confidence between 0 and 1."""
    o = F.from_json(col, "query_type string, symbols array<string>, confidence double")
    return F.struct(F.coalesce(o["query_type"], F.lit("unknown")).alias("query_type"), F.coalesce(F.size(o["symbols"]), F.lit(0)).alias("symbols"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(o["confidence"], F.lit(0.0)))).alias("confidence"))


def render(template: str, cols: dict[str, Column]) -> Column:
    """Fills ``{name}`` places of a template."""
    out = F.lit(template)
    for name, c in cols.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def frontier(found: DataFrame, visited: DataFrame, group: str) -> DataFrame:
    """(group, item, rank): new items of a group in order, without those visited."""
    new = found.select(group, "item").distinct().join(visited.select(group, "item"), [group, "item"], "left_anti")
    return new.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("item")))


#: Actions that may be taken again on one target (fixed values).
SEARCHES = ("grep_search", "semantic_search")


def agent_loop(steps: DataFrame, group: str, most: int = 5) -> DataFrame:
    """(group, step, action, target, gain) of the recorded steps that the loop takes.

    ``steps`` has one row per found name: (group, step, action, target, name).
    The last of ``most`` steps is no action any more. An action other than a
    search is taken once per target; a repeated one is skipped. The gain of a
    step are the names that no step before it found. After two steps in a row
    that gain at most one name, from the third step on, the loop ends.
    """
    one = steps.where(F.col("step") < most).groupBy(group, "step", "action", "target").agg(F.count("*").alias("_n"))
    again = F.row_number().over(Window.partitionBy(group, "action", "target").orderBy("step"))
    taken = one.withColumn("_a", again).where((F.col("_a") == 1) | F.col("action").isin(*SEARCHES)).select(group, "step", "action", "target")
    names = steps.join(taken.select(group, "step"), [group, "step"], "left_semi").where("name IS NOT NULL").groupBy(group, "name").agg(F.min("step").alias("step"))
    gain = names.groupBy(group, "step").agg(F.count("*").alias("gain"))
    rows = taken.join(gain, [group, "step"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    w = Window.partitionBy(group).orderBy("step")
    ends = (F.col("step") >= 3) & (F.col("gain") <= 1) & (F.lag("gain").over(w) <= 1)
    rows = rows.withColumn("_end", F.coalesce(ends, F.lit(False)).cast("int"))
    before = F.coalesce(F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_b", before).where("_b = 0").select(group, "step", "action", "target", "gain")


def run_actions(actions: DataFrame, calls: DataFrame, functions: DataFrame, k: int = 10) -> DataFrame:
    """(action, target, name, file_path, source): what the expanding actions (action, target) find, the first ``k`` names of each.

    ``calls`` has (src, dst), ``functions`` (name, file_path, parent_class).
    Other actions find nothing here.
    """
    a = actions.select("action", "target").distinct()
    of = lambda action: a.where(F.col("action") == action)
    place = functions.where("name IS NOT NULL").groupBy("name").agg(F.min("file_path").alias("file_path"))
    callers = of("expand_callers").join(calls.select(F.col("dst").alias("target"), F.col("src").alias("name")), "target")
    callees = of("expand_callees").join(calls.select(F.col("src").alias("target"), F.col("dst").alias("name")), "target")
    linked = callers.unionByName(callees).join(place, "name").select("action", "target", "name", "file_path")

    def beside(action: str, column: str) -> DataFrame:
        own = functions.where(F.col(column).isNotNull() & F.col("name").isNotNull()).select("name", "file_path", *([column] if column != "file_path" else [])).distinct()
        at = of(action).join(own.select(F.col("name").alias("target"), F.col(column).alias("_c")), "target").distinct()
        near = at.join(own.withColumn("_c", F.col(column)), "_c").where("name <> target")
        return near.groupBy("action", "target", "name").agg(F.min("file_path").alias("file_path"))

    found = linked.unionByName(beside("expand_same_file", "file_path")).unionByName(beside("expand_same_class", "parent_class"))
    w = Window.partitionBy("action", "target").orderBy("name")
    source = F.concat(F.regexp_replace(F.regexp_replace("action", "^expand_", ""), "(caller|callee)s$", "$1"), F.lit("_of_"), "target")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("action", "target", "name", "file_path", source.alias("source"))


def candidate_queue(offers: DataFrame, visited: DataFrame, group: str) -> DataFrame:
    """(group, item, place): candidates in the order they were first offered (step, pos), without those visited."""
    first = offers.groupBy(group, "item").agg(F.min(F.struct("step", "pos")).alias("_at"))
    open_ = first.join(visited.select(group, "item").distinct(), [group, "item"], "left_anti")
    return open_.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_at", "item"))).select(group, "item", "place")
