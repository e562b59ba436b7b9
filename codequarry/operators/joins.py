"""Range, as-of and prioritised joins between calls, lines and functions.

A line lies in few functions, but a name or file may own many rows. Spans are
therefore cut into buckets of lines; the equi-join on (key, bucket) bounds what
meets in one task, and the exact bounds are checked after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import materialize

#: Lines of one bucket; a function of common length lies in one or two.
BUCKET = 64


def spans(functions: DataFrame, key: str) -> DataFrame:
    """(key, bucket, id, start_line, end_line): one row for every bucket that a function touches."""
    first, last = F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET)
    return functions.where("start_line IS NOT NULL AND end_line >= start_line").select(
        key, "id", "start_line", "end_line", F.explode(F.sequence(first, last)).alias("bucket")
    )


def containing(points: DataFrame, functions: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Every (point, function) with equal key and the point's line in the function's span."""
    p = points.withColumn("bucket", F.floor(F.col(line) / BUCKET))
    hit = p.join(spans(functions, key), [key, "bucket"])
    return hit.where((F.col(line) >= F.col("start_line")) & (F.col(line) <= F.col("end_line"))).drop("bucket")


def _first(rows: DataFrame, by: str, *order) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def innermost(points: DataFrame, functions: DataFrame, key: str = "file_path", point: str = "point") -> DataFrame:
    """(point, id) of the innermost span around each point: the one that starts last, then ends first."""
    return _first(containing(points, functions, key), point, F.desc("start_line"), "end_line", "id").select(point, "id")


def caller_of(points: DataFrame, functions: DataFrame) -> DataFrame:
    """(point, id): the function that starts at the line, else the first one around it."""
    hit = containing(points, functions, "file_path")
    return _first(hit, "point", (F.col("start_line") != F.col("line")).cast("int"), "id").select("point", "id")


def containing_or_before(points: DataFrame, functions: DataFrame) -> DataFrame:
    """(point, id, how): the first function around the line, else the nearest one that starts before it.

    The backward search is one ordered pass over a file's starts and points.
    """
    inside = _first(containing(points, functions, "file_path"), "point", "start_line", "id").select("point", "id", F.lit("inside").alias("how"))
    rest = points.join(inside, "point", "left_anti")
    starts = functions.where("start_line IS NOT NULL").groupBy("file_path", "start_line").agg(F.max("id").alias("id"))
    marks = starts.select("file_path", F.col("start_line").alias("line"), F.lit(0).alias("k"), "id", F.lit(None).cast("long").alias("point"))
    asks = rest.select("file_path", "line", F.lit(1).alias("k"), F.lit(None).cast("string").alias("id"), F.col("point").cast("long"))
    w = Window.partitionBy("file_path").orderBy("line", "k", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = marks.unionByName(asks).withColumn("found", F.last("id", True).over(w)).where("k = 1 AND found IS NOT NULL")
    return inside.unionByName(back.select("point", F.col("found").alias("id"), F.lit("before").alias("how")))


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call_id, rule, status, id, candidates) of every call (call_id, name, file_path, line, caller_id).

    Rules in order; the first that yields anything decides: 1 the location
    (file and name, line inside), 2 the name anywhere with the line inside,
    3 the name in the file, 4 the name anywhere. Rules 1 and 2 take the first
    by start line; 3 and 4 are ambiguous with more than one candidate. A call
    of an unknown name is external. Calls of the caller itself are left out.
    """
    calls = materialize(calls)
    fn = materialize(functions.where("name IS NOT NULL").select("id", "name", "file_path", "start_line", "end_line"))
    file_name = F.concat_ws("\0", F.coalesce("file_path", F.lit("")), "name").alias("key")
    by_place = containing(calls.select("*", file_name), fn.select("id", "start_line", "end_line", file_name), "key")
    one = _first(by_place, "call_id", "start_line", "id").select("call_id", F.lit(1).alias("rule"), "id", F.lit(1).cast("long").alias("n"))
    left = materialize(calls.join(one, "call_id", "left_anti"))
    any_place = containing(left.drop("file_path"), fn.select("id", "name", "start_line", "end_line"), "name")
    two = _first(any_place, "call_id", "start_line", "id").select("call_id", F.lit(2).alias("rule"), "id", F.lit(1).cast("long").alias("n"))
    left = left.join(two, "call_id", "left_anti")
    # a name's candidates are counted before the join, so hot names cost one row a call
    in_file = fn.groupBy("name", "file_path").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    three = left.join(in_file, ["name", "file_path"]).select("call_id", F.lit(3).alias("rule"), "id", "n")
    global_ = fn.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    four = left.join(three, "call_id", "left_anti").join(global_, "name").select("call_id", F.lit(4).alias("rule"), "id", "n")
    found = one.unionByName(two).unionByName(three).unionByName(four)
    every = calls.join(found, "call_id", "left")
    status = (
        F.when(F.col("rule").isNull(), "external")
        .when(F.col("n") > 1, "ambiguous")
        .when(F.col("rule") == 4, "global_match")
        .otherwise("resolved")
    )
    out = every.select("call_id", "rule", status.alias("status"), F.when(F.coalesce("n", F.lit(2)) == 1, F.col("id")).alias("id"), F.coalesce("n", F.lit(0)).alias("candidates"), "caller_id")
    return out.where(F.col("id").isNull() | (F.col("id") != F.coalesce("caller_id", F.lit("")))).drop("caller_id")


def mentioned_names(texts: DataFrame, id_col: str, text_col: str, functions: DataFrame, least: int = 3) -> DataFrame:
    """(id, name) of the function names that a text names in backticks or before ``(``."""
    tick = F.expr(f"regexp_extract_all({text_col}, '`([A-Za-z_][A-Za-z0-9_]*)`', 1)")
    call = F.expr(f"regexp_extract_all({text_col}, '([A-Za-z_][A-Za-z0-9_]*)\\\\(', 1)")
    said = texts.where(F.col(text_col).isNotNull()).select(id_col, F.explode(F.array_union(tick, call)).alias("name"))
    said = said.where(F.length("name") >= least).distinct()
    return said.join(functions.select("name").distinct(), "name", "left_semi").select(id_col, "name")


def similar_titles(titles: DataFrame, num: int = 17, den: int = 20) -> DataFrame:
    """(a, b) of the distinct titles (title) whose word sets have a Jaccard of more than num / den.

    Prefix filter: of each set only the rarest words can be the first shared one.
    """
    t = titles.where("title IS NOT NULL").select("title").distinct()
    words = F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    t = materialize(t.select("title", words.alias("w")).where(F.size("w") > 0))
    df = t.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    each = t.select("title", F.size("w").alias("n"), F.explode("w").alias("word")).join(df, "word")
    rank = F.row_number().over(Window.partitionBy("title").orderBy("df", "word"))
    keep = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    pre = materialize(each.withColumn("r", rank).where(F.col("r") <= keep).select("title", "n", "word"))
    a = pre.select("word", F.col("title").alias("a"), F.col("n").alias("na"))
    b = pre.select("word", F.col("title").alias("b"), F.col("n").alias("nb"))
    near = a.join(b, "word").where("a < b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b").distinct()
    s = near.join(t.select(F.col("title").alias("a"), F.col("w").alias("wa")), "a").join(t.select(F.col("title").alias("b"), F.col("w").alias("wb")), "b")
    return s.where(F.size(F.array_intersect("wa", "wb")) * den > F.size(F.array_union("wa", "wb")) * num).select("a", "b")


def numbered_rows(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``k``, the place from 0 of each row in the order of a unique column.

    The rows are range-partitioned and numbered inside of each partition; only
    the number of rows of each partition reaches the driver.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(df.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()))
    before, offsets = 0, []
    for r in rows.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():  # one row a partition
        offsets.append((r["_p"], before))
        before += r["n"]
    start = df.sparkSession.createDataFrame(offsets, "_p int, _before long")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return rows.withColumn("_i", inside).join(F.broadcast(start), "_p").withColumn("k", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def positional(items: DataFrame, results: DataFrame, order: str, start: int = 0) -> DataFrame:
    """Items from place ``start`` on with ``other``, the result that belongs to each.

    If there are as many results as such items, results count from the first of
    them, else from the first item of all; items without a result are left out.
    """
    a = materialize(numbered_rows(items, order).where(F.col("k") >= start))
    b = materialize(numbered_rows(results, order).select(F.col(order).alias("other"), F.col("k").alias("j")))
    shift = start if a.count() == b.count() else 0
    return a.join(b, F.col("k") - shift == F.col("j")).drop("j")


def batch(items: DataFrame, order: str, offset: int, limit: int, done: DataFrame) -> DataFrame:
    """The items of a batch (places ``offset`` to ``offset + limit`` in the order of a unique column) that are not ``done`` yet, with their place ``k``.

    The written results of an interrupted run are its checkpoint.
    """
    mine = numbered_rows(items, order).where((F.col("k") >= offset) & (F.col("k") < offset + limit))
    return mine.join(done.select(order).distinct(), order, "left_anti")
