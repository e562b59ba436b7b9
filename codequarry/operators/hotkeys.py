"""Per-key results when a few keys own most rows.

The exact median of a key is no algebraic aggregate, but the rank search for
it is: counts by (key, value range) and then by (key, id prefix) are combined
inside each map task by Spark's hash aggregation, which spills, and only those
compact partial counts are shuffled. No task ever holds a hot key's rows. Rows
of the many small keys are shuffled once, as nothing combines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import join_on_keys, materialize

#: Rows of one key, or of keys that share a hash bucket, that may be ordered in one task.
GROUP_BOUND = 20_000
#: Bits by which the search narrows a key's values in each round.
RANGE_BITS = 12
#: Words of 64 bits of the map that tells which ids may occur more than once: its size
#: does not grow with the data. Where it fills up, more rows are shuffled, nothing else.
MAP_WORDS = 1 << 20
#: Characters by which the search extends the known prefix in each round.
PREFIX_STEP = 3


def latest_by_id(df: DataFrame, id_col: str, version_cols: list[str], cols: list[str]) -> DataFrame:
    """The newest row of each id.

    Rows are ordered by ``version_cols`` and, where these tie, by the
    remaining ``cols``, so that the result does not depend on file order.
    Nulls are oldest. Rows with a null id have no identity and are left out.
    """
    rest = [c for c in cols if c != id_col and c not in version_cols]
    state = F.max(F.struct(*[F.col(c) for c in [*version_cols, *rest]])).alias("_s")
    return (
        df.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(state)
        .select(*[F.col(id_col) if c == id_col else F.col(f"_s.{c}").alias(c) for c in cols])
    )


def latest_where_repeated(df: DataFrame, id_col: str, version_cols: list[str], cols: list[str]) -> DataFrame:
    """The newest row of each id, like ``latest_by_id``, where few ids occur more than once.

    Only hashes of the ids are shuffled to find those that repeat; a bit map of
    fixed size keeps them. Rows whose id is not in the map pass as they are, the
    others are compared. A false hit only costs that comparison.
    """
    some = df.where(F.col(id_col).isNotNull()).select(*cols)
    hash_, bit = F.xxhash64(id_col), F.expr("shiftleft(1L, CAST(_h & 63 AS INT))")
    word = F.expr(f"shiftrightunsigned(_h, 6) & {MAP_WORDS - 1}L")
    twice = some.select(hash_.alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1")
    marks = materialize(twice.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits")))
    tagged = some.withColumn("_h", hash_).withColumns({"_w": word, "_b": bit}).join(F.broadcast(marks), "_w", "left")  # MAP_WORDS rows at most
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_b")) != 0, F.lit(False))
    return tagged.where(~maybe).select(*cols).unionByName(latest_by_id(tagged.where(maybe), id_col, version_cols, cols))


def _pick(counted: DataFrame, state: DataFrame, by: str, n_keys: int) -> DataFrame:
    """The value of ``by`` that holds each key's wanted rank, and the rank inside of it."""
    before = Window.partitionBy("_key").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counted.withColumn("_run", F.sum("_n").over(before))
    hit = join_on_keys(run, state.select("_key", "_k"), ["_key"], by, n_keys=n_keys)
    return hit.where((F.col("_k") <= F.col("_run")) & (F.col("_k") > F.col("_run") - F.col("_n"))).withColumn(
        "_k", F.col("_k") - (F.col("_run") - F.col("_n"))
    )


def _median_values(rows: DataFrame, span: DataFrame, n_keys: int) -> DataFrame:
    """(_key, _v, _k, _n): each key's lower median value, the wanted rank among its rows of that value, and their number.

    ``span`` has (_key, _n, _lo, _hi). Every round parts each key's open values
    by the first ``RANGE_BITS`` bits in which they differ, counts the parts and
    goes on with the one that holds the rank.
    """
    state = materialize(span.select("_key", F.floor((F.col("_n") + 1) / 2).alias("_k"), "_lo", "_hi", "_n"))
    done = None
    while True:
        settled = state.where("_lo = _hi").select("_key", F.col("_lo").alias("_v"), "_k", "_n")
        done = settled if done is None else done.unionByName(settled)
        state = materialize(state.where("_lo < _hi"))
        if not state.take(1):
            return materialize(done)
        shift = F.greatest(F.length(F.bin(F.col("_lo").bitwiseXOR(F.col("_hi")))) - RANGE_BITS, F.lit(0))
        inside = join_on_keys(rows, state.select("_key", "_lo", "_hi", shift.alias("_s")), ["_key"], "_id", n_keys=n_keys).where("_v BETWEEN _lo AND _hi")
        counted = inside.groupBy("_key", F.expr("shiftright(_v, _s)").alias("_r")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        state = materialize(_pick(counted, state, "_r", n_keys).select("_key", "_k", "_lo", "_hi", "_n"))


def _common_prefix(a: str, b: str):
    """Length of the common prefix of two string columns."""
    upto = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    same = F.filter(upto, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same)


def median_and_top(df: DataFrame, key: str, value: str, id_col: str, bound: int = GROUP_BOUND) -> DataFrame:
    """Lower median and smallest-id maximum of every key: (key, median_id, top_id).

    A key's rows are ordered by ``value`` (null counts as 0), then by id in
    byte order; the median is the row at place floor((n + 1) / 2). ``id_col``
    is unique. Rows with a null key are left out; an empty table gives no
    rows. Keys of at most ``bound`` rows are ordered in one task each; others
    go through the counted rank search.
    """
    rows = materialize(
        df.where(F.col(key).isNotNull()).select(
            F.col(key).alias("_key"), F.coalesce(F.col(value), F.lit(0)).cast("long").alias("_v"), F.col(id_col).alias("_id")
        )
    )
    # keys are told apart by buckets of their hash, many more than there can be hot ones, so that counting them stays small
    n_buckets = 1 << max(13, (8 * rows.count() // bound).bit_length())
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(n_buckets)).cast("int"))
    hot = materialize(rows.groupBy("_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > bound).select("_bucket"))
    n_hot = hot.count()

    cold_rows = join_on_keys(rows, hot, ["_bucket"], "_id", "left_anti", n_hot) if n_hot else rows
    one_key = Window.partitionBy("_key")
    ranked = cold_rows.select("_key", "_v", "_id", F.row_number().over(one_key.orderBy("_v", "_id")).alias("_r"), F.count("*").over(one_key).alias("_n"))
    cold = ranked.groupBy("_key").agg(
        F.max(F.when(F.col("_r") == F.floor((F.col("_n") + 1) / 2), F.col("_id"))).alias("median_id"),
        F.min(F.struct(F.bitwise_not("_v").alias("_v"), "_id"))["_id"].alias("top_id"),
    )
    if not n_hot:
        return cold.withColumnRenamed("_key", key)

    rows = materialize(join_on_keys(rows, hot, ["_bucket"], "_id", "left_semi", n_hot).select("_key", "_v", "_id"))
    span = materialize(rows.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    n_hot = span.count()
    state = _median_values(rows, span, n_hot).withColumn("_p", F.lit(""))
    top_v = span.select("_key", F.col("_hi").alias("_v"))
    ends = (
        join_on_keys(rows, top_v, ["_key", "_v"], "_id", n_keys=n_hot).groupBy("_key").agg(F.min("_id").alias("top_id"))
    )
    state = materialize(state)
    settled = None
    while True:
        small = state.where(F.col("_n") <= bound)
        settled = small if settled is None else settled.unionByName(small)
        state = materialize(state.where(F.col("_n") > bound))
        n_open = state.count()
        if not n_open:
            break
        inside = join_on_keys(rows, state.select("_key", "_v", "_p"), ["_key", "_v"], "_id", n_keys=n_open).where(
            F.col("_id").startswith(F.col("_p"))
        )
        span = inside.groupBy("_key").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
        cut = span.select("_key", (_common_prefix("_lo", "_hi") + PREFIX_STEP).alias("_len"))
        inside = join_on_keys(inside, materialize(cut), ["_key"], "_id", n_keys=n_open)
        counted = (
            inside.withColumn("_q", F.substring("_id", F.lit(1), F.col("_len")))
            .groupBy("_key", "_v", "_q")
            .agg(F.count("*").alias("_n"))
        )
        state = materialize(
            _pick(counted, state, "_q", n_open).select("_key", "_v", F.col("_q").alias("_p"), "_k", "_n")
        )
    found = join_on_keys(rows, settled.select("_key", "_v", "_p", "_k"), ["_key", "_v"], "_id", n_keys=n_hot).where(
        F.col("_id").startswith(F.col("_p"))
    )
    median = found.groupBy("_key").agg(
        F.element_at(F.sort_array(F.collect_list("_id")), F.max("_k").cast("int")).alias("median_id")
    )
    warm = median.join(ends, "_key").select("_key", "median_id", "top_id")
    return cold.unionByName(warm).withColumnRenamed("_key", key)


def per_name_fan_in(nodes: DataFrame, bound: int = GROUP_BOUND) -> DataFrame:
    """Median and top function of every function name: (name, median_id, top_id)."""
    rows = latest_where_repeated(nodes, "id", ["extracted_at", "ingested_at"], ["id", "name", "fan_in", "extracted_at", "ingested_at"])
    return median_and_top(rows, "name", "fan_in", "id", bound)
