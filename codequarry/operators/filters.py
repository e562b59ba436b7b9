"""Predicates over function, issue and path tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.session import join_on_keys


def keyword_nodes(functions: DataFrame, keyword: str, k: int) -> DataFrame:
    """The first ``k`` functions whose name or path contains the keyword, in any case."""
    w = keyword.lower()
    hit = F.lower("name").contains(w) | F.lower("file_path").contains(w)
    return functions.where(hit).orderBy("start_line", "id").limit(k)


def name_prefix(functions: DataFrame, prefix: str, but: str | None = None) -> DataFrame:
    out = functions.where(F.col("name").startswith(prefix))
    return out if but is None else out.where(F.col("name") != but)


def contains_by_path_length(functions: DataFrame, text: str, k: int) -> DataFrame:
    """Case-sensitive containment in the name, shortest paths first."""
    return functions.where(F.col("name").contains(text)).orderBy(F.length("file_path"), "id").limit(k)


def any_word(col: str, words: list[str]) -> Column:
    """Regular-expression alternative over literal words."""
    return F.col(col).rlike("(" + "|".join("\\Q" + w + "\\E" for w in words) + ")")


def path_rank(col: str = "file_path", first: str = "src", second: str = "lib", last: tuple[str, ...] = ("tests", "examples")) -> Column:
    """3 for the first root, 2 for the second, 0 for the last ones, 1 otherwise."""
    c = F.col(col)
    rank = F.when(c.startswith(first + "/"), 3).when(c.startswith(second + "/"), 2)
    for x in last:
        rank = rank.when(c.startswith(x + "/"), 0)
    return rank.otherwise(1)


#: Path parts and their weights; the first part found decides (fixed values).
LADDER = (("src/", 100), ("common/", 90), ("lib/", 85), ("include/", 50), ("tests/", 20), ("examples/", 10), ("tools/", 30))


def file_priority(col: str = "file_path", ladder: tuple = LADDER, default: int = 40) -> Column:
    rank = F.when(F.lit(False), 0)
    for part, weight in ladder:
        rank = rank.when(F.col(col).contains(part), weight)
    return rank.otherwise(default)


def definition_file(functions: DataFrame) -> DataFrame:
    """(name, definition_file): the file of the highest priority, then the shortest path, then the first."""
    best = F.min(F.struct(-file_priority(), F.length("file_path"), F.col("file_path")))
    return functions.where("name IS NOT NULL AND file_path IS NOT NULL").groupBy("name").agg(best.alias("b")).select("name", F.col("b.file_path").alias("definition_file"))


def same_or_suffix(a: str, b: str) -> Column:
    """Paths are equal or one is a suffix of the other."""
    x, y = F.col(a), F.col(b)
    return (x == y) | x.endswith(y) | y.endswith(x)


def suffix_matches(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(wanted, file_path) where one path is a suffix of the other at a directory border.

    Each path is expanded into its suffixes, so the match is an equi-join.
    """
    parts = F.split("file_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"))
    w = wanted.select("wanted").distinct()
    f = files.select("file_path").distinct()
    longer = f.withColumn("wanted", F.explode(tails)).join(w, "wanted")
    wt = w.withColumn("file_path", F.col("wanted"))
    shorter = wt.withColumn("tail", F.explode(tails)).select("wanted", F.col("tail").alias("file_path")).join(f, "file_path")
    return longer.select("wanted", "file_path").unionByName(shorter.select("wanted", "file_path")).distinct()


def either_contains(a: str, b: str) -> Column:
    return F.col(a).contains(F.col(b)) | F.col(b).contains(F.col(a))


def in_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("file_path").distinct(), "file_path", "left_semi")


def dead_entries(functions: DataFrame) -> DataFrame:
    """Functions that nobody calls but that call others; not main, not a test."""
    n = F.col("name")
    return functions.where((F.coalesce("fan_in", F.lit(0)) == 0) & (F.col("fan_out") > 0) & (n != "main") & ~n.startswith("test_") & ~n.startswith("Test"))


def without_headers(rows: DataFrame, col: str = "file_path") -> DataFrame:
    return rows.where(~F.col(col).rlike(r"\.(h|hpp)$"))


def stale(rows: DataFrame, version: str, wanted: int, schema: str, wanted_schema: int) -> DataFrame:
    return rows.where((F.coalesce(F.col(version), F.lit(0)) < wanted) | (F.coalesce(F.col(schema), F.lit(1)) < wanted_schema))


#: Names too common to say anything (fixed values).
GENERIC_NAMES = r"^(main|find|length|get|pool|data)$|^operator|^LOG"


def without_hubs(names: DataFrame, degrees: DataFrame, most: int = 50) -> DataFrame:
    """Names (name) whose total degree is at most ``most`` and that are not generic.

    ``degrees`` has one row per name; hubs are few, a count decides how they join.
    """
    hubs = degrees.where(F.col("degree") > most).select("name")
    return join_on_keys(names.where(~F.col("name").rlike(GENERIC_NAMES)), hubs, ["name"], "name", "left_anti")


def frequent_names(functions: DataFrame, least: int = 50) -> DataFrame:
    """(name, in_degree) of names whose functions' fan-in adds up to ``least``."""
    n = F.sum(F.coalesce("fan_in", F.lit(0))).cast("long")
    return functions.where("name IS NOT NULL").groupBy("name").agg(n.alias("in_degree")).where(F.col("in_degree") >= least)


def variable_kind(in_class: str, in_function: str, symbol_kind: str) -> Column:
    """member in a class; in a function param (symbol kind 8) or local; else by symbol kind."""
    k = F.col(symbol_kind)
    return (
        F.when(F.col(in_class), "member")
        .when(F.col(in_function), F.when(k == 8, "param").otherwise("local"))
        .otherwise(F.when(k == 26, "param").when(k == 8, "member").otherwise("global"))
    )


def first_reason(rules: list[tuple[str, Column]], passed: str = "passed") -> Column:
    """The name of the first rule (name, condition) that a row fails by meeting its condition, else ``passed``."""
    out = None
    for name, condition in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(passed) if out is None else out.otherwise(passed)


def best_of_similar(rows: DataFrame, pairs: DataFrame, title: str, better: str, id_col: str) -> DataFrame:
    """(id) of the rows with a similar title in a row that is better, or as good with a smaller id.

    ``pairs`` has (a, b) of different similar titles; rows of one title are similar too.
    """
    best = rows.where(F.col(title).isNotNull()).groupBy(title).agg(F.min(F.struct((-F.col(better)).alias("s"), F.col(id_col).alias("i"))).alias("best"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    other = both.join(best.select(F.col(title).alias("b"), "best"), "b").groupBy(F.col("a").alias(title)).agg(F.min("best").alias("near"))
    know = rows.join(best, title).join(other, title, "left").withColumn("least", F.least("best", F.coalesce("near", "best")))
    own = F.struct((-F.col(better)).alias("s"), F.col(id_col).alias("i"))
    return know.where(F.col("least") < own).select(id_col).distinct()
