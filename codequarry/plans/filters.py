"""Queries FLT1-FLT17."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import filters as f
from codequarry.operators import graph as g
from codequarry.plans.fixtures import SQL_CALLS, SQL_FUNCTIONS, SQL_NODES, calls, functions, nodes
from codequarry.session import table

QUERIES: dict = {}
ORACLE: dict = {}
_W = "WITH " + SQL_FUNCTIONS


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@q("FLT1", _W + " SELECT id, name, start_line FROM functions WHERE contains(lower(name), 'buffer') OR contains(lower(file_path), 'buffer') ORDER BY start_line, id LIMIT 20")
def flt1(spark, d):
    return f.keyword_nodes(functions(spark, d), "Buffer", 20).select("id", "name", "start_line")


@q("FLT2", _W + " SELECT id, name FROM functions WHERE starts_with(name, 'parse_') AND name <> 'parse_tree'")
def flt2(spark, d):
    return f.name_prefix(functions(spark, d), "parse_", "parse_tree").select("id", "name")


@q("FLT3", _W + " SELECT id, file_path FROM functions WHERE contains(name, 'Frame') OR contains(name, 'frame') ORDER BY length(file_path), id LIMIT 30")
def flt3(spark, d):
    fn = functions(spark, d)
    return fn.where(F.col("name").contains("Frame") | F.col("name").contains("frame")).orderBy(F.length("file_path"), "id").limit(30).select("id", "file_path")


@q("FLT4", "SELECT DISTINCT id FROM issues WHERE regexp_matches(title, '(leaks|hangs)')")
def flt4(spark, d):
    return table(spark, d, "issues").where(f.any_word("title", ["leaks", "hangs"])).select("id").distinct()


_RANK = "CASE WHEN starts_with(file_path, 'src/') THEN 3 WHEN starts_with(file_path, 'lib/') THEN 2 WHEN starts_with(file_path, 'tests/') THEN 0 WHEN starts_with(file_path, 'examples/') THEN 0 ELSE 1 END"


@q("FLT5", _W + f" SELECT {_RANK} AS rank, count(*) AS n FROM functions GROUP BY 1")
def flt5(spark, d):
    return functions(spark, d).groupBy(f.path_rank().alias("rank")).agg(F.count("*").alias("n"))


_LADDER = "CASE WHEN contains(file_path,'src/') THEN 100 WHEN contains(file_path,'common/') THEN 90 WHEN contains(file_path,'lib/') THEN 85 WHEN contains(file_path,'include/') THEN 50 WHEN contains(file_path,'tests/') THEN 20 WHEN contains(file_path,'examples/') THEN 10 WHEN contains(file_path,'tools/') THEN 30 ELSE 40 END"


@q("FLT6", _W + f" SELECT id, {_LADDER} AS priority FROM functions")
def flt6(spark, d):
    return functions(spark, d).select("id", f.file_priority().alias("priority"))


@q("FLT7", _W + f""", r AS (SELECT name, file_path, row_number() OVER (PARTITION BY name ORDER BY {_LADDER} DESC, length(file_path), file_path) AS rn
  FROM functions WHERE name IS NOT NULL AND file_path IS NOT NULL) SELECT name, file_path AS definition_file FROM r WHERE rn = 1""")
def flt7(spark, d):
    return f.definition_file(functions(spark, d))


@q("FLT8", """WITH w AS (SELECT DISTINCT substr(file_path, strpos(file_path, '/') + 1) AS wanted FROM retrieved_functions WHERE contains(file_path, '/')),
  f AS (SELECT DISTINCT file_path FROM function_nodes)
  SELECT wanted, file_path FROM w, f WHERE wanted = file_path OR ends_with(file_path, '/' || wanted) OR ends_with(wanted, '/' || file_path)""")
def flt8(spark, d):
    rf = table(spark, d, "retrieved_functions").where(F.col("file_path").contains("/"))
    wanted = rf.select(F.expr("substring(file_path, instr(file_path, '/') + 1)").alias("wanted"))
    return f.suffix_matches(wanted, table(spark, d, "function_nodes"))


@q("FLT9", """WITH p AS (SELECT DISTINCT qa_id, u.file_path AS a FROM (SELECT qa_id, unnest(retrieved_functions) AS u FROM qa_results) z WHERE u.file_path IS NOT NULL)
  SELECT x.qa_id, count(*) AS pairs FROM p x JOIN p y ON x.qa_id = y.qa_id AND x.a < y.a
  WHERE contains(split_part(x.a, '/', 2), split_part(y.a, '/', 2)) OR contains(split_part(y.a, '/', 2), split_part(x.a, '/', 2)) GROUP BY 1""")
def flt9(spark, d):
    rf = table(spark, d, "qa_results").select("qa_id", F.explode("retrieved_functions.file_path").alias("a")).where("a IS NOT NULL").distinct()
    rf = rf.withColumn("s", F.split_part("a", F.lit("/"), F.lit(2)))
    pair = rf.join(rf.select("qa_id", F.col("a").alias("b"), F.col("s").alias("t")), "qa_id").where("a < b")
    return pair.where(f.either_contains("s", "t")).groupBy("qa_id").agg(F.count("*").alias("pairs"))


@q("FLT10", _W + " SELECT count(*) AS n FROM functions WHERE file_path IN (SELECT file_path FROM retrieved_functions)")
def flt10(spark, d):
    return f.in_files(functions(spark, d), table(spark, d, "retrieved_functions")).agg(F.count("*").alias("n"))


@q("FLT11", _W + " SELECT id FROM functions WHERE coalesce(fan_in, 0) = 0 AND fan_out > 0 AND name <> 'main' AND NOT starts_with(name, 'test_') AND NOT starts_with(name, 'Test')")
def flt11(spark, d):
    return f.dead_entries(functions(spark, d)).select("id")


@q("FLT12", "SELECT count(*) AS n FROM retrieved_functions WHERE NOT regexp_matches(file_path, '\\.(h|hpp)$')")
def flt12(spark, d):
    return f.without_headers(table(spark, d, "retrieved_functions")).agg(F.count("*").alias("n"))


@q("FLT13", "SELECT DISTINCT id FROM function_nodes WHERE coalesce(param_count, 0) < 2 OR coalesce(fan_in, 1) < 1")
def flt13(spark, d):
    return f.stale(table(spark, d, "function_nodes"), "param_count", 2, "fan_in", 1).select("id").distinct()


_DEG = """deg AS (SELECT name, sum(i) AS in_degree, sum(o) AS out_degree, sum(i) + sum(o) AS degree FROM (
  SELECT src AS name, 0 AS i, 1 AS o FROM calls UNION ALL SELECT dst, 1, 0 FROM calls) z GROUP BY name)"""


@q("FLT14", f"WITH {SQL_NODES}, {SQL_CALLS}, {_DEG} SELECT name FROM nodes WHERE NOT regexp_matches(name, '{f.GENERIC_NAMES}') AND name NOT IN (SELECT name FROM deg WHERE degree > 50)")
def flt14(spark, d):
    return f.without_hubs(nodes(spark, d), g.degrees(calls(spark, d))).select("name")


@q("FLT15", _W + " SELECT name, CAST(sum(coalesce(fan_in, 0)) AS BIGINT) AS in_degree FROM functions WHERE name IS NOT NULL GROUP BY name HAVING sum(coalesce(fan_in, 0)) >= 50")
def flt15(spark, d):
    return f.frequent_names(functions(spark, d))


@q("FLT17", """SELECT DISTINCT id, CASE WHEN parent_class IS NOT NULL THEN 'member' WHEN start_character > 0 THEN CASE WHEN param_count = 8 THEN 'param' ELSE 'local' END
  WHEN param_count = 26 THEN 'param' WHEN param_count = 8 THEN 'member' ELSE 'global' END AS kind FROM function_nodes""")
def flt17(spark, d):
    t = table(spark, d, "function_nodes").withColumns({"c": F.col("parent_class").isNotNull(), "f": F.coalesce(F.col("start_character") > 0, F.lit(False))})
    return t.select("id", f.variable_kind("c", "f", "param_count").alias("kind")).distinct()
