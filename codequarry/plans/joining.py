"""Queries JN1-JN21."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.operators import joins as j
from codequarry.plans.fixtures import SQL_CALLS, SQL_FUNCTIONS, SQL_NODES, calls, functions, nodes
from codequarry.session import materialize, table

QUERIES: dict = {}
ORACLE: dict = {}


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


# raw calls: every retrieved function names a callee, a place and the line it was seen at
_RAW = SQL_FUNCTIONS + """, raw AS (SELECT rf_id AS call_id, any_value(name) AS name, any_value(file_path) AS file_path, any_value(start_line) AS line
  FROM retrieved_functions WHERE rf_id IS NOT NULL AND name IS NOT NULL GROUP BY rf_id)"""


def _raw(spark, d):
    t = table(spark, d, "retrieved_functions").where("rf_id IS NOT NULL AND name IS NOT NULL").dropDuplicates(["rf_id"])
    return t.select(F.col("rf_id").alias("call_id"), "name", "file_path", F.col("start_line").alias("line"), F.lit(None).cast("string").alias("caller_id"))


_R1 = "r1 AS (SELECT call_id, id FROM (SELECT call_id, f.id, row_number() OVER (PARTITION BY call_id ORDER BY f.start_line, f.id) AS r FROM raw c JOIN functions f ON f.name = c.name AND f.file_path = c.file_path AND c.line BETWEEN f.start_line AND f.end_line) z WHERE r = 1)"
_R2 = "r2 AS (SELECT call_id, id FROM (SELECT call_id, f.id, row_number() OVER (PARTITION BY call_id ORDER BY f.start_line, f.id) AS r FROM raw c JOIN functions f ON f.name = c.name AND c.line BETWEEN f.start_line AND f.end_line WHERE call_id NOT IN (SELECT call_id FROM r1)) z WHERE r = 1)"
_R3 = "r3 AS (SELECT call_id, count(*) AS n, min(f.id) AS id FROM raw c JOIN functions f ON f.name = c.name AND f.file_path = c.file_path WHERE call_id NOT IN (SELECT call_id FROM r1 UNION ALL SELECT call_id FROM r2) GROUP BY call_id)"
_N4 = "n4 AS (SELECT name, count(*) AS n, min(id) AS id FROM functions WHERE name IS NOT NULL GROUP BY name)"
_ALL = f"WITH {_RAW}, {_R1}, {_R2}, {_R3}, {_N4}"


@q("JN1", f"WITH {_RAW}, {_R1} SELECT call_id, id FROM r1")
def jn1(spark, d):
    return j.resolve_calls(_raw(spark, d), functions(spark, d)).where("rule = 1").select("call_id", "id")


@q("JN2", f"WITH {_RAW}, {_R1}, {_R2} SELECT call_id, id FROM r2")
def jn2(spark, d):
    return j.resolve_calls(_raw(spark, d), functions(spark, d)).where("rule = 2").select("call_id", "id")


@q("JN3", f"WITH {_RAW}, {_R1}, {_R2}, {_R3} SELECT call_id, n AS candidates FROM r3")
def jn3(spark, d):
    return j.resolve_calls(_raw(spark, d), functions(spark, d)).where("rule = 3").select("call_id", "candidates")


@q("JN4", f"{_ALL} SELECT call_id, n AS candidates FROM raw JOIN n4 USING (name) WHERE call_id NOT IN (SELECT call_id FROM r1 UNION ALL SELECT call_id FROM r2 UNION ALL SELECT call_id FROM r3)")
def jn4(spark, d):
    return j.resolve_calls(_raw(spark, d), functions(spark, d)).where("rule = 4").select("call_id", "candidates")


@q("JN5", f"""{_ALL}, u AS (SELECT call_id, 1 AS rule, id, CAST(1 AS BIGINT) AS n FROM r1 UNION ALL SELECT call_id, 2, id, 1 FROM r2 UNION ALL SELECT call_id, 3, id, n FROM r3
  UNION ALL SELECT call_id, 4, n4.id, n FROM raw JOIN n4 USING (name) WHERE call_id NOT IN (SELECT call_id FROM r1 UNION ALL SELECT call_id FROM r2 UNION ALL SELECT call_id FROM r3))
  SELECT call_id, rule, CASE WHEN rule IS NULL THEN 'external' WHEN n > 1 THEN 'ambiguous' WHEN rule = 4 THEN 'global_match' ELSE 'resolved' END AS status,
  CASE WHEN n = 1 THEN u.id END AS id, coalesce(n, 0) AS candidates FROM raw LEFT JOIN u USING (call_id)""")
def jn5(spark, d):
    return j.resolve_calls(_raw(spark, d), functions(spark, d))


_PTS = "points AS (SELECT rf_id AS point, any_value(file_path) AS file_path, any_value(start_line) AS line FROM retrieved_functions WHERE rf_id IS NOT NULL GROUP BY rf_id)"
_IN = "points p JOIN functions f ON f.file_path = p.file_path AND p.line BETWEEN f.start_line AND f.end_line"


def _points(spark, d):
    t = table(spark, d, "retrieved_functions").where("rf_id IS NOT NULL").dropDuplicates(["rf_id"])
    return t.select(F.col("rf_id").alias("point"), "file_path", F.col("start_line").alias("line"))


@q("JN6", f"WITH {SQL_FUNCTIONS}, {_PTS} SELECT point, id FROM (SELECT point, f.id, row_number() OVER (PARTITION BY point ORDER BY CASE WHEN f.start_line = p.line THEN 0 ELSE 1 END, f.id) AS r FROM {_IN}) z WHERE r = 1")
def jn6(spark, d):
    return j.caller_of(_points(spark, d), functions(spark, d))


@q("JN7", f"""WITH {SQL_FUNCTIONS}, {_PTS}, c AS (SELECT concat(file_path, '#', parent_class) AS id, file_path, min(start_line) AS start_line, max(end_line) AS end_line FROM functions WHERE parent_class IS NOT NULL GROUP BY 1, 2)
  SELECT point, id FROM (SELECT point, f.id, row_number() OVER (PARTITION BY point ORDER BY f.start_line DESC, f.end_line, f.id) AS r FROM points p JOIN c f ON f.file_path = p.file_path AND p.line BETWEEN f.start_line AND f.end_line) z WHERE r = 1""")
def jn7(spark, d):
    fn = functions(spark, d).where("parent_class IS NOT NULL")
    c = fn.groupBy(F.concat("file_path", F.lit("#"), "parent_class").alias("id"), "file_path").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return j.innermost(_points(spark, d), c)


@q("JN8", f"""WITH {SQL_FUNCTIONS}, {_PTS}, i AS (SELECT point, id, 'inside' AS how FROM (SELECT point, f.id, row_number() OVER (PARTITION BY point ORDER BY f.start_line, f.id) AS r FROM {_IN}) z WHERE r = 1)
  SELECT point, id, how FROM i UNION ALL SELECT point, id, 'before' FROM (SELECT point, f.id, row_number() OVER (PARTITION BY point ORDER BY f.start_line DESC, f.id DESC) AS r
  FROM points p JOIN functions f ON f.file_path = p.file_path AND f.start_line <= p.line WHERE point NOT IN (SELECT point FROM i)) z WHERE r = 1""")
def jn8(spark, d):
    return j.containing_or_before(_points(spark, d), functions(spark, d))


@q("JN9", f"WITH {SQL_FUNCTIONS}, {_PTS} SELECT point, id FROM (SELECT point, f.id, row_number() OVER (PARTITION BY point ORDER BY f.start_line DESC, f.end_line, f.id) AS r FROM {_IN}) z WHERE r = 1")
def jn9(spark, d):
    return j.innermost(_points(spark, d), functions(spark, d))


_PRS = "(VALUES (1, 'src/core/a.cc,lib/b.h', '3,9'), (2, 'a.cc', '4'), (3, 'none.c', NULL)) AS t(pr, paths, fixes)"
_FILES = "(VALUES ('src/core/a.cc'), ('src/net/a.cc'), ('lib/b.h')) AS f(file_path)"


def _prs(spark):
    return spark.createDataFrame([(1, "src/core/a.cc,lib/b.h", "3,9"), (2, "a.cc", "4"), (3, "none.c", None)], "pr int, paths string, fixes string")


@q("JN11", f"""WITH {SQL_FUNCTIONS}, s AS (SELECT DISTINCT id, name FROM (SELECT id, unnest(list_concat(regexp_extract_all(body, '`([A-Za-z_][A-Za-z0-9_]*)`', 1), regexp_extract_all(body, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1))) AS name FROM issues WHERE body IS NOT NULL) z)
  SELECT id, name FROM s WHERE length(name) >= 3 AND name IN (SELECT name FROM functions WHERE name IS NOT NULL)""")
def jn11(spark, d):
    return j.mentioned_names(table(spark, d, "issues"), "id", "body", functions(spark, d))


_G = f"WITH {SQL_NODES}, {SQL_CALLS}"


@q("JN13", _G + " SELECT src, a.file_path AS src_file, dst, b.file_path AS dst_file FROM calls JOIN nodes a ON a.name = src JOIN nodes b ON b.name = dst")
def jn13(spark, d):
    n, c = nodes(spark, d), calls(spark, d)
    a, b = (n.select(F.col("name").alias(x), F.col("file_path").alias(x + "_file")) for x in ("src", "dst"))
    return c.join(a, "src").join(b, "dst").select("src", "src_file", "dst", "dst_file")


@q("JN15", f"WITH {SQL_FUNCTIONS}, g AS (SELECT DISTINCT file_path FROM functions), e AS (SELECT file_path, count(DISTINCT rf_id) AS n FROM retrieved_functions WHERE file_path IS NOT NULL GROUP BY 1) SELECT g.file_path, coalesce(e.n, 0) AS visits, e.n IS NULL AS gap FROM g LEFT JOIN e USING (file_path)")
def jn15(spark, d):
    e = table(spark, d, "retrieved_functions").where("file_path IS NOT NULL").groupBy("file_path").agg(F.countDistinct("rf_id").alias("n"))
    g = functions(spark, d).select("file_path").distinct().join(e, "file_path", "left")
    return g.select("file_path", F.coalesce("n", F.lit(0)).alias("visits"), F.col("n").isNull().alias("gap"))


@q("JN16", _G + " SELECT a.file_path = b.file_path AS same_file, count(*) AS n FROM calls JOIN nodes a ON a.name = src JOIN nodes b ON b.name = dst GROUP BY 1")
def jn16(spark, d):
    return jn13(spark, d).groupBy((F.col("src_file") == F.col("dst_file")).alias("same_file")).agg(F.count("*").alias("n"))


@q("JN17", _G + " SELECT name FROM nodes WHERE name NOT IN (SELECT dst FROM calls) AND name NOT IN (SELECT src FROM calls)")
def jn17(spark, d):
    c = calls(spark, d)
    ends = c.select(F.col("src").alias("name")).union(c.select("dst"))
    return nodes(spark, d).join(ends, "name", "left_anti").select("name")


@q("JN18", _G + " SELECT name, count(dst) AS n, min(dst) AS first FROM nodes LEFT JOIN calls ON src = name GROUP BY name")
def jn18(spark, d):
    c = calls(spark, d).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("n"), F.min("dst").alias("first"))
    return nodes(spark, d).join(c, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), "first")


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}_]+'), lambda x: x <> ''))"


@q("JN20", f"""WITH t AS (SELECT title, {_WORDS} AS w FROM (SELECT DISTINCT title FROM issues WHERE title IS NOT NULL) z)
  SELECT a.title AS a, b.title AS b FROM t a JOIN t b ON a.title < b.title AND len(a.w) * 20 >= len(b.w) * 17 AND len(b.w) * 20 >= len(a.w) * 17
  WHERE len(list_intersect(a.w, b.w)) * 20 > (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 17""")
def jn20(spark, d):
    return j.similar_titles(table(spark, d, "issues"))


@q("JN21", _G + """, no_out AS (SELECT name FROM nodes WHERE name NOT IN (SELECT src FROM calls)), inc AS (SELECT DISTINCT name AS dst, file_path FROM retrieved_functions WHERE name IN (SELECT name FROM no_out) AND file_path IS NOT NULL)
  SELECT dst, file_path FROM inc WHERE NOT EXISTS (SELECT 1 FROM functions f WHERE f.file_path = inc.file_path AND f.name = inc.dst)""")
def jn21(spark, d):
    quiet = nodes(spark, d).join(calls(spark, d).select(F.col("src").alias("name")), "name", "left_anti").select("name")
    inc = table(spark, d, "retrieved_functions").where("file_path IS NOT NULL").select("name", "file_path").distinct().join(quiet, "name", "left_semi")
    known = functions(spark, d).select("name", "file_path")
    return materialize(inc).join(known, ["name", "file_path"], "left_anti").select(F.col("name").alias("dst"), "file_path")
