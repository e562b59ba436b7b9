"""Queries on file lists, written results, recorded agent steps and configurations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.functions import text as t
from codequarry.operators import aggregates as a
from codequarry.plans import retrievals
from codequarry.plans.fixtures import SQL_FUNCTIONS, SQL_LINES, functions, lines
from codequarry.plans.metrics import _R, _once, _ranked, gold
from codequarry.plans.retrievals import _KW, _questions
from codequarry.session import materialize, shared_dir, table
from codequarry.sources import landed, sinks
from codequarry.sources.code import SKIPPED, implementation_text, project_files, read_records

QUERIES: dict = {"TK2": retrievals.QUERIES["RT6"]}
ORACLE: dict = {"TK2": retrievals.ORACLE["RT6"]}


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@q("SRC1", f"SELECT DISTINCT file_path, regexp_matches(file_path, '\\.(h|hpp)$') AS is_header FROM function_nodes WHERE file_path IS NOT NULL AND NOT regexp_matches(file_path, '{SKIPPED}')")
def src1(spark, d):
    return project_files(table(spark, d, "function_nodes")).orderBy("is_header", "file_path")


@q("SRC2", "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE regexp_matches(text, '(?m)^#{1,3} ')")
def src2(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("(?m)^#{1,3} "))
    return docs.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))


@q("SRC3", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?m)^#{1,3} ') AND NOT regexp_matches(text, '(?i)release') AND len(string_split(text, chr(10))) <= 30")
def src3(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("(?m)^#{1,3} ") & ~F.col("text").rlike("(?i)release"))
    return docs.where(F.size(F.split("text", "\n")) <= 30).select("doc_id")


@q("SRC4", f"SELECT DISTINCT file_path FROM retrieved_functions WHERE ends_with(file_path, '.py') AND NOT regexp_matches(file_path, '{SKIPPED}')")
def src4(spark, d):
    py = table(spark, d, "retrieved_functions").where(F.col("file_path").endswith(".py"))
    return project_files(py).select("file_path").orderBy("file_path")


_TEXTS = """b AS (SELECT file_path, arg_max(body, (length(body), body)) AS text FROM retrieved_functions WHERE file_path IS NOT NULL AND body IS NOT NULL GROUP BY 1),
  s AS (SELECT regexp_replace(string_split(file_path, '/')[-1], '\\.[^.]*$', '') AS stem, regexp_replace(file_path, '\\.[^.]*$', '') AS place, text, file_path FROM b)"""


@q("SRC10", f"""WITH {_TEXTS}, i AS (SELECT * FROM s WHERE NOT regexp_matches(file_path, '\\.(h|hpp)$')), n AS (SELECT place, arg_max(text, (length(text), text)) AS near FROM i GROUP BY 1), f AS (SELECT stem, arg_max(text, (length(text), file_path, text)) AS far FROM i GROUP BY 1)
  SELECT s.file_path, CASE WHEN length(text) < 400 AND length(coalesce(near, far)) > length(text) THEN coalesce(near, far) ELSE text END AS text FROM s LEFT JOIN n USING (place) LEFT JOIN f ON f.stem = s.stem WHERE regexp_matches(s.file_path, '\\.(h|hpp)$')""")
def src10(spark, d):
    b = table(spark, d, "retrieved_functions").where("file_path IS NOT NULL AND body IS NOT NULL")
    b = materialize(b.groupBy("file_path").agg(F.max(F.struct(F.length("body"), "body")).alias("m")).select("file_path", F.col("m.body").alias("text")))
    return implementation_text(b.where(F.col("file_path").rlike(r"\.(h|hpp)$")), b, 400)


@q("SNK7", f"{_R} SELECT result_id, qa_id, question FROM once WHERE qa_id IS NOT NULL AND question IS NOT NULL")
def snk7(spark, d):
    out = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    sinks.write_results(_once(spark, d).where("qa_id IS NOT NULL AND question IS NOT NULL").select("result_id", "qa_id", "question"), out)
    return read_records(spark, out, "jsonl").select("result_id", "qa_id", "question")


@q("SNK8")
def snk8(spark, d):
    by = _ranked(spark, d).groupBy("source").agg(F.count("*").alias("n")).orderBy("source")
    return spark.createDataFrame([(sinks.report(by, "Hits by source"),)], "report string")


@q("AGT5", f"{_R} SELECT result_id, rank AS step, name, lead(name) OVER (PARTITION BY result_id ORDER BY rank) AS next FROM ranked")
def agt5(spark, d):
    nxt = F.lead("name").over(Window.partitionBy("result_id").orderBy("rank"))
    return _ranked(spark, d).select("result_id", F.col("rank").alias("step"), "name", nxt.alias("next"))


@q("AGT6", f"""WITH {SQL_FUNCTIONS}, {_KW}, s AS (SELECT DISTINCT question, lower(unnest(list_concat(list_reverse(list_filter(w, lambda x: contains(x, '_') OR regexp_matches(substr(x, 2), '[A-Z]'))), list_filter(w, lambda x: NOT (contains(x, '_') OR regexp_matches(substr(x, 2), '[A-Z]'))))[1:2])) AS word FROM kq),
  c AS (SELECT DISTINCT question, word AS symbol, file_path FROM s JOIN functions f ON lower(f.name) = word),
  k AS (SELECT *, row_number() OVER (PARTITION BY question, symbol ORDER BY CASE WHEN contains(file_path, split_part(symbol, '_', 2)) AND split_part(symbol, '_', 2) <> '' THEN 0 ELSE 1 END, file_path) AS r FROM c) SELECT question, symbol, file_path FROM k WHERE r <= 3""")
def agt6(spark, d):
    k = F.transform(t.keywords(F.col("question"), 2), lambda w: F.lower(w))
    s = materialize(_questions(spark, d).select("question", F.explode(k).alias("symbol")).distinct())
    files = functions(spark, d).where("name IS NOT NULL").select(F.lower("name").alias("symbol"), "file_path").join(s.select("symbol").distinct(), "symbol", "left_semi").distinct()
    part = F.split_part("symbol", F.lit("_"), F.lit(2))
    first = F.when(F.col("file_path").contains(part) & (part != ""), 0).otherwise(1)
    w = Window.partitionBy("question", "symbol").orderBy(first, "file_path")
    return s.join(files, "symbol").withColumn("r", F.row_number().over(w)).where("r <= 3").select("question", "symbol", "file_path")


@q("AGT14", f"{_R}, c AS (SELECT k, result_id, avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END) AS covered FROM ranked, (VALUES (1), (2), (4)) AS t(k) WHERE source = 'grep' GROUP BY 1, 2) SELECT k AS config, round(avg(covered), 6) AS mean, round(avg(covered) - (SELECT avg(covered) FROM c WHERE k = 1), 6) AS gain FROM c GROUP BY k")
def agt14(spark, d):
    r = materialize(_ranked(spark, d))
    each = [a.coverage(r, gold(), k).select(F.lit(k).alias("config"), "covered") for k in (1, 2, 4)]
    runs = each[0].unionByName(each[1]).unionByName(each[2]).groupBy("config").agg(F.avg("covered").alias("m"))
    base = F.max(F.when(F.col("config") == 1, F.col("m"))).over(Window.partitionBy(F.lit(1)))  # one row a configuration
    return runs.select("config", F.round("m", 6).alias("mean"), F.round(F.col("m") - base, 6).alias("gain"))


_REST = "regexp_extract(text, '^\\s*\\}?\\s*(?:else\\s+)?(?:if|switch|catch)\\s*\\((.*)$', 1)"


@q("WN10", f"WITH {SQL_LINES}, c AS (SELECT rf_id, line_no, {_REST} AS rest, lead(text) OVER (PARTITION BY rf_id ORDER BY line_no) AS next FROM lines) SELECT rf_id, line_no, length(regexp_replace(rest, '[^(]', '', 'g')) - length(regexp_replace(rest, '[^)]', '', 'g')) AS depth, coalesce(next, '') AS next FROM c WHERE rest <> ''")
def wn10(spark, d):
    rest = F.regexp_extract("text", r"^\s*\}?\s*(?:else\s+)?(?:if|switch|catch)\s*\((.*)$", 1)
    nxt = F.coalesce(F.lead("text").over(Window.partitionBy("rf_id").orderBy("line_no")), F.lit(""))
    c = lines(spark, d).select("rf_id", "line_no", rest.alias("rest"), nxt.alias("next")).where("rest <> ''")
    depth = F.length(F.regexp_replace("rest", r"[^(]", "")) - F.length(F.regexp_replace("rest", r"[^)]", ""))
    return c.select("rf_id", "line_no", depth.alias("depth"), "next")


_TREE = """[{"name": "Pool", "kind": 5, "range": {"start": {"line": 0}, "end": {"line": 9}}, "children": [
  {"name": "run", "kind": 6, "detail": "int ()", "range": {"start": {"line": 2}, "end": {"line": 4}}}, {"name": "n", "kind": 8, "range": {"start": {"line": 5}, "end": {"line": 5}}}]},
  {"name": "Color", "kind": 10, "range": {"start": {"line": 11}, "end": {"line": 12}}}, {"name": "main", "kind": 12, "detail": "int ()", "range": {"start": {"line": 14}, "end": {"line": 20}}}]"""
