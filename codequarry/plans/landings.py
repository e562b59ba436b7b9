"""Queries on inputs that are landed first: written from the tables as files or texts of another form, then read by the operator."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.functions import text as t
from codequarry.operators import context as c
from codequarry.operators import filters as f
from codequarry.operators import incremental as inc
from codequarry.plans.fixtures import SQL_CALLS, SQL_FUNCTIONS, SQL_NODES, calls, functions, nodes
from codequarry.plans.metrics import _R, _once, _ranked
from codequarry.session import materialize, shared_dir, table
from codequarry.sources import landed
from codequarry.sources.code import read_records

QUERIES: dict = {}
ORACLE: dict = {}


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- symbol trees and issue pages, as services answer them -------------------------------------------------------------

_SPANS = "start_line IS NOT NULL AND end_line IS NOT NULL AND name IS NOT NULL AND name <> '' AND file_path IS NOT NULL"


@q("SRC5", f"""WITH {SQL_FUNCTIONS}, s AS (SELECT * FROM functions WHERE {_SPANS}) SELECT file_path, name, CASE WHEN parent_class IS NULL THEN 'function' ELSE 'method' END AS kind, signature, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, parent_class FROM s
  UNION ALL SELECT file_path, parent_class, 'class', NULL, min(start_line), max(end_line), NULL FROM s WHERE parent_class IS NOT NULL GROUP BY file_path, parent_class""")
def src5(spark, d):
    s = functions(spark, d).where(_SPANS)
    line = lambda x: F.struct((F.col(x) - 1).alias("line"))
    span = lambda a, b: F.struct(F.struct(a.alias("line")).alias("start"), F.struct(b.alias("line")).alias("end"))
    one = F.struct("name", F.when(F.col("parent_class").isNull(), 12).otherwise(6).alias("kind"), F.col("signature").alias("detail"), F.struct(line("start_line").alias("start"), line("end_line").alias("end")).alias("range"))
    # the symbols of one class, then the classes and functions of one file: as many as a file has
    held = s.groupBy("file_path", "parent_class").agg(F.collect_list(one).alias("in"), span(F.min("start_line") - 1, F.max("end_line") - 1).alias("range"))
    node = F.when(F.col("parent_class").isNull(), F.array_join(F.transform("in", lambda x: F.to_json(x)), ",")).otherwise(F.to_json(F.struct(F.col("parent_class").alias("name"), F.lit(5).alias("kind"), "range", F.col("in").alias("children"))))
    trees = held.groupBy("file_path").agg(F.concat(F.lit("["), F.array_join(F.collect_list(node), ","), F.lit("]")).alias("tree"))
    return landed.symbols(materialize(trees))


@q("SRC6", """WITH i AS (SELECT DISTINCT id, number, title, coalesce(state, 'open') AS state, fetched_at FROM issues WHERE number % 7 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, state DESC) AS r FROM i)
  SELECT id, number, title, state FROM k WHERE r = 1""")
def src6(spark, d):
    # a page for each repository, hour of fetching and hundred of numbers; every seventh number is a pull request
    i = table(spark, d, "issues").select("id", "number", "title", F.coalesce("state", F.lit("open")).alias("state"), "fetched_at").distinct()
    repo = F.substring_index("id", "#", 1)
    rank = F.dense_rank().over(Window.partitionBy("id").orderBy("fetched_at", "state"))
    request = F.when(F.col("number") % 7 == 0, F.struct(F.lit("u").alias("url")))
    rows = i.withColumns({"repo": repo, "page": rank}).select("repo", "page", F.floor(F.col("number") / 100).alias("h"), F.to_json(F.struct("number", "title", "state", request.alias("pull_request"))).alias("j"))
    pages = rows.groupBy("repo", "page", "h").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("body"))
    return landed.issue_pages(materialize(pages), F.col("repo")).select("id", "number", "title", "state")


# --- records and indexes in files ---------------------------------------------------------------------------------------


@q("SRC7", f"{_R}, a AS (SELECT qa_id, result_id, coalesce(latency_ms, 0) AS ms FROM once WHERE qa_id IS NOT NULL) SELECT kind, qa_id, result_id, ms FROM a, (VALUES ('csv'), ('json'), ('jsonl')) AS v(kind)")
def src7(spark, d):
    a = materialize(_once(spark, d).where("qa_id IS NOT NULL").select("qa_id", "result_id", F.coalesce("latency_ms", F.lit(0.0)).alias("ms")))
    out = None
    for kind in ("csv", "json", "jsonl"):
        path = _path(spark, kind)
        if kind == "csv":
            a.write.csv(path, header=True)
        elif kind == "jsonl":
            a.write.json(path)
        else:
            # one document a part, with its rows below "results"
            rows = F.to_json(F.struct(F.collect_list(F.struct(*a.columns)).alias("results")))
            a.groupBy(F.pmod(F.xxhash64("result_id"), F.lit(16)).alias("part")).agg(rows.alias("value")).write.partitionBy("part").text(path)
        got = read_records(spark, path, kind, "results" if kind == "json" else None)
        got = got.select(F.lit(kind).alias("kind"), "qa_id", F.col("result_id").cast("long").alias("result_id"), F.col("ms").cast("double").alias("ms"))
        out = got if out is None else out.unionByName(got)
    return out


@q("SRC8", "SELECT vec_id AS chunk_id, label, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings WHERE embedding IS NOT NULL")
def src8(spark, d):
    path = _path(spark, "index")
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("chunk_id"), F.struct("label").alias("meta"), "embedding")
    e.write.json(path)
    index = read_records(spark, path, "jsonl", schema="chunk_id long, meta struct<label:int>, embedding array<float>")
    return index.select("chunk_id", "meta.label", F.size("embedding").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


# --- links between requests, issues and files -----------------------------------------------------------------------------

# A request for every second issue: its text closes the issue with the next number, what its body mentions included.
_PRS = "prs AS (SELECT DISTINCT id AS pr, split_part(id, '#', 1) AS repo, concat('Fixes #', number + 1, ' and closes  #', coalesce(comments, 0), '; see #', number, chr(10), coalesce(body, '')) AS body FROM issues WHERE number % 2 = 0)"
_FIXES = r"f AS (SELECT DISTINCT pr, repo, CAST(unnest(regexp_extract_all(body, '(?i)(?:fixes?|closes?|resolves?)\s+#(\d+)', 1)) AS INTEGER) AS issue FROM prs)"


def _prs(spark, d):
    i = table(spark, d, "issues").where("number % 2 = 0")
    body = F.concat(F.lit("Fixes #"), F.col("number") + 1, F.lit(" and closes  #"), F.coalesce("comments", F.lit(0)), F.lit("; see #"), F.col("number"), F.lit("\n"), F.coalesce("body", F.lit("")))
    return i.select(F.col("id").alias("pr"), F.substring_index("id", "#", 1).alias("repo"), body.alias("body")).distinct()


@q("TX7", f"WITH {_PRS}, {_FIXES} SELECT pr, issue FROM f")
def tx7(spark, d):
    return _prs(spark, d).select("pr", F.explode(t.fixed_issues(F.col("body"))).alias("issue")).distinct()


@q("JN12", f"WITH {_PRS}, {_FIXES} SELECT pr, id AS issue FROM f JOIN (SELECT DISTINCT id FROM issues) i ON id = repo || '#i' || issue")
def jn12(spark, d):
    fixes = _prs(spark, d).select("pr", "repo", F.explode(t.fixed_issues(F.col("body"))).alias("n")).distinct()
    known = table(spark, d, "issues").select(F.col("id").alias("issue")).distinct()
    return fixes.select("pr", F.concat("repo", F.lit("#i"), "n").alias("issue")).join(known, "issue").select("pr", "issue")


@q("SNK6", f"""WITH {_PRS}, {_FIXES}, i AS (SELECT id, state, substr(title, 1, 4096) AS title, substr(body, 1, 65535) AS body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, state DESC NULLS LAST, title DESC NULLS LAST, body DESC NULLS LAST) AS r FROM issues WHERE id IS NOT NULL) z WHERE r = 1)
  SELECT 'issue' AS kind, id AS src, state AS what, title, body, NULL AS dst FROM i UNION ALL SELECT DISTINCT 'edge', pr, 'FIXES', NULL, NULL, id FROM f JOIN i ON id = repo || '#i' || issue WHERE pr IN (SELECT id FROM i)""")
def snk6(spark, d):
    from codequarry.sources.sinks import issue_rows

    rows = materialize(issue_rows(table(spark, d, "issues")))
    fixes = _prs(spark, d).select("pr", "repo", F.explode(t.fixed_issues(F.col("body"))).alias("n"))
    edges = fixes.select(F.col("pr").alias("src"), F.lit("FIXES").alias("type"), F.concat("repo", F.lit("#i"), "n").alias("dst"))
    null = F.lit(None).cast("string")
    kept = inc.connected_edges(edges, rows.select("id")).select(F.lit("edge").alias("kind"), "src", F.col("type").alias("what"), null.alias("title"), null.alias("body"), "dst").distinct()
    return rows.select(F.lit("issue").alias("kind"), F.col("id").alias("src"), F.col("state").alias("what"), "title", "body", null.alias("dst")).unionByName(kept)


# Changed paths are given by their last two parts, so that files are found by their ends.
_WANTED = "w AS (SELECT DISTINCT rf_id AS pr, array_to_string(string_split(file_path, '/')[-2:], '/') AS path FROM retrieved_functions WHERE file_path IS NOT NULL AND rf_id IS NOT NULL)"


@q("JN10", f"WITH {_WANTED}, x AS (SELECT DISTINCT path FROM w), fl AS (SELECT DISTINCT file_path, array_to_string(string_split(file_path, '/')[-2:], '/') AS tail FROM function_nodes WHERE file_path IS NOT NULL), m AS (SELECT path, file_path FROM x JOIN fl ON (tail = path OR file_path = path) AND (file_path = path OR ends_with(file_path, '/' || path))) SELECT pr, file_path, count(DISTINCT name) AS functions FROM w JOIN m USING (path) JOIN function_nodes USING (file_path) GROUP BY 1, 2")
def jn10(spark, d):
    rf = table(spark, d, "retrieved_functions").where("file_path IS NOT NULL AND rf_id IS NOT NULL")
    w = rf.select(F.col("rf_id").alias("pr"), F.substring_index("file_path", "/", -2).alias("wanted")).distinct()
    fn = table(spark, d, "function_nodes").where("file_path IS NOT NULL")
    found = f.suffix_matches(w.select("wanted").distinct(), fn.select("file_path").distinct()).where(F.length("wanted") <= F.length("file_path"))
    per = fn.groupBy("file_path").agg(F.countDistinct("name").alias("functions"))
    return w.join(found.select("wanted", "file_path"), "wanted").join(per, "file_path").select("pr", "file_path", "functions")


# --- replies of a model, as they are recorded --------------------------------------------------------------------------------

_REPLY = """reply AS (SELECT result_id, CASE WHEN rf IS NULL THEN 'unknown' WHEN len(rf) > 4 THEN 'topic' ELSE 'symbol' END AS query_type, list_transform(coalesce(rf, []), lambda x: coalesce(x.name, '?')) AS names, rf[1].score * 2 - 0.5 AS c FROM once WHERE result_id % 11 <> 3)"""


def _replies(spark, d):
    """Every third reply is fenced, with a comma too many; others stand between words, some are no object at all."""
    o = _once(spark, d)
    rf = F.col("retrieved_functions")
    kind = F.when(rf.isNull(), F.lit(None).cast("string")).when(F.size(rf) > 4, "topic").otherwise("symbol")
    names = F.transform(F.coalesce(rf, F.array().cast(o.schema["retrieved_functions"].dataType)), lambda x: F.coalesce(x["name"], F.lit("?")))
    body = F.to_json(F.struct(kind.alias("query_type"), names.alias("symbols"), (F.try_element_at(rf, F.lit(1))["score"] * 2 - 0.5).alias("confidence")))
    loose = F.regexp_replace(body, r"\}$", ",}")
    text = F.when(F.col("result_id") % 11 == 3, F.lit("I cannot tell.")).when(F.col("result_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), loose, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is "), body, F.lit(" as asked")))
    return materialize(o.select("result_id", text.alias("reply")))


@q("TX25", f"{_R}, {_REPLY} SELECT result_id, CASE WHEN query_type <> 'unknown' THEN query_type END AS type, len(names) AS n FROM reply UNION ALL SELECT result_id, NULL, NULL FROM once WHERE result_id % 11 = 3")
def tx25(spark, d):
    o = t.json_from_reply(F.col("reply"), "query_type string, symbols array<string>, confidence double")
    r = _replies(spark, d).withColumn("o", o)
    return r.select("result_id", F.col("o.query_type").alias("type"), F.array_size("o.symbols").alias("n"))


@q("AGT12", f"{_R}, {_REPLY} SELECT result_id, query_type, len(names) AS symbols, round(coalesce(least(1.0, greatest(0.0, c)), 0.0), 6) AS confidence FROM reply UNION ALL SELECT result_id, 'unknown', 0, 0.0 FROM once WHERE result_id % 11 = 3")
def agt12(spark, d):
    raw = F.to_json(t.json_from_reply(F.col("reply"), "query_type string, symbols array<string>, confidence double"))
    a = _replies(spark, d).withColumn("o", raw).select("result_id", c.query_analysis("o").alias("a"))
    return a.select("result_id", "a.query_type", "a.symbols", F.round("a.confidence", 6).alias("confidence"))


_NAMED = "u.file_path IS NOT NULL AND u.start_line IS NOT NULL AND u.file_path NOT LIKE '% %' AND u.file_path NOT LIKE '%:%'"


@q("TX27", f"""{_R}, u AS (SELECT result_id, i, rf[i] AS u FROM (SELECT result_id, rf, unnest(range(1, len(rf) + 1)) AS i FROM once) z), g AS (SELECT result_id, i, u, i % 3 AS e FROM u WHERE {_NAMED}),
  k AS (SELECT *, row_number() OVER (PARTITION BY result_id, e ORDER BY i) AS r FROM g)
  SELECT result_id, 'E' || e || CASE WHEN r > 1 THEN '_' || (r - 1) ELSE '' END AS evidence_id, u.file_path AS file, u.start_line AS line_start, coalesce(u.end_line, u.start_line) AS line_end, coalesce(u.source, '') AS kind FROM k""")
def tx27(spark, d):
    """Records like ``E1 file:a-b kind``, parted by either semicolon; evidence ids repeat."""
    u = _once(spark, d).select("result_id", F.posexplode("retrieved_functions").alias("k", "u")).where(_NAMED)
    lines = F.concat(F.col("u.start_line").cast("string"), F.coalesce(F.concat(F.lit("-"), F.col("u.end_line").cast("string")), F.lit("")))
    one = F.concat(F.lit("E"), (F.col("k") + 1) % 3, F.lit(" "), "u.file_path", F.lit(":"), lines, F.coalesce(F.concat(F.lit(" "), "u.source"), F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", one.alias("r")))), lambda x: x["r"])
    raw = u.groupBy("result_id").agg(F.when(F.col("result_id") % 2 == 0, F.array_join(parts, "; ")).otherwise(F.array_join(parts, "；")).alias("raw"))
    return t.gold_evidence(materialize(raw), "result_id", "raw")


# --- changes between two snapshots of the sources -----------------------------------------------------------------------------

_OLDNEW = """b AS (SELECT file_path, min(md5(body)) AS h, row_number() OVER (ORDER BY file_path) % 10 AS m FROM retrieved_functions WHERE file_path IS NOT NULL AND body IS NOT NULL GROUP BY 1),
  b2 AS (SELECT file_path, h, ascii(right(h, 1)) % 10 AS m FROM b), old AS (SELECT file_path, h FROM b2 WHERE m <> 0), new AS (SELECT CASE WHEN m = 3 THEN 'moved/' || file_path ELSE file_path END AS file_path, CASE WHEN m = 2 THEN 'x' || h ELSE h END AS h FROM b2 WHERE m <> 1)"""


def _snapshots(spark, d):
    b = table(spark, d, "retrieved_functions").where("file_path IS NOT NULL AND body IS NOT NULL").groupBy("file_path").agg(F.min(F.md5("body")).alias("h"))
    b = materialize(b.withColumn("m", F.ascii(F.right("h", F.lit(1))) % 10))
    moved = F.when(F.col("m") == 3, F.concat(F.lit("moved/"), "file_path")).otherwise(F.col("file_path"))
    new = b.where("m <> 1").select(moved.alias("file_path"), F.when(F.col("m") == 2, F.concat(F.lit("x"), "h")).otherwise(F.col("h")).alias("h"))
    return b.where("m <> 0").select("file_path", "h"), new


_CHANGES = f"""{_OLDNEW}, one AS (SELECT h, min(file_path) AS old_path FROM old WHERE file_path NOT IN (SELECT file_path FROM new) GROUP BY h HAVING count(*) = 1), two AS (SELECT h, min(file_path) AS file_path FROM new WHERE file_path NOT IN (SELECT file_path FROM old) GROUP BY h HAVING count(*) = 1),
  ren AS (SELECT old_path, file_path FROM one JOIN two USING (h)), ch AS (SELECT 'R' AS change, file_path, old_path FROM ren UNION ALL SELECT 'A', file_path, NULL FROM new WHERE file_path NOT IN (SELECT file_path FROM old) AND file_path NOT IN (SELECT file_path FROM ren)
   UNION ALL SELECT 'D', file_path, NULL FROM old WHERE file_path NOT IN (SELECT file_path FROM new) AND file_path NOT IN (SELECT old_path FROM ren) UNION ALL SELECT 'M', n.file_path, NULL FROM new n JOIN old o ON o.file_path = n.file_path WHERE o.h <> n.h)"""


@q("SRC11", f"WITH {_CHANGES} SELECT change, file_path, old_path FROM ch")
def src11(spark, d):
    return inc.file_changes(*_snapshots(spark, d))


# A file includes the headers of the functions that its own functions call.
_INC = "i AS (SELECT DISTINCT a.file_path, b.file_path AS header FROM calls JOIN nodes a ON a.name = src JOIN nodes b ON b.name = dst WHERE regexp_matches(b.file_path, '\\.(h|hpp)$') AND a.file_path <> b.file_path)"


@q("SRC11_cascade", f"WITH {SQL_NODES}, {SQL_CALLS}, {_INC}, hd AS (SELECT DISTINCT header FROM i), c AS (SELECT header AS file_path FROM hd WHERE length(header) % 2 = 0), base AS (SELECT DISTINCT string_split(file_path, '/')[-1] AS b FROM c) SELECT file_path, 'changed' AS why FROM c UNION ALL SELECT DISTINCT file_path, 'includes' FROM i WHERE string_split(header, '/')[-1] IN (SELECT b FROM base) AND file_path NOT IN (SELECT file_path FROM c)")
def src11_cascade(spark, d):
    n, e = nodes(spark, d), calls(spark, d)
    a, b = (n.select(F.col("name").alias(x), F.col("file_path").alias(y)) for x, y in (("src", "file_path"), ("dst", "header")))
    includes = e.join(a, "src").join(b, "dst").where(F.col("header").rlike(r"\.(h|hpp)$") & (F.col("file_path") != F.col("header"))).select("file_path", "header").distinct()
    includes = materialize(includes)
    changed = includes.select(F.col("header").alias("file_path")).distinct().where(F.length("file_path") % 2 == 0)
    return inc.header_cascade(changed, includes)


# --- recorded steps ------------------------------------------------------------------------------------------------------------


@q("JN14", f"{_R}, g AS (SELECT result_id, row_number() OVER (ORDER BY result_id) - 1 AS k, question FROM once), r AS (SELECT result_id, row_number() OVER (ORDER BY result_id) - 1 AS k, answer FROM once WHERE result_id >= (SELECT result_id FROM g WHERE k = 100)) SELECT g.result_id AS item, r.result_id AS result FROM g JOIN r ON r.k = g.k - 100 WHERE g.k >= 100 AND g.k < 100 + (SELECT count(*) FROM r)")
def jn14(spark, d):
    from codequarry.operators.joins import numbered_rows, positional

    items = _once(spark, d).select("result_id")
    first = numbered_rows(items, "result_id").where("k = 100").select(F.col("result_id").alias("least"))
    results = items.join(F.broadcast(first), F.col("result_id") >= F.col("least")).select("result_id")  # one row
    return positional(items, results, "result_id", 100).select(F.col("result_id").alias("item"), F.col("other").alias("result"))


@q("AG20", f"""{_R}, k AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY result_id) AS r, count(*) OVER (PARTITION BY qa_id) AS n FROM once WHERE qa_id IS NOT NULL), m AS (SELECT 'base' AS run, * FROM k WHERE r = 1 UNION ALL SELECT 'new', * FROM k WHERE r = n),
  a AS (SELECT run, avg(CASE WHEN coalesce(error, '') = '' THEN 1.0 ELSE 0.0 END) AS ok, avg(latency_ms) AS ms, count(*) AS n FROM m GROUP BY 1) SELECT round(b.ok, 6) AS base_ok, round(w.ok, 6) AS new_ok, round(w.ok - b.ok, 6) AS ok_delta, round(w.ms - b.ms, 4) AS latency_delta, w.n - b.n AS count_delta FROM a b, a w WHERE b.run = 'base' AND w.run = 'new'""")
def ag20(spark, d):
    from codequarry.operators.aggregates import run_deltas

    one = Window.partitionBy("qa_id")
    k = materialize(_once(spark, d).where("qa_id IS NOT NULL").select("result_id", (F.coalesce("error", F.lit("")) == "").alias("ok"), "latency_ms", F.row_number().over(one.orderBy("result_id")).alias("r"), F.count("*").over(one).alias("n")))
    return run_deltas(k.where("r = 1"), k.where("r = n"))


@q("TK9", f"{_R}, w AS (SELECT DISTINCT question, regexp_extract_all(question, '\\b[a-zA-Z_][a-zA-Z0-9_]{{2,}}\\b') AS w FROM once WHERE question IS NOT NULL) SELECT question, array_to_string(list_concat(list_reverse(list_filter(w, lambda x: contains(x, '_'))), list_filter(w, lambda x: NOT contains(x, '_'))), '|') AS words FROM w")
def tk9(spark, d):
    words = F.regexp_extract_all("question", F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b".replace(r"\b", t.BORDER)), F.lit(0))
    return _once(spark, d).where("question IS NOT NULL").select("question").distinct().select("question", F.array_join(t.identifiers_first(words), "|").alias("words"))


@q("AGT14_resume", f"{_R}, g AS (SELECT result_id, row_number() OVER (ORDER BY result_id) - 1 AS k FROM once) SELECT result_id, k FROM g WHERE k >= 50 AND k < 450 AND result_id % 3 <> 0")
def agt14_resume(spark, d):
    from codequarry.operators.joins import batch

    items = _once(spark, d).select("result_id")
    # a run that was interrupted has written every third result
    path = _path(spark, "done")
    items.where("result_id % 3 = 0").write.json(path)
    done = read_records(spark, path, "jsonl", schema="result_id long")
    return batch(items, "result_id", 50, 400, done)
