"""Queries RT, SRC, SNK, GR21, AGT and ST."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.functions import text as t
from codequarry.functions.vectors import nearest
from codequarry.operators import context as c
from codequarry.operators import filters as f
from codequarry.operators import incremental as inc
from codequarry.operators import retrieval as r
from codequarry.plans.filters import _LADDER
from codequarry.plans.fixtures import SQL_CALLS, SQL_FUNCTIONS, SQL_LINES, SQL_NODES, calls, functions, lines, nodes
from codequarry.plans.metrics import _CH, _R, _TWO, _chunks, _once, _ranked
from codequarry.plans.texts import _sql_list
from codequarry.session import materialize, table
from codequarry.sources.sinks import issue_rows

QUERIES: dict = {}
ORACLE: dict = {}
_L = f"WITH {SQL_LINES}"


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@q("RT2", f"{_L} SELECT file_path, count(*) AS n FROM lines WHERE regexp_matches(text, '(?i)\\bfetch_frame\\b') OR contains(lower(text), 'lock_guard') GROUP BY 1")
def rt2(spark, d):
    ln = lines(spark, d)
    a, b = r.grep(ln, "fetch_frame", word=True), r.grep(ln, "lock_guard", fixed=True)
    return a.unionByName(b).select("rf_id", "line_no", "file_path").distinct().groupBy("file_path").agg(F.count("*").alias("n"))


_IDX = "idx AS (SELECT DISTINCT rf_id, file_path, line_no, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}')) AS word FROM lines)"


@q("RT3", f"{_L}, {SQL_FUNCTIONS}, {_IDX} SELECT DISTINCT word, file_path FROM idx WHERE word IN (SELECT lower(name) FROM functions WHERE starts_with(name, 'parse_')) AND NOT regexp_matches(file_path, '(^|/)build/')")
def rt3(spark, d):
    s = functions(spark, d).where(F.col("name").startswith("parse_")).select(F.col("name").alias("word"))
    return r.symbol_files(lines(spark, d), s)


_KW = f"""kq AS (SELECT question, list_filter(regexp_extract_all(question, '\\b[a-zA-Z_][a-zA-Z0-9_]{{2,}}\\b'), lambda x: NOT list_contains({_sql_list(t.STOP_WORDS + t.KEYWORDS)}, lower(x))) AS w FROM (SELECT DISTINCT question FROM qa_results WHERE question IS NOT NULL) z),
  kl AS (SELECT question, list_distinct(list_transform(list_concat(list_reverse(list_filter(w, lambda x: contains(x, '_') OR regexp_matches(substr(x, 2), '[A-Z]'))), list_filter(w, lambda x: NOT (contains(x, '_') OR regexp_matches(substr(x, 2), '[A-Z]'))))[1:6], lambda x: lower(x))) AS k FROM kq),
  kw AS (SELECT question, len(k) AS n, unnest(k) AS word FROM kl)"""


def _questions(spark, d):
    return table(spark, d, "qa_results").where("question IS NOT NULL").select("question").distinct()


@q("RT4", f"{_L}, {_IDX}, {_KW}, s AS (SELECT question, rf_id, round(least(1.0, count(*) / max(n)), 4) AS score FROM kw JOIN (SELECT DISTINCT word, rf_id FROM idx) i USING (word) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, rf_id) AS rank FROM s) SELECT question, rf_id, score FROM k WHERE rank <= 10")
def rt4(spark, d):
    return r.grep_retrieve(_questions(spark, d), lines(spark, d), 10).select("question", "rf_id", "score")


_COS = "cos AS (SELECT a.vec_id AS query, b.vec_id AS id, b.label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS score FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0 AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL)"


def _near(spark, d, k, least=None):
    e = table(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 50 = 0"), k, least=least)


@q("RT5", f"WITH {_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM cos) SELECT query, id, score, rank FROM k WHERE rank <= 10")
def rt5(spark, d):
    return _near(spark, d, 10)


@q("RT6", f"""WITH {_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM cos), o AS (SELECT query, label, max(score) AS score FROM k WHERE rank <= 20 AND score >= 0.2 GROUP BY 1, 2),
  p AS (SELECT query, label, CASE WHEN label < 2 THEN score * 0.5 ELSE score END AS score FROM o), s AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, label) AS r FROM p) SELECT query, label, score FROM s WHERE r <= 10""")
def rt6(spark, d):
    lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("name"))
    top = _near(spark, d, 20).where("score >= 0.2").join(lab, "id").groupBy("query", "name").agg(F.max("score").alias("score"))
    hubs = lab.where("name < 2").select("name")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "name")
    return r.penalised(top, hubs).withColumn("r", F.row_number().over(w)).where("r <= 10").select("query", F.col("name").alias("label"), "score")


_WD = f"list_distinct(list_filter(regexp_split_to_array(lower(%s), '[^a-z0-9_]+'), lambda x: length(x) > 2 AND NOT list_contains({_sql_list(t.INDEX_STOP_WORDS)}, x)))"


@q("RT7", f"""WITH a AS (SELECT question, unnest({_WD % 'question'}) AS word FROM (SELECT DISTINCT question FROM qa_results WHERE question IS NOT NULL) z), h AS (SELECT DISTINCT id, unnest({_WD % 'title'}) AS word FROM issues WHERE title IS NOT NULL),
  n AS (SELECT question, id, count(*) AS n FROM a JOIN h USING (word) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, id) AS rank FROM n) SELECT question, id, n FROM k WHERE rank <= 5""")
def rt7(spark, d):
    return r.contained_words(_questions(spark, d), table(spark, d, "issues"), "id", "title", 5).select("question", "id", "n")


@q("RT9", f"WITH {SQL_NODES}, {SQL_CALLS}, s AS (SELECT name FROM nodes WHERE contains(lower(name), 'parse_')), u AS (SELECT name, 'keyword' AS how FROM s UNION ALL SELECT dst, 'callee' FROM calls WHERE src IN (SELECT name FROM s)) SELECT name, max(how) AS how FROM u GROUP BY name")
def rt9(spark, d):
    s = nodes(spark, d).where(F.lower("name").contains("parse_")).select("name")
    callee = calls(spark, d).join(s.select(F.col("name").alias("src")), "src", "left_semi").select(F.col("dst").alias("name"))
    u = s.withColumn("how", F.lit("keyword")).unionByName(callee.withColumn("how", F.lit("callee")))
    return u.groupBy("name").agg(F.max("how").alias("how"))


@q("RT10", f"""WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda x: NOT list_contains({_sql_list(t.INDEX_STOP_WORDS)}, x))) AS term FROM documents WHERE text IS NOT NULL), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2),
  sz AS (SELECT id, sum(tf) AS len FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS mean FROM sz), a AS (SELECT DISTINCT question, unnest(list_filter(regexp_extract_all(lower(question), '[a-z]{{3,}}'), lambda x: NOT list_contains({_sql_list(t.INDEX_STOP_WORDS)}, x))) AS term FROM qa_results WHERE question IS NOT NULL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT question, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM a JOIN tf USING (term) JOIN df USING (term) JOIN sz USING (id), st GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) SELECT question, id, round(score, 4) AS score FROM k WHERE rank <= 3""")
def rt10(spark, d):
    # as the SQL engine rounds; Spark rounds the decimal, which differs at 0.00005
    return r.bm25(_questions(spark, d), table(spark, d, "documents"), "doc_id", "text", 3).select("question", "id", (F.floor(F.col("score") * 1e4 + 0.5) / 1e4).alias("score"))


@q("RT12", f"{_CH}, {_TWO} SELECT qn AS question, file_path, name FROM t WHERE rr <= 1")
def rt12(spark, d):
    from codequarry.operators.windows import two_stage

    return two_stage(materialize(_chunks(spark, d)), "qn", 3, 1).select(F.col("qn").alias("question"), "file_path", "name")


@q("RT13", f"{_R}, k AS (SELECT *, row_number() OVER (PARTITION BY result_id, name, file_path ORDER BY score DESC NULLS LAST, source NULLS FIRST) AS r FROM ranked WHERE score IS NOT NULL) SELECT result_id, name, file_path, score, source FROM k WHERE r = 1")
def rt13(spark, d):
    return r.merge_hits(_ranked(spark, d).where("score IS NOT NULL"), "result_id", ["name", "file_path"]).select("result_id", "name", "file_path", "score", "source")


@q("RT14", "WITH b AS (SELECT rf_id, any_value(name) AS name, any_value(file_path) AS file_path, any_value(signature) AS signature, any_value(body) AS body FROM retrieved_functions WHERE rf_id IS NOT NULL AND name IS NOT NULL AND file_path IS NOT NULL GROUP BY rf_id) SELECT rf_id, 'Function: ' || name || chr(10) || 'File: ' || file_path || chr(10) || 'Signature: ' || coalesce(signature, '') || chr(10) || substr(coalesce(body, ''), 1, 3000) AS text FROM b")
def rt14(spark, d):
    b = table(spark, d, "retrieved_functions").where("rf_id IS NOT NULL AND name IS NOT NULL AND file_path IS NOT NULL").dropDuplicates(["rf_id"])
    return b.select("rf_id", r.chunk_text(*[F.col(x) for x in ("name", "file_path", "signature", "body")]).alias("text"))


@q("RT16", f"WITH {SQL_FUNCTIONS}, k AS (SELECT split_part(file_path, '/', 2) AS module, file_path, row_number() OVER (PARTITION BY split_part(file_path, '/', 2) ORDER BY {_LADDER} DESC, file_path) AS r FROM (SELECT DISTINCT file_path FROM functions) z) SELECT module, file_path FROM k WHERE r = 1")
def rt16(spark, d):
    fl = functions(spark, d).select("file_path").distinct()
    best = F.min(F.struct((-f.file_priority()).alias("p"), "file_path")).alias("b")
    return fl.groupBy(F.split_part("file_path", F.lit("/"), F.lit(2)).alias("module")).agg(best).select("module", F.col("b.file_path").alias("file_path"))


@q("RT18", f"WITH {_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM cos), g AS (SELECT vec_id AS query, label AS gold FROM embeddings), x AS (SELECT budget, k.query, max(CASE WHEN k.label = g.gold THEN 1.0 ELSE 0.0 END) AS hit FROM k JOIN g USING (query), (VALUES (1), (5), (10), (20)) AS b(budget) WHERE rank <= budget GROUP BY 1, 2) SELECT budget, round(avg(hit), 6) AS recall FROM x GROUP BY budget")
def rt18(spark, d):
    e = table(spark, d, "embeddings")
    top = _near(spark, d, 20).join(e.select(F.col("vec_id").alias("id"), "label"), "id").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("gold")), "query")
    x = top.withColumn("budget", F.explode(F.array(*map(F.lit, (1, 5, 10, 20))))).where("rank <= budget")
    hit = x.groupBy("budget", "query").agg(F.max(F.when(F.col("label") == F.col("gold"), 1.0).otherwise(0.0)).alias("hit"))
    return hit.groupBy("budget").agg(F.round(F.avg("hit"), 6).alias("recall"))


@q("JN19", f"WITH {_COS} SELECT query, count(*) AS n, round(max(score), 4) AS best FROM cos WHERE score >= 0.3 GROUP BY query")
def jn19(spark, d):
    e = table(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 50 = 0"), None, least=0.3).groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@q("RT19", f"{_R}, u AS (SELECT result_id, name, file_path, CASE WHEN source = 'grep' THEN 1.0 ELSE score END AS score, source FROM ranked WHERE score IS NOT NULL AND name IS NOT NULL), m AS (SELECT result_id, max(score) AS best FROM u GROUP BY 1), k AS (SELECT u.*, row_number() OVER (PARTITION BY u.result_id, name ORDER BY score DESC, source, file_path) AS r FROM u JOIN m USING (result_id) WHERE best >= 0.5 OR source <> 'graph') SELECT result_id, name, CAST(score AS DOUBLE) AS score FROM k WHERE r = 1")
def rt19(spark, d):
    u = _ranked(spark, d).where("score IS NOT NULL AND name IS NOT NULL").withColumn("score", F.when(F.col("source") == "grep", 1.0).otherwise(F.col("score")))
    u = materialize(u)
    m = u.groupBy("result_id").agg(F.max("score").alias("best"))
    k = u.join(m, "result_id").where("best >= 0.5 OR source <> 'graph'")
    return k.groupBy("result_id", "name").agg(F.max("score").alias("score"))


@q("RT20", f"{_L}, h AS (SELECT file_path, text, row_number() OVER (PARTITION BY file_path ORDER BY rf_id, line_no) AS r FROM lines WHERE contains(text, 'throw ')) SELECT file_path, coalesce(nullif(regexp_extract(text, '(\\w+)\\s*\\(', 1), ''), 'unknown') AS name, substr(text, 1, 800) AS text FROM h WHERE r = 1")
def rt20(spark, d):
    first = F.min(F.struct("rf_id", "line_no", "text")).alias("h")
    h = r.grep(lines(spark, d), "throw ", fixed=True, ignore_case=False).groupBy("file_path").agg(first)
    return h.select("file_path", F.coalesce(F.nullif(F.regexp_extract("h.text", r"(\w+)\s*\(", 1), F.lit("")), F.lit("unknown")).alias("name"), F.substring("h.text", 1, 800).alias("text"))


@q("RT20_code")
def rt20_code(spark, d):
    hits = r.grep(lines(spark, d), "throw ", fixed=True, ignore_case=False)
    return r.grep_functions(hits, table(spark, d, "retrieved_functions"))


@q("RT22", f"{_R} SELECT DISTINCT file_path || ':' || start_line AS place FROM (SELECT u.file_path, u.start_line FROM (SELECT unnest(rf) AS u FROM once) z) y WHERE file_path IS NOT NULL AND start_line IS NOT NULL")
def rt22(spark, d):
    u = _once(spark, d).select(F.explode("retrieved_functions").alias("u")).where("u.file_path IS NOT NULL AND u.start_line IS NOT NULL")
    return u.select(F.concat("u.file_path", F.lit(":"), "u.start_line").alias("place")).distinct()


_SNAP = "old AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 0), new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 2 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 10 <> 1)"


def _snap(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    m = F.col("id") % 10
    return o.where(m != 0), o.where(m != 1).select("id", F.when(m == 2, "X").otherwise(F.col("s")).alias("s"), F.when(m != 3, F.col("v")).alias("v"))


@q("SNK1", f"WITH {_SNAP} SELECT coalesce(a.id, b.id) AS id, coalesce(b.s, a.s) AS s, coalesce(b.v, a.v) AS v FROM old a FULL JOIN new b ON a.id = b.id")
def snk1(spark, d):
    return inc.upsert(*_snap(spark, d), "id")


_E = "e AS (SELECT DISTINCT concat(u.file_path, '#', u.name) AS src, 'AT' AS type, u.file_path AS dst FROM (SELECT unnest(retrieved_functions) AS u FROM qa_results) z WHERE u.file_path IS NOT NULL AND u.name IS NOT NULL), n AS (SELECT DISTINCT file_path AS id FROM function_nodes UNION SELECT concat(file_path, '#', name) FROM function_nodes WHERE name IS NOT NULL)"


def _edges(spark, d):
    u = table(spark, d, "qa_results").select(F.explode("retrieved_functions").alias("u")).where("u.file_path IS NOT NULL AND u.name IS NOT NULL")
    e = u.select(F.concat("u.file_path", F.lit("#"), "u.name").alias("src"), F.lit("AT").alias("type"), F.col("u.file_path").alias("dst"))
    fn = table(spark, d, "function_nodes")
    n = fn.select(F.col("file_path").alias("id")).union(fn.where("name IS NOT NULL").select(F.concat("file_path", F.lit("#"), "name")))
    return e, n


@q("SNK2", f"WITH {_E} SELECT src, type, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def snk2(spark, d):
    e, n = _edges(spark, d)
    return inc.connected_edges(e, n).select("src", "type", "dst")


@q("SNK3", "SELECT id, count(*) AS n FROM function_nodes GROUP BY id HAVING count(*) > 1")
def snk3(spark, d):
    return inc.duplicate_ids(table(spark, d, "function_nodes"))


@q("SNK5", f"WITH {SQL_FUNCTIONS}, gone AS (SELECT file_path FROM functions WHERE name = 'main'), k AS (SELECT * FROM functions WHERE file_path NOT IN (SELECT file_path FROM gone)) SELECT 'nodes' AS what, count(*) AS n FROM k UNION ALL SELECT 'edges', count(*) FROM k WHERE fan_in > 3")
def snk5(spark, d):
    fn = materialize(functions(spark, d))
    loops = fn.where("fan_in > 3").select(F.col("id").alias("src"), F.lit("SELF").alias("type"), F.col("id").alias("dst"))
    n, e = inc.delete_files(fn, loops, fn.where("name = 'main'").select("file_path"))
    return n.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(e.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


_GRAPH = f"""WITH {SQL_FUNCTIONS}, fl AS (SELECT DISTINCT file_path FROM functions), dr AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS d FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(file_path, '/') AS p FROM fl) y) z), cl AS (SELECT DISTINCT file_path, parent_class FROM functions WHERE parent_class IS NOT NULL)"""


@q("GR21", f"{_GRAPH} SELECT 'Repository' AS kind, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'Directory', count(*) FROM dr UNION ALL SELECT 'File', count(*) FROM fl UNION ALL SELECT 'Class', count(*) FROM cl UNION ALL SELECT 'Function', count(*) FROM functions UNION ALL SELECT 'CONTAINS', (SELECT count(*) FROM dr) + (SELECT count(*) FROM fl) + (SELECT count(*) FROM cl) + (SELECT count(*) FROM functions) UNION ALL SELECT 'HAS_METHOD', count(*) FROM functions WHERE parent_class IS NOT NULL")
def gr21(spark, d):
    n, e = inc.assemble(materialize(functions(spark, d)))
    return n.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).unionByName(e.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")))


_BD = "b AS (SELECT rf_id, any_value(name) AS name, any_value(file_path) AS file_path, any_value(score) AS score, any_value(source) AS source, any_value(expand_level) AS expand_level, length(any_value(body)) AS size FROM retrieved_functions WHERE rf_id IS NOT NULL AND body IS NOT NULL AND file_path IS NOT NULL AND name IS NOT NULL GROUP BY rf_id)"
_LV = "CASE expand_level WHEN 'SIGNATURE' THEN 1 WHEN 'BODY' THEN 2 WHEN 'CLASS' THEN 3 WHEN 'FULL_FILE' THEN 4 ELSE 0 END"


def _bodies(spark, d):
    b = table(spark, d, "retrieved_functions").where("rf_id IS NOT NULL AND body IS NOT NULL AND file_path IS NOT NULL AND name IS NOT NULL").dropDuplicates(["rf_id"])
    return b.select("rf_id", "name", "file_path", "score", "source", "expand_level", F.length("body").alias("size"))


@q("AGT4", f"{_R}, s AS (SELECT DISTINCT result_id, u.name AS item, u.score FROM (SELECT result_id, unnest(rf) AS u FROM once) z WHERE u.name IS NOT NULL AND u.score IS NOT NULL), v AS (SELECT result_id, item FROM s WHERE score > 0.8) SELECT result_id, item, row_number() OVER (PARTITION BY result_id ORDER BY item) AS rank FROM (SELECT DISTINCT result_id, item FROM s EXCEPT SELECT result_id, item FROM v) z")
def agt4(spark, d):
    s = materialize(_ranked(spark, d).where("name IS NOT NULL AND score IS NOT NULL").select("result_id", F.col("name").alias("item"), "score"))
    return c.frontier(s, s.where("score > 0.8"), "result_id")


@q("AGT7", f"WITH {_BD}, k AS (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY {_LV} DESC, score DESC NULLS LAST, rf_id) AS r FROM b) SELECT file_path, name, rf_id, expand_level FROM k WHERE r = 1")
def agt7(spark, d):
    return c.widest(_bodies(spark, d), ["file_path", "name"]).select("file_path", "name", "rf_id", "expand_level")


@q("AGT8", f"WITH {_BD} SELECT rf_id, CAST(used AS BIGINT) AS used FROM (SELECT rf_id, sum(size) OVER (PARTITION BY file_path ORDER BY CASE WHEN name = 'main' THEN 1 ELSE 0 END DESC, score DESC NULLS LAST, rf_id ROWS UNBOUNDED PRECEDING) AS used FROM b) z WHERE used <= 8000")
def agt8(spark, d):
    first = F.when(F.col("name") == "main", 1).otherwise(0)
    return c.context(_bodies(spark, d), "file_path", 10_000, first).select("rf_id", "used")


@q("AGT9", f"WITH {_BD}, o AS (SELECT file_path, CASE WHEN score > 0.5 THEN 'high' ELSE source END AS bucket, name, max(score) AS score FROM b GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY file_path, bucket ORDER BY score DESC NULLS LAST, name) AS r FROM o) SELECT file_path, bucket, name FROM k WHERE r <= CASE bucket WHEN 'high' THEN 5 WHEN 'embedding' THEN 5 WHEN 'grep' THEN 3 WHEN 'graph' THEN 10 WHEN 'call_chain' THEN 5 ELSE 3 END")
def agt9(spark, d):
    return c.bucketed(_bodies(spark, d), "file_path").select("file_path", "bucket", "name")


@q("AGT10", f"WITH {_BD}, x AS (SELECT file_path, rf_id, sum(size) OVER (PARTITION BY file_path) AS total, sum(size) OVER (PARTITION BY file_path ORDER BY score DESC NULLS LAST, rf_id ROWS UNBOUNDED PRECEDING) AS used FROM b) SELECT file_path, total <= 5000 AS whole, rf_id FROM x WHERE total <= 5000 OR used <= 5000")
def agt10(spark, d):
    return c.whole_or_best(_bodies(spark, d), 5000)


@q("AGT13", "SELECT DISTINCT result_id, 'Q: ' || coalesce(question, '') || chr(10) || 'A: ' || coalesce(answer, '') AS prompt FROM qa_results")
def agt13(spark, d):
    p = c.render("Q: {question}\nA: {answer}", {"question": F.col("question"), "answer": F.col("answer")})
    return table(spark, d, "qa_results").select("result_id", p.alias("prompt")).distinct()


@q("ST1", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st1(spark, d):
    from codequarry.streaming.events import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
