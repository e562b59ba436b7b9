"""Queries AG5-AG28, WN1-WN9, TK1-TK8 and SET1-SET6."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import aggregates as a
from codequarry.operators import graph as g
from codequarry.operators import windows as w
from codequarry.plans.filters import _DEG
from codequarry.plans.fixtures import SQL_CALLS, SQL_FUNCTIONS, SQL_LINES, SQL_NODES, calls, functions, lines, nodes
from codequarry.session import materialize, table

QUERIES: dict = {}
ORACLE: dict = {}
_W = f"WITH {SQL_FUNCTIONS}"
_RK = """once AS (SELECT result_id, any_value(retrieved_functions) AS rf, any_value(question) AS question, any_value(answer) AS answer, any_value(error) AS error, any_value(qa_id) AS qa_id,
  any_value(total_latency_ms) AS total_latency_ms, any_value(latency_ms) AS latency_ms, any_value(total_tokens) AS total_tokens FROM qa_results WHERE result_id IS NOT NULL GROUP BY result_id),
  ranked AS (SELECT result_id, u.name, u.file_path, u.score, u.source, row_number() OVER (PARTITION BY result_id ORDER BY u.score DESC NULLS LAST, u.file_path NULLS LAST, u.name NULLS LAST) AS rank
  FROM (SELECT result_id, unnest(rf) AS u FROM once) z)"""
_R = f"WITH {_RK}"
def gold():
    return F.col("source") == "grep"



def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _once(spark, d):
    return table(spark, d, "qa_results").where("result_id IS NOT NULL").dropDuplicates(["result_id"])


def _ranked(spark, d):
    return a.ranked(table(spark, d, "qa_results"))


@q("AG5", f"{_W} SELECT file_path, name, array_to_string(list_sort(list(DISTINCT start_line)), ',') AS lines FROM functions WHERE name IS NOT NULL AND start_line IS NOT NULL GROUP BY 1, 2")
def ag5(spark, d):
    fn = functions(spark, d).where("name IS NOT NULL AND start_line IS NOT NULL")
    return fn.groupBy("file_path", "name").agg(F.array_join(F.sort_array(F.collect_set("start_line")), ",").alias("lines"))


@q("AG7", f"""{_W}, n AS (SELECT file_path, string_agg(name, '|' ORDER BY name) AS names FROM (SELECT file_path, name, row_number() OVER (PARTITION BY file_path ORDER BY name) AS r FROM (SELECT DISTINCT file_path, name FROM functions WHERE name IS NOT NULL) y) z WHERE r <= 10 GROUP BY 1),
  c AS (SELECT file_path, count(*) AS functions, CAST(sum(coalesce(fan_in, 0)) AS BIGINT) AS fan_in, CAST(sum(coalesce(fan_out, 0)) AS BIGINT) AS fan_out FROM functions GROUP BY 1) SELECT c.*, names FROM c LEFT JOIN n USING (file_path) ORDER BY functions DESC, file_path LIMIT 30""")
def ag7(spark, d):
    fn = materialize(functions(spark, d))
    c = fn.groupBy("file_path").agg(F.count("*").alias("functions"), F.sum(F.coalesce("fan_in", F.lit(0))).alias("fan_in"), F.sum(F.coalesce("fan_out", F.lit(0))).alias("fan_out"))
    return c.join(a.top_list(fn, "file_path", "name", 10, "names"), "file_path", "left").orderBy(F.desc("functions"), "file_path").limit(30)


@q("AG8", f"WITH {SQL_CALLS} SELECT src AS name, string_agg(dst, '|' ORDER BY dst) AS callees FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM calls) z WHERE r <= 10 GROUP BY src")
def ag8(spark, d):
    return a.top_list(calls(spark, d), "src", "dst", 10, "callees").withColumnRenamed("src", "name")


@q("AG9", """WITH m AS (SELECT DISTINCT id, title, unnest(regexp_extract_all(body, '`([A-Za-z_][A-Za-z0-9_]*)`', 1)) AS name FROM issues WHERE body IS NOT NULL),
  t AS (SELECT name, string_agg(title, '|' ORDER BY title) AS titles FROM (SELECT name, title, row_number() OVER (PARTITION BY name ORDER BY title) AS r FROM (SELECT DISTINCT name, title FROM m WHERE title IS NOT NULL) y) z WHERE r <= 5 GROUP BY 1)
  SELECT name, count(DISTINCT id) AS issues, any_value(titles) AS titles FROM m LEFT JOIN t USING (name) GROUP BY name ORDER BY 2 DESC, name LIMIT 20""")
def ag9(spark, d):
    i = table(spark, d, "issues").where("body IS NOT NULL")
    m = materialize(i.select("id", "title", F.explode(F.expr("regexp_extract_all(body, '`([A-Za-z_][A-Za-z0-9_]*)`', 1)")).alias("name")).distinct())
    top = m.groupBy("name").agg(F.countDistinct("id").alias("issues")).orderBy(F.desc("issues"), "name").limit(20)
    return top.join(a.top_list(m, "name", "title", 5, "titles"), "name", "left")


@q("AG10", f"{_W} SELECT regexp_replace(file_path, '/[^/]*$', '') AS dir, count(*) AS functions, count(DISTINCT file_path) AS files, max(fan_in) AS most FROM functions GROUP BY 1")
def ag10(spark, d):
    fn = functions(spark, d)
    return fn.groupBy(F.regexp_replace("file_path", "/[^/]*$", "").alias("dir")).agg(F.count("*").alias("functions"), F.countDistinct("file_path").alias("files"), F.max("fan_in").alias("most"))


@q("AG11", f"""{_R}, gold AS (SELECT * FROM ranked, (VALUES (1), (2), (3)) AS t(k) WHERE source = 'grep'), per AS (SELECT k, result_id, count(*) AS n, sum(CASE WHEN rank <= k THEN 1 ELSE 0 END) AS found FROM gold GROUP BY 1, 2)
  SELECT k, round(sum(found) / sum(n), 6) AS recall, round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM per GROUP BY k""")
def ag11(spark, d):
    return a.recall_at(_ranked(spark, d), gold(), [1, 2, 3])


_COV = "cov AS (SELECT result_id, avg(CASE WHEN rank <= 2 THEN 1.0 ELSE 0.0 END) AS covered FROM ranked WHERE source = 'grep' GROUP BY 1)"


@q("AG12", f"{_R}, {_COV} SELECT round(avg(covered), 6) AS mean, count(*) FILTER (covered = 1) AS \"full\", count(*) FILTER (covered > 0 AND covered < 1) AS part, count(*) FILTER (covered = 0) AS zero FROM cov")
def ag12(spark, d):
    c = a.coverage(_ranked(spark, d), gold(), 2)
    return c.agg(F.round(F.avg("covered"), 6).alias("mean"), F.count_if(F.col("covered") == 1).alias("full"), F.count_if((F.col("covered") > 0) & (F.col("covered") < 1)).alias("part"), F.count_if(F.col("covered") == 0).alias("zero"))


@q("AG13", f"""{_R}, b AS (SELECT result_id, min(rank) AS r FROM ranked WHERE source = 'grep' GROUP BY 1) SELECT round(avg(r), 6) AS mean, round(avg(1.0 / r), 6) AS mrr, (SELECT r FROM (SELECT r, row_number() OVER (ORDER BY r) AS k FROM b) z WHERE k = (SELECT count(*) // 2 + 1 FROM b)) AS upper_median FROM b""")
def ag13(spark, d):
    b = materialize(_ranked(spark, d).where(gold()).groupBy("result_id").agg(F.min("rank").alias("r")))
    s = b.agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.avg(1 / F.col("r")), 6).alias("mrr"))
    return s.crossJoin(a.values_at(b, "r", {"upper_median": F.expr("n div 2 + 1")}))


@q("AG14", f"""{_R}, v AS (SELECT total_latency_ms AS v, row_number() OVER (ORDER BY total_latency_ms) AS k, count(*) OVER () AS n FROM once WHERE total_latency_ms IS NOT NULL)
  SELECT max(CASE WHEN k = greatest(1, n * 50 // 100) THEN v END) AS p50, max(CASE WHEN k = greatest(1, n * 95 // 100) THEN v END) AS p95 FROM v""")
def ag14(spark, d):
    return a.values_at(_once(spark, d), "total_latency_ms", {"p50": F.expr("greatest(1, n * 50 div 100)"), "p95": F.expr("greatest(1, n * 95 div 100)")})


@q("AG15", f"{_R} SELECT CASE WHEN score >= 0 AND score < 0.3 THEN 0 WHEN score >= 0.3 AND score < 0.5 THEN 1 WHEN score >= 0.5 AND score < 0.7 THEN 2 WHEN score >= 0.7 AND score <= 1 THEN 3 END AS bin, count(*) AS n FROM ranked GROUP BY 1")
def ag15(spark, d):
    return _ranked(spark, d).groupBy(a.bins("score", [0.0, 0.3, 0.5, 0.7, 1.0]).alias("bin")).agg(F.count("*").alias("n"))


@q("AG16", f"{_R} SELECT source, rank, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM ranked GROUP BY ROLLUP (source, rank)")
def ag16(spark, d):
    return _ranked(spark, d).rollup("source", "rank").agg(a.share(F.col("score") >= 0.5).alias("accuracy"), F.count("*").alias("n"))


@q("AG17", f"""{_R}, per AS (SELECT result_id, split_part(min(file_path), '/', 1) AS root, max(rank) AS depth, sum(CASE WHEN rank <= 2 THEN 1 ELSE 0 END) AS found, count(*) AS n FROM ranked WHERE source = 'grep' GROUP BY 1)
  SELECT root, depth, round(avg(found / n), 6) AS macro, round(sum(found) / sum(n), 6) AS micro FROM per GROUP BY GROUPING SETS ((root), (depth), ())""")
def ag17(spark, d):
    r = _ranked(spark, d).where(gold())
    per = r.groupBy("result_id").agg(F.split_part(F.min("file_path"), F.lit("/"), F.lit(1)).alias("root"), F.max("rank").alias("depth"), F.sum(F.when(F.col("rank") <= 2, 1).otherwise(0)).alias("found"), F.count("*").alias("n"))
    sets = [[F.col("root")], [F.col("depth")], []]
    return per.groupingSets(sets, "root", "depth").agg(F.round(F.avg(F.col("found") / F.col("n")), 6).alias("macro"), F.round(F.sum("found") / F.sum("n"), 6).alias("micro")).select("root", "depth", "macro", "micro")


_HITS = f"""{_W}, {_RK}, h AS (SELECT result_id, bool_or(file_path IN (SELECT file_path FROM functions)) AS file_hit, bool_or(concat(file_path, '#', name) IN (SELECT concat(file_path, '#', name) FROM functions WHERE name IS NOT NULL)) AS symbol_hit FROM ranked WHERE file_path IS NOT NULL AND name IS NOT NULL GROUP BY 1)"""


def _hits(spark, d):
    fn = functions(spark, d).where("name IS NOT NULL").select("file_path", "name").distinct()
    r = _ranked(spark, d).where("file_path IS NOT NULL AND name IS NOT NULL")
    r = r.join(functions(spark, d).select("file_path").distinct().withColumn("f", F.lit(1)), "file_path", "left").join(fn.withColumn("s", F.lit(1)), ["file_path", "name"], "left")
    return r.groupBy("result_id").agg(F.max(F.col("f").isNotNull()).alias("file_hit"), F.max(F.col("s").isNotNull()).alias("symbol_hit"))


@q("AG18", f"{_HITS} SELECT CASE WHEN symbol_hit THEN 'A' WHEN file_hit THEN 'B' ELSE 'C' END AS kind, count(*) AS n FROM h GROUP BY 1")
def ag18(spark, d):
    kind = F.when(F.col("symbol_hit"), "A").when(F.col("file_hit"), "B").otherwise("C")
    return _hits(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@q("AG19", f"{_R}, e AS (SELECT unnest(map_entries(total_tokens)) AS t FROM once) SELECT t.key AS kind, CAST(sum(t.value) AS BIGINT) AS tokens, count(*) AS n FROM e GROUP BY 1")
def ag19(spark, d):
    e = _once(spark, d).select(F.explode("total_tokens").alias("kind", "v"))
    return e.groupBy("kind").agg(F.sum("v").alias("tokens"), F.count("*").alias("n"))


_PATHS = "regexp_extract_all(answer, '[A-Za-z0-9_/]+/[A-Za-z0-9_]+[.](?:cpp|cc|cu|h|py)')"
_CITED = f"cited AS (SELECT DISTINCT result_id, unnest({_PATHS}) AS path FROM once WHERE answer IS NOT NULL)"


def _cited(spark, d):
    o = _once(spark, d).where("answer IS NOT NULL")
    return o.select("result_id", F.explode(F.expr("regexp_extract_all(answer, '[A-Za-z0-9_/]+/[A-Za-z0-9_]+[.](?:cpp|cc|cu|h|py)', 0)")).alias("path")).distinct()


@q("AG21", f"{_W}, {_RK}, {_CITED} SELECT path, count(*) AS n FROM cited WHERE path NOT IN (SELECT file_path FROM functions WHERE file_path IS NOT NULL) GROUP BY path ORDER BY n DESC, path LIMIT 15")
def ag21(spark, d):
    known = functions(spark, d).select(F.col("file_path").alias("path"))
    return _cited(spark, d).join(known, "path", "left_anti").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(15)


@q("AG22", f"{_R}, t AS (SELECT count(DISTINCT result_id) AS runs FROM ranked), p AS (SELECT result_id, name, min(rank) AS rank FROM ranked WHERE name IS NOT NULL GROUP BY 1, 2) SELECT name, round((sum(rank) + (runs - count(*)) * 6) / runs, 6) AS score FROM p, t GROUP BY name, runs")
def ag22(spark, d):
    r = materialize(_ranked(spark, d))
    runs = r.select("result_id").distinct().count()
    return a.missing_penalty_rank(r.where("name IS NOT NULL").groupBy("result_id", "name").agg(F.min("rank").alias("rank")), max(1, runs), 5)


@q("AG23", f"{_W} SELECT split_part(name, '_', 1) || '_' || split_part(name, '_', 2) AS family, split_part(file_path, '/', 1) AS module, count(*) AS n FROM functions WHERE name IS NOT NULL GROUP BY 1, 2")
def ag23(spark, d):
    p = lambda k: F.split_part("name", F.lit("_"), F.lit(k))
    fn = functions(spark, d).where("name IS NOT NULL")
    return fn.groupBy(F.concat(p(1), F.lit("_"), p(2)).alias("family"), F.split_part("file_path", F.lit("/"), F.lit(1)).alias("module")).agg(F.count("*").alias("n"))


@q("AG24", f"WITH {SQL_NODES}, {SQL_CALLS} SELECT 'functions' AS what, count(*) AS n FROM functions UNION ALL SELECT 'files', count(DISTINCT file_path) FROM functions UNION ALL SELECT 'classes', count(DISTINCT parent_class) FROM functions UNION ALL SELECT 'calls', count(*) FROM calls")
def ag24(spark, d):
    fn = functions(spark, d)
    one = fn.agg(F.count("*").alias("functions"), F.countDistinct("file_path").alias("files"), F.countDistinct("parent_class").alias("classes"))
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in one.columns])).alias("x")).select("x.what", "x.n")
    return long.unionByName(calls(spark, d).agg(F.count("*").alias("n")).select(F.lit("calls").alias("what"), "n"))


@q("AG26", f"{_HITS} SELECT round(avg(CASE WHEN symbol_hit THEN 1.0 ELSE 0.0 END), 6) AS symbol_rate, round(avg(CASE WHEN file_hit THEN 1.0 ELSE 0.0 END), 6) AS file_rate FROM h")
def ag26(spark, d):
    return _hits(spark, d).agg(a.share(F.col("symbol_hit")).alias("symbol_rate"), a.share(F.col("file_hit")).alias("file_rate"))


@q("AG27", f"{_R} SELECT coalesce(len(rf), 0) AS steps, count(*) AS n, round(avg(latency_ms), 4) AS mean, min(latency_ms) AS least, max(latency_ms) AS most FROM once GROUP BY 1")
def ag27(spark, d):
    steps = F.coalesce(F.array_size("retrieved_functions"), F.lit(0))
    return _once(spark, d).groupBy(steps.alias("steps")).agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean"), F.min("latency_ms").alias("least"), F.max("latency_ms").alias("most"))


@q("AG28", f"{_R}, {_COV} SELECT result_id, round(covered * 100, 4) AS percent FROM cov WHERE covered < 0.5")
def ag28(spark, d):
    return a.coverage(_ranked(spark, d), gold(), 2).where("covered < 0.5").select("result_id", F.round(F.col("covered") * 100, 4).alias("percent"))


_ND = f"WITH {SQL_NODES}, {SQL_CALLS}, {_DEG}, x AS (SELECT name, regexp_replace(file_path, '/[^/]*$', '') AS dir, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (name))"


@q("WN1", f"{_ND} SELECT dir, name FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY degree DESC, name) AS r FROM x) z WHERE r <= 2")
def wn1(spark, d):
    x = nodes(spark, d).withColumn("dir", F.regexp_replace("file_path", "/[^/]*$", "")).join(g.degrees(calls(spark, d)), "name", "left").na.fill(0, ["degree"])
    return w.top_per_group(x, ["dir"], [F.desc("degree"), "name"], 2).select("dir", "name")


_CH = f"{_R}, ch AS (SELECT question AS qn, u.file_path AS file_path, u.name AS name, max(u.score) AS score FROM (SELECT question, unnest(rf) AS u FROM once) z WHERE u.file_path IS NOT NULL AND u.name IS NOT NULL AND u.score IS NOT NULL AND question IS NOT NULL GROUP BY 1, 2, 3)"


def _chunks(spark, d):
    e = _once(spark, d).where("question IS NOT NULL").select(F.col("question").alias("qn"), F.explode("retrieved_functions").alias("u"))
    e = e.where("u.file_path IS NOT NULL AND u.name IS NOT NULL AND u.score IS NOT NULL")
    return e.groupBy("qn", F.col("u.file_path").alias("file_path"), F.col("u.name").alias("name")).agg(F.max("u.score").alias("score"))


_TWO = """f AS (SELECT qn, file_path, row_number() OVER (PARTITION BY qn ORDER BY max(score) DESC, file_path) AS r FROM ch GROUP BY 1, 2),
  t AS (SELECT ch.*, row_number() OVER (PARTITION BY ch.qn, ch.file_path ORDER BY score DESC, name) AS rr FROM ch JOIN f ON f.qn = ch.qn AND f.file_path = ch.file_path WHERE f.r <= 3)"""


@q("WN2", f"{_CH}, {_TWO} SELECT qn, file_path, name, score FROM t WHERE rr <= 2")
def wn2(spark, d):
    return w.two_stage(materialize(_chunks(spark, d)), "qn", 3, 2).select("qn", "file_path", "name", "score")


@q("WN3", f"{_W} SELECT file_path, id FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS r FROM functions) z WHERE r = 1")
def wn3(spark, d):
    # a first row is an aggregate, so it combines before the shuffle
    first = F.min(F.struct(F.col("start_line"), F.col("id"))).alias("f")
    return functions(spark, d).groupBy("file_path").agg(first).select("file_path", "f.id")


@q("WN4", f"{_R} SELECT result_id, split_part(file_path, '/', 1) AS root, min(rank) AS best FROM ranked WHERE file_path IS NOT NULL GROUP BY 1, 2")
def wn4(spark, d):
    r = _ranked(spark, d).where("file_path IS NOT NULL")
    return r.groupBy("result_id", F.split_part("file_path", F.lit("/"), F.lit(1)).alias("root")).agg(F.min("rank").alias("best"))


@q("WN5", f"{_W}, c AS (SELECT file_path, count(*) AS n FROM functions GROUP BY 1) SELECT file_path, n, CAST(coalesce(sum(n) OVER (ORDER BY file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c")
def wn5(spark, d):
    return w.offsets(functions(spark, d).groupBy("file_path").agg(F.count("*").alias("n")), "file_path", "n")


_BODIES = "b AS (SELECT rf_id, any_value(file_path) AS file_path, any_value(score) AS score, length(any_value(body)) AS size FROM retrieved_functions WHERE rf_id IS NOT NULL AND body IS NOT NULL AND file_path IS NOT NULL GROUP BY rf_id)"


@q("WN6", f"WITH {_BODIES} SELECT rf_id, CAST(used AS BIGINT) AS used FROM (SELECT rf_id, sum(size) OVER (PARTITION BY file_path ORDER BY score DESC NULLS LAST, rf_id ROWS UNBOUNDED PRECEDING) AS used FROM b) z WHERE used <= 3000")
def wn6(spark, d):
    b = table(spark, d, "retrieved_functions").where("rf_id IS NOT NULL AND body IS NOT NULL AND file_path IS NOT NULL").dropDuplicates(["rf_id"])
    b = b.select("rf_id", "file_path", "score", F.length("body").alias("size"))
    return w.pack(b, "file_path", [F.desc_nulls_last("score"), "rf_id"], "size", 3000).select("rf_id", "used")


@q("WN7", f"""{_R}, s AS (SELECT qa_id, result_id AS step, u.name AS item FROM (SELECT qa_id, result_id, unnest(rf) AS u FROM once WHERE qa_id IS NOT NULL) z WHERE u.name IS NOT NULL),
  g AS (SELECT qa_id, step, count(*) AS g FROM (SELECT qa_id, item, min(step) AS step FROM s GROUP BY 1, 2) y GROUP BY 1, 2), e AS (SELECT qa_id, step, coalesce(g, 0) AS gain FROM (SELECT DISTINCT qa_id, step FROM s) x LEFT JOIN g USING (qa_id, step)),
  l AS (SELECT *, lag(gain) OVER w AS pg, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY qa_id ORDER BY step)) SELECT qa_id, step, gain, coalesce(r >= 3 AND greatest(gain, pg) <= 1, false) AS stop FROM l""")
def wn7(spark, d):
    o = _once(spark, d).where("qa_id IS NOT NULL").select("qa_id", F.col("result_id").alias("step"), F.explode("retrieved_functions.name").alias("item"))
    return w.information_gain(materialize(o.where("item IS NOT NULL")), "qa_id")


@q("WN8", f"{_W} SELECT id, near FROM (SELECT a.id, b.id AS near, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.start_line - b.start_line), b.id) AS r FROM functions a JOIN functions b ON a.file_path = b.file_path AND a.id <> b.id WHERE a.name = 'apply') z WHERE r = 1")
def wn8(spark, d):
    fn = functions(spark, d)
    return g.same_file_neighbours(fn, fn.where("name = 'apply'"), 1).select(F.col("target").alias("id"), F.col("id").alias("near"))


@q("WN9", f"WITH {SQL_LINES}, h AS (SELECT rf_id, line_no AS hit FROM lines WHERE contains(text, 'nullptr')) SELECT h.rf_id, hit, line_no, text FROM h JOIN lines l ON l.rf_id = h.rf_id AND l.line_no BETWEEN hit - 2 AND hit + 2")
def wn9(spark, d):
    ln = materialize(lines(spark, d))
    return w.with_context(ln, ln.where(F.col("text").contains("nullptr")), 2).select("rf_id", "hit", "line_no", "text")


@q("TK1", f"{_R} SELECT result_id, name, score FROM ranked WHERE rank <= 2")
def tk1(spark, d):
    return _ranked(spark, d).where("rank <= 2").select("result_id", "name", "score")


@q("TK4", "SELECT file_path, max(retrieved_at) AS newest FROM retrieved_functions WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 50")
def tk4(spark, d):
    t = table(spark, d, "retrieved_functions").where("file_path IS NOT NULL").groupBy("file_path").agg(F.max("retrieved_at").alias("newest"))
    return t.orderBy(F.desc_nulls_last("newest"), "file_path").limit(50)


@q("TK5", f"{_W} SELECT id FROM functions ORDER BY id LIMIT 25 OFFSET 50")
def tk5(spark, d):
    return functions(spark, d).select("id").orderBy("id").offset(50).limit(25)


@q("TK7", f"{_R}, s AS (SELECT name, round(sum(score) - 2, 6) AS score FROM ranked WHERE name IS NOT NULL GROUP BY 1) SELECT name, score FROM s WHERE score > 0 ORDER BY score DESC, name LIMIT 40")
def tk7(spark, d):
    s = _ranked(spark, d).where("name IS NOT NULL").groupBy("name").agg(F.round(F.sum("score") - 2, 6).alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "name").limit(40)


@q("TK8", f"{_W} SELECT id FROM functions ORDER BY CASE WHEN name = 'main' THEN 0 ELSE 1 END, id LIMIT 100")
def tk8(spark, d):
    return functions(spark, d).orderBy(F.when(F.col("name") == "main", 0).otherwise(1), "id").limit(100).select("id")


@q("SET1", f"""{_ND}, a AS (SELECT name FROM x ORDER BY degree DESC, name LIMIT 200), b AS (SELECT name FROM nodes WHERE starts_with(name, 'parse_') OR starts_with(name, 'init'))
  SELECT (SELECT count(*) FROM (SELECT name FROM a UNION SELECT name FROM b) u) AS every, (SELECT count(*) FROM (SELECT name FROM a INTERSECT SELECT name FROM b) u) AS both_, (SELECT count(*) FROM (SELECT name FROM a EXCEPT SELECT name FROM b) u) AS only_a""")
def set1(spark, d):
    n = materialize(nodes(spark, d))
    x = n.join(g.degrees(calls(spark, d)), "name", "left").na.fill(0, ["degree"])
    p = x.orderBy(F.desc("degree"), "name").limit(200).select("name", F.lit(1).alias("a"), F.lit(0).alias("b"))
    r = n.where(F.col("name").startswith("parse_") | F.col("name").startswith("init")).select("name", F.lit(0).alias("a"), F.lit(1).alias("b"))
    u = p.unionByName(r).groupBy("name").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return u.agg(F.count("*").alias("every"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both_"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"))


_AB = f"{_R}, s AS (SELECT result_id, list_distinct(list_transform(rf, lambda x: x.file_path)) AS files, list_distinct(regexp_extract_all(question || ' ' || coalesce(answer, ''), '[A-Za-z0-9_/]+/[A-Za-z0-9_]+[.](?:cpp|cc|cu|h|py)')) AS said FROM once WHERE question IS NOT NULL AND rf IS NOT NULL)"


def _sets(spark, d):
    o = _once(spark, d).where("question IS NOT NULL AND retrieved_functions IS NOT NULL")
    said = F.expr("array_distinct(regexp_extract_all(concat(question, ' ', coalesce(answer, '')), '[A-Za-z0-9_/]+/[A-Za-z0-9_]+[.](?:cpp|cc|cu|h|py)', 0))")
    return o.select("result_id", F.array_compact(F.array_distinct("retrieved_functions.file_path")).alias("files"), said.alias("said"))


@q("SET2", f"{_AB} SELECT result_id, round(CASE WHEN len(said) > 0 THEN len(list_intersect(said, files)) / len(said) ELSE 0 END, 6) AS covered FROM s")
def set2(spark, d):
    s = _sets(spark, d)
    return s.select("result_id", F.round(F.when(F.size("said") > 0, F.size(F.array_intersect("said", "files")) / F.size("said")).otherwise(0.0), 6).alias("covered"))


@q("SET6", f"{_AB} SELECT result_id, round(len(list_intersect(said, files)) / greatest(1, len(list_distinct(list_concat(said, files)))), 6) AS jaccard FROM s")
def set6(spark, d):
    s = _sets(spark, d)
    return s.select("result_id", F.round(F.size(F.array_intersect("said", "files")) / F.greatest(F.lit(1), F.size(F.array_union("said", "files"))), 6).alias("jaccard"))


@q("SET3", "SELECT count(*) AS affected FROM (SELECT file_path FROM function_nodes WHERE extracted_at >= TIMESTAMP '2025-01-01' UNION SELECT f.file_path FROM function_nodes f JOIN (SELECT DISTINCT name FROM function_nodes WHERE extracted_at >= TIMESTAMP '2026-01-01') c ON c.name = f.name) z")
def set3(spark, d):
    f = table(spark, d, "function_nodes")
    changed = f.where("extracted_at >= timestamp_ntz'2025-01-01'").select("file_path")
    names = f.where("extracted_at >= timestamp_ntz'2026-01-01'").select("name").distinct()
    return changed.union(f.join(names, "name", "left_semi").select("file_path")).distinct().agg(F.count("*").alias("affected"))


@q("SET4", f"WITH {SQL_CALLS} SELECT dst AS name FROM (SELECT dst FROM calls WHERE src IN ('init', 'run') UNION SELECT src FROM calls WHERE dst = 'main') z WHERE dst NOT IN ('init', 'run', 'main')")
def set4(spark, d):
    c = calls(spark, d)
    f = c.where(F.col("src").isin("init", "run")).select(F.col("dst").alias("name")).union(c.where("dst = 'main'").select("src")).distinct()
    return f.where(~F.col("name").isin("init", "run", "main"))


@q("SET5", f"{_R} SELECT result_id, len(list_distinct(list_transform(rf, lambda x: x.name))) AS n FROM once WHERE rf IS NOT NULL")
def set5(spark, d):
    o = _once(spark, d).where("retrieved_functions IS NOT NULL")
    return o.select("result_id", F.size(F.array_compact(F.array_distinct("retrieved_functions.name"))).alias("n"))


@q("SET7", f"WITH RECURSIVE {SQL_NODES}, {SQL_CALLS}, h AS (SELECT name, 0 AS hop FROM nodes WHERE starts_with(name, 'parse_') UNION SELECT dst, hop + 1 FROM h JOIN calls ON src = name WHERE hop < 4) SELECT DISTINCT name FROM h")
def set7(spark, d):
    n = nodes(spark, d).where(F.col("name").startswith("parse_")).select(F.col("name").alias("seed"))
    return g.k_hop(calls(spark, d), n, 4).select("name").distinct()
