"""Queries on recorded agent steps, searches in several modes, admission and modules' representatives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.functions import text as t
from codequarry.operators import context as c
from codequarry.operators import filters as f
from codequarry.operators import graph as g
from codequarry.operators import joins as j
from codequarry.operators import retrieval as r
from codequarry.operators.hotkeys import latest_where_repeated
from codequarry.plans import retrievals
from codequarry.plans.filters import _DEG
from codequarry.plans.fixtures import SQL_CALLS, SQL_FUNCTIONS, SQL_LINES, SQL_NODES, calls, functions, lines, nodes
from codequarry.plans.metrics import _R, _once, _ranked
from codequarry.plans.retrievals import _KW, _questions
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


# --- admission of issues by rules and their score: labels and limits are parameters, taken from these tables ---------------

_TIERS = [("first", ["bug", "regression", "performance"]), ("second", ["server", "build"])]
_SKIPPED = ["stale", "question"]
_NEWEST = "i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, state DESC NULLS LAST) AS r FROM issues WHERE id IS NOT NULL) z WHERE r = 1)"
_SIGNS = """s AS (SELECT *, coalesce(regexp_matches(body, '\\b[0-9a-f]{7,40}\\b'), false) AS has_commit, coalesce(regexp_matches(body, '(?i)\\b[\\w/.-]+\\.(c|cpp|h|cc|cxx|hpp)(\\b|:\\d+)'), false) AS has_path, coalesce(regexp_matches(body, '\\b([a-zA-Z_][a-zA-Z0-9_]{2,30})\\s*\\('), false) AS has_call,
  CASE WHEN list_has_any(coalesce(labels, []), ['bug', 'regression', 'performance']) THEN 'first' WHEN list_has_any(coalesce(labels, []), ['server', 'build']) THEN 'second' ELSE 'third' END AS tier FROM i)"""
_REASON = """re AS (SELECT *, CASE WHEN coalesce(state_reason, '') NOT IN ('completed', 'not_planned', '') OR state <> 'closed' THEN 'not_closed' WHEN list_has_any(coalesce(labels, []), ['stale', 'question']) THEN 'skipped_label' WHEN created_at < TIMESTAMP '2022-01-01' THEN 'too_old'
  WHEN tier = 'first' AND NOT (has_commit OR has_path) THEN 'first_no_code' WHEN tier = 'second' AND NOT (has_commit OR has_path) THEN 'second_no_code' WHEN tier = 'second' AND coalesce(comments, 0) < 1 THEN 'second_no_comments' ELSE 'passed' END AS reason FROM s)"""
_WORDSET = r"list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}_]+'), lambda x: x <> ''))"
_DUP = f"""ca AS (SELECT id, title, coalesce(comments, 0) AS n, {_WORDSET} AS w FROM re WHERE reason = 'passed' AND title IS NOT NULL),
  du AS (SELECT DISTINCT a.id FROM ca a JOIN ca b ON (b.n > a.n OR (b.n = a.n AND b.id < a.id)) AND (a.title = b.title OR (len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) * 20 > (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 17)))"""


def _admission(spark, d):
    newest = Window.partitionBy("id").orderBy(F.desc_nulls_last("fetched_at"), F.desc_nulls_last("state"))
    i = table(spark, d, "issues").where("id IS NOT NULL").withColumn("r", F.row_number().over(newest)).where("r = 1")
    s = i.withColumns({"x": t.code_signals(F.col("body")), "tier": t.label_tier(F.col("labels"), _TIERS, "third")})
    code = F.col("x.commit") | F.col("x.path")
    rules = [
        ("not_closed", ~F.coalesce("state_reason", F.lit("")).isin("completed", "not_planned", "") | (F.col("state") != "closed")),
        ("skipped_label", F.arrays_overlap(F.coalesce("labels", F.array().cast("array<string>")), F.array(*map(F.lit, _SKIPPED)))), ("too_old", F.col("created_at") < F.lit("2022-01-01").cast("timestamp_ntz")),
        ("first_no_code", (F.col("tier") == "first") & ~code), ("second_no_code", (F.col("tier") == "second") & ~code), ("second_no_comments", (F.col("tier") == "second") & (F.coalesce("comments", F.lit(0)) < 1)),
    ]
    s = materialize(s.select("id", "title", "labels", "created_at", "tier", "x", F.coalesce("comments", F.lit(0)).alias("n"), f.first_reason(rules).alias("reason")))
    kept = s.where("reason = 'passed'")
    double = f.best_of_similar(kept, j.similar_titles(kept), "title", "n", "id")
    return s.join(double.withColumn("dup", F.lit(True)), "id", "left").withColumn("reason", F.when(F.col("dup"), "duplicate").otherwise(F.col("reason")))


@q("FLT16", f"WITH {_NEWEST}, {_SIGNS}, {_REASON}, {_DUP} SELECT id, CASE WHEN id IN (SELECT id FROM du) THEN 'duplicate' ELSE reason END AS reason FROM re")
def flt16(spark, d):
    return _admission(spark, d).select("id", "reason")


@q("AG25", f"WITH {_NEWEST}, {_SIGNS}, {_REASON}, {_DUP} SELECT CASE WHEN id IN (SELECT id FROM du) THEN 'duplicate' ELSE reason END AS reason, count(*) AS n FROM re GROUP BY 1")
def ag25(spark, d):
    return _admission(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


_SCORE = """least(1.0, CASE tier WHEN 'first' THEN 1.0 WHEN 'second' THEN 0.7 ELSE 0.3 END * CASE WHEN created_at IS NULL THEN 0.5 WHEN created_at >= TIMESTAMP '2024-01-01' THEN 1.0 WHEN created_at >= TIMESTAMP '2023-01-01' THEN 0.7 ELSE 0.3 END
  * CASE WHEN list_contains(coalesce(labels, []), 'stale') THEN 0.2 ELSE 1.0 END * (1.0 + CASE WHEN has_commit THEN 0.3 WHEN has_path THEN 0.15 ELSE 0.0 END + CASE WHEN has_call THEN 0.1 ELSE 0.0 END))"""


def _score():
    weight = F.when(F.col("tier") == "first", 1.0).when(F.col("tier") == "second", 0.7).otherwise(0.3)
    bonus = F.when(F.col("x.commit"), 0.3).when(F.col("x.path"), 0.15).otherwise(0.0) + F.when(F.col("x.call"), 0.1).otherwise(0.0)
    stale = F.coalesce(F.array_contains("labels", "stale"), F.lit(False))
    return t.ranking_score(weight, F.col("created_at"), [("2024-01-01", 1.0), ("2023-01-01", 0.7)], 0.3, 0.5, stale, 0.2, bonus)


@q("TX20", f"WITH {_NEWEST}, {_SIGNS} SELECT id, tier, round({_SCORE}, 6) AS score FROM s")
def tx20(spark, d):
    return _admission(spark, d).select("id", "tier", F.round(_score(), 6).alias("score"))


@q("RT8", f"""WITH {_NEWEST}, {_SIGNS}, {_KW}, a AS (SELECT DISTINCT question, lower(unnest((list_concat(list_reverse(list_filter(w, lambda x: contains(x, '_') OR regexp_matches(substr(x, 2), '[A-Z]'))), list_filter(w, lambda x: NOT (contains(x, '_') OR regexp_matches(substr(x, 2), '[A-Z]')))))[1:3])) AS word FROM kq),
  h AS (SELECT id, round({_SCORE}, 6) AS f, list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), substr(coalesce(body, ''), 1, 500))), '[a-z0-9_]+'), lambda x: length(x) > 1)) AS w FROM s),
  e AS (SELECT DISTINCT word, id, round(f / n, 6) AS score FROM (SELECT id, f, len(w) AS n, unnest(w) AS word FROM h) z WHERE word IN (SELECT word FROM a)), k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, id) AS r FROM e)
  SELECT question, id, max(score) AS score FROM a JOIN k USING (word) WHERE r <= 3 GROUP BY 1, 2""")
def rt8(spark, d):
    i = table(spark, d, "issues").where("id IS NOT NULL").groupBy("id").agg(F.max_by("body", "fetched_at").alias("body"))
    s = materialize(_admission(spark, d).select("id", "title", F.round(_score(), 6).alias("f")).join(i, "id"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("body", F.lit("")), 1, 500))
    return r.keyword_issues(_questions(spark, d), s, "id", text, F.col("f"))


# --- searches and chunks ------------------------------------------------------------------------------------------------------

_HITS = "hits AS (SELECT rf_id, file_path, line_no FROM lines WHERE regexp_matches(text, '(?i)mutex.*guard|too large: [0-9]+'))"


@q("RT1", f"""WITH {SQL_LINES}, {_HITS}, p AS (SELECT file_path, count(*) AS n FROM hits GROUP BY 1) SELECT 'content' AS mode, l.rf_id, l.line_no, CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.rf_id = l.rf_id AND h.line_no = l.line_no) THEN 'match' ELSE 'context' END AS kind, substr(l.text, 1, 60) AS text, NULL AS n
  FROM lines l WHERE EXISTS (SELECT 1 FROM hits h WHERE h.rf_id = l.rf_id AND abs(h.line_no - l.line_no) <= 2) UNION ALL SELECT 'files', NULL, NULL, NULL, file_path, NULL FROM p UNION ALL SELECT 'count', NULL, NULL, NULL, file_path, n FROM p""")
def rt1(spark, d):
    ln = lines(spark, d)
    hits = materialize(r.grep(ln, "mutex.*guard|too large: [0-9]+"))
    return r.grep_modes(hits, ln, 2, 60)


_CHUNKS = f"""WITH {SQL_FUNCTIONS} SELECT DISTINCT concat('func::', name, '::', file_path, ':', start_line) AS id, 'function' AS type, substr(concat('Function: ', name, chr(10), 'File: ', file_path, chr(10), 'Signature: ', coalesce(signature, '')), 1, 600) AS text FROM functions WHERE name IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL
  UNION ALL SELECT DISTINCT concat('issue::', id), 'issue', substr(concat('Issue #', number, ': ', title, chr(10), substr(coalesce(body, ''), 1, 300)), 1, 600) FROM issues WHERE id IS NOT NULL AND number % 2 = 1 AND title IS NOT NULL
  UNION ALL SELECT DISTINCT concat('pr::', id), 'pr', substr(concat('PR #', number, ': ', title, chr(10), substr(coalesce(body, ''), 1, 200)), 1, 600) FROM issues WHERE id IS NOT NULL AND number % 2 = 0 AND title IS NOT NULL"""


@q("RT15", _CHUNKS)
def rt15(spark, d):
    fn = functions(spark, d).where("name IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL")
    head = F.concat(F.lit("Function: "), "name", F.lit("\nFile: "), "file_path", F.lit("\nSignature: "), F.coalesce("signature", F.lit("")))
    out = fn.select(F.concat(F.lit("func::"), "name", F.lit("::"), "file_path", F.lit(":"), "start_line").alias("id"), F.lit("function").alias("type"), F.substring(head, 1, 600).alias("text")).distinct()
    i = table(spark, d, "issues").where("id IS NOT NULL AND title IS NOT NULL")
    for kind, word, odd, most in (("issue", "Issue", 1, 300), ("pr", "PR", 0, 200)):
        text = F.concat(F.lit(f"{word} #"), "number", F.lit(": "), "title", F.lit("\n"), F.substring(F.coalesce("body", F.lit("")), 1, most))
        part = i.where(F.col("number") % 2 == odd).select(F.concat(F.lit(f"{kind}::"), "id").alias("id"), F.lit(kind).alias("type"), F.substring(text, 1, 600).alias("text"))
        out = out.unionByName(part.distinct())
    return out


# --- recorded steps: the runs of one question, each with an action and a target ------------------------------------------------

_STEPS = f"""{_R}, st AS (SELECT qa_id, row_number() OVER (PARTITION BY qa_id ORDER BY result_id) AS step, CASE WHEN result_id % 4 = 0 THEN 'grep_search' WHEN result_id % 4 = 1 THEN 'expand_callers' ELSE 'expand_callees' END AS action, coalesce(rf[1].name, '') AS target, rf FROM once WHERE qa_id IS NOT NULL)"""


def _steps(spark, d):
    kind = F.when(F.col("result_id") % 4 == 0, "grep_search").when(F.col("result_id") % 4 == 1, "expand_callers").otherwise("expand_callees")
    step = F.row_number().over(Window.partitionBy("qa_id").orderBy("result_id"))
    # numbered before the names are listed
    o = _once(spark, d).where("qa_id IS NOT NULL").withColumn("step", step)
    s = o.select("qa_id", "step", kind.alias("action"), F.coalesce(F.try_element_at("retrieved_functions", F.lit(1))["name"], F.lit("")).alias("target"), F.explode_outer("retrieved_functions").alias("u"))
    return materialize(s.select("qa_id", "step", "action", "target", F.col("u.name").alias("name"), F.col("u.score").alias("score")))


@q("AGT1", f"""{_STEPS}, tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qa_id, action, target ORDER BY step) AS a FROM st WHERE step < 5) z WHERE a = 1 OR action = 'grep_search'),
  nm AS (SELECT qa_id, name, min(step) AS step FROM (SELECT qa_id, step, unnest(rf).name AS name FROM tk) z WHERE name IS NOT NULL GROUP BY 1, 2), ga AS (SELECT tk.qa_id, tk.step, action, target, coalesce(n, 0) AS gain FROM tk LEFT JOIN (SELECT qa_id, step, count(*) AS n FROM nm GROUP BY 1, 2) y USING (qa_id, step)),
  en AS (SELECT *, coalesce(step >= 3 AND gain <= 1 AND lag(gain) OVER (PARTITION BY qa_id ORDER BY step) <= 1, false) AS ends FROM ga), fi AS (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY qa_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_ FROM en)
  SELECT qa_id, step, action, target, gain FROM fi WHERE NOT over_""")
def agt1(spark, d):
    return c.agent_loop(_steps(spark, d), "qa_id")


_ACTS = "ac AS (SELECT DISTINCT CASE length(name) % 4 WHEN 0 THEN 'expand_callers' WHEN 1 THEN 'expand_callees' WHEN 2 THEN 'expand_same_file' ELSE 'expand_same_class' END AS action, name AS target FROM nodes WHERE starts_with(name, 'parse_'))"


@q("AGT2", f"""WITH {SQL_NODES}, {SQL_CALLS}, {_ACTS}, own AS (SELECT DISTINCT name, file_path, parent_class FROM functions WHERE name IS NOT NULL),
  fo AS (SELECT action, target, src AS name, n.file_path FROM ac JOIN calls ON dst = target JOIN nodes n ON n.name = src WHERE action = 'expand_callers' UNION ALL SELECT action, target, dst, n.file_path FROM ac JOIN calls ON src = target JOIN nodes n ON n.name = dst WHERE action = 'expand_callees'
   UNION ALL SELECT action, target, b.name, min(b.file_path) FROM ac JOIN own a ON a.name = target JOIN own b ON b.file_path = a.file_path AND b.name <> target WHERE action = 'expand_same_file' GROUP BY 1, 2, 3
   UNION ALL SELECT action, target, b.name, min(b.file_path) FROM ac JOIN own a ON a.name = target JOIN own b ON b.parent_class = a.parent_class AND b.name <> target WHERE action = 'expand_same_class' GROUP BY 1, 2, 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY action, target ORDER BY name) AS r FROM fo)
  SELECT action, target, name, file_path, CASE action WHEN 'expand_callers' THEN 'caller' WHEN 'expand_callees' THEN 'callee' ELSE replace(action, 'expand_', '') END || '_of_' || target AS source FROM k WHERE r <= 10""")
def agt2(spark, d):
    n = nodes(spark, d).where(F.col("name").startswith("parse_"))
    m = F.length("name") % 4
    kind = F.when(m == 0, "expand_callers").when(m == 1, "expand_callees").when(m == 2, "expand_same_file").otherwise("expand_same_class")
    fn = materialize(functions(spark, d).select("name", "file_path", "parent_class"))
    return c.run_actions(n.select(kind.alias("action"), F.col("name").alias("target")), materialize(calls(spark, d)), fn)


@q("AGT3", f"""{_STEPS}, o AS (SELECT qa_id, step, i - 1 AS pos, rf[i].name AS item, rf[i].score AS score FROM (SELECT qa_id, step, rf, unnest(range(1, len(rf) + 1)) AS i FROM st) z), v AS (SELECT DISTINCT qa_id, item FROM o WHERE score > 0.8), fi AS (SELECT qa_id, item, min((step, pos)) AS p FROM o WHERE item IS NOT NULL GROUP BY 1, 2)
  SELECT qa_id, item, row_number() OVER (PARTITION BY qa_id ORDER BY p, item) AS place FROM fi WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.qa_id = fi.qa_id AND v.item = fi.item)""")
def agt3(spark, d):
    step = F.row_number().over(Window.partitionBy("qa_id").orderBy("result_id"))
    o = _once(spark, d).where("qa_id IS NOT NULL").withColumn("step", step).select("qa_id", "step", F.posexplode("retrieved_functions").alias("pos", "u"))
    o = materialize(o.select("qa_id", "step", "pos", F.col("u.name").alias("item"), F.col("u.score").alias("score")).where("item IS NOT NULL"))
    return c.candidate_queue(o, o.where("score > 0.8"), "qa_id")


# --- classes and representatives --------------------------------------------------------------------------------------------------


@q("GR5", f"""WITH {SQL_FUNCTIONS}, m AS (SELECT * FROM functions WHERE parent_class IS NOT NULL), c AS (SELECT parent_class, file_path, count(*) AS n FROM m GROUP BY 1, 2), b AS (SELECT parent_class, arg_min(file_path, (-n, file_path)) AS main_file FROM c GROUP BY 1)
  SELECT parent_class, main_file, count(DISTINCT name) AS methods, min(CASE WHEN file_path = main_file THEN start_line END) AS first_line, max(CASE WHEN file_path = main_file THEN end_line END) AS last_line FROM m JOIN b USING (parent_class) GROUP BY 1, 2""")
def gr5(spark, d):
    fn = materialize(functions(spark, d).where("parent_class IS NOT NULL"))
    per = fn.groupBy("parent_class", "file_path").agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))
    best = per.groupBy("parent_class").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("file_path").alias("main_file"), "first_line", "last_line")).alias("b"))
    return fn.groupBy("parent_class").agg(F.countDistinct("name").alias("methods")).join(best, "parent_class").select("parent_class", "b.main_file", "methods", "b.first_line", "b.last_line")


_DIR = "regexp_replace(file_path, '/[^/]*$', '')"
_GROUPS = (("directory", _DIR, 2), ("module", "split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2)", 3), ("domain", "split_part(name, '_', 1)", 2))


@q("GR18", f"WITH {SQL_NODES}, {SQL_CALLS}, {_DEG}, a AS (SELECT name, file_path, coalesce(degree, 0) AS degree, coalesce(in_degree, 0) AS i, coalesce(out_degree, 0) AS o FROM nodes LEFT JOIN deg USING (name)), s AS (SELECT name, 'degree' AS why FROM (SELECT name FROM a ORDER BY degree DESC, name LIMIT 200) t UNION ALL SELECT name, 'entry' FROM (SELECT name FROM a WHERE i <= 2 AND o >= 5 ORDER BY o DESC, name LIMIT 100) t UNION ALL SELECT name, 'name' FROM (SELECT name FROM a WHERE regexp_matches(name, '^(init|run|main|parse|load)') ORDER BY degree DESC, name LIMIT 150) t" + "".join(f" UNION ALL SELECT name, '{k}' FROM (SELECT name, row_number() OVER (PARTITION BY {e} ORDER BY degree DESC, name) AS r FROM a) t WHERE r <= {n}" for k, e, n in _GROUPS) + ") SELECT name, string_agg(why, '|' ORDER BY why) AS why FROM s GROUP BY name")
def gr18(spark, d):
    a = materialize(nodes(spark, d).join(g.degrees(calls(spark, d)), "name", "left").na.fill(0, ["degree", "in_degree", "out_degree"]))
    part = lambda c_, k: F.split_part(c_, F.lit("/" if c_ == "file_path" else "_"), F.lit(k))
    groups = {"directory": (F.regexp_replace("file_path", "/[^/]*$", ""), 2), "module": (F.concat(part("file_path", 1), F.lit("/"), part("file_path", 2)), 3), "domain": (part("name", 1), 2)}
    return g.representatives(a, r"^(init|run|main|parse|load)", groups)


# --- scopes: the best documents and the files they lead to ------------------------------------------------------------------------

_PATH = "[A-Za-z0-9_/]+/[A-Za-z0-9_]+[.](?:cpp|cc|cu|h|py)"
_LONG = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z]+'), lambda x: length(x) >= 4))"
_SCOPE = f"""{SQL_FUNCTIONS}, known AS (SELECT DISTINCT file_path FROM functions WHERE file_path IS NOT NULL), top AS (SELECT question, id FROM ({retrievals.ORACLE["RT10"]}) t10), sec AS (SELECT doc_id AS id, regexp_extract(text, '(?m)^#{{1,3}} +([^\\n]*)', 1) AS title, text FROM documents WHERE text IS NOT NULL),
  nm AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '{_PATH}')) AS file_path FROM sec), ti AS (SELECT DISTINCT id, unnest({_LONG.format("title")}) AS word FROM sec), pa AS (SELECT file_path, unnest({_LONG.format("file_path")}) AS word FROM known),
  led AS (SELECT word, file_path FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY file_path) AS r FROM pa WHERE word IN (SELECT word FROM ti)) z WHERE r <= 20),
  ev AS (SELECT question, file_path FROM top JOIN nm USING (id) WHERE file_path IN (SELECT file_path FROM known) UNION SELECT question, file_path FROM top JOIN ti USING (id) JOIN led USING (word)
   UNION SELECT question, file_path FROM (SELECT DISTINCT question, unnest(regexp_extract_all(question, '{_PATH}')) AS file_path FROM qa_results WHERE question IS NOT NULL) y WHERE file_path IN (SELECT file_path FROM known)),
  scope AS (SELECT question, file_path FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY file_path) AS r FROM ev) x WHERE r <= 20)"""


def _scope(spark, d):
    top = materialize(retrievals.QUERIES["RT10"](spark, d).select("question", "id"))
    sections = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.regexp_extract("text", r"(?m)^#{1,3} +([^\n]*)", 1).alias("title"), "text")
    # the newest states as of ``functions``, by the columns that order them up to the path; the others never leave the scan
    v = ["extracted_at", "ingested_at"]
    newest = latest_where_repeated(table(spark, d, "function_nodes"), "id", v, ["id", "name", "signature", "file_path", *v])
    files = newest.where("file_path IS NOT NULL").select("file_path")
    return r.planned_scope(_questions(spark, d), top, sections, files)


@q("RT11", f"WITH {_SCOPE} SELECT question, file_path FROM scope")
def rt11(spark, d):
    return _scope(spark, d)


@q("RT17", f"""{_R}, {_SCOPE}, gold AS (SELECT DISTINCT result_id, unnest(regexp_extract_all(answer, '{_PATH}')) AS file_path FROM once WHERE answer IS NOT NULL), h AS (SELECT k.result_id, o.question, k.file_path, k.rank, s.file_path IS NOT NULL AS inside, CASE WHEN g.file_path IS NOT NULL THEN 1.0 ELSE 0.0 END AS rel FROM ranked k JOIN once o USING (result_id) LEFT JOIN scope s ON s.question = o.question AND s.file_path = k.file_path LEFT JOIN gold g ON g.result_id = k.result_id AND g.file_path = k.file_path WHERE k.file_path IS NOT NULL AND o.question IS NOT NULL),
  w AS (SELECT *, row_number() OVER (PARTITION BY result_id, inside ORDER BY rank) AS r FROM h) SELECT result_id, round(1 - avg(CASE WHEN rank <= 10 THEN rel END), 6) AS global_noise, round(1 - avg(CASE WHEN inside AND r <= 10 THEN rel END), 6) AS scoped_noise FROM w GROUP BY 1""")
def rt17(spark, d):
    o = _once(spark, d).select("result_id", "question", "answer")
    ranks = _ranked(spark, d).where("file_path IS NOT NULL").select("result_id", "file_path", "rank").join(o.where("question IS NOT NULL").select("result_id", "question"), "result_id")
    gold = o.where("answer IS NOT NULL").select("result_id", F.explode(t.paths(F.col("answer"))).alias("file_path"))
    return r.noise_ratios(ranks, materialize(_scope(spark, d)), gold)


# Issues are kept, and edges between them, when the code graph is cleared.
@q("SNK4", """WITH e AS (SELECT DISTINCT i.id AS src, 'NEXT' AS type, j.id AS dst FROM issues i JOIN issues j ON j.id = split_part(i.id, '#', 1) || '#i' || (i.number + 1)) SELECT 'node' AS what, id AS src, NULL AS dst FROM (SELECT DISTINCT id FROM issues WHERE id IS NOT NULL) z UNION ALL SELECT 'edge', src, dst FROM e""")
def snk4(spark, d):
    from codequarry.operators.incremental import connected_edges, delete_files

    fn = functions(spark, d).where("file_path IS NOT NULL").select("id", "file_path")
    i = materialize(table(spark, d, "issues").where("id IS NOT NULL").select("id", "number").distinct())
    after = i.select(F.col("id").alias("src"), F.lit("NEXT").alias("type"), F.concat(F.substring_index("id", "#", 1), F.lit("#i"), F.col("number") + 1).alias("dst"))
    said = table(spark, d, "issues").where("body IS NOT NULL").select(F.col("id").alias("src"), F.lit("MENTIONS").alias("type"), F.explode(t.paths(F.col("body"))).alias("dst"))
    every = fn.select("id", "file_path").unionByName(i.select("id", F.lit(None).cast("string").alias("file_path"))).unionByName(fn.select(F.col("file_path").alias("id"), "file_path").distinct())
    edges = connected_edges(after.unionByName(said), every)
    kept, left = delete_files(materialize(every), materialize(edges), fn.select("file_path"))
    none = F.lit(None).cast("string")
    return kept.select(F.lit("node").alias("what"), F.col("id").alias("src"), none.alias("dst")).unionByName(left.select(F.lit("edge").alias("what"), "src", "dst"))
