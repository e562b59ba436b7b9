"""Queries EX1-EX5 and TX26 on the retrieved bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import extract as e
from codequarry.plans.fixtures import SQL_LINES, lines
from codequarry.session import materialize, table

QUERIES: dict = {}
ORACLE: dict = {}
_L = f"WITH {SQL_LINES}, code AS (SELECT * FROM lines WHERE NOT regexp_matches(text, '^\\s*($|//|\\*)'))"


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _bodies(spark, d):
    return table(spark, d, "retrieved_functions").where("rf_id IS NOT NULL AND body IS NOT NULL").select("rf_id", "file_path", "body").dropDuplicates(["rf_id"])


# the statement kinds, failure returns and checks, written out once more so that a wrong pattern of the operator shows
_STATEMENTS = r"""WITH RECURSIVE @LINES, every AS (SELECT rf_id, line_no, text, NOT regexp_matches(text, '^\s*($|//|\*)') AS code,
  CASE WHEN regexp_matches(text, '^\s*\}?\s*if\s*\(') THEN 'if' WHEN regexp_matches(text, '^\s*\}?\s*else\s+if\s*\(') THEN 'else_if' WHEN regexp_matches(text, '^\s*\}?\s*else\s*(?:\{|\b|$)') THEN 'else'
    WHEN regexp_matches(text, '^\s*\}?\s*switch\s*\(') THEN 'switch' WHEN regexp_matches(text, '^\s*case\s+.+?:') THEN 'case' WHEN regexp_matches(text, '^\s*default\s*:') THEN 'default'
    WHEN regexp_matches(text, '^\s*\}?\s*try\s*(?:\{|\b|$)') THEN 'try' WHEN regexp_matches(text, '^\s*\}?\s*catch\s*\(') THEN 'catch' END AS type,
  regexp_matches(text, 'return\s+(nullptr|NULL|false|-1|\{\}|0|"")\s*;|throw\s+') AS failed FROM lines),
  heads AS (SELECT *, trim(regexp_extract(text, '^\s*\}?\s*(?:else\s+)?(?:if|switch|catch)\s*\((.*)$', 1)) AS rest, coalesce(bool_or(failed) OVER (PARTITION BY rf_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), false) AS fails FROM every),
  cond AS (SELECT rf_id, line_no, rest AS whole_cond, 0 AS taken, 1 + @REST AS depth FROM heads WHERE code AND type IN ('if', 'else_if', 'switch', 'catch')
   UNION ALL SELECT rf_id, line_no, cond2, taken + 1, @FULL FROM (SELECT c.rf_id, c.line_no, c.whole_cond || ' ' || trim(regexp_replace(l.text, '//.*$', '')) AS cond2, taken FROM cond c JOIN lines l ON l.rf_id = c.rf_id AND l.line_no = c.line_no + c.taken + 1 WHERE c.depth > 0) z),
  whole AS (SELECT rf_id, line_no, max(taken) AS taken, trim(regexp_replace(arg_max(whole_cond, taken), '\)\s*\{?\s*$', '')) AS whole_cond FROM cond GROUP BY 1, 2),
  seen AS (SELECT h.*, w.whole_cond, coalesce(w.taken, 0) AS taken FROM heads h LEFT JOIN whole w USING (rf_id, line_no) WHERE code AND NOT EXISTS (SELECT 1 FROM whole o WHERE o.rf_id = h.rf_id AND h.line_no > o.line_no AND h.line_no <= o.line_no + o.taken)),
  said AS (SELECT rf_id, line_no, type, CASE WHEN whole_cond IS NOT NULL THEN CASE WHEN length(whole_cond) > 120 THEN substr(whole_cond, 1, 120) || '...' ELSE whole_cond END WHEN type = 'case' THEN trim(regexp_extract(text, '^\s*case\s+(.+?):', 1)) ELSE '' END AS condition, taken > 0 AS multi_line, false AS is_error_path,
    CASE WHEN whole_cond IS NULL THEN '' WHEN regexp_matches(whole_cond, '(?i)(ctx|context|device|handle|ptr|pointer|fd|file|sock|socket|conn|connection|inst|instance|gpu|buf|buffer|res|resource)\s*->\s*\w+\s*(==|!=)\s*(nullptr|NULL|0)') THEN 'resource_check'
     WHEN regexp_matches(whole_cond, '(?i)(==|!=)\s*(nullptr|NULL|0|nullptr_t)|(<|>|<=|>=)\s*(0|1|-1|\w+_count|count|size|len|length)|!\s*\w+|\w+\s*\.\s*(empty|size)\s*\(\)|std::\w+\s*\(\s*\w+\s*\)|(is_valid|is_empty|has_|can_|should_|needs_)\s*\(') THEN 'parameter_check'
     WHEN fails AND type IN ('if', 'else_if') THEN 'error_guard' WHEN regexp_matches(whole_cond, '(?i)initialized|ready|valid|dirty|clean|open|closed|active|enabled|disabled|flag|status|state|mode|\bdata\s*\.\s*\w+\s*(==|!=|!|\b)') THEN 'state_validation' ELSE '' END AS semantic_type FROM seen WHERE type IS NOT NULL
   UNION ALL SELECT rf_id, line_no, 'return', value, false, failed, '' FROM (SELECT *, trim(regexp_extract(text, 'return\s+(.*?);', 1)) AS value FROM seen) z
    WHERE failed OR (type IS NULL AND value <> '' AND value NOT IN ('true', 'false', '0', '1', '-1', '""', '''''', '{}', 'nullptr', 'NULL') AND NOT regexp_matches(value, '^[a-zA-Z_]\w*$|^"[^"]*"$')))"""


def _open(column: str) -> str:
    bare = rf"""regexp_replace({column}, '"(?:\\.|[^"\\])*(?:"|$)|''(?:\\.|[^''\\])*(?:''|$)', '', 'g')"""
    return f"(length(regexp_replace({bare}, '[^(]', '', 'g')) - length(regexp_replace({bare}, '[^)]', '', 'g')))"


_SAID = _STATEMENTS.replace("@LINES", SQL_LINES).replace("@REST", _open("rest")).replace("@FULL", _open("cond2"))


@q("EX1", f"{_SAID} SELECT rf_id, line_no, type, condition, multi_line, is_error_path, semantic_type FROM said")
def ex1(spark, d):
    return e.control_flow(lines(spark, d))


@q("EX1b", f"{_SAID} SELECT type, count(*) AS n FROM said GROUP BY 1")
def ex1b(spark, d):
    return e.control_flow(lines(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@q("EX1c", f"{_SAID} SELECT type, semantic_type, is_error_path, multi_line, count(*) AS n FROM said GROUP BY ALL")
def ex1c(spark, d):
    return e.control_flow(lines(spark, d)).groupBy("type", "semantic_type", "is_error_path", "multi_line").agg(F.count("*").alias("n"))


# The retrieved bodies hardly use their own parameters, so the first line of each gets the names that its other lines use
# most: a pool, an index and a value.
_USED = r"""used AS (SELECT rf_id, min(nullif(regexp_extract(text, '\b([a-z]\w*)\s*\.', 1), '')) AS a, min(nullif(regexp_extract(text, '\b([a-z]\w*)\[', 1), '')) AS b, min(nullif(regexp_extract(text, '\(([a-z]\w*)', 1), '')) AS c FROM lines WHERE line_no > 1 GROUP BY 1),
  own AS (SELECT rf_id, line_no, CASE WHEN line_no = 1 THEN 'int run(const std::map<int, int> & ' || coalesce(a, 'a') || ', int * ' || coalesce(b, 'b') || ' = {}, char ' || coalesce(c, 'c') || ') {' ELSE text END AS text FROM lines JOIN used USING (rf_id)),
  code AS (SELECT rf_id, line_no, regexp_replace(text, '//.*$', '') AS c FROM own WHERE line_no > 1 AND NOT regexp_matches(text, '^\s*($|//|\*)')),
  params AS (SELECT DISTINCT rf_id, unnest([coalesce(a, 'a'), coalesce(b, 'b'), coalesce(c, 'c')]) AS param FROM used)"""


def _uses(spark, d):
    ln = materialize(lines(spark, d).select("rf_id", "line_no", "text"))
    first = lambda p: F.min(F.nullif(F.regexp_extract("text", p, 1), F.lit("")))
    used = ln.where("line_no > 1").groupBy("rf_id").agg(first(r"(?<![A-Za-z0-9_])([a-z]\w*)\s*\.").alias("a"), first(r"(?<![A-Za-z0-9_])([a-z]\w*)\[").alias("b"), first(r"\(([a-z]\w*)").alias("c"))
    name = lambda c: F.coalesce(c, F.lit(c))
    head = F.concat(F.lit("int run(const std::map<int, int> & "), name("a"), F.lit(", int * "), name("b"), F.lit(" = {}, char "), name("c"), F.lit(") {"))
    return ln.join(used, "rf_id").select("rf_id", "line_no", F.when(F.col("line_no") == 1, head).otherwise(F.col("text")).alias("text"))


def _uses_sql() -> str:
    each = (
        ("field_read:", r"\b(\w+)\s*\.\s*(\w+)", 1, "x2"), ("array_index", r"\b(\w+)\s*\[", 1, "''"), ("ref_pass", r"&\s*(\w+)\b", 1, "''"), ("assign_to:", r"(?:const\s+)?\w+\s*[*&]?\s+(\w+)\s*=\s*(\w+)", 2, "x1"),
        ("pass_to:", r"\b(\w+)\s*\([^)]*\b(\w+)\b", 2, "x1"), ("return", r"return\s+(\w+)", 1, "''"), ("field_assign:", r"\b(\w+)\s*\.\s*(\w+)\s*=\s*([^;]+)", 1, "x2 || '=' || substr(trim(x3), 1, 30)"),
    )
    out = []
    for op, p, name, more in each:
        groups = [g for g in (1, 2, 3) if f"x{g}" in more or g == name]
        cols = ", ".join(f"unnest(regexp_extract_all(c, '{p}', {g})) AS x{g}" for g in groups)
        own = " WHERE x1 <> x2" if op == "pass_to:" else ""
        out.append(f"SELECT rf_id, line_no, x{name} AS param, '{op}' || {more} AS op FROM (SELECT rf_id, line_no, {cols} FROM code) z{own}")
    return " UNION ALL ".join(out)


@q("EX2", f"WITH {SQL_LINES}, {_USED}, seen AS ({_uses_sql()}) SELECT rf_id, param, string_agg(DISTINCT op, '|' ORDER BY op) AS operations, array_to_string(list_sort(list_distinct(list(line_no))), ',') AS lines FROM seen JOIN params USING (rf_id, param) GROUP BY 1, 2")
def ex2(spark, d):
    return e.parameter_flow(_uses(spark, d))


def _case(col: int | None) -> str:
    out = []
    for k, p in e.RESOURCE_OPERATIONS:
        out.append(f"WHEN regexp_matches(text, '{p}') THEN " + (f"'{k}'" if col is None else f"regexp_extract(text, '{p}', 1)"))
    return "CASE " + " ".join(out) + " END"


_OPS = f"""{_L}, o AS (SELECT rf_id, line_no, text, {_case(None)} AS type, {_case(1)} AS operation FROM code),
  r AS (SELECT rf_id, line_no, type, operation, CASE WHEN type = 'raii' AND contains(lower(text), 'lock') THEN 'mutex' WHEN type = 'raii' THEN 'memory' WHEN type = 'throw' THEN 'exception'
   WHEN regexp_matches(lower(text), 'gpu|cuda|vulkan|webgpu|sycl|device|context|ctx') THEN 'gpu_context' WHEN regexp_matches(lower(text), 'file|fd|socket|sock|handle') THEN 'io_handle'
   WHEN regexp_matches(lower(text), 'malloc|free|new|delete|mem|make_unique|make_shared') THEN 'memory' ELSE 'generic' END AS resource,
   coalesce(nullif(regexp_extract(text, '([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(?:new|malloc|calloc|realloc|std::make)', 1), ''), nullif(regexp_extract(text, 'delete(?:\\s*\\[\\s*\\])?\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''),
   nullif(regexp_extract(text, 'free\\s*\\(\\s*([A-Za-z_][A-Za-z0-9_]*)', 1), ''), nullif(regexp_extract(text, '([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(?:nullptr|NULL|0)\\s*;', 1), ''), '') AS variable FROM o WHERE type IS NOT NULL)"""


@q("EX3", f"{_OPS} SELECT rf_id, line_no, type, operation, resource, variable FROM r")
def ex3(spark, d):
    return e.resource_operations(lines(spark, d))


@q("EX3b", f"{_OPS} SELECT a.rf_id, a.variable, a.line_no AS allocated, min(b.line_no) AS released FROM r a LEFT JOIN r b ON b.rf_id = a.rf_id AND b.variable = a.variable AND b.type = 'release' AND b.line_no > a.line_no WHERE a.type = 'allocate' AND a.variable <> '' GROUP BY 1, 2, 3")
def ex3b(spark, d):
    return e.resource_pairs(e.resource_operations(lines(spark, d)))


@q("EX4")
def ex4(spark, d):
    return e.python_symbols(_bodies(spark, d).where(F.col("file_path").endswith(".py")))


@q("EX5")
def ex5(spark, d):
    return e.function_spans(_bodies(spark, d))


@q("TX26", f"""WITH {SQL_LINES}, k AS (SELECT rf_id, line_no, text, CASE WHEN regexp_matches(text, '^\\s*(?:async\\s+)?def\\s+\\w+') THEN 'function' WHEN regexp_matches(text, '^\\s*class\\s+\\w+') THEN 'class' WHEN regexp_matches(text, '^[A-Za-z_]\\w*\\s*=[^=]') THEN 'variable' END AS kind FROM lines WHERE ends_with(file_path, '.py'))
  SELECT rf_id, kind, coalesce(nullif(regexp_extract(text, '^\\s*(?:async\\s+)?(?:def|class)\\s+(\\w+)', 1), ''), regexp_extract(text, '^([A-Za-z_]\\w*)\\s*=', 1)) AS name, line_no FROM k WHERE kind IS NOT NULL""")
def tx26(spark, d):
    return e.python_fallback(lines(spark, d).where(F.col("file_path").endswith(".py")))


@q("SRC9", f"WITH {SQL_LINES} SELECT rf_id, string_agg(lpad(CAST(line_no AS VARCHAR), 4, ' ') || ' | ' || text, chr(10) ORDER BY line_no) AS code FROM lines WHERE line_no BETWEEN 2 AND 5 GROUP BY rf_id")
def src9(spark, d):
    from codequarry.sources.code import numbered

    span = lines(spark, d).where("line_no BETWEEN 2 AND 5")
    return numbered(span, "rf_id")
