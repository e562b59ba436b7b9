"""Queries TX1-TX27."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import text as t
from codequarry.plans.fixtures import SQL_FUNCTIONS, functions
from codequarry.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _sql_list(words):
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def _join(c):
    return F.array_join(c, "|")


_Q = "q AS (SELECT DISTINCT question FROM qa_results WHERE question IS NOT NULL)"
_I = "i AS (SELECT DISTINCT id, body FROM issues WHERE body IS NOT NULL)"


def _questions(spark, d):
    return table(spark, d, "qa_results").where("question IS NOT NULL").select("question").distinct()


def _issues(spark, d):
    return table(spark, d, "issues").where("body IS NOT NULL").select("id", "body").distinct()


@q("TX1", f"""WITH {_Q}, w AS (SELECT question, list_filter(regexp_extract_all(question, '\\b[a-zA-Z_][a-zA-Z0-9_]{{2,}}\\b'), lambda x: NOT list_contains({_sql_list(t.STOP_WORDS + t.KEYWORDS)}, lower(x))) AS w FROM q)
  SELECT question, array_to_string(list_concat(list_reverse(list_filter(w, lambda x: contains(x, '_') OR regexp_matches(substr(x, 2), '[A-Z]'))), list_filter(w, lambda x: NOT (contains(x, '_') OR regexp_matches(substr(x, 2), '[A-Z]'))))[1:6], '|') AS keywords FROM w""")
def tx1(spark, d):
    return _questions(spark, d).select("question", _join(t.keywords(F.col("question"))).alias("keywords"))


@q("TX2", f"WITH x AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda x: NOT list_contains({_sql_list(t.INDEX_STOP_WORDS)}, x))) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x GROUP BY word")
def tx2(spark, d):
    w = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(t.index_tokens(F.col("text"))).alias("word"))
    per = w.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@q("TX3", f"""WITH {_Q} SELECT question, array_to_string(list_filter(list_concat(regexp_extract_all(question, '\\b[a-zA-Z_][a-zA-Z0-9_]*::[a-zA-Z_][a-zA-Z0-9_]*\\b'), regexp_extract_all(question, '\\b[A-Z][a-z]+[A-Z][a-zA-Z]*\\b')),
  lambda x: length(x) >= 3 AND NOT list_contains(['function','class','module','variable','code'], lower(x)))[1:3], '|') AS entities FROM q""")
def tx3(spark, d):
    return _questions(spark, d).select("question", _join(t.entities(F.col("question"))).alias("entities"))


@q("TX4", f"""WITH {_Q}, s AS (SELECT question, list_concat(regexp_extract_all(question, '`([^`]+?)`', 1), list_filter(regexp_extract_all(question, '\\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b', 1), lambda x: length(x) > 5)) AS s FROM q)
  SELECT question, array_to_string(list_sort(list_distinct(s)), '|') AS symbols FROM s""")
def tx4(spark, d):
    return _questions(spark, d).select("question", _join(F.array_sort(t.symbols(F.col("question")))).alias("symbols"))


@q("TX6", f"""WITH b AS (SELECT rf_id, any_value(body) AS body FROM retrieved_functions WHERE rf_id IS NOT NULL AND body IS NOT NULL GROUP BY rf_id),
  s AS (SELECT rf_id, unnest(list_concat(regexp_extract_all(body, '\\b(?:class|struct)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), regexp_extract_all(body, '(?:^|\\n)[A-Za-z_][A-Za-z0-9_:<>*& ]* [*&]?([A-Za-z_][A-Za-z0-9_:~]*)\\(', 1))) AS s FROM b)
  SELECT DISTINCT rf_id, s AS symbol FROM s WHERE length(s) >= 2 AND NOT list_contains({_sql_list(t.KEYWORDS)}, s)""")
def tx6(spark, d):
    b = table(spark, d, "retrieved_functions").where("rf_id IS NOT NULL AND body IS NOT NULL").dropDuplicates(["rf_id"])
    return b.select("rf_id", F.explode(t.code_symbols(F.col("body"))).alias("symbol"))


_FIX = "(VALUES (1, 'Fixes #12 and closes #7'), (2, 'resolve #3, RESOLVES  #40'), (3, 'see #9'), (4, NULL)) AS t(pr, body)"


@q("TX8", f"WITH {_I}, m AS (SELECT id, unnest(list_concat(regexp_extract_all(body, '`([A-Za-z_][A-Za-z0-9_]*)`', 1), regexp_extract_all(body, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1))) AS name FROM i) SELECT DISTINCT id, name FROM m WHERE length(name) >= 4")
def tx8(spark, d):
    return _issues(spark, d).select("id", F.explode(t.mentions(F.col("body"))).alias("name")).distinct()


@q("TX9", f"WITH {_I} SELECT DISTINCT id FROM i WHERE regexp_matches(body, '\\b[0-9a-f]{{7,40}}\\b') OR regexp_matches(body, '[A-Za-z0-9_/]+\\.(?:cpp|cc|cu|h|hpp|py)\\b') OR regexp_matches(body, '[A-Za-z_][A-Za-z0-9_]*\\(')")
def tx9(spark, d):
    return _issues(spark, d).where(t.has_code_reference(F.col("body"))).select("id").distinct()


_A = "a AS (SELECT DISTINCT result_id, answer FROM qa_results WHERE answer IS NOT NULL AND result_id IS NOT NULL)"


def _answers(spark, d):
    return table(spark, d, "qa_results").where("answer IS NOT NULL AND result_id IS NOT NULL").select("result_id", "answer").distinct()


@q("TX10", f"WITH {_A}, e AS (SELECT result_id, unnest(regexp_extract_all(answer, '[A-Za-z0-9_./-]+\\.[a-z]+:\\d+')) AS e FROM a) SELECT result_id, regexp_replace(e, ':\\d+$', '') AS path, CAST(regexp_extract(e, ':(\\d+)$', 1) AS INTEGER) AS line, count(*) AS n FROM e GROUP BY 1, 2, 3")
def tx10(spark, d):
    e = _answers(spark, d).select("result_id", F.explode(t.evidence(F.col("answer"))).alias("e"))
    return e.groupBy("result_id", "e.path", "e.line").agg(F.count("*").alias("n"))


@q("TX11", f"WITH {_A} SELECT DISTINCT result_id, unnest(regexp_extract_all(answer, '[A-Za-z0-9_/]+/[A-Za-z0-9_]+[.](?:cpp|cc|cu|h|py)')) AS path FROM a")
def tx11(spark, d):
    return _answers(spark, d).select("result_id", F.explode(t.paths(F.col("answer"))).alias("path"))


@q("TX13", "SELECT DISTINCT file_path, regexp_replace(file_path, '^[./]+', '') AS path FROM retrieved_functions WHERE file_path IS NOT NULL")
def tx13(spark, d):
    return table(spark, d, "retrieved_functions").where("file_path IS NOT NULL").select("file_path", t.strip_dots(F.col("file_path")).alias("path")).distinct()


@q("TX15", "SELECT DISTINCT rf_id, regexp_extract(body, '^[^{;]*') AS signature FROM retrieved_functions WHERE body IS NOT NULL AND body <> ''")
def tx15(spark, d):
    return table(spark, d, "retrieved_functions").where("body IS NOT NULL AND body <> ''").select("rf_id", F.regexp_extract("body", "^[^{;]*", 0).alias("signature")).distinct()


@q("TX16", f"WITH {SQL_FUNCTIONS}, f AS (SELECT DISTINCT file_path FROM functions) SELECT file_path, string_split(file_path, '/')[-1] AS name, regexp_extract(file_path, '\\.([^./]*)$', 1) AS suffix, CASE WHEN regexp_extract(file_path, '\\.([^./]*)$', 1) IN ('h', '') THEN 'cpp' ELSE regexp_extract(file_path, '\\.([^./]*)$', 1) END AS language, len(string_split(file_path, '/')) - 1 AS depth FROM f")
def tx16(spark, d):
    p = F.col("file_path")
    f = functions(spark, d).select("file_path").distinct()
    return f.select("file_path", t.basename(p).alias("name"), t.suffix(p).alias("suffix"), t.language(p).alias("language"), F.size(t.ancestors(p)).alias("depth"))


@q("TX17", """WITH l AS (SELECT doc_id, k, parts[k] AS line, regexp_matches(parts[k], '^#{1,3} ') AS head FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL) y) z),
  s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM l)
  SELECT doc_id, CAST(n AS BIGINT) AS section_no, coalesce(max(CASE WHEN head THEN regexp_replace(line, '^#{1,3} +', '') END), '') AS title, trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY k), '')) AS body FROM s GROUP BY doc_id, n""")
def tx17(spark, d):
    return t.sections(table(spark, d, "documents"), "doc_id", "text")


_CLEAN = "text"
for _p, _to in ((r"(?s)```.*?(```|\z)", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"<[^<>\n]*>", "")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_to}', 'g')"


@q("TX19", "SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text ELSE substr(text, 1, 600) || chr(10) || '...' || chr(10) || right(text, 600) END AS text FROM documents")
def tx19(spark, d):
    return table(spark, d, "documents").select("doc_id", t.elide(F.col("text"), 1200).alias("text"))


@q("TX22", f"WITH {_Q} SELECT CASE WHEN regexp_matches(question, '`[^`]+`|[a-z]+_[a-z]+') THEN 'symbol' WHEN regexp_matches(question, '[A-Za-z]{{4,}}') THEN 'topic' ELSE 'guess' END AS kind, count(*) AS n FROM q GROUP BY 1")
def tx22(spark, d):
    c = F.col("question")
    kind = F.when(c.rlike("`[^`]+`|[a-z]+_[a-z]+"), "symbol").when(c.rlike("[A-Za-z]{4,}"), "topic").otherwise("guess")
    return _questions(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_KNOWN = "k AS (SELECT DISTINCT file_path FROM function_nodes WHERE file_path IS NOT NULL), kb AS (SELECT string_split(file_path, '/')[-1] AS base, min(file_path) AS file_path FROM k GROUP BY 1), p AS (SELECT DISTINCT file_path AS path FROM retrieved_functions WHERE file_path IS NOT NULL)"


def _resolve(spark, d):
    k = table(spark, d, "function_nodes").where("file_path IS NOT NULL").select("file_path").distinct()
    base = k.groupBy(t.basename(F.col("file_path")).alias("base")).agg(F.min("file_path").alias("by_base"))
    p = table(spark, d, "retrieved_functions").where("file_path IS NOT NULL").select(F.col("file_path").alias("path")).distinct()
    out = p.join(k.select(F.col("file_path").alias("path"), F.col("file_path").alias("same")), "path", "left")
    return out.withColumn("base", t.basename(F.col("path"))).join(base, "base", "left")


@q("TX23", f"WITH {_KNOWN} SELECT path, CASE WHEN k.file_path IS NOT NULL THEN 'literal' WHEN kb.file_path IS NOT NULL THEN 'basename' ELSE 'none' END AS found FROM p LEFT JOIN k ON k.file_path = path LEFT JOIN kb ON kb.base = string_split(path, '/')[-1]")
def tx23(spark, d):
    return _resolve(spark, d).select("path", F.when(F.col("same").isNotNull(), "literal").when(F.col("by_base").isNotNull(), "basename").otherwise("none").alias("found"))


@q("TX24", f"WITH {_KNOWN} SELECT path, coalesce(k.file_path, kb.file_path) AS file_path FROM p LEFT JOIN k ON k.file_path = path LEFT JOIN kb ON kb.base = string_split(path, '/')[-1]")
def tx24(spark, d):
    return _resolve(spark, d).select("path", F.coalesce("same", "by_base").alias("file_path"))


#: Words of questions in other languages and what code calls them: a parameter of the operator, made for these tables.
TERMS = {
    "缓冲区": ["buffer", "ring buffer"], "句柄": ["handle"], "队列": ["queue", "work queue"], "快照": ["snapshot"], "节点": ["node"], "日志": ["journal", "log"], "租约": ["lease"], "令牌": ["token"],
    "索引": ["index"], "Puffer": ["buffer"], "Sperre": ["lock", "lock guard"],
}
_TERMS = "list_concat(" + ", ".join(f"CASE WHEN contains(question, '{k}') THEN {_sql_list(v)} ELSE [] END" for k, v in TERMS.items()) + ")"
_FIRSTS = "list_filter({0}, lambda x, k: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = k)"


@q("TX5", f"""WITH {_Q}, a AS (SELECT question, list_filter(list_concat(regexp_extract_all(question, '(?i)\\b[A-Z][a-z]+[A-Z][a-zA-Z0-9_]*\\b'), regexp_extract_all(question, '(?i)\\b[a-z_][a-z0-9_]*_t\\b'), regexp_extract_all(question, '(?i)\\b[A-Z]{{2,}}_\\w+\\b')), lambda x: length(x) >= 3) AS i0, list_distinct({_TERMS}) AS t0, {_TERMS} AS t1 FROM q),
  b AS (SELECT question, ({_FIRSTS.format("i0")})[1:10] AS i, list_filter(t1, lambda x, k: list_position(t1, x) = k) AS t FROM a),
  c AS (SELECT question, i, list_filter(list_filter(list_concat(i, list_filter(t, lambda x: length(x) >= 3 AND NOT contains(x, ' ')), regexp_extract_all(question, '\\b[A-Z]{{2,}}\\b'), list_filter(flatten(list_transform(list_filter(t, lambda x: contains(x, ' ')), lambda x: string_split(x, ' '))), lambda x: length(x) >= 3)), lambda x: length(x) >= 3), lambda w: NOT (ends_with(w, '_t') AND list_contains(list_transform(i, lambda y: lower(y)), w[1:-3]))) AS k0 FROM b),
  d AS (SELECT question, i, ({_FIRSTS.format("k0")})[1:12] AS k FROM c),
  e AS (SELECT question, i, k, list_concat(i[1:3], CASE WHEN len(k) > 0 THEN [array_to_string(k[1:3], ' ')] ELSE [] END, flatten(list_transform(i[1:2], lambda a: list_transform(list_filter(k[1:3], lambda b: lower(b) <> lower(a)), lambda b: a || ' ' || b)))) AS s FROM d)
  SELECT question, array_to_string(i, '|') AS identifiers, array_to_string(k, '|') AS keywords, array_to_string((list_filter(s, lambda x, n: list_position(s, x) = n))[1:8], '|') AS queries,
   array_to_string(list_transform(i, lambda w: CASE WHEN regexp_matches(w, '^[A-Z]{{2,}}_') THEN 'macro' WHEN ends_with(w, '_t') THEN 'type' WHEN regexp_matches(w, '^[A-Z][a-z]+[A-Z]') THEN 'class' ELSE 'unknown' END), '|') AS kinds FROM e""")
def tx5(spark, d):
    r = t.rewrite(_questions(spark, d), TERMS)
    return r.select("question", *[_join(c).alias(c) for c in r.columns[1:]])


@q("TX12", f"WITH {_A}, s AS (SELECT result_id, regexp_extract(answer, '(?m)^(?:#+ )?(?:Evidence:|证据：)[ \\t]*\\n((?:- [^\\n]*(?:\\n|\\z))+)', 1) AS items FROM a), e AS (SELECT result_id, unnest(regexp_extract_all(items, '[A-Za-z0-9_./-]+\\.[a-z]+:\\d+')) AS e FROM s) SELECT result_id, regexp_replace(e, ':\\d+$', '') AS path, count(*) AS n FROM e GROUP BY 1, 2")
def tx12(spark, d):
    e = _answers(spark, d).select("result_id", F.explode(t.cited_files(F.col("answer"), "(?:Evidence:|证据：)")).alias("e"))
    return e.groupBy("result_id", "e.path").agg(F.count("*").alias("n"))


def _flat(sql: str) -> str:
    """Inner brackets taken out, as often as they nest."""
    for _ in range(6):
        sql = f"regexp_replace({sql}, '<[^<>(){{}}]*>|\\([^<>(){{}}]*\\)|\\{{[^<>(){{}}]*\\}}|\\[[^<>(){{}}]*\\]', '', 'g')"
    return sql


_INNER = "regexp_extract(signature, '(?s)\\((.*)\\)[^)]*$', 1)"


@q("TX14", f"WITH {SQL_FUNCTIONS} SELECT id, CASE WHEN trim({_INNER}) IN ('', 'void') THEN 0 ELSE length(regexp_replace({_flat(_INNER)}, '[^,]', '', 'g')) + 1 END AS params FROM functions WHERE signature IS NOT NULL")
def tx14(spark, d):
    return functions(spark, d).where("signature IS NOT NULL").select("id", t.parameter_count(F.col("signature")).alias("params"))


_CLEANED = f"trim(regexp_replace({_CLEAN}, '\\n\\s*\\n+', chr(10) || chr(10), 'g'))"


@q("TX18", f"SELECT doc_id, {_CLEANED} AS text FROM documents WHERE text IS NOT NULL")
def tx18(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", t.clean_markdown(F.col("text")).alias("text"))


@q("TX18_chunks", f"""WITH RECURSIVE cl AS (SELECT doc_id, {_CLEANED} AS text FROM documents WHERE text IS NOT NULL),
  sec AS (SELECT doc_id, k, regexp_replace(s[k], '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n(##?\\s)', chr(1) || '\\1', 'g'), chr(1)) AS s FROM cl) z) y),
  laid AS (SELECT doc_id, k, CASE WHEN regexp_matches(s, '^#{{1,3}}\\s+[^\\n]+\\n') THEN trim(regexp_extract(s, '^(#{{1,3}}\\s+[^\\n]+)\\n', 1)) || chr(10) || chr(10) || regexp_replace(regexp_replace(s, '^#{{1,3}}\\s+[^\\n]+\\n', ''), '^\\s+|\\s+$', '', 'g') ELSE s END AS s FROM sec WHERE s <> ''),
  pc AS (SELECT doc_id, k, 0 AS j, s AS t, chr(10) || chr(10) AS sep, false AS fresh FROM laid WHERE length(s) <= 600 UNION ALL SELECT doc_id, k, j, p[j], chr(10), j = 1 FROM (SELECT doc_id, k, p, unnest(range(1, len(p) + 1)) AS j FROM (SELECT doc_id, k, string_split(s, chr(10)) AS p FROM laid WHERE length(s) > 600) z) y),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS r FROM pc),
  w AS (SELECT doc_id, r, t AS now, CAST(NULL AS VARCHAR) AS done FROM n WHERE r = 1 UNION ALL
   SELECT n.doc_id, n.r, CASE WHEN length(w.now) + length(n.t) <= 600 AND NOT n.fresh THEN CASE WHEN w.now = '' THEN n.t ELSE w.now || n.sep || n.t END ELSE n.t END, CASE WHEN length(w.now) + length(n.t) <= 600 AND NOT n.fresh THEN NULL ELSE nullif(w.now, '') END FROM w JOIN n ON n.doc_id = w.doc_id AND n.r = w.r + 1),
  lst AS (SELECT doc_id, max(r) AS r FROM w GROUP BY 1), o AS (SELECT doc_id, r AS pos, done AS text FROM w WHERE done IS NOT NULL UNION ALL SELECT doc_id, r + 1, now FROM w JOIN lst USING (doc_id, r) WHERE now <> '')
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_no, text FROM o""")
def tx18_chunks(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", t.clean_markdown(F.col("text")).alias("text"))
    each = docs.select("doc_id", F.posexplode(t.markdown_chunks(F.col("text"))).alias("k", "text"))
    return each.select("doc_id", (F.col("k") + 1).cast("long").alias("chunk_no"), "text")


_TIERS = [("src/core/", "core"), ("src/", "library"), ("lib/", "library"), ("include/", "interface"), ("tests/", "tests"), ("tools/", "tools"), ("examples/", "examples"), ("third_party/", "vendor"), ("vendor/", "vendor")]
_INNER_TIERS = {"core": [("parse_", "parser"), ("alloc_", "memory"), ("lock_", "locks"), ("get", "access"), ("init", "setup")]}
_T1 = "CASE " + " ".join(f"WHEN starts_with(file_path, '{p}') THEN '{k}'" for p, k in _TIERS) + " ELSE 'other' END"
_T2 = "CASE " + " ".join(f"WHEN starts_with(name, '{p}') THEN '{k}'" for p, k in _INNER_TIERS["core"]) + " ELSE 'other' END"
_TAGGED = [
    ("init", "_(init|new|create|alloc)\\b"), ("free", "_(free|destroy|release|delete|cleanup|clear)\\b"), ("forward", "_(forward|compute|calc|run|exec|apply)\\b"), ("get", "\\bget_|_\\bget\\b"), ("set", "\\bset_|_\\bset\\b"), ("sample", "_sample|_sampler|_prob"), ("quant", "_quant|_dequant|_iq_"),
    ("io", "_load|_save|_read|_write|_parse|_dump|_encode|_decode"), ("graph", "_graph|_node|_edge"), ("backend", "_backend|_device|_dev_"), ("mem", "_mem|_alloc|_buffer|_pool"), ("sync", "_sync|_barrier|_fence"), ("thread", "_thread|_parallel|_worker"), ("token", "_token|_tok_"), ("kv", "_kv_|_kv_cache"),
]


@q("TX21", f"WITH {SQL_FUNCTIONS} SELECT id, {_T1} AS tier1, CASE WHEN {_T1} = 'core' THEN {_T2} END AS tier2, coalesce(nullif(concat_ws('|', {', '.join(f'CASE WHEN regexp_matches(lower(name), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{k}{chr(39)} END' for k, p in _TAGGED)}), ''), 'other') AS tags FROM functions WHERE name IS NOT NULL AND file_path IS NOT NULL")
def tx21(spark, d):
    n, p = F.col("name"), F.col("file_path")
    fn = functions(spark, d).where("name IS NOT NULL AND file_path IS NOT NULL")
    return fn.select("id", t.two_tiers(p, _TIERS, n, _INNER_TIERS).alias("x"), _join(t.semantic_tags(n)).alias("tags")).select("id", "x.tier1", "x.tier2", "tags")
