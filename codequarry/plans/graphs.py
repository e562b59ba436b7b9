"""Queries GR1-GR22 on the name graph of the retrieval traces, and the degree aggregates on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import graph as g
from codequarry.plans.filters import _DEG
from codequarry.plans.fixtures import SQL_CALLS, SQL_FUNCTIONS, SQL_NODES, calls, functions, nodes
from codequarry.session import materialize, table

QUERIES: dict = {}
ORACLE: dict = {}
_G = f"WITH {SQL_NODES}, {SQL_CALLS}"
_R = f"WITH RECURSIVE {SQL_NODES}, {SQL_CALLS}"


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _nc(spark, d):
    return nodes(spark, d), materialize(calls(spark, d))


@q("GR1", _G + """ SELECT 'caller' AS side, src AS name, n.file_path, n.start_line FROM (SELECT src FROM calls WHERE dst = 'reset' AND src IN (SELECT name FROM nodes) ORDER BY src LIMIT 10) c JOIN nodes n ON n.name = c.src
  UNION ALL SELECT 'callee', dst, n.file_path, n.start_line FROM (SELECT dst FROM calls WHERE src = 'reset' AND dst IN (SELECT name FROM nodes) ORDER BY dst LIMIT 10) c JOIN nodes n ON n.name = c.dst""")
def gr1(spark, d):
    n, c = _nc(spark, d)
    a = g.callers(c, n, "reset", 10).select(F.lit("caller").alias("side"), "name", "file_path", "start_line")
    return a.unionByName(g.callees(c, n, "reset", 10).select(F.lit("callee").alias("side"), "name", "file_path", "start_line"))


@q("GR2", _G + """, x AS (SELECT src AS name, file_path, CASE WHEN starts_with(file_path, 'src/') THEN 3 WHEN starts_with(file_path, 'lib/') THEN 2 WHEN starts_with(file_path, 'tests/') OR starts_with(file_path, 'examples/') THEN 0 ELSE 1 END AS rank
  FROM calls JOIN nodes ON name = src WHERE dst = 'init') SELECT name, file_path, CAST(0.5 AS DOUBLE) AS score, 'caller_of_init' AS source FROM x ORDER BY rank DESC, name LIMIT 10""")
def gr2(spark, d):
    from codequarry.operators.filters import path_rank

    n, c = _nc(spark, d)
    hit = c.where("dst = 'init'").select(F.col("src").alias("name")).join(n, "name")
    return hit.orderBy(path_rank().desc(), "name").limit(10).select("name", "file_path", F.lit(0.5).alias("score"), F.lit("caller_of_init").alias("source"))


@q("GR3", f"""WITH {SQL_FUNCTIONS}, r AS (SELECT t.id AS target, f.id, abs(f.start_line - t.start_line) AS distance,
  row_number() OVER (PARTITION BY t.id ORDER BY abs(f.start_line - t.start_line), f.id) AS rn FROM functions t JOIN functions f ON f.file_path = t.file_path AND f.id <> t.id WHERE t.name = 'main')
  SELECT target, id, distance FROM r WHERE rn <= 5""")
def gr3(spark, d):
    fn = functions(spark, d)
    return g.same_file_neighbours(fn, fn.where("name = 'main'"), 5)


@q("GR4", f"""WITH {SQL_FUNCTIONS}, c AS (SELECT split_part(parent_class, '::', 1) AS class, file_path, count(*) AS n FROM functions WHERE parent_class IS NOT NULL GROUP BY 1, 2)
  SELECT class, CAST(sum(n) AS BIGINT) AS members, arg_min(file_path, (-n, file_path)) AS main_file FROM c GROUP BY class""")
def gr4(spark, d):
    fn = functions(spark, d).where("parent_class IS NOT NULL")
    per = fn.groupBy(F.split_part("parent_class", F.lit("::"), F.lit(1)).alias("class"), "file_path").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "file_path"))
    return per.groupBy("class").agg(F.sum("n").alias("members"), best.alias("b")).select("class", "members", F.col("b.file_path").alias("main_file"))


_SEEDS = "(SELECT name AS seed FROM nodes WHERE name LIKE 'parse\\_%' ESCAPE '\\')"


def _seeds(n):
    return n.where(F.col("name").startswith("parse_")).select(F.col("name").alias("seed"))


def _hop_sql(edges: str, hops: int) -> str:
    return f""", e AS ({edges}), h AS (SELECT seed, seed AS name, 0 AS hop FROM {_SEEDS} s UNION SELECT h.seed, e.b, h.hop + 1 FROM h JOIN e ON e.a = h.name WHERE h.hop < {hops})
  SELECT seed, name, min(hop) AS hop FROM h GROUP BY seed, name"""


_BOTH = "SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls"


@q("GR6", _R + _hop_sql("SELECT src AS a, dst AS b FROM calls", 3))
def gr6(spark, d):
    n, c = _nc(spark, d)
    return g.k_hop(c, _seeds(n), 3)


@q("GR7", _R + f", u AS ({_BOTH}), f AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM u)" + _hop_sql("SELECT a, b FROM f WHERE r <= 5", 3))
def gr7(spark, d):
    n, c = _nc(spark, d)
    return g.k_hop(c, _seeds(n), 3, directed=False, per_node=5)


@q("GR8", _R + f", {_DEG}" + _hop_sql(f"SELECT a, b FROM ({_BOTH}) u WHERE b NOT IN (SELECT name FROM deg WHERE degree > 50)", 2))
def gr8(spark, d):
    n, c = _nc(spark, d)
    hubs = g.degrees(c).where("degree > 50")
    return g.k_hop(c, _seeds(n), 2, directed=False, without=hubs)


_LAYER = """ SELECT {h} AS layer, count(DISTINCT src) AS callers, count(*) AS rows, count(DISTINCT file_path) AS files
  FROM calls LEFT JOIN nodes ON name = src WHERE dst IN (SELECT src FROM l{p}) AND src NOT IN (SELECT src FROM s{p})"""


@q("GR9", _G + ", l0 AS (SELECT 'apply' AS src), s0 AS (SELECT 'apply' AS src)" + "".join(
    f", l{h} AS (SELECT DISTINCT src FROM calls WHERE dst IN (SELECT src FROM l{h - 1}) AND src NOT IN (SELECT src FROM s{h - 1})), s{h} AS (SELECT src FROM s{h - 1} UNION SELECT src FROM l{h})" for h in (1, 2))
    + " UNION ALL ".join(_LAYER.format(h=h, p=h - 1) for h in (1, 2, 3)))
def gr9(spark, d):
    n, c = _nc(spark, d)
    return g.impact(c, n, spark.createDataFrame([("apply",)], "name string"), 3)


@q("GR10", _R + f""", e AS ({_BOTH}), p AS (SELECT a.seed AS a, b.seed AS b FROM {_SEEDS} a, (SELECT name AS seed FROM nodes WHERE name LIKE 'scan\\_%' ESCAPE '\\') b WHERE substr(a.seed, 7) = substr(b.seed, 6)),
  h AS (SELECT a AS seed, a AS name, 0 AS hop FROM p UNION SELECT h.seed, e.b, h.hop + 1 FROM h JOIN e ON e.a = h.name WHERE h.hop < 4),
  m AS (SELECT seed, name, min(hop) AS hop FROM h GROUP BY 1, 2) SELECT p.a, p.b, m.hop AS hops FROM p LEFT JOIN m ON m.seed = p.a AND m.name = p.b""")
def gr10(spark, d):
    n, c = _nc(spark, d)
    a = _seeds(n).select(F.col("seed").alias("a"), F.expr("substring(seed, 7)").alias("k"))
    b = n.where(F.col("name").startswith("scan_")).select(F.col("name").alias("b"), F.expr("substring(name, 6)").alias("k"))
    return g.shortest_paths(c, a.join(b, "k").select("a", "b"), 4)


@q("GR11", _G + """ SELECT a.src AS a, a.dst AS b, CAST(NULL AS VARCHAR) AS c FROM calls a JOIN calls b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
  UNION ALL SELECT a.src, a.dst, b.dst FROM calls a JOIN calls b ON b.src = a.dst JOIN calls c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND b.src < b.dst""")
def gr11(spark, d):
    _, c = _nc(spark, d)
    return g.two_cycles(c).withColumn("c", F.lit(None).cast("string")).unionByName(g.three_cycles(c))


@q("GR12", _G + """ SELECT x.src AS a, x.dst AS b, y.dst AS c, z.dst AS d FROM calls x JOIN calls y ON y.src = x.dst JOIN calls z ON z.src = y.dst
  WHERE y.dst <> x.src AND z.dst <> x.src AND z.dst <> x.dst ORDER BY 1, 2, 3, 4 LIMIT 60""")
def gr12(spark, d):
    _, c = _nc(spark, d)
    return g.call_chains(c, 60)


@q("GR13", _G + f""", {_DEG}, m AS (SELECT name, regexp_replace(file_path, '/[^/]*$', '') AS module FROM nodes), hit AS (SELECT DISTINCT module FROM m WHERE contains(name, 'parse_t'))
  SELECT name, module, coalesce(out_degree, 0) AS out_degree FROM m LEFT JOIN deg USING (name) WHERE module IN (SELECT module FROM hit) AND contains(name, 'frame') ORDER BY 3 DESC, name LIMIT 30""")
def gr13(spark, d):
    n, c = _nc(spark, d)
    m = n.select("name", F.regexp_replace("file_path", "/[^/]*$", "").alias("module"))
    hit = m.where(F.col("name").contains("parse_t")).select("module").distinct()
    out = m.join(hit, "module", "left_semi").where(F.col("name").contains("frame")).join(g.degrees(c), "name", "left")
    return out.select("name", "module", F.coalesce("out_degree", F.lit(0)).alias("out_degree")).orderBy(F.desc("out_degree"), "name").limit(30)


@q("GR14", f"""WITH {SQL_FUNCTIONS}, f AS (SELECT file_path, count(*) AS n, string_split(file_path, '/') AS p FROM functions WHERE contains(file_path, '/') GROUP BY file_path),
  x AS (SELECT array_to_string(p[1:i], '/') AS dir, n FROM (SELECT p, n, unnest(range(1, len(p))) AS i FROM f) z)
  SELECT dir, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') END AS parent, count(*) AS files, CAST(sum(n) AS BIGINT) AS functions FROM x GROUP BY dir""")
def gr14(spark, d):
    return g.directory_tree(functions(spark, d))


def _modules(spark, d):
    c, fn = materialize(calls(spark, d)), materialize(functions(spark, d).select("name", "file_path"))
    return c, fn, materialize(g.communities(c, fn))


@q("GR15")
def gr15(spark, d):
    return _modules(spark, d)[2]


@q("GR16")
def gr16(spark, d):
    c, fn, m = _modules(spark, d)
    return g.merge_small(m, c, functions=fn)


@q("GR17")
def gr17(spark, d):
    c, fn, m = _modules(spark, d)
    return g.module_names(materialize(g.merge_small(m, c, functions=fn)), nodes(spark, d), c)


_DIR = "regexp_replace(file_path, '/[^/]*$', '')"


@q("GR19", _G + """, a AS (SELECT dst AS name, string_agg(src, '|' ORDER BY src) AS callers FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM calls) z WHERE r <= 8 GROUP BY dst),
  b AS (SELECT src AS name, string_agg(dst, '|' ORDER BY dst) AS callees FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM calls) z WHERE r <= 8 GROUP BY src)
  SELECT name, callers, callees FROM a FULL JOIN b USING (name)""")
def gr19(spark, d):
    return g.neighbourhood(materialize(calls(spark, d)))


@q("GR20", f"""WITH {SQL_FUNCTIONS}, s AS (SELECT DISTINCT name, file_path FROM functions WHERE name LIKE 'parse\\_%' ESCAPE '\\'),
  n AS (SELECT name, file_path, sum(coalesce(fan_in, 0)) AS w FROM functions WHERE name IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT s.name AS symbol, n.name AS near, row_number() OVER (PARTITION BY s.name, s.file_path ORDER BY n.w DESC, n.name) AS r FROM s JOIN n ON n.file_path = s.file_path AND n.name <> s.name)
  SELECT DISTINCT symbol, f.file_path FROM (SELECT symbol, near FROM k WHERE r <= 2 UNION SELECT name, name FROM s) z JOIN (SELECT DISTINCT name, file_path FROM n) f ON f.name = z.near""")
def gr20(spark, d):
    fn = functions(spark, d).where("name IS NOT NULL")
    n = materialize(fn.groupBy("name", "file_path").agg(F.sum(F.coalesce("fan_in", F.lit(0))).alias("w")))
    s = n.where(F.col("name").startswith("parse_")).select(F.col("name").alias("symbol"), "file_path")
    each = g.strongest_in_file(s, n).union(s.select("symbol", "symbol")).distinct()
    return g.files_of_symbols(each, n.select("name", "file_path"))


@q("GR22", f"""{_G} SELECT CASE WHEN a.file_path = b.file_path THEN 0 WHEN split_part(a.file_path,'/',1)=split_part(b.file_path,'/',1) AND split_part(a.file_path,'/',2)=split_part(b.file_path,'/',2) AND split_part(a.file_path,'/',3)=split_part(b.file_path,'/',3) THEN 1
  WHEN split_part(a.file_path,'/',1)=split_part(b.file_path,'/',1) AND split_part(a.file_path,'/',2)=split_part(b.file_path,'/',2) THEN 2 WHEN split_part(a.file_path,'/',1)=split_part(b.file_path,'/',1) THEN 3 ELSE 4 END AS distance, count(*) AS n
  FROM calls JOIN nodes a ON a.name = src JOIN nodes b ON b.name = dst GROUP BY 1""")
def gr22(spark, d):
    n, c = _nc(spark, d)
    pa, pb = (n.select(F.col("name").alias(x), F.col("file_path").alias(y)) for x, y in (("src", "pa"), ("dst", "pb")))
    return g.module_distance(c.join(pa, "src").join(pb, "dst")).groupBy("distance").agg(F.count("*").alias("n"))


@q("AG1", _G + """ SELECT name, count(DISTINCT i.src) AS fan_in, count(DISTINCT o.dst) AS fan_out FROM nodes LEFT JOIN calls i ON i.dst = name LEFT JOIN calls o ON o.src = name GROUP BY name""")
def ag1(spark, d):
    n, c = _nc(spark, d)
    return g.fan_counts(n, c).select("name", "fan_in", "fan_out")


@q("AG2", _G + """ SELECT name, name NOT IN (SELECT src FROM calls) AS is_leaf, name NOT IN (SELECT src FROM calls) AND name NOT IN (SELECT dst FROM calls) AS is_orphan FROM nodes""")
def ag2(spark, d):
    n, c = _nc(spark, d)
    return g.fan_counts(n, c).select("name", "is_leaf", "is_orphan")


@q("AG3", f"""WITH {SQL_FUNCTIONS} SELECT count(*) AS n, CAST(sum(CASE WHEN fan_out = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaves, round(avg(fan_in), 6) AS mean_fan_in, max(fan_in) AS most FROM functions""")
def ag3(spark, d):
    fn = functions(spark, d)
    return fn.agg(F.count("*").alias("n"), F.sum(F.when(F.col("fan_out") == 0, 1).otherwise(0)).alias("leaves"), F.round(F.avg("fan_in"), 6).alias("mean_fan_in"), F.max("fan_in").alias("most"))


@q("AG4", f"WITH {SQL_CALLS}, {_DEG} SELECT name, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(degree AS BIGINT) AS degree FROM deg")
def ag4(spark, d):
    return g.degrees(calls(spark, d))


@q("AG6", _G + """, m AS (SELECT name, split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS module FROM nodes)
  SELECT a.module AS src_module, b.module AS dst_module, count(*) AS weight FROM calls JOIN m a ON a.name = src JOIN m b ON b.name = dst WHERE a.module <> b.module GROUP BY 1, 2""")
def ag6(spark, d):
    n, c = _nc(spark, d)
    m = n.select("name", F.substring_index("file_path", "/", 2).alias("module"))
    return g.module_calls(c, materialize(m))


@q("TK3", f"WITH {SQL_CALLS}, {_DEG} SELECT name, CAST(in_degree AS BIGINT) AS fan_in FROM deg ORDER BY in_degree DESC, name LIMIT 10")
def tk3(spark, d):
    return g.degrees(calls(spark, d)).orderBy(F.desc("in_degree"), "name").limit(10).select("name", F.col("in_degree").alias("fan_in"))


@q("TK6", f"WITH {SQL_CALLS}, {_DEG} SELECT name, CAST(in_degree * out_degree AS BIGINT) AS hub FROM deg ORDER BY 2 DESC, name LIMIT 20")
def tk6(spark, d):
    return g.degrees(calls(spark, d)).select("name", (F.col("in_degree") * F.col("out_degree")).alias("hub")).orderBy(F.desc("hub"), "name").limit(20)
