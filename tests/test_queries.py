"""Every registered query of the core against the SQL engine, on the smallest tables."""

import ast
import math
import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

QUERIES = {k: f for k, f in entry.queries().items() if getattr(f, "__module__", "").startswith("codequarry.plans")}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def value(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(value, r)) for r in df[cols].itertuples(index=False, name=None)), key=repr)


def python_symbols(got, duck):
    want = []
    for i, body in duck.sql("SELECT rf_id, any_value(body) FROM retrieved_functions WHERE ends_with(file_path, '.py') AND body IS NOT NULL AND rf_id IS NOT NULL GROUP BY 1").fetchall():
        try:
            tree = ast.parse(body)
        except (SyntaxError, ValueError):
            continue
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                want.append((i, n.name, n.lineno))
            elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
                name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr
                want += [(i, name, n.lineno)] * (not name.startswith("_"))
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                want += [(i, a.name, n.lineno) for a in n.names]
    assert sorted(zip(got["rf_id"], got["name"], got["line"])) == sorted(want)


def function_spans(got, duck):
    body = dict(duck.sql("SELECT rf_id, any_value(body) FROM retrieved_functions WHERE body IS NOT NULL AND rf_id IS NOT NULL GROUP BY 1").fetchall())
    assert len(got) > 50
    for x in got.itertuples():
        text = body[x.rf_id].split("\n")[x.first_line - 1 : x.last_line]
        assert x.name in text[0] and "(" in text[0] and not text[0].rstrip().endswith(";")
        assert sum(t.count("{") - t.count("}") for t in text) <= 0 < sum(t.count("{") for t in text)


def hits_by_source(got, duck):
    n = duck.sql("SELECT u.source, count(*) FROM (SELECT unnest(rf) AS u FROM (SELECT result_id, any_value(retrieved_functions) AS rf FROM qa_results WHERE result_id IS NOT NULL GROUP BY 1) z) y GROUP BY 1").fetchall()
    report = got["report"][0]
    assert len(got) == 1 and all(re.search(rf"\b{s}\b.*\b{k}\b", report) for s, k in n if s)


def modules(got, duck):
    names = duck.sql("SELECT DISTINCT name FROM function_nodes WHERE name IS NOT NULL UNION SELECT u.name FROM (SELECT unnest(retrieved_functions) AS u FROM qa_results) z WHERE u.name IS NOT NULL").fetchall()
    assert got["name"].is_unique and {n for n, in names} >= set(got["name"]) >= {n for n, in duck.sql("SELECT DISTINCT name FROM function_nodes WHERE name IS NOT NULL").fetchall()}
    assert set(got["module"]) <= set(got["name"])


def merged_modules(got, duck):
    modules(got, duck)
    assert got.groupby("module").size().min() >= 10


def named_modules(got, duck):
    assert got["module"].is_unique and got["module_name"].is_unique and got["module_name"].str.startswith("mod_").all()


def grep_code(got, duck):
    assert got["file_path"].is_unique and len(got)
    bodies = duck.sql("SELECT file_path, string_agg(body, chr(10)) FROM retrieved_functions WHERE file_path IS NOT NULL AND body IS NOT NULL GROUP BY 1").fetchall()
    said = dict(bodies)
    assert all("throw " in said[x.file_path] and x.text.split("\n")[0].strip() in said[x.file_path] for x in got.itertuples())


#: What the rows of a query that no SQL gives must hold.
CHECKS = {"EX4": python_symbols, "EX5": function_spans, "SNK8": hits_by_source, "GR15": modules, "GR16": merged_modules, "GR17": named_modules, "RT20_code": grep_code}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.sql(SQL[name]).df())
    else:
        CHECKS[name](got, duck)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(entry.queries())
    assert entry.entry is not None
