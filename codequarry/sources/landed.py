"""Answers of external services that were landed as JSON: symbol trees and issue pages."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbol kinds of the language server protocol that count (fixed values); enums are no functions.
FUNCTION_KINDS = {6: "method", 9: "constructor", 12: "function"}
CLASS_KINDS = {5: "class", 23: "struct"}
VARIABLE_KINDS = {8: "field", 13: "variable", 14: "constant"}
_KINDS = FUNCTION_KINDS | CLASS_KINDS | VARIABLE_KINDS


def _flatten(file_path: str, tree: str | None) -> list[tuple]:
    try:
        stack = [(s, None) for s in reversed(json.loads(tree or "[]"))]
    except (ValueError, TypeError):
        return []
    out = []
    while stack:
        s, parent = stack.pop()
        if not isinstance(s, dict):
            continue
        kind, name, span = _KINDS.get(s.get("kind")), s.get("name"), s.get("range") or {}
        start, end = (span.get(k, {}).get("line") for k in ("start", "end"))
        if kind and name and start is not None:
            out.append((file_path, name, kind, s.get("detail"), start + 1, (end if end is not None else start) + 1, parent))
        inner = name if s.get("kind") in CLASS_KINDS else parent
        stack.extend((c, inner) for c in reversed(s.get("children") or []))
    return out


def symbols(trees: DataFrame) -> DataFrame:
    """(file_path, name, kind, signature, start_line, end_line, parent_class) of symbol trees (file_path, tree).

    Lines count from 1. A tree that is no JSON gives no rows; symbols without a
    name, a place or a known kind are left out, their children are kept.
    """
    names = ["file_path", "name", "kind", "signature", "start_line", "end_line", "parent_class"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in _flatten(p, t)]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    schema = "file_path string, name string, kind string, signature string, start_line long, end_line long, parent_class string"
    return trees.select("file_path", "tree").mapInArrow(run, schema)


_ISSUE = "array<struct<number:int,title:string,body:string,state:string,created_at:string,pull_request:struct<url:string>>>"


def issue_pages(pages: DataFrame, repository: str | Column) -> DataFrame:
    """(id, number, title, body, state, created_at) of landed pages (page, body), pull requests left out.

    ``repository`` is the pages' repository or a column with it.

    An issue that moved between two fetched pages counts once, from the later page.
    """
    repo = F.lit(repository) if isinstance(repository, str) else repository
    each = pages.select(repo.alias("repo"), "page", F.explode(F.from_json("body", _ISSUE)).alias("i")).where("i.pull_request IS NULL AND i.number IS NOT NULL")
    last = each.groupBy("repo", "i.number").agg(F.max_by("i", "page").alias("i"))
    return last.select(
        F.concat("repo", F.lit("#i"), F.col("i.number").cast("string")).alias("id"), "i.number", "i.title", "i.body", "i.state",
        F.col("i.created_at").try_cast("timestamp_ntz").alias("created_at"),
    )
