"""Cutting oversized bodies at natural boundaries.

A piece is found by one bounded-quantifier match at the place where its new
lines begin. The alternatives stand in the order of the boundaries' strength:
the rest of the text, a run of lines before a line that is too long, the last
blank line, the last line that begins with a closing brace, the last line
break. A line beyond the limit falls back to cuts by character. The overlap is
looked up backwards from the end of the piece before.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1500
OVERLAP_LINES = 2


@lru_cache(maxsize=4096)
def _tail(room: int, limit: int) -> re.Pattern:
    """The rest of the text within ``room``, or all lines that fit before an oversized one."""
    return re.compile(rf"(?s)(?P<rest>.{{1,{room}}}\Z)|(?P<wall>(?>.{{0,{room - 1}}}\n)(?=[^\n]{{{limit}}}.))")


@lru_cache(maxsize=16)
def _cut(limit: int) -> re.Pattern:
    return re.compile(
        rf"(?s)(?P<blank>.{{0,{limit}}}(?<![^\n])[^\S\n]*\n)"
        rf"|(?P<brace>.{{0,{limit}}}(?<![^\n])[^\S\n]*\}}[^\n]*\n)"
        rf"|(?P<line>.{{0,{limit}}}\n)"
    )


def pieces(body: str, limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of each piece; lines count from 1."""
    out = []
    n, start, new = len(body), 0, 0  # new: where the lines begin that no piece holds yet
    line_of_start, start_seen = 1, 0

    def put(a: int, b: int) -> None:
        nonlocal line_of_start, start_seen
        if a >= start_seen:
            line_of_start += body.count("\n", start_seen, a)
        else:
            line_of_start -= body.count("\n", a, start_seen)
        start_seen = a
        out.append((a, b, line_of_start, line_of_start + body.count("\n", a, b - 1)))

    while new < n:
        line_end = body.find("\n", new) + 1 or n
        if line_end - new > limit:
            for a in range(new, line_end, limit):
                put(a, min(a + limit, line_end))
            start = new = line_end
            continue
        if line_end - start > limit:
            start = new
        room = limit - (new - start)
        m = _tail(room, limit).match(body, new) or _cut(limit).match(body, new, start + limit)
        end = m.end()
        put(start, end)
        back = end
        for _ in range(overlap):
            if back > start:
                back = max(start, body.rfind("\n", start, back - 1) + 1)
        start, new = back, end
    return out


_PIECE = pa.struct([(c, pa.int64()) for c in ("char_start", "char_end", "first", "last")])


def _scan(limit: int, overlap: int):
    def run(batches):
        for b in batches:
            sizes, flat = [], []
            for body in b.column(2).to_pylist():
                p = pieces(body, limit, overlap)
                sizes.append(len(p))
                flat.extend(p)
            cols = np.array(flat, dtype=np.int64).reshape(-1, 4)
            values = pa.StructArray.from_arrays([pa.array(cols[:, k]) for k in range(4)], fields=list(_PIECE))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, values)], ["rf_id", "line", "pieces"]
            )

    return run


def split_bodies(functions: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> DataFrame:
    """Pieces of every body of more than ``limit`` code points.

    (rf_id, piece_no, char_start, char_end, first_line, last_line). Null and
    shorter bodies, and rows with a null rf_id, give no piece. A repeated rf_id
    counts once; should its rows differ, the smallest (start line, pieces)
    stands for it. Only offsets are shuffled, never bodies.
    """
    line = F.coalesce(F.nullif(F.col("start_line"), F.lit(0)), F.lit(1)).cast("long")
    cut = (
        functions.where(F.col("rf_id").isNotNull() & (F.length("body") > limit))
        .select(F.col("rf_id").cast("long").alias("rf_id"), line.alias("line"), "body")
        .mapInArrow(
            _scan(limit, overlap),
            "rf_id long, line long, pieces array<struct<char_start:long,char_end:long,first:long,last:long>>",
        )
    )
    once = cut.groupBy("rf_id").agg(F.min(F.struct("line", "pieces")).alias("u"))
    return once.select("rf_id", "u.line", F.posexplode("u.pieces").alias("k", "p")).select(
        "rf_id",
        (F.col("k") + 1).cast("long").alias("piece_no"),
        "p.char_start",
        "p.char_end",
        (F.col("line") + F.col("p.first") - 1).alias("first_line"),
        (F.col("line") + F.col("p.last") - 1).alias("last_line"),
    )
