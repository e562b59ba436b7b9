"""Vector functions and exact nearest neighbours of a query set.

The query set is taken in blocks of a bounded size; each block is one scan of
all vectors with a matrix product per batch, and only each batch's best rows
are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Floats of one block of queries that is sent to the executors (32 MB).
BLOCK_FLOATS = 8_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _scan(shared, k: int | None, least: float | None):
    def run(batches):
        ids, unit = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy()
            x = _unit(np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
            score = unit @ x.T
            if least is not None:
                score = np.where(score >= least - 1e-3, score, -np.inf)
            if k is None:
                q, c = np.nonzero(np.isfinite(score))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[c]), pa.array(score[q, c])], ["query", "id", "score"])
                continue
            keep = min(k + 1, len(own))
            top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            floor = np.take_along_axis(score, top, 1).min(axis=1)
            # scores are rounded later, so what may round up to the border is kept too
            q, c = np.nonzero((score >= floor[:, None] - 1e-4) & np.isfinite(score))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[c]), pa.array(score[q, c])], ["query", "id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int | None, id_col: str = "vec_id", vec_col: str = "embedding", least: float | None = None) -> DataFrame:
    """(query, id, score, rank): the ``k`` most similar other vectors of every query, ties by id.

    With ``least`` only scores from there on leave the scan; ``k`` may then be
    None, for all of them.

    Null vectors are left out; all vectors have one length.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long"), vec_col)
    scans, ids, block = None, [], []

    def flush():
        nonlocal scans, ids, block
        shared = spark.sparkContext.broadcast((np.array(ids, dtype=np.int64), _unit(np.array(block, dtype=np.float64))))
        s = rows.mapInArrow(_scan(shared, k, least), "query long, id long, score double")
        scans = s if scans is None else scans.unionByName(s)
        ids, block = [], []

    for row in queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long"), vec_col).toLocalIterator():
        ids.append(row[0])
        block.append(row[1])
        if len(block) * len(block[0]) >= BLOCK_FLOATS:
            flush()
    if block or scans is None:
        if not block:
            return spark.createDataFrame([], "query long, id long, score double, rank int")
        flush()
    best = scans.where("query <> id").withColumn("score", F.round("score", 4))
    if least is not None:
        best = best.where(F.col("score") >= least)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
