"""Near-duplicate pairs by a blocked sparse product of documents and shingles.

The product of the document-by-shingle matrix with its transpose counts the
shingles that two documents share. Only the entries are formed that can reach
the similarity: each document keeps the columns of a prefix in an order from
rare to frequent, entries are skipped whose sizes and places bound the overlap
below what is needed, and pairs whose count stays below the prefix's own bound
are dropped before the exact overlap is taken. All bounds are exact, so no pair
is lost; the order only decides how many entries are formed.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.text import TokenHasher, shingles, tokens
from codequarry.session import join_on_keys, materialize

#: Counters of the frequency sketch by which shingles are ordered: a fixed size,
#: whatever the corpus. It may only cost time where shingles share a counter.
SKETCH_BITS = 22
SKETCH_SLICES = 64
#: Documents of one shingle that meet in one task; longer columns are cut into blocks.
BLOCK_ROWS = 512
#: Shared shingles asked of two prefixes, as a share of the smaller document.
SLACK = 0.05


def _shingled(width: int, min_tokens: int):
    def run(batches):
        hasher = TokenHasher()
        for b in batches:
            ids, sigs, sets = [], [], []
            for doc, title, body in zip(*(b.column(k).to_pylist() for k in range(3))):
                toks = tokens((title or "") + "\n" + (body or ""))
                if len(toks) < min_tokens:
                    continue
                s = shingles(hasher(toks), width)
                ids.append(doc)
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sets.append(s)
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                ["id", "sig", "grams"],
            )

    return run


def _count_slices(batches):
    """Partial counters of this partition, as slices."""
    size = 1 << SKETCH_BITS
    total = np.zeros(size, dtype=np.int64)
    for b in batches:
        total += np.bincount(b.column(0).flatten().to_numpy() & (size - 1), minlength=size)
    for k, part in enumerate(total.reshape(SKETCH_SLICES, -1)):
        at = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([at.astype("<i4").tobytes()]), pa.array([part[at].astype("<i8").tobytes()])],
            ["slice", "at", "n"],
        )


def _add_slices(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_SLICES, dtype=np.int64)
    for at, n in zip(pdf["at"], pdf["n"]):
        total[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "n": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})


def frequency_sketch(sets: DataFrame) -> bytes:
    """How many documents hold the shingles of each counter (fixed size, int32)."""
    parts = sets.select("grams").mapInArrow(_count_slices, "slice int, at binary, n binary")
    rows = parts.groupBy("slice").applyInPandas(_add_slices, "slice int, n binary").collect()  # SKETCH_SLICES rows
    by = {r["slice"]: bytes(r["n"]) for r in rows}
    empty = b"\0" * (4 * (1 << SKETCH_BITS) // SKETCH_SLICES)
    return b"".join(by.get(k, empty) for k in range(SKETCH_SLICES))


def _prefixes(shared, threshold: Fraction):
    def run(batches):
        counts = np.frombuffer(shared.value, "<i4")
        mask = len(counts) - 1
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for doc, g in zip(b.column(0).to_numpy(), b.column(1)):
                g = g.values.to_numpy()
                n = len(g)
                k = max(1, int(SLACK * n))
                keep = n - -(-threshold.numerator * n // threshold.denominator) + k
                freq = counts[g & mask]
                order = np.lexsort((g, freq))[:keep]
                place = np.flatnonzero(freq[order] > 1)  # a counter of 1 is a shingle of one document
                # a partner of at least this size shares more, so here a shorter prefix suffices
                both = threshold.numerator + threshold.denominator
                short = n - -(-2 * threshold.numerator * n // both) + k
                for c, x in zip(cols, (g[order[place]], doc, n, place + 1, k, place < short)):
                    c.append(x if isinstance(x, np.ndarray) else np.full(len(place), x))
            flat = [np.concatenate(c) if c else np.empty(0) for c in cols]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(t.to_pandas_dtype()), t) for f, t in zip(flat, kinds)], ["gram", "doc", "n", "place", "k", "short"])

    return run


def similar_classes(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b) of all pairs of different shingle sets (doc long, grams array<long>) of at least the similarity."""
    spark = sets.sparkSession
    shared = spark.sparkContext.broadcast(frequency_sketch(sets))
    post = materialize(
        sets.select("doc", "grams").mapInArrow(_prefixes(shared, threshold), "gram long, doc long, n int, place int, k int, short boolean")
    )
    long = post.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_ROWS)
    long = materialize(long.select("gram", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("nb")))
    cells = post.withColumns({"lo": F.lit(0), "hi": F.lit(0), "own": F.lit(0)})
    if long.take(1):
        # at most |postings| / BLOCK_ROWS columns are that long; a pair meets in exactly one cell
        blocked = post.join(long, "gram").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("nb")).cast("int"))
        blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        blocked = blocked.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        cells = (
            post.join(long.select("gram"), "gram", "left_anti")
            .withColumns({"lo": F.lit(0), "hi": F.lit(0), "own": F.lit(0)})
            .unionByName(blocked.select(*cells.columns))
        )
    num, den = threshold.numerator, threshold.denominator
    # the smaller document of a pair stands left, with its short prefix only
    a = cells.where("short").select("gram", "lo", "hi", *[F.col(c).alias(f"{c}1") for c in ("doc", "n", "place", "k", "own")])
    b = cells.select("gram", "lo", "hi", *[F.col(c).alias(f"{c}2") for c in ("doc", "n", "place", "k", "own")])
    most = F.least("place1", "place2") + F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2"))
    product = (
        a.join(b, ["gram", "lo", "hi"])
        .where(
            ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("doc1") < F.col("doc2"))))
            & ((F.col("own1") != F.col("own2")) | (F.col("lo") == F.col("hi")))
            & (F.col("n1") * den >= F.col("n2") * num)
            & (most * (num + den) >= (F.col("n1") + F.col("n2")) * num)
        )
        .groupBy("doc1", "doc2")
        .agg(F.count("*").alias("shared"), F.min("k1").alias("least"))
        .where(F.col("shared") >= F.col("least"))
        .select("doc1", "doc2")
    )
    left = sets.select(F.col("doc").alias("doc1"), F.col("grams").alias("g1"))
    right = sets.select(F.col("doc").alias("doc2"), F.col("grams").alias("g2"))
    both = F.size(F.array_intersect("g1", "g2"))
    return (
        materialize(product)
        .join(left, "doc1")
        .join(right, "doc2")
        .where(both * (num + den) >= (F.size("g1") + F.size("g2")) * num)
        .select(F.col("doc1").alias("a"), F.col("doc2").alias("b"))
    )


def _classes(items: DataFrame, id_col: str, title_col: str, body_col: str, threshold: Fraction, width: int, min_tokens: int) -> tuple[DataFrame, DataFrame]:
    """The classes of equal shingle sets: (id, doc) of every item, and (a, b) of the classes that are similar."""
    rows = materialize(
        items.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(title_col), F.col(body_col))
        .mapInArrow(_shingled(width, min_tokens), "id string, sig binary, grams array<long>")
    )
    sets = materialize(
        rows.groupBy("sig").agg(F.first("grams").alias("grams")).withColumn("doc", F.monotonically_increasing_id())
    )
    member = rows.groupBy("id").agg(F.min("sig").alias("sig"))
    member = materialize(member.join(sets.select("sig", "doc"), "sig").select("id", "doc"))
    return member, similar_classes(sets, threshold)


def _celled(member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their cell (own, nb), and (doc, nb) of the classes that are cut into several."""
    large = member.groupBy("doc").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_ROWS)
    large = materialize(large.select("doc", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("nb")))
    celled = join_on_keys(member, large, ["doc"], "id", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    return celled.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")), large


def near_duplicate_pairs(
    items: DataFrame, id_col: str = "id", title_col: str = "title", body_col: str = "body",
    threshold: Fraction = Fraction(3, 5), width: int = 3, min_tokens: int = 80,
) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all items whose shingle sets reach the Jaccard ``threshold``.

    Null titles and bodies count as empty; items of fewer than ``min_tokens``
    tokens and rows with a null id are left out. A repeated id counts once; if
    its rows differ, the smallest shingle signature stands for it. Items with
    the same shingle set are one class during the search, so a group of copies
    costs nothing but its own result rows. A class of more than ``BLOCK_ROWS``
    items is written out in cells, so no task holds all of its pairs.
    """
    member, pairs = _classes(items, id_col, title_col, body_col, threshold, width, min_tokens)
    celled, large = _celled(member)

    def expanded(df: DataFrame, doc: str, out: str) -> DataFrame:
        cells = join_on_keys(df, large.withColumnRenamed("doc", doc), [doc], "b" if doc == "a" else "ia", "left")
        cells = cells.withColumn("own", F.explode(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1))).drop("nb")
        return cells.join(celled.select(F.col("doc").alias(doc), "own", F.col("id").alias(out)), [doc, "own"]).drop("own")

    x = expanded(expanded(pairs, "a", "ia"), "b", "ib")
    between = x.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    many = member.groupBy("doc").agg(F.count("*").alias("m")).where(F.col("m") > 1).select("doc")
    again = celled.join(many, "doc", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    again = again.select("doc", "id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    side = lambda k: again.select("doc", "lo", "hi", F.col("id").alias(f"id_{k}"), F.col("own").alias(f"own_{k}"))
    within = side("a").join(side("b"), ["doc", "lo", "hi"])
    within = within.where((F.col("id_a") < F.col("id_b")) & ((F.col("own_a") != F.col("own_b")) | (F.col("lo") == F.col("hi"))))
    return between.unionByName(within.select("id_a", "id_b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node of ``links`` (a long, b long).

    Every round hands the smallest label among the neighbours on and then jumps
    to the label's own label, until no label changes.
    """
    ends = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = materialize(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    while True:
        heard = ends.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        step = label.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        step = materialize(step)
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = materialize(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        label = new.select("node", "root")
        if not new.where("root <> was").take(1):
            return label


def near_duplicate_groups(
    items: DataFrame, id_col: str = "id", title_col: str = "title", body_col: str = "body",
    threshold: Fraction = Fraction(3, 5), width: int = 3, min_tokens: int = 80,
) -> DataFrame:
    """(id, group_id, n_links): one row per item that has near-duplicates.

    Groups are the connected components of the links; ``group_id`` is the
    smallest id of the group, ``n_links`` the number of items that are similar
    to the item itself. Copies are never written out as pairs.
    """
    member, pairs = _classes(items, id_col, title_col, body_col, threshold, width, min_tokens)
    size = materialize(member.groupBy("doc").agg(F.count("*").alias("m"), F.min("id").alias("least")))
    # a class of which no item is left (its items had another set too) links none
    for end in ("a", "b"):
        pairs = pairs.join(size.select(F.col("doc").alias(end)), end, "left_semi")
    pairs = materialize(pairs)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size.select(F.col("doc").alias("b"), "m"), "b").groupBy(F.col("a").alias("doc")).agg(F.sum("m").alias("linked"))
    classes = size.join(near, "doc", "left").join(components(pairs).withColumnRenamed("node", "doc"), "doc", "left")
    classes = materialize(classes.select("doc", "least", F.coalesce("root", "doc").alias("root"), (F.col("m") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    group = classes.groupBy("root").agg(F.min("least").alias("group_id"))
    known = materialize(classes.where("n_links > 0").join(group, "root").select("doc", "group_id", "n_links"))
    return join_on_keys(member, known, ["doc"], "id").select("id", "group_id", "n_links")
