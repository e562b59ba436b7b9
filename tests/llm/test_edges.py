"""Clashing extra columns, very long texts, repeated rows and nulls for all operators."""

import pytest
from pyspark.sql import functions as F

from codequarry.llm import queries
from codequarry.llm.encoding import encode_texts
from codequarry.llm.leakage import leaked_items
from codequarry.llm.overlap import near_duplicate_pairs
from codequarry.llm.provenance import not_hand_written
from codequarry.llm.sentences import sentence_units
from codequarry.llm.splitting import pieces, split_bodies

CLASHES = ["doc", "item", "grams", "sig", "gram", "n", "k", "votes", "pieces", "line", "u", "p", "path", "repo", "kinds", "hash", "chars", "text2", "ids2", "row", "a", "b"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_extra_columns_and_repeated_rows_change_nothing(spark, sf, tmp_path, name):
    for t in ("documents", "eval_items", "issues", "qa_results", "retrieved_functions"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        once = t in ("documents", "eval_items")  # their keys are unique
        clashing(df if once else df.unionByName(df)).write.parquet(str(tmp_path / f"{t}.parquet"))
    plain = sorted(map(str, queries.QUERIES[name](spark, sf).collect()))
    assert sorted(map(str, queries.QUERIES[name](spark, str(tmp_path)).collect())) == plain
    assert len(plain) == len(set(plain)) or name == "p7_ids"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "eval_items", "issues", "qa_results", "retrieved_functions"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_very_long_texts(spark):
    words = " ".join(f"w{k % 5000}" for k in range(200_000))
    code = "\n".join(f"    call_{k}(x);" for k in range(60_000))
    got = split_bodies(spark.createDataFrame([(1, 0, code)], "rf_id long, start_line int, body string"))
    assert got.count() == len(pieces(code))
    docs = spark.createDataFrame([(1, words), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(words.split()[777:800]), None)], "item_id long, question string, reference_answer string")
    assert [(x.doc_id, x.item_id) for x in leaked_items(docs, items).collect()] == [(1, 5)]
    assert encode_texts(docs).where("doc_id = 1").first().ids[:1] != []
    assert sentence_units(docs).count() == 1
    pair = spark.createDataFrame([("a", "t", words), ("b", "t", words + " more")], "id string, title string, body string")
    assert [tuple(x) for x in near_duplicate_pairs(pair).collect()] == [("a", "b")]
    big = spark.createDataFrame([("a.js", "x" * 3_000_000), ("b.cc", "\n" * 100_000)], "file_path string, body string")
    assert not_hand_written(big).count() == 0
