"""Registered queries of the training-data operators."""

from __future__ import annotations

from codequarry.llm.encoding import encode_texts
from codequarry.llm.leakage import leak_verdicts, leaked_items
from codequarry.llm.overlap import near_duplicate_groups, near_duplicate_pairs
from codequarry.llm.pairs import defective_pairs
from codequarry.llm.provenance import not_hand_written
from codequarry.llm.residue import residue_bodies
from codequarry.llm.sentences import sentence_units
from codequarry.llm.splitting import split_bodies
from codequarry.session import table


def p1_found(spark, d):
    return not_hand_written(table(spark, d, "retrieved_functions"))


def p2_found(spark, d):
    return residue_bodies(table(spark, d, "issues"))


def p3_found(spark, d):
    return split_bodies(table(spark, d, "retrieved_functions"))


def p4_found(spark, d):
    return defective_pairs(table(spark, d, "qa_results"))


def p6_found(spark, d):
    return near_duplicate_pairs(table(spark, d, "issues"))


def p6_groups(spark, d):
    return near_duplicate_groups(table(spark, d, "issues"))


def p7_ids(spark, d):
    return encode_texts(table(spark, d, "documents"))


def p8_found(spark, d):
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_verdicts(spark, d):
    return leak_verdicts(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark, d):
    return sentence_units(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p6_found, p6_groups, p7_ids, p8_found, p8_verdicts, p9_found)}
#: None of these is expressible in the SQL engine (NFKC, byte-pair merges, piece-by-piece state); see tests/llm.
ORACLE: dict[str, str] = {}
