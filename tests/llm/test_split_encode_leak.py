import base64
import random

import pytest

from codequarry.llm.encoding import VOCABULARY, PrefixEncoder, encode_texts
from codequarry.llm.leakage import Matcher, SuffixAutomaton, cut_leaks, leak_verdicts, leaked_items
from codequarry.llm.splitting import pieces, split_bodies
from codequarry.llm.text import tokens


def plain_pieces(body, limit):
    """The rules line by line, without patterns."""
    parts = body.split("\n")
    lines = [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x))
    out, new, first = [], 0, 0
    while new < len(lines):
        if len(lines[new]) > limit:
            for k in range(at[new], at[new + 1], limit):
                out.append((k, min(k + limit, at[new + 1]), new + 1, new + 1))
            new += 1
            first = new
            continue
        if at[new + 1] - at[first] > limit:
            first = new
        end = new
        while end < len(lines) and at[end + 1] - at[first] <= limit:
            end += 1
        if end < len(lines) and len(lines[end]) <= limit:
            own = range(new, end)
            blank = [j for j in own if not lines[j].strip()]
            brace = [j for j in own if lines[j].strip().startswith("}")]
            end = (blank or brace or [end - 1])[-1] + 1
        out.append((at[first], at[end], first + 1, end))
        first, new = max(first, end - 2), end
    return out


def test_pieces_against_the_rules_line_by_line():
    r = random.Random(4)
    for _ in range(4000):
        body = "".join(r.choice(["a", "b\n", "  }\n", "\n", " \n", "é" * 8, "\r\n", "y" * 24 + "\n", "}"]) for _ in range(r.randrange(40)))
        for limit in (5, 20, 21):
            assert pieces(body, limit) == (plain_pieces(body, limit) if body else [])


def test_split_bodies_edge_rows(spark):
    long = "x = 1;\n" * 400
    rows = [(1, 0, long, "c"), (1, 0, long, "c"), (2, None, "short", "c"), (3, 7, None, "c"), (4, 7, "", "c"), (None, 1, long, "c"), (5, 10, "z" * 4000, "c")]
    df = spark.createDataFrame(rows, "rf_id long, start_line int, body string, piece_no string")
    got = split_bodies(df).orderBy("rf_id", "piece_no").collect()
    assert {x.rf_id for x in got} == {1, 5}
    assert [(x.char_start, x.char_end, x.first_line, x.last_line) for x in got if x.rf_id == 5] == [(0, 1500, 10, 10), (1500, 3000, 10, 10), (3000, 4000, 10, 10)]
    assert [(x.char_start, x.char_end, x.first_line, x.last_line) for x in got if x.rf_id == 1] == pieces(long)
    assert split_bodies(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return PrefixEncoder(f.read())


@pytest.fixture(scope="module")
def merges():
    """The same vocabulary, merged by a public library."""
    import os

    import tiktoken

    where = os.path.join(os.path.dirname(VOCABULARY), "byte_bpe_50k.tiktoken")
    with open(where, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids_against_merging(encoder, merges):
    r = random.Random(1)
    units = ["a", "b", "the", "in", "é", "中", " ", "  ", "\n", "ing", "er", "0", "!", "\x1c", "🚀", "s", "'", "<|endoftext|>", "ا", "​", "aaaa"]
    for _ in range(2000):
        text = "".join(r.choice(units) for _ in range(r.randrange(60)))
        assert encoder(text) == merges(text)


def test_ids_of_every_document(spark, sf, merges):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {x.doc_id: merges(x.text) if x.text else [] for x in docs.select("doc_id", "text").collect()}
    assert {x.doc_id: list(x.ids) for x in encode_texts(docs).collect()} == want


def test_ids_of_odd_texts(spark, encoder):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a" * 100_000, 1), (3, " \n", 1)], "doc_id long, text string, ids int")
    got = sorted((x.doc_id, len(x.ids)) for x in encode_texts(df).collect())
    assert got[:2] == [(1, 0), (2, 0)] and got[3] == (3, len(encoder("a" * 100_000)))
    assert encode_texts(df.limit(0)).collect() == []


def runs(a, b, n):
    have = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
    return any(tuple(b[k : k + n]) in have for k in range(len(b) - n + 1))


def test_automaton_against_all_runs():
    r = random.Random(2)
    for n in (2, 3, 5):
        items = [(k, [r.choice("abc") for _ in range(r.randrange(12))]) for k in range(12)]
        built = SuffixAutomaton(n)
        for k, t in items:
            built.add(k, t)
        auto = Matcher.load(built.packed())
        for _ in range(200):
            doc = [r.choice("abcd") for _ in range(r.randrange(20))]
            leaks = auto.leaks(doc)
            assert set(leaks) == {k for k, t in items if runs(t, doc, n)}
            for k, t in items:
                held = {tuple(t[j : j + n]) for j in range(len(t) - n + 1)}
                cover = {i + j for i in range(len(doc) - n + 1) if tuple(doc[i : i + n]) in held for j in range(n)}
                assert {x for a, b, _ in leaks.get(k, []) for x in range(a, b)} == cover
            long = [m for m in range(1, 13) for _, t in items if len(t) >= n and runs(t, doc, m)]
            assert auto.longest(doc) == max(long, default=0)


@pytest.mark.parametrize("block", [40, 1_000_000])
def test_leaks_in_blocks(spark, sf, block):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "eval_items"))
    held = [(x.item_id, tokens(t)) for x in items.limit(60).collect() for t in (x.question, x.reference_answer)]
    want = {(d.doc_id, k) for d in docs.collect() for k, t in held if runs(t, tokens(d.text), 15)}
    sub = items.where(items.item_id.isin([k for k, _ in held]))
    got = leaked_items(docs, sub, block=block * 60 if block == 40 else block)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    assert leaked_items(docs, items.limit(0)).collect() == []


def test_verdicts(spark):
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, "pre " + words.upper() + " post"), (2, "x"), (3, None), (4, " ".join(words.split()[:16]) + " z" * 400)], "doc_id long, text string")
    items = spark.createDataFrame([(7, words, None), (None, words, words)], "item_id long, question string, reference_answer string")
    got = {x.doc_id: tuple(x)[1:] for x in leak_verdicts(docs, items).collect()}
    assert got == {1: (42, 40, 40, [(1, 41)], True), 4: (416, 16, 16, [(0, 16)], False)}


def test_results_do_not_depend_on_blocks(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "eval_items"))
    # eleven percent of each of two items: above the limit only together
    own = [(k, " ".join(f"i{k}_{j}" for j in range(40)), None) for k in (1, 2)]
    both = " ".join(own[0][1].split()[:22]) + " z" * 156 + " " + " ".join(own[1][1].split()[:22])
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, both)], "doc_id long, text string"))
    items = items.limit(25).select("item_id", "question", "reference_answer").unionByName(spark.createDataFrame([(-k, q, a) for k, q, a in own], "item_id long, question string, reference_answer string"))
    one, many = ({tuple(map(str, x)) for x in leak_verdicts(docs, items, block=b).collect()} for b in (1_000_000, 120))
    assert one == many and any(x[0] == "-1" and x[-1] == "True" for x in one)


def test_passages_and_what_is_cut(spark):
    item = [f"t{k}" for k in range(60)]
    a, b = " ".join(item[:18]), " ".join(item[30:50])
    clean = " ".join(f"c{k}" for k in range(500))
    docs = [(1, f"Head {a}, {clean} {b}!"), (2, clean), (3, None), (4, " ".join(item)), (5, f"É “{a.upper()}” ﬁn {clean}"), (6, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item), "")], "item_id long, question string, reference_answer string")
    got = {x.doc_id: x.spans for x in leaked_items(df, items).collect()}
    assert got[1] == [(1, 19), (519, 539)] and set(got) == {1, 4, 5}
    left = {x.doc_id: x.text for x in cut_leaks(df, items).collect()}
    assert left == {1: f"Head , {clean} !", 2: clean, 3: None, 5: f"É “” ﬁn {clean}", 6: ""}
