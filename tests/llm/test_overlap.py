import random
from fractions import Fraction

import pytest

import codequarry.llm.overlap as overlap
from codequarry.llm.overlap import components, near_duplicate_groups, near_duplicate_pairs
from codequarry.llm.text import tokens


def brute(rows, threshold, width, least):
    sets = {}
    for i, t, b in rows:
        k = tokens((t or "") + "\n" + (b or ""))
        if i is not None and len(k) >= least:
            sets[i] = {tuple(k[j : j + width]) for j in range(len(k) - width + 1)}
    ids = sorted(sets)
    return {
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= threshold
    }


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    base = [[r.choice(words) for _ in range(r.randrange(20, 60))] for _ in range(25)]
    for k in range(160):
        t = list(r.choice(base))
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.3:
            t = t[len(t) // 2 :] + t[: len(t) // 2]
        rows.append((f"o/r#i{k}", " ".join(t[:3]), " ".join(t[3:])))
    rows += [("copy1", "t", rows[0][2]), ("copy2", "t", rows[0][2]), ("copy1", "t", rows[0][2])]
    rows += [("n1", None, rows[1][2]), ("n2", rows[1][2], None), (None, "x", rows[1][2]), ("e", "", ""), ("z", None, None)]
    return rows


def test_pairs_against_brute_force(spark, monkeypatch):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "id string, title string, body string").repartition(3)
    for threshold in (Fraction(3, 5), Fraction(4, 5)):
        got = [tuple(x) for x in near_duplicate_pairs(df, threshold=threshold, min_tokens=10).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, threshold, 3, 10)


def test_long_columns_are_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK_ROWS", 4)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "id string, title string, body string").repartition(3)
    got = [tuple(x) for x in near_duplicate_pairs(df, min_tokens=10).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, Fraction(3, 5), 3, 10)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, title string, body string")
    assert near_duplicate_pairs(df).collect() == []


@pytest.mark.parametrize("rows_a_block", [4, 512])
def test_groups_against_the_pairs(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(overlap, "BLOCK_ROWS", rows_a_block)
    rows = corpus(3) + [(f"many{k}", "t", corpus(3)[0][2]) for k in range(30)]
    df = spark.createDataFrame(rows, "id string, title string, body string").repartition(3)
    pairs = {tuple(x) for x in near_duplicate_pairs(df, min_tokens=10).collect()}
    assert pairs == brute(rows, Fraction(3, 5), 3, 10)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for i in sorted(near):
        if i not in want:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = i
                    todo += near[x]
    got = near_duplicate_groups(df, min_tokens=10).collect()
    assert {x.id: (x.group_id, x.n_links) for x in got} == {i: (g, len(near[i])) for i, g in want.items()} and len(got) == len(want)
    assert near_duplicate_groups(df.limit(0)).collect() == []


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 120, 1) if k % 40 != 39] + [(500, 400), (400, 450), (7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {k: k // 40 * 40 for k in range(120)} | {400: 400, 450: 400, 500: 400}
