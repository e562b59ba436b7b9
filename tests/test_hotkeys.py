import random

import pytest

from codequarry.operators.hotkeys import latest_by_id, latest_where_repeated, median_and_top, per_name_fan_in

SCHEMA = "name string, fan_in int, id string"


def brute(rows):
    by = {}
    for name, fan, i in rows:
        if name is not None:
            by.setdefault(name, []).append((fan or 0, i.encode()))
    out = set()
    for name, xs in by.items():
        xs.sort()
        top = min(i for f, i in xs if f == xs[-1][0])
        out.add((name, xs[(len(xs) + 1) // 2 - 1][1].decode(), top.decode()))
    return out


@pytest.mark.parametrize("bound", [3, 40, 20_000])
def test_median_and_top_against_brute_force(spark, bound):
    r = random.Random(bound)
    rows = []
    for k in range(600):
        name = r.choice(["hot", "hot", "warm", None, "", "Ünï", f"rare{k}"])
        rows.append((name, r.choice([None, 0, 0, 0, 1, 5, r.randrange(50)]), f"src/{'a' * (k % 3)}é{k}:{name}"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {tuple(x) for x in median_and_top(df, "name", "fan_in", "id", bound).collect()}
    assert got == brute(rows)


def test_ids_that_are_prefixes_of_each_other(spark):
    rows = [("n", 0, "a" * k) for k in range(1, 60)]
    got = [tuple(x) for x in median_and_top(spark.createDataFrame(rows, SCHEMA), "name", "fan_in", "id", 2).collect()]
    assert got == [("n", "a" * 30, "a")]


def test_empty_table(spark):
    assert median_and_top(spark.createDataFrame([], SCHEMA), "name", "fan_in", "id").collect() == []


def test_latest_state_wins_whatever_arrives_last(spark):
    df = spark.createDataFrame(
        [("x", "n", 9, "2024-01-02", "2024-01-02"), ("x", "n", 1, "2024-01-01", "2024-03-01"), ("x", "n", 9, "2024-01-02", "2024-01-02"), (None, "n", 5, "2024-01-01", None)],
        "id string, name string, fan_in int, extracted_at string, ingested_at string",
    )
    got = latest_by_id(df, "id", ["extracted_at", "ingested_at"], df.columns).collect()
    assert [(x.id, x.fan_in) for x in got] == [("x", 9)]
    extra = df.withColumnRenamed("id", "id").selectExpr("*", "1 AS _key", "2 AS _v", "3 AS _n")
    assert [tuple(x) for x in per_name_fan_in(extra).collect()] == [("n", "x", "x")]


def test_values_of_any_range_and_many_hot_keys(spark, monkeypatch):
    import codequarry.session as session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    r = random.Random(9)
    far = [2**63 - 1, -(2**63), 0, -1, 1, 2**40, 2**40 + 1, -(2**40)]
    rows = [(f"k{k % 9}", r.choice([r.randrange(-50, 9000), r.choice(far)]), f"id{k:04d}") for k in range(900)]
    df = spark.createDataFrame(rows, "name string, fan_in long, id string").repartition(5)
    assert {tuple(x) for x in median_and_top(df, "name", "fan_in", "id", 6).collect()} == brute(rows)


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_only_repeated_ids_are_compared(spark, monkeypatch, words):
    import codequarry.operators.hotkeys as hotkeys

    monkeypatch.setattr(hotkeys, "MAP_WORDS", words)
    r = random.Random(4)
    rows = [(r.choice([None, f"i{r.randrange(300)}"]), r.choice([None, 1, 2]), r.randrange(5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "id string, v int, x int").repartition(4)
    plain = sorted(map(str, latest_by_id(df, "id", ["v"], ["id", "v", "x"]).collect()))
    assert sorted(map(str, latest_where_repeated(df, "id", ["v"], ["id", "v", "x"]).collect())) == plain
