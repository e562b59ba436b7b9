"""Scopes of questions: results against SQL and plain search, and how much is shuffled for them."""

import random

import duckdb
from pyspark.sql import functions as F

from codequarry.operators import retrieval
from codequarry.plans import agents


def moved(spark, run):
    """The result of ``run``, and the rows and bytes that its stages shuffled."""
    store, jvm, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm, spark.sparkContext._gateway

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return [sum(f(stages.apply(i)) for i in range(stages.size())) for f in (lambda x: x.shuffleWriteRecords(), lambda x: x.shuffleWriteBytes())]

    before = written()
    result = run()
    return result, *(b - a for a, b in zip(before, written()))


def test_files_of_a_section_are_not_repeated_by_question(spark):
    r = random.Random(11)
    letters = lambda i: "".join("abcdefghij"[int(x)] for x in f"{i:04}")
    words = [letters(i) for i in range(24)]
    files = [f"src/{w}/f{i}.h" for w in words for i in range(30)] + ["z/last.py", "a/First.py", "a/Zeroth.py"]
    # repeated ids, words that lead nowhere, paths that are no files, sections without a title or text
    sections = [(k, " ".join(words[8 * k : 8 * k + 8]), f"see a/First.py, z/last.py and no/such{k}.cpp") for k in range(3)]
    sections += [(0, "nowhere abc", "src/aaai/f9.h twice src/aaai/f9.h"), (3, "", "plain"), (4, "nowhere", None), (5, None, "z/last.py"), (None, words[0], "z/last.py")]
    asked = [f"question {i}" + r.choice(["", " on a/Zeroth.py and z/last.py", " on no/such.py"]) for i in range(300)]
    top = [(x, k) for x in asked[:290] for k in r.sample(range(3), 2) + [r.randrange(3, 6)]] + [("gone", None)]
    run = lambda: retrieval.planned_scope(
        spark.createDataFrame([(x,) for x in asked], "question string"),
        spark.createDataFrame(top, "question string, id long"),
        spark.createDataFrame(sections, "id long, title string, text string"),
        spark.createDataFrame([(x,) for x in files + files[:9]], "file_path string"),
    ).collect()
    got, rows, _ = moved(spark, run)
    led = {w: sorted(x for x in files if w in x.lower().replace(".", "/").split("/"))[:20] for w in words}
    of = {}
    for k, title, text in sections:
        said = {x for x in files if text and x in text.replace(",", "").split()}
        of.setdefault(k, set()).update(said, *(led.get(w, []) for w in (title or "").split()))
    want = set()
    for x in asked:
        every = {y for q, k in top if q == x and k is not None for y in of[k]} | {y for y in files if y in x.split()}
        want |= {(x, y) for y in sorted(every)[:20]}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    # 300 questions, of whose best sections two lead to 160 files each
    assert rows < 12_000


def test_states_of_functions_are_not_shuffled_for_their_paths(spark, tmp_path):
    r = random.Random(7)
    at = lambda: None if r.random() < 0.1 else f"2024-01-0{r.randrange(1, 4)} 00:00:00"
    long = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(300))
    place = lambda i: r.choice([f"src/lock/f{i % 97}.h", f"lib/graph/g{i % 89}.cpp", None])
    ids = [*range(2000), *range(60), *range(60), *[None] * 5]
    rows = [(None if i is None else f"id{i}", r.choice("abc") + str(k), long(), place(i or 0), at(), at()) for k, i in enumerate(ids)]
    fn = spark.createDataFrame(rows, "id string, name string, signature string, file_path string, extracted_at string, ingested_at string")
    fn = fn.withColumns({c: F.to_timestamp(c) for c in ("extracted_at", "ingested_at")})
    rest = {"start_line": "int", "end_line": "int", "parent_class": "string", "param_count": "int", "fan_in": "int", "fan_out": "int"}
    fn.withColumns({c: F.lit(None).cast(k) for c, k in rest.items()}).write.parquet(f"{tmp_path}/function_nodes.parquet")
    docs = [(i, f"# {r.choice(['lock', 'graph', 'other'])} notes\nword{'abc'[i % 3]} in src/lock/f{i}.h and lib/graph/g{i}.cpp") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(f"word{x} {n} of src/lock/f{n}.h",) for x in "abc" for n in range(20)]
    spark.createDataFrame(asked, "question string").write.parquet(f"{tmp_path}/qa_results.parquet")
    got, _, size = moved(spark, lambda: agents.QUERIES["RT11"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    for x in ("documents", "qa_results", "function_nodes"):
        c.execute(f"CREATE VIEW {x} AS SELECT * FROM '{tmp_path}/{x}.parquet/*.parquet'")
    want = c.execute(agents.ORACLE["RT11"]).fetchall()
    assert len(want) > 300 and sorted(map(tuple, got)) == sorted(want)
    # 2,000 signatures of 300 characters are not
    assert size < 300_000
