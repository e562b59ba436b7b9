import pytest

from codequarry.llm.pairs import CUTOFF, DEFECTS, FUNCTIONS, defective_pairs, fit, language, pair_posteriors, votes, wanted_language

Q = "Which callers of `pack_tick` rely on its return value being 3?"
SOUND = [
    (Q, "The limit in src/core/a_b.cc is 8. Only `fold_x` relies on it, i.e. the planner waits."),
    (Q, "Yes."), (Q, "Yes, see `mark_x`."), (Q, "`mark_x`"), (Q, "src/core/a_b.cc:12"),
    (Q, "> " + Q + "\n\nNo, pack_tick() does not."),
    (Q, 'The handler prints "Sorry, I can\'t help with that" when it is stale, and the caller looks for it.'),
    (Q, "I cannot find any caller of x_y outside a/b.cc; inside it, line 5 frees the wire first."),
    (Q, "Both of them do.\n\nEvidence:\n- src/core/a_b.cc:12\n- src/core/c.h:7"),
    (Q, "It is this one.\n\n| caller | line |\n|---|---|\n| x_y | 7 |"),
    (Q, "It is this one.\n\n```cpp\nint a(;\n```"),
    ("队列的上限7是在哪里检查的？", "不会。"), ("队列的上限7是在哪里检查的？", "注意：x_y（见a/b.cc）不是线程安全的。"),
    (Q + " Please answer in Chinese.", "会的，见`mark_x`。"),
    ("Warum hält x_y() die Sperre?", "Ja."), ("Warum hält x_y() die Sperre?", "Leider ja: x_y() verwirft den Wert 3."),
]
DEFECTIVE = [
    ("empty", Q, None), ("empty", Q, ""), ("empty", Q, "​ ﻿"), ("empty", Q, "**Answer:**"), ("empty", Q, "答案："),
    ("empty", Q, "```cpp\n\n```"), ("empty", Q, "####"), ("empty", None, "> "), ("empty", Q, "<br/>&nbsp;"),
    ("copy", Q, Q), ("copy", Q, Q.upper()), ("copy", Q, f"**{Q}**\n"), ("copy", Q, "You asked: " + Q), ("copy", Q, Q + "\n" + Q),
    ("copy", "List the effects of x_y in a/b_c.cc?", "list the effects of x_y in a/b_ccc"), ("copy", Q, "Question " + Q),
    ("copy", "队列的上限7是在哪里检查的？", "您问的是：队列的上限7是在哪里检查的"),
    ("refusal", Q, "I'm sorry, but I can't help with that request."), ("refusal", Q, "> " + Q + "\n\nSorry, I must decline to review `x_y`."),
    ("refusal", Q, "Could you share the code of x_y? Without it I have nothing to go on."),
    ("refusal", "队列的上限7是在哪里检查的？", "抱歉，我无法回答这个问题。"), ("refusal", "Warum?", "Tut mir leid, dazu darf ich nichts sagen."),
    ("language", Q, "注意：x_y（见a/b.cc）不是线程安全的。"), ("language", Q, "Warum hält x_y() die Sperre bis zum Ende? Das ist nicht gut."),
    ("language", Q + " Please answer in Chinese.", "The limit is 8. The caller relies on it."), ("language", "队列的上限7？", "このログは平均10ミリ秒で処理されます。"),
    ("truncated", Q, "The limit is 8. The contract says that a volatile node must"), ("truncated", Q, "The limit is 8. However,"),
    ("truncated", Q, "It is here:\n\n1. The limit is 8.\n2."), ("truncated", Q, "It is here.\n\n```cpp\nint a() {"),
    ("truncated", "队列的上限7是在哪里检查的？", "只有当页表处于空闲模式时才会走慢路径。注意：x_y（见"), ("truncated", Q, "It is here. The fix (see `fold"),
]


def rows():
    pairs = [(q, a) for q, a in SOUND] * 3 + [(q, a) for _, q, a in DEFECTIVE]
    return [(k, q, a, "e") for k, (q, a) in enumerate(pairs)]


def test_defects_of_read_pairs(spark):
    df = spark.createDataFrame(rows() * 2, "result_id long, question string, answer string, defect string").repartition(3)
    got = {x.result_id: x.defect for x in defective_pairs(df).collect()}
    want = {3 * len(SOUND) + k: d for k, (d, _, _) in enumerate(DEFECTIVE)}
    assert got == want
    many = defective_pairs(df, every_label=True).collect()
    assert {(x.result_id, x.defect) for x in many} >= set(want.items())


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, Q, Q), (1, None, None)], "result_id long, question string, answer string")
    assert [tuple(x) for x in defective_pairs(df).collect()] == [(1, "empty")]
    assert pair_posteriors(df.limit(0)).collect() == []
    long = "The limit is 8. " * 20_000
    df = spark.createDataFrame([(1, "x " * 20_000, long), (2, long, long)], df.schema)
    assert [tuple(x) for x in defective_pairs(df).collect()] == [(2, "copy")]


def test_model_weighs_functions_by_their_agreement():
    names = FUNCTIONS["refusal"]
    rows = {"100111": 40, "010111": 15, "0011-1": 9, "100011": 6, "000000": 900, "1000-0": 6, "0000--": 900, "00001-": 80}
    post = fit(list(rows), list(rows.values()), names)
    assert min(post["100111"], post["010111"], post["100011"]) > 0.9 > 0.1 > max(post["1000-0"], post["00001-"]) and post["000000"] < 0.01
    # no single function tells these apart
    assert votes(Q, "Yes.")[1] is None and len(votes(Q, "Yes.")[0]) == sum(len(FUNCTIONS[d]) for d in DEFECTS)


@pytest.mark.parametrize("text, lang", [("Yes.", "en"), ("Ja.", "de"), ("`x_y`", None), ("不会。", "zh"), ("なぜRouteはロックを取らない", "ja"), ("", None)])
def test_language(text, lang):
    assert language(text) == lang


def test_wanted_language():
    assert wanted_language("为什么？请用英文回答。") == "en"
    assert wanted_language(Q + " Please answer in Chinese.") == "zh"
    assert wanted_language("Warum ruft X zuerst a_b auf?") == "de"


#: Sound answers to different questions, among which refusals are rare.
PLAIN = [(f"Does `f_{k}` rely on row {k}?", f"{w} of f_{k} {v} the row, and nothing else does.") for k, (w, v) in enumerate((a, b) for a in ("The caller", "One caller", "The planner", "A reader", "The loader", "Each reader") for b in ("frees", "keeps", "copies", "locks", "drops", "sorts", "merges", "checks"))]


def test_curly_apostrophes_and_missing_phrases(spark):
    asked = [f"Who frees row {k} of `a_{k}`?" for k in range(40)]
    said = [(q, "I’m sorry, but I can’t answer that.") for q in asked[:4]] + [(q, "I don’t have access to the repository.") for q in asked[4:8]]
    # the second sentence is in no list, so only the posterior of an answer that many questions got shows the refusal
    odd = [(q, f"Could you share the code of `a_{k + 8}`? Without it the trail ends here for us.") for k, q in enumerate(asked[8:14])]
    sound = [(asked[14], "Could you share the pool? Yes: a_14() hands it on to b_14() and the reader frees it."), *PLAIN * 8]
    pairs = said + odd + sound
    df = spark.createDataFrame([(k, q, a) for k, (q, a) in enumerate(pairs)], "result_id long, question string, answer string")
    got = {x.result_id: x.defect for x in defective_pairs(df).collect()}
    assert got == dict.fromkeys(range(len(said) + len(odd)), "refusal")
    at = [f for d in DEFECTS for f in FUNCTIONS[d]].index("every_sentence")
    by = {x.result_id: x.votes for x in pair_posteriors(df).collect()}
    assert {by[k][at] for k in range(len(said), len(said) + len(odd))} == {"0"}


def test_several_labels(spark):
    pairs = [(Q, "Tut mir leid, dazu darf ich nichts sagen."), (Q, "Leider kann ich diese Frage nicht beantworten, weil die"), ("Warum hält x_y() die Sperre?", "I'm sorry, but I can't help with that request.")]
    pairs += [p for p in rows_of() if p not in pairs] + PLAIN * 4
    df = spark.createDataFrame([(k, q, a) for k, (q, a) in enumerate(pairs)], "result_id long, question string, answer string")
    got = {}
    for x in defective_pairs(df, every_label=True).collect():
        got.setdefault(x.result_id, set()).add(x.defect)
    assert got[0] == {"refusal", "language"} and got[1] == {"refusal", "language", "truncated"} and got[2] == {"refusal", "language"}


def rows_of():
    return [(q, a) for q, a in SOUND] * 3 + [(q, a) for _, q, a in DEFECTIVE]


def test_cutoff_on_planted_defects(spark):
    """Defects planted into answers that show none: of each kind nearly all are found, and hardly a sound one is called defective."""
    rows = spark.read.parquet("/root/testdata/sf0.01/qa_results.parquet").where("result_id IS NOT NULL").dropDuplicates(["result_id"]).orderBy("result_id").collect()
    bad = {x.result_id for x in defective_pairs(spark.read.parquet("/root/testdata/sf0.01/qa_results.parquet")).collect()}
    good = [(x.question, x.answer) for x in rows if x.result_id not in bad and x.question and len(x.answer or "") > 120]
    assert len(good) > 200
    plant = {"empty": lambda q, a: " \u200b\n", "copy": lambda q, a: q.upper(), "refusal": lambda q, a: "I am unable to answer this.", "truncated": lambda q, a: a[: len(a) // 2].rsplit(None, 1)[0] + " the", "language": lambda q, a: "Der Puffer wird nicht von dem Leser gehalten, weil er nur für die Sperre ist."}
    out, truth = [], {}
    for k, (q, a) in enumerate(good):
        kind = [*DEFECTS, *[None] * 15][k % 20]
        if kind == "language" and wanted_language(q) in (None, "de") or kind == "truncated" and any(m in a for m in '`"“|') or kind == "refusal" and wanted_language(q) != "en":
            kind = None
        out.append((k, q, plant[kind](q, a) if kind else a))
        truth[k] = kind
    post = pair_posteriors(spark.createDataFrame(out, "result_id long, question string, answer string")).collect()
    for d in DEFECTS:
        planted = [x[d] for x in post if truth[x.result_id] == d]
        clean = [x[d] for x in post if truth[x.result_id] is None]
        assert planted and sum(p > CUTOFF for p in planted) >= 0.95 * len(planted) and sum(p > CUTOFF for p in clean) <= 0.01 * len(clean), d
