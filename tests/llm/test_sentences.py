import pytest

from codequarry.llm.sentences import sentence_units, units


def cut(text):
    return [text[a:b] for a, b in units(text)]


@pytest.mark.parametrize(
    "want",
    [
        ["What now?!", "Roll back 25175214."],
        ["The limit is 8.", "2314 of the field entries exceed it."],
        ["The cause is known, cf. Sec. 5.", "No. 3282 of the list covers the cure."],
        ["We stopped at v5.5.10.", "fetch_bundle fails there."],
        ["The list ends with shrink_ring, etc.", "The rest of a/b.h was not read."],
        ["It wraps the pool, the slot, etc.", "`reset_hook` keeps a pointer."],
        ["It reads 41,268 rows at 9 a.m. and again at 6 p.m. on the same cell.", "Line 3 is fine."],
        ["It polls every 39.2 s.", "Version v4.18.9 moved it, i.e. the worker waits."],
        ['"Is the fence frozen?"', "The planner thinks so."],
        ['"Who resets the cell?" was the first question.', "See https://x.invalid/a.b?c=1."],
        ['The reviewer answered: "It is sparse. Leave it alone."', "fold_x is fine."],
        ['It breaks off with "flow 905..."', "Nobody kept the rest."],
        ['It prints "strip is detached, retrying..." and goes quiet.', "The path drops it ... and x never learns."],
        ["(See a/b.h for the partial variant.)", "It differs from open_worker() in one channel."],
        ["Who closes it (the writer or Cursor?) after a failed call.", "Rejected on 3 Nov. because of that."],
        ["In a/b.py steht z. B. die Grenze 6, gemessen wurden aber ca. 30.4 ms.", "Sie gilt u. a. für X, d. h. der Rest fehlt."],
        ["Das wird am 3. Tag des Monats gebaut.", "Er schrieb: „Das ist falsch. Bitte ändern.“", "Warum?"],
        ["Le relecteur a noté : « Ne touchez pas. C'est voulu. »", "Personne n'a vérifié !", "On mesure env. 3.03 ms, cf. la fig. 9."],
        ["Está en x(), p. ej. para valores de 26.04 ms.", "¡Nadie revisó el caso 2!", "El informe, pág. 568, dice que «No. Funciona así.»"],
        ["На рис. 3 видно, т. е. код её не видит.", "Рецензент написал: «Ошибка. Исправьте.»", "Почему?"],
        ["لماذا لا يأخذ X القفل؟", "لم يراجع أحد هذه الحالة!", "انتقل إلى x()."],
        ["यह दो बार गिना जाता है, इसलिए गलत है।", "क्या C लॉक लेता है?", "सीमा 36.003 लिखी है।"],
        ["ตั้งแต่รุ่น5ย้ายไปที่cache_mesh", "ตัวเรียกไม่ได้ตรวจค่า", "คลาสXใช้ล็อกร่วมกับy"],
    ],
)
def test_spaced_scripts(want):
    assert cut(" ".join(want)) == want
    assert cut("\n".join(want)) == want


@pytest.mark.parametrize(
    "want",
    [
        ["审查者问：“谁来关闭这个路由？”", "如果X没有加锁，y()为什么还能读到？", "上限是20.002，而写入了4条！"],
        ["不可为空。", "`poll_x`返回之后仍然持有！", "`y`完了。"],
        ["文档里写着“不可为空。请先检查”，但x并没有检查。", "失败分支丢弃了令牌……而x()完全不知道。", "注意：x（见a/b.cc）不是线程安全的。"],
        ["レビューでは「空にできない。先に確認すること」と書かれていました。", "なぜXはロックを取らないのでしょうか？", "平均10.9ミリ秒で処理されます。"],
    ],
)
def test_scripts_without_spaces(want):
    assert cut("".join(want)) == want


def test_layout():
    text = (
        "# Title. With a point\nText that\nwraps here. Second.\n\n- one. Two\n  goes on\n* three\n1. No. 3 is fine. Yes.\n> quoted. Again\n"
        "```cpp\na. b\n\nc\n```\nafter\n \nlast"
    )
    assert cut(text) == [
        "# Title. With a point", "Text that\nwraps here.", "Second.", "- one.", "Two\n  goes on", "* three",
        "1. No. 3 is fine.", "Yes.", "> quoted.", "Again", "```cpp\na. b\n\nc\n```", "after", "last",
    ]


def test_units_cover_all_text_but_white_space(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    odd = ["", " \n\t", "...", "```", "```\nopen", "　a　", "“” \" (", "a" * 50_000, "! ? .", "1. ", "- ", None, ". a. B", "`", "«»"]
    for text in [d.text for d in docs] + odd:
        if text is None:
            continue
        seen = 0
        for a, b in units(text):
            assert seen <= a < b and not text[a].isspace() and not text[b - 1].isspace()
            assert not text[seen:a].strip()
            seen = b
        assert not text[seen:].strip()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(odd)], "doc_id long, text string, unit_start string")
    got = {(x.doc_id, x.unit_start, x.unit_end) for x in sentence_units(df).collect()}
    assert got == {(k, a, b) for k, t in enumerate(odd) if t for a, b in units(t)}
    assert sentence_units(df.limit(0)).collect() == []


@pytest.mark.parametrize("mark", "။ ។ ܀ ᠃ ፧ ‼ ⁇ ﹒ ﹖ ﹗ ᙮ ꓿ 𑁇 ⸮".split())
def test_terminators_of_all_scripts(mark):
    assert cut(f"Ein Wort{mark} Noch eins{mark}") == [f"Ein Wort{mark}", f"Noch eins{mark}"]
    assert cut(f"Ein Wort{mark}❞ Noch eins.") == [f"Ein Wort{mark}❞", "Noch eins."]


def test_terminators_cover_the_property():
    import regex

    from codequarry.llm.sentences import _MARK

    marks = [chr(c) for c in range(0x110000) if regex.match(r"[\p{SB=STerm}\p{SB=ATerm}]", chr(c))]
    assert len(marks) > 150 and all(_MARK.match(c) for c in marks)
