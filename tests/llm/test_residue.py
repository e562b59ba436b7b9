import random

import pytest

import codequarry.llm.residue as residue
from codequarry.llm.residue import MAX_BITS, residue_bodies, residue_found, segments, similar_segments, simhash, skeleton, spread_labels

RESIDUE = [
    "Version: __version__\n\n**OS**: __OS__", "**version**: {% include version %} {% include steps %}", "{{ title }}", "<version>\n\n**steps**: <steps>",
    "Body: <body> **component**: <component>", "{REPRO}\nVersion: {version}", "Repro: %REPRO%\n%log_tail%", "## Logs\n_No response_\n\n## Environment\n[INSERT STEPS HERE]",
    "**What happened**\n<your version>\n\n**Logs**\nTODO", "## Checklist\n- [ ] I searched existing issues\n<!-- paste logs here -->", "Orci porta nibh magna nibh massa.",
    "foo bar baz", "**Logs**\n1.\n2.\n\n**Version**\n- [ ] I searched existing issues", "asdf asdf asdf !!", "abc 123 abc 123", "xxx xxxx xx ...", "Your text here. Your text here.", "此处填写内容，此处填写内容。 ...",
    "<!DOCTYPE html>\n<html><body><h1>The page you are looking for could not be found. Go back to the start page.</h1><hr><address>edge-5</address></body></html>",
    "Gateway Time-out\nThe gateway did not receive a timely response.", '{"message": "Not Found", "status": "404"}', "# Error establishing a database connection\n\n[Home](/) | [Status](/status/4)",
    "503 Service Temporarily Unavailable\n\nhost: cache-8.example.invalid", "系统繁忙，请稍后再试。错误代码：7", "抱歉，您访问的页面不存在或已被删除。", "Access denied. Reference #2b1f.77",
    "<noscript>Your browser does not run scripts; the tracker cannot be shown.</noscript>", "This site requires scripts and cookies. Turn them on and reload.",
    "Verify you are human. Script execution is needed to continue. Ray 77ab01", "请启用 JavaScript 后继续访问。", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
]
REPORTS = [
    "same here", "+1", "any news on `map_cluster`?", "see src/net/a_b.hpp:9", "`index_x` still fails in v3.9.1", "同样的问题，v3.9.1 也有",
    "### Version\n\nv6.7.7\n\n### Logs\n\n_No response_", 'The page of the inspector prints "Please enable JavaScript to view this page." because x_y() strips the script tag.',
    "The watcher answers `502 Bad Gateway` in this case.", "The chat template `{{ title }}` reaches x_y() unrendered.", "It crashes when I press save", "> 502 Bad Gateway\n\nHappens to me too",
    "<!-- paste logs here -->\nIt hangs.", "### Version\n7\n\n### Logs\nN/A", "### Host\nedge-5\n\n### Logs\nTODO", "TODO list is lost after the upgrade of the planner", "这个句柄的上限是40.07，而实际写入了6条记录。",
]


def test_read_bodies(spark):
    # what a page says beside its trusted line is known only if several issues hold it
    rows = [(f"{i}{k}", b, "x") for k, b in enumerate(RESIDUE) for i in "rs"] + [(f"k{k}", b, "x") for k, b in enumerate(REPORTS)]
    rows += [("n", None, "x"), ("e", "", "x"), ("b", " \n\t", "x"), (None, RESIDUE[0], "x"), ("r0", RESIDUE[0], "y"), ("long", "the slot leaks again. " * 5000, "x")]
    df = spark.createDataFrame(rows, "id string, body string, unknown string").repartition(3)
    got = sorted(x.id for x in residue_bodies(df).collect())
    assert got == sorted(f"{i}{k}" for k in range(len(RESIDUE)) for i in "rs")
    assert residue_bodies(df.limit(0)).collect() == []


def test_labels_spread_to_near_duplicates(spark):
    page = "this very special tracker page of ours has been moved to some other place by the people who run it, reload the start page and be patient"
    seed = "Please enable JavaScript to use it: " + page
    unknown = "Please enable it: " + page
    assert [k for _, k in segments(seed)] == ["notice"] and [k for _, k in segments(unknown)] == ["unknown"]
    far = "the tracker loses every second record of the index when two people save at the same time and nobody sees a warning about it"
    df = spark.createDataFrame([("a", seed), ("b", unknown), ("c", far)], "id string, body string")
    assert bin((simhash(skeleton(seed)) ^ simhash(skeleton(unknown))) & (2**64 - 1)).count("1") > 0
    close = [x.id for x in residue_bodies(df).orderBy("id").collect()]
    assert close[0] == "a" and "c" not in close


@pytest.mark.parametrize("bucket", [2, 256])
def test_tables_find_all_near_hashes(spark, monkeypatch, bucket):
    monkeypatch.setattr(residue, "BUCKET_ROWS", bucket)
    r = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfglmn" for b in ("ora", "ine", "ust", "ek")]
    base = [" ".join(r.choice(words) for _ in range(40)) for _ in range(12)]
    texts = set(base)
    for b in base:
        for _ in range(8):
            w = b.split()
            w[r.choice([0, 1, len(w) - 1])] = r.choice(words)
            texts.add(" ".join(w))
    nodes = [(k, t, k % 5 == 0) for k, t in enumerate(sorted(texts))]
    want = set()
    for a, ta, sa in nodes:
        for b, tb, sb in nodes:
            x, y = residue._word_shingles(ta), residue._word_shingles(tb)
            near = bin((simhash(ta) ^ simhash(tb)) & (2**64 - 1)).count("1") <= MAX_BITS
            if a < b and not (sa and sb) and near and len(x & y) >= 0.8 * len(x | y):
                want.add((a, b))
    df = spark.createDataFrame(nodes, "node long, text string, seed boolean")
    got = [tuple(x) for x in similar_segments(df).collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_spread_follows_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (9, 9)], "a long, b long")
    seeds = spark.createDataFrame([(4,), (20,)], "node long")
    assert sorted(x.node for x in spread_labels(links, seeds).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("bucket", [2, 256])
def test_prefixes_find_all_similar_segments(spark, monkeypatch, bucket):
    monkeypatch.setattr(residue, "BUCKET_ROWS", bucket)
    r = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfglmn" for b in ("ora", "ine", "ust", "ek")]
    texts = {"ab cd", "abc d", "a b c d e f", "abc d e f"}
    for n in (15, 25, 60):
        for _ in range(4):
            base = [r.choice(words) for _ in range(n)]
            for _ in range(8):
                w = list(base)
                for _ in range(r.choice([0, 1, 2])):
                    w[r.randrange(n)] = r.choice(words)
                texts.add(" ".join(w))
    nodes = [(k, t, k % 5 == 0) for k, t in enumerate(sorted(texts))]
    want, far = set(), 0
    for a, ta, sa in nodes:
        for b, tb, sb in nodes:
            x, y = residue._word_shingles(ta), residue._word_shingles(tb)
            if a < b and not (sa and sb) and (len(x & y) >= 0.8 * len(x | y) or ta.replace(" ", "") == tb.replace(" ", "")):
                want.add((a, b))
                far += bin((simhash(ta) ^ simhash(tb)) & (2**64 - 1)).count("1") > MAX_BITS
    df = spark.createDataFrame(nodes, "node long, text string, seed boolean")
    got = [tuple(x) for x in residue.similar_shingles(df).collect()]
    assert set(got) == want and len(got) == len(want) and far


def test_light_edits_of_a_notice_get_its_label(spark):
    r = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfglmn" for b in ("ora", "ine", "ust", "ek")]
    page = [r.choice(words) for _ in range(60)]
    seed = "please enable javascript " + " ".join(page)
    edits = []
    for k in range(57):
        w = list(page)
        w[k] = "zzyzx"
        edits.append(" ".join(["please enable", *w]))
    far = [e for e in edits if bin((simhash(seed) ^ simhash(e)) & (2**64 - 1)).count("1") > MAX_BITS]
    far = [e for e in far if len(residue._word_shingles(e) & residue._word_shingles(seed)) >= 0.8 * len(residue._word_shingles(e) | residue._word_shingles(seed))]
    assert far and {k for _, k in segments(far[0])} == {"unknown"}
    df = spark.createDataFrame([("a", seed), ("b", far[0])], "id string, body string")
    assert sorted(x.id for x in residue_bodies(df).collect()) == ["a", "b"]


def test_only_company_shows_the_rest_of_a_page(spark):
    page = "502 Bad Gateway\nThe upstream of this host sleeps; wake it up and come back."
    one = "JavaScript is disabled in your browser. The gadgets of this board stay dark."
    both = "404 Not Found\nI saw it twice today"
    rows = [("a", page), ("b", page.replace("host", "HOST")), ("c", one), ("d", one), ("e", both), ("f", both), ("g", "I saw it twice today"), ("h", "500 Internal Server Error\nonly once")]
    # a light edit of a text that is known by its company follows it along the near-duplicates
    tail = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows += [("i", f"Gateway Time-out\n{tail}"), ("j", f"Gateway Time-out\n{tail}"), ("k", f"Gateway Time-out\n{tail} end")]
    df = spark.createDataFrame(rows, "id string, body string")
    assert {x.id: x.by for x in residue_found(df).collect()} == dict.fromkeys("abcdijk", "propagation")


def test_long_segments_and_comments_are_read_whole():
    filler = "Lorem ipsum dolor sit amet 1.2 " * 8
    assert {k for _, k in segments(filler.strip())} == {"filler"}
    hint = "<!-- " + "Tell us what happened -> and what you expected instead. " * 20
    assert [k for _, k in segments(hint + "-->")] == ["placeholder"]
    assert [k for _, k in segments(hint + "\n\nMore hints\n-->\n## Logs")] == ["placeholder", "label"]
    broken = segments("<!-- paste logs here\nThe pool forgets a row\n\nroute a --> b fails\n\nIt hangs. <!-- x -->")
    assert [k for _, k in broken].count("unknown") >= 2
    swallowed = segments("<!-- Describe it\nThe debugger stops in store_tree() at src/a.cc\n\nA colleague gets it too paste logs here -->")
    assert "report" in [k for _, k in swallowed]
