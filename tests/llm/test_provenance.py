import pytest

from codequarry.llm.provenance import DATA, GENERATED, MINIFIED, VENDORED, body_kinds, file_kinds, file_rules, merkle_tree, not_hand_written, path_kinds, shared_subtrees

CODE = "int run(Pool & x) {\n    // may still hold the fence\n    return fold_x(9, 0xaa);\n}\n"
TABLE = "static const unsigned char k_x[1200] = {\n" + "".join("  " + ", ".join(f"0x{(k * j) % 256:02x}" for k in range(12)) + ",\n" for j in range(100)) + "};\n"
MIN = "!function(e,t){" + "var a=r[26],m=function(n){return n.fra(511)||q};" * 40 + "}(this);"


@pytest.mark.parametrize(
    "path, kinds",
    [
        ("vendor/quillxml/field.cpp", VENDORED), (".\\third_party\\oak\\src\\a.cc", VENDORED), ("3rdparty/minihash-3.17/p.h", VENDORED), ("src/deps/vendored/fz/n.cc", VENDORED),
        ("web/node_modules/oak-1/index.js", VENDORED), ("web/dist/chunk-9a300a5e.2.js", MINIFIED), ("web/static/journal.min.js", MINIFIED), ("build/debug/moc_slab.cpp", GENERATED),
        ("./ui/qrc_icons_14.cpp", GENERATED), ("src/lang/row.tab.c", GENERATED), ("src/lang/lex.row.c", GENERATED), ("a/b.pb.cc", GENERATED), ("a/b_pb2.py", GENERATED),
        ("a/b_pb2_grpc.py", GENERATED), ("a/b.gen.cpp", GENERATED), ("a/b.generated.h", GENERATED), ("a/b.g.cc", GENERATED), ("out/Release/gen/idl/a.h", GENERATED),
        ("src/audit/vendor_report_3.cpp", 0), ("src/build/branch_output_2.py", 0), ("tools/minify_digest.py", 0), ("src/generators/table_generator.cpp", 0),
        ("src/lang/lexer_grid.cpp", 0), ("tests/unit/test_codegen_x.cpp", 0), ("web/app/pass.js", 0), ("src/ui/vault_lut.cpp", 0),
    ],
)
def test_paths(path, kinds):
    assert path_kinds(path) == kinds


@pytest.mark.parametrize(
    "body, kinds",
    [
        ("/* This file was automatically generated from x.schema -- any manual change is lost. */\n" + CODE, GENERATED),
        ("// @generated by tools/mk_x.py on every build\n" + CODE, GENERATED), ("/*\n * Autogenerated; to change it, edit x.def and run it again.\n */\n" + CODE, GENERATED),
        ("// Code produced by idlforge v6.2.3. DO NOT EDIT.\n" + CODE, GENERATED), ("// 本文件由脚本自动生成，请勿手工修改。\n" + CODE, GENERATED),
        ('#line 1 "unpack_header.y"\n/* skeleton output of the grammar compiler, version v1.2 */\n' + CODE, GENERATED),
        ("// Upstream copy of lumenpng release v1.2; report bugs to the lumenpng project, not here.\n" + CODE, VENDORED),
        ("/* oakregex v1.2 - imported verbatim from upstream, local changes: none.\n * Copyright (c) 2 The oakregex authors. */\n" + CODE, VENDORED),
        (MIN, MINIFIED), (TABLE, DATA), (TABLE.replace("\n", "\r\n"), DATA), (TABLE.replace("\n  ", ""), DATA),
        ("// Feeds the code generator; the generated output goes to the build directory.\n" + CODE, 0), ("// Do not edit the x_y buffer while the iterator is alive.\n" + CODE, 0),
        ("/* Written by hand on purpose: the automatic x version was too slow. */\n" + CODE, 0), ("// Replaces the vendored bzfold parser that we removed in v1.4.\n" + CODE, 0),
        ('int f() {\n    const char * x = "' + "QzM+0xab/" * 600, 0),  # cut within the literal
        ('int f() {\n    const char * x = "' + "QzM+0xab/" * 600 + '";\n' + CODE + "}\n", 0), ("int f() {\n    static const int steps[8] = {44, 30, 2, 55, 35, 43, 13, 41};\n}\n", 0), (CODE, 0),
    ],
)
def test_bodies(body, kinds):
    assert body_kinds(body) == kinds


def test_rows(spark):
    rows = [("a.cc", CODE, 1), ("./a.cc", TABLE, 2), ("a.cc", None, 3), (None, TABLE, 4), ("vendor/x/a.cc", None, 5), ("vendor/x/a.cc", "", 5), ("e.cc", "", 6), ("long.cc", CODE * 5000, 7)]
    df = spark.createDataFrame(rows, "file_path string, body string, hash int").repartition(2)
    assert sorted(x.file_path for x in not_hand_written(df).collect()) == ["./a.cc", "vendor/x/a.cc"]
    assert not_hand_written(df.limit(0)).collect() == []


def test_subtrees_shared_by_projects_are_vendored(spark):
    lib = [(f"f{k}.c", f"int f{k};\n" * 3) for k in range(4)]
    rows = [("one", f"src/zlib/sub/{n}", b) for n, b in lib] + [("two", f"deep/er/copy/sub/{n}", b) for n, b in lib] + [("two", f"again/sub/{n}", b) for n, b in lib]
    rows += [("three", f"src/zlib/sub/{n}", b + "changed") for n, b in lib] + [("one", "src/main.c", "int m;"), ("two", "main.c", "int m;"), ("one", "x/big.c", CODE * 40), ("three", "y/large.c", CODE * 40)]
    df = spark.createDataFrame(rows, "repo string, file_path string, body string")
    got = sorted((x.file_path, x.kinds) for x in file_kinds(df, repo_col="repo").where("kinds <> 0").collect())
    want = {p for r, p, _ in rows if "sub/" in p and r != "three"} | {"x/big.c", "y/large.c"}
    # the third project has a file of the same name as a copy, so its path is one of them
    assert {p for p, _ in got} == want and {k for _, k in got} == {VENDORED}


def test_only_the_subtree_shows_a_copy_without_a_telling_path(spark):
    lib = [(n, f"int {n[0]};\n" * 3) for n in ("a.c", "b.c", "in/c.c", "in/d.c")]
    rows = [(f"third_party/zlib/{n}", b) for n, b in lib] + [(f"src/compress/{n}", b) for n, b in lib] + [(f"src/own/{n}", b + "x") for n, b in lib]
    # copies inside of the project are its own
    rows += [("src/core/big.c", CODE * 40), ("tests/copy/big.c", CODE * 40)]
    got = {x.file_path: (x.layout, x.content, x.subtree) for x in file_rules(spark.createDataFrame(rows, "file_path string, body string")).collect()}
    assert {p for p, k in got.items() if k == (0, 0, VENDORED)} == {f"src/compress/{n}" for n, _ in lib}
    assert {p for p, k in got.items() if any(k)} == {f"{d}/{n}" for n, _ in lib for d in ("third_party/zlib", "src/compress")}


def test_the_origin_of_a_copy_is_hand_written(spark):
    lib = [(f"f{k}.c", f"int f{k};\n" * 3) for k in range(4)]
    rows = [("zlib", f"src/{n}", b) for n, b in lib] + [("app", f"lib/z/{n}", b + "y") for n, b in lib] + [("app", f"vendor/zlib/src/{n}", b) for n, b in lib]
    df = spark.createDataFrame(rows, "repo string, file_path string, body string")
    assert {x.file_path for x in file_kinds(df, repo_col="repo").where("kinds <> 0").collect()} == {f"vendor/zlib/src/f{k}.c" for k in range(4)}


def test_tree_hashes_do_not_depend_on_order_or_place(spark):
    deep = "/".join(f"d{k}" for k in range(150))
    rows = [("p", "a/x/1", 1, 9), ("p", "a/x/2", 2, 9), ("q", "b/c/x/2", 2, 9), ("q", "b/c/x/1", 1, 9), ("q", "b/c/x/3", 3, 9), ("p", "top", 5, 9), ("r", f"{deep}/1", 1, 9), ("s", f"e/{deep}/1", 1, 9), ("p", "a/x/none", None, 0)]
    df = spark.createDataFrame(rows, "repo string, path string, hash long, chars long")
    tree = {(x.repo, x.path): x for x in merkle_tree(df.where("repo < 'r'")).collect()}
    assert set(tree) == {("p", "a"), ("p", "a/x"), ("p", "a/x/1"), ("p", "a/x/2"), ("p", "a/x/none"), ("p", "top"), ("q", "b"), ("q", "b/c"), ("q", "b/c/x"), ("q", "b/c/x/1"), ("q", "b/c/x/2"), ("q", "b/c/x/3")}
    assert tree["p", "a/x"].hash != tree["q", "b/c/x"].hash and tree["q", "b/c"].files == 3 and tree["p", "a/x/none"].hash is None
    same = merkle_tree(df.where("path NOT IN ('b/c/x/3', 'a/x/none')"))
    shared = {(x.repo, x.path) for x in shared_subtrees(same, 2, 100).collect()}
    assert shared == {("p", "a"), ("p", "a/x"), ("q", "b/c"), ("q", "b/c/x")}
    far = {(x.repo, x.path) for x in shared_subtrees(same.where("repo IN ('r', 's')"), 1, 100).collect()}
    assert ("r", "d0") in far and ("s", "e/d0") in far and ("s", "e") not in far


def test_tree_against_a_walk_level_by_level(spark):
    rows = [("p", "/".join(x), k, 1) for k, x in enumerate([("a", "b", "c"), ("a", "b", "d"), ("a", "e"), ("f", "b", "c"), ("f", "b", "d"), ("g",)])]
    rows = [(r, p, {"c": 7, "d": 8}.get(p[-1], k), n) for r, p, k, n in rows]

    def walk(prefix):
        below = {}
        for _, p, h, _ in rows:
            if p.startswith(prefix + "/"):
                below.setdefault(p[len(prefix) + 1 :].split("/")[0], []).append((p, h))
        return tuple(sorted((n, walk(f"{prefix}/{n}") if x[0][0] != f"{prefix}/{n}" else x[0][1]) for n, x in below.items()))

    tree = {x.path: x.hash for x in merkle_tree(spark.createDataFrame(rows, "repo string, path string, hash long, chars long")).collect()}
    dirs = [d for d in tree if walk(d)]
    assert {(x, y) for x in dirs for y in dirs if tree[x] == tree[y]} == {(x, y) for x in dirs for y in dirs if walk(x) == walk(y)}
    assert len(dirs) == 4


def test_headers_below_long_comments():
    licence = "".join(f"// clause {k} of the licence, which is a long one\n" for k in range(120))
    block = "/*\n" + "".join(f"   clause {k} of the licence\n" for k in range(40))
    made = "Code generated by rowgen. DO NOT EDIT.\n"
    code = "int a() {\n" + "    b();\n" * 30
    assert body_kinds(licence + "// " + made + code) == GENERATED
    assert body_kinds(block + "\n   " + made + "*/\n" + code) == GENERATED
    assert body_kinds("#!/bin/sh\n\n" + licence.replace("//", "#") + "# Copied verbatim from https://x.example\nrun\n") == VENDORED
    assert body_kinds(code + '#line 7 "src/row.y"\n' + code) == GENERATED
    assert body_kinds(code + "// " + made + "}\n") == 0
    assert body_kinds(block + "*/\n" + code + "/* " + made + "*/\n") == 0
    assert body_kinds(code + '    puts("# 7");\n') == 0
