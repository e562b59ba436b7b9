"""Files that nobody on the project wrote by hand: generated, minified, vendored, data.

Merkle hashes are computed bottom-up over the directory trees: a file's hash
combines the hashes of its distinct bodies, a directory's hash those of its
named entries. A subtree that unrelated projects share is vendored. Header
rules (comments at the top of a body) and layout rules (the path, the shape of
the lines) find generated, minified and blob files, and folders that are named
for third parties.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import join_on_keys, materialize

#: Lines at the top of a body in which a header counts; a comment block that begins the body counts to its end.
HEADER_LINES = 12
#: Characters of a line from which the layout may be minified.
LONG_LINE = 300
#: Literals in a row, and their share of the body, from which it is data.
BLOB_LITERALS, BLOB_SHARE = 96, 0.8
#: Characters of text from which one shared file is taken for a copy, and files from which a subtree is.
COPY_CHARS, COPY_FILES = 2_000, 3

VENDORED, GENERATED, MINIFIED, DATA = 1, 2, 4, 8
KINDS = {VENDORED: "vendored", GENERATED: "generated", MINIFIED: "minified", DATA: "data"}

_VENDOR_DIRS = r"(?:vendors?|vendored|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|site-packages|godeps|pods|subprojects)"
#: The folder of one third party, for the regular expressions of the SQL engine.
_THIRD = rf"(?i)^((?:.*/)?{_VENDOR_DIRS}/[^/]+)(?:/|$)"
_PATHS = (
    (VENDORED, rf"(?:^|/){_VENDOR_DIRS}/"),
    (GENERATED, r"^(?:build|out|target|bazel-[\w-]+|cmake-build-[\w-]+)/|(?:^|/)(?:generated|__generated__|autogen|out/[^/]+/gen)/"),
    (MINIFIED, r"(?:^|/)dist/|[.-]min\.(?:js|mjs|cjs|css)$|\.bundle\.(?:js|css)$|\.(?:js|css)\.map$|(?:^|/)chunk[.-][0-9a-f]{6,}\b[^/]*\.js$"),
    (
        GENERATED,
        r"\.pb\.(?:h|cc|cpp|c|go|py|swift|dart)$|_pb2(?:_grpc)?\.pyi?$|_grpc\.pb\.\w+$|[._](?:gen|g|generated)\.(?:h|hh|hpp|cc|cpp|cxx|c|cu|py|js|ts|go|rs|cs|dart|java)$"
        r"|\.tab\.(?:c|h|cc|cpp|hh|hpp)$|(?:^|/)lex\.[^/]+\.(?:c|cc|cpp)$|\.yy\.(?:c|h|cc|cpp)$|(?:^|/)(?:moc|qrc|uic)_[^/]+\.(?:cpp|cc|h|py)$|\.(?:designer|g)\.cs$",
    ),
)
_PATHS = tuple((k, re.compile(p, re.I)) for k, p in _PATHS)

_COMMENT = re.compile(r"^\s*(//+|/\*+|\*+(?!\w)|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|pragma|undef)\b)|--|;+|<!--|\"\"\"|%|REM\b)\s*")
_SHUT = {"/*": "*/", "<!": "-->", '""': '"""'}
_SHUT_LAST = re.compile(r"\s*(?:\*/|-->)?\s*\Z")
#: Lines that may stand before or inside the comments that begin a body.
_PREAMBLE = re.compile(r"^\s*(?:<\?(?:php|xml)\b.*|#\s*(?:pragma|ifndef|define)\b.*|@charset\b.*|['\"]use strict['\"];?)?\s*$")
_MADE = re.compile(
    r"""@generated\b|@autogenerated\b|\b(?:auto(?:matically)?|machine)[\s-]*generated\b(?!\s+(?:by\s+hand|version|output|code\s+goes))|\bautogenerated\b
    |\b(?:file|code|source|module|parser|lexer|header|this|stub|binding)s?\s+(?:is|are|was|were|has\s+been)\s+(?:automatically\s+)?(?:generated|produced|created|emitted|built)\s+(?:by|from|with|using|automatically)\b
    |^(?:automatically\s+)?(?:generated|produced|emitted)\s+(?:automatically\s+)?(?:by|from|with|using)\b|\b(?:code|file|source|output)\s+(?:generated|produced|emitted)\s+(?:by|from|with)\b
    |^generated\s+(?:file|code|source|on)\b|(?-i:\bDO\s+NOT\s+(?:EDIT|MODIFY|CHANGE)\b)(?:\s+(?:by\s+hand|manually|this\s+file|directly))?[\s.!*/-]*$|\bdo\s+not\s+(?:edit|modify|change)\s+(?:this\s+file|by\s+hand|manually|directly|it\s+by\s+hand)
    |\b(?:manual|hand|any)\s+(?:made\s+)?(?:changes?|edits?|modifications?)\s+(?:is|are|will\s+be|to\s+this\s+file\s+will\s+be|get)\s+(?:lost|overwritten|discarded)|\bskeleton\s+output\s+of\b|\b(?:output|product)\s+of\s+the\s+(?:\w+\s+){0,2}(?:compiler|generator)\b
    |(?:本|此|该)?文件(?:由|是).{0,20}(?:自动)?生成|自动生成.{0,6}(?:请勿|不要|切勿)|请勿(?:手工|手动|直接|人工)?(?:修改|编辑|更改)|(?:automatisch\s+(?:erzeugt|generiert))|generado\s+automáticamente|généré\s+automatiquement|自動生成""",
    re.I | re.X,
)
_LINE_OF = re.compile(r'^[^\S\n]*#[^\S\n]*(?:line[^\S\n]+)?\d+[^\S\n]+"[^"\n]+\.(?:y|yy|ypp|l|ll|lpp|g4|re|rl|def|idl|proto)"', re.M)
_COPIED = re.compile(
    r"""\b(?:upstream|verbatim|vendored|unmodified|third[\s-]party)\s+(?:copy|source|snapshot|import|release)\b|\bcopied\s+(?:verbatim\s+|unchanged\s+)?from\b|\bimported\s+(?:verbatim\s+|unchanged\s+)?from\s+(?:upstream|the\b|https?:)
    |\bvendored\s+from\b|\breport\s+bugs\s+to\s+the\s+\S+\s+project\b|\blocal\s+(?:changes|modifications)\s*:\s*none\b|\bpart\s+of\s+the\s+\S+\s+(?:library|distribution)\b.*\bnot\s+(?:part\s+of\s+)?this\b""",
    re.I | re.X,
)
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`')
_NUMBER = r"[-+]?(?:0[xX][0-9a-fA-F]+|0[bB][01]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?|\.\d+)[fFuUlL]*"
_RUN = re.compile(rf"(?:{_NUMBER}\s*,\s*){{{BLOB_LITERALS - 1},}}(?:{_NUMBER})?")
_QUOTED_RUN = re.compile(r'(?:"(?:[^"\\\n]|\\.)*"\s*,?\s*)+')
_DECLARED = re.compile(r"[\w\s\[\]*&:<>,.()-]{0,160}=?\s*[{(\[]?\s*[})\]]?\s*;?\s*")


def path_kinds(path: str) -> int:
    """What the path alone shows; the spelling (slashes, ./) does not matter."""
    p = clean_path(path)
    return sum({k for k, rule in _PATHS if rule.search(p)})


def clean_path(path: str) -> str:
    p = re.sub(r"/+", "/", path.replace("\\", "/"))
    while p.startswith("./"):
        p = p[2:]
    return p


def _comments(body: str) -> Iterator[str]:
    """Texts of the comment lines at the top: of the first lines, and of the comment block that begins the body to its end."""
    shut, top = "", True  # what ends the open block comment; nothing but comments so far
    at = k = 0
    while at < len(body) and (top or k < HEADER_LINES):
        end = body.find("\n", at)
        end = len(body) if end < 0 else end
        line, at, k = body[at:end], end + 1, k + 1
        while True:
            m = _COMMENT.match(line)
            if shut:
                said, closed, rest = line.partition(shut)
                if top or m:
                    m = _COMMENT.match(said)
                    yield said[m.end() if m else 0 :].strip()
                if not closed:
                    break
                shut, line = "", rest
            elif m:
                shut = _SHUT.get(m[1][:2], "")
                line = line[m.end() :]
                if not shut:
                    yield _SHUT_LAST.sub("", line) if len(line) < 4000 else line
                    break
            else:
                top = top and bool(_PREAMBLE.match(line))
                break


def _header(body: str) -> int:
    kinds = GENERATED if "#" in body and _LINE_OF.search(body) else 0
    for said in _comments(body):
        if _MADE.search(said):
            kinds |= GENERATED
        if _COPIED.search(said):
            kinds |= VENDORED
    return kinds


def _minified(body: str) -> bool:
    """Most of the text stands in long lines of dense code, strings and comments apart."""
    if not re.search(rf"[^\n]{{{LONG_LINE}}}", body):
        return False
    code = _STRING.sub('""', re.sub(r"/\*.*?\*/|(?m:^\s*//.*$)", "", body, flags=re.S))
    code = _RUN.sub("0", code)
    lines = [x for x in code.split("\n") if x.strip()]
    long = [x for x in lines if len(x) >= LONG_LINE]
    size = sum(map(len, lines))
    dense = sum(map(len, long))
    if not long or dense < 0.5 * size:
        return False
    blank = sum(len(re.findall(r"\s", x)) for x in long)
    marks = sum(len(re.findall(r"[^\w\s]", x)) for x in long)
    return blank <= 0.15 * dense and marks >= 0.15 * dense


def _blob(body: str) -> bool:
    """The body is one table of literals, but for its declaration and comments."""
    text = re.sub(r"/\*.*?\*/|(?m:^\s*//.*$)", "", body, flags=re.S).strip()
    held = sum(len(m.group()) for m in _RUN.finditer(text))
    if held and held >= BLOB_SHARE * len(text):
        return True
    if len(text) >= COPY_CHARS and '"' in text:
        held = max((m.end() - m.start() for m in _QUOTED_RUN.finditer(text)), default=0)
        rest = _QUOTED_RUN.sub("", text)
        return held >= BLOB_SHARE * len(text) and bool(_DECLARED.fullmatch(rest))
    return False


def body_kinds(body: str) -> int:
    kinds = _header(body)
    if len(body) >= 200:
        kinds |= MINIFIED * _minified(body) | DATA * _blob(body)
    return kinds


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _scan(batches):
    for b in batches:
        paths = b.column(0).to_pylist()
        content, hashes, sizes = [], [], []
        for body in b.column(1).to_pylist():
            k, h, n = 0, None, 0
            if body:
                k = body_kinds(body)
                plain = body.replace("\r\n", "\n").strip()
                h, n = _signed(xxhash.xxh3_64_intdigest(plain)), len(plain)
            content.append(k)
            hashes.append(h)
            sizes.append(n)
        bits = lambda kinds: pa.array(np.array(kinds, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [b.column(2), b.column(0), pa.array([clean_path(p) for p in paths], pa.string()), bits([path_kinds(p) for p in paths]), bits(content), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64())],
            ["repo", "file_path", "path", "layout", "content", "hash", "chars"],
        )


def merkle_tree(files: DataFrame) -> DataFrame:
    """(repo, path, hash, files, chars) of every file and directory.

    ``files`` has (repo, path, hash, chars), one row per file. A file hands its
    hash up: at each directory above it is hashed with the name of the entry it
    came through, and a directory's hash is the exclusive or over what reaches
    it. So two directories are equal if the same files lie at the same places
    below them, whatever they are called. All levels combine in one aggregation
    inside the map tasks; no directory is gathered and no depth is left out.
    The root of a repository is not a node.
    """
    parts = F.split("path", "/")
    entries = F.reverse(F.slice(parts, 2, F.size(parts)))
    own = F.array(F.coalesce("hash", F.lit(0).cast("long")))
    up = F.aggregate(entries, own, lambda acc, name: F.concat(acc, F.array(F.xxhash64(name, F.element_at(acc, -1)))))
    each = files.select("repo", "chars", parts.alias("parts"), F.col("hash").alias("whole"), F.posexplode(up).alias("k", "h"))
    node = F.array_join(F.slice("parts", 1, F.size("parts") - F.col("k")), "/")
    # a file without a body is an entry of its directories, but no hash of its own
    node_hash = F.when((F.col("k") > 0) | F.col("whole").isNotNull(), F.col("h"))
    return (
        each.select("repo", node.alias("path"), node_hash.alias("h"), "chars")
        .groupBy("repo", "path")
        .agg(F.bit_xor("h").alias("hash"), F.count("*").alias("files"), F.sum("chars").alias("chars"))
    )


def shared_subtrees(tree: DataFrame, min_files: int = COPY_FILES, min_chars: int = COPY_CHARS) -> DataFrame:
    """(repo, path) of the nodes whose hash occurs in unrelated projects.

    A project is a repository or, inside of one, the folder of one third party
    (``third_party/name``). Copies within one project are its own. Where
    exactly one repository holds the content outside of such a folder and
    another one inside, that one is its origin and is left out. Small nodes
    prove nothing: a directory counts from ``min_files`` files on, a file from
    ``min_chars`` characters on.
    """
    held = F.regexp_extract("path", _THIRD, 1)
    large = tree.where((F.col("hash").isNotNull()) & (((F.col("files") >= min_files) & (F.col("chars") > 0)) | (F.col("chars") >= min_chars)))
    large = large.select("repo", "path", "hash", "files", held.alias("held"))
    outside, inside = F.when(F.col("held") == "", F.col("repo")), F.when(F.col("held") != "", F.col("repo"))
    project = F.struct("repo", "held")
    span = large.groupBy("hash", "files").agg(
        F.min(project).alias("lo"), F.max(project).alias("hi"),
        F.min(outside).alias("out_lo"), F.max(outside).alias("out_hi"), F.min(inside).alias("in_lo"), F.max(inside).alias("in_hi"),
    ).where("lo < hi")
    origin = (F.col("held") == "") & (F.col("out_lo") == F.col("out_hi")) & ((F.col("in_lo") != F.col("repo")) | (F.col("in_hi") != F.col("repo")))
    return large.join(span, ["hash", "files"]).where(~F.coalesce(origin, F.lit(False))).select("repo", "path")


#: What shows that a path is not hand-written; ``file_rules`` names them.
RULES = ("layout", "content", "subtree")


def file_rules(functions: DataFrame, path_col: str = "file_path", body_col: str = "body", repo_col: str | None = None) -> DataFrame:
    """(file_path, layout, content, subtree): the kinds that each sort of rule gives to a path as stored, as bit sets.

    A path counts by its own spelling for headers and layout; for the trees all
    spellings of a file are one. Without ``repo_col`` all paths are one
    repository, in which the folders of third parties are projects of their
    own. Null and empty bodies show nothing.
    """
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit("")) if repo_col else F.lit("")
    src = functions.where(F.col(path_col).isNotNull())
    read = src.select(F.col(path_col).alias("file_path"), F.col(body_col).alias("body"), repo.alias("repo")).mapInArrow(
        _scan, "repo string, file_path string, path string, layout int, content int, hash long, chars long"
    )
    rows = materialize(
        read.groupBy("repo", "file_path", "path", "hash").agg(F.max("chars").alias("chars"), F.bit_or("layout").alias("layout"), F.bit_or("content").alias("content"))
    )
    own = rows.groupBy("file_path").agg(F.bit_or("layout").alias("layout"), F.bit_or("content").alias("content"))
    once = rows.where(F.col("hash").isNotNull()).groupBy("repo", "path", "hash").agg(F.max("chars").alias("chars"))
    files = once.groupBy("repo", "path").agg(F.expr("bit_xor(xxhash64(hash))").alias("hash"), F.sum("chars").alias("chars"))
    shared = materialize(shared_subtrees(merkle_tree(files)).distinct())
    parts = F.split("path", "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = rows.select("repo", "file_path", "path").distinct().withColumn("path", F.explode(every))
    copies = join_on_keys(up, shared, ["repo", "path"], "file_path").select("file_path", F.lit(0).alias("layout"), F.lit(0).alias("content"), F.lit(VENDORED).alias("subtree"))
    all_ = own.withColumn("subtree", F.lit(0)).unionByName(copies)
    return all_.groupBy("file_path").agg(*[F.bit_or(c).alias(c) for c in RULES])


def file_kinds(functions: DataFrame, **cols) -> DataFrame:
    """(file_path, kinds) of every non-null path as stored; kinds is a bit set, 0 for hand-written."""
    kinds = F.col("layout").bitwiseOR(F.col("content")).bitwiseOR(F.col("subtree"))
    return file_rules(functions, **cols).select("file_path", kinds.alias("kinds"))


def not_hand_written(functions: DataFrame, **cols) -> DataFrame:
    """(file_path) of the generated, minified, vendored and data files."""
    return file_kinds(functions, **cols).where("kinds <> 0").select("file_path")
