"""Sentence units of documents in many languages and scripts.

A text is first cut into blocks by its layout (blank lines, fences, headings,
list and quote marks). Inside a block the character properties of the sentence
break rules decide: a terminator of any script, the marks that close after it,
white space where the script uses it, and the class of what follows.
Abbreviations of the languages suppress a break, quotations and brackets hold
their sentences together, and Thai breaks at spaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Abbreviations that never end a sentence.
NEVER_LAST = frozenset(
    """e.g i.e cf vs approx incl excl resp max min viz al ca bzw vgl inkl evtl ggf sog usw.d z.b d.h u.a env ej
    см напр ср т.е""".split()
)
#: Titles, before a name; in lower case they are units or words.
TITLES = frozenset("Mr Mrs Ms Dr Prof St Sr Sra Mme Mlle Hr Fr".split())
#: Abbreviations that never end a sentence before a number.
BEFORE_NUMBER = frozenset(
    """no nos nr fig figs tab tabs sec secs ch chap vol eq pp pg abb abs kap art ziff bd num núm pág págs cap рис табл стр гл п
    № n°""".split()
)
#: Abbreviations that may end a sentence: they do so unless it goes on in lower case or with a number.
MAYBE_LAST = frozenset(
    """etc a.m p.m am.m jan feb mar apr jun jul aug sep sept oct nov dec inc ltd co corp bros usw др пр""".split()
)
#: German words after which a number with a point is an ordinal.
BEFORE_ORDINAL = frozenset("am der dem den des zum vom im jeder jedem jeden seit bis ab".split())

OPEN = {"(": ")", "（": "）", "[": "]", "［": "］", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", "【": "】", "《": "》"}
CLOSE = frozenset(OPEN.values()) | {'"', "”"}
_ALL = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
_TERMINATORS = "".join(regex.findall(r"[\p{SB=STerm}\p{SB=ATerm}]", _ALL))
#: Marks that close after a terminator: the closing ones of the property; it holds the opening ones too.
_SHUTTING = "".join(regex.findall(r"(?=\p{SB=Close})[^\p{Ps}\p{Pi}]", _ALL))
_CLOSERS = re.escape("".join(sorted({*CLOSE, *_SHUTTING}))) + "'’›*"
del _ALL
_WIDE = "。！？｡．﹒﹖﹗"
_PLAIN = ".!?…؟।॥۔።՞՜։"
#: Terminators that may stand inside of a word, so that white space must follow.
_SPACED = frozenset(_PLAIN) - frozenset("।॥؟") | frozenset("‼⁇⁈⁉․")
_MARK = re.compile(rf"(?P<marks>[{re.escape(_TERMINATORS + _PLAIN + _WIDE)}]+)(?P<close>(?:\s?[»›]|[{_CLOSERS}])*)")
_CONTINUES = regex.compile(r"\p{SB=SContinue}")
_PAIRED = re.compile("[" + re.escape("".join(OPEN) + "".join(CLOSE)) + "`]")
_WORD_BEFORE = regex.compile(r"[^\s(（\[\"“„«「『]*\Z")
_FORMAT = regex.compile(r"\p{Cf}+")
_NEXT = regex.compile(r"\p{Cf}*(\S*)")
_LETTER = re.compile(r"[^\W\d_぀-鿿]")
_PART = re.compile(r"[^\W\d_]{1,3}\.,?")
_THAI = re.compile("[฀-๿]")
_SPACE = re.compile(r"\s+")
_CJK_ON = frozenset("，、；：,;:）)〕】》」』”’")
_JA_ON = frozenset("とってのはがをにでもへ")

_LINE = re.compile(r"[^\n]*\n?")
_FENCE = re.compile(r"[^\S\n]{0,3}```")
_HEAD = re.compile(r"[^\S\n]{0,3}#{1,6}(?=[^\S\n]|\Z|\n)")
_ITEM = re.compile(r"[^\S\n]{0,3}(?:[-*>]|\d+\.)[^\S\n]")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the layout blocks; ``whole`` blocks are one unit."""
    at, n = 0, len(text)
    begin = None  # of the open paragraph or list item
    while at < n:
        end = _LINE.match(text, at).end()
        if _FENCE.match(text, at):
            if begin is not None:
                yield begin, at, False
                begin = None
            close = end
            while close < n:
                line = close
                close = _LINE.match(text, line).end()
                if _FENCE.match(text, line) and not text[line:close].strip().strip("`"):
                    break
            yield at, close, True
            at = close
            continue
        blank = not text[at:end].strip()
        head = not blank and _HEAD.match(text, at, end)
        if begin is not None and (blank or head or _ITEM.match(text, at, end)):
            yield begin, at, False
            begin = None
        if head:
            yield at, end, True
        elif not blank and begin is None:
            begin = at
        at = end
    if begin is not None:
        yield begin, n, False


def _held(s: str) -> list[tuple[int, int]]:
    """Spans of quotations, brackets and code that close inside ``s``; outermost ones, in order."""
    stack: list[tuple[str, int]] = []
    waits: Counter[str] = Counter()  # how many open marks wait for which end
    spans: list[tuple[int, int]] = []

    def shut(end: str, k: int) -> None:
        # what was opened inside and never closed goes with it, so no mark is passed twice
        while True:
            want, at = stack.pop()
            waits[want] -= 1
            if want == end:
                spans.append((at, k))
                return

    for m in _PAIRED.finditer(s):
        c, k = m.group(), m.start()
        code = bool(stack) and stack[-1][0] == "`"
        if code and c != "`":
            continue
        end = "“" if c == "”" and not waits["”"] and waits["“"] else c
        if waits[end] and (c in CLOSE or c == "`"):
            shut(end, k)
        elif c in OPEN or c in '"`':
            stack.append(("“" if c == "„" else OPEN.get(c, c), k))
            waits[stack[-1][0]] += 1
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _name_like(word: str) -> bool:
    """An identifier, path or code, which begins a sentence in lower case too."""
    return word[:1] in "`" or "_" in word or "::" in word or "(" in word or "/" in word


def _goes_on(word: str) -> bool:
    """Whether the word continues the sentence before it: lower case and no name."""
    return word[:1].islower() and not _name_like(word)


def _ends(s: str, m: re.Match) -> bool:
    """Whether the mark ends a sentence that something follows in the same block."""
    marks, close, end = m["marks"].replace("․", "."), m["close"], m.end()
    follows = s[end]
    spaced = follows.isspace()
    if not spaced:
        if marks[-1] in _WIDE:
            if follows in _CJK_ON:
                return False
            return not (close and follows in _JA_ON)
        if marks[-1] in "!?‼⁇⁈⁉" and "一" <= follows <= "鿿":
            return True
        if marks[-1] in "।॥؟":
            return True
        return marks[-1] not in _SPACED and not _CONTINUES.match(follows)
    word = _NEXT.match(s, _SPACE.match(s, end).end()).group(1)
    if marks[-1] in _WIDE:
        return True
    if close.strip("*'’") and _goes_on(word):
        return False
    if marks[0] == "…" or marks[:2] == "..":
        gap = m.start() and s[m.start() - 1].isspace()
        return not gap and not _goes_on(word) and not _name_like(word)
    if marks != ".":
        return True
    before = _FORMAT.sub("", _WORD_BEFORE.search(s, max(0, m.start() - 60), m.start()).group())
    low = before.lower()
    number = word[:1].isdigit()
    if low in NEVER_LAST or before in TITLES:
        return False
    if low in BEFORE_NUMBER and number:
        return False
    if low in MAYBE_LAST:
        return not (number or _goes_on(word))
    previous = s[max(0, m.start() - 60) : m.start() - len(before)].split()
    previous = previous[-1] if previous else ""
    if _LETTER.fullmatch(before) and not previous[-1:].isdigit():
        # an initial, or one part of an abbreviation written with spaces
        return not (before.isupper() or _PART.fullmatch(word) or _LETTER.fullmatch(previous[:-1]))
    if before.isdigit() and len(before) <= 2 and word[:1].isalpha():
        return previous.lower() not in BEFORE_ORDINAL
    return True


def _sentences(s: str) -> Iterator[int]:
    """Ends of the sentences inside a block, but for the last one."""
    held = _held(s)
    h = 0
    n = len(s)
    for m in _MARK.finditer(s):
        end = m.end()
        if end >= n:
            break
        while h < len(held) and held[h][1] < end:
            h += 1
        if h < len(held) and held[h][0] < end:
            continue
        if _ends(s, m):
            yield end


def _thai_breaks(s: str) -> Iterator[int]:
    """Gaps beside words of Thai script."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", s)]
    for (a, b), (c, d) in zip(words, words[1:]):
        if _THAI.search(s, a, b) or _THAI.search(s, c, d):
            if not (a == words[0][0] and _ITEM.match(s[a : b + 1])):
                yield b


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit, in code points."""
    out = []
    for a, b, whole in blocks(text):
        cuts: list[int] = []
        if not whole:
            s = text[a:b]
            mark = _ITEM.match(s)
            skip = mark.end() if mark else 0
            rest = s[skip:].rstrip()
            cuts = [a + skip + k for k in _sentences(rest)]
            if _THAI.search(s):
                cuts = sorted({*cuts, *(a + k for k in _thai_breaks(s))})
        for x, y in zip([a, *cuts], [*cuts, b]):
            while x < y and text[x].isspace():
                x += 1
            while x < y and text[y - 1].isspace():
                y -= 1
            if x < y:
                out.append((x, y))
    return out


def _scan(batches):
    for b in batches:
        sizes, flat = [], []
        for text in b.column(1).to_pylist():
            u = units(text)
            sizes.append(len(u))
            flat.extend(u)
        at = np.array(flat, dtype=np.int64).reshape(-1, 2)
        docs = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))
        yield pa.RecordBatch.from_arrays([docs, pa.array(at[:, 0]), pa.array(at[:, 1])], ["doc_id", "unit_start", "unit_end"])


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit_start, unit_end) of all units of all texts, without a shuffle.

    Null and blank texts have none; an unclosed fence runs to the end of its
    text. Every other character than white space is in exactly one unit.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = (
        docs.where(docs[text_col].isNotNull())
        .select(id_col, text_col)
        .mapInArrow(_scan, f"doc_id {kind}, unit_start long, unit_end long")
    )
    return out.withColumnRenamed("doc_id", id_col)
