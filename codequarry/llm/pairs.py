"""Defective question and answer pairs, by labelling functions and a label model.

Several noisy functions vote for, against or not at all on each kind of
defect, all of them on every pair. A latent class model is fitted to the counts
of the vote patterns by expectation maximisation, which weighs the functions
without labelled rows; every label is kept whose posterior exceeds the cutoff.
The corpus is scanned once; only votes and hashes are shuffled and only pattern
counts reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.sentences import BEFORE_NUMBER, NEVER_LAST, units
from codequarry.session import join_on_keys, materialize

#: Kinds of defect, strongest first: where several labels are kept, the first one is reported.
DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
#: Labelling functions of each defect, by what they may vote.
FUNCTIONS = {
    "empty": ("no_words", "no_letters", "blank"),
    "copy": ("same_sequence", "no_new_token", "same_length"),
    "refusal": ("declines", "lacks", "asks_back", "every_sentence", "canned", "no_evidence"),
    "language": ("script", "words", "sentences"),
    "truncated": ("open_end", "open_pair", "dangling"),
}
#: Posterior above which a label is kept, validated on planted defects (tests/llm/test_pairs.py).
CUTOFF = 0.5
#: Different questions that must have got an answer, names and numbers apart, for it to be canned,
#: and the fewest words of such an answer.
CANNED_QUESTIONS, CANNED_WORDS = 3, 4

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}\p{Z}\p{M}--[\t\n\r ]]|[⠀ㅤ]", regex.V1)
_TAG = re.compile(r"<[^<>\n]*>|&[a-z]+;|&#\d+;")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_CODE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』')
_URL = re.compile(r"https?://\S+")
_NAME = re.compile(r"[A-Za-z0-9_./\\:#~-]*(?:[_/\\]|::|\.[a-z]|\d|\(\))[A-Za-z0-9_./\\:#()~-]*|\b[A-Z]+[a-z]+[A-Z]\w*")
_LABEL = (
    r"(?:the\s+)?(?:final\s+)?(?:answers?|response|reply|result|output|q|a|question|you asked|your question(?: (?:was|is))?|"
    r"antwort|frage|sie fragten|ihre frage|réponse|question posée|respuesta|pregunta|ответ|вопрос|"
    r"答案|回答|答|问题|问|回复|您问的是|你问的是|您的问题是|質問|回答は)"
)
_ONLY_LABEL = re.compile(rf"{_LABEL}\s*[:：.]?\s*", re.I)
_LEAD = re.compile(rf"^[\s>*#_\"'“-]*{_LABEL}[\s*_]*[:：][\s*_]*", re.I)
#: Labels before a repeated question whose colon is lost.
_LEADS = frozenset(
    "answer question q a youasked yourquestion yourquestionis yourquestionwas frage antwort siefragten ihrefrage 问题 问 您问的是 你问的是 您的问题是 答案 回答 答".split()
)
_CHARS = regex.compile(r"[^\W_]+")
_WORD = regex.compile(r"[\p{L}\p{N}_]+|[\p{Han}\p{Hiragana}\p{Katakana}]")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[^\W\p{Han}\p{Hiragana}\p{Katakana}]+")

#: Sorts of things that refusals say, by language; each is noisy by itself.
_DECLINES = re.compile(
    r"""\bI(?:'m|\s+am)\s+(?:very\s+|so\s+)?sorry\b|^\s*sorry\b|\bmust\s+decline\b|\bI\s+(?:have\s+to\s+|must\s+)?(?:decline|refuse)\b
    |\bI\s+(?:can\s?not|can't|could\s+not|couldn't|won't|will\s+not|am\s+not\s+able\s+to|am\s+unable\s+to)\s+(?:\w+\s+)?(?:answer|help|assist|comply|discuss|
      provide|comment|say|speculate|give|judge|review|determine|respond|fulfil)
    |\bI(?:'m|\s+am)\s+(?:not\s+able|unable|not\s+allowed|not\s+permitted)\b|\bas\s+an?\s+(?:AI|language)\b|\b(?:outside|beyond)\s+(?:what\s+I|the\s+scope|my\s+(?:scope|abilit|knowledge))
    |leider\s+(?:kann|darf)\s+ich|tut\s+mir\s+leid|darf\s+ich\s+(?:nichts|nicht)|kann\s+ich\s+(?:\w+\s+){0,4}nicht\s+(?:beantworten|beurteilen|sagen|prüfen)
    |als\s+(?:KI|Sprachmodell)|je\s+(?:suis\s+désolé|ne\s+peux\s+pas)|désolé|lo\s+siento|no\s+puedo\s+(?:responder|ayudar)
    |抱歉|对不起|無法|无法(?:回答|判断|提供|确定|评价|给出|查看|访问|说明|作答)|不予(?:作答|回答|置评)|恕(?:难|不|我)|超出了?我|作为一[个名](?:语言模型|AI|人工智能)|不便(?:评价|回答|透露)|不能回答|拒绝回答
    |申し訳|お答えできません|извините|не\s+могу\s+ответить""",
    re.I | re.X | re.M,
)
_LACKS = re.compile(
    r"""\b(?:not|isn't|is\s+no)\s+enough\s+(?:evidence|information|context|material)\b|\binsufficient\s+(?:evidence|information|context)\b
    |\bdo(?:es)?\s+not\s+have\s+access\b|\bdon't\s+have\s+(?:access|enough)\b|\b(?:context|material|excerpt|source)s?\s+(?:does|do)\s+not\s+(?:contain|include|show)\b
    |\bnothing\s+to\s+(?:go\s+on|work\s+with)\b|\bno\s+(?:answer|statement|conclusion)\s+(?:about\s+.{1,60}\s+)?(?:can|could|is)\b
    |nicht\s+genug\s+(?:Informationen|Kontext|Belege)|keine\s+(?:Antwort|Auskunft|Aussage)\s+(?:möglich|geben)|keine\s+Aussage\b.*\bmöglich|ohne\s+Zugriff\s+auf
    |没有足够的(?:证据|信息|上下文)|检索结果中没有""",
    re.I | re.X,
)
_ASKS_BACK = re.compile(
    r"""\b(?:could|can)\s+you\s+(?:please\s+)?(?:share|provide|paste|send)\b|\bplease\s+(?:provide|share|paste|send)\b|Bitte\s+(?:stellen|schicken|liefern)\s+Sie|请(?:您)?(?:提供|补充)""",
    re.I | re.X,
)
_SAYS = (_DECLINES, _LACKS, _ASKS_BACK)

#: Every alternative above holds one of these; most texts hold none, which is told faster.
_HINTS = (
    "sorry", "declin", "refus", "can't", "cannot", "can not", "could not", "couldn't", "won't", "will not", "unable", "not able", "not allowed", "not permitted", "as a", "no answer", "no statement", "no conclusion",
    "enough", "insufficient", "outside", "beyond", "have access", "nothing to", "don't have", "does not", "do not", "could you", "can you", "please", "leider", "tut mir", "darf ich", "kann ich", "als ki", "als sprachmodell",
    "nicht genug", "keine ", "ohne zugriff", "bitte", "désolé", "je suis", "je ne peux", "lo siento", "no puedo", "抱歉", "对不起", "無法", "无法", "不予", "恕", "超出", "作为一", "不便", "请", "没有足够", "检索结果", "不能回答", "拒绝",
    "申し訳", "お答え", "извините", "не могу",
)

_ASK = (
    ("en", re.compile(r"\b(?:answer|reply|respond|write)\w*\s+(?:\w+\s+)?in\s+english\b|用英[文语語]|auf\s+englisch|en\s+(?:anglais|inglés)|英語で", re.I)),
    ("zh", re.compile(r"\b(?:answer|reply|respond|write)\w*\s+(?:\w+\s+)?in\s+chinese\b|用中[文国]|用汉语|auf\s+chinesisch|en\s+(?:chinois|chino)|中国語で", re.I)),
    ("de", re.compile(r"\b(?:answer|reply|respond|write)\w*\s+(?:\w+\s+)?in\s+german\b|用德[文语語]|auf\s+deutsch|en\s+(?:allemand|alemán)|ドイツ語で", re.I)),
    ("fr", re.compile(r"\bin\s+french\b|用法[文语語]|auf\s+französisch|en\s+français", re.I)),
    ("es", re.compile(r"\bin\s+spanish\b|用西班牙[文语語]|auf\s+spanisch|en\s+español", re.I)),
    ("ja", re.compile(r"\bin\s+japanese\b|用日[文语語]|auf\s+japanisch|日本語で", re.I)),
)
_SCRIPTS = (
    ("kana", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("han", regex.compile(r"\p{Han}")), ("ru", regex.compile(r"\p{Cyrillic}")),
    ("ar", regex.compile(r"\p{Arabic}")), ("hi", regex.compile(r"\p{Devanagari}")), ("th", regex.compile(r"\p{Thai}")), ("ko", regex.compile(r"\p{Hangul}")),
)
_LATIN_WORD = regex.compile(r"\p{Latin}+")
_LETTERS = regex.compile(r"\p{L}+")
_STOP = {
    "en": """the a an of to and is are was were it its that this these with for from by on in at as be been has have had not no yes
        which who what when where why how does do did can could would should there their they them he she we you i but or only if
        before after because while until though although some any all each every both one see than then""",
    "de": """der die das den dem des ein eine einen einem einer und ist sind war waren wird werden wurde wurden nicht kein keine ja nein
        mit für von vom zum zur auf aus bei nach vor über unter zu im am an als wie wer was wann wo warum welche welcher sich sie er es
        ich wir ihn ihm dann nur noch auch aber oder wenn weil bevor nachdem seit jeder jede gibt hält""",
    "fr": """le la les un une des du de et est sont était ne pas que qui quoi quand où pourquoi comment avec pour par dans sur au aux ce
        cette ces il elle on nous vous ils mais ou si avant après depuis je se son sa ses plus oui non cas""",
    "es": """el la los las un una unos unas de del y es son era no que quién qué cuándo dónde por para con en al se su sus lo le este esta
        pero o si antes después desde como más sí caso porque nadie ¿por""",
}
#: Which of the languages a word is common in.
_COMMON = {w: tuple(k for k, v in _STOP.items() if w in v.split()) for x in _STOP.values() for w in x.split()}


def _prose(text: str) -> str:
    """The text without code, names, paths and links."""
    return _NAME.sub(" ", _URL.sub(" ", _CODE.sub(" ", _FENCE.sub(" ", text))))


@lru_cache(maxsize=65_536)
def _script_of(char: str) -> str:
    return next((k for k, p in _SCRIPTS if p.match(char)), "")


def _script(prose: str) -> str | None:
    if prose.isascii():
        return "latin" if _LETTERS.search(prose) else None
    n = dict.fromkeys([*(k for k, _ in _SCRIPTS), "latin"], 0)
    for char, times in Counter(prose).items():
        script = _script_of(char) if char > "ʯ" else ""
        if script:
            n[script] += times
    if n["kana"] + n["han"] and n["kana"] >= 0.1 * (n["kana"] + n["han"]):
        n["kana"], n["han"] = n["kana"] + n["han"], 0
    # one Latin word counts as one character of the other scripts' words do: two
    n["latin"] = 2 * len(_LATIN_WORD.findall(prose))
    best = max(n, key=n.get)
    return {"kana": "ja", "han": "zh"}.get(best, best) if n[best] else None


def _prose_language(prose: str, script: str | None) -> str | None:
    if script != "latin":
        return script
    hits = Counter(k for w in _LETTERS.findall(prose.lower()) for k in _COMMON.get(w, ()))
    best = hits.most_common(2)
    return None if not best or len(best) > 1 and best[0][1] == best[1][1] else best[0][0]


def language(text: str) -> str | None:
    """ISO code of the language of the prose; None if it has none or too little."""
    prose = _prose(text)
    return _prose_language(prose, _script(prose))


@lru_cache(maxsize=10_000)
def wanted_language(question: str) -> str | None:
    for lang, p in _ASK:
        if p.search(question):
            return lang
    return language(question)


def _strip_question(answer: str, question: str) -> str:
    """The answer after a leading repetition of the question."""
    words = question.split()
    if not words:
        return answer
    flat = _LEAD.sub("", re.sub(r"^[\s>*#\"“]+", "", answer))
    at = 0
    for k, w in enumerate(words):
        start = at
        while at < len(flat) and flat[at].isspace():
            at += 1
        if (k and at == start) or flat[at : at + len(w)].lower() != w.lower():
            return answer
        at += len(w)
    return flat[at:].lstrip('*"”!?.。 \t')


_BARE_MARK = re.compile(r"[-*+>]|\d+\.|#+")


def _vote(yes: bool, no: bool = False) -> str:
    return "1" if yes else "0" if no else "-"


def _open_end(body: str) -> bool:
    """Whether the text stops before its end, by its last line."""
    last = body.rstrip().rsplit("\n", 1)[-1].strip()
    if last.startswith("```"):
        return False
    if last.startswith("|"):
        return not last.endswith("|")
    if _BARE_MARK.fullmatch(last):
        return True
    if re.search(r"[.!?…。！？؟।｡](?:\s?[»›])?['\"”“’»›」』）)\]*_`]*$", last):
        return False
    item = re.sub(r"^(?:[-*+]|\d+\.)\s+|^>\s*", "", last)
    # an item, or a whole answer, that is but one name or place is complete
    item = re.sub(r"^\*\*|\*\*$", "", item)
    one = re.fullmatch(r"`[^`]+`|[\w./\\:~#()+-]+", item)
    if one and (item != last or body.strip() == last):
        return bool(re.fullmatch(r"[A-Za-z]{1,3}", item))
    before = body.rstrip()[: -len(last)].rstrip() if last else ""
    return not (one and (not before or before.endswith("\n")))


def _open_pair(body: str) -> bool:
    """An unclosed fence, code span, bracket or quotation in the last paragraph."""
    if body.count("```") % 2:
        return True
    rest = _FENCE.sub("", body)
    tail = rest.rstrip().rsplit("\n\n", 1)[-1]
    if tail.count("`") % 2 or tail.count('"') % 2:
        return True
    return any(
        tail.count(a) > sum(tail.count(c) for c in b)
        for a, b in (("(", ")"), ("（", "）"), ("“", "”"), ("„", "“”"), ("«", "»"), ("「", "」"), ("『", "』"))
        if not (a == "“" and "„" in tail)
    )


def _dangling(body: str) -> bool:
    """Ends in a bare list mark, a lead-in, a comma, or an abbreviation that cannot be last."""
    end = body.rstrip()
    last = end.rsplit("\n", 1)[-1].strip()
    if _BARE_MARK.fullmatch(last) or re.fullmatch(r"\|[-|\s]*", last) or end.endswith((":", "：", ",", "，", "、", ";", "；", "-")):
        return True
    word = re.search(r"([^\s(（]+)\.$", last[-60:])
    return bool(word and (word[1].lower() in NEVER_LAST or word[1].lower() in BEFORE_NUMBER and word[1] != "no"))


_SCRIPT_OF = {"en": "latin", "de": "latin", "fr": "latin", "es": "latin"}
#: Where the language may change: after a sentence, but not after a short word that may be an abbreviation.
_STOPS = re.compile(r"(?:(?<=[^\W\d_]{4}\.)|(?<=[!?…]))[\"'”’»)\]]*\s+|(?<=[。！？])|\n+")
_SIX_WORDS = re.compile(r"\W*(?:[^\W_]+\W+){5}[^\W_]")
_PLACE = re.compile(r"^\|.*\|\s*$|^\s*[-*+]\s+`?[\w./\\]+:\d+", re.M)


def canned_form(plain: str) -> str | None:
    """An answer's words without names and numbers, for comparison between questions; None if they are few."""
    words = _LETTERS.findall(_NAME.sub(" ", _URL.sub(" ", plain.lower())).replace("’", "'"))
    size = sum(1 if w[0] < "぀" else len(w) // 2 for w in words)
    return " ".join(words) if CANNED_WORDS <= size <= 60 else None


def votes(question: str | None, answer: str | None) -> tuple[str, str | None]:
    """One character per labelling function (1 for, 0 against, - no vote), and the answer's canned form.

    ``canned`` has no vote yet: it depends on the other answers.
    """
    question = question or ""
    visible = _INVISIBLE.sub(" ", answer or "").strip()
    # six words that are no markup are more than a label, which most answers show at once
    words = letters = not any(m in visible for m in "<&`") and bool(_SIX_WORDS.match(visible))
    if not words:
        bare = _TAG.sub(" ", re.sub(r"```\w*", " ", visible))
        bare = re.sub(r"[\s*_#>`~|:：.\-=+]+", " ", bare).strip()
        words = bool(bare) and not _ONLY_LABEL.fullmatch(bare)
        letters = bool(_WORD.search(bare))
    empty = _vote(not words, True) + _vote(not letters) + _vote(not visible)

    # marks may be lost anywhere, also inside of names, so letters and digits are compared
    told_back = _LEAD.sub("", visible).lower()
    q = "".join(_CHARS.findall(question.lower()))
    # most answers begin otherwise than any repetition
    first = "".join(_CHARS.findall(told_back[:80]))
    may_repeat = bool(q) and any((x + q * (len(first) // len(q) + 1)).startswith(first) for x in ("", *_LEADS))
    a = "".join(_CHARS.findall(told_back)) if may_repeat else ""
    times = len(a) // len(q) if q else 0
    lead = a[: len(a) - len(q) * times]
    same = bool(times) and a[len(lead) :] == q * times and (not lead or lead in _LEADS)
    asked = frozenset(_TOKEN.findall(question.lower())) if q else frozenset()
    inside = same or bool(q) and all(m.group() in asked for m in _TOKEN.finditer(told_back))
    copy = _vote(same, words) + _vote(inside and words, words) + _vote(same and not lead)

    body = _LEAD.sub("", _strip_question(visible, question))
    plain = _CODE.sub("X", _QUOTED.sub("Q", _FENCE.sub("", body)))
    plain = re.sub(r"^(?:[-*+>#]+|\d+\.)\s+", "", plain, flags=re.M)
    flat = plain.replace("’", "'")
    hits: list[set[int]] = []
    low = " ".join(flat.lower().split())
    if any(h in low for h in _HINTS):
        parts = (flat[x:y] for x, y in units(flat))
        hits = [{k for k, p in enumerate(_SAYS) if p.search(x)} for x in parts if not x.startswith("|")]
    evidence = "```" in body or bool(_PLACE.search(body))
    said = set().union(*hits)
    refusal = "".join(_vote(k in said, words) for k in range(len(_SAYS))) + _vote(bool(said) and all(hits), words) + "-" + _vote(False, evidence)

    want = wanted_language(question)
    prose = _prose(_QUOTED.sub(" ", body))
    script = _script(prose)
    lang = _prose_language(prose, script)
    known = want is not None
    by_script = _vote(known and script is not None and script != _SCRIPT_OF.get(want, want), known and script is not None)
    by_words = _vote(known and lang is not None and lang != want, known and lang is not None)
    langs = [x for x in (_prose_language(p, _script(p)) for p in _STOPS.split(prose)) if x] if known else []
    other = sum(x != want for x in langs)
    by_part = _vote(bool(langs) and other > 0.6 * len(langs), bool(langs))
    # the end of a text that only asks again, or of one that is wholly a refusal, is looked at like any other
    ends = _vote(_open_end(body), True) + _vote(_open_pair(body)) + _vote(_dangling(body)) if words and body.strip() else "---"
    return empty + copy + refusal + by_script + by_words + by_part + ends, canned_form(plain)


#: Share of for-votes of each function among defective and sound pairs before the fit:
#: the mean of a Beta prior that weighs as much as PRIOR_ROWS of its rows. It fixes
#: which class is the defect and keeps a function that votes rarely from drifting.
PRIOR = {
    "no_words": (0.99, 0.001), "no_letters": (0.9, 0.001), "blank": (0.6, 0.001),
    "same_sequence": (0.99, 0.001), "no_new_token": (0.9, 0.01), "same_length": (0.9, 0.01),
    "declines": (0.6, 0.005), "lacks": (0.3, 0.005), "asks_back": (0.15, 0.002), "every_sentence": (0.8, 0.001), "canned": (0.7, 0.05), "no_evidence": (0.5, 0.5),
        "script": (0.7, 0.001), "words": (0.95, 0.005), "sentences": (0.95, 0.01),
    "open_end": (0.9, 0.001), "open_pair": (0.4, 0.001), "dangling": (0.2, 0.001),
}
PRIOR_ROWS = 0.02  # as a share of all rows
ROUNDS = 50


def fit(patterns: list[str], counts: list[float], names: tuple[str, ...], rate: float = 0.03) -> dict[str, float]:
    """Posterior of the defect for every vote pattern, by expectation maximisation.

    Each function has a rate of for-votes among its votes in either class; no
    vote carries no evidence. Deterministic; depends on the counts only.
    """
    n = np.asarray(counts, dtype=float)
    v = np.array([list(p) for p in patterns]).reshape(len(patterns), len(names))
    yes, no = (v == "1").astype(float), (v == "0").astype(float)
    mean = np.array([PRIOR[x] for x in names])
    weight = PRIOR_ROWS * n.sum()
    p, share = mean.copy(), rate
    post = np.zeros(len(n))
    for _ in range(ROUNDS):
        like = [np.log(np.clip(p[:, c], 1e-6, 1 - 1e-6)) for c in (0, 1)]
        miss = [np.log(np.clip(1 - p[:, c], 1e-6, 1 - 1e-6)) for c in (0, 1)]
        odds = np.log(share) - np.log(1 - share) + yes @ (like[0] - like[1]) + no @ (miss[0] - miss[1])
        post = 1 / (1 + np.exp(-odds))
        share = float(np.clip((post @ n + rate * weight) / (n.sum() + weight), 1e-6, 0.5))
        for c, w in ((0, post * n), (1, (1 - post) * n)):
            size = weight * (share if c == 0 else 1 - share)
            p[:, c] = (w @ yes + mean[:, c] * size) / (w @ (yes + no) + size + 1e-12)
    return dict(zip(patterns, post))


def _scan(batches):
    for b in batches:
        got = [votes(q, a) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        forms = [None if f is None else xxhash.xxh3_64_intdigest(f) - (1 << 63) for _, f in got]
        asked = [xxhash.xxh3_64_intdigest(q or "") - (1 << 63) for q in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([v for v, _ in got], pa.string()), pa.array(forms, pa.int64()), pa.array(asked, pa.int64())], ["result_id", "votes", "form", "asked"]
        )


_CANNED_AT = [f for d in DEFECTS for f in FUNCTIONS[d]].index("canned")


def canned_votes(once: DataFrame) -> DataFrame:
    """The votes with that of ``canned`` put in: answers of the same form to several different questions."""
    by = once.where("form IS NOT NULL").select("form", "asked").distinct().groupBy("form").agg(F.count("*").alias("q")).where(F.col("q") >= CANNED_QUESTIONS)
    canned = join_on_keys(once, materialize(by.select("form", F.lit(1).alias("canned"))), ["form"], "result_id", "left")
    vote = F.when(F.col("canned").isNotNull(), "1").when(F.col("form").isNotNull(), "0").otherwise("-")
    put = F.concat(F.substring("votes", 1, _CANNED_AT), vote, F.expr(f"substring(votes, {_CANNED_AT + 2})"))
    return canned.select("result_id", put.alias("votes"))


def pair_posteriors(pairs: DataFrame) -> DataFrame:
    """(result_id, votes, one posterior column per defect) of every pair.

    A repeated result_id counts once; should its rows differ, the smallest vote
    pattern stands for it. Rows with a null result_id are left out; a null
    question leaves its functions without a vote; a null answer is empty.
    """
    scanned = pairs.where(F.col("result_id").isNotNull()).select(F.col("result_id").cast("long"), "question", "answer")
    scanned = scanned.mapInArrow(_scan, "result_id long, votes string, form long, asked long")
    once = materialize(scanned.groupBy("result_id").agg(F.min(F.struct("votes", "form", "asked")).alias("v")).select("result_id", "v.*"))
    once = materialize(canned_votes(once))
    out, at = once, 0
    for d in DEFECTS:
        names = FUNCTIONS[d]
        part = F.substring("votes", at + 1, len(names))
        # at most 3 ** len(names) patterns exist, whatever the number of rows
        rows = once.groupBy(part.alias("v")).agg(F.count("*").alias("n")).orderBy("v").collect()
        post = fit([r["v"] for r in rows], [r["n"] for r in rows], names) if rows else {}
        cases = reduce(lambda c, x: c.when(part == x[0], F.lit(float(x[1]))), post.items(), F.when(F.lit(False), F.lit(0.0)))
        out = out.withColumn(d, cases)
        at += len(names)
    return out


def defective_pairs(pairs: DataFrame, cutoff: float = CUTOFF, every_label: bool = False) -> DataFrame:
    """(result_id, defect) of the pairs with a label above the cutoff.

    By default the first of a pair's labels in the order of ``DEFECTS``, as a
    stronger defect causes weaker ones; with ``every_label`` all of them.
    """
    labelled = pair_posteriors(pairs)
    kept = F.array_compact(F.array(*[F.when(F.col(d) > cutoff, F.lit(d)) for d in DEFECTS]))
    labels = labelled.select("result_id", kept.alias("d")).where(F.size("d") > 0)
    if every_label:
        return labels.select("result_id", F.explode("d").alias("defect"))
    return labels.select("result_id", F.col("d")[0].alias("defect"))
