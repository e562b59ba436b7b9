"""Issue bodies that hold no report: unfilled forms, filler, error pages, script notices.

A body is read as segments (lines without markup and field labels; of a line
that trusted rules know in part, its other sentences). Rules give trusted
labels: residue of a kind, or report where a segment names code. What the rules
don't know gets its label by propagation. A text that several issues hold, and
never without a trusted error or notice beside it and never in a report, is a
part of such pages. Segments are linked by near-duplicates: SimHash tables over
permuted bit blocks find candidates, the Hamming distance and the similarity of
the texts verify them, and residue labels spread through the connected
components. SimHash misses many pairs of that similarity; a join on prefixes of
the shingle sets finds all of them. A body is residue if all its segments are.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.text import normalise
from codequarry.session import join_on_keys, materialize

KINDS = ("placeholder", "filler", "error", "notice", "extra")
#: SimHash: 64 bits in BLOCKS blocks; a table for each choice of KEYED blocks finds
#: all pairs within MAX_BITS = BLOCKS - KEYED differing bits.
BLOCKS, KEYED, MAX_BITS = 6, 3, 3
SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
#: Issues that must hold an unknown text, each beside trusted page residue, for it to be part of the page.
COMPANY = 2
#: Segments of one table key that meet in one task.
BUCKET_ROWS = 256

#: A comment closes in its own line or at the end of a later one: an arrow in the text must not let a broken one swallow a report.
_COMMENT = re.compile(r"<!--(?:(?:(?!<!--)[^\n])*?-->|(?:(?!<!--|-->[^\n]*\S[^\n]*$).)*?-->(?=[^\S\n]*$))", re.S | re.M)
#: Names of a report's code. A comment of several paragraphs that holds one was never closed where it should be.
_REPORTED = re.compile(r"\w\(\)|(?<!\w)[a-z0-9]+_[a-z0-9_]|[\w-]/[\w./-]+\.\w|\b[A-Z][a-z]+[A-Z]\w")
_DROPPED = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(
    r"</?(?:!doctype|html|head|title|meta|link|body|div|span|p|br|hr|h[1-6]|a|b|i|u|em|strong|center|address|table|tbody|thead|tr|td|th|"
    r"ul|ol|li|img|form|input|button|label|noscript|section|header|footer|nav|main|article|pre|code|font|small|details|summary|iframe|sup|sub)\b[^<>]*>",
    re.I,
)
_MARK = re.compile(r"^(?:\s*(?:>|[-*+](?=\s)|#{1,6}(?=\s)|\d+[.)](?=\s)))+\s*")
_BOX = re.compile(r"^\s*(?:>\s*)*(?:[-*+]|\d+\.)\s*\[( ?)\]\s*(.*)$")
_SPAN = re.compile(r"[`*_~]{1,3}")

_PLACEHOLDER = re.compile(
    r"""\{\{[^{}]*\}\}|\{%[^{}%]*%\}|<%[^<>]*%>|\$\{[^{}]*\}|\#\{[^{}]*\}|%\{?[A-Za-z][\w ]*\}?%|\$[A-Za-z]\w*\$|(?<!\w)__[A-Za-z]\w*?__(?!\w)|@@?[A-Za-z]\w*@@?(?!\w)
    |\[\[[^\[\]]*\]\]|(?<![\w$\#%{]){[A-Za-z][\w .-]{0,30}\}(?!\})|(?<!\w)<[A-Za-z][\w -]{0,30}>(?!\w)|<(?:your|the|insert|enter|add|my|a|an|name|version|description|title|steps|os|environment|placeholder|text|please)\b[^<>]*>
    |[\[(<{【（](?:\s*(?:insert|enter|add|your|please|describe|fill|paste|write|put|todo|tbd|placeholder|replace|optional|required|e\.g\.|example|请|在此|此处|填写))[^\])>}】）]*[\])>}】）]
    |\bX{3,}\b|_{4,}|\?{3,}|`<[^<>`]*>`""",
    re.I | re.X,
)
#: Whole segments that fill nothing in (fixed values).
_BLANKS = re.compile(
    r"""(?:_?no\s+response_?|n\s*/\s*a|none|nothing|null|nil|undefined|tbd|tba|todo|fixme|wip|placeholder|untitled|empty|title|description|body|text|\.{2,}|…+|-+|—+|x{2,}|\?+|-
    |(?:please\s+)?(?:replace|insert|enter|add|write|put|type|fill\s+in|fill\s+out|delete|remove|edit|describe|paste|provide|attach)\b[^.!?]{0,60}(?:text|here|below|above|template|section|line|comment|description|logs?|version|steps|form|issue|problem|bug)s?\b[^.!?]{0,30}
    |your\s+(?:text|description|answer|message|comment|title|version|content|name)(?:\s+goes)?(?:\s+here)?|(?:sample\s+|some\s+|dummy\s+)?(?:text|content|description|message)\s+(?:goes\s+)?here|sample\s+text|(?:a\s+)?clear\s+and\s+concise\s+description\b.*
    |describe\s+(?:the|your)\s+(?:bug|issue|problem)\b.*|steps\s+to\s+reproduce(?:\s+the\s+behaviou?r)?|i\s+searched\s+(?:the\s+)?existing\s+issues
    |无|暂无|没有|待补充|待填写|待定|略|未填写|同上|空|请(?:在此|在这里|在下方|于此)?(?:处)?(?:填写|输入|描述|补充|粘贴|替换)[^。，]{0,20}|(?:在此|此处|这里)(?:填写|输入|描述|粘贴)[^。，]{0,20}|你的[^。，]{0,8}|此处[^。，]{0,8}内容|示例文本|占位(?:文本|符)?
    |keine\s+angabe|hier\s+(?:text|beschreibung)\s+(?:einfügen|eingeben))""",
    re.I | re.X,
)
#: Words of the usual filler text (fixed values).
_LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor incididunt ut labore et dolore
    magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure
    reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia
    deserunt mollit anim id est laborum massa nunc urna odio arcu quam diam nibh felis porta vero orci vitae tellus mauris ligula lacus
    turpis purus justo neque risus leo sem nec eget ac ante augue bibendum blandit condimentum congue cras cursus dapibus dictum
    dignissim donec efficitur egestas eleifend elementum etiam euismod facilisis faucibus fermentum feugiat finibus fringilla fusce gravida
    habitant hendrerit iaculis imperdiet integer interdum lacinia laoreet lectus libero lobortis luctus maecenas malesuada mattis maximus
    metus mi molestie mollis morbi nam netus nullam ornare pellentesque pharetra phasellus placerat porttitor posuere potenti praesent
    pretium proin pulvinar quisque rhoncus rutrum sagittis sapien scelerisque semper senectus sodales sollicitudin suscipit suspendisse
    tempus tincidunt tortor tristique ultrices ultricies vehicula vel venenatis vestibulum viverra vivamus volutpat vulputate
    eros erat accumsan aenean aliquam aliquet auctor convallis""".split()
)
#: Keyboard and metasyntactic filler (fixed values).
_DUMMY = frozenset("foo bar baz qux quux foobar asdf asdfg asdfgh asdfasdf qwer qwert qwerty qwertz zxcv zxcvb hjkl jkl sdf test testing tests blah bla xxx xyz abc abcd dummy sample hello world 测试 测试测试 啊啊啊".split())

_STATUS = r"(?:error\s*(?:code)?\s*:?\s*)?(?:4\d\d|5\d\d)"
_ERROR = re.compile(
    rf"""^{_STATUS}?[\s:|,.–—-]*(?:bad\s+(?:gateway|request)|not\s+found|page\s+not\s+found|file\s+not\s+found|forbidden|unauthori[sz]ed|access\s+denied|(?:internal\s+)?server\s+error|internal\s+error
      |(?:the\s+)?(?:service|server|site|page|website)(?:\s+is)?\s+(?:temporarily\s+)?(?:unavailable|overloaded|down)|temporarily\s+unavailable|service\s+temporarily\s+unavailable|gateway\s+time-?\s?out|(?:\w+\s+)?request\s+time-?\s?out|too\s+many\s+requests
      |method\s+not\s+allowed|gone|moved\s+permanently|request\s+entity\s+too\s+large|application\s+error|error)\b[\s.!]*$
    |^{_STATUS}[\s.]*$|^error\s*(?:code)?\s*[:#]?\s*\d*[\s.]*$|page\s+(?:that\s+)?(?:you\s+(?:are|were)\s+(?:looking\s+for|trying\s+to)|you\s+requested)|(?:could|can)\s*(?:not|n't)\s+be\s+(?:found|reached|displayed|loaded|served)[\s.!]*$
    |requested\s+(?:url|page|resource)\b.*\b(?:not\s+found|could\s+not)|page\s+(?:does\s+not|doesn't|no\s+longer)\s+exist
    |^(?:please\s+)?(?:try|reload|refresh)\b.{{0,40}}\b(?:again|later|page|minutes?|seconds?|moment)\b.{{0,25}}$|something\s+went\s+wrong|^(?:whoops|oops)\b
    |session\s+(?:has\s+)?(?:expired|timed\s+out)|^(?:please\s+)?(?:sign|log)\s*in\s+(?:again\b|to\s+(?:continue|view))|unexpected\s+error\s+(?:has\s+)?occurred|an?\s+(?:internal\s+)?error\s+(?:has\s+)?occurred|^we(?:'re|\s+are)\s+sorry\b|rate\s+limit\s+exceeded
    |currently\s+(?:undergoing|down\s+for)\s+maintenance|down\s+for\s+maintenance|under\s+maintenance|request\s+was\s+(?:blocked|denied|rejected|cancell?ed)|error\s+establishing\s+a\b.*\bconnection|^access\s+(?:to\s+this\s+(?:page|site)\s+)?(?:is\s+|has\s+been\s+)?denied|no\s+healthy\s+upstream|connection\s+(?:refused|reset|timed\s+out)[\s.]*$|^you\s+(?:do\s+not|don't)\s+have\s+permission\b|don't\s+have\s+permission\s+to\s+access
    |系统(?:繁忙|错误|维护)|稍后(?:再试|重试)|错误代码|访问的?页面(?:不存在|已)|页面(?:不存在|未找到|已被删除|找不到|出错)|无法(?:访问|显示)(?:此|该|本)?(?:页面|网站)|服务器(?:错误|内部错误|繁忙|开小差)|请求(?:超时|过于频繁)|登录(?:已)?(?:过期|失效|超时)|网关(?:超时|错误)|服务(?:暂时)?不可用
    |seite\s+(?:wurde\s+)?nicht\s+gefunden|interner\s+serverfehler|page\s+(?:non\s+trouvée|introuvable)|página\s+no\s+encontrada|ページが見つかりません""",
    re.I | re.X,
)
_NOTICE = re.compile(
    r"""(?:enable|activate|turn\s+on|allow|need|requires?|without|disabled|does\s+not\s+(?:run|support)|doesn't\s+(?:run|support)|switch\s+on)\b.{0,50}\b(?:java\s*-?scripts?|scripts?|scripting|cookies?)\b
    |\b(?:java\s*-?scripts?|scripts?|cookies?)\b.{0,40}\b(?:is|are|must\s+be|to\s+be|has\s+to\s+be|appears?)\b.{0,20}\b(?:disabled|enabled|required|blocked|off|needed|activated)|checking\s+(?:your|the|if\s+the)\s+(?:browser|connection|site)|(?:java\s*)?scripts?\s+execution|verify(?:ing)?\s+(?:that\s+)?you\s+are\s+(?:a\s+)?human
    |ddos\s+protection|browser\s+(?:is\s+)?(?:not|no\s+longer)\s+(?:be\s+)?supported|unsupported\s+browser|outdated\s+browser
    |just\s+a\s+moment|you\s+(?:will|are\s+being)\s+(?:be\s+)?redirected|complete\s+the\s+(?:security\s+check|captcha)
    |(?:启用|开启|打开|需要|支持|禁用|关闭|允许).{0,8}(?:java\s*script|脚本|cookies?)|(?:java\s*script|脚本|cookies?).{0,8}(?:被禁用|已禁用|未启用|才能)|正在检查您?的?浏览器|浏览器.{0,6}(?:不支持|检查)|aktivieren\s+sie\b.{0,20}(?:java\s*script|cookies)
    |(?:java\s*script|cookies)\b.{0,30}(?:aktivier|deaktiviert|erforderlich)|activer?\s+java\s*script|active\s+java\s*script|habilit\w+\s+java\s*script|javascriptを有効""",
    re.I | re.X,
)
#: Lines that come with error pages and say nothing else.
_EXTRA = re.compile(
    r"""^(?:host|server|node|edge|request[\s_-]*id|ray[\s_-]*id|trace[\s_-]*id|incident[\s_-]*id|error[\s_-]*(?:id|code|ref(?:erence)?)|reference|incident|ref|ray|status|code|time(?:stamp)?|date|url|path|ip|your\s+ip|client\s+ip|id|请求编号|错误编号|时间)\s*[:#=：]?\s*[\w.:/#+-]*$
    |^(?:incident|reference|ray|request|ticket)\s+(?:id\s+)?[\#\w.-]+$
    |^\(?\#?[0-9a-f-]{4,40}\)?$|^(?:nginx|apache|openresty|cloudflare|varnish|envoy|caddy|iis)\b[\w./ ()-]{0,20}$|^[a-z]+-\d+$|^(?:\[[^\]]{1,20}\]\([^)]*\)\s*[|·•/-]?\s*)+$|^(?:home|status|back|help|contact|retry|reload|menu|login|sign\s+in|search|about|docs)(?:\s*[|·•/-]\s*\w+)*$
    |^[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}$|^\d{4}-\d\d-\d\d[T ][\d:.Z+-]+$""",
    re.I | re.X,
)
_QUOTE = re.compile(r'"[^"\n]*"|“[^”\n]*”|「[^」\n]*」|`[^`\n]*`')
_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_LETTERS = regex.compile(r"\p{L}+")
_JSON_FIELD = re.compile(r'"(?:message|error|status|code|detail|title|statusCode|path|timestamp|documentation_url|request_id)"\s*:\s*("[^"]*"|[\w.]+)', re.I)
_FIELD = re.compile(r"^\s*([\w /()'?-]{1,40}|[一-鿿]{1,12})\s*[:：]\s*(.*)$")
#: What a report names: code, a path, an identifier, a version, a link, a hash.
_CODE = re.compile(
    r"`[^`]+`|\w+\(\)|\b[a-z0-9]+_[a-z0-9_]+|[\w-]+/[\w./-]+\.\w+|\b[A-Z][a-z]+[A-Z]\w+|::|->|;\s*$|[{}]\s*$|https?://|\bv?\d+\.\d+(?:\.\d+)?\b|\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{7,40}\b"
)
#: The commonest of these, told at a glance.
_PLAIN_CODE = re.compile(r"`[^`]+`|\w\(\)|::|->|https?://|(?<!\w)[a-z0-9]+_[a-z0-9_]")
_TICKET = re.compile(r"(?:reference|incident|request|ray|error|ticket|trace)?\s*(?:id|code|no\.?)?\s*[#:]?\s*\(?#?\b[0-9a-f]{3,}(?:[.-][0-9a-f]+)*\)?", re.I)
_NAMES_OF_NOTICE = re.compile(r"java\s*script|cloudflare|openresty", re.I)


_IN_BRACKETS = re.compile(r"\(\s*(?:insert|enter|add|your|please|describe|fill|paste|write|put|todo|tbd|placeholder|replace|optional|required|e\.g\.|example|请|在此|此处|填写)", re.I)
#: Every notice, and every sentence of an error page, holds one of these, which is told faster.
_NOTICE_HINTS = ("script", "cookie", "checking", "human", "ddos", "browser", "moment", "redirected", "captcha", "security check", "脚本", "浏览器")
_ERROR_HINTS = (
    "error", "bad", "found", "page", "forbidden", "unauthori", "denied", "unavailable", "overloaded", "down", "time", "too many", "not allowed", "gone", "moved", "too large", "be reached", "be displayed", "be loaded", "be served",
    "url", "resource", "try", "reload", "refresh", "wrong", "oops", "session", "sign in", "signin", "log in", "login", "occurred", "sorry", "limit exceeded", "maintenance", "request was", "upstream", "connection", "permission",
    "系统", "稍后", "错误", "页面", "无法", "服务", "请求", "登录", "网关", "seite", "serverfehler", "página", "ページ",
)


def _may_hold(text: str) -> bool:
    """Whether a placeholder may be in the text, by what every placeholder holds."""
    return any(c in text for c in "{%<$[@【（") or "__" in text or "???" in text or "xxx" in text.lower() or "(" in text and bool(_IN_BRACKETS.search(text))


def _has_placeholder(text: str) -> bool:
    return _may_hold(text) and bool(_PLACEHOLDER.search(text))


def _names_code(text: str) -> bool:
    return bool(_PLAIN_CODE.search(text) or _CODE.search(_NAMES_OF_NOTICE.sub("", text)))


def _sentence(p: str) -> str:
    """The residue kind of one sentence, or ''."""
    core = p.strip(" .。!！…*_~`\"'，,")
    if not core or re.fullmatch(r"\d{1,2}[.)]", p):
        return "blank"
    clauses = [c for c in re.split("[，,]", core) if c.strip()]
    if _BLANKS.fullmatch(core) or _BLANKS.fullmatch(p) or all(_BLANKS.fullmatch(c.strip()) for c in clauses):
        return "placeholder"
    words = _LETTERS.findall(p.lower())
    if len(words) >= 2 and sum(w in _LATIN for w in words) >= 0.8 * len(words):
        return "filler"
    if words and all(w in _DUMMY or re.fullmatch(r"(.)\1+", w) for w in words) and set(re.findall(r"\d+", p)) <= {"1", "12", "123", "1234", "12345"}:
        return "filler"
    bare = _QUOTE.sub(" ", p).strip()
    low = " ".join(bare.lower().split())
    if any(h in low for h in _NOTICE_HINTS) and _NOTICE.search(bare):
        return "notice"
    if (bare[:1].isdigit() or any(h in low for h in _ERROR_HINTS)) and _ERROR.search(bare) and not _CODE.search(_NAMES_OF_NOTICE.sub("", _TICKET.sub("", p))):
        return "error"
    return "extra" if _EXTRA.search(core) else ""


def _parts(text: str) -> list[str]:
    """The sentences of a segment."""
    return [p for p in re.split(r"(?<=[.!?])\s+|(?<=[。！？])", text) if p.strip()]


def _residue(text: str) -> str:
    """The residue kind of a segment that consists of residue only, or ''."""
    rest = _PLACEHOLDER.sub(" ", text) if _may_hold(text) else text
    if rest != text:
        left = re.sub(r"[^\W\d][\w ()/-]{0,30}\s*[:：=]", " ", rest)
        if not _ALNUM.search(left) or _residue(left.strip()) in ("placeholder", "filler", "blank"):
            return "placeholder"
    kinds = []
    for p in _parts(text):
        kinds.append(_sentence(p))
        if not kinds[-1]:
            return ""
    kinds = [k for k in kinds if k != "blank"] if any(k != "blank" for k in kinds) else kinds
    if not kinds:
        return ""
    if set(kinds) == {"blank"}:
        return "placeholder" if re.search(r"\.{2,}|…|_{3,}", text) else ""
    return next((k for k in kinds if k != "extra"), "extra")


def _kind(text: str, heading: bool) -> str:
    """'', a residue kind, 'label', 'report' or 'unknown' of one stripped segment."""
    if not text or not _ALNUM.search(text) and not re.search(r"\.{2,}|…|\?{3,}|_{4,}", text):
        return ""
    kind = _residue(text)
    if kind:
        return kind
    field = _FIELD.match(text)
    if heading or (field and not field[2].strip()):
        short = len(text) <= 60 and not _CODE.search(text)
        if short:
            return "label"
    if field and field[2].strip() and len(field[1].split()) <= 4:
        value = _kind(field[2].strip(), False)
        if value in ("placeholder", "filler"):
            return value
    return "report" if _names_code(text) else "unknown"


def _broken(comment: str) -> bool:
    return bool(re.search(r"\n[^\S\n]*\n", comment) and _REPORTED.search(comment))


def segments(body: str) -> list[tuple[str, str]]:
    """(text, kind) of every segment of a body that says anything."""
    out: list[tuple[str, str]] = []
    hints = [m.group() for m in _COMMENT.finditer(body) if not _broken(m.group())] if "<!--" in body else []
    text = _DROPPED.sub("\n", _COMMENT.sub(lambda m: m.group() if _broken(m.group()) else "\n", body) if hints else body)
    if re.search(r"</|<!doctype|<br|<hr", text, re.I):  # else such names in brackets are placeholders
        text = _TAG.sub("\n", text)
    if hints:
        out.append(("<!-- -->", "placeholder"))
    for line in text.splitlines():
        box = _BOX.match(line)
        if box:
            out.append((box[2].strip(), "placeholder"))
            continue
        heading = bool(re.match(r"\s*(?:>\s*)*#{1,6}\s", line) or re.fullmatch(r"\s*(?:>\s*)*\*\*[^*]+\*\*[:：]?\s*", line))
        if line.strip().startswith("```"):
            continue
        stripped = _MARK.sub("", line).strip()
        if re.fullmatch(r"\d{1,2}[.)]", stripped):  # an empty item of a numbered list
            continue
        if re.fullmatch(r"[{\[].*[}\]],?", stripped) and _JSON_FIELD.search(stripped) and not re.search(r"[\w\"]", _JSON_FIELD.sub("", stripped)):
            values = [v.strip('"') for v in _JSON_FIELD.findall(stripped)]
            kinds = [_kind(v, False) for v in values]
            if "error" in kinds or "notice" in kinds:
                out.append((stripped, "error"))
                continue
        cells = [c.strip() for c in stripped.strip("|").split("|")] if stripped.startswith("|") else [stripped]
        for cell in cells:
            plain = re.sub(r"\*\*|~~|(?<!\w)[*_](?=\w)|(?<=\w)[*_](?!\w)", "", cell) if not _has_placeholder(cell) else cell.replace("**", "")
            plain = plain.strip()
            kind = _kind(plain, heading)
            said = [(p, _sentence(p)) for p in _parts(plain)] if kind == "unknown" else []
            if len(said) > 1 and any(k in ("error", "notice") for _, k in said):
                out += [(p, k or "unknown") for p, k in said if k != "blank"]
            elif kind:
                out.append((plain, kind))
    return out


def skeleton(text: str) -> str:
    """A segment's text with numbers and host-like names masked, for comparison."""
    t = normalise(text)
    t = re.sub(r"[\w-]+(?:\.[\w-]+)+", " h ", t)
    return " ".join(re.findall(r"[^\W\d_]+|[一-鿿]", re.sub(r"\d+", " ", t)))


def simhash(text: str) -> int:
    """64-bit SimHash over the character trigrams of a skeleton."""
    grams = {text[k : k + 3] for k in range(max(1, len(text) - 2))}
    h = np.array([xxhash.xxh3_64_intdigest(g) for g in grams], dtype=np.uint64)
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    on = bits.sum(axis=0) * 2 > len(h)
    return int(np.packbits(on, bitorder="little").view(np.int64)[0])


def _word_shingles(text: str) -> set[tuple[str, ...]]:
    w = text.split()
    return {tuple(w[k : k + SHINGLE_WORDS]) for k in range(max(1, len(w) - SHINGLE_WORDS + 1))}


def _read(batches):
    for b in batches:
        ids, report, page, residue, seeds, unknown = [], [], [], [], [], []
        for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seg = segments(body)
            ids.append(i)
            found = [k for _, k in seg]
            page.append("error" in found or "notice" in found)
            report.append("report" in found or ("extra" in found and not page[-1]))
            # a form of labels alone is unfilled as well
            residue.append(any(k in ("placeholder", "filler", "error", "notice") for k in found) or bool(found) and set(found) == {"label"})
            seeds.append(sorted({skeleton(t) for t, k in seg if k in KINDS and k != "extra"} - {""}))
            unknown.append(sorted({skeleton(t) for t, k in seg if k == "unknown"}))
        text = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(report), pa.array(page), pa.array(residue), pa.array(seeds, text), pa.array(unknown, text)],
            ["id", "report", "page", "residue", "seeds", "unknown"],
        )


_EDGES = [round(k * 64 / BLOCKS) for k in range(BLOCKS + 1)]


def _tables(batches):
    """One row per segment and table: the bits of the table's blocks as the key."""
    masks = [sum(((1 << (_EDGES[j + 1] - _EDGES[j])) - 1) << _EDGES[j] for j in c) for c in combinations(range(BLOCKS), KEYED)]
    keys = np.array(masks, dtype=np.uint64)
    for b in batches:
        sims = np.array([simhash(t) for t in b.column("text").to_pylist()], dtype=np.int64)
        n = len(sims)
        table = np.tile(np.arange(len(keys), dtype=np.int32), n)
        bits = (sims.view(np.uint64)[:, None] & keys[None, :]).reshape(-1).view(np.int64)
        rep = np.repeat(np.arange(n), len(keys))
        yield pa.RecordBatch.from_arrays(
            [b.column("node").take(pa.array(rep)), b.column("seed").take(pa.array(rep)), pa.array(np.repeat(sims, len(keys))), pa.array(table), pa.array(bits)],
            ["node", "seed", "sim", "table", "bits"],
        )


def prefix_keys(text: str) -> list[int]:
    """Keys of which any two texts that ``_alike`` keeps share one.

    Of two sets of shingles as similar as MIN_SIMILARITY each holds all but a
    few of the other's, so their smallest hashes, those few and one more, meet.
    The last key is the text without spaces.
    """
    h = sorted({xxhash.xxh3_64_intdigest("\t".join(s)) for s in _word_shingles(text)})
    keys = h[: len(h) - math.ceil(MIN_SIMILARITY * len(h) - 1e-9) + 1] if len(h) > 1 else []
    return [*keys, xxhash.xxh3_64_intdigest(text.replace(" ", ""))]


def _prefixes(batches):
    """One row per segment and prefix key."""
    for b in batches:
        texts = b.column("text").to_pylist()
        keys = [prefix_keys(t) for t in texts]
        rep = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
        sizes = pa.array([len(_word_shingles(t)) for t in texts], pa.int64())
        bits = np.array([x for k in keys for x in k], dtype=np.uint64).view(np.int64)
        table = np.array([t for k in keys for t in [0] * (len(k) - 1) + [1]], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [b.column("node").take(rep), b.column("seed").take(rep), sizes.take(rep), pa.array(table), pa.array(bits)],
            ["node", "seed", "sim", "table", "bits"],
        )


def _alike(pdf_iter):
    for pdf in pdf_iter:
        keep = []
        for a, b in zip(pdf["ta"], pdf["tb"]):
            x, y = _word_shingles(a), _word_shingles(b)
            keep.append(len(x & y) >= MIN_SIMILARITY * len(x | y) or a.replace(" ", "") == b.replace(" ", ""))
        yield pdf.loc[keep, ["a", "b"]]


def _verified(nodes: DataFrame, kept: DataFrame, near: Column) -> DataFrame:
    """Links (a, b) between nodes that share a key (table, bits) of ``kept``, pass ``near`` and are alike.

    Only links with at least one unknown end are needed. A table key with many
    segments is cut into cells of ``BUCKET_ROWS`` that meet pairwise.
    """
    sizes = kept.groupBy("table", "bits").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    hot = sizes.where(F.col("m") > BUCKET_ROWS).select("table", "bits", F.ceil(F.col("m") / BUCKET_ROWS).cast("int").alias("nb"))
    rows = kept.join(hot, ["table", "bits"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    side = lambda s: rows.select("table", "bits", "lo", "hi", F.col("node").alias(s), *[F.col(c).alias(c + s) for c in ("sim", "seed", "own")])
    pairs = (
        side("a").join(side("b"), ["table", "bits", "lo", "hi"])
        .where((F.col("a") < F.col("b")) & ((F.col("owna") != F.col("ownb")) | (F.col("lo") == F.col("hi"))))
        .where(~(F.col("seeda") & F.col("seedb")) & near)
        .select("a", "b").distinct()
    )
    text = nodes.select("node", "text")
    both = pairs.join(text.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(text.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(_alike, "a long, b long")


def similar_segments(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between segments (node long, text, seed boolean) that are near-duplicates within MAX_BITS."""
    kept = materialize(nodes.mapInArrow(_tables, "node long, seed boolean, sim long, table int, bits long"))
    return _verified(nodes, kept, F.bit_count(F.col("sima").bitwiseXOR(F.col("simb"))) <= MAX_BITS)


def similar_shingles(nodes: DataFrame) -> DataFrame:
    """All links (a, b) between segments (node long, text, seed boolean) at MIN_SIMILARITY or more, at any SimHash distance."""
    kept = materialize(nodes.mapInArrow(_prefixes, "node long, seed boolean, sim long, table int, bits long"))
    # ``sim`` holds the number of shingles here; texts equal but for spaces may have any
    near = (F.col("table") == 1) | (F.least("sima", "simb") >= MIN_SIMILARITY * F.greatest("sima", "simb"))
    return _verified(nodes, kept, near)


def spread_labels(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) of all nodes whose connected component holds a seed (node)."""
    ends = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    reached = frontier = materialize(seeds.select("node").join(ends.select(F.col("a").alias("node")).distinct(), "node", "left_semi"))
    while frontier.take(1):
        step = frontier.join(ends, frontier["node"] == ends["a"]).select(F.col("b").alias("node")).distinct()
        frontier = materialize(step.join(reached, "node", "left_anti"))
        reached = materialize(reached.unionByName(frontier))
    return reached


def page_parts(read: DataFrame) -> DataFrame:
    """(text) of the unknown texts that belong to error pages and notices, by the company they keep.

    At least ``COMPANY`` issues hold such a text, all of them beside a trusted
    error or notice and none in a report.
    """
    each = read.select("id", F.explode("unknown").alias("text"), (F.col("page") & ~F.col("report")).alias("inside")).where("text <> ''")
    per = each.groupBy("text", "id").agg(F.min("inside").alias("inside"))
    return per.groupBy("text").agg(F.count("*").alias("n"), F.min("inside").alias("inside")).where(F.col("inside") & (F.col("n") >= COMPANY)).select("text")


def residue_found(issues: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """(id, by) of the issues whose body holds nothing but residue.

    ``by`` tells whether trusted rules know all of it ('rules') or some of it
    got its label by propagation ('propagation'). Null and blank bodies are no
    residue. An id that occurs with several bodies is residue if any of them
    is. Rows with a null id are left out.
    """
    read = materialize(
        issues.where(F.col(id_col).isNotNull() & F.col(body_col).isNotNull())
        .select(F.col(id_col).cast("string").alias("id"), F.col(body_col))
        .mapInArrow(_read, "id string, report boolean, page boolean, residue boolean, seeds array<string>, unknown array<string>")
    )
    parts = page_parts(read).withColumn("seed", F.lit(True))
    known = read.select(F.explode("seeds").alias("text"), F.lit(True).alias("seed"))
    # a text without letters can't be compared; its body is no residue
    open_ = read.select(F.explode("unknown").alias("text"), F.lit(False).alias("seed"))
    nodes = known.unionByName(open_).unionByName(parts).where(F.col("text") != "").groupBy("text").agg(F.max("seed").alias("seed"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    links = similar_segments(nodes).unionByName(similar_shingles(nodes))
    reached = spread_labels(links, nodes.where("seed"))
    spread = materialize(nodes.where("NOT seed").join(reached, "node").select("text").unionByName(parts.select("text")).distinct().withColumnRenamed("text", "u"))

    clear = read.where(~F.col("report"))
    sure = clear.where(F.col("residue") & (F.size("unknown") == 0)).select("id", F.lit("rules").alias("by"))
    asked = clear.where(F.size("unknown") > 0).select("id", "unknown", F.xxhash64("id", F.array_join("unknown", "\n")).alias("row"))
    each = asked.select("id", "row", F.size("unknown").alias("n"), F.explode("unknown").alias("u")).distinct()
    hits = join_on_keys(each, spread, ["u"], "row").groupBy("id", "row", "n").agg(F.count("*").alias("k"))
    carried = hits.where(F.col("k") == F.col("n")).select("id", F.lit("propagation").alias("by"))
    return sure.unionByName(carried).groupBy("id").agg(F.max("by").alias("by"))


def residue_bodies(issues: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """(id) of the issues whose body holds nothing but residue."""
    return residue_found(issues, id_col, body_col).select("id")
