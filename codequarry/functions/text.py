"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Question words that say nothing about code (fixed values).
STOP_WORDS = """a an the in on at to for of and or but is are was were be with by from it its this that these those i you he she we they my your
his her our their what which who when where why how all any both each few more most other some such no nor not only own same so than too very
can will just should now use using used error bug issue problem fix function code file class struct variable method call return void int char
float double bool string const static public private protected""".split()
#: Words of the programming language (fixed values).
KEYWORDS = """if else for while do switch case default break continue return goto try catch throw new delete class struct enum union typedef
typename template namespace using public private protected virtual override const static extern inline volatile mutable explicit operator sizeof
typeof decltype auto nullptr true false int char float double bool void long short signed unsigned size_t ssize_t uint32_t uint64_t int32_t
int64_t""".split()
#: Short words left out of the document index (fixed values).
INDEX_STOP_WORDS = """the and for are but not you all can had her was one our out get has him his how man new now old see two way who did its let put
say she too use with have this will your from they know want been good much some time very when come here just like long make many over such take
than them well were what would there their said each which does could should may might being doing done about into only other then under work also
back after first even because any these give day most""".split()


#: A word border between ASCII word characters and anything else, so that names
#: beside text without spaces are found too.
BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _lit(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern.replace(r"\b", BORDER)), F.lit(group))


def keywords(text: Column, most: int = 6) -> Column:
    """Words of a question without stop words: identifiers first, last one leading, then the others."""
    words = F.filter(_all(text, r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b"), lambda w: ~F.array_contains(_lit(STOP_WORDS + KEYWORDS), F.lower(w)))
    ident = F.filter(words, lambda w: w.contains("_") | F.substring(w, 2, 10_000).rlike("[A-Z]"))
    plain = F.filter(words, lambda w: ~(w.contains("_") | F.substring(w, 2, 10_000).rlike("[A-Z]")))
    return F.slice(F.concat(F.reverse(ident), plain), 1, most)


#: A word of the index in a text in lower case.
INDEX_WORD = "[a-z]{3,}"


def index_tokens(text: Column) -> Column:
    """Lower-case words of at least three letters without the index's stop words, repeats kept."""
    return F.filter(_all(F.lower(text), INDEX_WORD), lambda w: ~F.array_contains(_lit(INDEX_STOP_WORDS), w))


def entities(text: Column, most: int = 3) -> Column:
    """Qualified names, then names in camel case, of at least three characters."""
    found = F.concat(_all(text, r"\b[a-zA-Z_][a-zA-Z0-9_]*::[a-zA-Z_][a-zA-Z0-9_]*\b"), _all(text, r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b"))
    common = _lit(["function", "class", "module", "variable", "code"])
    return F.slice(F.filter(found, lambda e: (F.length(e) >= 3) & ~F.array_contains(common, F.lower(e))), 1, most)


def symbols(text: Column) -> Column:
    """Names in backticks, then snake-case names of more than five characters, each once."""
    snake = F.filter(_all(text, r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b", 1), lambda w: F.length(w) > 5)
    return F.array_distinct(F.concat(_all(text, "`([^`]+?)`", 1), snake))


def code_symbols(text: Column) -> Column:
    """Names that C-like code declares or defines: classes, then functions, of two characters at least."""
    classes = _all(text, r"\b(?:class|struct)\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    functions = _all(text, r"(?:^|\n)[A-Za-z_][A-Za-z0-9_:<>*& ]* [*&]?([A-Za-z_][A-Za-z0-9_:~]*)\(", 1)
    return F.array_distinct(F.filter(F.concat(classes, functions), lambda w: (F.length(w) >= 2) & ~F.array_contains(_lit(KEYWORDS), w)))


def fixed_issues(text: Column) -> Column:
    """Numbers after fix, close or resolve, as integers."""
    return F.transform(_all(text, r"(?i)(?:fixes?|closes?|resolves?)\s+#(\d+)", 1), lambda n: n.try_cast("int"))


def mentions(text: Column, least: int = 4) -> Column:
    """Names in backticks or before a bracket, each once, in order of kind and place."""
    found = F.concat(_all(text, "`([A-Za-z_][A-Za-z0-9_]*)`", 1), _all(text, r"([A-Za-z_][A-Za-z0-9_]*)\(", 1))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= least))


def has_code_reference(text: Column) -> Column:
    """A commit hash, a source path or a call."""
    like = lambda p: text.rlike(p.replace(r"\b", BORDER))
    return like(r"\b[0-9a-f]{7,40}\b") | like(r"[A-Za-z0-9_/]+\.(?:cpp|cc|cu|h|hpp|py)\b") | text.rlike(r"[A-Za-z_][A-Za-z0-9_]*\(")


def evidence(text: Column) -> Column:
    """``path:line`` references as structs (path, line); a number too large for a line is null."""
    found = _all(text, r"[A-Za-z0-9_./-]+\.[a-z]+:\d+")
    return F.transform(found, lambda e: F.struct(F.regexp_replace(e, r":\d+$", "").alias("path"), F.regexp_extract(e, r":(\d+)$", 1).try_cast("int").alias("line")))


def paths(text: Column) -> Column:
    return F.array_distinct(_all(text, r"[A-Za-z0-9_/]+/[A-Za-z0-9_]+[.](?:cpp|cc|cu|h|py)"))


def section(text: Column, heading: str) -> Column:
    """The lines after a heading up to the next one; null without it."""
    after = F.regexp_extract(text, r"(?ms)^#+ " + heading + r"[ \t]*$\n?(.*?)(?=^#|\z)", 1)
    return F.when(text.rlike(r"(?m)^#+ " + heading + r"[ \t]*$"), after)


def strip_dots(path: Column) -> Column:
    """Removes leading dots and slashes, each character by itself."""
    return F.regexp_replace(path, r"^[./]+", "")


def parameter_count(signature: Column) -> Column:
    """Parameters of a signature; commas inside of nested brackets do not count.

    A fold over the characters keeps the depth; templates count as brackets.
    """
    inner = F.regexp_extract(signature, r"(?s)\((.*)\)[^)]*$", 1)
    zero = F.struct(F.lit(0).alias("d"), F.lit(1).alias("n"))

    def step(s, c):
        up, down = c.isin("(", "<", "[", "{"), c.isin(")", ">", "]", "}")
        return F.struct((s["d"] + up.cast("int") - down.cast("int")).alias("d"), (s["n"] + ((c == ",") & (s["d"] == 0)).cast("int")).alias("n"))

    n = F.aggregate(F.split(inner, ""), zero, step, lambda s: s["n"])
    return F.when(F.trim(inner).isin("", "void"), 0).otherwise(n)


def ancestors(path: Column) -> Column:
    """The directories above a path, from the root on."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    name = basename(path)
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")


def language(path: Column) -> Column:
    """The suffix; headers and files without one count as cpp."""
    s = suffix(path)
    return F.when(s.isin("h", ""), "cpp").otherwise(s)


def elide(text: Column, most: int) -> Column:
    """Head and tail of a long text, the middle replaced by a mark."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.right(text, F.lit(half))))


def clean_markdown(text: Column) -> Column:
    """Without fences, images, link targets, tags and runs of blank lines."""
    t = F.regexp_replace(text, r"(?s)```.*?(```|\z)", "")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"<[^<>\n]*>", "")
    return F.trim(F.regexp_replace(t, r"\n\s*\n+", "\n\n"))


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section_no, title, body) split at headings; a text before the first one is section 0."""
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("k", "line"))
    head = F.col("line").rlike(r"^#{1,3} ")
    w = Window.partitionBy(id_col).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"head": head, "section_no": F.sum(head.cast("int")).over(w)})
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("k", "line"))))
    title = F.max(F.when(F.col("head"), F.regexp_replace("line", r"^#{1,3} +", "")))
    out = rows.groupBy(id_col, "section_no").agg(title.alias("title"), F.trim(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("body"))
    return out.select(id_col, F.col("section_no").cast("long").alias("section_no"), F.coalesce("title", F.lit("")).alias("title"), "body")


def json_from_reply(text: Column, schema: str) -> Column:
    """The object of a fenced block, or of the first to the last brace, of a reply."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    raw = F.when(fenced != "", fenced).otherwise(bare)
    return F.from_json(F.regexp_replace(raw, r",\s*([}\]])", "$1"), schema)


def gold_evidence(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, evidence_id, file, line_start, line_end, kind) of records like ``E1 file:a-b kind``.

    Records are split at semicolons of either width; a repeated id gets a
    number behind it.
    """
    each = records.select(id_col, F.posexplode(F.split(text_col, r"[;；]\s*(?=E\d+ )")).alias("k", "raw"))
    p = r"^\s*(E\d+)\s+([^:\s]+):(\d+)(?:-(\d+))?(?:\s+(\S+))?"
    x = lambda n: F.regexp_extract("raw", p, n)
    rows = each.select(id_col, "k", x(1).alias("e"), x(2).alias("file"), x(3).try_cast("int").alias("line_start"), F.coalesce(x(4).try_cast("int"), x(3).try_cast("int")).alias("line_end"), x(5).alias("kind")).where("e <> ''")
    n = F.row_number().over(Window.partitionBy(id_col, "e").orderBy("k")) - 1
    rows = rows.withColumn("n", n)
    return rows.select(id_col, F.when(F.col("n") == 0, F.col("e")).otherwise(F.concat("e", F.lit("_"), "n")).alias("evidence_id"), "file", "line_start", "line_end", "kind")


def identifiers_first(words: Column) -> Column:
    """Words in order, those with an underscore put in front one after the other, so the last of them leads."""
    has = lambda w: w.contains("_")
    return F.concat(F.reverse(F.filter(words, has)), F.filter(words, lambda w: ~has(w)))


#: What an identifier looks like in a question, upper and lower case alike (fixed values).
IDENTIFIERS = (r"\b[A-Z][a-z]+[A-Z][a-zA-Z0-9_]*\b", r"\b[a-z_][a-z0-9_]*_t\b", r"\b[A-Z]{2,}_\w+\b")


def _once_lower(words: Column) -> Column:
    """The first of the words that are equal but for case."""
    low = F.transform(words, lambda w: F.lower(w))
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_position(low, F.get(low, k - 1)) == k), lambda k: F.get(words, k - 1))


def rewrite(questions: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """The search terms of every question (question): (question, identifiers, keywords, queries, kinds).

    ``identifiers`` are at most ten words of three characters or more in the
    order of their patterns. ``keywords`` are at most twelve: identifiers, the
    code words of the ``terms`` that the question contains, acronyms, and the
    parts of code words of several words. ``queries`` are at most eight: the
    first identifiers, the first keywords together, and pairs. ``kinds`` tell
    what each identifier is.
    """
    q, none = F.col("question"), F.array().cast("array<string>")
    word = lambda x: F.length(x) >= 3
    ident = F.filter(F.concat(*[_all(q, "(?i)" + p) for p in IDENTIFIERS]), word)
    said = F.array(*[F.when(q.contains(k), F.array(*[F.lit(x) for x in v])) for k, v in terms.items()]) if terms else F.array(none)
    out = questions.select("question", ident.alias("all"), F.array_distinct(F.flatten(F.array_compact(said))).alias("found"))
    out = out.withColumn("identifiers", F.when(F.size("all") > 0, F.slice(_once_lower(F.col("all")), 1, 10)).otherwise(none))
    plain = F.filter("found", lambda x: word(x) & ~x.contains(" "))
    parts = F.filter(F.flatten(F.transform(F.filter("found", lambda x: x.contains(" ")), lambda x: F.split(x, " "))), word)
    out = out.withColumns({"low": F.transform("identifiers", lambda w: F.lower(w)), "every": F.filter(F.concat("identifiers", plain, _all(q, r"\b[A-Z]{2,}\b"), parts), word)})
    # a type's name says no more than the identifier it ends
    out = out.withColumn("every", F.filter("every", lambda w: ~(F.endswith(w, F.lit("_t")) & F.array_contains("low", F.substring(w, F.lit(1), F.greatest(F.length(w) - 2, F.lit(0)))))))
    out = out.withColumn("keywords", F.when(F.size("every") > 0, F.slice(_once_lower(F.col("every")), 1, 12)).otherwise(none))
    pairs = F.flatten(F.transform(F.slice("identifiers", 1, 2), lambda a: F.transform(F.filter(F.slice("keywords", 1, 3), lambda b: F.lower(a) != F.lower(b)), lambda b: F.concat(a, F.lit(" "), b))))
    together = F.when(F.size("keywords") > 0, F.array(F.array_join(F.slice("keywords", 1, 3), " "))).otherwise(none)
    kind = lambda w: F.when(w.rlike("^[A-Z]{2,}_"), "macro").when(w.endswith("_t"), "type").when(w.rlike("^[A-Z][a-z]+[A-Z]"), "class").otherwise("unknown")
    return out.select("question", "identifiers", "keywords", F.slice(F.array_distinct(F.concat(F.slice("identifiers", 1, 3), together, pairs)), 1, 8).alias("queries"), F.transform("identifiers", kind).alias("kinds"))


def cited_files(text: Column, heading: str) -> Column:
    """The places of the list under a heading line, in order: (path, line)."""
    items = F.regexp_extract(text, rf"(?m)^(?:#+ )?{heading}[ \t]*\n((?:- [^\n]*(?:\n|\z))+)", 1)
    return evidence(items)


def markdown_chunks(text: Column, most: int = 600) -> Column:
    """Chunks of a text of at most ``most`` characters: whole sections while they fit, longer ones by lines.

    A line that is longer by itself is one chunk.
    """
    sections_ = F.filter(F.transform(F.split(text, r"\n(?=##?\s)"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
    head = F.lit(r"^(#{1,3}\s+[^\n]+)\n([\s\S]*)$")
    laid = F.transform(sections_, lambda s: F.when(F.regexp_like(s, head), F.concat(F.trim(F.regexp_extract(s, r"^(#{1,3}\s+[^\n]+)\n([\s\S]*)$", 1)), F.lit("\n\n"), F.regexp_replace(F.regexp_extract(s, r"^(#{1,3}\s+[^\n]+)\n([\s\S]*)$", 2), r"^\s+|\s+$", ""))).otherwise(s))
    # pieces with what joins them to the piece before: a section that is too long comes as its lines, the first of which starts anew
    line = lambda x, sep, new: F.struct(x.alias("t"), F.lit(sep).alias("sep"), new.alias("new"))
    pieces = F.flatten(F.transform(laid, lambda s: F.when(F.length(s) > most, F.transform(F.split(s, "\n"), lambda x, k: line(x, "\n", k == 0))).otherwise(F.array(line(s, "\n\n", F.lit(False))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, p):
        fits = (F.length(acc["now"]) + F.length(p["t"]) <= most) & ~p["new"]
        more = F.when(acc["now"] == "", p["t"]).otherwise(F.concat(acc["now"], p["sep"], p["t"]))
        full = F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.when(fits, F.struct(acc["done"].alias("done"), more.alias("now"))).otherwise(F.struct(full.alias("done"), p["t"].alias("now")))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


#: What a function's name says about its work (fixed values).
SEMANTIC_TAGS = {
    "init": r"_(init|new|create|alloc)\b", "free": r"_(free|destroy|release|delete|cleanup|clear)\b", "forward": r"_(forward|compute|calc|run|exec|apply)\b", "get": r"\bget_|_\bget\b", "set": r"\bset_|_\bset\b",
    "sample": r"_sample|_sampler|_prob", "quant": r"_quant|_dequant|_iq_", "io": r"_load|_save|_read|_write|_parse|_dump|_encode|_decode", "graph": r"_graph|_node|_edge", "backend": r"_backend|_device|_dev_",
    "mem": r"_mem|_alloc|_buffer|_pool", "sync": r"_sync|_barrier|_fence", "thread": r"_thread|_parallel|_worker", "token": r"_token|_tok_", "kv": r"_kv_|_kv_cache",
}


def semantic_tags(name: Column) -> Column:
    """The tags of a name, or ``other``."""
    low = F.lower(name)
    tags = F.array_compact(F.array(*[F.when(low.rlike(p.replace(r"\b", BORDER)), F.lit(k)) for k, p in SEMANTIC_TAGS.items()]))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("other")))


def two_tiers(path: Column, tiers: list[tuple[str, str]], name: Column, inner: dict[str, list[tuple[str, str]]]) -> Column:
    """(tier1, tier2): the first prefix in ``tiers`` that the path has, and the first name prefix of that tier in ``inner``."""
    one = F.coalesce(*[F.when(path.startswith(p), F.lit(k)) for p, k in tiers], F.lit("other"))
    two = F.lit(None).cast("string")
    for tier, prefixes in inner.items():
        two = F.when(one == tier, F.coalesce(*[F.when(name.startswith(p), F.lit(k)) for p, k in prefixes], F.lit("other"))).otherwise(two)
    return F.struct(one.alias("tier1"), two.alias("tier2"))


def label_tier(labels: Column, tiers: list[tuple[str, list[str]]], other: str) -> Column:
    """The first tier (name, labels) that shares a label with the array."""
    out = F.lit(other)
    for name, words in reversed(tiers):
        out = F.when(F.arrays_overlap(F.coalesce(labels, F.array().cast("array<string>")), _lit(words)), name).otherwise(out)
    return out


def ranking_score(weight: Column, created: Column, ages: list[tuple[str, float]], oldest: float, unknown: float, stale: Column, stale_factor: float, bonus: Column) -> Column:
    """weight x age x staleness x (1 + bonus), at most 1; ``ages`` are (first day, factor), newest first."""
    age = F.when(created.isNull(), unknown)
    for day, factor in ages:
        age = age.when(created >= F.lit(day).cast("timestamp_ntz"), factor)
    return F.least(F.lit(1.0), weight * age.otherwise(oldest) * F.when(stale, stale_factor).otherwise(1.0) * (1.0 + bonus))


def code_signals(text: Column) -> Column:
    """Whether a text has a commit hash, a source path and a call, as a struct of booleans; false for null."""
    like = lambda p: F.coalesce(text.rlike(p.replace(r"\b", BORDER)), F.lit(False))
    return F.struct(
        like(r"\b[0-9a-f]{7,40}\b").alias("commit"), like(r"(?i)\b[\w/.-]+\.(c|cpp|h|cc|cxx|hpp)(\b|:\d+)").alias("path"), like(r"\b([a-zA-Z_][a-zA-Z0-9_]{2,30})\s*\(").alias("call")
    )
