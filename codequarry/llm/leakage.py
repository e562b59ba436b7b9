"""Held-out passages inside a corpus, by a generalised suffix automaton.

The automaton holds every token run of the held-out texts. It is built on the
executors, a block of texts at a time, and kept as a flat table of transitions.
A document's tokens are streamed through it; at each token the state tells the
longest held-out run that ends there. From the run length limit on, the state's
ancestor at that limit names the items. The corpus is only scanned; what it
finds is put together over the blocks, so results do not depend on them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.text import TOKEN, normalise, tokens
from codequarry.session import materialize

MIN_RUN = 15
#: Tokens of held-out text per automaton (some 60 MB in a Python worker); a larger
#: set is taken in blocks of whole items, each with one scan of the corpus.
BLOCK_TOKENS = 200_000
_GRAPHEME = regex.compile(r"\X")


class SuffixAutomaton:
    """Builds the automaton of the texts of some items."""

    def __init__(self, min_run: int):
        self.min_run = min_run
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.texts: list[tuple[int, list[int]]] = []

    def _state(self, size: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _extend(self, last: int, w: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        have = nxt[last].get(w)
        if have is not None:
            if size[have] == size[last] + 1:
                return have
            return self._clone(last, w, have)
        cur = self._state(size[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, item: int, toks: list[str]) -> None:
        if len(toks) < self.min_run:
            return
        ids = [self.words.setdefault(t, len(self.words)) for t in toks]
        last = 0
        for w in ids:
            last = self._extend(last, w)
        self.texts.append((item, ids))

    def packed(self) -> bytes:
        """The transitions as two flat arrays, with the items of each state at the run length limit."""
        n, width = self.min_run, max(1, len(self.words))
        base = [-1] * len(self.size)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            if self.size[v] >= n:
                up = self.link[v]
                base[v] = v if self.size[up] < n else base[up]
        items: dict[int, set] = {}
        go = {v * width + w: to for v, x in enumerate(self.next) for w, to in x.items()}
        matcher = Matcher(n, self.words, go, self.link, self.size, base, {})
        for item, ids in self.texts:
            for _, run, state in matcher.walk(ids):
                if run >= n:
                    items.setdefault(base[state], set()).add(item)
        arrays = [np.array(x, dtype=t) for x, t in ((list(go), np.int64), (list(go.values()), np.int32), (self.link, np.int32), (self.size, np.int32), (base, np.int32))]
        return pickle.dumps((n, list(self.words), *arrays, {v: tuple(sorted(x)) for v, x in items.items()}), 5)


class Matcher:
    """Streams documents through a packed automaton."""

    def __init__(self, min_run, words, go, link, size, base, items):
        self.min_run, self.words, self.go, self.link, self.size, self.base, self.items = min_run, words, go, link, size, base, items

    @classmethod
    def load(cls, packed: bytes) -> Matcher:
        n, words, at, to, link, size, base, items = pickle.loads(packed)
        return cls(n, {w: k for k, w in enumerate(words)}, dict(zip(at.tolist(), to.tolist())), link.tolist(), size.tolist(), base.tolist(), items)

    def walk(self, ids: list[int | None]) -> Iterator[tuple[int, int, int]]:
        """(place, longest run that ends there, state) of every token that ends one."""
        go, link, size, width = self.go.get, self.link, self.size, max(1, len(self.words))
        v = run = 0
        for at, w in enumerate(ids):
            if w is None:
                v = run = 0
                continue
            to = go(v * width + w)
            while to is None and v:
                v = link[v]
                run = size[v]
                to = go(v * width + w)
            if to is None:
                continue
            v, run = to, run + 1
            yield at, run, v

    def leaks(self, toks: list[str]) -> dict[int, list[list[int]]]:
        """item -> [first token, end token, longest run] of each passage; runs that touch are one passage."""
        get, n = self.words.get, self.min_run
        found: dict[int, list[list[int]]] = {}
        for at, run, state in self.walk([get(t) for t in toks]):
            if run >= n:
                # of the items that the run's last tokens name, each holds just these for sure
                for item in self.items[self.base[state]]:
                    spans = found.setdefault(item, [])
                    if spans and spans[-1][1] >= at + 1 - n:
                        spans[-1][1] = at + 1
                    else:
                        spans.append([at + 1 - n, at + 1, n])
                    spans[-1][2] = spans[-1][1] - spans[-1][0]
        return found

    def longest(self, toks: list[str]) -> int:
        """The longest run of one held-out text."""
        get = self.words.get
        return max((run for _, run, _ in self.walk([get(t) for t in toks])), default=0)


def _build(min_run: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        auto = SuffixAutomaton(min_run)
        for item, toks in sorted(zip(pdf["item"], map(list, pdf["toks"]))):
            auto.add(item, toks)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "packed": [auto.packed()]})

    return run


def _tokenised(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["item", "toks"])


def automata(items: DataFrame, id_col: str, text_cols: list[str], min_run: int, block: int) -> DataFrame:
    """(block, packed) of the automata, each over the texts of the items of one block.

    Items are spread by their hash over as many blocks as hold ``block`` tokens
    each, so a block holds about that many, and all texts of an item are in one.
    Texts too short for a leak are left out.
    """
    texts = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.explode(F.array(*[F.col(c) for c in text_cols])).alias("t"))
    toks = texts.where(F.col("t").isNotNull()).distinct().mapInArrow(_tokenised, "item long, toks array<string>")
    toks = materialize(toks.where(F.size("toks") >= min_run))
    total = toks.agg(F.sum(F.size("toks"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    spread = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    return materialize(toks.withColumn("block", spread).groupBy("block").applyInPandas(_build(min_run), "block int, packed binary"))


def _scan(shared, mode: str):
    def run(batches):
        auto = Matcher.load(shared.value)
        spans_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                toks = tokens(text)
                if len(toks) < auto.min_run:
                    continue
                found = auto.leaks(toks)
                if mode == "pairs":
                    out += [(doc, item, [s[:2] for s in spans], max(s[2] for s in spans)) for item, spans in found.items()]
                elif found:
                    out.append((doc, len(toks), merged(s[:2] for x in found.values() for s in x), auto.longest(toks)))
            cols = list(zip(*out)) or [()] * 4
            spans = pa.array([[{"first": x, "end": y} for x, y in s] for s in cols[2]], spans_type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), spans, pa.array(cols[3], pa.int64())],
                ["doc", "item" if mode == "pairs" else "n", "spans", "longest"],
            )

    return run


def merged(spans) -> list[list[int]]:
    """The union of spans, in order."""
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


_SPANS = "spans array<struct<first:long,end:long>>"


def _blocks(docs, items, doc_id, text_col, item_id, item_texts, min_run, block, mode, schema):
    spark = docs.sparkSession
    packed = automata(items, item_id, item_texts, min_run, block)
    out = None
    for row in packed.select("block").orderBy("block").collect():  # one row a block of held-out text
        # of a fixed size, whatever the corpus: only one block's automaton is with the driver at a time
        auto = spark.sparkContext.broadcast(bytes(packed.where(F.col("block") == row[0]).first()["packed"]))
        scan = docs.select(doc_id, text_col).where(F.col(text_col).isNotNull()).mapInArrow(_scan(auto, mode), schema)
        out = scan if out is None else out.unionByName(scan)
    return spark.createDataFrame([], schema) if out is None else out


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_texts: tuple[str, ...] = ("question", "reference_answer"), min_run: int = MIN_RUN, block: int = BLOCK_TOKENS,
) -> DataFrame:
    """(doc_id, item_id, spans, longest_passage) of every leak.

    A leak is a run of at least ``min_run`` tokens of one of the item's texts
    that is also a run of the document. ``spans`` are the passages [first
    token, end token) that such runs cover; the clean tokens between two of
    them are in none. Null and short texts have none. Item ids are integers;
    items without an id are left out.
    """
    schema = f"doc {docs.schema[doc_id].dataType.simpleString()}, item long, {_SPANS}, longest long"
    out = _blocks(docs, items, doc_id, text_col, item_id, list(item_texts), min_run, block, "pairs", schema)
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "spans", F.col("longest").alias("longest_passage"))


def _merge_sql(spans):
    """The union of sorted spans."""
    start = F.array().cast("array<struct<first:long,end:long>>")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        wide = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))
        touch = (F.size(acc) > 0) & (s["first"] <= last["end"])
        return F.when(touch, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wide))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, start, step)


def leak_verdicts(
    docs: DataFrame, items: DataFrame, max_run: int = 50, max_coverage: float = 0.2, doc_id: str = "doc_id",
    text_col: str = "text", item_id: str = "item_id", item_texts: tuple[str, ...] = ("question", "reference_answer"),
    min_run: int = MIN_RUN, block: int = BLOCK_TOKENS,
) -> DataFrame:
    """Per leaking document (doc_id, n_tokens, leaked_tokens, longest_run, spans, remove).

    ``spans`` are the leaked passages over all items, ``leaked_tokens`` the
    tokens in them. ``remove`` is set where the longest run exceeds ``max_run``
    tokens or more than ``max_coverage`` of the document is leaked.
    """
    schema = f"doc {docs.schema[doc_id].dataType.simpleString()}, n long, {_SPANS}, longest long"
    out = _blocks(docs, items, doc_id, text_col, item_id, list(item_texts), min_run, block, "docs", schema)
    # a document has one row a block, with at most as many spans as it has runs of the limit
    per = out.groupBy("doc").agg(F.max("n").alias("n_tokens"), F.max("longest").alias("longest_run"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"))
    per = per.withColumn("spans", _merge_sql(F.col("s")))
    leaked = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    per = per.withColumn("leaked_tokens", leaked)
    share = F.col("leaked_tokens") / F.col("n_tokens")
    return per.select(
        F.col("doc").alias(doc_id), "n_tokens", "leaked_tokens", "longest_run", "spans",
        ((F.col("longest_run") > max_run) | (share > max_coverage)).alias("remove"),
    )


def token_places(text: str) -> list[tuple[int, int]] | None:
    """(start, end) of every token in the text as it stands; None if normalising mixes places up."""
    if text.isascii():
        return [m.span() for m in TOKEN.finditer(text.lower())]
    at, flat = [], []
    for m in _GRAPHEME.finditer(text):
        piece = normalise(m.group())
        flat.append(piece)
        at += [m.span()] * len(piece)
    whole = "".join(flat)
    if TOKEN.findall(whole) != tokens(text):
        return None
    return [(at[m.start()][0], at[m.end() - 1][1]) for m in TOKEN.finditer(whole)]


def _cut(batches):
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            places = token_places(text) if spans else []
            if places is None:
                out.append(None)
                continue
            keep, upto = [], 0
            for s in spans or ():
                keep.append(text[upto : places[s["first"]][0]])
                upto = places[s["end"] - 1][1]
            out.append("".join([*keep, text[upto:]]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc", "text"])


def cut_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, text) of the documents without their leaked passages.

    Documents beyond the limits of ``leak_verdicts`` are left out whole; of the
    others the leaked passages are cut out as they stand. A leaking text whose
    normal form mixes up places is left out too. Texts without a leak, null ones
    included, stay as they are.
    """
    found = materialize(leak_verdicts(docs, items, doc_id=doc_id, text_col=text_col, **how).select(doc_id, "spans", "remove"))
    kept = docs.select(doc_id, text_col).join(found, doc_id, "left").where(~F.coalesce("remove", F.lit(False)))
    clean = kept.where("spans IS NULL").select(doc_id, text_col)
    kind = docs.schema[doc_id].dataType.simpleString()
    cut = kept.where("spans IS NOT NULL").select(doc_id, text_col, "spans").mapInArrow(_cut, f"doc {kind}, text string").where("text IS NOT NULL")
    return clean.unionByName(cut.select(F.col("doc").alias(doc_id), F.col("text").alias(text_col)))
