"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that its encoding
ends with. A suffix-link automaton over the vocabulary yields the tokens that
end at each byte; the one whose predecessor (the last token of the shorter
prefix) is pair-compatible is stored, and following the stored tokens
backwards gives the ids. The cost is linear in the text, whatever its form.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies; a parameter of ``encode_texts``.
VOCABULARY = os.environ.get("CODEQUARRY_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 16 << 20
#: Pre-tokens whose ids a worker keeps.
KEEP = 200_000

#: Splits text before the merges (fixed value of this vocabulary), with white
#: space as the Unicode property rather than as the module's own class.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins by which the vocabulary file writes bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixEncoder:
    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        alphabet = _byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in model["vocab"] if all(c in alphabet for c in t)}
        self.ids = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}  # merge order of a token; single bytes come first
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ia, ib = self.ids[raw[a]], self.ids[raw[b]]
            made = self.ids[raw[a] + raw[b]]
            self.rank[ia, ib] = k
            if made not in self.parts:
                self.parts[made] = (ia, ib)
                self.order[made] = k
        self.auto = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) == 1 or i in self.parts:
                self.auto.add_word(t.decode("latin-1"), (i, len(t)))
        self.auto.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.fits: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side in an encoding.

        They may not if, while both are built up merge by merge, a merge over
        the seam would come before one of the merges inside.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self._compatible(left, right)
            if len(self.fits) > 5 * KEEP:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the youngest merge of either side, one at a time. ``bound`` is the
        # order of the merge undone last: it was done while the seam stood open,
        # so a seam merge of smaller order would have been taken instead.
        bound = len(self.rank) + 1
        while True:
            seam = self.rank.get((left, right))
            if seam is not None and seam < bound:
                return False
            ol, orr = self.order.get(left, -1), self.order.get(right, -1)
            if ol < 0 and orr < 0:
                return True
            # of equal merges the left one is done first, so the right one is undone first
            if ol > orr:
                # a seam merge of this very order stands right of the inner one and comes later
                bound, left = ol, self.parts[left][1]
            else:
                # the inner merge stands right of the seam: a seam merge of equal order comes first
                bound, right = orr + 1, self.parts[right][0]

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8")
        whole = self.ids.get(data)
        if whole is not None and (len(data) == 1 or whole in self.parts):
            return (whole,)
        n = len(data)
        last = [(-1, 0)] * (n + 1)
        done = 0
        for at, (tok, size) in self.auto.iter(data.decode("latin-1")):
            end = at + 1
            if done == end:
                continue
            begin = end - size
            if begin == 0 or self.compatible(last[begin][0], tok):
                last[end] = (tok, begin)
                done = end
        out = []
        while n:
            tok, n = last[n]
            out.append(tok)
        return tuple(reversed(out))

    def __call__(self, text: str) -> list[int]:
        kept, out = self.kept, []
        for p in self.pattern.findall(text):
            ids = kept.get(p)
            if ids is None:
                if len(kept) > KEEP:
                    kept.clear()
                ids = self.piece(p)
                if len(p) < 200:
                    kept[p] = ids
            out.extend(ids)
        return out


_encoders: dict[int, PrefixEncoder] = {}


def _encoder(shared) -> PrefixEncoder:
    key = hash(shared.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PrefixEncoder(shared.value)
    return _encoders[key]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, ids): the token ids of every text; empty and null texts give an empty list.

    Texts are encoded as they are, without special tokens; strings that look
    like special tokens are ordinary text. One row per row of ``docs``, no shuffle.
    """
    if os.path.getsize(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                lists = [enc(t) if t else [] for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
