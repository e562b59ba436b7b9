"""Tokens and hashed shingles as the data sets define them."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import xxhash

_format_chars: re.Pattern | None = None

#: A token: a run of a-z, 0-9 and _, or one kana or CJK character.
TOKEN = re.compile("[a-z0-9_]+|[぀-ヿ㐀-䶿一-鿿]")


def format_chars() -> re.Pattern:
    """Matches the characters of category Cf."""
    global _format_chars
    if _format_chars is None:
        cf = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"]
        _format_chars = re.compile("[" + "".join(map(re.escape, cf)) + "]+")
    return _format_chars


def normalise(text: str) -> str:
    """NFKC, without characters of category Cf, in lower case."""
    if text.isascii():
        return text.lower()
    return format_chars().sub("", unicodedata.normalize("NFKC", text)).lower()


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(normalise(text)) if text else []


class TokenHasher:
    """64-bit hashes of tokens, kept for those seen last."""

    def __init__(self, keep: int = 200_000):
        self.seen: dict[str, int] = {}
        self.keep = keep

    def __call__(self, toks: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.keep:
            seen.clear()
        out = []
        for t in toks:
            h = seen.get(t)
            if h is None:
                h = seen[t] = xxhash.xxh3_64_intdigest(t)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` tokens."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(acc.view(np.int64))
