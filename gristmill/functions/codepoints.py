"""Tokenise whole batches of texts with array operations over Unicode code points.

A word is a maximal run of letters or digits, lower-cased by code point. All hashes are 64 bits
and depend on the text alone, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np

#: Code points under this are in one table per process; higher ones get rows for the batch that has them.
SMALL = 0x3000
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def worker_cache() -> dict:
    """A dict that lives as long as the Python process, however often functions are unpickled."""
    module = sys.modules.setdefault("_gristmill_worker_cache", types.ModuleType("_gristmill_worker_cache"))
    return module.__dict__.setdefault("items", {})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def properties(points: list[int]) -> dict[str, np.ndarray]:
    """Of each code point: word (letter or digit), letter, number, digit, space, upper, lower (mapped), value (random)."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in points]
    lower = np.array([ord(c.lower()[0]) if c.lower() != c else i for i, c in zip(points, chars)], dtype=np.uint32)
    return {
        "word": np.array([c.isalnum() for c in chars]),
        "letter": np.array([c.isalpha() for c in chars]),
        "number": np.array([c.isnumeric() and not c.isalpha() for c in chars]),
        "digit": np.array([c.isdigit() for c in chars]),
        "space": np.array([c.isspace() for c in chars]),
        "upper": np.array([c.isupper() for c in chars]),
        "lower": lower,
        "value": mix(lower.astype(np.uint64) + np.uint64(1)),
    }


def tables(points: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Tables of properties and the row of each code point; rare high ones get rows at the end."""
    cache = worker_cache()
    if "tables" not in cache:
        cache["tables"] = properties(list(range(SMALL)))
    small, high = cache["tables"], np.flatnonzero(points >= SMALL)
    if not len(high):
        return small, points
    distinct, at = np.unique(points[high], return_inverse=True)
    rows = points.copy()
    rows[high] = SMALL + at
    more = properties(distinct.tolist())
    return {k: np.concatenate([v, more[k]]) for k, v in small.items()}, rows


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    cache = worker_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            out = []
            for b in (BASE & MASK, pow(BASE, -1, 1 << 64)):
                x = np.full(n, b, dtype=np.uint64)
                x[0] = 1
                out.append(np.cumprod(x, dtype=np.uint64))
        cache["powers"] = tuple(out)
    return cache["powers"]


class Batch:
    """Code points of some texts, one after another with a NUL after each."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=self.n) + 1
        self.end = np.cumsum(size) - 1
        self.start = self.end - size + 1
        self.t, self.row = tables(self.cp)

    def has(self, name: str) -> np.ndarray:
        return self.t[name][self.row]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, position, side="left")

    def runs(self, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends (exclusive) of maximal runs of True."""
        edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
        if flag[0]:
            edge = np.concatenate([[0], edge])
        if flag[-1]:
            edge = np.concatenate([edge, [len(flag)]])
        return edge[0::2], edge[1::2]

    def span_hash(self, start: np.ndarray, end: np.ndarray, exact: bool = False) -> np.ndarray:
        """A hash of each span's characters; lower-cased unless exact."""
        value = mix(self.cp.astype(np.uint64) + np.uint64(1)) if exact else self.t["value"][self.row]
        power, inverse = powers(len(self.cp) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.cp) + 1, dtype=np.uint64)
            np.cumsum(value * power[: len(self.cp)], out=total[1:])
            return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: start, end, hash, document."""
        start, end = self.runs(self.has("word"))
        return start, end, self.span_hash(start, end), self.doc_of(start)


def batches(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int, Batch]]:
    """Whole texts grouped to about so many characters; a longer text is a batch of its own."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield first, i, Batch(texts[first:i])
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts), Batch(texts[first:])


def shingles(hashes: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of width words within one document, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            out *= np.uint64(BASE & MASK)
            out += hashes[i : i + n]
    at = np.flatnonzero(docs[:n] == docs[width - 1 :])
    return mix(out[at]), at


def word_hashes(text: str) -> np.ndarray:
    return Batch([text]).words()[2] if text else np.empty(0, np.uint64)
