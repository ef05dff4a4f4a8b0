"""Vectorised tokens: a batch of texts becomes one code-point array, classed and hashed by numpy, never per token.

Two token rules share the code-point classes:
``words`` - longest runs of letters and digits, each Chinese character (U+3400-U+9FFF) a word of its own;
``units`` - one Chinese character or kana, a longest run of other letters and digits, or any other single code point
that is not white space.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np

SPACE, LETTER, HAN, KANA, OTHER = range(5)
_MULTIPLIER, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def _cache() -> types.ModuleType:
    """Per-process memory that outlives a task; functions shipped by value would lose their own globals."""
    return sys.modules.setdefault("_lodestream_cache", types.ModuleType("_lodestream_cache"))


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower-case code point) of every code point, from the interpreter's own character data."""
    c = _cache()
    if not hasattr(c, "tables"):
        every = [chr(i) for i in range(0x110000)]
        kind = np.full(0x110000, OTHER, np.uint8)
        kind[np.fromiter((x.isalnum() for x in every), bool, 0x110000)] = LETTER
        kind[np.fromiter((x.isspace() for x in every), bool, 0x110000)] = SPACE
        kind[0x3040:0x3100] = KANA
        kind[0x3400:0xA000] = HAN
        lower = np.arange(0x110000, dtype=np.uint32)
        for i, x in enumerate(every):
            if x.isupper() and (y := x.lower()) != x:
                lower[i] = ord(y[0])
        c.tables = kind, lower
    return c.tables


def powers(n: int) -> np.ndarray:
    c = _cache()
    if len(getattr(c, "powers", ())) < n:
        p = np.empty(max(n, 256), np.uint64)
        p[0] = 1
        p[1:] = np.uint64(_MULTIPLIER)
        c.powers = np.multiply.accumulate(p)
    return c.powers


class Batch:
    """Tokens of some texts: ``doc`` (index of the text), ``start`` and ``stop`` (code points, in the joined batch), ``hash``."""

    def __init__(self, texts: list[str], rule: str, hashes: bool = True) -> None:
        kinds, lower = code_tables()
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[codes]
        if rule == "words":
            run = (kind == LETTER) | (kind == KANA)
            single = kind == HAN
        else:
            run = kind == LETTER
            single = (kind == HAN) | (kind == KANA) | (kind == OTHER)
        begins = run.copy()
        begins[1:] &= ~run[:-1]
        keep = run | single
        first = begins | single
        self.base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.start = np.flatnonzero(first)
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.kind = kind[self.start]
        at = np.flatnonzero(first[keep])
        length = np.diff(np.append(at, int(keep.sum())))
        self.stop = self.start + length
        self.hash = np.empty(0, np.uint64)
        if hashes and len(at):
            inside = np.arange(at[-1] + length[-1]) - np.repeat(at, length)
            value = (lower[codes[keep]].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()) + 1)[inside]
            h = np.add.reduceat(value, at)
            h ^= h >> np.uint64(31)
            h *= _MIX
            self.hash = h ^ (h >> np.uint64(29))

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.base) - 1)


def slices(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` code points (one longer text is a range of its own), to bound a batch's memory."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
