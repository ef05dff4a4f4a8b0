"""Oversized items cut at natural boundaries by packing their structure tree.

The text's headings, pages, lists, tables, markup, JSON nesting, paragraphs and lines make a tree of spans. Only nodes
above the limit are entered; the pieces of their children are merged from the bottom up while they fit. A line above the
limit is entered further by sentences, clauses, words and, where it has none, characters. Pieces are exact stretches of
the stored text, so nothing is lost or rewritten; each begins with a natural stretch of the end of the one before.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Levels of boundaries, strongest first: 0 pages, 1-6 headings, then those below; list items and JSON commas by depth.
_PAGE, _BLOCK, _PARAGRAPH, _ITEM, _LINE = 0, 7, 8, 9, 40
_STRUCTURE = re.compile(
    r"(?P<page>\f)|^(?P<heading>#{1,6})[ \t]|(?P<blank>(?:\r\n?|\n)(?:[ \t　]*(?:\r\n?|\n))+)"
    r"|^(?P<item>[ \t]*)(?:[-*+•][ \t]|\d{1,3}[.)、][ \t]?)|(?P<tag></?(?:h(?P<rank>[1-6])|p|div|section|article|ul|ol|li|tr|table)\b[^>]{0,200}>)|(?P<line>\r\n?|\n)",
    re.M | re.I,
)
_JSON = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{},]', re.S)
_FINE = (
    re.compile(r"(?:[.!?…]+[\"'”’)\]]*(?=\s)|[。！？｡]+[\"'”’）」』]*)\s*"),
    re.compile(r"(?:[,;:](?=\s)|[，；：、])\s*"),
    re.compile(r"\s+"),
)


def structure(text: str) -> list[tuple[int, int]]:
    """(position, level) of the structural boundaries, by position; a boundary lies before the text it introduces."""
    level: dict[int, int] = {}
    put = lambda at, n: level.__setitem__(at, min(n, level.get(at, n)))
    if text.lstrip()[:1] in ("{", "[") and (text.lstrip()[:2].rstrip() in ("{", "[") or text.lstrip()[1:2] in '"{['):
        depth = 0
        for m in _JSON.finditer(text):
            c = m.group()
            if c in "{[":
                depth += 1
            elif c in "}]":
                depth = max(0, depth - 1)
                if not depth:
                    put(m.end(), 1)
            elif c == ",":
                put(m.end(), min(1 + depth, _LINE - 1))
        for m in re.finditer(r"\r\n?|\n", text):
            put(m.end(), _LINE)
    else:
        after_heading = -1
        for m in _STRUCTURE.finditer(text):
            kind = m.lastgroup if m.lastgroup != "rank" else "tag"
            if kind == "page":
                put(m.end(), _PAGE)
            elif kind == "heading":
                put(m.start(), len(m.group("heading")))
                end = re.compile(r"[\r\n]|$").search(text, m.end()).start()
                after_heading = end
            elif kind == "tag":
                rank = m.group("rank")
                put(m.end() if m.group().startswith("</") else m.start(), int(rank) if rank and not m.group().startswith("</") else _BLOCK)
            elif kind == "item":
                put(m.start(), _ITEM + min(len(m.group("item").expandtabs(4)) // 2, 20))
            elif m.start() != after_heading:  # a heading stays with what it heads
                put(m.end(), _PARAGRAPH if kind == "blank" else _LINE)
    return sorted((p, n) for p, n in level.items() if 0 < p < len(text))


def _whole(text: str, at: int, lo: int) -> int:
    """The nearest place at or before ``at`` that parts no accent, joiner or line end from its base."""
    while at > lo + 1 and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n" or "\U0001f3fb" <= text[at] <= "\U0001f3ff"):
        at -= 1
    return at


def _merge(parts: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    out = [parts[0]]
    for lo, hi in parts[1:]:
        if hi - out[-1][0] <= limit:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _spans(lo: int, hi: int, cuts: list[int]) -> list[tuple[int, int]]:
    edges = [lo, *cuts, hi]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _line(text: str, lo: int, hi: int, limit: int, finer: int = 0) -> list[tuple[int, int]]:
    if hi - lo <= limit:
        return [(lo, hi)]
    if finer == len(_FINE):
        out = []
        while hi - lo > limit:
            at = _whole(text, lo + limit, lo)
            out.append((lo, at))
            lo = at
        return [*out, (lo, hi)]
    parts = _spans(lo, hi, [m.end() for m in _FINE[finer].finditer(text, lo, hi) if lo < m.end() < hi])
    return _merge([x for a, b in parts for x in _line(text, a, b, limit, finer + 1)], limit)


def _tree(text: str, lo: int, hi: int, at: list[int], level: list[int], limit: int) -> list[tuple[int, int]]:
    if hi - lo <= limit:
        return [(lo, hi)]
    i, j = bisect.bisect_right(at, lo), bisect.bisect_left(at, hi)
    if i == j:
        return _line(text, lo, hi, limit)
    top = min(level[i:j])
    children = _spans(lo, hi, [at[k] for k in range(i, j) if level[k] == top])
    return _merge([x for a, b in children for x in _tree(text, a, b, at, level, limit)], limit)


def split_text(text: str, limit: int = 1200, overlap: int = 200) -> list[tuple[int, int, int]]:
    """(start, own, end) of each piece: text[start:end] has at most ``limit`` characters and repeats text[start:own]."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)] if n else []
    points = structure(text)
    cores = _tree(text, 0, n, [p for p, _ in points], [x for _, x in points], limit - overlap)
    out = [(cores[0][0], cores[0][0], cores[0][1])]
    for (before, _), (lo, hi) in zip(cores, cores[1:], strict=False):
        floor = max(before, lo - overlap)
        start = lo
        for pattern in _FINE:
            # the earliest sentence, else clause, else word, that lies within the overlap
            found = next((m.end() for m in pattern.finditer(text, floor, lo) if m.end() < lo), None)
            if found is not None:
                start = found
                break
        else:
            start = _whole(text, floor, before) if floor > before else floor
            if lo - start > overlap:
                start = lo
        out.append((start, lo, hi))
    return out


def split_items(df: DataFrame, key: str, content: str, limit: int = 1200, overlap: int = 200) -> DataFrame:
    """(key, piece, start, own, end, text): pieces of at most ``limit`` code points of each row's content.

    start and end are code-point offsets in the content as stored; own is where the part not repeated from the piece
    before begins, so the texts from own on make up the content again. Content within the limit is one piece. Null and
    empty contents have no piece; repeated rows are split each; an empty table gives an empty result; other columns are
    ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "piece", "start", "own", "stop", "text"]
        for b in batches:
            ids = b.column(0)
            rows: list[tuple] = []
            size = 0

            def flush(rows: list[tuple], ids: pa.Array = ids) -> pa.RecordBatch:
                i, p, s, o, e, t = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i)).cast(arrow), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(o, pa.int64()), pa.array(e, pa.int64()), pa.array(t, pa.string())], names
                )

            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                for p, (s, o, e) in enumerate(split_text(text, limit, overlap)):
                    rows.append((i, p, s, o, e, text[s:e]))
                    size += e - s
                    if size > 4_000_000:
                        yield flush(rows)
                        rows, size = [], 0
            if rows:
                yield flush(rows)

    picked = df.where(F.col(content).isNotNull()).select(F.col(key).alias("k"), F.col(content).alias("c"))
    out = picked.mapInArrow(run, f"k {kind.simpleString()}, piece int, start bigint, own bigint, stop bigint, text string")
    return out.withColumnsRenamed({"k": key, "stop": "end"})
