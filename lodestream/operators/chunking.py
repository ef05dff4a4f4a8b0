"""Traceable chunks of loaded documents: text, Markdown sections, code blocks, JSON leaves.

A table function over Arrow batches: each document is split on its own and its chunks carry where they came from. The
separators are tried from coarse to fine; a separator stays at the end of the piece before it (in code, at the start of
the piece after it), pieces are packed up to the size, and a chunk may repeat the end of the one before.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "、", ". ", "! ", "? ", "; ", ".", "!", "?", ";", "，", ",", " ", "")
#: Where code splits first, by language; other languages use the blank lines and lines of text.
CODE = {
    "python": ("\nclass ", "\ndef ", "\n\tdef ", "\n    def "),
    "javascript": ("\nfunction ", "\nconst ", "\nlet ", "\nclass "),
    "java": ("\nclass ", "\npublic ", "\nprotected ", "\nprivate "),
    "go": ("\nfunc ", "\ntype ", "\nvar ", "\nconst "),
    "rust": ("\nfn ", "\nimpl ", "\nstruct ", "\nenum "),
    "sql": ("\nCREATE ", "\nSELECT ", "\nINSERT ", "\nWITH "),
}
LANGUAGES = {"py": "python", "js": "javascript", "ts": "javascript", "java": "java", "go": "go", "rs": "rust", "sql": "sql"}
SCHEMA = (
    "doc_key string, chunk_id string, chunk_index int, content string, char_start bigint, char_end bigint, line_start bigint, line_end bigint, "
    "heading_path array<string>, json_path string, content_hash string, kind string"
)
Span = tuple[int, int]


def _parts(text: str, lo: int, hi: int, separator: str, at_start: bool) -> list[Span]:
    if not separator:
        return [(i, i + 1) for i in range(lo, hi)]
    edges, at = [lo], text.find(separator, lo, hi)
    while at >= 0:
        edge = at if at_start else at + len(separator)
        if edges[-1] < edge < hi:
            edges.append(edge)
        at = text.find(separator, at + len(separator), hi)
    return list(zip(edges, [*edges[1:], hi], strict=True))


def _packed(parts: list[Span], size: int, overlap: int) -> Iterator[Span]:
    held: list[Span] = []
    for part in parts:
        if held and part[1] - held[0][0] > size:
            yield held[0][0], held[-1][1]
            while held and (held[-1][1] - held[0][0] > overlap or part[1] - held[0][0] > size):
                held.pop(0)
        held.append(part)
    if held:
        yield held[0][0], held[-1][1]


def split_spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, at_start: bool = False, lo: int = 0, hi: int | None = None) -> list[Span]:
    """Spans of at most ``size`` characters, without the white space about them."""
    hi = len(text) if hi is None else hi
    if hi - lo <= size:
        raw = [(lo, hi)]
    else:
        n = next((i for i, s in enumerate(separators) if not s or text.find(s, lo, hi) >= 0), len(separators) - 1)
        raw, run = [], []
        for part in _parts(text, lo, hi, separators[n], at_start and n < len(separators) - len(SEPARATORS)):
            if part[1] - part[0] <= size:
                run.append(part)
                continue
            raw += _packed(run, size, overlap)
            run = []
            raw += split_spans(text, size, overlap, separators[n + 1 :] or ("",), at_start, *part)
        raw += _packed(run, size, overlap)
    out = []
    for a, b in raw:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
    return out


_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t#]*$", re.M)


def headings_at(text: str, end: int) -> list[str]:
    """The open headings, outermost first, of what ends at ``end``."""
    stack: list[tuple[int, str]] = []
    for m in _HEADING.finditer(text):
        if m.start() >= end:
            break
        level = len(m.group(1))
        stack = [x for x in stack if x[0] < level] + [(level, m.group(2))]
    return [h for _, h in stack]


def markdown_sections(text: str) -> list[Span]:
    """The stretches between headings of the first three levels, headings left out."""
    out, at = [], 0
    for m in _HEADING.finditer(text):
        if len(m.group(1)) <= 3:
            out.append((at, m.start()))
            at = m.end()
    return [(a, b) for a, b in [*out, (at, len(text))] if text[a:b].strip()]


def json_leaves(value: object, path: str = "$", parent: str | None = None) -> Iterator[tuple[str, str, str, str]]:
    """(path, parent path, label, text) of the scalars; a top-level key and an array's element are groups of their own."""
    if isinstance(value, dict):
        for k, v in value.items():
            p = f"{path}.{k}" if re.fullmatch(r"[A-Za-z_]\w*", k) else f"{path}['{k}']"
            yield from ((q, p if path == "$" and q == p else g, label or k, t) for q, g, label, t in json_leaves(v, p, path if path != "$" else p))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            p = f"{path}[{i}]"
            yield from ((q, g, label or f"[{i}]", t) for q, g, label, t in json_leaves(v, p, p))
    elif value is not None:
        text = value if isinstance(value, str) else json.dumps(value)
        yield path, parent or path, "", text


def json_chunks(text: str, size: int, overlap: int) -> list[tuple[str, str]] | None:
    """(json path, content) of grouped leaves, or None where the text is not JSON.

    Short leaves of a group share chunks as ``label: text`` lines; a long one is split, each piece led by its group's short
    ones. Where these take more than half the size, they are chunks of their own as well, and the first of them lead.
    """
    try:
        data = json.loads(text)
    except ValueError:
        return None
    groups: dict[str, list[tuple[str, str]]] = {}
    for _, group, label, value in json_leaves(data):
        groups.setdefault(group, []).append((label, value.strip()))
    out = []
    for group, leaves in groups.items():
        short = [f"{k}: {v}" for k, v in leaves if len(k) + 2 + len(v) <= size // 2]
        long = [(k, v) for k, v in leaves if len(k) + 2 + len(v) > size // 2]
        lines: list[str] = []
        for line in short:
            if lines and len("\n".join([*lines, line])) > size:
                out.append((group, "\n".join(lines)))
                lines = []
            lines.append(line)
        lead = "\n".join(lines)[: size // 2]
        if lines and (not long or len("\n".join(lines)) > len(lead)):
            out.append((group, "\n".join(lines)))
        for k, v in long:
            head = f"{lead}\n{k}: " if lead else f"{k}: "
            room = max(1, size - len(head))
            out += [(group, head + v[a:b]) for a, b in split_spans(v, room, min(overlap, room - 1))]
    return out


def chunks_of(content: str, file_type: str, size: int, overlap: int) -> Iterator[tuple[str, int | None, int | None, list[str], str | None, str]]:
    """(content, start, end, heading path, json path, kind); JSON chunks have no place of their own in the text."""
    kind = file_type.lower().lstrip(".")
    if kind in ("json", "jsonl") or (not kind and content[:1] in "{["):
        found = json_chunks(content, size, overlap)
        if found is not None:
            yield from ((c, None, None, [], p, "json") for p, c in found)
            return
    if kind in ("md", "markdown") or (kind in ("", "text") and _HEADING.search(content)):
        for lo, hi in markdown_sections(content):
            for a, b in split_spans(content, size, overlap, lo=lo, hi=hi):
                yield content[a:b], a, b, headings_at(content, b), None, "markdown"
        return
    if language := LANGUAGES.get(kind):
        spans = split_spans(content, size, overlap, CODE[language] + SEPARATORS, at_start=True)
        yield from ((content[a:b], a, b, [], None, "code") for a, b in spans)
        return
    yield from ((content[a:b], a, b, headings_at(content, b), None, "text") for a, b in split_spans(content, size, overlap))


def split_documents(docs: DataFrame, size: int, overlap: int, key: str = "doc_key") -> DataFrame:
    """Chunks (see SCHEMA) of documents (key, content, file_type).

    Line ends are normalised once, before offsets are taken, so offsets and line numbers agree. Null and blank contents
    have no chunk. Broken JSON is split as text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, content, kind in zip(f["k"], f["content"], f["kind"], strict=True):
                text = re.sub(r"\r\n?", "\n", content or "")
                for i, (c, a, b, path, where, how) in enumerate(chunks_of(text, kind or "", size, overlap)):
                    digest = hashlib.sha256(c.encode()).hexdigest()
                    line = (None, None) if a is None else (text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 1)
                    rows.append((k, f"{k}-{i + 1}-{digest[:12]}", i, c, a, b, *line, path, where, digest, how))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            for c in ("char_start", "char_end", "line_start", "line_end"):
                out[c] = out[c].astype("Int64")
            yield out

    picked = docs.selectExpr(f"cast(`{key}` AS string) AS k", "content", "file_type AS kind")
    return picked.mapInPandas(run, SCHEMA)
