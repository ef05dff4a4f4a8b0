"""Fixed-capacity containers filled by lexical retrieval.

The corpus is cut into shards of bounded size as it is read; each shard has its own BM25 inverted index (numpy postings).
The largest unused document seeds a container and queries the index with its own terms; its unused neighbours, best score
first, fill the container as far as they fit. Related texts so share a container. Nothing is shuffled: a shard
is packed by the task that read it and one container a shard is left unfilled at most by more than its gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens

#: A shard ends at this many documents or code points, whichever comes first; bounds a task's memory at every size.
SHARD_DOCS, SHARD_CHARS = 2048, 6_000_000


class Postings:
    """BM25 index of one shard: documents by term, with the term's weight in the document."""

    def __init__(self, doc: np.ndarray, term_hash: np.ndarray, n_docs: int, k1: float = 1.5, b: float = 0.75) -> None:
        order = np.argsort(term_hash, kind="stable")
        sorted_hash = term_hash[order]
        new = np.empty(len(order), bool)
        new[:1] = True
        new[1:] = sorted_hash[1:] != sorted_hash[:-1]
        term = np.cumsum(new) - 1
        n_terms = int(term[-1]) + 1 if len(term) else 0
        # tokens sorted by term and, the sort being stable and documents in order, by document within it
        d = doc[order]
        edge = new.copy()
        edge[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(edge)
        tf = np.diff(np.append(at, len(order))).astype(np.float32)
        self.docs, post_term = d[at], term[at]
        self.first = np.searchsorted(post_term, np.arange(n_terms + 1))
        df = np.diff(self.first)
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
        length = np.bincount(doc, minlength=n_docs).astype(np.float32)
        norm = k1 * (1 - b + b * length / max(length.mean() if n_docs else 1.0, 1e-9)).astype(np.float32)
        self.weight = idf[post_term] * tf * (k1 + 1) / (tf + norm[self.docs])
        # the terms of each document, as its query
        by_doc = np.argsort(self.docs, kind="stable")
        self.terms = post_term[by_doc]
        self.terms_first = np.searchsorted(self.docs[by_doc], np.arange(n_docs + 1))
        self.n_docs = n_docs

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's terms."""
        q = self.terms[self.terms_first[seed] : self.terms_first[seed + 1]]
        lo, n = self.first[q], self.first[q + 1] - self.first[q]
        if not len(q):
            return np.zeros(self.n_docs)
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        return np.bincount(self.docs[at], self.weight[at], self.n_docs)


def pack(sizes: np.ndarray, capacity: int, scores: Callable[[int], np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Containers as lists of (document, piece, tokens).

    A document above capacity is cut into full containers and a rest, which is an item like the others.
    """
    full, rest = np.divmod(sizes, capacity)
    exact = (full > 0) & (rest == 0)
    full[exact] -= 1
    rest[exact] = capacity
    out = [[(int(d), k, capacity)] for d in np.flatnonzero(full) for k in range(full[d])]
    unused = rest > 0
    smallest = np.sort(rest[unused])
    for seed in np.argsort(-rest, kind="stable"):
        if not unused[seed]:
            continue
        unused[seed] = False
        room = capacity - int(rest[seed])
        held = [(int(seed), int(full[seed]), int(rest[seed]))]
        if len(smallest) and room >= smallest[0]:
            fits = np.flatnonzero(unused & (rest <= room))
            if len(fits):
                order = fits[np.argsort(-scores(int(seed))[fits], kind="stable")]
                size = rest[order]
                while len(order):
                    d = int(order[0])
                    unused[d] = False
                    held.append((d, int(full[d]), int(rest[d])))
                    room -= int(rest[d])
                    keep = size <= room
                    keep[0] = False
                    order, size = order[keep], size[keep]
        out.append(held)
    return out


def _tokenizer_counts(path: str, pattern: str) -> Callable[[list[str]], np.ndarray]:
    """Token counts by a public byte-level tokenizer's rank file, loaded once a process."""
    cache = tokens._cache()
    if getattr(cache, "encoder_path", None) != path:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache.encoder, cache.encoder_path = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), path
    return lambda texts: np.array([len(cache.encoder.encode_ordinary(t)) for t in texts], np.int64)


#: Fixed value: the word pattern that the byte-level rank files go with.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pack_documents(
    docs: DataFrame, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None,
    pattern: str = BYTE_PATTERN, shard_docs: int = SHARD_DOCS, shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """(doc_id, container, piece, tokens, filled): the container, or containers, of each document.

    Sizes are units (see ``tokens``) or, with tokenizer_path, tokens of that public tokenizer. piece counts a document's
    parts from 0 and is above 0 only where it alone exceeds the capacity; filled is the container's sum of tokens.
    A null text, or one without a token, needs no room: container null, tokens 0. Repeated rows are items of their own
    (containers are named after a seed's doc_id, so those of repeated ids get a running number). An empty table gives an
    empty result; other columns are ignored.
    """

    def shard(ids: pa.Array, texts: list[str], number: int) -> pa.RecordBatch:
        sizes = np.zeros(len(texts), np.int64)
        docs_of, hashes = [], []
        for lo, hi in tokens.slices(texts):
            t = tokens.Batch(texts[lo:hi], "units")
            sizes[lo:hi] = t.counts()
            word = t.kind != tokens.OTHER
            docs_of.append(t.doc[word] + lo)
            hashes.append(t.hash[word])
        if tokenizer_path:
            sizes = _tokenizer_counts(tokenizer_path, pattern)(texts)
        index = Postings(np.concatenate(docs_of), np.concatenate(hashes), len(texts))
        names = ids.to_pylist()
        at, container, piece, size, filled = [], [], [], [], []
        for k, held in enumerate(pack(sizes, capacity, index.scores)):
            total, name = sum(x[2] for x in held), f"{names[held[0][0]]}.{number}.{k}"
            for d, p, s in held:
                at.append(d), container.append(name), piece.append(p), size.append(s), filled.append(total)
        for d in np.flatnonzero(sizes == 0):
            at.append(int(d)), container.append(None), piece.append(0), size.append(0), filled.append(0)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at, pa.int64())), pa.array(container, pa.string()), pa.array(piece, pa.int32()), pa.array(size, pa.int64()), pa.array(filled, pa.int64())],
            ["doc_id", "container", "piece", "tokens", "filled"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[str] = []
        chars = number = 0
        for b in batches:
            column, values, begin = b.column(0), b.column(1).fill_null("").to_pylist(), 0
            for i, t in enumerate(values):
                texts.append(t)
                chars += len(t)
                if len(texts) >= shard_docs or chars >= shard_chars:
                    ids.append(column.slice(begin, i + 1 - begin))
                    yield shard(pa.concat_arrays(ids), texts, number)
                    ids, texts, chars, begin, number = [], [], 0, i + 1, number + 1
            if begin < len(values):
                ids.append(column.slice(begin))
        if texts:
            yield shard(pa.concat_arrays(ids), texts, number)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, container string, piece int, tokens bigint, filled bigint")
