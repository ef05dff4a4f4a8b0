"""Evaluation passages inside training text, by spaced-seed hashing.

Fixed masks of a span of tokens ignore some positions, so a seed still hits where single tokens were substituted.
The evaluation side's seeds become a bitmap of fixed size (4 MB however many cases there are); the corpus is scanned
once, JVM to Arrow to numpy, and only positions whose seed is in the bitmap leave the scan, each with the tokens after
it. They join the evaluation seeds by hash, and the tokens around each hit are compared position by position.
Neither the texts nor their tokens are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: kind of passage: (least run in words, masks). Every mask spans at most the run, so each run holds a whole seed.
#: A 1 is a position that must agree, a 0 one that may differ.
KINDS = {
    "words": (12, ("110110101111", "111011010111")),
    "characters": (24, ("110111011010111011101101",)),
}
_BITS = 25  # of the bitmap's addresses


def _seed_hashes(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the mask's positions at every start; empty when there are fewer tokens than the span."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    weight = tokens.powers(len(mask) + 2)
    for i, bit in enumerate(mask):
        if bit == "1":
            out += h[i : i + n] * weight[i + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(30))


def _addresses(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return seeds >> np.uint64(64 - _BITS), (seeds & np.uint64((1 << _BITS) - 1))


def _hits(batch: tokens.Batch, bitmap: np.ndarray | None, only: np.ndarray | None = None) -> Iterator[tuple]:
    """(mask number, run, token positions, seeds) of each mask; with a bitmap only seeds in it."""
    number = 0
    for kind, (run, masks) in KINDS.items():
        for mask in masks:
            seeds = _seed_hashes(batch.hash, mask, number)
            n = len(batch.hash) - run + 1  # a hit needs the whole run within its text
            if n > 0:
                seeds = seeds[:n]
                ok = batch.doc[:n] == batch.doc[run - 1 : run - 1 + n]
                if bitmap is not None:
                    a, b = _addresses(seeds)
                    ok &= (bitmap[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at = np.flatnonzero(ok)
                    b = b[at]
                    at = at[(bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                else:
                    at = np.flatnonzero(ok)
                yield number, kind, run, at, seeds[at]
            number += 1


def _windows(h: np.ndarray, at: np.ndarray, run: int) -> pa.Array:
    flat = h[at[:, None] + np.arange(run)].reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * run), pa.array(flat))


def _evaluation_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, fields, kinds, texts = (b.column(i).to_pylist() for i in range(4))
        for lo, hi in tokens.slices(texts):
            t = tokens.Batch(texts[lo:hi], "words")
            for number, kind, run, at, seeds in _hits(t, None):
                at_kind = np.array([k == kind for k in kinds[lo:hi]], bool)[t.doc[at]] if len(at) else np.empty(0, bool)
                at, seeds = at[at_kind], seeds[at_kind]
                if len(at):
                    doc = t.doc[at] + lo
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seeds.view(np.int64)), pa.array(np.full(len(at), number, np.int32)), pa.array([ids[d] for d in doc]), pa.array([fields[d] for d in doc]), pa.array((at - np.searchsorted(t.doc, t.doc[at])).astype(np.int32)), _windows(t.hash, at, run)],
                        ["seed", "mask", "case_id", "field", "case_pos", "case_window"],
                    )


def _bitmap_part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (_BITS - 3), np.uint8)
    for b in batches:
        for a in _addresses(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
            np.bitwise_or.at(bits, a >> np.uint64(3), (1 << (a & np.uint64(7))).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()])], ["bits"])


def leaked_passages(
    docs: DataFrame, cases: DataFrame, doc_id: str = "doc_id", text: str = "text", character_languages: tuple[str, ...] = ("zh",)
) -> DataFrame:
    """(doc_id, case_id, field, hits, exact_hits, best_match): every document sharing a seed window with a case.

    cases: ``case_id``, ``field``, ``language``, ``passage``, one row a passage. best_match is the largest share of equal
    tokens in a window of 12 words (24 characters for character_languages) around a hit, 1.0 where a whole window agrees,
    less where tokens were substituted; exact_hits counts the windows that agree wholly.

    Null, empty and short texts or passages share nothing and give no row; repeated rows of a document or case count
    once; empty tables give an empty result; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    kind = F.when(F.col("language").isin(*character_languages), "characters").otherwise("words")
    wanted = cases.where(F.col("passage").isNotNull()).select("case_id", "field", kind.alias("kind"), "passage").distinct()
    id_type = wanted.schema["case_id"].dataType.simpleString()
    seeds = wanted.mapInArrow(
        _evaluation_seeds, f"seed bigint, mask int, case_id {id_type}, field string, case_pos int, case_window array<bigint>"
    )
    bits = np.zeros(1 << (_BITS - 3), np.uint8)
    # one part a partition, a few partitions, each part of fixed size
    for row in seeds.select("seed").coalesce(4).mapInArrow(_bitmap_part, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in tokens.slices(texts):
                t = tokens.Batch(texts[lo:hi], "words")
                for number, _, run, at, found in _hits(t, bitmap):
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(t.doc[at] + lo)), pa.array(found.view(np.int64)), pa.array(np.full(len(at), number, np.int32)), pa.array((at - np.searchsorted(t.doc, t.doc[at])).astype(np.int32)), _windows(t.hash, at, run)],
                            ["doc_id", "seed", "mask", "pos", "window"],
                        )

    doc_type = docs.schema[doc_id].dataType.simpleString()
    hits = (
        docs.where(F.col(text).isNotNull())
        .select(doc_id, text)
        .mapInArrow(scan, f"doc_id {doc_type}, seed bigint, mask int, pos int, window array<bigint>")
    )
    same = F.aggregate(F.zip_with("window", "case_window", lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y)
    return (
        hits.join(seeds, ["seed", "mask"])
        .select("doc_id", "case_id", "field", "pos", "case_pos", (same / F.size("window")).alias("match"))
        .groupBy("doc_id", "case_id", "field")
        .agg(
            F.countDistinct("pos").alias("hits"),
            F.countDistinct(F.when(F.col("match") == 1, F.col("pos"))).alias("exact_hits"),
            F.max("match").alias("best_match"),
        )
    )
