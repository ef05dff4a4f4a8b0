"""Batch retrieval: BM25, vectors, fusion, boosts, reranking, source authority and cited context.

Queries are a DataFrame; every stage works on (query, document) rows and orders with an explicit key, so ties never depend
on partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import cut


def top(df: DataFrame, by: str, score: Column, tie: str, k: int) -> DataFrame:
    """The k best rows of each ``by`` with their rank; a row limit is pushed before the shuffle by WindowGroupLimit."""
    w = Window.partitionBy(by).orderBy(score.desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, idf): distinct documents of each term; idf = ln(1 + (N - df + .5) / (df + .5))."""
    t = docs.select(key, X.tokens(F.col(text)).alias("t"))
    n = t.count()
    df = X.exploded(t.withColumn("t", F.array_distinct("t")), "t", "term").groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25(
    docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = 5, k1: float = 1.5, b: float = 0.75
) -> DataFrame:
    """(query, key, score, rank): the k best documents of each query; a repeated query term counts as often as it stands.

    A query set of bounded size goes to the tasks as one block of weights, and of each batch of documents only the k best
    leave the scan. A larger one is joined: only occurrences of query terms leave the scan, their (document, term)
    counts combined map-side. Null or empty texts and queries match nothing.
    """
    return bm25_indexed(docs.select(F.col(key).alias("doc"), X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")), key, queries, query_key, query_text, k, k1, b)


def bm25_indexed(toks: DataFrame, key: str, queries: DataFrame, query_key: str, query_text: str, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``bm25`` over tokens (doc, t) made before, as ``text_index`` keeps them."""
    n, mean = toks.agg(F.count("*"), F.avg(F.size("t"))).first()
    wanted = X.exploded(queries.select(F.col(query_key).alias("query"), X.tokens(F.col(query_text)).alias("t")), "t", "term").groupBy("query", "term").agg(F.count("*").alias("times"))
    wanted = wanted.persist()
    vocabulary = wanted.select("term").distinct()
    asked, words = wanted.select("query").distinct().count(), vocabulary.count()
    each = toks.select("doc", F.size("t").alias("dl"), F.array_distinct("t").alias("t") if asked * words <= MOST_CELLS else "t")
    found = X.exploded(each, "t", "term").join(vocabulary, "term", "left_semi")
    idf = lambda df: F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
    if asked * words <= MOST_CELLS:
        df = found.groupBy("term").agg(F.count("*").alias("df")).select("term", idf(F.col("df")).alias("idf"))
        scored = _scores_by_block(toks, wanted.join(df, "term").collect(), float(mean or 1.0), k, k1, b)
        wanted.unpersist()
    else:
        tf = found.groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        part = F.col("times") * idf(F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(mean or 1.0))))
        scored = tf.join(df, "term").join(wanted, "term").groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored.where("score > 0"), "query", F.col("score"), "doc", k).withColumnRenamed("doc", key)


def text_index(docs: DataFrame, key: str, text: str, dimensions: int = 256) -> DataFrame:
    """(key, t, vector): tokens and hash embedding of each text, written once to the shared folder and read by every query set."""
    return cut(embed(docs.select(key, text, X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")), key, text, dimensions, ("t",)))


#: Query terms by queries up to which the weights go to the tasks as one block (8 bytes a cell, 64 MB); beyond it they are joined.
MOST_CELLS = 8_000_000


def _scores_by_block(toks: DataFrame, weights: list, mean: float, k: int, k1: float, b: float) -> DataFrame:
    """(query, doc, score): the k best of every Arrow batch of documents for every query, as one matrix product a batch."""
    words = sorted({w.term for w in weights})
    names = sorted({w.query for w in weights})
    row, column = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(names)}
    block = np.zeros((len(words), len(names)))
    for w in weights:
        block[row[w.term], column[w.query]] = w.times * w.idf * (k1 + 1)
    shared = toks.sparkSession.sparkContext.broadcast((words, names, block))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names, block = shared.value
        lookup = pa.array(words, pa.string())
        step = max(1, min(1000, MOST_CELLS // max(len(words), len(names), 1)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                part = whole.slice(lo, step)
                part = part.take(pc.sort_indices(part.column(0)))  # ties go to the smaller document
                lists = part.column(1)
                length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)
                ids = pc.index_in(lists.flatten(), value_set=lookup).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(lists)), length.astype(int))
                hit = ~np.isnan(ids.astype(float))
                tf = np.bincount(doc[hit] * len(words) + ids[hit].astype(int), minlength=len(lists) * len(words)).reshape(len(lists), -1)
                score = np.round((tf / (tf + (k1 * (1 - b + b * length / mean))[:, None])) @ block, 6)
                best = np.argsort(-score, axis=0, kind="stable")[:k]
                q = np.broadcast_to(np.arange(len(names)), best.shape)
                value = np.take_along_axis(score, best, 0)
                ok = value > 0
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q[ok]]), part.column(0).take(pa.array(best[ok])), pa.array(value[ok])], ["query", "doc", "score"])

    kind = toks.schema["doc"].dataType.simpleString()
    of = "bigint" if names and isinstance(names[0], int) else "string"
    return toks.mapInArrow(run, f"query {of}, doc {kind}, score double")


def embed(docs: DataFrame, key: str, text: str, dimensions: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, vector, *keep): the L2-normalised hash embedding of each text, all zero for a text without words.

    Words are cut JVM-side; each distinct word of an Arrow batch is hashed once, the sums are one bincount. No shuffle.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(X.WORD), 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                part = whole.slice(lo, 2000)
                lists = part.column(1)
                coded = lists.flatten().dictionary_encode()
                names = coded.dictionary.to_pylist()
                digests = [hashlib.sha256(w.encode()).digest() for w in names]
                pos = np.array([int.from_bytes(h[:4], "big") % dimensions for h in digests], np.int64)
                value = np.array([(1.0 if h[4] % 2 == 0 else -1.0) * (1 + math.log1p(len(w))) for h, w in zip(digests, names, strict=True)])
                at = coded.indices.to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int))
                sums = np.bincount(doc * dimensions + pos[at], value[at], len(lists) * dimensions).reshape(-1, dimensions) if len(at) else np.zeros((len(lists), dimensions))
                norm = np.sqrt((sums * sums).sum(1, keepdims=True))
                flat = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).reshape(-1)
                offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dimensions)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat)), *part.columns[2:]], [key, "vector", *keep])

    kinds = [(c, docs.schema[c].dataType.simpleString()) for c in keep]
    schema = ", ".join(f"`{c}` {t}" for c, t in [(key, docs.schema[key].dataType.simpleString()), ("vector", "array<double>"), *kinds])
    return docs.select(key, words, *keep).mapInArrow(run, schema)


def hash_embedding(docs: DataFrame, key: str, text: str, dimensions: int = 256) -> DataFrame:
    """(key, pos, value): the non-zero components of ``embed``."""
    e = embed(docs, key, text, dimensions).select(key, F.posexplode_outer("vector").alias("pos", "value"))
    return e.where("abs(value) > 1e-9").withColumn("pos", F.col("pos").cast("bigint"))


def _matrices(rows: list) -> dict[int, tuple[list, np.ndarray]]:
    """Keys and matrix of the (query, vector) rows of each length."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[1]), []).append(r)
    return {n: ([r[0] for r in rs], np.array([list(r[1]) for r in rs], float).reshape(len(rs), n)) for n, rs in by.items()}


def _nearest(names: list, q: np.ndarray, keys: pa.Array, v: np.ndarray, metric: str, k: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(queries, places in keys, scores) of the k best for each query among the vectors of one batch, sorted by key."""
    dot = v @ q.T
    vn, qn = np.sqrt((v * v).sum(1))[:, None], np.sqrt((q * q).sum(1))[None]
    if metric == "cosine":
        dot = np.divide(dot, vn * qn, out=np.zeros_like(dot), where=vn * qn > 0)
    elif metric == "l2":
        dot = -np.sqrt(np.maximum(0.0, vn * vn + qn * qn - 2 * dot))
    score = np.round(dot, 6)
    place = {x: i for i, x in enumerate(keys.to_pylist())}
    for j, name in enumerate(names):
        if name in place:
            score[place[name], j] = -np.inf
    best = np.argsort(-score, axis=0, kind="stable")[:k]
    value = np.take_along_axis(score, best, 0)
    ok = value > -np.inf
    return [names[j] for j in np.broadcast_to(np.arange(len(names)), best.shape)[ok]], best[ok], value[ok]


def vector_top(vectors: DataFrame, key: str, vector: str, queries: DataFrame, metric: str = "cosine", k: int = 10, query_key: str | None = None) -> DataFrame:
    """(query, key, score, rank): exact nearest vectors of each query vector by cosine, inner product or L2 distance.

    queries is the stated query set against all rows, with ``query_key`` (default: key) and the vector. Its vectors go to the
    tasks as blocks of at most MOST_CELLS numbers, each scored against a batch of rows as one matrix product, and only the k
    best of a batch leave the scan; a set of one block is broadcast, the blocks of a larger one are rows that meet the
    batches. A row never finds itself (equal keys). Null vectors and those of another length match nothing; a zero
    vector has cosine 0; ties go to the smaller key.
    """
    asked = queries.select(F.col(query_key or key).alias("query"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    n, dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    of, kind = asked.schema["query"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    schema = f"query {of}, doc {kind}, score double"
    from pyspark.sql.pandas.types import to_arrow_type

    query_type = to_arrow_type(asked.schema["query"].dataType)
    rows = vectors.select(F.col(key).alias("doc"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")

    def scored(blocks: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length = pc.list_value_length(batch.column(1))
        for size, (names, q) in blocks.items():
            same = batch.filter(pc.equal(length, size))
            step = max(1, min(4096, MOST_CELLS // max(len(names), size, 1)))
            for lo in range(0, same.num_rows, step):
                part = same.slice(lo, step)
                part = part.take(pc.sort_indices(part.column(0)))
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), size)
                found, at, value = _nearest(names, q, part.column(0), v, metric, k)
                yield pa.RecordBatch.from_arrays([pa.array(found, query_type), part.column(0).take(pa.array(at)), pa.array(value)], ["query", "doc", "score"])

    if n * (dim or 1) <= MOST_CELLS:
        shared = vectors.sparkSession.sparkContext.broadcast(_matrices(asked.collect()))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from scored(shared.value, b)

        near = rows.mapInArrow(run, schema)
    else:
        # packs of rows and blocks of queries, each one row, so that what meets are blocks and never single rows
        pieces = -(-n * dim // MOST_CELLS)
        blocks = asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(pieces)).alias("b")).agg(F.collect_list(F.struct("query", "v")).alias("asked"))
        packs = rows.withColumn("pack", F.struct(F.spark_partition_id(), F.floor(F.monotonically_increasing_id() % (1 << 33) / 4096)))
        packs = packs.groupBy("pack").agg(F.collect_list(F.struct("doc", "v")).alias("rows"))

        def run_packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    part = pa.RecordBatch.from_struct_array(b.column(0).slice(i, 1).flatten())
                    yield from scored(_matrices([(r["query"], r["v"]) for r in b.column(1)[i].as_py()]), part)

        near = packs.select("rows").join(blocks.select("asked"), F.lit(True)).mapInArrow(run_packs, schema)
    return top(near, "query", F.col("score"), "doc", k).withColumnRenamed("doc", key)


def rank_fusion(lists: list[DataFrame], key: str, k: int = 20, constant: int = 60) -> DataFrame:
    """(query, key, score, rank): reciprocal rank fusion, the sum of 1 / (constant + rank) over the lists."""
    union = lists[0].select("query", key, "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("query", key, "rank"))
    fused = union.groupBy("query", key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))
    return top(fused, "query", F.col("score"), key, k)


def overlap(query_tokens: Column, other_tokens: Column) -> Column:
    """Share of the query's distinct tokens that the other text has."""
    n = F.size(query_tokens)
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(query_tokens, other_tokens)) / n)


def with_tokens(docs: DataFrame) -> DataFrame:
    """docs (context, content) with context_tokens and all_tokens, worked out once a document and not once a hit."""
    distinct = lambda c: F.array_distinct(X.tokens(F.coalesce(c, F.lit(""))))
    return docs.withColumns({"context_tokens": distinct(F.col("context")), "all_tokens": distinct(F.concat_ws("\n", "context", "content"))})


def structured_context(title: Column, source: Column, **metadata: Column) -> Column:
    lines = [F.when(F.length(c) > 0, F.concat(F.lit(f"{n}: "), c)) for n, c in (("title", title), ("source", source), *metadata.items())]
    return F.concat_ws("\n", *lines)


def boost_by_metadata(hits: DataFrame, weight: float = 0.15) -> DataFrame:
    """hits (query_tokens, context_tokens, score, ...) with structured_score, and score raised by weight times it."""
    s = overlap(F.col("query_tokens"), F.col("context_tokens"))
    return hits.withColumn("structured_score", F.round(s, 6)).withColumn("score", F.round(F.col("score") + weight * s, 6))


def rerank_by_overlap(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rerank_score", F.round(overlap(F.col("query_tokens"), F.col("all_tokens")), 6))


def source_status(source: Column, heading: Column, content: Column) -> Column:
    """What a source's name, headings and markers say about its authority."""
    s, h, c = F.lower(F.replace(F.coalesce(source, F.lit("")), F.lit("\\"), F.lit("/"))), F.lower(F.coalesce(heading, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    trap = h.contains("negative misleading notes") | c.contains("unanswerable_trap")
    marked = c.rlike(r"\[deprecated\]|\[retired\]|\[do_not_use\]|\[misleading\]|\[false_claim\]|do not use this draft|do not use this snippet")
    return (
        F.when(s.contains("misleading_archive"), F.when(trap, "unanswerable_trap").otherwise("misleading"))
        .when(h.contains("deprecated") | h.contains("retired") | marked, "deprecated")
        .otherwise("authoritative")
    )


def authority(status: Column) -> tuple[Column, Column]:
    """(weight, penalty) of a source status."""
    # Weight and penalty by status; any other status has (0.8, -1).
    table = (("authoritative", 1.0, 0.0), ("deprecated", 0.35, -4.0), ("misleading", 0.1, -8.0), ("unanswerable_trap", 0.0, -10.0))
    weight, penalty = F.lit(0.8), F.lit(-1.0)
    for name, w, p in table:
        weight, penalty = F.when(status == name, w).otherwise(weight), F.when(status == name, p).otherwise(penalty)
    return weight, penalty


def adjust_by_authority(hits: DataFrame) -> DataFrame:
    _, penalty = authority(F.col("source_status"))
    return hits.withColumn("score", F.round(F.coalesce("rerank_score", "score") + penalty, 6))


def relevant(hits: DataFrame) -> DataFrame:
    """Rows of sources that are not blocked and that some score speaks for."""
    ok = (F.coalesce("rerank_score", F.lit(0.0)) > 0) | (F.coalesce("score", F.lit(0.0)) > 0.10) | (F.coalesce("keyword_score", F.lit(0.0)) > 0)
    return hits.where(~F.col("source_status").isin("misleading", "unanswerable_trap") & ok)


def cited_context(hits: DataFrame, key: str) -> DataFrame:
    """(query, context): the ranked hits of each query as numbered source blocks; a query has at most top-k hits."""
    block = F.concat(
        F.lit("--- SOURCE "), F.col("rank"), F.lit(": "), F.coalesce("title", "source"), F.lit(" ---\nSOURCE: "), F.col("source"),
        F.lit("\nCHUNK ID: "), F.col(key).cast("string"), F.lit("\nEXCERPT:\n"), X.excerpt(F.col("content")), F.lit("\n"),
    )
    return hits.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x.b), "\n").alias("context"))


def metadata_line(heading_path: Column, page_number: Column, field_paths: Column, **named: Column) -> Column:
    """``k=v; `` parts that are there, in a fixed order: headings, page, the first eight field paths, then the named ones."""
    part = lambda n, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{n}="), c))
    head = part("heading", F.array_join(heading_path, " > "))
    fields = part("fields", F.array_join(F.slice(field_paths, 1, 8), ", "))
    return F.concat_ws("; ", head, part("page", page_number.cast("string")), fields, *(part(n, c.cast("string")) for n, c in named.items()))


def at_positions(hits: DataFrame, docs: DataFrame, position: str = "position") -> DataFrame:
    """Hits of an index that knows rows by their ordinal, joined to the rows."""
    return hits.join(docs, position)
