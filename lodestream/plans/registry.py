"""Names every query of the core; each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import accounting, chunking, control, evaluation, events, graph, hierarchy, memory, retrieval, routing, social, timestamps
from ..session import cut, spread, table
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


# Timestamps and hierarchies


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_timestamps(spark, sf_dir).where("status = 'resolved'").select("id", "utc_ms")


@query
def p3_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "bulk_mock_posts").select("id", "platform", "published_at").dropDuplicates(["id"])
    return timestamps.normalise_timestamps(posts, "published_at", "platform", table(spark, sf_dir, "platform_zones"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy.hierarchy(table(spark, sf_dir, "bulk_mock_posts").select("id", "parent_id"))
    return tree.where("parent IS NOT NULL").selectExpr("id", "root AS root_id", "depth")


@query
def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.paths(hierarchy.hierarchy(table(spark, sf_dir, "bulk_mock_posts").select("id", "parent_id")))


@query
def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every post."""
    posts = table(spark, sf_dir, "bulk_mock_posts").select("id", "parent_id")
    return hierarchy.descendants(hierarchy.hierarchy(posts))


# Retrieval


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "title"))
    return d.withColumn("whole", F.concat_ws("\n", "title", "text"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rag_eval_cases")


def _faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each FAQ record, with its searchable context."""
    f = table(spark, sf_dir, "media_response_faq")
    f = spread(f).groupBy("faq_id").agg(F.max_by(F.struct("source", "title", "content"), F.struct("updated_at", F.coalesce("content", F.lit("")))).alias("m")).select("faq_id", "m.*")
    return f.withColumn("content", F.coalesce("content", F.lit(""))).withColumns({"context": retrieval.structured_context(F.col("title"), F.col("source")), "whole": F.concat_ws("\n", "title", "content")})


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieval.bm25(_documents(spark, sf_dir), "doc_id", "whole", _cases(spark, sf_dir), "id", "query", 5)
    return r.select("query", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def bm25_content_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "rag_document").groupBy("doc_key").agg(F.max("content").alias("content"))
    r = retrieval.bm25(docs, "doc_key", "content", _cases(spark, sf_dir), "id", "query", 5)
    return r.select("query", "doc_key", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = retrieval.term_statistics(_documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text")
    return t.select("term", "df", F.round("idf", 6).alias("idf"))


def _vectors(metric: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = table(spark, sf_dir, "embeddings")
        r = retrieval.vector_top(v, "vec_id", "embedding", v.where("vec_id % 100 = 0"), metric)
        return r.select("query", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))

    f.__name__ = f"vector_{metric}_topk"
    return query(f)


_vectors("cosine"), _vectors("ip"), _vectors("l2")


@query
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = retrieval.hash_embedding(table(spark, sf_dir, "documents"), "doc_id", "text")
    return e.select("doc_id", "pos", F.round("value", 6).alias("value"))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    faq, cases = _faq(spark, sf_dir), _cases(spark, sf_dir)
    index = retrieval.text_index(faq, "faq_id", "whole")
    return _search(index, cases)


def _search(index: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two lists of a set of queries over an index of FAQ records: by words and by hash embedding."""
    words = retrieval.bm25_indexed(index.select(F.col("faq_id").alias("doc"), "t"), "faq_id", cases, "id", "query", 20)
    asked = retrieval.embed(cases, "id", "query")
    like = retrieval.vector_top(index.select("faq_id", "vector"), "faq_id", "vector", asked, "ip", 20, "id")
    return cut(words), like


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, like = _lists(spark, sf_dir)
    fused = retrieval.rank_fusion([words, like], "faq_id", 20)
    return fused.join(words.select("query", "faq_id", F.col("score").alias("keyword_score")), ["query", "faq_id"], "left")


@query
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query", "faq_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _boosted(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    faq = cut(retrieval.with_tokens(_faq(spark, sf_dir).drop("whole")))
    asked = _cases(spark, sf_dir).select(F.col("id").alias("query"), F.array_distinct(X.tokens(F.col("query"))).alias("query_tokens"))
    hits = (_fused(spark, sf_dir) if hits is None else hits).join(faq, "faq_id").join(asked, "query")
    return retrieval.boost_by_metadata(hits)


@query
def metadata_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir).select("query", "faq_id", "structured_score", "score")


def _final(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    h = retrieval.rerank_by_overlap(_boosted(spark, sf_dir, hits))
    h = h.withColumn("source_status", retrieval.source_status(F.col("source"), F.col("title"), F.col("content")))
    return retrieval.relevant(retrieval.adjust_by_authority(h))


@query
def keyword_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank_by_overlap(_boosted(spark, sf_dir)).select("query", "faq_id", "rerank_score")


@query
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline: lists, fusion, boost, rerank, authority, filter, five best."""
    t = retrieval.top(_final(spark, sf_dir).drop("rank"), "query", F.col("score"), "faq_id", 5)
    return t.select("query", "faq_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def cited_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cited_context(retrieval.top(_final(spark, sf_dir).drop("rank"), "query", F.col("score"), "faq_id", 5), "faq_id")


@query
def authority_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).withColumn("source_status", retrieval.source_status(F.col("source"), F.col("title"), F.col("text")))
    weight, penalty = retrieval.authority(F.col("source_status"))
    return d.select("doc_id", "source_status", weight.alias("weight"), penalty.alias("penalty"))


# Term graph


@query
def graph_terms_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph.informative_terms(_documents(spark, sf_dir), "doc_id", "text")
    return t.select("term", "df", F.round("idf", 6).alias("idf"), F.round("threshold", 6).alias("threshold"))


@query
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    r = graph.term_neighbours(d, "doc_id", "text", d.where("doc_id % 100 = 0"))
    return r.select("seed", "doc_id", "shared", "score", "confidence", F.col("rank").cast("bigint").alias("rank"))


@query
def same_source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.same_source_edges(_documents(spark, sf_dir), "doc_id", "source")


@query
def adjacent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.same_source_edges(_documents(spark, sf_dir), "doc_id", "source", 1).select("from", "to", "weight")


@query
def shared_title_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shared_value_edges(_documents(spark, sf_dir), "doc_id", "title", 0.8)


@query
def adaptive_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    hits = cut(bm25_topk(spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id"))
    seeds = graph.seed_concentration(hits, "source")
    told = graph.seed_informativeness(hits, docs, "doc_id", "whole")
    cases = _cases(spark, sf_dir).select(F.col("id").alias("query"), graph.query_specificity(F.col("query")).alias("specificity"))
    s = cases.join(seeds, "query").join(told, "query")
    g = graph.expansion_gate(s)
    return g.select("query", F.round("specificity", 4).alias("specificity"), F.round("concentration", 4).alias("concentration"), F.col("favourable").cast("bigint").alias("favourable"), "should_expand", F.round("confidence", 4).alias("confidence"))


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused hits of each query with their neighbours in the term graph, where the gate lets them in."""
    faq = cut(_faq(spark, sf_dir).select("faq_id", "source", "whole"))
    fused = cut(_fused(spark, sf_dir))
    hits = fused.join(faq.select("faq_id", "source"), "faq_id")
    cases = _cases(spark, sf_dir).select(F.col("id").alias("query"), graph.query_specificity(F.col("query")).alias("specificity"))
    signals = cases.join(graph.seed_concentration(hits, "source"), "query").join(graph.seed_informativeness(hits, faq, "faq_id", "whole"), "query")
    out = graph.expand(fused, faq, "faq_id", "whole", graph.expansion_gate(signals))
    return out.join(fused.select("query", "faq_id", "keyword_score"), ["query", "faq_id"], "left")


@query
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir).select("query", "faq_id", "score", "graph_score")


@query
def graph_expand_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expand_once(_fused(spark, sf_dir), _faq(spark, sf_dir), "faq_id", "whole")


@query
def hybrid_graph_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline with the graph stage between fusion and boost."""
    t = retrieval.top(_final(spark, sf_dir, _expanded(spark, sf_dir)).drop("rank"), "query", F.col("score"), "faq_id", 5)
    return t.select("query", "faq_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def graph_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lists of words and of embeddings add to each other, against the records whose title a query names a word of."""
    words, like = _lists(spark, sf_dir)
    named = retrieval.with_tokens(_faq(spark, sf_dir)).select("faq_id", F.explode("context_tokens").alias("term"))
    asked = _cases(spark, sf_dir).select(F.col("id").alias("query"), F.explode(F.array_distinct(X.tokens(F.col("query")))).alias("term")).where("length(term) > 6")
    want = asked.join(named, "term").select("query", F.col("faq_id").alias("item"))
    run = lambda r: r.select("query", F.col("faq_id").alias("item"), "rank")
    return evaluation.graph_effect(run(words), run(like), want)


@query
def source_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    edges = graph.same_source_edges(d, "doc_id", "source", 2).select("from", "to", "weight")
    return graph.neighbours_of(edges.unionByName(graph.shared_value_edges(d, "doc_id", "title", 0.8)), d.where("doc_id % 100 = 0"), "doc_id")


@query
def evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence at 5 of BM25 over FAQ records, a query's expected sources being those of the records that name one of its keywords."""
    faq = _faq(spark, sf_dir)
    hits = retrieval.bm25(faq, "faq_id", "whole", _cases(spark, sf_dir), "id", "query", 5).join(faq, "faq_id")
    hits = hits.withColumn("source_status", retrieval.source_status(F.col("source"), F.col("title"), F.col("content")))
    cases = _cases(spark, sf_dir).select(F.col("id").alias("query"), F.concat("expected_sources", F.array(F.lit("kb/faq"), F.lit("kb/playbooks"), F.lit("pr/handbook"))).alias("sources"), F.col("expected_keywords").alias("keywords"))
    return evaluation.evidence_metrics(hits, cases, 5)


@query
def metadata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "rag_document")
    line = retrieval.metadata_line(F.array("title"), F.col("metadata.page_number"), F.col("metadata.json_text_fields"), file_type=F.col("metadata.file_type"), team=F.col("metadata.team"))
    return d.select("doc_key", line.alias("line")).distinct()


# Social signals


def _posts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row a post with the columns asked for; the latest of a post's rows holds."""
    return social.latest_posts(table(spark, sf_dir, "bulk_mock_posts"), columns)


def _signals(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return social.with_signals(_posts(spark, sf_dir, *social.SIGNAL_COLUMNS, *columns))


@query
def post_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir)
    return s.select("id", "sentiment_label", "is_complaint", "engagement_total", F.array_join(F.array_sort(social.matched_signals(F.col("signal"))), "|").alias("signals"))


@query
def sentiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).groupBy("sentiment_label").agg(F.count("*").alias("posts"))


@query
def platform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir, "platform").groupBy(F.coalesce("platform", F.lit("unknown")).alias("platform")).agg(F.count("*").alias("posts"))


@query
def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).groupBy(F.to_date("ingested_at").cast("string").alias("day")).agg(F.count("*").alias("posts"))


@query
def risk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social.risk(_signals(spark, sf_dir).withColumn("platform", F.coalesce("platform", F.lit("unknown"))), "platform")


@query
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social.keywords(_posts(spark, sf_dir, "tags", "metadata"), 30)


@query
def representative_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = retrieval.top(_signals(spark, sf_dir).where("platform IS NOT NULL"), "platform", F.col("engagement_total"), "id", 5)
    return t.select("platform", "id", "engagement_total", F.col("rank").cast("bigint").alias("rank"))


@query
def author_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir, "author_id")
    return s.where("author_id IS NOT NULL").groupBy("author_id").agg(
        F.count("*").alias("posts"), F.countDistinct("platform").alias("platforms"), F.count_if(F.col("sentiment_label") == "negative").alias("negative"), F.sum("engagement_total").alias("engagement"), F.min("id").alias("first_post")
    )


@query
def post_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social.search(_posts(spark, sf_dir, "title", "content", "author", "platform", "tags", "metadata"), "battery pack", platforms=["X", "forum", "news_comment"]).select("id", "platform")


@query
def alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = {"heat pump": ["热泵", "ヒートポンプ", "bomba de calor"]}
    return social.search(_posts(spark, sf_dir, "title", "content", "author", "platform", "tags", "metadata"), "Heat Pump", aliases).select("id")


@query
def complaints_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant of a query with its matches; a post is kept for the first variant it matches."""
    posts = _posts(spark, sf_dir, "title", "content", "author", "platform", "tags", "metadata")
    found = None
    for n, v in enumerate(social.query_variants("nordhay")):
        part = social.search(posts, v).select("id", F.lit(n).alias("n"), F.lit(v).alias("matched_query"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("id").agg(F.min_by("matched_query", "n").alias("matched_query"))


@query
def thread_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, sf_dir, "thread_id", "parent_id", "metadata")
    wanted = posts.where("try_cast(regexp_extract(id, '([0-9]+)$', 1) AS bigint) % 100 = 0").select(F.col("id").alias("thread"))
    return social.thread(posts, wanted)


@query
def comment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _posts(spark, sf_dir, "parent_id").where("length(parent_id) > 0")
    return p.groupBy("parent_id").agg(F.count("*").alias("comments"), F.min("id").alias("first_comment"))


@query
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir)
    return social.page(s, [F.desc("engagement_total"), F.col("id")], 20, 20).select("id", "engagement_total")


@query
def post_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir, "tags", "content").select("id", F.array_join(X.hashtags(F.col("tags"), F.col("content")), "|").alias("tags"))


@query
def post_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _posts(spark, sf_dir, "images").select("id", F.posexplode("images").alias("n", "image"))
    return p.where("image.url IS NOT NULL").select("id", F.col("n").cast("bigint").alias("n"), "image.url", "image.caption")


def _matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the posts on batteries of a span of days, with their day where the text states one."""
    s = social.search(_signals(spark, sf_dir, "author", "published_at"), "battery").withColumn("day", social.iso_day(F.col("published_at")))
    return social.between(s, "day", "2025-10-01", "2026-06-30")


@query
def public_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social.report(cut(_matching(spark, sf_dir).select("id", "platform", "tags", "metadata", "sentiment_label", "is_complaint", "engagement_total", "day")), "day")


@query
def opinion_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social.snapshot(cut(_matching(spark, sf_dir).select("id", "platform", "tags", "metadata", "sentiment_label", "is_complaint", "engagement_total", "day")), "day")


@query
def posts_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of results that a cursor text means, latest first, undated last."""
    s = _matching(spark, sf_dir).select("id", "day")
    return s.orderBy(*social.latest_first("day", "id")).offset(10).limit(20).select("id", F.col("day").cast("string").alias("day"))


@query
def result_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset and next cursor of cursors good and bad over each platform's posts."""
    n = _posts(spark, sf_dir, "platform").where("platform IS NOT NULL").groupBy("platform").agg(F.count("*").alias("total"))
    c = n.select("platform", "total", F.explode(F.array(*map(F.lit, ("0", "40", "x1", "", "9000000")))).alias("cursor"))
    at, after = social.next_cursor(F.col("total"), F.col("cursor"), 40)
    return c.select("platform", "cursor", at.alias("at"), after.alias("next"))


@query
def risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = risk_metrics(spark, sf_dir)
    return r.select("platform", F.array_join(social.risk_reasons(r), "; ").alias("reasons"))


@query
def author_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social.author_platforms(_signals(spark, sf_dir, "author_id"))


@query
def author_first_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _posts(spark, sf_dir, "author_id").where("author_id IS NOT NULL").select("author_id", "id")
    t = retrieval.top(p.withColumn("same", F.lit(0)), "author_id", F.col("same"), "id", 5)
    return t.select("author_id", "id", F.col("rank").cast("bigint").alias("rank"))


# Dedup


@query
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    g = d.groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return g.select("doc_id", "copies")


@query
def duplicate_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text an earlier document has."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("k"))
    first = d.groupBy("k").agg(F.min("doc_id").alias("first_id"))
    return d.join(first, "k").where("doc_id > first_id").select("doc_id", "first_id")


@query
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "bulk_mock_posts")
    return p.groupBy("id").agg(F.count("*").alias("versions"), F.max("ingested_at").cast("timestamp_ntz").alias("ingested_at"))


@query
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indexable rows of the knowledge files, FAQ records and memories, counted by where they come from."""
    a = table(spark, sf_dir, "rag_document").select(F.lit("file").alias("kind"), F.col("doc_key").alias("k"), "content")
    b = table(spark, sf_dir, "media_response_faq").select(F.lit("faq").alias("kind"), F.col("faq_id").alias("k"), "content")
    m = memory.to_documents(table(spark, sf_dir, "memories")).select(F.lit("memory").alias("kind"), F.col("doc_key").alias("k"), "content")
    u = a.unionByName(b).unionByName(m).where("length(trim(content)) > 0")
    return u.groupBy("kind").agg(F.countDistinct("k").alias("items"), F.sum(F.length("content")).alias("chars"))


# Text


@query
def text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), F.length(X.cut_to_tokens(F.col("text"), 50)).cast("bigint").alias("cut_length"))


@query
def source_basenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(X.basename(F.col("source")).alias("name")).agg(F.count("*").alias("docs"))


@query
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "rag_document")
    return d.select("doc_key", X.document_key(F.col("source"), F.col("title")).alias("computed")).distinct()


@query
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("length(text) > 0")
    return d.select("doc_id", X.line_of(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("middle_line"), X.line_of(F.col("text"), F.length("text")).alias("last_line"))


@query
def structured_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "rag_document")
    m = {n: F.col(f"metadata.{n}").cast("string") for n in ("file_type", "language", "page_number")}
    return d.select("doc_key", retrieval.structured_context(F.col("title"), F.col("source"), **m).alias("context")).distinct()


# Memory


@query
def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "memories")
    out = memory.upsert(m, m.limit(0))
    return out.select("memory_id", "versions", "index_status", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query
def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "memories")
    return memory.pending(memory.upsert(m, m.limit(0))).groupBy("record_type").agg(F.count("*").alias("pending"))


@query
def mark_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory.upsert(table(spark, sf_dir, "memories"), table(spark, sf_dir, "memories").limit(0))
    return memory.mark_indexed(m, memory.pending(m).where("record_type = 'summary'")).groupBy("index_status").agg(F.count("*").alias("records"))


@query
def memory_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.to_documents(table(spark, sf_dir, "memories")).select("doc_key", "source", "title", "memory_usage").distinct()


@query
def memory_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "memories")
    return m.select("memory_id", memory.stable_id(F.col("user_id"), F.col("conversation_id"), F.col("record_type"), F.col("content")).alias("stable_id")).distinct()


@query
def memory_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = memory.fingerprint(table(spark, sf_dir, "memories"))
    return f.select("records", "ids", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query
def memory_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.turns(table(spark, sf_dir, "memories").select("memory_id", "content").distinct())


@query
def memory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest pending chat records."""
    return memory.scoped(table(spark, sf_dir, "memories").dropDuplicates(["memory_id", "updated_at"]), kinds=("chat_raw", "summary"), status="pending", limit=20).select("memory_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query
def memory_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "memories")
    named = m.where("record_type = 'decision'").select(F.concat(F.lit("memory://mysql/"), F.coalesce("conversation_id", F.lit("")), F.lit("/"), "memory_id").alias("source"))
    return memory.by_source(m, named).select("memory_id", "record_type").distinct()


@query
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = memory.turns(table(spark, sf_dir, "memories").select("memory_id", "content").distinct())
    return routing.transcript(t.withColumnRenamed("turn", "ordinal"), "memory_id")


# Budgets, over the events as usage


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    return e.select("event_id", "user_id", "event_type", "value", "ts", F.lit(1).alias("model_calls"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("tool_calls"), n.alias("total_tokens"))


@query
def budget_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = accounting.merge_usage(_usage(spark, sf_dir), "user_id", ["model_calls", "tool_calls", "total_tokens"], "event_type")
    return m.withColumn("event_type", F.array_join("event_type", "|"))


@query
def budget_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _usage(spark, sf_dir)
    c = ["model_calls", "total_tokens"]
    now = accounting.merge_usage(u, "user_id", c, "event_type")
    before = accounting.merge_usage(u.where("ts < timestamp_ntz'2024-01-15 00:00:00'"), "user_id", c, "event_type")
    return accounting.usage_difference(now, before, "user_id", c)


@query
def budget_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.admit(_usage(spark, sf_dir), "user_id", "event_id", "value", 500.0)


@query
def budget_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = accounting.merge_usage(_usage(spark, sf_dir), "user_id", ["model_calls", "tool_calls"], "event_type")
    used = F.col("model_calls")
    return m.select("user_id", accounting.remaining(F.lit(70), used).cast("bigint").alias("remaining"), (used >= 70).alias("over"), (used >= 0.8 * 70).alias("warn"), F.greatest(F.lit(0), F.floor((F.lit(70) - 1 - used) / 2)).cast("bigint").alias("slots"))


@query
def budget_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's calls in order under two limits: 40 calls, of which 10 clicks."""
    u = _usage(spark, sf_dir).select("event_id", "user_id", "event_type")
    a = accounting.admit_calls(u, "user_id", "event_id", F.col("event_type") == "click", 40, 10)
    return a.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("skipped"), F.max(F.when(F.col("admitted"), F.col("event_id"))).alias("last_call"))


@query
def budget_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = accounting.merge_usage(_usage(spark, sf_dir), "user_id", ["model_calls", "tool_calls"], "event_type")
    w = accounting.budget_warnings({"model_calls": F.col("model_calls"), "tool_calls": F.col("tool_calls")}, {"model_calls": 70, "tool_calls": 20})
    return m.select("user_id", F.array_join(w, "; ").alias("warnings"))


# Evaluation, over the labelled vectors


def _judged(spark: SparkSession, sf_dir: str, metric: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0")
    run = retrieval.vector_top(v, "vec_id", "embedding", q, metric, 10).withColumnRenamed("vec_id", "item")
    # a stated query set against all rows of its label
    want = q.select(F.col("vec_id").alias("query"), "label").join(v.select(F.col("vec_id").alias("item"), "label"), "label").where("item <> query")
    return run, want.select("query", "item")


@query
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, want = _judged(spark, sf_dir, "cosine")
    return evaluation.case_metrics(run, want, 5)


@query
def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, want = _judged(spark, sf_dir, "cosine")
    m = evaluation.case_metrics(run, want, 5).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), F.col("label").cast("string").alias("category")), "query")
    return evaluation.mean_metrics(m, "category")


@query
def run_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, like = _lists(spark, sf_dir)
    return evaluation.ablation(words.select("query", F.col("faq_id").alias("item")), like.select("query", F.col("faq_id").alias("item")))


@query
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pareto_front(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency_report(table(spark, sf_dir, "events"), "event_type", "value")


# Routing, sections and state


def _domains(spark: SparkSession) -> DataFrame:
    rows = [("core", True, ""), ("web_search", True, ""), *((d, False, k) for d, ks in oracle.DOMAINS.items() for k in ks)]
    return spark.createDataFrame(rows, "domain string, always boolean, keyword string")


@query
def domain_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.active_domains(_cases(spark, sf_dir), "id", "query", _domains(spark))


@query
def section_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's digest: its document types as planned sections, the last document's title as their content."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL AND doc_type IS NOT NULL")
    plan = d.select("source", F.col("doc_type").alias("section")).distinct().withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("section")))
    done = d.where("title IS NOT NULL").select("source", F.col("doc_type").alias("section"), F.col("title").alias("content"), F.col("doc_id").alias("ordinal"))
    return routing.assemble(plan, done, "source")


@query
def state_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events folded in order; a sign-up replaces what was gathered before."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "override").otherwise("append")
    u = e.select(F.col("user_id").cast("string").alias("thread"), "event_id", kind.alias("kind"), F.col("event_type").alias("value"))
    return routing.reduce_state(u, "thread", "event_id")


@query
def role_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's sections with the titles of the documents of their types; of all types where none has a title."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL AND doc_type IS NOT NULL")
    reports = d.where("title IS NOT NULL AND doc_id % 7 = 0").select("source", F.col("doc_type").alias("role"), F.col("doc_id").alias("ordinal"), F.col("title").alias("report"))
    plan = d.select("source").distinct().select("source", F.explode(F.array(F.struct(F.lit("news").alias("section"), F.lit("news, Blog").alias("roles")), F.struct(F.lit("rest").alias("section"), F.lit("none").alias("roles")))).alias("p")).select("source", "p.*")
    return routing.role_evidence(plan, reports, "source")


@query
def tools_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "bulk_mock_posts").where("platform IS NOT NULL AND type IS NOT NULL")
    return routing.tools_by_domain(p.select(F.col("platform").alias("domain"), F.col("type").alias("tool")).distinct())


@query
def private_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five memories each user wrote last."""
    m = memory.upsert(table(spark, sf_dir, "memories"), table(spark, sf_dir, "memories").limit(0))
    r = control.last_of_each(control.owned(m.withColumn("known", F.when(F.col("user_id").isNotNull(), "yes")), "known", "yes"), "user_id", [F.desc("updated_at"), F.col("memory_id")], 5)
    return r.select("user_id", "memory_id", F.col("rank").cast("bigint").alias("rank"))


@query
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "bulk_mock_posts").where("platform IS NOT NULL")
    return control.unique_names(p.select("platform", F.explode("tags").alias("tag")), "platform", "tag")


@query
def admitted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = control.admitted_units(_posts(spark, sf_dir, "thread_id").where("thread_id IS NOT NULL"), "thread_id", "id", 5, 2)
    return u.groupBy("state").agg(F.count("*").alias("units"))


@query
def run_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two runs each query prefers, by reciprocal rank: cosine or L2."""
    a, b = (evaluation.case_metrics(*_judged(spark, sf_dir, m), 5).select("query", F.col("recall").alias(m)) for m in ("cosine", "l2"))
    p = control.preference(F.col("cosine"), F.col("l2"))
    return a.join(b, "query").select("query", p[0].cast("bigint").alias("first"), p[1].cast("bigint").alias("second"))


# Chunks


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "rag_document").groupBy("doc_key").agg(F.max_by(F.struct("content", "source", "title", F.col("metadata.file_type").alias("file_type")), "loaded_at").alias("m")).select("doc_key", "m.*")
    return chunking.split_documents(d, 400, 50)


# Extensions over the events: not in the reference


@query
def events_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return events.last_before(e, "user_id", "ts", "event_id", "event_type", "purchase", "click")


@query
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 12 * 3600)


@query
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.daily(table(spark, sf_dir, "events"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in _QUERIES}
