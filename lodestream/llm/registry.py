"""Names the queries of this subpackage; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import language, leakage, lookalike, oracle, packing, personal, splitting, truncation


def _post_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language segments of every post, keyed by (id, label); no text is shuffled."""
    posts = table(spark, sf_dir, "bulk_mock_posts").select("id", F.col("metadata.language").alias("label"), "content")
    sample = language.labelled_sample(table(spark, sf_dir, "documents"), "lang", "text", "doc_id", 300)
    sample += language.labelled_sample(posts, "label", "content", "id", 1000)
    keyed = posts.select(F.struct("id", "label").alias("key"), "content")
    return language.language_segments(keyed, "key", "content", language.build_dictionaries(sample))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _post_languages(spark, sf_dir).where("lang IS NOT NULL").groupBy("key.id").agg(
        F.collect_set("lang").alias("langs"), F.first("key.label").alias("label")
    )
    label = language.label_language(F.col("label"))
    wrong = label.isNull() | ~F.array_contains("langs", label) | (F.size("langs") > 1)
    return told.where(wrong).select("id", F.explode("langs").alias("lang"))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _post_languages(spark, sf_dir).select("key.id", "segment", "start", "end", "lang", "confidence").distinct()


ITEMS = (("media_response_faq", "faq_id", "updated_at"), ("rag_document", "doc_key", "loaded_at"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key, _ in ITEMS:
        pieces = splitting.split_items(table(spark, sf_dir, name), key, "content")
        parts.append(pieces.where("piece = 1").select(F.lit(name).alias("item_table"), F.col(key).alias("item_id")))
    return parts[0].unionByName(parts[1]).distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the latest row of each item."""
    parts = []
    for name, key, at in ITEMS:
        latest = table(spark, sf_dir, name).groupBy(key).agg(F.max_by("content", at).alias("content"))
        parts.append(splitting.split_items(latest, key, "content").withColumnRenamed(key, "item_id").withColumn("item_table", F.lit(name)))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "bulk_mock_posts"), "id", ("content", "title")).distinct()


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "bulk_mock_posts").dropDuplicates(["id"])
    return lookalike.consistent_forms(posts, "id", ("content", "title")).where("stored <> form")


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = personal.personal_information(table(spark, sf_dir, "bulk_mock_posts"), "id", ("content", "author"))
    memories = personal.personal_information(table(spark, sf_dir, "memories"), "memory_id", ("content",))
    a = posts.select(F.lit("bulk_mock_posts").alias("item_table"), F.col("id").alias("item_id"), "field", "redacted", "found")
    return a.unionByName(memories.select(F.lit("memories").alias("item_table"), F.col("memory_id").alias("item_id"), "field", "redacted", "found"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array_distinct(F.transform("found", lambda x: x.type)))
    return _personal(spark, sf_dir).select("item_table", "item_id", "field", kinds.alias("pii_type")).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that hold personal data, with placeholders in its place."""
    return _personal(spark, sf_dir).where(F.size("found") > 0).select("item_table", "item_id", "field", "redacted").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.where("piece = 1").select("doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, with sizes of a public tokenizer."""
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path=path)
    return packed.where("container IS NOT NULL").agg(
        F.countDistinct("container").alias("containers"),
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / (1024 * F.countDistinct("container"))).alias("share_filled"),
    )


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "rag_eval_cases")
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("passage")) for c in ("query", "expected_answer"))))
    return cases.select(F.col("id").alias("case_id"), "language", parts.alias("p")).select("case_id", "language", "p.field", "p.passage")


def p8_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), _passages(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_overlaps(spark, sf_dir).where("exact_hits > 0").select("doc_id", "case_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_texts(table(spark, sf_dir, "documents")).where("truncated").select("doc_id")


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_by_source(truncation.truncated_texts(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_segments": p1_segments, "p2_found": p2_found, "p2_pieces": p2_pieces, "p5_found": p5_found, "p5_forms": p5_forms, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p7_fill": p7_fill, "p8_found": p8_found, "p8_overlaps": p8_overlaps, "p9_found": p9_found, "p9_sources": p9_sources}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
