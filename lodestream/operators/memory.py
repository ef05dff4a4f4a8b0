"""Chat memory as a keyed table: upsert, pending queue, scoped scans, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Record types that are indexed.
INDEXABLE = ("chat_raw", "summary", "preference", "project_fact", "decision", "constraint", "deprecated")


def stable_id(user: Column, conversation: Column, kind: Column, content: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(kind, F.lit("-"), F.substring(F.sha2(F.concat_ws("\n", blank(user), blank(conversation), blank(kind), blank(content)), 256), 1, 24))


def upsert(table: DataFrame, changes: DataFrame, key: str = "memory_id") -> DataFrame:
    """The table after the changes: the latest version of each key, created when first seen, pending again once written again.

    A rewrite by union and one map-side combined aggregation; a lakehouse MERGE can take its place.
    """
    both = table.unionByName(changes)
    rest = [c for c in both.columns if c not in (key, "created_at", "index_status")]
    version = F.struct(F.col("updated_at"), F.col("index_status"), F.coalesce(F.col("content"), F.lit("")))
    out = both.groupBy(key).agg(F.min("created_at").alias("created_at"), F.count("*").alias("versions"), F.max_by(F.struct("index_status", *rest), version).alias("m"))
    return out.select(key, "created_at", "versions", "m.*")


def pending(table: DataFrame) -> DataFrame:
    return table.where("index_status = 'pending'")


def mark_indexed(table: DataFrame, batch: DataFrame, key: str = "memory_id") -> DataFrame:
    """Marks exactly the records of the batch that was indexed; what arrived meanwhile stays pending."""
    done = batch.select(key).distinct().withColumn("__done", F.lit(True))
    out = table.join(done, key, "left")
    return out.withColumn("index_status", F.when(F.col("__done"), "indexed").otherwise(F.col("index_status"))).drop("__done")


def to_documents(table: DataFrame) -> DataFrame:
    """Indexable records as documents; deprecated ones are marked not to be adopted."""
    usage = F.when(F.col("record_type") == "deprecated", "do_not_adopt").otherwise("adopt")
    return table.where(F.col("record_type").isin(*INDEXABLE) & (F.length(F.trim("content")) > 0)).select(
        F.col("memory_id").alias("doc_key"), "content", F.concat(F.lit("memory://"), F.coalesce("conversation_id", F.lit("")), F.lit("/"), "memory_id").alias("source"),
        F.coalesce("title", F.substring(F.substring_index("content", "\n", 1), 1, 120)).alias("title"), "record_type", usage.alias("memory_usage"),
    )


def fingerprint(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("records"), F.countDistinct("memory_id").alias("ids"), F.max("updated_at").alias("updated_at"))


def turns(table: DataFrame) -> DataFrame:
    """(memory_id, turn, role, said) of ``role: text`` lines."""
    lines = F.posexplode(F.split("content", r"\n")).alias("turn", "line")
    d = table.select("memory_id", lines).where(F.col("line").rlike(r"^(user|assistant|system): "))
    return d.select("memory_id", F.col("turn").cast("bigint").alias("turn"), F.substring_index("line", ":", 1).alias("role"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("said"))


def scoped(table: DataFrame, user: str | None = None, conversation: str | None = None, kinds: tuple[str, ...] = (), status: str | None = None, limit: int | None = None) -> DataFrame:
    """Records of a user, conversation, kinds or status, latest first, ties by id; filters reach the scan or the database."""
    d = table
    for column, value in (("user_id", user), ("conversation_id", conversation), ("index_status", status)):
        d = d if value is None else d.where(F.col(column) == value)
    d = d.where(F.col("record_type").isin(*kinds)) if kinds else d
    d = d.orderBy(F.desc("updated_at"), F.desc("memory_id"))
    return d.limit(limit) if limit else d


def by_source(table: DataFrame, sources: DataFrame) -> DataFrame:
    """Records that ``memory://conversation/id`` sources name, whatever comes before the last two parts."""
    ids = sources.select(F.regexp_extract("source", r"^memory://(?:[^/]+/)?[^/]*/([^/]+)$", 1).alias("memory_id")).where("memory_id <> ''").distinct()
    return table.join(ids, "memory_id", "left_semi")


def kinds_of(kinds: Column) -> Column:
    """Record types as asked for: trimmed, lower case, distinct in order of first appearance, empty ones out."""
    return F.array_distinct(F.filter(F.transform(kinds, lambda k: F.lower(F.btrim(k))), lambda k: F.length(k) > 0))
