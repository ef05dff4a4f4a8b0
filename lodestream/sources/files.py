"""Knowledge files as documents: recursive scan, titles, languages, fingerprints; a source's change is told by its bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import LANGUAGES


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, length, bytes) of the files below a path; unreadable ones are skipped by the reader."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").load(path)
    return d.select("path", F.col("modificationTime").alias("modified"), "length", F.col("content").alias("bytes"))


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("path", "modified", "length", F.sha2("bytes", 256).alias("sha256"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) of the files added, changed or removed between two fingerprint tables."""
    j = now.alias("n").join(before.alias("b"), "path", "full")
    kind = F.when(F.col("b.sha256").isNull(), "added").when(F.col("n.sha256").isNull(), "removed").when(F.col("n.sha256") != F.col("b.sha256"), "changed")
    return j.select("path", kind.alias("change")).where("change IS NOT NULL")


def title(text: Column, path: Column) -> Column:
    """First heading, else first line of at most 120 characters, else the file's stem."""
    heading = F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(.+?)[ \t#]*$", 1)
    line = F.substring_index(F.btrim(text), "\n", 1)
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")
    return F.coalesce(F.nullif(heading, F.lit("")), F.when(F.length(line).between(1, 120), line), stem)


def documents(files: DataFrame) -> DataFrame:
    """(source, title, content, extension, file_type, language, headings) of text files; bytes that are no UTF-8 are replaced."""
    text = F.btrim(F.make_valid_utf8(F.col("bytes").cast("string")))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    codes = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    d = files.select("path", text.alias("content"), ext.alias("extension")).where("length(content) > 0")
    kind = F.when(F.col("extension").isin("md", "markdown"), "markdown").when(F.col("extension").isin("json", "jsonl"), "json").when(F.try_element_at(codes, F.col("extension")).isNotNull(), "code").otherwise("text")
    return d.select(
        F.col("path").alias("source"), title(F.col("content"), F.col("path")).alias("title"), "content", "extension", kind.alias("file_type"),
        F.try_element_at(codes, F.col("extension")).alias("language"), F.slice(F.regexp_extract_all("content", F.lit(r"(?m)^#{1,6}[ \t]+(.+)$"), 1), 1, 10).alias("headings"),
    )


def previews(docs: DataFrame, limit: int = 50) -> DataFrame:
    """A listing of sources: the first 240 characters, the length and whether it was cut."""
    return docs.orderBy("source").limit(limit).select("source", "title", F.substring("content", 1, 240).alias("preview"), F.length("content").alias("chars"), (F.length("content") > 240).alias("truncated"))


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 64, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric or time key; filters and columns are pushed to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), fetchsize="10000", **options)
    return reader.load()
