"""Sinks: append of new rows only, index tables rewritten as a whole or by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str, dry_run: bool = True) -> DataFrame:
    """The rows whose key the JSON store at ``path`` does not have yet; written there unless dry_run."""
    fresh = rows.dropDuplicates([key])
    try:
        stored = spark.read.schema(rows.schema).json(path)
        fresh = fresh.join(stored.select(key), key, "left_anti")
    except Exception as e:  # noqa: BLE001 - a store that does not exist yet holds nothing
        if "PATH_NOT_FOUND" not in str(e):
            raise
    if not dry_run:
        fresh.write.mode("append").json(path)
    return fresh


def write_index(tables: dict[str, DataFrame], folder: str, partition_by: str | None = None) -> None:
    """Index tables (chunks, postings, lengths, vectors, edges) as Parquet, rewritten whole, or by partition of a source."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if partition_by and partition_by in df.columns:
            w = w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
        w.parquet(f"{folder}/{name}")


def index_status(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(index, entries) of the written index tables."""
    parts = [spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias("entries")).select(F.lit(n).alias("index"), "entries") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
