"""Text expressions on the JVM side: tokens, excerpts, estimates, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
HAN = "[一-鿿]"
GRAPH_TERM = r"[A-Za-z][A-Za-z0-9_-]+|[一-鿿]+"
#: Function words that connect anything with anything; pass your own for other corpora.
STOPWORDS = tuple("the and for with that this from not are was were but had has have its they their there which while when who will would can could been than then into over after before about".split())


def tokens(text: Column) -> Column:
    """Lower-case words; a word that holds a Chinese character becomes its Chinese characters, one token each."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(HAN), F.regexp_extract_all(w, F.lit(HAN), 0)).otherwise(F.array(w))))


def exploded(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a row for each element of the array column, as ``name``; empty and null arrays give none.

    The outer form with a filter above it: Spark would infer a filter on the array's size for the inner one and push it
    under the expression that makes the array, which then runs twice.
    """
    return df.withColumn(name, F.explode_outer(column)).drop(column).where(F.col(name).isNotNull())


def graph_terms(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct Latin identifiers of two or more characters and runs of Chinese ones, without stop words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(GRAPH_TERM), 0), lambda w: F.btrim(F.lower(w), F.lit("_-")))
    found = F.filter(found, lambda w: F.length(w) >= 2)
    return F.array_except(found, F.array(*map(F.lit, stopwords)))


def excerpt(text: Column, longest: int = 500) -> Column:
    """White space collapsed; longer texts end in three dots within the limit."""
    s = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(s) <= longest, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, longest - 3)), F.lit("...")))


def token_estimate(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("bigint")


def cut_to_tokens(text: Column, budget: int) -> Column:
    return F.when(F.length(text) <= 4 * budget, text).otherwise(F.rtrim(F.substring(text, 1, 4 * budget)))


def basename(source: Column) -> Column:
    return F.substring_index(F.element_at(F.split(F.replace(source, F.lit("\\"), F.lit("/")), "/"), -1), "#", 1)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a code-point offset."""
    head = F.substring(text, F.lit(1), offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def document_key(source: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit("\n"), F.coalesce(title, F.lit(""))), 256), 1, 16)


def hashtags(tags: Column, content: Column) -> Column:
    inline = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"#([\p{L}\p{N}_-]+)"), 1)
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(tags, F.array().cast("array<string>")), inline)))
