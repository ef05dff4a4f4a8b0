"""The relational part of running tools and researchers: scopes, names, caps, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def owned(df: DataFrame, owner: str, who: str) -> DataFrame:
    """Rows of one owner; rows of nobody belong to nobody."""
    return df.where(F.col(owner) == who)


def unique_names(tools: DataFrame, server: str, name: str) -> DataFrame:
    """(server, name, called): a name two servers offer stays bare with the first of them, the others' get their server in front."""
    first = tools.groupBy(name).agg(F.min(server).alias("__first"))
    t = tools.select(server, name).distinct().join(first, name)
    called = F.when(F.col(server) == F.col("__first"), F.col(name)).otherwise(F.concat(server, F.lit("__"), name))
    return t.select(server, name, called.alias("called"))


def last_of_each(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The k last rows of each ``by`` with their rank from the end; the rank limit acts before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def admitted_units(df: DataFrame, by: str, order: str, slots: int, running: int) -> DataFrame:
    """The first ``slots`` units of each ``by``: ``run`` up to ``running`` at once, then ``overflow``; later ones are skipped."""
    first = last_of_each(df, by, [F.col(order)], slots)
    return first.withColumn("state", F.when(F.col("rank") <= running, "run").otherwise("overflow"))


def preference(a: Column, b: Column) -> Column:
    """[1, 0], [0, 1] or [0, 0] by which of two scores is the larger."""
    return F.when(a > b, F.array(F.lit(1), F.lit(0))).when(b > a, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(0)))


def image_references(text: Column) -> Column:
    """Data URLs of images in a text; references to other hosts are not followed."""
    return F.regexp_extract_all(text, F.lit(r"data:image/[a-z+.-]+;base64,[A-Za-z0-9+/=]+"), 0)
