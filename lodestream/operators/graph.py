"""Term graph over chunks: informative terms, neighbours by shared terms, structural edges, the expansion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import cut
from .ordering import numbered


def mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term), distinct."""
    return X.exploded(docs.select(key, X.graph_terms(F.coalesce(F.col(text), F.lit(""))).alias("t")), "t", "term")


def informative_terms(docs: DataFrame, key: str, text: str, percentile: float = 50) -> DataFrame:
    """(term, df, idf, threshold) of the terms at or above the idf at the percentile's position of the ascending idf list.

    The position is found from counts by document frequency, of which there are few, not by ranking all terms.
    """
    m = mentions(docs, key, text)
    n = docs.count()
    df = m.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.withColumn("idf", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    levels = idf.groupBy("idf").agg(F.count("*").alias("terms"))
    levels = levels.withColumn("upto", F.sum("terms").over(Window.orderBy("idf"))).withColumn("all", F.sum("terms").over(Window.partitionBy()))
    at = F.least(F.floor(F.col("all") * percentile / 100), F.col("all") - 1)
    threshold = levels.where(F.col("upto") > at).agg(F.min("idf").alias("threshold"))
    return idf.join(F.broadcast(threshold), F.col("idf") >= F.col("threshold"))  # one row


def term_neighbours(docs: DataFrame, key: str, text: str, seeds: DataFrame, percentile: float = 50, most: int = 8, weight: float = 0.35) -> DataFrame:
    """(seed, key, shared, score, confidence, rank): documents sharing informative terms with each seed document.

    Seeds are a stated set against all rows; the join touches only postings of the seeds' informative terms.
    score = weight * max(seed score, .1) * min(1, shared / 3), the terms' own informativeness being 1 above the threshold.
    """
    terms = informative_terms(docs, key, text, percentile).select("term")
    m = mentions(docs, key, text).join(terms, "term", "left_semi")
    s = m.join(seeds.select(key).distinct(), key, "left_semi").select(F.col(key).alias("seed"), "term")
    near = s.join(m, "term").where(F.col("seed") != F.col(key)).groupBy("seed", key).agg(F.count("*").alias("shared"))
    share = F.least(F.lit(1.0), F.col("shared") / 3)
    near = near.withColumns({"score": F.round(weight * 0.1 * share, 6), "confidence": F.round(0.5 * share + 0.5, 4)})
    w = Window.partitionBy("seed").orderBy(F.col("score").desc(), F.col("shared").desc(), F.col(key))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


#: Weight of the most distant pairs of a source, and how much each place further apart takes from 1.
FLOOR, STEP = 0.2, 0.15


def same_source_edges(docs: DataFrame, key: str, source: str, reach: int | None = None) -> DataFrame:
    """(from, to, source, place, weight): all documents of one source are linked, d places apart with max(.2, 1 - .15 (d - 1)).

    All pairs of a source grow as its square, and all beyond six places apart have the same weight. So pairs above it are
    rows with ``from`` and ``to``, and the rest is given by membership: a row for each document with ``to`` null, its
    place in the source and the floor weight, which any two members without a row of their own have. With ``reach``, only
    the pairs up to so many places apart and no membership. Null sources link nothing.
    """
    d = cut(numbered(docs.where(F.col(source).isNotNull()).select(key, source), source, key))
    near = reach if reach is not None else next(i for i in range(1, 100) if round(1 - STEP * i, 6) <= FLOOR)
    steps = F.explode(F.array(*(F.lit(i) for i in range(1, near + 1)))).alias("d")
    a = d.select(F.col(key).alias("from"), source, "n", steps).withColumn("n", F.col("n") + F.col("d"))
    weight = F.round(F.greatest(F.lit(FLOOR), 1 - STEP * (F.col("d") - 1)), 4)
    pairs = a.join(d.withColumnRenamed(key, "to"), [source, "n"]).select("from", "to", F.col(source).alias("source"), F.lit(None).cast("bigint").alias("place"), weight.alias("weight"))
    if reach is not None:
        return pairs
    kind = docs.schema[key].dataType
    return pairs.unionByName(d.select(F.col(key).alias("from"), F.lit(None).cast(kind).alias("to"), F.col(source).alias("source"), F.col("n").cast("bigint").alias("place"), F.lit(FLOOR).alias("weight")))


def shared_value_edges(docs: DataFrame, key: str, value: str, weight: float) -> DataFrame:
    """(from, to, weight): each document to the first document of the same value; pairs in between follow from those."""
    first = docs.where(F.length(value) > 0).groupBy(value).agg(F.min(key).alias("from"))
    return docs.join(first, value).where(F.col(key) > F.col("from")).select("from", F.col(key).alias("to"), F.lit(weight).alias("weight"))


def query_specificity(query: Column) -> Column:
    """Share of a query's words that are long (five or more) or capitalised."""
    words = F.filter(F.split(F.btrim(query), r"\s+"), lambda w: F.length(w) > 0)
    special = F.filter(words, lambda w: (F.length(w) >= 5) | ((F.length(w) >= 2) & w.rlike(r"^\p{Lu}")))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(special) / F.size(words))


def seed_concentration(hits: DataFrame, source: str, seeds: int = 4) -> DataFrame:
    """(query, concentration): the largest share of one source among a query's first seeds."""
    s = hits.where(F.col("rank") <= seeds).groupBy("query", source).agg(F.count("*").alias("n"))
    return s.groupBy("query").agg((F.max("n") / F.sum("n")).alias("concentration"))


def seed_informativeness(hits: DataFrame, docs: DataFrame, key: str, text: str, seeds: int = 3) -> DataFrame:
    """(query, informativeness): the mean normalised idf of the distinct graph terms of a query's first seeds, 0 without terms.

    idf = ln(1 + (n - df + .5) / (df + .5)) over ln(n + 1), where n is the largest df of any term.
    """
    first = hits.where(F.col("rank") <= seeds).select("query", key)
    # distinct terms with counts, read twice
    df = cut(mentions(docs, key, text).groupBy("term").agg(F.count("*").alias("df")))
    n = df.agg(F.max("df").cast("double").alias("n"))
    of_seeds = mentions(docs.join(first.select(key).distinct(), key, "left_semi"), key, text)
    asked = first.join(of_seeds, key).select("query", "term").distinct()
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) / F.log(F.col("n") + 1)
    each = asked.join(df, "term").crossJoin(F.broadcast(n)).groupBy("query").agg(F.avg(idf).alias("informativeness"))  # one row
    return first.select("query").distinct().join(each, "query", "left").select("query", F.coalesce("informativeness", F.lit(0.0)).alias("informativeness"))


def expansion_gate(signals: DataFrame) -> DataFrame:
    """Adds favourable, should_expand and confidence to (specificity, concentration, informativeness) signals."""
    n = (F.col("specificity") >= 0.3).cast("int") + (F.col("concentration") >= 0.5).cast("int") + (F.col("informativeness") >= 0.3).cast("int")
    d = signals.withColumn("favourable", n)
    go = F.col("favourable") >= 2
    return d.withColumns({"should_expand": go, "confidence": F.when(go, 0.5 + 0.25 * F.col("favourable")).otherwise(0.5 - 0.1 * (3 - F.col("favourable")))})


def expand(seeds: DataFrame, docs: DataFrame, key: str, text: str, go: DataFrame | None = None, weight: float = 0.35, most: int = 4, least: float = 0.15, percentile: float = 50) -> DataFrame:
    """(query, key, score, graph_score): each query's seeds merged with the documents that share informative terms with them.

    seeds: (query, key, score); go: (query, should_expand), queries without true keep their seeds as they are. A neighbour
    has weight * max(seed score, .1) * min(1, shared / 3), the largest over the seeds, where its confidence, half that
    share and half the terms' informativeness (1 above the threshold), is at least ``least``; the ``most`` best enter, a
    seed among them keeps the larger of its two scores. Shared terms are counted once per distinct seed document and
    neighbour, not once per query.
    """
    terms = informative_terms(docs, key, text, percentile).select("term")
    m = mentions(docs, key, text).join(terms, "term", "left_semi")
    s = m.join(seeds.select(key).distinct(), key, "left_semi").select(F.col(key).alias("seed"), "term")
    near = s.join(m, "term").where(F.col("seed") != F.col(key)).groupBy("seed", key).agg(F.count("*").alias("shared"))
    asked = seeds.where(F.col("score") > 0).select("query", F.col(key).alias("seed"), F.col("score").alias("s"))
    if go is not None:
        asked = asked.join(go.where("should_expand").select("query"), "query", "left_semi")
    share = F.least(F.lit(1.0), F.col("shared") / 3)
    found = asked.join(near, "seed").where(F.round(0.5 * share + 0.5, 4) >= least)
    found = found.select("query", key, F.round(weight * F.greatest(F.col("s"), F.lit(0.1)) * share, 6).alias("g"), "shared")
    best = found.groupBy("query", key).agg(F.max(F.struct("g", "shared")).alias("b")).select("query", key, "b.*")
    w = Window.partitionBy("query").orderBy(F.desc("g"), F.desc("shared"), F.col(key))
    best = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("query", key, F.col("g").alias("graph_score"))
    merged = seeds.select("query", key, "score").join(best, ["query", key], "full")
    return merged.select("query", key, F.greatest("score", "graph_score").alias("score"), "graph_score")


def expand_once(seeds: DataFrame, docs: DataFrame, key: str, text: str, weight: float = 0.35, least: float = 0.15, percentile: float = 50) -> DataFrame:
    """(query, key, score): the store-backed variant: one score a neighbour over the union of terms shared with any seed, by
    the best seed's score, seeds themselves left out, no limit."""
    terms = informative_terms(docs, key, text, percentile).select("term")
    m = mentions(docs, key, text).join(terms, "term", "left_semi")
    asked = seeds.join(m, key).select("query", "term").distinct()
    top = seeds.groupBy("query").agg(F.max("score").alias("s"))
    near = asked.join(m, "term").groupBy("query", key).agg(F.count("*").alias("shared")).join(seeds.select("query", key), ["query", key], "left_anti")
    share = F.least(F.lit(1.0), F.col("shared") / 3)
    near = near.join(top, "query").where((F.round(0.5 * share + 0.5, 4) >= least) & (F.col("s") > 0))
    return near.select("query", key, F.round(weight * F.greatest(F.col("s"), F.lit(0.1)) * share, 6).alias("score"))


def neighbours_of(edges: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, neighbour, weight) over undirected edges (from, to, weight) of the wanted keys, the largest weight a pair."""
    both = edges.select(F.col("from").alias(key), F.col("to").alias("neighbour"), "weight").unionByName(edges.select(F.col("to").alias(key), F.col("from").alias("neighbour"), "weight"))
    return both.where(F.col(key) != F.col("neighbour")).join(wanted.select(key).distinct(), key, "left_semi").groupBy(key, "neighbour").agg(F.max("weight").alias("weight"))
