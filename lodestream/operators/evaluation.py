"""Retrieval quality: hit, recall, precision and reciprocal rank at k, by category, ablations, fronts, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def case_metrics(retrieved: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query, hit, recall, precision, mrr) from retrieved (query, item, rank) and expected (query, item).

    Precision is over what was returned, not over k. Cases that expect nothing have no row.
    """
    want = expected.select("query", "item").distinct()
    n = want.groupBy("query").agg(F.count("*").alias("wanted"))
    r = retrieved.where(F.col("rank") <= k).select("query", "item", "rank")
    got = r.join(want.withColumn("ok", F.lit(1)), ["query", "item"], "left")
    s = got.groupBy("query").agg(F.count("*").alias("returned"), F.count("ok").alias("right"), F.countDistinct(F.when(F.col("ok") == 1, F.col("item"))).alias("found"), F.min(F.when(F.col("ok") == 1, F.col("rank"))).alias("first"))
    j = n.join(s, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "query",
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.round(zero(F.col("found") / F.col("wanted")), 6).alias("recall"),
        F.round(zero(F.col("right") / F.col("returned")), 6).alias("precision"),
        F.round(zero(1.0 / F.col("first")), 6).alias("mrr"),
    )


def mean_metrics(cases: DataFrame, by: str) -> DataFrame:
    """Means by category and, where the category is null, over all cases."""
    m = [F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "precision", "mrr")]
    return cases.rollup(by).agg(F.count("*").alias("cases"), *m)


def ablation(base: DataFrame, other: DataFrame) -> DataFrame:
    """(query, gained, lost): items that only the other, or only the base run returned."""
    a, b = base.select("query", "item"), other.select("query", "item")
    both = a.withColumn("in_base", F.lit(1)).join(b.withColumn("in_other", F.lit(1)), ["query", "item"], "full")
    return both.groupBy("query").agg(F.count_if(F.col("in_base").isNull()).alias("gained"), F.count_if(F.col("in_other").isNull()).alias("lost"))


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that none beats in both: no other has x and y at least as large and one larger.

    One row a distinct x stays (its largest y), so the running maximum that follows sees few rows; no row pairs are made.
    """
    best = df.groupBy(x).agg(F.max(y).alias("__y"))
    above = F.max("__y").over(Window.orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("__a", above).where("__a IS NULL OR __y > __a").select(x, F.col("__y").alias(y))
    return df.join(front, [x, y], "left_semi")


def latency_report(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, min, median, p95 (by position), max and mean of each group; the position is found by an exact percentile."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.expr(f"percentile({value}, 0.5)").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean")
    )


def evidence_metrics(retrieved: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """(query, evidence_hit, evidence_recall, evidence_precision, misleading_rate, authoritative_rate) at k.

    retrieved: (query, rank, source, content, source_status); cases: (query, sources, keywords). Evidence is a hit of an
    expected source whose preview, the first 300 characters with white space collapsed, holds an expected keyword; recall
    counts keywords found in such sources. Cases without expected sources have no row; without keywords, any hit of an
    expected source is evidence. Rates are over what was returned.
    """
    preview = F.lower(F.substring(F.btrim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")), 1, 300))
    words = F.array_distinct(F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: F.lower(F.btrim(w))), lambda w: F.length(w) > 0))
    want = cases.where(F.size("sources") > 0).select("query", "sources", words.alias("words"))
    # every case has its row; the k hits of a case are one short list
    hits = retrieved.where(F.col("rank") <= k).select("query", F.struct("source", preview.alias("text"), F.coalesce("source_status", F.lit("authoritative")).alias("status")).alias("h"))
    j = want.join(hits.groupBy("query").agg(F.collect_list("h").alias("hits")), "query", "left")
    j = j.withColumn("hits", F.coalesce("hits", F.array().cast(hits.schema["h"].dataType.simpleString().join(("array<", ">")))))
    right = F.filter("hits", lambda h: F.array_contains("sources", h.source))
    evidence = F.filter(right, lambda h: (F.size("words") == 0) | F.exists("words", lambda w: F.contains(h.text, w)))
    found = F.filter("words", lambda w: F.exists(right, lambda h: F.contains(h.text, w)))
    n = F.greatest(F.lit(1), F.size("hits"))
    rate = lambda *s: F.round(F.size(F.filter("hits", lambda h: h.status.isin(*s))) / n, 6)
    hit = F.when(F.size(evidence) > 0, 1.0).otherwise(0.0)
    return j.select(
        "query", hit.alias("evidence_hit"), F.round(F.when(F.size("words") > 0, F.size(found) / F.size("words")).otherwise(hit), 6).alias("evidence_recall"),
        F.round(F.size(evidence) / n, 6).alias("evidence_precision"), rate("deprecated", "misleading", "unanswerable_trap").alias("misleading_rate"), rate("authoritative").alias("authoritative_rate"),
    )


def with_latency(cases: DataFrame, latencies: DataFrame, by: str) -> DataFrame:
    """``mean_metrics`` with cases counted for latency alone: latencies (query, by, ms) may hold queries that cases skip."""
    j = latencies.join(cases.drop(by), "query", "left")
    m = [F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "precision", "mrr")]
    return j.rollup(by).agg(F.count("*").alias("asked"), F.count("hit").alias("cases"), *m, F.round(F.avg("ms"), 4).alias("ms"))


def graph_effect(base: DataFrame, other: DataFrame, expected: DataFrame) -> DataFrame:
    """(benefit, noise, net, rank_change) of an expansion: shares of cases that gain an expected item they lacked, and of
    cases that gain only others; mean change of the first expected rank. Runs are (query, item, rank)."""
    want = expected.select("query", "item").distinct().withColumn("ok", F.lit(1))
    new = other.join(base.select("query", "item"), ["query", "item"], "left_anti").join(want, ["query", "item"], "left")
    first = lambda run, name: run.join(want, ["query", "item"]).groupBy("query").agg(F.min("rank").alias(name))
    gains = new.groupBy("query").agg(F.max("ok").alias("good"), F.count("*").alias("n"))
    j = want.select("query").distinct().join(gains, "query", "left").join(first(base, "r0"), "query", "left").join(first(other, "r1"), "query", "left")
    lacked = F.col("r0").isNull()
    j = j.withColumns({"benefit": (F.coalesce("good", F.lit(0)) == 1) & lacked, "noise": F.col("good").isNull() & (F.coalesce("n", F.lit(0)) > 0)})
    share = lambda c: F.avg(F.col(c).cast("double"))
    return j.agg(F.round(share("benefit"), 6).alias("benefit"), F.round(share("noise"), 6).alias("noise"), F.round(share("benefit") - share("noise"), 6).alias("net"), F.round(F.avg(F.col("r0") - F.col("r1")), 6).alias("rank_change"))


def judge_scores(answers: DataFrame, by: str) -> DataFrame:
    """(by, score, groundedness): a judge's 0 to 5 mark as a share of 5, and grounded claims over claims (1 without claims)."""
    return answers.groupBy(by).agg(F.round(F.avg(F.col("mark") / 5), 6).alias("score"), F.round(F.coalesce(F.sum("grounded") / F.nullif(F.sum("claims"), F.lit(0)), F.lit(1.0)), 6).alias("groundedness"))


def best_settings(runs: DataFrame) -> DataFrame:
    """Runs of a sweep with their place: hit first, recall next, then their name."""
    return runs.orderBy(F.desc("hit"), F.desc("recall"), "run")
