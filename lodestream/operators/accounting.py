"""Usage budgets: mergeable counters, differences, ordered admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered


def merge_usage(usage: DataFrame, by: str, counters: list[str], notes: str) -> DataFrame:
    """Sums the counters and unites the notes of each ``by``."""
    return usage.groupBy(by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counters), F.array_sort(F.collect_set(notes)).alias(notes))


def usage_difference(now: DataFrame, before: DataFrame, by: str, counters: list[str]) -> DataFrame:
    b = before.select(by, *(F.col(c).alias(f"__{c}") for c in counters))
    return now.join(b, by, "left").select(by, *(F.greatest(F.lit(0), F.col(c) - F.coalesce(F.col(f"__{c}"), F.lit(0))).cast("bigint").alias(c) for c in counters))


def admit(calls: DataFrame, by: str, order: str, cost: str, limit: float) -> DataFrame:
    """(by, admitted, spent): calls in order, each admitted while what is spent plus its cost stays within the limit.

    A skipped call spends nothing, so a cheaper one after it may pass; an ordered fold over each key's calls, which a
    session's budget keeps few.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("double").alias("c"))))
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast(calls.schema[order].dataType.simpleString().join(("array<", ">"))).alias("admitted"))

    def step(acc: Column, x: Column) -> Column:
        ok = acc.spent + x.c <= limit
        return F.struct(F.when(ok, acc.spent + x.c).otherwise(acc.spent).alias("spent"), F.when(ok, F.concat(acc.admitted, F.array(x.o))).otherwise(acc.admitted).alias("admitted"))

    g = calls.groupBy(by).agg(rows.alias("r")).select(by, F.aggregate("r", start, step).alias("a"))
    return g.select(by, F.size("a.admitted").cast("bigint").alias("admitted"), F.round("a.spent", 4).alias("spent"))


def remaining(limit: Column, used: Column) -> Column:
    """What is left; null where there is no limit, negative where it was passed."""
    return limit - used


def admit_calls(calls: DataFrame, by: str, order: str, is_search: Column, most_tools: int | None = None, most_searches: int | None = None) -> DataFrame:
    """calls with ``admitted``: in order, each while neither limit is passed; a skipped call spends nothing.

    A call costs one tool call, a search call also one search. So the first ``most_searches`` searches are the only ones
    that can pass, and of those and the other calls the first ``most_tools`` do: two numberings in groups of any size in
    place of a fold over a group.
    """
    d = numbered(calls.withColumn("__s", F.when(is_search, F.concat(F.col(by).cast("string"), F.lit("/s"))).otherwise(F.concat(F.col(by).cast("string"), F.lit("/t")))), "__s", order)
    can = F.lit(True) if most_searches is None else ~is_search | (F.col("n") <= most_searches)
    d = d.withColumn("__can", can).drop("n", "__s")
    d = numbered(d.withColumn("__k", F.concat(F.col(by).cast("string"), F.when(F.col("__can"), "/y").otherwise("/n"))), "__k", order)
    ok = F.col("__can") if most_tools is None else F.col("__can") & (F.col("n") <= most_tools)
    return d.withColumn("admitted", ok).drop("n", "__k", "__can")


def budget_warnings(used: dict[str, Column], limits: dict[str, int], ratio: float = 0.8) -> Column:
    """What a usage is near or past: a line for each limit reached or at least ``ratio`` used, in the limits' order."""
    lines = []
    for name, limit in limits.items():
        u = used[name]
        lines.append(F.when(u >= limit, F.concat(F.lit(f"{name}: limit "), u.cast("string"), F.lit(f"/{limit}"))).when(u >= ratio * limit, F.concat(F.lit(f"{name}: near "), u.cast("string"), F.lit(f"/{limit}"))))
    return F.array_compact(F.array(*lines))


def token_usage(message: str) -> tuple[Column, Column, Column]:
    """(input, output, total) tokens of a message variant: its usage, else its response's, the sum where no total is told."""
    def of(*paths: str) -> Column:
        return F.coalesce(*(F.nullif(F.try_variant_get(message, f"$.{p}", "bigint"), F.lit(0)) for p in paths), F.lit(0))

    told = ("response_metadata.token_usage", "response_metadata.usage")
    asked = of("usage_metadata.input_tokens", *(f"{t}.{n}" for n in ("input_tokens", "prompt_tokens") for t in told))
    said = of("usage_metadata.output_tokens", *(f"{t}.{n}" for n in ("output_tokens", "completion_tokens") for t in told))
    total = of("usage_metadata.total_tokens", *(f"{t}.total_tokens" for t in told))
    return asked, said, F.coalesce(F.nullif(total, F.lit(0)), asked + said)


def ordered_union(first: Column, second: Column) -> Column:
    """Distinct values of both lists in order of first appearance."""
    return F.array_union(first, second)


def list_difference(now: Column, before: Column) -> Column:
    """What now holds that before does not, repeats kept."""
    return F.filter(now, lambda x: ~F.array_contains(before, x))
