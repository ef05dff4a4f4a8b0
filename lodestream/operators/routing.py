"""Routing by keyword, sections from evidence, ordered folds of state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_domains(queries: DataFrame, key: str, text: str, domains: DataFrame) -> DataFrame:
    """(key, domain): domains always active, or one of whose keywords the text holds.

    domains: (domain, always, keyword), a small dimension table of stated size; every query is held against it.
    """
    low = queries.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    hit = low.join(F.broadcast(domains), F.col("always") | F.expr("instr(__t, keyword) > 0"))
    return hit.select(key, "domain").distinct()


def assemble(plan: DataFrame, done: DataFrame, by: str) -> DataFrame:
    """(by, report): planned sections in order with the last content written for each; unwritten ones stay empty."""
    last = done.groupBy(by, "section").agg(F.max_by("content", "ordinal").alias("content"))
    j = plan.join(last, [by, "section"], "left")
    part = F.struct("position", F.concat(F.lit("## "), "section", F.lit("\n"), F.coalesce("content", F.lit(""))).alias("b"))
    return j.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.b), "\n\n").alias("report"))


def reduce_state(updates: DataFrame, key: str, order: str) -> DataFrame:
    """(key, value) after ordered updates (kind, value): ``override`` replaces what was gathered, others append."""
    last = updates.groupBy(key).agg(F.max(F.when(F.col("kind") == "override", F.col(order))).alias("__from"))
    kept = updates.join(last, key).where(F.col("__from").isNull() | (F.col(order) >= F.col("__from")))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "value"))), lambda x: x.value), "|").alias("value"))


def role_evidence(plan: DataFrame, reports: DataFrame, by: str) -> DataFrame:
    """(by, section, evidence): for each planned section the reports of its comma-separated roles; of all roles where none has any.

    reports: (by, role, ordinal, report), some a role.
    """
    lists = lambda d, *g: d.groupBy(*g).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "report"))), lambda x: x.report).alias("l"))
    asked = plan.select(by, "section", F.explode_outer(F.transform(F.split("roles", ","), lambda r: F.lower(F.btrim(r)))).alias("role"))
    some = asked.join(reports, [by, "role"]).transform(lambda d: lists(d, by, "section"))
    whole = lists(reports, by).withColumnRenamed("l", "w")
    j = plan.select(by, "section").join(some, [by, "section"], "left").join(whole, by, "left")
    return j.select(by, "section", F.array_join(F.coalesce("l", "w", F.array().cast("array<string>")), "\n\n").alias("evidence"))


def tools_by_domain(tools: DataFrame) -> DataFrame:
    """(domain, tools, names): distinct names in order, of a table of tools of stated size."""
    return tools.groupBy("domain").agg(F.countDistinct("tool").alias("tools"), F.array_join(F.array_sort(F.collect_set("tool")), ", ").alias("names"))


def transcript(messages: DataFrame, by: str) -> DataFrame:
    """(by, text): (role, ordinal, said) messages of each thread as tagged lines, in order."""
    tag = F.when(F.col("role").isin("user", "human"), "user_input").when(F.col("role").isin("assistant", "ai"), "assistant_output").otherwise(F.col("role"))
    line = F.concat(F.lit("<"), tag, F.lit(">"), "said", F.lit("</"), tag, F.lit(">"))
    return messages.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("b")))), lambda x: x.b), "\n").alias("text"))
