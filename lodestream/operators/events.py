"""Extensions over timed events: as-of lookup, sessions, days. The batch side of ``streaming.events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordering
from .ordering import laid


def last_before(events: DataFrame, key: str, at: str, order: str, kind: str, of: str, before: str) -> DataFrame:
    """(order, key, previous): for each ``of`` event the id of the key's last ``before`` event; no range join."""
    e = laid(events.where(F.col(kind).isin(of, before)).select(key, at, order, kind), key, at, order)
    seen = ordering.last_before(e, key, (at, order), F.when(F.col(kind) == before, F.col(order)), "previous")
    return seen.where(F.col(kind) == of).select(order, key, "previous")


def sessions(events: DataFrame, key: str, at: str, order: str, gap_seconds: int) -> DataFrame:
    """(key, session, events, first, last): runs of events no more than the gap apart."""
    e = laid(events.select(key, at, order), key, at, order)
    e = ordering.last_before(e, key, (at, order), F.col(at), "__previous")
    gap = F.timestamp_diff("SECOND", F.col("__previous"), F.col(at))
    e = ordering.running_sum(e, key, (at, order), F.when(gap > gap_seconds, 1).otherwise(0), "session")
    return e.groupBy(key, F.col("session").cast("bigint").alias("session")).agg(F.count("*").alias("events"), F.min(at).alias("first"), F.max(at).alias("last"))


def daily(events: DataFrame) -> DataFrame:
    """(day, event_type, events, total)."""
    return events.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
