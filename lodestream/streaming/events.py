"""Structured Streaming: days with late data, the pending queue, state folded by key. Extensions beside the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, at: str, by: str, late: str = "7 days") -> DataFrame:
    """(day, by, events) by tumbling days; events later than the watermark are dropped by the engine."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day"), by).agg(F.count("*").alias("events")).select(F.col("window.start").alias("day"), by, "events")


def index_pending(records: DataFrame, index: Callable[[DataFrame], None], marked: Callable[[DataFrame], None], checkpoint: str, key: str = "memory_id") -> StreamingQuery:
    """Each micro-batch of pending records is indexed, then exactly its keys are marked; a batch run again changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        pending = df.where("index_status = 'pending'").dropDuplicates([key]).persist()
        index(pending)
        marked(pending.select(key))
        pending.unpersist()

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_state(updates: DataFrame, key: str) -> DataFrame:
    """(key, value, updates) as updates (kind, value, ordinal) arrive: ``override`` replaces the list, others append."""

    def step(k: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n = state.get if state.exists else ("", 0)
        parts = value.split("|") if value else []
        for f in frames:
            for kind, v in f.sort_values("ordinal")[["kind", "value"]].itertuples(index=False):
                parts = [v] if kind == "override" else [*parts, v]
                n += 1
        state.update(("|".join(parts), n))
        yield pd.DataFrame({key: [k[0]], "value": ["|".join(parts)], "updates": [n]})

    kind = updates.schema[key].dataType.simpleString()
    return updates.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, value string, updates bigint", "value string, n bigint", "update", GroupStateTimeout.NoTimeout)
