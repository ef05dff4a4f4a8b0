"""Slots for models that are not here: each takes a batch function and falls back to a deterministic default."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_model(name: str, model: Callable[[pd.Series], pd.Series] | None, returns: T.DataType, default: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """An Arrow-batched column function over a text model (embedding, rewriting, summary, OCR); ``default`` without one.

    A batch on which the model fails takes null, and null takes the default.
    """
    if model is None:
        return default

    @F.pandas_udf(returns)
    def run(s: pd.Series) -> pd.Series:
        try:
            return model(s)
        except Exception:  # noqa: BLE001 - a failing model must not fail the query
            return pd.Series([None] * len(s))

    run.__name__ = name
    return lambda c: F.coalesce(run(c), default(c))


def cleaned_rewrite(answer: Column, original: Column) -> Column:
    """A rewritten query out of a model's answer: fences, JSON, prefixes and quotes off; the original where none is left."""
    s = F.btrim(F.regexp_replace(answer, r"(?s)^```\w*\s*|\s*```$", ""))
    s = F.coalesce(*(F.get_json_object(s, f"$.{k}") for k in ("query", "rewritten_query", "search_query")), s)
    s = F.btrim(F.regexp_replace(s, r"(?i)^(?:rewritten )?query\s*:\s*", ""))
    s = F.btrim(s, F.lit("\"'` "))
    fits = (F.length(s) > 0) & (F.length(s) <= F.greatest(F.lit(4000), 5 * F.length(original)))
    return F.when(fits, s).otherwise(original)


def image_route(width: Column, height: Column, edges: Column, probe: Column, vision: Column) -> Column:
    """Where an image goes by its features: skip, ocr, vision or both; an ordered choice."""
    tiny = (width < 32) | (height < 32)
    worded = F.length(F.trim(F.coalesce(probe, F.lit("")))) >= 20
    return F.when(tiny, "skip").when(worded & vision & (edges < 0.2), "both").when(worded | ~vision, "ocr").otherwise("vision")
