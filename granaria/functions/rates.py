"""Ratios in both null conventions, and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """Null where the population is empty."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def safe_div(part: Column, whole: Column) -> Column:
    """0.0 where the population is empty (the older convention)."""
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def sigmoid(x: Column, clip: float = 50.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), x))))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")
