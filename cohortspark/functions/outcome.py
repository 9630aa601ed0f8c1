"""Survival codes and clips."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def event_code(event: Column, competing: Column) -> Column:
    """1 for the event, else 2 for the competing event, else 0 (censored)."""
    return F.when(event == 1, 1).when(competing == 1, 2).otherwise(0)


def clip_low(c: Column, low: float) -> Column:
    """Null-safe lower clip (greatest alone would turn null into the bound)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clip_high(c: Column, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def indicators(column: str, values: list, prefix: str) -> list[Column]:
    """One 0/1 column per listed value."""
    return [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values]
