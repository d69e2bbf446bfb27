"""Rounding and clamping as scripts on the web do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def to_minutes(time: Column) -> Column:
    """Minutes of a transit time hh:mm:ss, whose hours may pass 24."""
    parts = F.split(time, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def to_time(minutes: Column) -> Column:
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat(two(F.floor(minutes / 60)), F.lit(":"), two(F.pmod(minutes, F.lit(60)).cast("bigint")), F.lit(":00"))
