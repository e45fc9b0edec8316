"""Scalar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def angle(dy: Column, dx: Column) -> Column:
    """The direction of (dx, dy), 0 to 2 pi."""
    a = F.atan2(dy, dx)
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def holiday_flags(df: DataFrame, day: str, holiday: str) -> DataFrame:
    """weekday (Monday 0), weekend, and whether the day is less than one or two weeks before or after a holiday."""
    left = F.datediff(F.lit(holiday).cast("date"), F.col(day))
    between = lambda x, n: ((x > 0) & (x < n)).cast("int")
    return df.withColumns({"weekday": F.weekday(day), "weekend": (F.weekday(day) >= 5).cast("int"), "week_before": between(left, 7), "two_before": between(left, 14), "week_after": between(-left, 7), "two_after": between(-left, 14)})


def round_binary(x: Column, places: int) -> Column:
    """x times a power of ten, rounded half away from zero and divided again, as other engines round doubles. Spark's own round goes by the
    shortest decimal, so that 1024.1625, which is a little less than that in binary, would become 1024.163 and not 1024.162."""
    scale = F.lit(10.0**places)
    return F.round(x * scale) / scale
