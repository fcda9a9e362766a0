"""Number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_number(c: Column) -> Column:
    """What is left of a text without signs other than digits, point and minus, as double; null if that is no number."""
    return F.regexp_replace(c.cast("string"), r"[^\d.-]", "").try_cast("double")


def activity_level(c: Column) -> Column:
    return F.when(c <= 0, "none").when(c <= 10, "low").when(c <= 50, "medium").when(c > 50, "high")


def quality_bin(c: Column) -> Column:
    return F.when(c <= 0.2, "Very Poor").when(c <= 0.4, "Poor").when(c <= 0.6, "Fair").when(c <= 0.8, "Good").when(c <= 1.0, "Excellent")


def similarity_bin(c: Column) -> Column:
    return F.when(c >= 0.8, "very_high").when(c >= 0.6, "high").when(c >= 0.4, "medium").when(c >= 0.2, "low").otherwise("very_low")


def histogram_bin(c: Column, bins: int = 20) -> Column:
    """Which of ``bins`` equal parts of [0, 1] holds the value; 1.0 is in the last."""
    return F.least(F.width_bucket(c, F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)).cast("long")


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
