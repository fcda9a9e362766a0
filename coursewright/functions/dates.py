"""Date functions. Nothing reads the clock: what depends on today takes ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright import config


def parse_date(c: Column, formats: tuple[str, ...] = config.DATE_FORMATS) -> Column:
    """The first format that reads the value, as timestamp_ntz; null if none does or the value means missing."""
    t = F.trim(c.cast("string"))
    t = F.when(t.isin("", "nan", "None", "NaT"), None).otherwise(t)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def difference(start: Column, end: Column, unit: str = "days") -> Column:
    """Whole days, 30-day months or 365-day years from start to end, rounded down also below zero."""
    days = F.floor((micros(end) - micros(start)) / F.lit(86_400_000_000.0))
    return F.floor(days / {"days": 1, "months": 30, "years": 365}[unit]).cast("long")


def is_active(discontinued: Column, as_of: str) -> Column:
    return discontinued.isNull() | (discontinued > F.lit(as_of).cast("timestamp_ntz"))


def status(discontinued: Column, as_of: str) -> Column:
    return F.when(is_active(discontinued, as_of), "active").otherwise("discontinued")


def format_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c.cast("timestamp"), "yyyy-MM-dd"), F.lit("N/A"))


def month_ends(start: Column, end: Column) -> Column:
    """The last days of the months that end within the range."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.filter(F.transform(months, lambda m: F.last_day(m)), lambda d: d <= end.cast("date"))


def recent(c: Column, as_of: str, days: int = config.RECENT_DAYS) -> Column:
    end = F.lit(as_of).cast("timestamp_ntz")
    return c.between(end - F.make_dt_interval(F.lit(days)), end)


def period_start(c: Column, unit: str) -> Column:
    """Start of the day, week, month, quarter or year (D, W, M, Q, Y)."""
    return F.date_trunc({"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}[unit], c)


def parse_column(df: DataFrame, column: str, formats: tuple[str, ...] = config.COLUMN_DATE_FORMATS) -> DataFrame:
    """Read a column with the first format that reads any of its values, and flag what it does not read.

    One aggregate counts what each format reads.
    """
    t = F.trim(F.col(column).cast("string"))
    counts = df.agg(*[F.count(F.try_to_timestamp(t, F.lit(f))).alias(f"n{k}") for k, f in enumerate(formats)]).first()
    best = next((f for k, f in enumerate(formats) if counts[f"n{k}"]), None)
    read = F.try_to_timestamp(t, F.lit(best)).cast("timestamp_ntz") if best else F.lit(None).cast("timestamp_ntz")
    return df.withColumn(column, read).withColumn(f"{column}_is_valid", F.col(column).isNotNull())
