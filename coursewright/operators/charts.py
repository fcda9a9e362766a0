"""Tables that charts are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.functions.dates import period_start
from coursewright.functions.numbers import histogram_bin
from coursewright.operators.quantiles import quantiles


def term_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    from coursewright.functions.text import exploded_tokens

    return exploded_tokens(docs, text).groupBy("term").agg(F.count("*").alias("n"))


def timeline(df: DataFrame, date: str, unit: str = "M", category: str | None = None) -> DataFrame:
    keys = [period_start(F.col(date), unit).cast("timestamp_ntz").alias("period"), *([F.col(category)] if category else [])]
    return df.where(F.col(date).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))


def sum_by_period(df: DataFrame, date: str, value: str, unit: str = "M") -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(period_start(F.col(date), unit).cast("timestamp_ntz").alias("period")).agg(F.sum(value).alias("total"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(histogram_bin(F.col(column), bins).alias("bin")).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, value: str, group: str) -> DataFrame:
    """Minimum, quartiles and maximum by group, exactly, however large a group is."""
    q = quantiles(df, value, (0.0, 0.25, 0.5, 0.75, 1.0), (group,))
    return q.select(group, *[F.round(f"q{k}", 6).alias(n) for k, n in enumerate(("low", "q1", "median", "q3", "high"))])


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    return df.groupBy(x, y).agg(F.round(F.avg(value), 6).alias("mean_value"))


def wide_heatmap(df: DataFrame, x: str, y: str, value: str, columns: list) -> DataFrame:
    """As ``heatmap``, one column for each of the given values of ``y``."""
    return df.groupBy(x).pivot(y, columns).agg(F.first(value))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(x, y).where(F.col(x).isNotNull()).orderBy(x)


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for n, c in (("x", x), ("y", y), ("color", color), ("size", size)) if c])


def quality_bars(quality: DataFrame) -> DataFrame:
    names = ("completeness", "metadata", "content", "quality")
    return quality.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"{n}_score").alias("score")) for n in names])).alias("x")).select("x.*")
