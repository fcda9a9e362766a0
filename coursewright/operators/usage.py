"""Usage analyses of training records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright import config
from coursewright.functions.dates import difference

#: Completions above which a row counts as high volume (our choice; none is given).
HIGH_VOLUME = 5000
#: Longest minutes of a micro-learning unit (our choice).
MICRO_MINUTES = 15


def history(df: DataFrame, high: int = HIGH_VOLUME) -> DataFrame:
    return df.agg(F.sum("completion_count").alias("total_completions"), F.count_if(F.col("completion_count") > high).alias("high_volume"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Rows by value with their percentage of all."""
    per = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return per.join(F.broadcast(total)).select(column, "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct"))


def delivery(df: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for kv in config.DELIVERY_LABELS.items() for x in kv])
    return df.groupBy("delivery_method").agg(F.count("*").alias("n"), F.round(F.avg("duration_minutes"), 4).alias("avg_minutes"), F.count_if(F.col("duration_minutes") <= MICRO_MINUTES).alias("micro")).withColumn(
        "label", F.coalesce(F.element_at(labels, F.col("delivery_method")), F.col("delivery_method"))
    )


def content_age(df: DataFrame, as_of: str) -> DataFrame:
    days = difference(F.col("available_from"), F.lit(as_of).cast("timestamp_ntz"))
    return df.agg(*[F.count_if(days <= n * 365).alias(f"{n}_year") for n in (1, 2, 3)])


def assignment_hours(df: DataFrame) -> DataFrame:
    return df.groupBy("assignment_type").agg(F.count("*").alias("n"), F.round(F.sum("training_hours"), 4).alias("hours"))


def volume(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"), F.sum("completion_count").alias("completions"))


def top_interests(df: DataFrame, n: int = 5) -> DataFrame:
    return df.groupBy("interest_area").agg(F.sum("completion_count").alias("completions")).orderBy(F.desc("completions"), "interest_area").limit(n)


def category_counts(flagged: DataFrame) -> DataFrame:
    """How many rows have each training category's flag; a row may have several."""
    names = list(config.TRAINING_CATEGORIES)
    one = flagged.agg(*[F.count_if(F.col(f"is_{c}")).alias(c) for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in names])).alias("x")).select("x.*")


def report(df: DataFrame, as_of: str) -> str:
    """The analyses as text with headings; each part is a few rows."""
    parts = {
        "EDUCATION HISTORY": history(df),
        "PERSONAS": shares(df, "persona_type"),
        "DELIVERY METHODS": delivery(df),
        "CONTENT AGE": content_age(df, as_of),
        "ASSIGNMENT": assignment_hours(df),
        "INTERESTS": top_interests(df),
    }
    lines = []
    for title, d in parts.items():
        lines += [title, "=" * len(title)]
        lines += ["  ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in d.limit(50).collect()]
        lines.append("")
    return "\n".join(lines)
