"""From catalog files to all results, as lazy frames."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.functions import dates, numbers, text
from coursewright.operators import columns, merge, metrics, recommend, validate
from coursewright.sources.readers import read_catalog


@dataclass
class Results:
    """Named frames; nothing runs until one is asked for."""

    courses: DataFrame
    findings: DataFrame
    duplicates: DataFrame
    totals: DataFrame
    quality: DataFrame
    activity: DataFrame
    trend: DataFrame
    recommendations: DataFrame
    alerts: DataFrame

    def sheets(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("courses", "findings")}


def clean(df: DataFrame) -> DataFrame:
    """Standard names, numbers, dates, counts and categories of one source."""
    d = columns.settle_unnamed(columns.standardize(columns.null_tokens(df)))
    strings = [c for c, t in d.dtypes if t == "string"]
    d = d.withColumns({c: F.trim(F.col(c)) for c in strings})
    if "course_no" in d.columns:
        d = d.withColumn("course_no", text.clean_course_no(F.col("course_no")))
    for c in ("course_available_from", "course_discontinued_from", "last_updated"):
        if c in d.columns:
            d = d.withColumn(c, dates.parse_date(F.col(c)))
    for c in ("learner_count", "total_2024_activity", "cross_reference_count"):
        if c in d.columns:
            d = d.withColumn(c, F.coalesce(numbers.clean_number(F.col(c)), F.lit(0.0)).cast("bigint"))
    if "duration_mins" in d.columns:
        d = d.withColumn("duration_mins", numbers.clean_number(F.col("duration_mins")))
    return columns.fill_category(d) if "category_name" in d.columns else d


def derive(df: DataFrame, as_of: str) -> DataFrame:
    """Types, cases, age, status and activity level."""
    d = columns.cast_types(columns.add_missing(df, (*columns.config.REQUIRED_COLUMNS, "course_discontinued_from", "learner_count", "total_2024_activity", "cross_reference_count", "course_keywords")))
    return d.withColumns(
        {
            "region_entity": text.title_case(F.col("region_entity")),
            "course_type": F.lower("course_type"),
            "course_age_days": dates.difference(F.col("course_available_from"), F.lit(as_of).cast("timestamp_ntz")),
            "course_status": dates.status(F.col("course_discontinued_from"), as_of),
            "activity_level": numbers.activity_level(F.col("total_2024_activity")),
        }
    )


def analyze(sources: list[tuple[str, DataFrame]], as_of: str) -> Results:
    """Clean each source, put them together, keep the latest row of each number, and describe the rest."""
    ready = merge.rank_sources([(n, clean(d)) for n, d in sources])
    ready = [(n, d if "row_no" in d.columns else d.withColumn("row_no", F.monotonically_increasing_id())) for n, d in ready]
    whole = columns.synthetic_keys(columns.union_sources(ready))
    whole = derive(whole, as_of)
    courses = merge.dedupe_latest(whole, order=("source_rank", "row_no"))
    quality, activity = metrics.quality_metrics(courses), metrics.activity_metrics(courses, as_of)
    return Results(
        courses,
        validate.check_rows(whole, ("source_rank", "row_no")),
        merge.duplicate_summary(whole),
        metrics.catalog_totals(courses, as_of),
        quality,
        activity,
        metrics.monthly_trend(courses),
        recommend.row_recommendations(courses),
        recommend.alerts(quality, activity, as_of),
    )


def analyze_files(spark: SparkSession, paths: list[str], as_of: str) -> tuple[Results, list[tuple[str, str]]]:
    """As ``analyze``, from files; with the files that could not be read."""
    good, bad = read_catalog(spark, paths)
    return analyze(good, as_of), bad
