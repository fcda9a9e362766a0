"""Validation: lists of rules become one array of findings per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright import config
from coursewright.functions.dates import parse_date

FINDING = "struct<severity:string,field:string,message:string>"


def _rule(when: Column, severity: str, field: str, message: str | Column) -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), m.alias("message")))


def findings(df: DataFrame, rules: list[Column], keys: tuple[str, ...]) -> DataFrame:
    """One row per rule that holds, with the row's keys."""
    held = F.filter(F.array(*[r.cast(FINDING) for r in rules]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(held).alias("x")).select(*keys, "x.severity", "x.field", "x.message")


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in config.REQUIRED_COLUMNS if c not in df.columns]


def check_rows(df: DataFrame, keys: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """Lenient findings: missing values, odd course numbers, versions and dates."""
    has = set(df.columns)
    rules = [_rule(F.col(c).isNull(), "WARNING", c, f"Missing required value for {c}") for c in config.REQUIRED_COLUMNS if c in has]
    if "course_no" in has:
        c = F.col("course_no").cast("string")
        signs = F.array(*[F.when(F.contains(c, F.lit(s)), F.lit(n)) for s, n in ((":", ":"), (",", ","), (" ", " "), ("​", "zero-width space"))])
        found = F.filter(signs, lambda x: x.isNotNull())
        rules.append(_rule(F.size(found) > 0, "INFO", "course_no", F.concat(F.lit("Course number contains invalid characters: "), F.array_join(found, ", "))))
    if "course_version" in has:
        v = F.trim(F.col("course_version").cast("string"))
        rules.append(_rule(v.isNotNull() & ~v.rlike(r"^\d+(\.\d+)*$"), "INFO", "course_version", "Version should ideally be in format X.Y.Z (e.g., 1.0.0)"))
    for d in ("course_available_from", "course_discontinued_from"):
        if d in has and dict(df.dtypes)[d] == "string":
            rules.append(_rule(F.col(d).isNotNull() & parse_date(F.col(d)).isNull(), "INFO", d, f"Invalid {d.replace('course_', '')} date format. Will attempt automatic conversion"))
    if "course_available_from" in has:
        rules.append(_rule(F.col("course_available_from").isNull(), "INFO", "course_available_from", "Course available from date is recommended"))
    return findings(df, rules, keys)


def _first(*checks: tuple[Column, str]) -> Column:
    out = None
    for when, message in checks:
        out = F.when(when, message) if out is None else out.when(when, message)
    return out


def _blank(c: Column, what: str) -> list[tuple[Column, str]]:
    return [(c.isNull() | (c == ""), f"{what} cannot be empty"), (F.trim(c) == "", f"{what} cannot contain only whitespace")]


def _digits(c: Column) -> Column:
    return F.trim(c).rlike(r"^\d+$")


def strict_rules(as_of: str) -> dict[str, Column]:
    """The first failing check of each field, as a message; null if the field is fine."""
    no, title, category, text, kind, region = (F.col(c) for c in config.REQUIRED_COLUMNS[:6])
    learners, activity, version = F.col("learner_count"), F.col("total_2024_activity"), F.col("course_version")
    keywords = F.transform(F.split("course_keywords", ","), lambda k: F.trim(k))
    any_key = lambda f: F.exists(keywords, f)
    now = F.lit(as_of).cast("timestamp_ntz")
    start, end = F.col("course_available_from"), F.col("course_discontinued_from")
    days = lambda n: F.make_dt_interval(F.lit(n))
    parts = F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))
    return {
        "course_no": _first(*_blank(no, "Course number"), (~no.rlike("^[A-Z0-9_-]+$"), "Course number contains invalid characters"), (F.length(no) > 50, "Course number cannot exceed 50 characters")),
        "course_title": _first(
            *_blank(title, "Course title"),
            (F.length(F.trim(title)) < 3, "Course title must be at least 3 characters long"),
            (F.length(F.trim(title)) > 200, "Course title cannot exceed 200 characters"),
            (_digits(title), "Course title cannot be a number only"),
        ),
        "category_name": _first(*_blank(category, "Category name"), (F.length(F.trim(category)) > 100, "Category name cannot exceed 100 characters"), (_digits(category), "Category name cannot be a number only")),
        "course_description": _first(
            *_blank(text, "Course description"),
            (F.length(F.trim(text)) < 50, "Course description must be at least 50 characters long"),
            (F.length(F.trim(text)) > 5000, "Course description cannot exceed 5000 characters"),
            (F.lower(F.trim(text)) == "no description available", "Course description cannot be a placeholder"),
            (F.size(F.array_distinct(F.split(F.trim(text), r"\s+"))) < 10, "Course description must contain meaningful content"),
        ),
        "course_type": _first(*_blank(kind, "Course type"), (~F.lower(F.trim(kind)).isin(*config.COURSE_TYPES), f"Course type must be one of: {', '.join(config.COURSE_TYPES)}")),
        "region_entity": _first(*_blank(region, "Region/Department"), (F.length(F.trim(region)) > 100, "Region/Department name cannot exceed 100 characters"), (_digits(region), "Region/Department name cannot be a number only")),
        "learner_count": _first((learners < 0, "Learner count cannot be negative"), (learners > 10_000, "Learner count exceeds reasonable limit (10,000)")),
        "total_2024_activity": _first((activity < 0, "Activity count cannot be negative"), (activity > 100_000, "Activity count exceeds reasonable limit (100,000)")),
        "course_keywords": _first(
            (F.col("course_keywords") == "", "Keywords cannot be empty"),
            (F.size(keywords) > 10, "Maximum 10 keywords allowed"),
            (any_key(lambda k: F.length(k) > 50), "Each keyword cannot exceed 50 characters"),
            (any_key(lambda k: k == ""), "Keywords cannot be blank"),
            (any_key(lambda k: k.rlike(r"^\d+$")), "Keywords cannot be numbers only"),
        ),
        "course_version": _first((~version.rlike(r"^\d+\.\d+\.\d+$"), "Version must be in format X.Y.Z"), (F.exists(parts, lambda p: p > 99), "Version numbers cannot exceed 99")),
        "course_available_from": _first(
            (start.isNull(), "Course available from date is required"),
            (start > now, "Course available from date cannot be in the future"),
            (start < now - days(5 * 365), "Course available from date cannot be more than 5 years in the past"),
        ),
        "course_discontinued_from": _first(
            (end < start, "Discontinued date cannot be before available date"),
            (end > now, "Discontinued date cannot be in the future"),
            (end - start < days(30), "Course duration must be at least 30 days"),
            (end - start > days(5 * 365), "Course duration cannot exceed 5 years"),
        ),
    }


def value_types(df: DataFrame, keys: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """Notes on categories and keywords that are not text; a Spark column has one type, so it shows in the plan."""
    types = dict(df.dtypes)
    odd = [(c, what) for c, what, fits in (("category_name", "Category name", ("string",)), ("course_keywords", "Keywords", ("string", "array<string>"))) if types.get(c, "string") not in fits]
    return findings(df, [_rule(F.col(c).isNotNull(), "INFO", c, f"{what} converted from {types[c]} to string") for c, what in odd], keys)


def model_rules() -> dict[str, Column]:
    """Limits of a course's other measures; null where the value is fine."""
    minutes, score, level, age = (F.col(c) for c in ("duration_mins", "quality_score", "activity_level", "course_age_days"))
    return {
        "duration_mins": _first((minutes < 0, "Duration cannot be negative"), (minutes > 60 * 1000, "Duration exceeds reasonable limit (1000 hours)")),
        "quality_score": _first(((score < 0) | (score > 1), "Quality score must be between 0 and 1")),
        "activity_level": _first((~level.isin("none", "low", "medium", "high"), "Activity level must be one of: none, low, medium, high")),
        "course_age_days": _first((age < 0, "Course age cannot be negative"), (age > 5 * 365, "Course age exceeds reasonable limit (5 years)")),
    }


def check_model(df: DataFrame, keys: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """One row per measure outside its limits; rules of absent columns are skipped."""
    return findings(df, [_rule(c.isNotNull(), "ERROR", f, c) for f, c in model_rules().items() if f in df.columns], keys)


def validation_totals(df: DataFrame, found: DataFrame, key: str = "row_no") -> DataFrame:
    """Rows in all, rows without an error, rows with one, and warnings and errors in all."""
    per = found.groupBy(F.col(key).alias("__key")).agg(F.count_if(F.col("severity") == "WARNING").alias("w"), F.count_if(F.col("severity") == "ERROR").alias("e"))
    d = df.select(key).join(per, F.col(key) == F.col("__key"), "left")
    bad = F.coalesce(F.col("e"), F.lit(0)) > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return d.agg(F.count("*").alias("total"), F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"), total("w")("warnings"), total("e")("errors"))


def result_counts(results: DataFrame) -> DataFrame:
    """Errors of results that are not valid and warnings of all, from rows with ``is_valid`` and arrays ``errors`` and ``warnings``."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return results.agg(total(F.when(~F.col("is_valid"), F.greatest(n("errors"), F.lit(0)))).alias("errors"), total(F.greatest(n("warnings"), F.lit(0))).alias("warnings"))


def check_strictly(df: DataFrame, as_of: str, keys: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """One row per field that fails its rules; rules of absent columns are skipped."""
    rules = {f: c for f, c in strict_rules(as_of).items() if f in df.columns}
    return findings(df, [_rule(c.isNotNull(), "ERROR", f, c) for f, c in rules.items()], keys)


def summarize(found: DataFrame) -> DataFrame:
    """Per field: findings, warnings, errors, distinct messages."""
    return found.groupBy(F.coalesce("field", F.lit("general")).alias("field")).agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.countDistinct("message").alias("messages"),
    )


def check_merge_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per key: nulls, and rows beyond the distinct values."""
    one = df.agg(F.count("*").alias("n"), *[x for k in keys for x in (F.count_if(F.col(k).isNull()).alias(f"{k}_nulls"), F.countDistinct(k).alias(f"{k}_distinct"))])
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"{k}_nulls").alias("nulls"), (F.col("n") - F.col(f"{k}_distinct")).alias("repeats")) for k in keys])
    return one.select(F.explode(rows).alias("x")).select("x.*")
