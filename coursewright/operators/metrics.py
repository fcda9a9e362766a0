"""Counts, distributions and quality scores, each from one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright import config
from coursewright.functions.dates import difference, is_active
from coursewright.functions.numbers import activity_level, clamp01, quality_bin


def filled(c: str) -> Column:
    """Neither null nor, for texts, blank."""
    return F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))


def to_rows(one: DataFrame, rows: list[tuple[str, ...]], names: tuple[str, ...]) -> DataFrame:
    """Turn a one-row frame into rows; each entry gives a label and columns of that frame."""
    items = [F.struct(F.lit(r[0]).alias(names[0]), *[F.col(c).alias(n) for c, n in zip(r[1:], names[1:])]) for r in rows]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, present, missing, pct`` of columns; blanks count as missing."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(filled(c)).alias(c) for c in columns])
    one = one.select(*columns, *[(F.col("n") - F.col(c)).alias(f"{c}__missing") for c in columns], *[F.round(F.try_divide(F.col(c) * 100.0, "n"), 4).alias(f"{c}__pct") for c in columns])
    return to_rows(one, [(c, c, f"{c}__missing", f"{c}__pct") for c in columns], ("field", "present", "missing", "pct"))


def group_completeness(df: DataFrame) -> DataFrame:
    """Mean completeness of each field group, over the columns present."""
    groups = {g: [c for c in cs if c in df.columns] for g, cs in config.FIELD_GROUPS.items()}
    share = lambda cs: F.round(F.avg(sum((filled(c).cast("double") for c in cs), F.lit(0.0)) * (100.0 / len(cs))), 4)
    one = df.agg(*[share(cs).alias(g) for g, cs in groups.items() if cs])
    return to_rows(one, [(g, g) for g, cs in groups.items() if cs], ("field_group", "pct"))


def catalog_totals(df: DataFrame, as_of: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("courses"),
        F.count_if(is_active(F.col("course_discontinued_from"), as_of)).alias("active"),
        F.sum("learner_count").alias("learners"),
        F.countDistinct("region_entity").alias("regions"),
        F.countDistinct("data_source").alias("sources"),
        F.count_if(F.col("cross_reference_count") > 1).alias("cross_referenced"),
        F.countDistinct("course_type").alias("types"),
        F.countDistinct("category_name").alias("categories"),
    )


def quality_metrics(df: DataFrame) -> DataFrame:
    """Completeness, metadata, content and overall score of the whole catalog."""
    share = lambda cs: sum((F.avg(filled(c).cast("double")) for c in cs), F.lit(0.0)) / len(cs)
    one = df.agg(
        share(config.SCORED_FIELDS).alias("c"),
        share(config.METADATA_FIELDS).alias("m"),
        F.coalesce(F.least(F.avg(F.length("course_description")) / 500, F.lit(1.0)), F.lit(0.7)).alias("k"),
    )
    return one.select(
        F.round("c", 6).alias("completeness_score"),
        F.round("m", 6).alias("metadata_score"),
        F.round("k", 6).alias("content_score"),
        F.round(0.4 * F.col("c") + 0.3 * F.col("m") + 0.3 * F.col("k"), 6).alias("quality_score"),
    )


def improvement_areas(quality: DataFrame) -> DataFrame:
    """The scores below their thresholds."""
    rows = to_rows(quality, [(k, f"{k}_score") for k in config.QUALITY_THRESHOLDS], ("area", "score"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in config.QUALITY_THRESHOLDS.items() for x in kv]), F.col("area"))
    return rows.withColumn("threshold", limit).where("score < threshold")


def quality_score(df: DataFrame) -> DataFrame:
    """Each row's score: 0.4 completeness, 0.3 cross references, 0.3 valid dates."""
    complete = sum((filled(c).cast("double") for c in config.SCORED_FIELDS), F.lit(0.0)) / len(config.SCORED_FIELDS)
    cross = F.coalesce(clamp01((F.col("cross_reference_count") - 1) / 3.0), F.lit(1.0))
    flags = [c for c in df.columns if c.endswith("_is_valid")]
    valid = sum((F.col(c).cast("double") for c in flags), F.lit(0.0)) / len(flags) if flags else F.lit(1.0)
    return df.withColumn("quality_score", F.round(0.4 * complete + 0.3 * cross + 0.3 * valid, 6))


def activity_metrics(df: DataFrame, as_of: str) -> DataFrame:
    rate = clamp01(F.avg(F.when(F.col("learner_count") > 0, F.col("total_2024_activity") / F.col("learner_count"))))
    return df.agg(
        F.count_if(is_active(F.col("course_discontinued_from"), as_of)).alias("active_courses"),
        F.sum("total_2024_activity").alias("total_activity"),
        F.round(rate, 6).alias("avg_completion_rate"),
        F.max("course_available_from").alias("last_activity_date"),
    )


def monthly_trend(df: DataFrame, date: str = "course_available_from", value: str = "total_2024_activity") -> DataFrame:
    """``month, total``; rows without a date are dropped."""
    return df.where(F.col(date).isNotNull()).groupBy(F.date_format(F.col(date).cast("timestamp"), "yyyy-MM").alias("month")).agg(F.sum(value).alias("total"))


def distribution(df: DataFrame, column: Column | str, name: str, weight: str | None = None) -> DataFrame:
    """Rows (or a summed column) by value; null is Unknown."""
    c = F.col(column) if isinstance(column, str) else column
    how = F.sum(weight) if weight else F.count("*")
    return df.groupBy(F.coalesce(c.cast("string"), F.lit("Unknown")).alias(name)).agg(how.cast("bigint").alias("n"))


def level_distribution(df: DataFrame) -> DataFrame:
    return distribution(df, activity_level(F.col("total_2024_activity")), "activity_level")


def quality_bins(scored: DataFrame) -> DataFrame:
    return scored.groupBy(quality_bin(F.col("quality_score")).alias("bin")).agg(F.count("*").alias("n"))


def quality_statistics(scored: DataFrame) -> DataFrame:
    q = F.col("quality_score")
    return scored.agg(
        F.round(F.avg(q), 6).alias("mean"), F.round(F.median(q), 6).alias("median"), F.count_if(q >= 0.8).alias("high"), F.count_if(q < 0.4).alias("low"), F.round(F.avg((q >= 0.8).cast("double")) * 100, 4).alias("high_pct")
    )


def cross_references(df: DataFrame) -> DataFrame:
    x = F.col("cross_reference_count")
    return df.agg(F.count_if(x == 1).alias("single"), F.count_if(x > 1).alias("multiple"), F.round(F.avg((x > 1).cast("double")) * 100, 4).alias("multiple_pct"))


def issues(df: DataFrame) -> DataFrame:
    """``issue, n, pct`` of what is wrong, without what is not."""
    found = {f"Missing {c}": ~filled(c) for c in config.REQUIRED_FIELDS if c in df.columns}
    found |= {f"Invalid {c[:-9]}": ~F.col(c) for c in df.columns if c.endswith("_is_valid")}
    if "cross_reference_count" in df.columns:
        found["No cross-references"] = F.coalesce(F.col("cross_reference_count"), F.lit(0)) <= 1
    one = df.agg(*[F.count_if(x).alias(f"n{k}") for k, x in enumerate(found.values())], *[F.round(F.avg(x.cast("double")) * 100, 4).alias(f"p{k}") for k, x in enumerate(found.values())])
    return to_rows(one, [(i, f"n{k}", f"p{k}") for k, i in enumerate(found)], ("issue", "n", "pct")).where("n > 0")


def missing_fields(df: DataFrame, critical: float = 20.0) -> DataFrame:
    c = completeness(df, [f for f in config.REQUIRED_FIELDS if f in df.columns])
    return c.select("field", "missing", F.round(100 - F.col("pct"), 4).alias("missing_pct"), (F.col("pct") < 100 - critical).alias("critical"))


def age_bands(df: DataFrame, as_of: str, date: str = "course_available_from") -> DataFrame:
    days = difference(F.col(date), F.lit(as_of).cast("timestamp_ntz"))
    band = F.when(days < 365, "1_year").when(days < 730, "2_years").when(days < 1095, "3_years").when(days.isNotNull(), "older").otherwise("unknown")
    return df.groupBy(band.alias("age")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: tuple[str, ...], n: int = 10) -> DataFrame:
    """The ``n`` most frequent values of each column; ties in the order of the values."""
    from pyspark.sql import Window

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def by_group(df: DataFrame, group: str, **measures: Column) -> DataFrame:
    return df.groupBy(group).agg(*[c.alias(n) for n, c in measures.items()])


def date_validity(df: DataFrame) -> DataFrame:
    """``column, valid, invalid, pct`` of each column with an ``_is_valid`` flag beside it; a null flag is invalid."""
    names = [c[: -len("_is_valid")] for c in df.columns if c.endswith("_is_valid") and c[: -len("_is_valid")] in df.columns]
    ok = lambda c: F.coalesce(F.col(f"{c}_is_valid"), F.lit(False))
    one = df.agg(*[x for c in names for x in (F.count_if(ok(c)).alias(f"{c}__v"), F.count_if(~ok(c)).alias(f"{c}__i"), F.round(F.avg(ok(c).cast("double")) * 100, 1).alias(f"{c}__p"))])
    return to_rows(one, [(c, f"{c}__v", f"{c}__i", f"{c}__p") for c in names], ("column", "valid", "invalid", "pct"))


def documented_score(df: DataFrame) -> DataFrame:
    """Add ``documented_score``: 0.4 for required fields, 0.3 for valid dates, 0.3 for metadata, each by its share."""
    share = lambda cs: sum((c.cast("double") for c in cs), F.lit(0.0)) / len(cs)
    dates = [F.coalesce(F.col(f"{c}_is_valid"), F.lit(False)) for c in config.DATE_COLUMNS]
    parts = (0.4, [filled(c) for c in config.REQUIRED_FIELDS]), (0.3, dates), (0.3, [filled(c) for c in ("course_keywords", "course_version")])
    return df.withColumn("documented_score", F.round(sum((w * share(cs) for w, cs in parts), F.lit(0.0)), 6))


def focus(df: DataFrame, columns: tuple[str, ...] = ("person_type", "course_type")) -> DataFrame:
    """``field, value, n, pct`` of audiences and course types; null is Unknown."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("value")) for c in columns])).alias("x")).select("x.*")
    total = df.agg(F.count("*").alias("total"))
    return long.groupBy("field", "value").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("field", "value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct"))


def kpis(df: DataFrame, as_of: str) -> DataFrame:
    """The numbers at the head of the dashboard, as one row."""
    words = df.where("course_keywords is not null").select(F.explode(F.split("course_keywords", ",")).alias("k")).select(F.lower(F.trim("k")).alias("k")).where("k <> ''")
    one = df.agg(
        F.countDistinct("course_no").alias("courses"),
        F.count_if(F.col("cross_reference_count") > 1).alias("multi_source"),
        F.countDistinct("data_source").alias("sources"),
        F.countDistinct("region_entity").alias("regions"),
        F.countDistinct("course_type").alias("types"),
        F.sum("learner_count").alias("learners"),
        F.countDistinct("person_type").alias("audiences"),
        F.countDistinct("category_name").alias("categories"),
        F.countDistinct("course_created_by").alias("authors"),
        F.count_if(is_active(F.col("course_discontinued_from"), as_of)).alias("active"),
    )
    return one.join(F.broadcast(words.agg(F.countDistinct("k").alias("keywords"))))


def size_bands(df: DataFrame, column: str = "learner_count", bounds: tuple[int, ...] = (0, 10, 50, 100, 500)) -> DataFrame:
    """Rows by band of a count: up to each bound, and above the last."""
    c, band = F.col(column), None
    for low, b in zip((None, *bounds), bounds):
        label = f"<= {b}" if low is None else f"{low + 1}-{b}"
        band = F.when(c <= b, label) if band is None else band.when(c <= b, label)
    return df.groupBy(band.when(c > bounds[-1], f"> {bounds[-1]}").otherwise("unknown").alias("band")).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``field, distinct_values`` of each column: pairs of a column and a value are made distinct before they are counted."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    long = df.select(F.explode(pairs).alias("x")).select("x.*").distinct()
    return long.groupBy("field").agg(F.count("v").alias("distinct_values"))
