"""Deduplication and merging of catalog records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright import config
from coursewright.functions.text import clean_text
from coursewright.operators.metrics import distinct_counts

#: How each column of several sources becomes one.
SUM = ("total_2024_activity", "learner_count", "cross_reference_count")
MEAN = ("duration_mins", "avg_hours_per_completion")
MAX = ("course_available_from", "course_discontinued_from")
LISTED = ("region_entity", "has_direct_reports", "data_source")


def latest_first(order: tuple[str, ...]) -> list[Column]:
    return [F.desc_nulls_last("course_available_from"), *[F.asc(c) for c in order]]


def dedupe_latest(df: DataFrame, key: str = "course_no", order: tuple[str, ...] = ("row_no",), keep_null_keys: bool = False) -> DataFrame:
    """The row of each key that became available last; null keys count as one key unless kept.

    The rank is cut to the first row before the shuffle too, so a key with very
    many rows sends one row per task.
    """
    w = Window.partitionBy(key).orderBy(*latest_first(order))
    out = df.where(F.col(key).isNotNull()) if keep_null_keys else df
    best = out.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    return best.union(df.where(F.col(key).isNull())) if keep_null_keys else best


def duplicate_rows(df: DataFrame, key: str = "course_no") -> DataFrame:
    """All rows whose key occurs more than once."""
    many = df.groupBy(F.col(key).alias("__key")).count().where("count > 1").withColumnRenamed("count", "copies")
    return df.join(many, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def duplicate_summary(df: DataFrame, key: str = "course_no") -> DataFrame:
    """Rows, rows that go, and repeated keys (the null key removes rows but is no group)."""
    per = df.groupBy(key).count()
    return per.agg(F.sum("count").alias("rows"), F.sum(F.col("count") - 1).alias("removed"), F.count_if((F.col("count") > 1) & F.col(key).isNotNull()).alias("groups"))


def composite_key(df: DataFrame) -> Column:
    """The course number, else the template number, else title, start of description, category and half-hours."""
    has = lambda c, t="string": F.col(c) if c in df.columns else F.lit(None).cast(t)
    text = F.concat_ws(
        "|",
        clean_text(has("course_title")),
        F.substring(clean_text(has("course_description")), 1, 50),
        clean_text(has("category_name")),
        (F.round(has("duration_mins", "double") / 30) * 30).cast("long").cast("string"),
    )
    bare = lambda c: F.nullif(F.regexp_replace(F.trim(has(c)), r"^[A-Za-z]+[-: ]", ""), F.lit(""))
    return F.coalesce(bare("course_no"), bare("offering_template_no"), text)


def merge_longest(df: DataFrame, key: Column | str) -> DataFrame:
    """One row per key with its longest title and description; ties go to the smallest text."""
    k = F.col(key) if isinstance(key, str) else key
    longest = lambda c: F.max_by(c, F.struct(F.length(c), F.reverse(c))).alias(c)
    return df.groupBy(k.alias("key")).agg(F.count("*").alias("copies"), longest("course_title"), longest("course_description"))


def merge_sources(df: DataFrame, key: str = "course_no", order: tuple[str, ...] = ("source_rank", "row_no")) -> DataFrame:
    """One row per trimmed key from all sources, in one aggregation.

    Sums, means, latest dates and flags as listed above; regions and sources
    as sorted lists with `` | ``; other columns by their first value in source
    order. Rows without a key are dropped.
    """
    rank = F.struct(*order)
    plan = []
    for c, t in df.dtypes:
        col = F.col(c)
        if c in (key, *order):
            continue
        if c in SUM:
            plan.append(F.sum(col).alias(c))
        elif c in MEAN:
            plan.append(F.avg(col).alias(c))
        elif c in MAX or c.startswith("is_"):
            plan.append(F.max(col).alias(c))
        elif c in LISTED:
            text = F.nullif(F.trim(col.cast("string")), F.lit(""))
            plan.append(F.nullif(F.array_join(F.array_sort(F.collect_set(text)), " | "), F.lit("")).alias(c))
        else:
            plan.append(F.min_by(col, F.when(col.isNotNull(), rank)).alias(c))
    if "data_source" in df.columns:
        plan.append(F.size(F.collect_set("data_source")).cast("bigint").alias("data_sources_count"))
    k = F.trim(F.col(key).cast("string"))
    return df.where(k.isNotNull() & (k != "")).groupBy(k.alias(key)).agg(*plan)


RULES = {
    "sum": lambda c, r: F.sum(c),
    "mean": lambda c, r: F.avg(c),
    "concatenate": lambda c, r: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), " | "),
    "most_frequent": lambda c, r: F.mode(c, True),
    "most_recent": lambda c, r: F.max_by(c, r),
    "first": lambda c, r: F.min_by(c, r),
    "max": lambda c, r: F.max(c),
}


def aggregate_by_rules(df: DataFrame, key: str, rules: dict[str, str], order: str) -> DataFrame:
    """One row per key; each column by its named rule, with rows in ``order``."""
    return df.groupBy(key).agg(*[RULES[how](c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c, how in rules.items()])


def default_rule(column: str, numeric: bool) -> str:
    if numeric:
        return "sum" if any(w in column for w in ("activity", "count", "learner")) else "mean"
    return "first"


def source_counts(merged: DataFrame) -> DataFrame:
    """How many courses come from how many sources, with percentages."""
    per = merged.groupBy("data_sources_count").agg(F.count("*").alias("courses"))
    total = merged.agg(F.count("*").alias("n"))
    return per.join(F.broadcast(total)).select("data_sources_count", "courses", F.round(F.col("courses") * 100.0 / F.col("n"), 4).alias("pct"))


def value_sources(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Which sources give a key's value of each column: ``key, column, sources``."""
    held = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.select(key, "data_source", F.explode(held).alias("column")).groupBy(key, "column").agg(F.array_join(F.array_sort(F.collect_set("data_source")), " | ").alias("sources"))


def classify_source(columns: list[str]) -> tuple[str, float]:
    """What kind of file has these columns, and how sure that is."""
    has = set(columns)
    if {"course_no", "course_title"} <= has and {"course_description", "category_name"} & has:
        return "course_catalog", 0.9
    if {"total_2024_activity", "learner_count"} & has:
        return "activity", 0.8
    if {"course_available_from", "course_discontinued_from"} & has:
        return "schedule", 0.7
    return "unknown", 0.5


def merge_plan(columns: list[str]) -> dict[str, str]:
    """Aggregation rules of a file by its kind; activity files are summed."""
    kind, _ = classify_source(columns)
    return {c: "sum" if kind == "activity" and c in SUM else "mean" if c in MEAN else "first" for c in columns if c != "course_no"}


def rank_sources(sources: list[tuple[str, DataFrame]]) -> list[tuple[str, DataFrame]]:
    """Sources by the confidence of their kind, stable."""
    return sorted(sources, key=lambda s: -classify_source(s[1].columns)[1])


def required_coverage(columns: list[str]) -> float:
    return len(set(columns) & set(config.REQUIRED_COLUMNS)) / len(config.REQUIRED_COLUMNS)


def file_structure(df: DataFrame) -> DataFrame:
    """Kind of a file by its columns, coverage of the required ones, and how complete and distinct its values are."""
    kind, sure = classify_source(df.columns)
    n = F.count("*")
    complete = sum((F.count(F.col(f"`{c}`")) / n for c in df.columns), F.lit(0.0)) / len(df.columns)
    one = df.agg(n.alias("n"), F.round(complete, 6).alias("completeness"))
    values = distinct_counts(df, tuple(df.columns)).agg(F.sum("distinct_values").alias("d"))
    return one.join(F.broadcast(values)).select(
        F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), F.round(F.lit(required_coverage(df.columns)), 6).alias("coverage"), "completeness", F.round(F.try_divide("d", "n") / len(df.columns), 6).alias("distinctness")
    )


def alternative_keys(df: DataFrame) -> DataFrame:
    """Rows without a number get a key from title, type, region or place; ``key_source`` and ``key_confidence`` tell which."""
    from coursewright.functions.text import title_key

    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    number, title = blank("course_no"), title_key(blank("course_title"))
    region = F.concat_ws("_", F.lit("region"), title_key(blank("region_entity")), title_key(blank("course_type")))
    row = F.concat_ws("_", F.lit("source"), F.col("data_source"), F.col("row_no").cast("string"))
    has_region = blank("region_entity").isNotNull() & blank("course_type").isNotNull()
    return df.withColumns(
        {
            "key": F.coalesce(number, title, F.when(has_region, region), row),
            "key_source": F.when(number.isNotNull(), "course_no").when(title.isNotNull(), "course_title").when(has_region, "region_type").otherwise("row"),
            "key_confidence": F.when(number.isNotNull(), 1.0).otherwise(0.5),
        }
    )
