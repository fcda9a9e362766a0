"""Queries over the catalog view and their SQL: cleaning, validation, merging, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright import config
from coursewright.functions import dates, numbers, text
from coursewright.operators import columns, merge, metrics, recommend, validate
from coursewright.plans.fixtures import AS_OF, CATALOG, catalog

Q, SQL = {}, {}
COLUMNS = ("course_title", "course_description", "category_name", "region_entity", "course_keywords", "course_available_from")
WITH = f"with {CATALOG}"
TS = f"timestamp '{AS_OF}'"


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def some(c: str) -> str:
    return f"coalesce(trim(cast({c} as varchar)) <> '', false)"


BARE = "regexp_replace(upper(trim(coalesce(course_no, ''))), '[^A-Z0-9]', '', 'g')"
STD = "case " + " ".join(f"when regexp_extract({BARE}, '[0-9]+') <> '' and starts_with({BARE}, '{p}') then '{p}' || regexp_extract({BARE}, '[0-9]+')" for p in ("COMP", "IT", "HR", "FIN", "MKT", "MGMT", "BUS", "TECH", "ENG", "SCI")) + f" else {BARE} end"
CLEAN = r"trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
LATEST = f"{WITH}, latest as (select *, row_number() over (partition by {{k}} order by course_available_from desc nulls last, row_no) as rn from (select *, {STD} as std, regexp_extract({BARE}, '[0-9]+') as num from catalog))"
QSCORE = f"""round(0.4 * ({" + ".join(f"cast({some(c)} as int)" for c in ("course_title", "course_description", "category_name", "region_entity"))}) / 4.0
  + 0.3 * least(greatest((cross_reference_count - 1) / 3.0, 0.0), 1.0) + 0.3, 6)"""


@query(
    "monthly_trend",
    LATEST.format(k="std") + " select strftime(course_available_from, '%Y-%m') as month, cast(sum(total_2024_activity) as bigint) as total from latest where rn = 1 and course_available_from is not null group by 1",
)
def monthly_trend(spark, sf):
    """Standard numbers, latest row of each, activity by month of availability."""
    d = catalog(spark, sf).withColumn("std", text.standard_course_no(F.col("course_no")))
    return metrics.monthly_trend(merge.dedupe_latest(d, "std"))


@query("std_course_number", f"{WITH} select row_no, {STD} as std, regexp_extract({BARE}, '[0-9]+') as numeric_id from catalog")
def std_course_number(spark, sf):
    n = F.col("course_no")
    return catalog(spark, sf).select("row_no", text.standard_course_no(n).alias("std"), text.numeric_course_id(n).alias("numeric_id"))


@query("clean_course_no", f"{WITH} select row_no, regexp_replace(regexp_replace(trim(course_no), '[:, ]', '_', 'g'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g') as course_no from catalog")
def clean_course_no(spark, sf):
    return catalog(spark, sf).select("row_no", text.clean_course_no(F.col("course_no")).alias("course_no"))


@query("dedupe_latest", LATEST.format(k="course_no") + " select row_no, course_no, course_available_from from latest where rn = 1")
def dedupe_latest(spark, sf):
    return merge.dedupe_latest(catalog(spark, sf)).select("row_no", "course_no", "course_available_from")


@query("duplicate_report", f"{WITH} select row_no, course_no, copies from (select row_no, course_no, count(*) over (partition by course_no) as copies from catalog) where copies > 1")
def duplicate_report(spark, sf):
    return merge.duplicate_rows(catalog(spark, sf)).select("row_no", "course_no", "copies")


@query(
    "duplicate_summary",
    f'{WITH} select cast(sum(n) as bigint) as "rows", cast(sum(n - 1) as bigint) as removed, count(*) filter (where n > 1 and course_no is not null) as groups from (select course_no, count(*) as n from catalog group by course_no)',
)
def duplicate_summary(spark, sf):
    return merge.duplicate_summary(catalog(spark, sf))


@query(
    "merge_longest",
    f"""{WITH} select regexp_extract({BARE}, '[0-9]+') as key, count(*) as copies, arg_max(course_title, (length(course_title), reverse(course_title))) as course_title,
    arg_max(course_description, (length(course_description), reverse(course_description))) as course_description from catalog group by 1""",
)
def merge_longest(spark, sf):
    return merge.merge_longest(catalog(spark, sf), text.numeric_course_id(F.col("course_no")))


_KEY = lambda c: f"nullif(regexp_replace(trim({c}), '^[A-Za-z]+[-: ]', ''), '')"


@query(
    "composite_keys",
    f"""{WITH}, d as (select * replace (case when row_no % 3 = 0 then course_no when row_no % 3 = 1 then ' ' end as course_no), case when row_no % 6 = 1 then 'TPL-' || course_no when row_no % 6 = 4 then 'tpl:' end as template from catalog)
    select row_no, coalesce({_KEY('course_no')}, {_KEY('template')}, concat_ws('|', {CLEAN.format('course_title')}, left({CLEAN.format('course_description')}, 50), {CLEAN.format('category_name')},
      cast(cast(round(duration_mins / 30) * 30 as bigint) as varchar))) as key from d""",
)
def composite_keys(spark, sf):
    """A third of the rows has a number; of the others some have the number of a template, the rest title, description, category and duration."""
    d = catalog(spark, sf).select("row_no", "course_no", "course_title", "course_description", "category_name", "duration_mins")
    part = F.col("row_no") % 6
    template = F.when(part == 1, F.concat(F.lit("TPL-"), "course_no")).when(part == 4, F.lit("tpl:"))
    d = d.withColumn("offering_template_no", template).withColumn("course_no", F.when(F.col("row_no") % 3 == 0, F.col("course_no")).when(F.col("row_no") % 3 == 1, F.lit(" ")))
    return d.select("row_no", merge.composite_key(d).alias("key"))


FIRST = lambda c: f"arg_min({c}, row_no) filter (where {c} is not null) as {c}"


@query(
    "merge_by_key",
    f"""{WITH} select regexp_extract({BARE}, '[0-9]+') as course_no, cast(sum(total_2024_activity) as bigint) as total_2024_activity, cast(sum(learner_count) as bigint) as learner_count,
    avg(duration_mins) as duration_mins, {FIRST('course_title')}, max(course_available_from) as course_available_from,
    string_agg(distinct trim(region_entity), ' | ' order by trim(region_entity)) as region_entity, string_agg(distinct data_source, ' | ' order by data_source) as data_source,
    count(distinct data_source) as data_sources_count from catalog group by 1""",
)
def merge_by_key(spark, sf):
    d = catalog(spark, sf).withColumn("course_no", text.numeric_course_id(F.col("course_no"))).withColumn("source_rank", F.lit(0))
    return merge.merge_sources(d.select("course_no", "total_2024_activity", "learner_count", "duration_mins", "course_title", "course_available_from", "region_entity", "data_source", "source_rank", "row_no"))


@query(
    "source_count_dist",
    f"""{WITH}, m as (select regexp_extract({BARE}, '[0-9]+') as k, count(distinct data_source) as data_sources_count from catalog group by 1)
    select data_sources_count, count(*) as courses, round(count(*) * 100.0 / (select count(*) from m), 4) as pct from m group by 1""",
)
def source_count_dist(spark, sf):
    d = catalog(spark, sf).groupBy(text.numeric_course_id(F.col("course_no")).alias("k")).agg(F.countDistinct("data_source").alias("data_sources_count"))
    return merge.source_counts(d)


@query(
    "rule_aggregation",
    f"""{WITH} select category_name, cast(sum(learner_count) as bigint) as learner_count, round(avg(duration_mins), 6) as duration_mins, max(course_available_from) as course_available_from,
    string_agg(distinct course_type, ' | ' order by course_type) as course_type, arg_min(course_title, row_no) filter (where course_title is not null) as course_title from catalog where category_name is not null group by 1""",
)
def rule_aggregation(spark, sf):
    d = catalog(spark, sf).where("category_name is not null")
    rules = {"learner_count": "sum", "duration_mins": "mean", "course_available_from": "max", "course_type": "concatenate", "course_title": "first"}
    return merge.aggregate_by_rules(d, "category_name", rules, "row_no").withColumn("duration_mins", F.round("duration_mins", 6))


@query(
    "value_sources",
    f"""{WITH} select k as num, "column", string_agg(distinct data_source, ' | ' order by data_source) as sources from (
    select regexp_extract({BARE}, '[0-9]+') as k, data_source, unnest([case when course_title is not null then 'course_title' end, case when category_name is not null then 'category_name' end]) as "column" from catalog)
    where "column" is not null group by 1, 2""",
)
def value_sources(spark, sf):
    d = catalog(spark, sf).withColumn("num", text.numeric_course_id(F.col("course_no")))
    return merge.value_sources(d, "num", ("course_title", "category_name"))


@query("completeness", f"{WITH} " + " union all ".join(f"select '{c}' as field, count(*) filter (where {some(c)}) as present, count(*) filter (where not {some(c)}) as missing, round(count(*) filter (where {some(c)}) * 100.0 / count(*), 4) as pct from catalog" for c in COLUMNS))
def completeness(spark, sf):
    return metrics.completeness(catalog(spark, sf), list(COLUMNS))


@query("fill_ratios", f"{WITH} " + " union all ".join(f"select '{c}' as \"column\", count({c}) as present, count(*) - count({c}) as missing, round(count({c}) * 100.0 / count(*), 4) as pct from catalog" for c in ("course_title", "category_name")))
def fill_ratios(spark, sf):
    return columns.fill_ratios(catalog(spark, sf).select("course_title", "category_name"))


def _group(name: str, cs: tuple[str, ...]) -> str:
    return f"select '{name}' as field_group, round(avg((" + " + ".join(f"cast({some(c)} as int)" for c in cs) + f") * 100.0 / {len(cs)}), 4) as pct from catalog"


@query("group_completeness", f"{WITH} " + " union all ".join(_group(g, cs) for g, cs in __import__("coursewright.config", fromlist=["x"]).FIELD_GROUPS.items()))
def group_completeness(spark, sf):
    return metrics.group_completeness(catalog(spark, sf))


@query(
    "catalog_totals",
    f"""{WITH} select count(*) as courses, count(*) filter (where course_discontinued_from is null or course_discontinued_from > {TS}) as active, cast(sum(learner_count) as bigint) as learners,
    count(distinct region_entity) as regions, count(distinct data_source) as sources, count(*) filter (where cross_reference_count > 1) as cross_referenced,
    count(distinct course_type) as types, count(distinct category_name) as categories from catalog""",
)
def catalog_totals(spark, sf):
    return metrics.catalog_totals(catalog(spark, sf), AS_OF)


def _mean(cs: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"avg(cast({some(c)} as int))" for c in cs) + f") / {len(cs)}"


QUALITY = f"""q as (select {_mean(("course_title", "course_description", "category_name", "region_entity"))} as c, {_mean(("course_available_from", "course_type", "course_keywords"))} as m,
    coalesce(least(avg(length(course_description)) / 500, 1.0), 0.7) as k from catalog),
    quality as (select round(c, 6) as completeness_score, round(m, 6) as metadata_score, round(k, 6) as content_score, round(0.4 * c + 0.3 * m + 0.3 * k, 6) as quality_score from q)"""


@query("quality_metrics", f"{WITH}, {QUALITY} select * from quality")
def quality_metrics(spark, sf):
    return metrics.quality_metrics(catalog(spark, sf))


@query(
    "improvement_areas",
    f"""{WITH}, {QUALITY} select * from (select 'completeness' as area, completeness_score as score, 0.8::double as threshold from quality union all select 'metadata', metadata_score, 0.7::double from quality
    union all select 'content', content_score, 0.7::double from quality) where score < threshold""",
)
def improvement_areas(spark, sf):
    return metrics.improvement_areas(metrics.quality_metrics(catalog(spark, sf)))


@query("quality_score_rows", f"{WITH} select row_no, {QSCORE} as quality_score from catalog")
def quality_score_rows(spark, sf):
    return metrics.quality_score(catalog(spark, sf)).select("row_no", "quality_score")


BIN = "case when quality_score <= 0.2 then 'Very Poor' when quality_score <= 0.4 then 'Poor' when quality_score <= 0.6 then 'Fair' when quality_score <= 0.8 then 'Good' when quality_score <= 1 then 'Excellent' end"
SCORED = f"{WITH}, scored as (select *, {QSCORE} as quality_score from catalog)"


@query("quality_bins", f"{SCORED} select {BIN} as bin, count(*) as n from scored group by 1")
def quality_bins(spark, sf):
    return metrics.quality_bins(metrics.quality_score(catalog(spark, sf)))


@query(
    "quality_statistics",
    f"""{SCORED} select round(avg(quality_score), 6) as mean, round(median(quality_score), 6) as median, count(*) filter (where quality_score >= 0.8) as high,
    count(*) filter (where quality_score < 0.4) as low, round(avg(cast(quality_score >= 0.8 as int)) * 100, 4) as high_pct from scored""",
)
def quality_statistics(spark, sf):
    return metrics.quality_statistics(metrics.quality_score(catalog(spark, sf)))


@query("low_quality", f"{SCORED} select row_no, course_title, quality_score from scored where quality_score < 0.6")
def low_quality(spark, sf):
    return metrics.quality_score(catalog(spark, sf)).where("quality_score < 0.6").select("row_no", "course_title", "quality_score")


@query(
    "activity_metrics",
    f"""{WITH} select count(*) filter (where course_discontinued_from is null or course_discontinued_from > {TS}) as active_courses, cast(sum(total_2024_activity) as bigint) as total_activity,
    round(least(greatest(avg(total_2024_activity * 1.0 / learner_count) filter (where learner_count > 0), 0.0), 1.0), 6) as avg_completion_rate, max(course_available_from) as last_activity_date from catalog""",
)
def activity_metrics(spark, sf):
    return metrics.activity_metrics(catalog(spark, sf), AS_OF)


LEVEL = "case when total_2024_activity <= 0 then 'none' when total_2024_activity <= 10 then 'low' when total_2024_activity <= 50 then 'medium' else 'high' end"


@query("activity_level_dist", f"{WITH} select {LEVEL} as activity_level, count(*) as n from catalog group by 1")
def activity_level_dist(spark, sf):
    return metrics.level_distribution(catalog(spark, sf))


@query("category_distribution", f"{WITH} select coalesce(category_name, 'Unknown') as category_name, cast(sum(learner_count) as bigint) as n from catalog group by 1")
def category_distribution(spark, sf):
    return metrics.distribution(catalog(spark, sf), "category_name", "category_name", "learner_count")


@query("region_distribution", f"{WITH} select coalesce(region_entity, 'Unknown') as region_entity, count(*) as n from catalog group by 1")
def region_distribution(spark, sf):
    return metrics.distribution(catalog(spark, sf), "region_entity", "region_entity")


@query("cross_references", f"{WITH} select count(*) filter (where cross_reference_count = 1) as single, count(*) filter (where cross_reference_count > 1) as multiple, round(avg(cast(cross_reference_count > 1 as int)) * 100, 4) as multiple_pct from catalog")
def cross_references(spark, sf):
    return metrics.cross_references(catalog(spark, sf))


@query(
    "issues_table",
    f"{WITH}, i as ("
    + " union all ".join(f"select 'Missing {c}' as issue, count(*) filter (where not {some(c)}) as n, round(avg(cast(not {some(c)} as int)) * 100, 4) as pct from catalog" for c in ("course_title", "course_description", "course_no", "category_name", "course_type", "region_entity"))
    + " union all select 'No cross-references', count(*) filter (where cross_reference_count <= 1), round(avg(cast(cross_reference_count <= 1 as int)) * 100, 4) from catalog) select * from i where n > 0",
)
def issues_table(spark, sf):
    return metrics.issues(catalog(spark, sf))


@query(
    "missing_fields",
    f"{WITH} " + " union all ".join(f"select '{c}' as field, count(*) filter (where not {some(c)}) as missing, round(100 - round(count(*) filter (where {some(c)}) * 100.0 / count(*), 4), 4) as missing_pct, round(count(*) filter (where {some(c)}) * 100.0 / count(*), 4) < 80 as critical from catalog" for c in ("course_title", "course_description", "course_no", "category_name", "course_type", "region_entity")),
)
def missing_fields(spark, sf):
    return metrics.missing_fields(catalog(spark, sf))


@query(
    "content_age",
    f"""{WITH}, a as (select floor(epoch({TS} - course_available_from) / 86400) as days from catalog)
    select case when days < 365 then '1_year' when days < 730 then '2_years' when days < 1095 then '3_years' when days is not null then 'older' else 'unknown' end as age, count(*) as n from a group by 1""",
)
def content_age(spark, sf):
    return metrics.age_bands(catalog(spark, sf), AS_OF)


@query(
    "course_status",
    f"""{WITH} select row_no, case when course_discontinued_from is null or course_discontinued_from > {TS} then 'active' else 'discontinued' end as course_status,
    cast(floor(epoch({TS} - course_available_from) / 86400) as bigint) as course_age_days, {LEVEL} as activity_level, duration_mins / 60 as course_duration_hours,
    coalesce(strftime(course_available_from, '%Y-%m-%d'), 'N/A') as shown from catalog""",
)
def course_status(spark, sf):
    return catalog(spark, sf).select(
        "row_no",
        dates.status(F.col("course_discontinued_from"), AS_OF).alias("course_status"),
        dates.difference(F.col("course_available_from"), F.lit(AS_OF).cast("timestamp_ntz")).alias("course_age_days"),
        numbers.activity_level(F.col("total_2024_activity")).alias("activity_level"),
        (F.col("duration_mins") / 60).alias("course_duration_hours"),
        dates.format_date(F.col("course_available_from")).alias("shown"),
    )


@query(
    "topk_values",
    f"""{WITH}, v as (select 'course_title' as field, course_title as value from catalog union all select 'category_name', category_name from catalog union all select 'region_entity', region_entity from catalog),
    c as (select field, value, count(*) as n from v where value is not null group by 1, 2) select field, value, n, rank from (select *, row_number() over (partition by field order by n desc, value) as rank from c) where rank <= 10""",
)
def topk_values(spark, sf):
    return metrics.top_values(catalog(spark, sf), ("course_title", "category_name", "region_entity")).withColumn("rank", F.col("rank").cast("bigint"))


@query("region_type_matrix", f"{WITH} select region_entity, course_type, count(*) as n, round(avg(duration_mins), 4) as avg_duration from catalog group by 1, 2")
def region_type_matrix(spark, sf):
    return catalog(spark, sf).groupBy("region_entity", "course_type").agg(F.count("*").alias("n"), F.round(F.avg("duration_mins"), 4).alias("avg_duration"))


VALID = [f"select row_no, 'WARNING' as severity, '{c}' as field, 'Missing required value for {c}' as message from catalog where {c} is null" for c in ("course_no", "course_title", "category_name", "course_description", "course_type", "region_entity", "course_available_from")]
VALID.append("select row_no, 'INFO', 'course_no', 'Course number contains invalid characters:  ' from catalog where contains(course_no, ' ')")
VALID.append("select row_no, 'INFO', 'course_version', 'Version should ideally be in format X.Y.Z (e.g., 1.0.0)' from catalog where course_version = 'draft'")
VALID.append("select row_no, 'INFO', 'course_available_from', 'Course available from date is recommended' from catalog where course_available_from is null")


@query("validation_rows", f"{WITH} " + " union all ".join(VALID))
def validation_rows(spark, sf):
    return validate.check_rows(catalog(spark, sf))


@query("validation_summary", f"{WITH}, f as (" + " union all ".join(VALID) + ") select field, count(*) as findings, count(*) filter (where severity = 'WARNING') as warnings, count(*) filter (where severity = 'ERROR') as errors, count(distinct message) as messages from f group by 1")
def validation_summary(spark, sf):
    return validate.summarize(validate.check_rows(catalog(spark, sf)))


@query(
    "strict_validation",
    f"""{WITH}, f as (
    select row_no, 'course_no' as field, case when not regexp_matches(course_no, '^[A-Z0-9_-]+$') then 'Course number contains invalid characters' end as message from catalog
    union all select row_no, 'course_title', case when course_title is null then 'Course title cannot be empty' end from catalog
    union all select row_no, 'category_name', case when category_name is null then 'Category name cannot be empty' when trim(category_name) = '' then 'Category name cannot contain only whitespace' end from catalog
    union all select row_no, 'course_description', case when course_description is null then 'Course description cannot be empty' when length(trim(course_description)) < 50 then 'Course description must be at least 50 characters long'
      when len(list_distinct(regexp_split_to_array(trim(course_description), '\\s+'))) < 10 then 'Course description must contain meaningful content' end from catalog
    union all select row_no, 'course_type', 'Course type must be one of: e-learning, instructor-led, blended, assessment' from catalog
    union all select row_no, 'region_entity', case when region_entity is null then 'Region/Department cannot be empty' end from catalog
    union all select row_no, 'course_version', case when not regexp_matches(course_version, '^\\d+\\.\\d+\\.\\d+$') then 'Version must be in format X.Y.Z' end from catalog
    union all select row_no, 'course_available_from', case when course_available_from is null then 'Course available from date is required'
      when course_available_from < {TS} - interval 1825 day then 'Course available from date cannot be more than 5 years in the past' end from catalog
    union all select row_no, 'course_discontinued_from', case when course_discontinued_from < course_available_from then 'Discontinued date cannot be before available date' when course_discontinued_from > {TS} then 'Discontinued date cannot be in the future'
      when course_discontinued_from - course_available_from < interval 30 day then 'Course duration must be at least 30 days' when course_discontinued_from - course_available_from > interval 1825 day then 'Course duration cannot exceed 5 years' end from catalog
    ) select row_no, 'ERROR' as severity, field, message from f where message is not null""",
)
def strict_validation(spark, sf):
    return validate.check_strictly(catalog(spark, sf), AS_OF)


@query(
    "merge_key_checks",
    f"{WITH} select 'course_no' as key, count(*) filter (where course_no is null) as nulls, count(*) - count(distinct course_no) as repeats from catalog union all select 'course_title', count(*) filter (where course_title is null), count(*) - count(distinct course_title) from catalog",
)
def merge_key_checks(spark, sf):
    return validate.check_merge_keys(catalog(spark, sf), ("course_no", "course_title"))


FORMS = ("'%Y-%m-%d'", "'%d/%m/%Y'", "'%d.%m.%Y'", "'%d %b %Y'")


@query(
    "parse_dates",
    f"""{WITH}, d as (select row_no, row_no % 15 as form, cast(course_available_from as timestamp) as x from catalog)
    select row_no, case when form = 14 then null when form in (2, 5, 8) and day(x) <= 12 then make_timestamp(year(x), day(x), month(x), 0, 0, 0.0)
      when form = 13 then x + to_seconds(row_no * 7 % 86400) else x end as parsed from d""",
)
def parse_dates(spark, sf):
    """Dates written in each of the fourteen forms, and one that is none, are read back.

    Where the first two numbers could be day and month either way, the form
    that comes first decides, so months and days of up to 12 change places.
    """
    d = F.col("course_available_from").cast("timestamp")
    d = F.when(F.col("row_no") % 15 == 13, F.timestamp_micros(F.unix_micros(d) + F.col("row_no") * 7 % 86400 * 1_000_000)).otherwise(d)
    raw = F.when(F.col("row_no") % 15 == 14, F.lit("soon"))
    for k, f in enumerate(config.DATE_FORMATS):
        raw = raw.when(F.col("row_no") % 15 == k, F.date_format(d, f))
    return catalog(spark, sf).withColumn("raw", raw).select("row_no", dates.parse_date(F.col("raw")).alias("parsed"))


@query(
    "clean_numbers",
    f"{WITH} select row_no, cast(learner_count as double) as n from catalog where row_no % 2 = 0 union all select row_no, cast(null as double) from catalog where row_no % 2 = 1",
)
def clean_numbers(spark, sf):
    raw = F.when(F.col("row_no") % 2 == 0, F.concat(F.lit("$ "), F.col("learner_count").cast("string"), F.lit(" x"))).otherwise(F.lit("n.a. - -"))
    return catalog(spark, sf).withColumn("raw", raw).select("row_no", numbers.clean_number(F.col("raw")).alias("n"))


REC_SQL = f"""{WITH}, r as (
    select row_no, course_no, 'quality' as type, 'Course description is too short (current: ' || length(course_description) || ' chars, minimum: 50 chars)' as description, 0.7 as impact, 0.3 as effort, 'high' as priority from catalog where length(course_description) < 50
    union all select row_no, course_no, 'quality', 'Course has insufficient keywords (current: ' || len(string_split(course_keywords, ',')) || ', minimum: 3)', 0.6, 0.4, 'medium' from catalog where len(string_split(course_keywords, ',')) < 3
    union all select row_no, course_no, 'activity', 'Low learner engagement (current: ' || learner_count || ', minimum: 5)', 0.8, 0.5, 'high' from catalog where learner_count < 5
    union all select row_no, course_no, 'activity', 'Low recent activity (last 90 days)', 0.7, 0.4, 'medium' from catalog where total_2024_activity < 100)
    select row_no, course_no, type, description, impact::double as impact, effort::double as effort, priority, round(impact::double / effort::double, 6) as ratio from r"""


@query("row_recommendations", REC_SQL)
def row_recommendations(spark, sf):
    return recommend.row_recommendations(catalog(spark, sf), None)


@query("top_recommendations", f"{REC_SQL} order by ratio desc, row_no, description limit 10")
def top_recommendations(spark, sf):
    return recommend.row_recommendations(catalog(spark, sf))


@query(
    "alerts",
    f"""{WITH}, {QUALITY}, a as (select max(course_available_from) as d from catalog) select 'warning' as severity, 'Low data completeness detected' as message from quality where completeness_score < 0.8
    union all select case when d < {TS} - interval 90 day then 'warning' else 'success' end, case when d < {TS} - interval 90 day then 'No recent course activity' else 'Recent course activity' end from a""",
)
def alerts(spark, sf):
    d = catalog(spark, sf)
    return recommend.alerts(metrics.quality_metrics(d), metrics.activity_metrics(d, AS_OF), AS_OF)


@query("quality_tab", f"{WITH}, {QUALITY} select * from (select case when completeness_score < 0.8 then 'completeness' end as area, 'Complete missing required fields' as advice from quality union all select case when metadata_score < 0.6 then 'metadata' end, 'Add dates, types and keywords' from quality union all select case when content_score < 0.7 then 'content' end, 'Extend course descriptions' from quality) where area is not null")
def quality_tab(spark, sf):
    return recommend.quality_tab(metrics.quality_metrics(catalog(spark, sf)))
