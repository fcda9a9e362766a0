"""Filters, column operators, fuzzy titles and the whole analysis, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.functions import dates, text
from coursewright.operators import columns, merge, metrics, titles
from coursewright.plans.analysis import analyze
from coursewright.plans.catalog_queries import TS, WITH
from coursewright.plans.fixtures import AS_OF, catalog, read

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("short_descriptions", f"{WITH} select row_no, length(course_description) as n from catalog where length(course_description) < 100")
def short_descriptions(spark, sf):
    return catalog(spark, sf).where(F.length("course_description") < 100).select("row_no", F.length("course_description").cast("bigint").alias("n"))


@query("low_activity", f"{WITH} select row_no, total_2024_activity from catalog where total_2024_activity < 10")
def low_activity(spark, sf):
    return catalog(spark, sf).where("total_2024_activity < 10").select("row_no", "total_2024_activity")


@query("recent_courses", f"{WITH} select row_no, course_available_from from catalog where course_available_from between {TS} - interval 90 day and {TS}")
def recent_courses(spark, sf):
    return catalog(spark, sf).where(dates.recent(F.col("course_available_from"), AS_OF)).select("row_no", "course_available_from")


@query("described_courses", f"{WITH} select row_no from catalog where trim(course_title) <> '' and trim(category_name) <> '' and trim(region_entity) <> ''")
def described_courses(spark, sf):
    c = catalog(spark, sf)
    return c.where(metrics.filled("course_title") & metrics.filled("category_name") & metrics.filled("region_entity")).select("row_no")


@query("large_regions", f"{WITH}, t as (select region_entity, count(*) as n from catalog where region_entity is not null group by 1 order by n desc, region_entity limit 3) select row_no, region_entity from catalog where region_entity in (select region_entity from t)")
def large_regions(spark, sf):
    c = catalog(spark, sf)
    top = c.where("region_entity is not null").groupBy("region_entity").count().orderBy(F.desc("count"), "region_entity").limit(3)
    return c.join(top, "region_entity", "left_semi").select("row_no", "region_entity")


@query("filled_categories", f"{WITH} select row_no, case when category_name is null or trim(category_name) = '' then 'Uncategorized' else trim(category_name) end as category_name from catalog")
def filled_categories(spark, sf):
    return columns.fill_category(catalog(spark, sf)).select("row_no", "category_name")


@query("filled_durations", f"{WITH}, d as (select row_no, case when row_no % 4 <> 0 then duration_mins::double end as m from catalog) select row_no, coalesce(m, (select median(m) from d)) as m from d")
def filled_durations(spark, sf):
    d = catalog(spark, sf).select("row_no", F.when(F.col("row_no") % 4 != 0, F.col("duration_mins")).alias("m"))
    return columns.fill_missing(d, {"m": "median"})


@query("aliased_columns", "select p_partkey as course_no, p_name as course_title, p_type as course_type, p_size as duration_mins from part")
def aliased_columns(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias(" Course ID "), F.col("p_name").alias("Title"), F.col("p_type").alias("Format"), F.col("p_size").alias("Dur Mins"))
    return columns.standardize(p)


@query("synthetic_keys", f"{WITH} select row_no, case when row_no % 6 = 0 then 'file_0_' || row_no else course_no end as course_no from catalog")
def synthetic_keys(spark, sf):
    c = catalog(spark, sf).select("row_no", F.when(F.col("row_no") % 6 != 0, F.col("course_no")).alias("course_no"), F.lit(0).alias("source_rank"))
    return columns.synthetic_keys(c).select("row_no", "course_no")


@query(
    "file_structure",
    f"""{WITH}, c as (select course_no, course_title, category_name, row_no from catalog) select 'course_catalog' as kind, 0.9::double as confidence, round(3 / 7.0::double, 6) as coverage,
    round((count(course_no) + count(course_title) + count(category_name) + count(row_no)) / (4.0::double * count(*)), 6) as completeness,
    round((count(distinct course_no) + count(distinct course_title) + count(distinct category_name) + count(distinct row_no)) / (4.0::double * count(*)), 6) as distinctness from c""",
)
def file_structure(spark, sf):
    return merge.file_structure(catalog(spark, sf).select("course_no", "course_title", "category_name", "row_no"))


@query(
    "fuzzy_titles",
    """with t as (select lower(trim(p_name)) as title, count(*) as n from part group by 1), p as (select a.title as title_1, b.title as title_2, a.n as n_1, b.n as n_2,
    round(jaro_winkler_similarity(a.title, b.title), 4) as similarity from t a join t b on a.title < b.title) select * from p where similarity >= 0.85""",
)
def fuzzy_titles(spark, sf):
    return titles.fuzzy_titles(read(spark, sf, "part").select(F.col("p_name").alias("title")))


@query("column_dates", f"{WITH} select row_no, case when row_no % 9 <> 0 then course_available_from end as d, row_no % 9 <> 0 and course_available_from is not null as d_is_valid from catalog")
def column_dates(spark, sf):
    raw = F.when(F.col("row_no") % 9 == 0, F.lit("unknown")).otherwise(F.date_format(F.col("course_available_from").cast("timestamp"), "yyyy/MM/dd"))
    return dates.parse_column(catalog(spark, sf).select("row_no", raw.alias("d")), "d")


@query("merge_keys_text", r"select p_partkey, regexp_replace(trim(lower(p_type || '-' || p_name)), '[^a-z0-9\s]', '', 'g') as k, regexp_replace(trim(lower(p_type || '-' || p_name)), '[^a-z0-9]+', '_', 'g') as t from part")
def merge_keys_text(spark, sf):
    c = F.concat_ws("-", "p_type", "p_name")
    return read(spark, sf, "part").select("p_partkey", text.merge_key(c).alias("k"), text.title_key(c).alias("t"))


def analysis_courses(spark, sf):
    """The whole analysis over three exports with different headers."""
    c = catalog(spark, sf)
    a = c.where("data_source = 'catalog'").select(F.col("course_no").alias("Course Number"), F.col("course_title").alias("Title"), F.col("course_description").alias("Description"), F.col("category_name").alias("Category"), "row_no", F.col("course_type").alias("Type"), F.col("region_entity").alias("Region"))
    b = c.where("data_source = 'activity'").select("course_no", F.col("learner_count").alias("Learners"), F.col("total_2024_activity").alias("Activity"), "row_no")
    d = c.where("data_source = 'schedule'").select("course_no", F.col("course_available_from").alias("Start Date"), F.col("course_discontinued_from").alias("End Date"), "row_no")
    return analyze([("catalog", a), ("activity", b), ("schedule", d)], AS_OF).courses.select("course_no", "data_source", "course_title", "region_entity", "course_status", "activity_level", "course_age_days")
