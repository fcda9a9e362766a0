"""Views that present the driver's tables as a course catalog, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-06-30"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: numbers that repeat and differ in form, gaps by modulo rules, usage from line items."""
    part, item, orders = (read(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    use = (
        item.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_partkey")
        .agg(F.countDistinct("o_custkey").alias("learners"), F.sum("l_quantity").cast("bigint").alias("quantity"), F.max("l_shipdate").alias("last_ship"), F.min("l_suppkey").alias("suppkey"))
    )
    place = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    p = F.col("p_partkey")
    n = F.when((p % 5 == 0) & (p > 0), p - 1).otherwise(p)
    d = part.join(use, p == F.col("l_partkey"), "left").join(place, F.col("suppkey") == F.col("s_suppkey"), "left").withColumn("n", n)
    k = F.when(p % 35 == 0, (F.col("n") + 1) % 4).otherwise(F.col("n") % 4)
    prefix = F.when(k == 0, "COMP").when(k == 1, "HR-").when(k == 2, "fin ").otherwise("")
    keywords = F.when(p % 7 == 0, None).when(p % 7 < 4, F.regexp_replace("p_name", " ", ",")).otherwise(F.concat(F.regexp_replace("p_name", " ", ","), F.lit(",skills")))
    return d.select(
        p.alias("row_no"),
        F.concat(prefix, F.lpad(F.col("n").cast("string"), 6, "0")).alias("course_no"),
        F.when(p % 97 != 0, F.col("p_name")).alias("course_title"),
        F.when(p % 53 == 0, None).when(p % 59 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("category_name"),
        F.when(p % 41 != 0, F.concat_ws(" ", "p_name", F.lit("course:"), F.repeat(F.concat("p_name", F.lit(", "), "p_type", F.lit(". ")), (p % 7).cast("int")))).alias("course_description"),
        F.col("p_type").alias("course_type"),
        F.col("n_name").alias("region_entity"),
        F.coalesce("learners", F.lit(0)).alias("learner_count"),
        F.greatest(F.coalesce("quantity", F.lit(0)) % 80 - 5, F.lit(0)).cast("bigint").alias("total_2024_activity"),
        F.when(p % 31 != 0, (F.date_add(F.lit("1996-01-01").cast("date"), (p % 1800).cast("int"))).cast("timestamp_ntz")).alias("course_available_from"),
        F.when(p % 3 != 0, F.col("last_ship")).alias("course_discontinued_from"),
        keywords.alias("course_keywords"),
        F.when(p % 11 == 0, F.lit("draft")).when(p % 2 == 0, F.concat(F.lit("1."), (p % 5).cast("string"))).otherwise(F.concat(F.lit("2."), (p % 5).cast("string"), F.lit(".0"))).alias("course_version"),
        (1 + p % 4).alias("cross_reference_count"),
        F.element_at(F.array(F.lit("catalog"), F.lit("activity"), F.lit("schedule")), (p % 3 + 1).cast("int")).alias("data_source"),
        (F.col("p_size") * 10.0).alias("duration_mins"),
    )


CATALOG = """
use as (
  select l_partkey, count(distinct o_custkey) as learners, cast(sum(l_quantity) as bigint) as quantity, max(l_shipdate) as last_ship, min(l_suppkey) as suppkey
  from lineitem join orders on l_orderkey = o_orderkey group by l_partkey
), numbered as (
  select *, case when p_partkey % 5 = 0 and p_partkey > 0 then p_partkey - 1 else p_partkey end as n
  from part left join use on p_partkey = l_partkey
       left join (select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey) on suppkey = s_suppkey
), catalog as (
  select p_partkey as row_no,
    (case case when p_partkey % 35 = 0 then (n + 1) % 4 else n % 4 end when 0 then 'COMP' when 1 then 'HR-' when 2 then 'fin ' else '' end) || lpad(cast(n as varchar), 6, '0') as course_no,
    case when p_partkey % 97 <> 0 then p_name end as course_title,
    case when p_partkey % 53 = 0 then null when p_partkey % 59 = 0 then ' ' else p_brand end as category_name,
    case when p_partkey % 41 <> 0 then p_name || ' course: ' || repeat(p_name || ', ' || p_type || '. ', cast(p_partkey % 7 as int)) end as course_description,
    p_type as course_type, n_name as region_entity, coalesce(learners, 0) as learner_count,
    cast(greatest(coalesce(quantity, 0) % 80 - 5, 0) as bigint) as total_2024_activity,
    case when p_partkey % 31 <> 0 then cast(date '1996-01-01' + cast(p_partkey % 1800 as int) as timestamp) end as course_available_from,
    case when p_partkey % 3 <> 0 then last_ship end as course_discontinued_from,
    case when p_partkey % 7 = 0 then null when p_partkey % 7 < 4 then replace(p_name, ' ', ',') else replace(p_name, ' ', ',') || ',skills' end as course_keywords,
    case when p_partkey % 11 = 0 then 'draft' when p_partkey % 2 = 0 then '1.' || cast(p_partkey % 5 as varchar) else '2.' || cast(p_partkey % 5 as varchar) || '.0' end as course_version,
    1 + p_partkey % 4 as cross_reference_count,
    case p_partkey % 3 when 0 then 'catalog' when 1 then 'activity' else 'schedule' end as data_source,
    p_size * 10.0 as duration_mins
  from numbered
)
"""


def courses_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as courses: title (first eight words), text, department, category, activity."""
    d = read(spark, sf_dir, "documents")
    title = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    return d.select(F.col("doc_id").alias("id"), title.alias("title"), "text", F.col("source").alias("dept"), F.col("lang").alias("category"), (F.col("n_chars") % 120).alias("activity"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("category"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: completions, hours, first day, and attributes by modulo rules."""
    e = read(spark, sf_dir, "events")
    u = e.groupBy("user_id").agg(F.count("*").alias("completion_count"), F.round(F.sum("value"), 4).alias("training_hours"), F.min("ts").alias("available_from"), F.min("event_type").alias("delivery_method"))
    k = F.col("user_id")
    pick = lambda m, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % m + 1).cast("int"))
    return u.select(
        "*",
        pick(3, "leaders", "employees", "managers").alias("persona_type"),
        pick(5, "Leadership", "Compliance", "Technology", "Clinical Skills", "Safety").alias("interest_area"),
        pick(2, "self_assigned", "assigned").alias("assignment_type"),
        pick(4, "in_house", "custom_vendor", "url_internal", "off_the_shelf").alias("content_source"),
        (k % 60 + 1).alias("duration_minutes"),
    )


USAGE = """
usage as (
  select user_id, count(*) as completion_count, round(sum(value), 4) as training_hours, min(ts) as available_from, min(event_type) as delivery_method,
    case user_id % 3 when 0 then 'leaders' when 1 then 'employees' else 'managers' end as persona_type,
    case user_id % 5 when 0 then 'Leadership' when 1 then 'Compliance' when 2 then 'Technology' when 3 then 'Clinical Skills' else 'Safety' end as interest_area,
    case user_id % 2 when 0 then 'self_assigned' else 'assigned' end as assignment_type,
    case user_id % 4 when 0 then 'in_house' when 1 then 'custom_vendor' when 2 then 'url_internal' else 'off_the_shelf' end as content_source,
    user_id % 60 + 1 as duration_minutes
  from events group by user_id
)
"""
