"""Queries over reports, validators and clusters that need longer SQL, and that SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright import config
from coursewright.functions import dates, text
from coursewright.operators import charts, columns, metrics, profile, quantiles, recommend, repair, similarity, titles, validate, usage as use
from coursewright.plans import catalog_queries as cat, text_queries as tex
from coursewright.plans.catalog_queries import QUALITY, TS, WITH, some
from coursewright.plans.fixtures import AS_OF, CATALOG, catalog, courses_text, embeddings, read, usage
from coursewright.plans.text_queries import CATS, EMB, REPS, TFIDF, TOKENS, USE

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# Dates

LATE = f"({TS} + interval 10 year)"
OK = lambda c: f"coalesce({c} between timestamp '1990-01-01' and {LATE}, false)"
MIDDLE = lambda c, ok: f"make_timestamp(cast(trunc(median(epoch_us({c})) filter (where {ok})) as bigint))"
REPAIRED = f"""{WITH}, a as (select row_no, left(course_no, 4) as prefix, data_source, cast(course_available_from as timestamp) as s, cast(course_discontinued_from as timestamp) as e from catalog),
  b as (select *, {OK('s')} as so, {OK('e')} and not coalesce({OK('s')} and e < s, false) as eo from a),
  c as (select *, coalesce(case when so then s end, case when eo then e end) as v from b),
  d as (select * replace (case when so then s else coalesce(v, s) end as s, so or v is not null as so), v is not null as vo from c),
  f as (select * replace (case when eo then e else coalesce(v, case when so then s end, e) end as e, eo or v is not null or so as eo) from d),
  m as (select prefix, {MIDDLE('v', 'vo')} as mv, {MIDDLE('s', 'so')} as ms, {MIDDLE('e', 'eo')} as me from f group by 1),
  g as (select f.* replace (case when vo then v else coalesce(mv, v) end as v, case when so then s else coalesce(ms, s) end as s, case when eo then e else coalesce(me, e) end as e,
    vo or mv is not null as vo, so or ms is not null as so, eo or me is not null as eo) from f left join m on f.prefix = m.prefix),
  n as (select data_source, {MIDDLE('s', 'so')} as ms from g group by 1),
  h as (select g.* replace (case when so then s else coalesce(ms, timestamp '2000-01-01') end as s, case when eo then e else {LATE} end as e, true as eo) from g left join n on g.data_source = n.data_source),
  repaired as (select row_no, v as course_version, vo as course_version_is_valid, s as course_available_from, so as course_available_from_is_valid,
    case when e < s then s + interval 1 year else e end as course_discontinued_from, eo as course_discontinued_from_is_valid from h)"""


def _repaired(spark, sf):
    return repair.repair_dates(catalog(spark, sf), AS_OF)


@query("date_repair", f"{REPAIRED} select * from repaired")
def date_repair(spark, sf):
    return _repaired(spark, sf).select("row_no", *[c for n in config.DATE_COLUMNS for c in (n, f"{n}_is_valid")])


@query("date_validity", f"{REPAIRED} " + " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {c}_is_valid) as valid, count(*) filter (where not {c}_is_valid) as invalid, round(avg(cast({c}_is_valid as int)) * 100, 1) as pct from repaired" for c in config.DATE_COLUMNS))
def date_validity(spark, sf):
    return metrics.date_validity(_repaired(spark, sf))


@query(
    "documented_score",
    f"""{REPAIRED} select row_no, round(0.4 * ({" + ".join(f"cast({some('c.' + c)} as int)" for c in config.REQUIRED_FIELDS)}) / {len(config.REQUIRED_FIELDS)}.0
    + 0.3 * ({" + ".join(f"cast({c}_is_valid as int)" for c in config.DATE_COLUMNS)}) / 3.0 + 0.3 * (cast({some('c.course_keywords')} as int) + cast({some('r.course_version')} as int)) / 2.0, 6) as documented_score
    from repaired r join catalog c using (row_no)""",
)
def documented_score(spark, sf):
    return metrics.documented_score(_repaired(spark, sf)).select("row_no", "documented_score")


@query("month_ends", "with e as (select event_type, cast(min(ts) as date) as a, cast(max(ts) as date) as b from events group by 1) select event_type, (select count(*) from generate_series(date_trunc('month', a)::date, b, interval 1 month) g(m) where last_day(m) <= b) as n from e")
def month_ends(spark, sf):
    """How many months end within each event type's span."""
    span = read(spark, sf, "events").groupBy("event_type").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    return span.select("event_type", F.size(dates.month_ends(F.col("a"), F.col("b"))).cast("bigint").alias("n"))


# Recommendations and insights

IDS = """ids as (select count(*) as ids from (select distinct regexp_extract(regexp_replace(upper(course_no), '[^A-Z0-9]', '', 'g'), '[0-9]+') as k, course_no from catalog) a
  join (select distinct regexp_extract(regexp_replace(upper(course_no), '[^A-Z0-9]', '', 'g'), '[0-9]+') as k, course_no from catalog) b on a.k = b.k and a.course_no < b.course_no where a.k <> '')"""
RECS = f"""{TFIDF}, {CATALOG}, {QUALITY}, {IDS}, counts as (select count(*) filter (where is_cross_dept and score >= 0.8) as crossing, count(*) filter (where score > 0.85) as content from d),
  one as (select * from quality, ids, counts), recs as (
  select 'Improve Overall Content Quality' as title, 1 as found, 'High' as impact, 'Medium' as effort, 1 as priority, 'Quality' as category from one where quality_score < 0.75
  union all select 'Consolidate Cross-Department Duplicate Courses', crossing, 'High', 'Medium', 1, 'Content Management' from one where crossing >= 3
  union all select 'Standardize Course Numbering', ids, 'Medium', 'Low', 2, 'Data Quality' from one where ids >= 2
  union all select 'Merge Similar Content', content, 'Medium', 'Medium', 3, 'Content Management' from one where content >= 3)"""


@query("dataset_recommendations", f"{RECS} select title, cast(found as bigint) as found, impact, effort, priority, category from recs")
def dataset_recommendations(spark, sf):
    d = catalog(spark, sf)
    numbers = similarity.same_number_pairs(d.withColumn("numeric_course_id", text.numeric_course_id(F.col("course_no"))))
    return recommend.dataset_recommendations(metrics.quality_metrics(d), similarity.duplicate_counts(tex._vectors(spark, sf), courses_text(spark, sf)), numbers)


@query("recommendation_groups", f"{RECS} select category, count(*) as n, count(*) filter (where priority <= 3) as urgent from recs group by 1")
def recommendation_groups(spark, sf):
    return recommend.recommendation_groups(dataset_recommendations(spark, sf))


@query(
    "insights",
    f"""select 'metadata' as kind, field as subject, cast(rate as double) as value from ({tex.SQL['metadata_quality']}) where advice <> 'ok'
    union all select 'term', term, cast(score as double) from ({tex.SQL['top_terms']}) union all select 'overlap', dept_1 || ' | ' || dept_2, cast(similarity as double) from ({tex.SQL['dept_overlap']})""",
)
def insights(spark, sf):
    return profile.insights(tex.metadata_quality(spark, sf), tex.top_terms(spark, sf), tex.dept_overlap(spark, sf))


# Similarity and clusters

CLUSTERS = """both_ as (select id_1 as id, id_2 as other from links union select id_2, id_1 from links),
  core as (select id from both_ group by id having count(*) + 1 >= {least}),
  inner_ as (select id, other from both_ where id in (select id from core) and other in (select id from core)),
  reach(id, root) as (select id, id from core union select i.other, r.root from reach r join inner_ i on i.id = r.id),
  comps as (select id, min(root) as cluster from reach group by id),
  border as (select b.id, arg_min(c.cluster, c.id) as cluster from both_ b join comps c on c.id = b.other where b.id not in (select id from core) group by 1)
  select n.id, coalesce(c.cluster, b.cluster, -1) as cluster from nodes_ n left join comps c on c.id = n.id left join border b on b.id = n.id"""


@query("dbscan_clusters", EMB.replace("with p", "with recursive p", 1) + ", links as (select id_1, id_2 from p where score >= 0.3), nodes_ as (select vec_id as id from embeddings), " + CLUSTERS.format(least=4))
def dbscan_clusters(spark, sf):
    return profile.vector_clusters(embeddings(spark, sf), 0.3, 4)


GRAMS = f"""with recursive {REPS}, tok as (select id, {TOKENS} as t from reps), g as (select id, unnest(t) as term from tok union all select id, t[k] || ' ' || t[k + 1] from (select id, t, unnest(range(1, len(t))) as k from tok)
    union all select id, t[k] || ' ' || t[k + 1] || ' ' || t[k + 2] from (select id, t, unnest(range(1, len(t) - 1)) as k from tok)),
  tf as (select id, term, count(*) as tf from g group by 1, 2), terms as (select term, sum(tf) as total, count(*) as df from tf group by 1 order by total desc, term limit 5000),
  raw as (select id, tf.term, tf * (ln((1.0 + (select count(*) from reps)) / (1.0 + df)) + 1) as x from tf join terms on tf.term = terms.term),
  norms as (select id, sqrt(sum(x * x)) as norm from raw group by 1), w as (select raw.id, term, x / norm as w from raw join norms on raw.id = norms.id),
  links as (select a.id as id_1, b.id as id_2 from w a join w b on a.term = b.term and a.id < b.id group by 1, 2 having round(sum(a.w * b.w), 6) >= 0.7), nodes_ as (select id from reps), """


@query("text_clusters", GRAMS + CLUSTERS.format(least=5))
def text_clusters(spark, sf):
    """Clusters of texts whose TF-IDF vectors over one to three words are within a cosine distance of 0.3, five or more to a core."""
    return profile.text_clusters(similarity.representatives(courses_text(spark, sf), "id", "text").select("id", "text"))


@query("cluster_sizes", GRAMS + f"found as (select * from ({'with recursive ' + CLUSTERS.format(least=5)})) select cluster, count(*) as n from found where cluster <> -1 group by 1")
def cluster_sizes(spark, sf):
    return text_clusters(spark, sf).where("cluster <> -1").groupBy("cluster").agg(F.count("*").alias("n"))


@query("cross_dept_pairs", f"{TFIDF} select id_1, id_2, score, dept_1, dept_2 from d where is_cross_dept order by score desc, id_1, id_2 limit 5")
def cross_dept_pairs(spark, sf):
    return similarity.cross_department(similarity.best_pairs(tex._vectors(spark, sf), courses_text(spark, sf), 0.7, "across")).select("id_1", "id_2", "score", "dept_1", "dept_2")


PAIR = f"""with b as (select item_id, text, lead(text) over (order by item_id) as next from benchmark), p as (select item_id, text, next from b where next is not null),
  ta as (select item_id, unnest({TOKENS}) as t from p), tb as (select item_id, unnest({TOKENS.replace('coalesce(text', 'coalesce(next')}) as t from p),
  ca as (select item_id, t, count(*)::double as n from ta group by 1, 2), cb as (select item_id, t, count(*)::double as n from tb group by 1, 2),
  j as (select coalesce(ca.item_id, cb.item_id) as item_id, ca.n as x, cb.n as y, case when ca.n is null or cb.n is null then ln(1.5) + 1 else 1 end as idf from ca full join cb on ca.item_id = cb.item_id and ca.t = cb.t)
  select p.item_id, round(coalesce(c, 0), 6) as cosine from p left join (select item_id, sum(coalesce(x, 0) * coalesce(y, 0)) / (sqrt(sum(power(coalesce(x, 0) * idf, 2))) * sqrt(sum(power(coalesce(y, 0) * idf, 2)))) as c from j group by 1) using (item_id)"""


@query("pair_cosines", PAIR)
def pair_cosines(spark, sf):
    """TF-IDF cosine of each benchmark item with the next."""
    b = read(spark, sf, "benchmark").select("item_id", "text")
    order = quantiles.with_next(b.select("item_id"), "item_id", "next_id").where("next_id is not null")
    pairs = b.join(order, "item_id").join(b.select(F.col("item_id").alias("next_id"), F.col("text").alias("next")), "next_id")
    return pairs.select("item_id", F.round(text.pair_cosine(F.col("text"), F.col("next")), 6).alias("cosine"))


COS = lambda a, b: f"round(list_cosine_similarity(cast({a} as double[]), cast({b} as double[])), 6)"


@query(
    "course_pairs",
    f"""with e as (select a.vec_id, a.embedding as t, b.embedding as d, a.vec_id % 50 as n from embeddings a left join embeddings b on b.vec_id = a.vec_id + 1),
    p as (select a.vec_id as id_1, b.vec_id as id_2, {COS('a.t', 'b.t')} as title_score, coalesce({COS('a.d', 'b.d')}, 0) as text_score, a.n as n_1, b.n as n_2 from e a join e b on a.vec_id < b.vec_id),
    w as (select *, case when n_1 = 0 or n_2 = 0 then 1.0 when n_1 < 20 or n_2 < 20 then 0.7 else 0.4 end::double as w from p)
    select id_1, id_2, title_score, text_score, round(w * title_score + (1 - w) * text_score, 8) as score from w where round(w * title_score + (1 - w) * text_score, 8) >= 0.25""",
)
def course_pairs(spark, sf):
    """Titles by a course's own vector, descriptions by that of the course after it."""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("text_vec"))
    e = e.join(after, "vec_id", "left").select(F.col("vec_id").alias("id"), F.col("embedding").alias("title_vec"), "text_vec", (F.col("vec_id") % 50).alias("text_length"))
    return similarity.course_pairs(e, 0.25)


PARTS = {
    "copies": "select 'copies', count(*), null from documents where text is not null",
    "pairs": "select 'pairs', count(*), round(sum(score), 4) from d",
    "counts": "select 'counts', 1, round(avg(score), 4) from d",
    "duplicates": "select 'duplicates', count(*), round(sum(score), 4) from d where score >= 0.8",
    "across": "select 'across', count(*), round(sum(score), 4) from (select score from d where is_cross_dept order by score desc, id_1, id_2 limit 5)",
    "consolidation": "select 'consolidation', count(*), round(sum(score), 4) from (select score from d where score >= 0.8 order by score desc, id_1, id_2 limit 20)",
    "departments": "select 'departments', count(*), null from (select dept_1, dept_2 from d where dept_1 <> dept_2 union select dept_2, dept_1 from d where dept_1 <> dept_2 union select dept_1, dept_1 from d union select dept_2, dept_2 from d)",
    "nodes": "select 'nodes', count(*), cast(sum(degree) as double) from nodes",
    "edges": "select 'edges', count(*), round(sum(score), 4) from pairs where id_1 in (select id from nodes) and id_2 in (select id from nodes)",
}


@query("content_report", f"{TFIDF}, {tex.NODES}, r(part, n, total) as (" + " union all ".join(PARTS.values()) + ") select part, n, total from r")
def content_report(spark, sf):
    """How many rows each part of the report on similar content has, and what their scores sum up to."""
    report = similarity.content_report(courses_text(spark, sf).select("id", "title", "text", "dept", "category", "activity"), 0.7)
    total = {"counts": F.max("avg_score"), "nodes": F.sum("degree").cast("double")}
    # pairs and duplicates grow with the square of the courses: they were counted where they were found
    counted = report.pop("totals").select("part", "n", F.round("total", 4).alias("total"))
    parts = {k: d for k, d in report.items() if k not in ("pairs", "duplicates")}
    rows = [d.agg(F.lit(k).alias("part"), F.count("*").alias("n"), F.round(total.get(k, F.sum("score") if "score" in d.columns else F.lit(None).cast("double")), 4).alias("total")) for k, d in parts.items()]
    return reduce(DataFrame.union, rows, counted)


@query("title_winkler", "select a.p_partkey, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) as jaro_winkler from part a join part b on b.p_partkey = a.p_partkey + 1")
def title_winkler(spark, sf):
    """Jaro-Winkler similarity of neighbouring part names."""
    p = read(spark, sf, "part")
    pairs = p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    return titles.string_ratio(pairs, "a", "b").select("p_partkey", F.round("jaro_winkler", 6).alias("jaro_winkler"))


@query("weighted_texts", f"{WITH} select row_no as id, md5(t) as text_md5 from (select row_no, concat_ws(' ', course_title, course_title, course_title, course_description, course_keywords) as t from catalog) where trim(t) <> ''")
def weighted_texts(spark, sf):
    d = similarity.weighted_texts(catalog(spark, sf), "row_no", "course_title", "course_description", "course_keywords")
    return d.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "stratified_sample",
    """with c as (select doc_id as id, source as dept, lang as category, md5(doc_id || ':1') as h from documents), g as (select dept, count(*) as n from c where dept is not null group by 1 order by n desc, dept limit 20),
    r as (select c.*, row_number() over (partition by c.dept order by h, id) as k, least(n, 50) as quota from c join g on c.dept = g.dept), drawn as (select * from r where k <= quota),
    rest as (select * from c where id not in (select id from drawn) order by h, id limit (select greatest(0, 400 - count(*)) from drawn))
    select id, dept, category from drawn union all select id, dept, category from rest""",
)
def stratified_sample(spark, sf):
    return profile.stratified_sample(courses_text(spark, sf).select("id", "dept", "category"), "dept", "id", 400)


@query("random_sample", "select doc_id as id from documents order by md5(doc_id || ':1'), doc_id limit 100")
def random_sample(spark, sf):
    return profile.stratified_sample(courses_text(spark, sf).select("id"), None, "id", 100)


# Keys and types

TITLE_KEY = lambda c: f"regexp_replace(trim(lower(nullif(trim({c}), ''))), '[^a-z0-9]+', '_', 'g')"


@query(
    "alternative_keys",
    f"""{WITH}, c as (select row_no, data_source, case when row_no % 6 <> 0 then nullif(trim(course_no), '') end as n, {TITLE_KEY('case when row_no % 4 <> 0 then course_title end')} as t,
      {TITLE_KEY('case when row_no % 5 <> 0 then region_entity end')} as r, {TITLE_KEY('course_type')} as y from catalog)
    select row_no, coalesce(n, t, case when r is not null and y is not null then 'region_' || r || '_' || y end, 'source_' || data_source || '_' || row_no) as key,
    case when n is not null then 'course_no' when t is not null then 'course_title' when r is not null and y is not null then 'region_type' else 'row' end as key_source, case when n is not null then 1.0 else 0.5 end::double as key_confidence from c""",
)
def alternative_keys(spark, sf):
    from coursewright.operators import merge

    gap = lambda c, m: F.when(F.col("row_no") % m != 0, F.col(c)).alias(c)
    c = catalog(spark, sf).select("row_no", "data_source", "course_type", gap("course_no", 6), gap("course_title", 4), gap("region_entity", 5))
    return merge.alternative_keys(c).select("row_no", "key", "key_source", "key_confidence")


@query(
    "odd_dates",
    f"""{WITH}, c as (select row_no, case when row_no % 10 = 0 then 'soon' when row_no % 7 <> 0 then 'date' end as d from catalog)
    select row_no, 'INFO' as severity, 'course_available_from' as field, 'Invalid available_from date format. Will attempt automatic conversion' as message from c where d = 'soon'
    union all select row_no, 'INFO', 'course_available_from', 'Course available from date is recommended' from c where d is null
    union all select row_no, 'WARNING', 'course_available_from', 'Missing required value for course_available_from' from c where d is null""",
)
def odd_dates(spark, sf):
    """Findings about dates that are still text."""
    r = F.col("row_no")
    return validate.check_rows(catalog(spark, sf).select("row_no", F.when(r % 10 == 0, "soon").when(r % 7 != 0, F.concat(F.lit("2024-01-"), (r % 28 + 1).cast("string"))).alias("course_available_from")))


@query("value_types", f"{WITH} select row_no, 'INFO' as severity, 'category_name' as field, 'Category name converted from bigint to string' as message from catalog where row_no % 5 <> 0 union all select row_no, 'INFO', 'course_keywords', 'Keywords converted from double to string' from catalog")
def value_types(spark, sf):
    d = catalog(spark, sf).select("row_no", F.when(F.col("row_no") % 5 != 0, F.col("row_no").cast("bigint")).alias("category_name"), F.col("duration_mins").cast("double").alias("course_keywords"))
    return validate.value_types(d)


MODEL = f"""{WITH}, m as (select row_no, duration_mins * 500 - 5000 as duration_mins, row_no % 13 / 10.0 as quality_score, case when row_no % 7 = 0 then 'odd' when row_no % 3 = 0 then null else 'low' end as activity_level,
  cast(row_no % 3000 - 100 as bigint) as course_age_days from catalog), f as (
  select row_no, 'duration_mins' as field, case when duration_mins < 0 then 'Duration cannot be negative' when duration_mins > 60000 then 'Duration exceeds reasonable limit (1000 hours)' end as message from m
  union all select row_no, 'quality_score', case when quality_score < 0 or quality_score > 1 then 'Quality score must be between 0 and 1' end from m
  union all select row_no, 'activity_level', case when activity_level not in ('none', 'low', 'medium', 'high') then 'Activity level must be one of: none, low, medium, high' end from m
  union all select row_no, 'course_age_days', case when course_age_days < 0 then 'Course age cannot be negative' when course_age_days > 1825 then 'Course age exceeds reasonable limit (5 years)' end from m)"""


def _model(spark, sf):
    r = F.col("row_no")
    return catalog(spark, sf).select(
        "row_no", (F.col("duration_mins") * 500 - 5000).alias("duration_mins"), (r % 13 / 10).alias("quality_score"), F.when(r % 7 == 0, "odd").when(r % 3 != 0, "low").alias("activity_level"), (r % 3000 - 100).alias("course_age_days")
    )


@query("model_limits", f"{MODEL} select row_no, 'ERROR' as severity, field, message from f where message is not null")
def model_limits(spark, sf):
    return validate.check_model(_model(spark, sf))


@query(
    "validation_totals",
    f"""{MODEL}, e as (select row_no, count(*) as n from f where message is not null group by 1) select count(*) as total, count(*) filter (where e.n is null) as passed, count(*) filter (where e.n > 0) as failed,
    0::bigint as warnings, cast(coalesce(sum(e.n), 0) as bigint) as errors from m left join e using (row_no)""",
)
def validation_totals(spark, sf):
    d = _model(spark, sf)
    return validate.validation_totals(d, validate.check_model(d))


@query("result_counts", f"{WITH} select cast(coalesce(sum(case when row_no % 3 = 0 then row_no % 4 end), 0) as bigint) as errors, cast(sum(row_no % 5) as bigint) as warnings from catalog")
def result_counts(spark, sf):
    r = F.col("row_no")
    made = lambda m: F.array_repeat(F.lit("x"), (r % m).cast("int"))
    return validate.result_counts(catalog(spark, sf).select((r % 3 != 0).alias("is_valid"), made(4).alias("errors"), made(5).alias("warnings")))


FILLS = {"zero": "0", "mean": "avg(m) over ()", "median": "median(m) over ()", "default": "60"}


@query(
    "missing_options",
    f"""{WITH}, c as (select row_no, case when row_no % 4 <> 0 then duration_mins end as m, nullif(trim(category_name), '') as t, course_available_from as d from catalog)
    select row_no, {", ".join(f"round(cast(coalesce(m, {x}) as double), 6) as m_{n}" for n, x in FILLS.items())}, coalesce(t, 'Unknown') as t_unknown, coalesce(t, 'N/A') as t_na,
    coalesce(d, {TS}) as d_today, coalesce(d, min(d) over ()) as d_min, coalesce(d, max(d) over ()) as d_max from c""",
)
def missing_options(spark, sf):
    """Every way to fill what is missing, side by side."""
    c = catalog(spark, sf).select("row_no", F.when(F.col("row_no") % 4 != 0, F.col("duration_mins")).alias("m"), F.col("category_name").alias("t"), F.col("course_available_from").alias("d"))
    wide = c.select("row_no", *[F.col("m").alias(f"m_{n}") for n in FILLS if n != "default"], F.col("m").alias("duration_mins"), F.col("t").alias("t_unknown"), F.col("t").alias("t_na"), *[F.col("d").alias(f"d_{n}") for n in ("today", "min", "max")])
    how = {**{f"m_{n}": n for n in FILLS if n != "default"}, "duration_mins": "default", "t_unknown": "Unknown", "t_na": "N/A", **{f"d_{n}": n for n in ("today", "min", "max")}}
    out = columns.fill_missing(wide, how, AS_OF).withColumnRenamed("duration_mins", "m_default")
    return out.withColumns({f"m_{n}": F.round(f"m_{n}", 6) for n in FILLS})


@query("zero_counts", f"{WITH} select row_no, coalesce(case when row_no % 8 <> 0 then learner_count end, 0) as learner_count, coalesce(case when row_no % 9 <> 0 then total_2024_activity end, 0) as total_2024_activity from catalog")
def zero_counts(spark, sf):
    c = catalog(spark, sf).select("row_no", F.when(F.col("row_no") % 8 != 0, F.col("learner_count")).alias("learner_count"), F.when(F.col("row_no") % 9 != 0, F.col("total_2024_activity")).alias("total_2024_activity"))
    return columns.fill_counts(c)


# Reports

PEOPLE = f"{WITH}, people as (select *, case row_no % 4 when 0 then 'leaders' when 1 then 'employees' when 2 then 'managers' end as person_type, 'author_' || row_no % 60 as course_created_by from catalog)"


def _people(spark, sf):
    r = F.col("row_no")
    return catalog(spark, sf).withColumns({"person_type": F.when(r % 4 == 0, "leaders").when(r % 4 == 1, "employees").when(r % 4 == 2, "managers"), "course_created_by": F.concat(F.lit("author_"), (r % 60).cast("string"))})


@query("focus", f"{PEOPLE} " + " union all ".join(f"select '{c}' as field, coalesce({c}, 'Unknown') as value, count(*) as n, round(count(*) * 100.0 / (select count(*) from people), 4) as pct from people group by 1, 2" for c in ("person_type", "course_type")))
def focus(spark, sf):
    return metrics.focus(_people(spark, sf))


@query(
    "kpis",
    f"""{PEOPLE}, k as (select count(distinct lower(trim(k))) as keywords from (select unnest(string_split(course_keywords, ',')) as k from people) where trim(k) <> '')
    select count(distinct course_no) as courses, count(*) filter (where cross_reference_count > 1) as multi_source, count(distinct data_source) as sources, count(distinct region_entity) as regions, count(distinct course_type) as types,
    cast(sum(learner_count) as bigint) as learners, count(distinct person_type) as audiences, count(distinct category_name) as categories, count(distinct course_created_by) as authors,
    count(*) filter (where course_discontinued_from is null or course_discontinued_from > {TS}) as active, any_value(keywords) as keywords from people, k""",
)
def kpis(spark, sf):
    return metrics.kpis(_people(spark, sf), AS_OF)


@query("learner_bands", f"{WITH} select case when learner_count <= 0 then '<= 0' when learner_count <= 10 then '1-10' when learner_count <= 50 then '11-50' when learner_count <= 100 then '51-100' when learner_count <= 500 then '101-500' else '> 500' end as band, count(*) as n from catalog group by 1")
def learner_bands(spark, sf):
    return metrics.size_bands(catalog(spark, sf))


@query("top_creators", f"{PEOPLE}, c as (select 'course_created_by' as field, course_created_by as value, count(*) as n from people group by 2) select *, row_number() over (order by n desc, value) as rank from c qualify rank <= 20")
def top_creators(spark, sf):
    return metrics.top_values(_people(spark, sf), ("course_created_by",), 20)


@query("types_tab", f"{WITH} select course_type, count(*) as courses, cast(sum(learner_count) as bigint) as learners, round(avg(learner_count), 4) as per_course from catalog group by 1")
def types_tab(spark, sf):
    return metrics.by_group(catalog(spark, sf), "course_type", courses=F.count("*"), learners=F.sum("learner_count"), per_course=F.round(F.avg("learner_count"), 4))


@query("category_counts", f"{CATS} " + " union all ".join(f"select '{c}' as category, count(*) filter (where {c}_confidence >= 0.15) as n from c" for c in config.TRAINING_CATEGORIES))
def category_counts(spark, sf):
    return use.category_counts(tex._categorised(spark, sf))


FUNCTIONS = f"{USE}, f as (select *, case user_id % 4 when 0 then 'clinical' when 1 then 'administrative' else 'operations' end as market_function, 'organization ' || user_id % 9 as training_organization from usage)"


def _functions(spark, sf):
    u = F.col("user_id")
    return usage(spark, sf).withColumns({"market_function": F.when(u % 4 == 0, "clinical").when(u % 4 == 1, "administrative").otherwise("operations"), "training_organization": F.concat(F.lit("organization "), (u % 9).cast("string"))})


@query("market_functions", f"{FUNCTIONS} select market_function, count(*) as n, round(count(*) * 100.0 / (select count(*) from f), 4) as pct from f group by 1")
def market_functions(spark, sf):
    return use.shares(_functions(spark, sf), "market_function")


@query("persona_functions", f"{FUNCTIONS} select persona_type, market_function, count(*) as n from f group by 1, 2")
def persona_functions(spark, sf):
    return _functions(spark, sf).groupBy("persona_type", "market_function").agg(F.count("*").alias("n"))


@query("organizations", f"{FUNCTIONS} select training_organization, count(*) as n, cast(sum(completion_count) as bigint) as completions from f group by 1")
def organizations(spark, sf):
    return use.volume(_functions(spark, sf), "training_organization")


@query("trend_line", f"{WITH} select course_available_from, total_2024_activity from catalog where course_available_from is not null")
def trend_line(spark, sf):
    return charts.trend(catalog(spark, sf), "course_available_from", "total_2024_activity")


@query("scatter", f"{WITH} select duration_mins::double as x, learner_count as y, course_type as color, total_2024_activity as size from catalog")
def scatter(spark, sf):
    return charts.scatter(catalog(spark, sf), "duration_mins", "learner_count", "course_type", "total_2024_activity")


# The whole analysis

CASE = "list_aggregate(list_transform(regexp_extract_all(lower({}), '([a-z]+|[^a-z]+)'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '')"


@query(
    "analysis_courses",
    f"""{WITH}, u as (
      select regexp_replace(regexp_replace(trim(course_no), '[:, ]', '_', 'g'), '[^A-Za-z0-9_-]', '', 'g') as course_no, data_source, case data_source when 'catalog' then 0 when 'activity' then 1 else 2 end as source_rank, row_no,
        case when data_source = 'catalog' then trim(course_title) end as course_title, case when data_source = 'catalog' then region_entity end as region_entity,
        case when data_source = 'schedule' then course_available_from end as s, case when data_source = 'schedule' then cast(course_discontinued_from as timestamp) end as e,
        case when data_source = 'activity' then total_2024_activity end as activity from catalog),
      r as (select *, row_number() over (partition by course_no order by s desc nulls last, source_rank, row_no) as rn from u)
    select course_no, data_source, course_title, {CASE.format('region_entity')} as region_entity, case when e is null or e > {TS} then 'active' else 'discontinued' end as course_status,
      case when activity <= 0 then 'none' when activity <= 10 then 'low' when activity <= 50 then 'medium' when activity > 50 then 'high' end as activity_level,
      cast(floor(epoch({TS} - s) / 86400) as bigint) as course_age_days from r where rn = 1""",
)
def analysis_courses(spark, sf):
    from coursewright.plans import more_queries

    return more_queries.analysis_courses(spark, sf)
