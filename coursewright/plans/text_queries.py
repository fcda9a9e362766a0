"""Queries over documents, embeddings, usage and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright import config
from coursewright.functions import text
from coursewright.functions.storage import cut_lineage
from coursewright.operators import cells, charts, metrics, profile, recommend, similarity, term_index, titles, usage as use
from coursewright.plans.catalog_queries import CLEAN, QUALITY, SCORED, WITH
from coursewright.plans.fixtures import CATALOG, USAGE, catalog, courses_text, embeddings, read, usage

Q, SQL = {}, {}
USE = f"with {USAGE}"
USE_AS_OF = "2024-12-31"
STOPS = ", ".join(f"'{w}'" for w in config.STOP_WORDS)
#: Word characters as Spark's Unicode mode has them.
W = r"[\p{L}\p{M}\p{N}_]"
TOKENS = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '{W}{W}+'), lambda x: x not in ({STOPS}))"


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# Text functions


@query("clean_text", f"select doc_id, md5({CLEAN.format('text')}) as clean_md5, length({CLEAN.format('text')}) as n from documents")
def clean_text(spark, sf):
    c = text.clean_text(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(c.cast("binary")).alias("clean_md5"), F.length(c).cast("bigint").alias("n"))


@query(
    "standard_titles",
    r"""with t as (select p_partkey, lower(p_name) as t from part) select p_partkey,
    trim(regexp_replace(regexp_replace(list_aggregate(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' '), '^(Course|Training|Module|Lesson)\s+', ''), '\s+(Course|Training|Module|Lesson)$', '')) as title from t""",
)
def standard_titles(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.standard_title(F.col("p_name")).alias("title"))


@query(
    "text_quality",
    f"""with t as (select doc_id, text, {CLEAN.format('text')} as c from documents), w as (select *, list_filter(string_split(c, ' '), lambda x: x <> '') as ws from t)
    select doc_id, length(c) as text_length, len(ws) as word_count,
      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: trim(s, ' ') <> '')) as sentence_count,
      case when len(ws) > 0 then round(list_sum(list_transform(ws, lambda x: length(x))) * 1.0 / len(ws), 6) else 0.0 end as avg_word_length,
      regexp_matches(c, '[0-9]') as has_numbers, regexp_matches(coalesce(text, ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]') as has_special_chars from w""",
)
def text_quality(spark, sf):
    q = text.text_quality(F.col("text"))
    q["avg_word_length"] = F.round(q["avg_word_length"], 6)
    return read(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in q.items()])


@query(
    "keywords",
    f"""with t as (select doc_id, unnest({TOKENS}) as w from documents), c as (select doc_id, w, count(*) as n from t group by 1, 2),
    r as (select *, row_number() over (partition by doc_id order by n desc, w) as k from c) select doc_id as id, string_agg(w, ',' order by w) as keywords from r where k <= 10 group by 1""",
)
def keywords(spark, sf):
    return profile.keywords(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


TERM = "element_at(f.terms, cast(doc_id % {n} as int) + 1)"


def _planted(spark, sf):
    """Titles with one planted technical term each."""
    terms = F.array(*[F.lit(t) for t in config.TECHNICAL_TERMS])
    d = read(spark, sf, "documents").select("doc_id", "text")
    return d.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" uses "), F.element_at(terms, (F.col("doc_id") % len(config.TECHNICAL_TERMS) + 1).cast("int")), F.lit(" and HIPAA.")))


_LIST = "[" + ", ".join(f"'{t}'" for t in config.TECHNICAL_TERMS) + "]"
_ALT = "|".join(sorted((t.replace("/", "/") for t in config.TECHNICAL_TERMS), key=len, reverse=True)).lower()
PLANTED = f"planted as (select doc_id, coalesce(text, '') || ' uses ' || ({_LIST})[cast(doc_id % {len(config.TECHNICAL_TERMS)} as int) + 1] || ' and HIPAA.' as text from documents)"


@query("tech_terms", f"with {PLANTED} select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\\b({_ALT})\\b', 1))), ',') as terms from planted")
def tech_terms(spark, sf):
    return _planted(spark, sf).select("doc_id", F.array_join(text.technical_terms(F.col("text")), ",").alias("terms"))


def _plain(p: str) -> str:
    """A pattern without the possessive signs, which change no match of these."""
    return p.replace("*+", "*").replace("++", "+")


def _found(patterns: tuple[str, ...]) -> str:
    return "list_distinct(flatten([" + ", ".join(f"regexp_extract_all(text, '{_plain(p)}')" for p in patterns) + "]))"


NAMED = """named as (select p_partkey, p_type || ' (' || left(upper(p_name), 3) || ') by ' || upper(p_name[1]) || p_name[2:] || ', ' || left(upper(p_name), 3) || '; A.B.C. and HR' || p_size % 7 || ' of Big Maker for '
  || upper(left(p_brand, 5)) || case when p_partkey % 3 = 0 then ': ' else ' ' end || substr('ABCDEFGH', cast(p_size % 5 + 1 as int), 3) || case when p_partkey % 5 = 0 then ' twice ' || substr('ABCDEFGH', cast(p_size % 5 + 1 as int), 3) else '' end as text from part)"""


@query(
    "acronyms",
    rf"""with {NAMED}, a as (select p_partkey, text, list_filter(list_distinct(list_transform({_found(text.ACRONYMS)}, lambda x: regexp_replace(x, '[^\w\s]', '', 'g'))), lambda x: length(x) >= 2) as bare, {_found(text.COMPOUNDS)} as c from named)
    select p_partkey, array_to_string(list_sort(list_filter(bare, lambda x: len(string_split(text, x)) > 2 or regexp_matches(text, x || '\s*\([^)]+\)') or regexp_matches(text, '\b' || x || '\b\s*[:;]'))), ',') as acronyms,
      array_to_string(list_sort(list_filter(c, lambda x: regexp_matches(x, '\S\s+\S'))), ',') as compounds from a""",
)
def acronyms(spark, sf):
    """Acronyms and compound terms of texts that define, repeat and list them."""
    # a small file is one task, however much its patterns take
    p, k = read(spark, sf, "part").repartition(4 * spark.sparkContext.defaultParallelism), F.col("p_partkey")
    upper = F.left(F.upper("p_name"), F.lit(3))
    listed = F.when(k % 3 == 0, F.lit(": ")).otherwise(F.lit(" "))
    three = F.substr(F.lit("ABCDEFGH"), (F.col("p_size") % 5 + 1).cast("int"), F.lit(3))
    twice = F.when(k % 5 == 0, F.concat(F.lit(" twice "), three)).otherwise(F.lit(""))
    parts = ["p_type", " (", upper, ") by ", F.upper(F.left("p_name", F.lit(1))), F.substr("p_name", F.lit(2)), ", ", upper, "; A.B.C. and HR", (F.col("p_size") % 7).cast("string"), " of Big Maker for ", F.upper(F.left("p_brand", F.lit(5))), listed, three, twice]
    named = F.concat(*[F.lit(x) if isinstance(x, str) and not x.startswith("p_") else F.col(x) if isinstance(x, str) else x for x in parts])
    return p.select("p_partkey", F.array_join(text.acronyms(named), ",").alias("acronyms"), F.array_join(text.compound_terms(named), ",").alias("compounds"))


WORDS = [w for ws in config.TRAINING_CATEGORIES.values() for w in ws]
CAT_TEXT = "' ' || trim(regexp_replace(lower(p_name || ' ' || ([" + ", ".join(f"'{w}'" for w in WORDS) + f"])[cast(p_partkey % {len(WORDS)} as int) + 1]), '[^a-z0-9_]+', ' ', 'g')) || ' '"


def _confidence(cat: str) -> str:
    import re

    plain = [re.sub(r"\W+", " ", w).strip() for w in config.TRAINING_CATEGORIES[cat]]
    return "round(least((" + " + ".join(f"case when contains(t, ' {w} ') then 1.0 when contains(t, '{w}') then 0.5 else 0.0 end" for w in plain) + f")::double / {len(plain)}, 1.0), 6)"


CATS = f"with t as (select p_partkey, {CAT_TEXT} as t from part), c as (select p_partkey, " + ", ".join(f"{_confidence(c)} as {c}_confidence" for c in config.TRAINING_CATEGORIES) + " from t)"


def _categorised(spark, sf):
    p = read(spark, sf, "part")
    words = F.array(*[F.lit(w) for w in WORDS])
    return profile.categories(p, F.concat_ws(" ", "p_name", F.element_at(words, (F.col("p_partkey") % len(WORDS) + 1).cast("int"))))


@query("category_detect", f"{CATS} select p_partkey, " + ", ".join(f"{c}_confidence" for c in config.TRAINING_CATEGORIES) + " from c")
def category_detect(spark, sf):
    return _categorised(spark, sf).select("p_partkey", *[f"{c}_confidence" for c in config.TRAINING_CATEGORIES])


@query("category_overlap", f"{CATS} " + " union all ".join(f"select '{a}' as category_1, '{b}' as category_2, round(avg(cast({a}_confidence >= 0.15 and {b}_confidence >= 0.15 as int)) * 100, 4) as pct from c" for a in config.TRAINING_CATEGORIES for b in config.TRAINING_CATEGORIES))
def category_overlap(spark, sf):
    return profile.category_overlap(_categorised(spark, sf))


@query(
    "title_ratios",
    """with recursive p as (select a.p_partkey, a.p_name as a, b.p_name as b from part a join part b on b.p_partkey = a.p_partkey + 1),
    lcs(p_partkey, a, b, k, line) as (select p_partkey, lower(a), lower(b), 0, list_transform(range(length(b) + 1), lambda x: 0) from p
      union all select p_partkey, a, b, k + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda i: case when i > 1 and b[i - 1] = a[k + 1] then line[i - 1] + 1 else line[i] end)))
      from lcs where k < length(a)),
    best as (select p_partkey, line[length(b) + 1] as m, length(a) + length(b) as n from lcs where k = length(a))
    select p.p_partkey, round_even(200.0 * m / n, 0) / 100 as indel, round(jaro_winkler_similarity(p.a, p.b), 6) as jaro_winkler from p join best using (p_partkey)""",
)
def title_ratios(spark, sf):
    """String ratios of neighbouring parts' names; the SQL finds the longest common subsequence line by line."""
    p = read(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"))
    pairs = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    return titles.string_ratio(pairs, "a", "b").select("p_partkey", F.round("indel", 4).alias("indel"), F.round("jaro_winkler", 6).alias("jaro_winkler"))


# Similarity

REPS = "reps as (select min(doc_id) as id, text from documents where text is not null group by text)"
TFIDF = f"""with {REPS}, tok as (select id, unnest({TOKENS}) as term from reps), tf as (select id, term, count(*) as tf from tok group by 1, 2),
  terms as (select term, sum(tf) as total, count(*) as df from tf group by 1 order by total desc, term limit 5000),
  n as (select count(*) as n from reps), raw as (select id, tf.term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) as x from tf join terms on tf.term = terms.term, n),
  norms as (select id, sqrt(sum(x * x)) as norm from raw group by 1), w as (select raw.id, term, x / norm as w from raw join norms on raw.id = norms.id),
  pairs as (select a.id as id_1, b.id as id_2, round(sum(a.w * b.w), 6) as score from w a join w b on a.term = b.term and a.id < b.id group by 1, 2 having round(sum(a.w * b.w), 6) >= 0.7),
  c as (select doc_id as id, source as dept, lang as category, n_chars % 120 as activity from documents),
  d as (select p.*, x.dept as dept_1, y.dept as dept_2, x.activity as activity_1, y.activity as activity_2, x.dept <> y.dept as is_cross_dept, x.category <> y.category as is_cross_category from pairs p join c x on x.id = id_1 join c y on y.id = id_2)"""


def _vectors(spark, sf):
    reps = similarity.representatives(courses_text(spark, sf), "id", "text")
    return term_index.TermVectors.of(reps.select("id", "text"))


@query("tfidf_pairs", f"{TFIDF} select id_1, id_2, score, is_cross_dept, is_cross_category, score >= 0.9 as is_high, case when is_cross_dept then 1 else 2 end as priority from d")
def tfidf_pairs(spark, sf):
    return similarity.flagged_pairs(_vectors(spark, sf), courses_text(spark, sf), 0.7)


@query("text_copies", "select doc_id as id, min(doc_id) over (partition by text) as representative from documents where text is not null")
def text_copies(spark, sf):
    d = courses_text(spark, sf)
    return similarity.members(d, similarity.representatives(d, "id", "text"), "id", "text")


@query(
    "potential_dups",
    f"{TFIDF} select id_1, id_2, score, case when is_cross_dept then 'Cross-department duplicate - consider consolidation or collaboration' else 'Review for potential consolidation' end as recommendation from d where score >= 0.8",
)
def potential_dups(spark, sf):
    return similarity.potential_duplicates(similarity.flagged_pairs(_vectors(spark, sf), courses_text(spark, sf), similarity.DUPLICATE)).select("id_1", "id_2", "score", "recommendation")


@query(
    "consolidation",
    f"""{TFIDF} select id_1, id_2, score, case when activity_1 >= activity_2 then id_1 else id_2 end as keep_course, case when activity_1 >= activity_2 then id_2 else id_1 end as consolidate_course,
    activity_1 - activity_2 as activity_diff, case when is_cross_dept then 'Cross-department content overlap - consider collaboration' else 'Content duplicate - consider consolidation' end as detail
    from d where score >= 0.8 order by score desc, id_1, id_2 limit 20""",
)
def consolidation(spark, sf):
    return similarity.consolidation(similarity.best_pairs(_vectors(spark, sf), courses_text(spark, sf), similarity.DUPLICATE, "high"))


@query(
    "sim_counts",
    f"""{TFIDF} select count(*) as pairs, count(*) filter (where score >= 0.8) as high, count(*) filter (where score >= 0.6 and score < 0.8) as medium, count(*) filter (where is_cross_dept) as cross_dept,
    round(avg(cast(is_cross_dept as int)) * 100, 4) as cross_dept_pct, round(avg(score), 6) as avg_score from d""",
)
def sim_counts(spark, sf):
    return similarity.counts_of(similarity.pair_groups(_vectors(spark, sf), courses_text(spark, sf), 0.7))


NODES = "ends as (select unnest([id_1, id_2]) as id from pairs), nodes as (select id, count(*) as degree, 10 + 5 * count(*) as size from ends group by 1 order by degree desc, id limit 50)"


@query("network_nodes", f"{TFIDF}, {NODES} select * from nodes")
def network_nodes(spark, sf):
    return similarity.most_linked(_vectors(spark, sf), 0.7)


@query("network_edges", f"{TFIDF}, {NODES} select id_1, id_2, score from pairs where id_1 in (select id from nodes) and id_2 in (select id from nodes)")
def network_edges(spark, sf):
    v = _vectors(spark, sf)
    nodes = cut_lineage(similarity.most_linked(v, 0.7))
    return similarity.network_edges(term_index.similar_pairs(v.among(nodes.select("id")), 0.7), nodes)


@query(
    "dept_heatmap",
    f"""{TFIDF}, o as (select dept_1, dept_2, score from d where dept_1 <> dept_2), both_ as (select * from o union all select dept_2, dept_1, score from o)
    select dept_1, dept_2, round(avg(score), 4) as mean_score, count(*) as pairs from both_ group by 1, 2
    union all select x, x, 1.0, count(*) from (select unnest([dept_1, dept_2]) as x from d) group by x""",
)
def dept_heatmap(spark, sf):
    return similarity.matrix_of(similarity.pair_groups(_vectors(spark, sf), courses_text(spark, sf), 0.7))


EMB = """with p as (select a.vec_id as id_1, b.vec_id as id_2, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as score
  from embeddings a join embeddings b on a.vec_id < b.vec_id)"""


@query("embed_pairs", f"{EMB} select * from p where score >= 0.3")
def embed_pairs(spark, sf):
    return cells.vector_pairs(embeddings(spark, sf).select("id", "embedding"), 0.3)


@query(
    "sim_histogram",
    f"""{EMB}, h as (select case when score >= 0.8 then 'very_high' when score >= 0.6 then 'high' when score >= 0.4 then 'medium' else 'low' end as band, count(*) as n from p where score >= 0.2 group by 1)
    select * from h union all select 'very_low', cast((select count(*) * (count(*) - 1) // 2 from embeddings) - (select coalesce(sum(n), 0) from h) as bigint)""",
)
def sim_histogram(spark, sf):
    return similarity.vector_histogram(embeddings(spark, sf)).withColumn("n", F.col("n").cast("bigint"))


@query(
    "id_match_pairs",
    f"""with {CATALOG}, f as (select regexp_extract(regexp_replace(upper(course_no), '[^A-Z0-9]', '', 'g'), '[0-9]+') as numeric_course_id, course_no, count(*) as n from catalog group by 1, 2)
    select a.numeric_course_id, a.course_no as number_1, a.n as n_1, b.course_no as number_2, b.n as n_2 from f a join f b on a.numeric_course_id = b.numeric_course_id and a.course_no < b.course_no where a.numeric_course_id <> ''""",
)
def id_match_pairs(spark, sf):
    return similarity.same_number_pairs(catalog(spark, sf).withColumn("numeric_course_id", text.numeric_course_id(F.col("course_no"))))


# Profiles

META = ("course_title", "category_name", "course_type", "region_entity", "course_keywords")


def _some(c: str) -> str:
    return f"coalesce(trim(cast({c} as varchar)) <> '', false)"


@query(
    "metadata_quality",
    f"{WITH}, m as ("
    + " union all ".join(f"select '{c}' as field, count(*) as total, count({c}) as non_null, count(*) filter (where {_some(c)}) as non_blank, round(count(*) filter (where {_some(c)}) * 1.0 / count(*), 6) as rate, count(distinct {c}) as distinct_values from catalog" for c in META)
    + ") select *, case when rate < 0.9 then 'complete' when distinct_values < 5 then 'diversify' else 'ok' end as advice from m",
)
def metadata_quality(spark, sf):
    return profile.metadata_quality(catalog(spark, sf), META)


@query("numbering", f"{WITH} select regexp_extract(course_no, '([A-Za-z]+)([0-9]+)', 1) as prefix, count(*) as n from catalog where regexp_matches(course_no, '[A-Za-z]+[0-9]+') group by 1")
def numbering(spark, sf):
    return profile.numbering(catalog(spark, sf))


@query(
    "numbering_stats",
    f"""{WITH}, x as (select try_cast(nullif(regexp_extract(course_no, '([A-Za-z]+)([0-9]+)', 2), '') as double) as x from catalog)
    select count(x) as n, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std, min(x) as min, round(quantile_cont(x, 0.25), 4) as q1, round(quantile_cont(x, 0.5), 4) as q2, round(quantile_cont(x, 0.75), 4) as q3, max(x) as max from x""",
)
def numbering_stats(spark, sf):
    return profile.numbering_statistics(catalog(spark, sf))


NUMS = ("learner_count", "total_2024_activity", "duration_mins", "cross_reference_count", "row_no")


@query(
    "correlations",
    f"{WITH}, r as (" + " union all ".join(f"select '{a}|{b}' as pair, round(corr({a}, {b}), 6) as r from catalog" for k, a in enumerate((*NUMS, "duration_hours")) for b in (*NUMS, "duration_hours")[k + 1 :] if "duration_hours" not in (a, b)) + " union all select 'duration_mins|duration_hours', round(corr(duration_mins, duration_mins / 60), 6) from catalog) select * from r where abs(r) > 0.7",
)
def correlations(spark, sf):
    d = catalog(spark, sf).withColumn("duration_hours", F.col("duration_mins") / 60)
    one = profile.correlations(d, NUMS)
    return one.union(profile.correlations(d, ("duration_mins", "duration_hours")))


FK = {"l_orderkey": "lineitem", "o_orderkey": "orders", "o_custkey": "orders"}


@query(
    "fk_containment",
    """with v as (select distinct 's_nationkey' as c, cast(s_nationkey as varchar) as v from supplier union select distinct 's_suppkey', cast(s_suppkey as varchar) from supplier),
    n as (select c, count(*) as n from v group by 1) select a.c as child, b.c as parent, any_value(n.n) as distinct_values, 0.8::double as confidence
    from v a join v b on a.v = b.v and a.c <> b.c join n on n.c = a.c group by 1, 2 having count(*) = any_value(n.n)""",
)
def fk_containment(spark, sf):
    return profile.containment(read(spark, sf, "supplier").select("s_nationkey", "s_suppkey"), ("s_nationkey", "s_suppkey"))


#: Key columns of all tables.
KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey", "n_regionkey"),
    "customer": ("c_custkey", "c_nationkey"),
    "supplier": ("s_suppkey", "s_nationkey"),
    "part": ("p_partkey",),
    "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
}


@query(
    "fk_tables",
    "with v as ("
    + " union ".join(f"select '{t}.{c}' as c, cast({c} as varchar) as v from {t} where {c} is not null" for t, cs in KEYS.items() for c in cs)
    + """), n as (select c, count(*) as n from v group by 1) select a.c as child, b.c as parent, any_value(n.n) as distinct_values, 0.8::double as confidence
    from v a join v b on a.v = b.v and a.c <> b.c join n on n.c = a.c group by 1, 2 having count(*) = any_value(n.n)""",
)
def fk_tables(spark, sf):
    """Which key columns' values another key column has, over seven tables."""
    return profile.table_containment({t: (read(spark, sf, t), cs) for t, cs in KEYS.items()})


@query(
    "column_confidence",
    f"""{WITH}, s as (select avg(learner_count) as m, stddev_pop(learner_count) as s from catalog)
    select 'learner_count' as field, round(avg(cast(learner_count is not null as int)) * (1 - avg(cast(abs((learner_count - m) / s) > 3 as int))), 4) as confidence from catalog, s
    union all select 'course_no', round(avg(cast(course_no is not null as int)) * case when count(distinct course_no) * 1.0 / count(*) > 0.8 then 0.8 else 1.0 end, 4) from catalog
    union all select 'course_title', round(avg(cast(course_title is not null as int)) * case when count(distinct course_title) * 1.0 / count(*) > 0.8 then 0.8 else 1.0 end, 4) from catalog""",
)
def column_confidence(spark, sf):
    return profile.column_confidence(catalog(spark, sf), ("learner_count",), ("course_no", "course_title"))


@query(
    "text_patterns",
    f"""{WITH}, s as (select course_no as c from catalog where course_no is not null order by row_no limit 100)
    select 'all_caps' as form, round(avg(cast(upper(c) = c and regexp_matches(c, '[A-Za-z]') as int)) * 100, 4) as pct from s
    union all select 'title_case', round(avg(cast(upper(c[1]) || lower(c[2:]) = c as int)) * 100, 4) from s
    union all select 'has_digit', round(avg(cast(regexp_matches(c, '[0-9]') as int)) * 100, 4) from s
    union all select 'has_special', round(avg(cast(regexp_matches(c, '[^A-Za-z0-9]') as int)) * 100, 4) from s
    union all select 'formatted_code', round(avg(cast(regexp_matches(c, '^[A-Z0-9_-]+$') as int)) * 100, 4) from s""",
)
def text_patterns(spark, sf):
    return profile.text_patterns(catalog(spark, sf), "course_no", "row_no")


TOK = f"tok as (select doc_id as id, {TOKENS} as t from documents)"


@query(
    "top_terms",
    f"""with {TOK}, g as (select id, unnest(t) as term from tok union all select id, t[k] || ' ' || t[k + 1] from (select id, t, unnest(range(1, len(t))) as k from tok)
      union all select id, t[k] || ' ' || t[k + 1] || ' ' || t[k + 2] from (select id, t, unnest(range(1, len(t) - 1)) as k from tok)),
    tf as (select id, term, count(*) as tf from g group by 1, 2), terms as (select term, sum(tf) as total, count(*) as df from tf group by 1 order by total desc, term limit 5000)
    select term, round(total * (ln((1.0 + (select count(*) from documents)) / (1.0 + df)) + 1), 4) as score from terms order by score desc, term limit 20""",
)
def top_terms(spark, sf):
    return profile.top_terms(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(
    "dept_overlap",
    f"""with t as (select source as dept, unnest({TOKENS}) as term from documents where source is not null), tf as (select dept, term, count(*)::double as tf from t group by 1, 2),
    s as (select dept, sum(tf * tf) as s from tf group by 1),
    sh as (select a.dept as dept_1, b.dept as dept_2, sum(a.tf * b.tf) as dot, sum(a.tf * a.tf) as xx, sum(b.tf * b.tf) as yy, count(*) as terms from tf a join tf b on a.term = b.term and a.dept < b.dept group by 1, 2),
    r as (select dept_1, dept_2, terms, round(round(dot / (sqrt(xx + power(ln(1.5) + 1, 2) * (x.s - xx)) * sqrt(yy + power(ln(1.5) + 1, 2) * (y.s - yy))), 6), 4) as similarity from sh join s x on x.dept = dept_1 join s y on y.dept = dept_2)
    select * from r where similarity > 0.3""",
)
def dept_overlap(spark, sf):
    d = read(spark, sf, "documents").select(F.col("source").alias("dept"), "text")
    return profile.department_overlap(d).withColumn("similarity", F.round("similarity", 4))


# Usage


@query("history_tracking", f"{USE} select cast(sum(completion_count) as bigint) as total_completions, count(*) filter (where completion_count > 60) as high_volume from usage")
def history_tracking(spark, sf):
    return use.history(usage(spark, sf), 60)


@query("persona_shares", f"{USE} select persona_type, count(*) as n, round(count(*) * 100.0 / (select count(*) from usage), 4) as pct from usage group by 1")
def persona_shares(spark, sf):
    return use.shares(usage(spark, sf), "persona_type")


@query("delivery_methods", f"{USE} select delivery_method, count(*) as n, round(avg(duration_minutes), 4) as avg_minutes, count(*) filter (where duration_minutes <= 15) as micro, delivery_method as label from usage group by 1")
def delivery_methods(spark, sf):
    return use.delivery(usage(spark, sf))


@query(
    "usage_age",
    f"""{USE}, a as (select floor(epoch(timestamp '{USE_AS_OF}' - available_from) / 86400) as d from usage)
    select count(*) filter (where d <= 365) as "1_year", count(*) filter (where d <= 730) as "2_year", count(*) filter (where d <= 1095) as "3_year" from a""",
)
def usage_age(spark, sf):
    return use.content_age(usage(spark, sf), USE_AS_OF)


@query("assignment_hours", f"{USE} select assignment_type, count(*) as n, round(sum(training_hours), 4) as hours from usage group by 1")
def assignment_hours(spark, sf):
    return use.assignment_hours(usage(spark, sf))


@query("content_production", f"{USE} select content_source, count(*) as n, cast(sum(completion_count) as bigint) as completions from usage group by 1")
def content_production(spark, sf):
    return use.volume(usage(spark, sf), "content_source")


@query("top_interests", f"{USE} select interest_area, cast(sum(completion_count) as bigint) as completions from usage group by 1 order by completions desc, interest_area limit 5")
def top_interests(spark, sf):
    return use.top_interests(usage(spark, sf))


# Charts


@query("date_bins_sum", "select date_trunc('week', ts) as period, round(sum(value), 4) as total from events group by 1")
def date_bins_sum(spark, sf):
    return charts.sum_by_period(read(spark, sf, "events"), "ts", "value", "W").withColumn("total", F.round("total", 4))


@query("timeline", f"{WITH} select cast(date_trunc('quarter', course_available_from) as timestamp) as period, category_name, count(*) as n from catalog where course_available_from is not null group by 1, 2")
def timeline(spark, sf):
    return charts.timeline(catalog(spark, sf), "course_available_from", "Q", "category_name")


@query("quality_histogram", f"{SCORED} select least(cast(floor(quality_score * 20) as bigint) + 1, 20) as bin, count(*) as n from scored group by 1")
def quality_histogram(spark, sf):
    return charts.histogram(metrics.quality_score(catalog(spark, sf)), "quality_score")


@query(
    "box_plot",
    f"{WITH} select course_type, " + ", ".join(f"round(quantile_cont(duration_mins::double, {q}), 6) as {n}" for n, q in (("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1))) + " from catalog group by 1",
)
def box_plot(spark, sf):
    return charts.five_numbers(catalog(spark, sf), "duration_mins", "course_type")


@query("heatmap", f"{WITH} select course_type, data_source, round(avg(learner_count), 6) as mean_value from catalog group by 1, 2")
def heatmap(spark, sf):
    return charts.heatmap(catalog(spark, sf), "course_type", "data_source", "learner_count")


@query(
    "wide_heatmap",
    f"""{WITH} select course_type, round(avg(learner_count) filter (where data_source = 'activity'), 6) as activity, round(avg(learner_count) filter (where data_source = 'catalog'), 6) as catalog,
    round(avg(learner_count) filter (where data_source = 'schedule'), 6) as schedule from catalog group by 1""",
)
def wide_heatmap(spark, sf):
    long = charts.heatmap(catalog(spark, sf), "course_type", "data_source", "learner_count")
    return charts.wide_heatmap(long, "course_type", "data_source", "mean_value", ["activity", "catalog", "schedule"])


@query("quality_chart", f"{WITH}, {QUALITY} select 'completeness' as measure, completeness_score as score from quality union all select 'metadata', metadata_score from quality union all select 'content', content_score from quality union all select 'quality', quality_score from quality")
def quality_chart(spark, sf):
    return charts.quality_bars(metrics.quality_metrics(catalog(spark, sf)))


@query("term_frequencies", f"with t as (select unnest({TOKENS}) as term from benchmark) select term, count(*) as n from t group by 1")
def term_frequencies(spark, sf):
    return charts.term_frequencies(read(spark, sf, "benchmark"))

