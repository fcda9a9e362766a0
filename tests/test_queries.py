"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Those with the longest SQL or the most particular plans; the rest are compared by the driver on larger tables.
NAMES = (
    "monthly_trend std_course_number dedupe_latest merge_by_key completeness quality_metrics activity_metrics validation_rows strict_validation "
    "parse_dates alerts keywords tech_terms embed_pairs id_match_pairs correlations fk_containment fuzzy_titles aliased_columns assignment_hours timeline "
    "date_repair date_validity documented_score month_ends recommendation_groups insights dbscan_clusters text_clusters cross_dept_pairs pair_cosines course_pairs "
    "title_winkler weighted_texts stratified_sample random_sample alternative_keys value_types model_limits validation_totals result_counts missing_options "
    "acronyms title_ratios composite_keys content_report fk_tables numbering_stats box_plot metadata_quality file_structure focus kpis learner_bands top_creators category_counts organizations analysis_courses"
).split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    sql = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    order = [list(sql.columns).index(c) for c in columns]
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(str([plain(r[k]) for k in order]) for r in sql.fetchall())
    assert ours == theirs


def test_analysis(spark):
    from coursewright.plans.analysis import analyze

    a = spark.createDataFrame([("C 1", "Intro", "5/3/2024", "N/A"), ("C 1", "Intro", "2024-04-01", "x"), ("C2", None, "soon", "")], "`Course Number` string, Title string, `Start Date` string, Category string")
    b = spark.createDataFrame([("C2", "7 people", "12")], "course_no string, Learners string, Activity string")
    r = analyze([("b", b), ("a", a)], "2024-06-30")
    got = {(x["course_no"], x["data_source"]): x for x in r.courses.collect()}
    assert set(got) == {("C_1", "a"), ("C2", "a")}
    assert str(got[("C_1", "a")]["course_available_from"])[:10] == "2024-04-01" and got[("C_1", "a")]["category_name"] == "x"
    assert r.duplicates.first()["removed"] == 2 and r.totals.first()["courses"] == 2
    assert {x["month"] for x in r.trend.collect()} == {"2024-04"} and r.findings.count() > 0
