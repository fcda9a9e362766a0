import collections
import datetime as dt
import io
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursewright import config
from coursewright.operators import cells, columns, merge, metrics, profile, quantiles, recommend, repair, similarity, term_index, titles, usage, validate
from coursewright.operators.graph import connected_components
from coursewright.sources import readers, writers


@pytest.fixture(scope="module")
def sources(spark):
    """Three exports with overlapping numbers and different headers."""
    a = spark.createDataFrame([("C001", "Intro", 60.0, 100, 50), ("C002", "Next", 120.0, 150, 75), ("C003", "More", 180.0, 200, 100)], "`Course No` string, `Course Title` string, `Dur Mins` double, total_2024_activity long, learner_count long")
    b = spark.createDataFrame([("C002", "Next", 150.0, 175, 80), ("C003", "More", 180.0, 225, 110), ("C004", "Deep", 240.0, 300, 150)], "course_no string, title string, duration double, total_2024_activity long, learner_count long")
    c = spark.createDataFrame([("C001", "Intro", 60.0, 120, 55), ("C004", None, None, 280, 140), ("C005", "End", 90.0, 50, 25)], "`Course No` string, Title string, `Duration Minutes` double, total_2024_activity long, learner_count long")
    frames = [(n, columns.standardize(d).withColumn("row_no", F.monotonically_increasing_id())) for n, d in (("s1", a), ("s2", b), ("s3", c))]
    return columns.union_sources(frames)


def test_merge(sources):
    got = {r["course_no"]: r for r in merge.merge_sources(sources).collect()}
    assert {k: (r["total_2024_activity"], r["learner_count"], r["duration_mins"]) for k, r in got.items()} == {
        "C001": (220, 105, 60.0),
        "C002": (325, 155, 135.0),
        "C003": (425, 210, 180.0),
        "C004": (580, 290, 240.0),
        "C005": (50, 25, 90.0),
    }
    assert [got[f"C00{k}"]["data_sources_count"] for k in range(1, 6)] == [2, 2, 2, 2, 1]
    assert got["C004"]["course_title"] == "Deep" and got["C001"]["data_source"] == "s1 | s3"


def test_column_names(spark):
    d = spark.createDataFrame([(1, 2, 3, 4)], ["Course No", "course_no ", "Unnamed: 3", "x.y"])
    assert columns.tidy_names(d).columns == ["course_no", "course_no_1", "unnamed: 3", "x_y"]
    assert columns.drop_unnamed(columns.tidy_names(d)).columns == ["course_no", "course_no_1", "x_y"]
    e = spark.createDataFrame([(None, "2024 date"), (None, "b")], "`unnamed: 0` string, `unnamed: 1` string")
    assert columns.settle_unnamed(e).columns == ["inferred_date"]
    assert columns.apply_aliases(spark.createDataFrame([(1, 2)], ["id", "course_id"])).columns == ["id", "course_no"]


def test_fill(spark):
    d = spark.createDataFrame([(None, 1.0), (" ", None), ("a ", 3.0)], "category_name string, x double")
    assert [r[0] for r in columns.fill_category(d).select("category_name").collect()] == ["Uncategorized", "Uncategorized", "a"]
    assert [r[0] for r in columns.fill_missing(d, {"x": "mean"}).select("x").collect()] == [1.0, 2.0, 3.0]
    assert columns.null_tokens(spark.createDataFrame([("N/A",), ("x",)], "c string")).where("c is null").count() == 1


def test_dedupe(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [(0, "a", t("2020-01-01")), (1, "a", t("2021-01-01")), (2, "a", None), (3, None, None), (4, None, t("2020-01-01")), (5, "b", None)]
    d = spark.createDataFrame(rows, "row_no long, course_no string, course_available_from timestamp_ntz")
    assert sorted(r["row_no"] for r in merge.dedupe_latest(d).collect()) == [1, 4, 5]
    assert sorted(r["row_no"] for r in merge.dedupe_latest(d, keep_null_keys=True).collect()) == [1, 3, 4, 5]
    assert merge.duplicate_summary(d).first().asDict() == {"rows": 6, "removed": 3, "groups": 1}
    assert merge.dedupe_latest(d.limit(0)).count() == 0


def test_validation(spark):
    d = spark.createDataFrame([(0, "A B", "ab", "v1"), (1, "AB", "Fine title", "1.0.0")], "row_no long, course_no string, course_title string, course_version string")
    found = {(r["row_no"], r["field"]) for r in validate.check_rows(d).collect()}
    assert found == {(0, "course_no"), (0, "course_version")}
    assert validate.summarize(validate.check_rows(d)).count() == 2


def test_repair(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [
        (0, "AAAA1", t("2020-01-01"), t("2021-01-01"), "s"),
        (1, "AAAA2", None, None, "s"),
        (2, "BBBB1", None, None, "s"),
        (3, "CCCC1", t("2022-01-01"), t("2021-01-01"), "s"),
        (4, "DDDD1", t("1889-01-01"), None, "t"),
    ]
    d = spark.createDataFrame(rows, "row_no long, course_no string, course_available_from timestamp_ntz, course_discontinued_from timestamp_ntz, data_source string")
    got = {r["row_no"]: r for r in repair.repair_dates(d, "2024-06-30").collect()}
    assert str(got[1]["course_available_from"]) == "2020-01-01 00:00:00" and got[1]["course_available_from_is_valid"]
    assert not got[2]["course_available_from_is_valid"] and str(got[2]["course_available_from"])[:4] in ("2020", "2021", "2022")
    assert str(got[2]["course_discontinued_from"])[:10] == "2034-06-30"
    assert got[3]["course_discontinued_from"] >= got[3]["course_available_from"]
    assert str(got[4]["course_available_from"])[:10] == "2023-01-01" and not got[4]["course_available_from_is_valid"]


def brute_pairs(texts, least, most=1):
    """All pairs of unit TF-IDF vectors of ``{id: text}``."""
    words = {k: [w for w in re.findall(r"\w\w+", t.lower()) if w not in config.STOP_WORDS] for k, t in texts.items()}
    tf = {k: collections.Counter(" ".join(w[j : j + n]) for n in range(1, most + 1) for j in range(len(w) - n + 1)) for k, w in words.items()}
    df = collections.Counter(t for c in tf.values() for t in c)
    x = {k: {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()} for k, c in tf.items()}
    norm = {k: math.sqrt(sum(v * v for v in c.values())) for k, c in x.items()}
    out = {}
    for a in x:
        for b in x:
            if a < b and norm[a] and norm[b]:
                score = round(sum(v * x[b].get(t, 0) for t, v in x[a].items()) / norm[a] / norm[b], 6)
                if score >= least:
                    out[a, b] = score
    return out


def close_to(got, want):
    assert {(r["id_1"], r["id_2"]) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r["score"] - want[r["id_1"], r["id_2"]]) <= 1.1e-6 for r in got)


@pytest.mark.parametrize("block,least,most", [(1024, 0.7, 1), (1024, 0.3, 1), (7, 0.5, 1), (3, 0.75, 3)])
def test_pairs_are_exact(spark, monkeypatch, block, least, most):
    monkeypatch.setattr(term_index, "BLOCK", block)
    rnd = random.Random(block)
    word = lambda: f"w{int(rnd.paretovariate(0.7)) % 300}"
    base = [" ".join(word() for _ in range(rnd.randrange(1, 40))) for _ in range(60)]
    near = [" ".join(w if rnd.random() < 0.8 else word() for w in rnd.choice(base).split()) for _ in range(60)]
    texts = dict(enumerate([*base, *near, "", "the of", "hot words here", "hot words here", "hot words here"]))
    d = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "id long, text string, term string")
    close_to(term_index.similar_pairs(term_index.TermVectors.of(d, most), least).collect(), brute_pairs(texts, least, most))


def test_scored_pairs_grow_with_rows_and_results(spark):
    """Four times the rows, of as many more kinds: pairs multiplied out stay near the rows and the result."""
    rnd = random.Random(8)
    for n in (150, 600):
        rows = []
        for g in range(n):
            base = [f"t{rnd.randrange(4000)}" for _ in range(25)] + [f"c{rnd.randrange(30)}" for _ in range(10)]
            rows += [(10 * g + k, " ".join(w if rnd.random() < 0.92 else f"t{rnd.randrange(4000)}" for w in base)) for k in range(3)]
        v = term_index.TermVectors.of(spark.createDataFrame(rows, "id long, text string"))
        scored = term_index.scored_pairs(v, 0.7)
        result = scored.where("score >= 0.7").count()
        assert result >= n and scored.count() <= 2 * (len(rows) + result)
    assert term_index.similar_pairs(term_index.TermVectors.of(spark.createDataFrame([], "id long, text string")), 0.7).count() == 0
    with pytest.raises(ValueError):
        term_index.scored_pairs(v, 0.0)


def test_string_ratios():
    assert titles.indel_ratio("abcd", "abxd") == 0.75 and titles.indel_ratio("", "") == 1.0
    assert round(titles.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611 and titles.jaro_winkler("a", "b") == 0.0


def test_components_and_clusters(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 7)], "src long, dst long")
    assert dict(connected_components(e).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert connected_components(e.limit(0)).count() == 0
    nodes = spark.createDataFrame([(k,) for k in range(8)], "id long")
    links = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (5, 6)], "id_1 long, id_2 long")
    assert dict(profile.density_clusters(nodes, links, 3).collect()) == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1, 5: -1, 6: -1, 7: -1}


def test_usage(spark):
    rows = [(6000, "leaders", "a", 45, 2.5, "x"), (3000, "employees", "b", 25, 1.0, "y"), (2000, "managers", "c", 15, 0.5, "x"), (5500, "employees", "b", 30, 1.5, "y"), (1000, "employees", "c", 10, 0.3, "y")]
    d = spark.createDataFrame(rows, "completion_count long, persona_type string, delivery_method string, duration_minutes long, training_hours double, assignment_type string")
    assert usage.history(d).first().asDict() == {"total_completions": 17500, "high_volume": 2}
    assert {r["persona_type"]: r["pct"] for r in usage.shares(d, "persona_type").collect()}["employees"] == 60.0
    assert {r["assignment_type"]: r["hours"] for r in usage.assignment_hours(d).collect()} == {"x": 3.0, "y": 2.8}
    assert {r["delivery_method"]: r["micro"] for r in usage.delivery(d).collect()} == {"a": 0, "b": 0, "c": 2}


def test_files(spark, tmp_path):
    d = spark.createDataFrame([("C1", "Title & more", 3), ("C2", None, 4)], "course_no string, course_title string, n long")
    (tmp_path / "r.xlsx").write_bytes(writers.workbook({"Overview": d, "Other": d}))
    back = readers.read_workbook(spark, str(tmp_path / "r.xlsx"))
    assert back.columns == ["course_no", "course_title", "n"] and back.orderBy("course_no").collect()[0]["course_title"] == "Title & more"
    (tmp_path / "a.csv").write_text("Course No,Title\nC1,N/A\n")
    good, bad = readers.read_catalog(spark, [str(tmp_path / "a.csv"), str(tmp_path / "r.xlsx"), str(tmp_path / "none.xlsx")])
    assert [n for n, _ in good] == ["a.csv", "r.xlsx"] and [n for n, _ in bad] == ["none.xlsx"]
    assert good[0][1].first()["Title"] is None
    writers.write_table(d, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_quality_and_alerts(spark):
    d = spark.createDataFrame([("t", "d" * 500, "c", "r", None, "k", "x")], "course_title string, course_description string, category_name string, region_entity string, course_available_from timestamp_ntz, course_type string, course_keywords string")
    q = metrics.quality_metrics(d)
    assert q.first().asDict() == {"completeness_score": 1.0, "metadata_score": 0.666667, "content_score": 1.0, "quality_score": 0.9}
    assert [r["area"] for r in metrics.improvement_areas(q).collect()] == ["metadata"]
    assert recommend.quality_tab(q).count() == 0


def test_stream(spark, tmp_path):
    from coursewright.streaming.trend import daily_trend, event_stream

    rows = [(k, dt.datetime(2024, 1, 1 + k % 3), k, "a", 1.0) for k in range(9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    src = event_stream(spark, str(tmp_path / "events.parquet"), "*.parquet")
    q = daily_trend(src).writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("trend").collect()) == [3, 3, 3]


def test_title_ratios_against_a_table_of_subsequences(spark):
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        return row[-1]

    rnd = random.Random(9)
    names = ["".join(rnd.choice("abc deé") for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
    d = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    for r in titles.string_ratio(d, "a", "b").collect():
        n = len(r["a"]) + len(r["b"])
        assert r["indel"] == (round(round(200 * common(r["a"], r["b"]) / n) / 100, 4) if n else 1.0)


def test_usage_report(spark):
    rows = [(1, 6000, "leaders", "a", 45, 2.5, "x", dt.datetime(2024, 1, 1), "Safety"), (2, 10, "managers", None, 5, 0.5, None, None, "Safety")]
    d = spark.createDataFrame(rows, "user_id long, completion_count long, persona_type string, delivery_method string, duration_minutes long, training_hours double, assignment_type string, available_from timestamp_ntz, interest_area string")
    text = usage.report(d, "2024-06-30").split("\n")
    assert [x for x in text if x.isupper()] == ["EDUCATION HISTORY", "PERSONAS", "DELIVERY METHODS", "CONTENT AGE", "ASSIGNMENT", "INTERESTS"]
    assert "total_completions: 6010  high_volume: 1" in text and "interest_area: Safety  completions: 6010" in text


def test_plans_from_column_names(spark):
    from coursewright.operators import columns, merge

    schemas = {"a": ["course_no", "category_name", "region_entity", "last_updated"], "b": ["course_no", "region_entity", "last_updated"], "c": ["category_name"]}
    found = set(columns.joins_between(schemas))
    assert found == {("a", "b", "primary_key_join", "course_no", 0.9), ("a", "b", "composite_join", "region_entity,last_updated", 0.7), ("a", "c", "categorical_join", "category_name", 0.6)}
    assert merge.merge_plan(["course_no", "learner_count", "course_title"]) == {"learner_count": "sum", "course_title": "first"}
    assert merge.merge_plan(["course_no", "course_title", "category_name", "duration_mins"])["duration_mins"] == "mean"
    assert [merge.default_rule(c, n) for c, n in (("x_activity", True), ("minutes", True), ("title", False))] == ["sum", "mean", "first"]
    frames = [(n, spark.createDataFrame([], ", ".join(f"{c} string" for c in cs))) for n, cs in (("odd", ["x"]), ("use", ["learner_count"]), ("cat", ["course_no", "course_title", "category_name"]), ("use2", ["learner_count"]))]
    assert [n for n, _ in merge.rank_sources(frames)] == ["cat", "use", "use2", "odd"]


def test_unnamed_columns_and_repeated_names(spark):
    from coursewright.operators import columns

    d = spark.createDataFrame([(None, "course 1", "5"), (" ", "title", "6")], "`Unnamed: 0` string, `Unnamed: 1` string, `Unnamed: 2` string")
    assert sorted(columns.settle_unnamed(columns.tidy_names(d)).columns) == ["data_column_2", "inferred_course_title"]
    assert columns.drop_unnamed(columns.tidy_names(d)).columns == []
    assert columns.tidy_names(spark.createDataFrame([(1, 2, 3)], "`A b` int, `a-B` int, a_b int")).columns == ["a_b", "a_b_1", "a_b_2"]


def test_lists_in_a_table_and_a_guarded_score(spark):
    from coursewright.functions import numbers

    r = spark.createDataFrame([("t", ["a", "b"], 1.7)], "title string, steps array<string>, score double")
    assert writers.recommendations_table(r).first()["steps"] == "a\nb"
    assert r.select(numbers.clamp01(F.col("score")).alias("s")).first()["s"] == 1.0


def test_a_random_top_up_fills_the_sample(spark):
    d = spark.range(1000).select(F.col("id"), F.concat(F.lit("d"), (F.col("id") % 40).cast("string")).alias("dept"))
    s = profile.stratified_sample(d, "dept", "id", 300, groups=5, least=10)
    assert s.count() == s.select("id").distinct().count() == 300
    assert profile.stratified_sample(d, "absent", "id", 30).count() == 30 and profile.stratified_sample(d.limit(0), "dept", "id", 30).count() == 0


def test_content_report(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, base, "a"), (2, base + " lambda", "b"), (3, base, "a"), (4, "something else entirely here", "b"), (5, base + " mu", "a")]
    d = spark.createDataFrame([(i, t[:9], t, dept, "x", 10 * i) for i, t, dept in rows], "id long, title string, text string, dept string, category string, activity long")
    r = similarity.content_report(d)
    pairs = {(x["id_1"], x["id_2"]) for x in r["pairs"].collect()}
    assert pairs == {(1, 2), (1, 5), (2, 5)} and r["counts"].first()["pairs"] == 3
    assert {(x["id"], x["representative"]) for x in r["copies"].collect()} == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)}
    assert {(x["id_1"], x["id_2"]) for x in r["across"].collect()} == {(1, 2), (2, 5)} and r["nodes"].count() == 3 and r["edges"].count() == 3


def test_columns_of_the_standard(spark):
    assert columns.column_type("learner_count") == "bigint" and columns.column_type("anything") == "string"
    assert columns.is_required("course_no") and not columns.is_required("learner_count")
    assert validate.missing_columns(spark.createDataFrame([], "course_no string, course_title string")) == ["category_name", "course_description", "course_type", "region_entity", "course_available_from"]


@pytest.mark.parametrize("least", [-0.4, 0.0, 0.3, 0.9])
def test_vector_pairs_are_exact(spark, monkeypatch, least):
    monkeypatch.setattr(cells, "CELL", 20)
    monkeypatch.setattr(cells, "BLOCK", 25)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 12))
    x = np.vstack([centres[rng.integers(0, 6, 150)] + rng.normal(0, 0.3, (150, 12)), rng.normal(0, 1, (60, 12)), np.tile(centres[0], (70, 1)), np.zeros((2, 12))]).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    d = spark.createDataFrame([*rows, (900, None), (901, [float("nan")] * 12)], "id long, embedding array<float>")
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 6)
    want = {(a, b): s[a, b] for a in range(len(x)) for b in range(a + 1, len(x)) if s[a, b] >= least}
    got = {(r["id_1"], r["id_2"]): r["score"] for r in cells.vector_pairs(d, least).collect()}
    assert set(got) ^ set(want) <= {k for k in set(got) | set(want) if abs(s[k] - least) < 2e-6} and all(abs(got[k] - s[k]) < 2e-6 for k in got)
    assert cells.vector_pairs(d.limit(0), least).count() == 0


def test_far_cells_are_not_compared(spark, monkeypatch):
    """Rows of well separated kinds visit no cell of another kind; without a bound they would visit half of all."""
    monkeypatch.setattr(cells, "CELL", 10)
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(8), 40, axis=0) + rng.normal(0, 0.01, (320, 8))
    d = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, e array<float>")
    c = cells.AngleCells.of(d, 0.9)
    kind = (c.pivots.argmax(axis=1)).tolist()
    visits = c.visits(d).select("cell", "visitor", "id").collect()
    assert sum(not v["visitor"] for v in visits) == 320 and all(kind[v["cell"]] == v["id"] // 40 for v in visits)
    loose = cells.AngleCells.of(d, -0.9).visits(d).where("visitor").count()
    assert sum(v["visitor"] for v in visits) <= loose / 4


def test_fuzzy_titles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(titles, "CELL", 12)
    monkeypatch.setattr(cells, "BLOCK", 40)
    rnd = random.Random(6)
    words = "introduction to spark advanced data safety training clinical skills café naïve 101 & leadership".split()
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))) for _ in range(60)]
    typo = lambda t: "".join(c for c in t if rnd.random() > 0.05)[: rnd.choice([99, 12])] + rnd.choice(["", "", "s", " ii"])
    rows = [*base, *map(typo, base), *map(typo, base), "An introduction to Spark", "Introduction to Spark ", "a", "b", "ab", "", None, "  ", "x" * 300, "x" * 290 + "y", "日本語 入門", "日本語 入門 ii"]
    d = spark.createDataFrame([(t, "x") for t in rows], "title string, n string")
    for least in (0.85, 0.6):
        distinct = collections.Counter(t.strip(" ").lower() for t in rows if t is not None and t.strip(" "))
        want = {(a, b, distinct[a], distinct[b]): round(titles.jaro_winkler(a, b), 4) for a in distinct for b in distinct if a < b}
        want = {k: v for k, v in want.items() if v >= least}
        got = {(r["title_1"], r["title_2"], r["n_1"], r["n_2"]): r["similarity"] for r in titles.fuzzy_titles(d, least).collect()}
        assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert titles.fuzzy_titles(d.limit(0)).count() == 0
    a, b = [rnd.choice(rows[:180]) for _ in range(500)] + ["", "", "x"], [rnd.choice(rows[:180]) for _ in range(500)] + ["", "x", ""]
    assert np.allclose(titles.jaro_winklers(a, b), [titles.jaro_winkler(x, y) for x, y in zip(a, b)])


def test_unlike_titles_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(titles, "CELL", 10)
    d = spark.createDataFrame([(c * 20 + str(k), 1) for c in "aeiou" for k in range(30)], "title string, n long")
    visits = titles.TitleCells.of(d).visits(d, 0.85).collect()
    homes = {}
    for v in visits:
        if not v["visitor"]:
            homes.setdefault(v["cell"], set()).add(v["title"][0])
    assert len(visits) and all(v["title"][0] in homes[v["cell"]] for v in visits)


def test_quantiles(spark):
    rnd = random.Random(7)
    rows = [("big", float(rnd.randrange(500))) for _ in range(3000)] + [("one", 4.5), ("two", 1.0), ("two", 2.0), ("none", None), (None, 3.0), (None, 9.0), ("tie", 5.0), ("tie", 5.0), ("tie", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r["g"]: [r["n"], *(r[f"q{k}"] for k in range(5))] for r in quantiles.quantiles(d, "v", shares, ("g",)).collect()}
    for g in {g for g, _ in rows}:
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g][0] == len(v) and (np.allclose(got[g][1:], np.quantile(v, shares)) if v else got[g][1:] == [None] * 5)
    whole = quantiles.quantiles(d, "v", shares).first()
    assert np.allclose([whole[f"q{k}"] for k in range(5)], np.quantile([v for _, v in rows if v is not None], shares))
    assert quantiles.quantiles(d.limit(0), "v", shares, ("g",)).count() == 0
    counts = d.groupBy("g", "v").count().repartitionByRange(4, "g", "v").select("g", F.spark_partition_id().alias("p"))
    assert counts.where("g = 'big'").select("p").distinct().count() > 1


def test_containment(spark):
    a = spark.createDataFrame([(k, k % 50, None, "x") for k in range(2000)], "a long, b long, c long, d string")
    b = spark.createDataFrame([(k, 5000 + k) for k in range(0, 4000)], "a long, e long")
    got = {(r["child"], r["parent"], r["distinct_values"]) for r in profile.table_containment({"s": (a, ("a", "b", "c", "d")), "t": (b, ("a", "e"))}, size=16).collect()}
    assert got == {("s.b", "s.a", 50), ("s.a", "t.a", 2000), ("s.b", "t.a", 50)}
    almost = spark.createDataFrame([(k, k if k != 777 else -1) for k in range(2000)], "a long, b long")
    assert profile.containment(almost, ("a", "b")).count() == 0
    assert profile.may_contain([1, 2], [1, 2, 3], 3) and not profile.may_contain([1, 2], [1, 3, 4], 3) and profile.may_contain([5], [1, 2, 3], 3) and not profile.may_contain([5], [1, 2], 3)


def test_unnamed_columns(spark):
    rows = [(k, None if k < 30 else "Course id", "" if k else "x", f"v{k}", None) for k in range(60)]
    d = spark.createDataFrame(rows, "n long, `Unnamed: 1` string, `Unnamed: 2` string, `Unnamed: 3` string, `Unnamed: 4` string").repartition(3)
    assert columns.settle_unnamed(d).columns == ["n", "inferred_course_id", "data_column_2"]
    assert columns.settle_unnamed(d.limit(0)).columns == ["n"]


def test_many_workbooks(spark, tmp_path):
    t = lambda *r: spark.createDataFrame(list(r), "`Course No` string, Title string")
    (tmp_path / "a.xlsx").write_bytes(writers.workbook({"One": t(("C1", "first"), ("C2", "N/A")), "Two": t(("C3", "on two"))}))
    (tmp_path / "b.xlsx").write_bytes(writers.workbook({"One": t(("C4", "x & y <z>"))}))
    (tmp_path / "c.xlsx").write_bytes(writers.workbook({"Other": spark.createDataFrame([(1, 2.5)], "n long, v double")}))
    whole = (tmp_path / "b.xlsx").read_bytes()
    (tmp_path / "broken.xlsx").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "text.xlsx").write_text("no workbook")
    paths = [str(tmp_path / f"{n}.xlsx") for n in ("a", "b", "c", "broken", "text", "absent")]
    good, bad = readers.read_workbooks(spark, paths)
    assert sorted(p.rsplit("/", 1)[-1] for p, _ in bad) == ["absent.xlsx", "broken.xlsx", "text.xlsx"]
    frames = {tuple(d.columns): d for _, d in good}
    assert {tuple(r) for r in frames["Course No", "Title", "data_source", "sheet"].collect()} == {("C1", "first", "a.xlsx", "One"), ("C2", None, "a.xlsx", "One"), ("C4", "x & y <z>", "b.xlsx", "One")}
    assert frames["n", "v", "data_source", "sheet"].first()["v"] == "2.5"
    every = dict(readers.read_workbooks(spark, paths, every_sheet=True)[0])
    assert every["a.xlsx"].count() == 4
    with pytest.raises(ValueError):
        readers.read_workbook(spark, paths[3])


def test_workbook_sink(spark, tmp_path, monkeypatch):
    n = 130_000
    d = spark.range(0, n, 1, 3).select("id", F.concat(F.lit("row "), "id").alias("text"), (F.col("id") / 2).alias("half"), F.array("id").alias("list"), F.to_date(F.lit("2024-01-02")).alias("day"), F.lit(None).cast("string").alias("none"))
    path = str(tmp_path / "out")
    writers.write_workbooks(d, path, "Rows")
    files = sorted(f.name for f in (tmp_path / "out").iterdir())
    assert len(files) == 3 and all(f.endswith(".xlsx") for f in files)
    (name, back), = readers.read_workbooks(spark, [path])[0]
    assert back.columns == ["id", "text", "half", "list", "day", "none", "data_source", "sheet"] and back.count() == n
    r = back.where("id = '99999'").first()
    assert (r["text"], r["half"], r["list"], r["day"], r["none"], r["sheet"]) == ("row 99999", "49999.5", "[99999]", "2024-01-02", None, "Rows")
    assert back.agg(F.sum(F.col("id").cast("long"))).first()[0] == n * (n - 1) // 2
    writers.write_workbooks(d.limit(5), path)
    assert readers.read_workbooks(spark, [path])[0][0][1].count() == 5
    writers.write_workbooks(d.limit(2), path, mode="append")
    assert readers.read_workbooks(spark, [path])[0][0][1].count() == 7
    before = sorted(f.name for f in (tmp_path / "out").iterdir())
    with pytest.raises(Exception):
        writers.write_workbooks(d.limit(5).select(F.raise_error(F.lit("stop")).cast("string").alias("x")), path)
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == before
    monkeypatch.setattr(writers, "SHEET_ROWS", 4)
    out = io.BytesIO()
    book = writers.Workbook(out)
    assert book.add("Long", ["k"], [(k,) for k in range(7)]) == 7
    book.close()
    (tmp_path / "long.xlsx").write_bytes(out.getvalue())
    (_, sheets), = readers.read_workbooks(spark, [str(tmp_path / "long.xlsx")], every_sheet=True)[0]
    assert sorted((r["k"], r["sheet"]) for r in sheets.collect()) == [(str(k), "Long" if k < 3 else f"Long {k // 3 + 1}") for k in range(7)]


def test_temporary_tables_go(spark):
    from pathlib import Path

    from coursewright.functions import storage

    with storage.temporary_tables(spark) as folder:
        d = storage.stored(spark.range(10))
        assert d.count() == 10 and list(Path(folder.removeprefix("file:")).glob("*/*.parquet"))
    assert not Path(folder.removeprefix("file:")).exists()
    with pytest.raises(RuntimeError), storage.temporary_tables(spark) as folder:
        storage.stored(spark.range(3))
        raise RuntimeError
    assert not Path(folder.removeprefix("file:")).exists()
    assert storage.stored(spark.range(3)).count() == 3


def test_department_overlap_reads_texts_once(spark, tmp_path):
    """Pairs as by brute force, from one reading of the texts and no join of their counts."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(12)]
    rows = [(rng.choice(["a", "b", "c", "", None]), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(60)]
    rows += [("d", "rare2 rare3"), ("e", None), ("f", ""), ("g", "w1 " * 50), ("h", "rare2")]
    spark.createDataFrame(rows, "dept string, text string").write.parquet(str(tmp_path / "docs"))
    found = profile.department_overlap(spark.read.parquet(str(tmp_path / "docs")), 0.01)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    counts = collections.defaultdict(collections.Counter)
    for dept, text in rows:
        if dept is not None:
            counts[dept].update((text or "").split())
    want = {}
    for x in counts:
        for y in counts:
            both = counts[x].keys() & counts[y].keys()
            if x < y and both:
                dot = sum(counts[x][t] * counts[y][t] for t in both)
                norm = lambda d: math.sqrt(sum((n * (1 if t in both else math.log(1.5) + 1)) ** 2 for t, n in counts[d].items()))
                want[x, y] = (len(both), round(dot / norm(x) / norm(y), 6))
    got = {(r["dept_1"], r["dept_2"]): (r["terms"], r["similarity"]) for r in found.collect()}
    assert got.keys() == {k for k, v in want.items() if v[1] > 0.01} and len(got) > 8
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= 2e-6 for k in got)
