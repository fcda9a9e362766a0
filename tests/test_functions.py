from pyspark.sql import functions as F

from coursewright.functions import dates, numbers, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()["x"]


def test_clean_text(spark):
    assert one(spark, "  Été: Ce n'est   PAS_ça! ", text.clean_text) == "été ce n est pas_ça"
    assert one(spark, None, text.clean_text) == ""


def test_course_numbers(spark):
    assert one(spark, " comp-0234 x", text.standard_course_no) == "COMP0234"
    assert one(spark, "0234", text.standard_course_no) == "0234"
    assert one(spark, None, text.standard_course_no) == ""
    assert one(spark, "xy-12-34", text.numeric_course_id) == "1234"
    assert one(spark, " A:b,c ​d ", text.clean_course_no) == "A_b_c_d"


def test_titles_and_keys(spark):
    assert one(spark, "course intro_to 3d-printing training", text.standard_title) == "Intro_To 3D Printing"
    assert one(spark, " A b! C ", text.merge_key) == "a b c"


def test_pair_cosine(spark):
    d = spark.createDataFrame([("alpha beta", "alpha beta"), ("alpha", "gamma"), ("", "x"), ("alpha beta", "alpha gamma")], "a string, b string")
    got = [r["x"] for r in d.select(text.pair_cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    k = 1.4054651081081644
    assert [round(x, 9) for x in got] == [1.0, 0.0, 0.0, round(1 / (1 + k * k), 9)]


def test_terms(spark):
    assert one(spark, "The API gateway calls a SQL database; api.", text.technical_terms) == ["api", "api gateway", "database", "sql"]
    assert "NASA" in one(spark, "NASA: the agency. Nothing else", text.acronyms)
    assert one(spark, "Learn Data Science now", text.compound_terms)[0].endswith("Data Science")


def test_categories(spark):
    d = spark.createDataFrame([("Leadership and change management",), ("nothing",)], "t string")
    got = d.select(text.category_confidence(F.col("t"), "leadership_development").alias("x")).collect()
    assert [r["x"] for r in got] == [3 / 8, 0.0]
    w = d.select(text.weighted_category_confidence({"course_title": F.col("t")}, "leadership_development").alias("x")).first()["x"]
    assert round(w, 6) == 0.45


def test_dates(spark):
    for raw in ("2024-03-05", "5/3/2024", "2024/3/5", "05.03.2024", "5 Mar 2024", "March 5 2024", "2024-03-05 00:00:00"):
        assert str(one(spark, raw, dates.parse_date))[:10] == "2024-03-05", raw
    assert str(one(spark, "3/25/2024", dates.parse_date))[:10] == "2024-03-25"
    assert one(spark, "soon", dates.parse_date) is None
    d = spark.sql("select timestamp_ntz'2024-01-01 12:00:00' a, timestamp_ntz'2024-01-01' b")
    assert d.select(dates.difference(F.col("a"), F.col("b")).alias("x")).first()["x"] == -1


def test_numbers(spark):
    assert one(spark, "$ 1,234.50 USD", numbers.clean_number) == 1234.5
    assert one(spark, "n-a", numbers.clean_number) is None
    assert [one(spark, v, numbers.activity_level, "long") for v in (None, 0, 10, 50, 51)] == [None, "none", "low", "medium", "high"]
    assert one(spark, 1.0, numbers.histogram_bin, "double") == 20


def test_acronyms_and_compounds(spark):
    long = " ".join(["word"] * 20_000) + " Big Data " + " ".join(["ABC"] * 20_000)
    rows = {
        "SQL and SQL, API: one, NLP (Natural Language) once, XML": (["API", "NLP", "SQL"], ["Natural Language"]),
        "U.S.A. and USA; Data Lake1 Data": (["Data", "USA"], []),
        "the New York Times": ([], ["New York Times", "the New York Times"]),
        "IT Help Desk or HR IT": (["IT"], ["HR IT", "Help Desk", "IT Help Desk"]),
        None: ([], []),
    }
    d = spark.createDataFrame([(t,) for t in [*rows, long]], "t string").select("t", text.acronyms(F.col("t")).alias("a"), text.compound_terms(F.col("t")).alias("c"))
    got = {r["t"]: (r["a"], r["c"]) for r in d.collect()}
    assert "ABC" in got[long][0]
    for t, (a, c) in rows.items():
        assert got[t] == (a, c), t


def test_every_date_format(spark):
    """One text for each format, which no format before it reads otherwise."""
    from coursewright import config

    shown = {
        "yyyy-M-d": "2024-3-25", "d/M/yyyy": "25/3/2024", "M/d/yyyy": "3/25/2024", "yyyy/M/d": "2024/3/25", "d-M-yyyy": "25-3-2024", "M-d-yyyy": "3-25-2024", "yyyy.M.d": "2024.3.25", "d.M.yyyy": "25.3.2024",
        "M.d.yyyy": "3.25.2024", "d MMM yyyy": "25 Mar 2024", "MMM d yyyy": "Mar 25 2024", "d MMMM yyyy": "25 March 2024", "MMMM d yyyy": "March 25 2024", "yyyy-M-d H:m:s": "2024-3-25 0:0:0",
    }
    assert tuple(shown) == config.DATE_FORMATS
    d = spark.createDataFrame([(x,) for x in [*shown.values(), "soon", "NaT", "", None]], "c string").select("c", dates.parse_date(F.col("c")).alias("t"))
    got = {r["c"]: r["t"] for r in d.collect()}
    assert all(str(got[x])[:10] == "2024-03-25" for x in shown.values()) and not any(got[x] for x in ("soon", "NaT", "", None))
