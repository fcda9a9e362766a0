"""Date repair: invalid dates filled from other columns, from similar numbers and from the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright import config
from coursewright.functions.dates import micros, parse_date


def _middles(d: DataFrame, key: str, flags: dict[str, str]) -> DataFrame:
    """The median of each column's valid dates by key, in microseconds, as ``__m_<column>``.

    Equal dates are counted before they meet, so a key holds its distinct
    dates, however many rows have them.
    """
    valid = F.array(*[F.when(F.col(f), F.struct(F.lit(c).alias("c"), micros(F.col(c)).alias("t"))) for c, f in flags.items()])
    counts = d.where(F.col(key).isNotNull()).select(key, F.explode(F.filter(valid, lambda x: x.isNotNull())).alias("x")).select(key, "x.*").groupBy(key, "c", "t").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key, "c")
    upto = F.sum("n").over(w.orderBy("t"))
    ranked = counts.select(key, "c", "t", "n", upto.alias("upto"), F.sum("n").over(w).alias("all"))
    holds = lambda place: (F.col("upto") >= place) & (F.col("upto") - F.col("n") < place)
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    middle = (F.max(F.when(holds(low), F.col("t"))) + F.max(F.when(holds(high), F.col("t")))) / 2
    per = ranked.groupBy(key, "c").agg(middle.cast("bigint").alias("m"))
    return per.groupBy(key).agg(*[F.max(F.when(F.col("c") == c, F.col("m"))).alias(f"__m_{c}") for c in flags])


def _date(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def repair_dates(df: DataFrame, as_of: str) -> DataFrame:
    """Repair version, available and discontinued dates and add ``<column>_is_valid``.

    1. Dates outside 1990 to ten years after ``as_of`` are invalid, as is an
       end before its start. 2. Invalid dates take the first valid one of
       version, available, discontinued. 3. Then the median of valid dates with
       the same first four characters of the number. 4. A start still missing
       takes its source's median, or January 1 of the year before ``as_of``,
       and stays flagged. 5. A missing end is ten years after ``as_of``. 6. An
       end before its start is a year after it. Medians are small tables, one
       row per prefix or source, joined on that key.
    """
    version, start, end = config.DATE_COLUMNS
    now = F.lit(as_of).cast("timestamp_ntz")
    late = now + F.expr("interval 10 years")
    ok = lambda c: F.coalesce(F.col(c).between(F.lit("1990-01-01").cast("timestamp_ntz"), late), F.lit(False))
    flag = lambda c: f"{c}_is_valid"
    types = dict(df.dtypes)
    d = df.withColumns({c: parse_date(F.col(c)) if types.get(c) == "string" else F.col(c) for c in config.DATE_COLUMNS if c in types})
    d = d.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in config.DATE_COLUMNS if c not in types})
    d = d.withColumns({flag(c): ok(c) for c in config.DATE_COLUMNS})
    d = d.withColumn(flag(end), F.col(flag(end)) & ~F.coalesce(F.col(flag(start)) & (F.col(end) < F.col(start)), F.lit(False)))
    for c in config.DATE_COLUMNS:
        others = F.coalesce(*[F.when(F.col(flag(o)), F.col(o)) for o in config.DATE_COLUMNS if o != c])
        d = d.withColumn("__fill", others).withColumns({c: F.when(F.col(flag(c)), F.col(c)).otherwise(F.coalesce("__fill", c)), flag(c): F.col(flag(c)) | F.col("__fill").isNotNull()}).drop("__fill")
    d = d.withColumn("__prefix", F.substring("course_no", 1, 4))
    medians = _middles(d, "__prefix", {c: flag(c) for c in config.DATE_COLUMNS})
    d = d.join(medians, "__prefix", "left")
    for c in config.DATE_COLUMNS:
        m = _date(F.col(f"__m_{c}"))
        d = d.withColumns({c: F.when(F.col(flag(c)), F.col(c)).otherwise(F.coalesce(m, F.col(c))), flag(c): F.col(flag(c)) | m.isNotNull()})
    d = d.drop("__prefix", *[f"__m_{c}" for c in config.DATE_COLUMNS])
    source = _middles(d, "data_source", {start: flag(start)}).toDF("__source", "__m")
    d = d.join(source, F.col("data_source") == F.col("__source"), "left")
    new_year = F.trunc(F.add_months(now.cast("date"), -12), "year").cast("timestamp_ntz")
    d = d.withColumn(start, F.when(F.col(flag(start)), F.col(start)).otherwise(F.coalesce(_date(F.col("__m")), new_year))).drop("__source", "__m")
    d = d.withColumns({end: F.when(F.col(flag(end)), F.col(end)).otherwise(late), flag(end): F.lit(True)})
    return d.withColumn(end, F.when(F.col(end) < F.col(start), F.col(start) + F.expr("interval 1 year")).otherwise(F.col(end)))
