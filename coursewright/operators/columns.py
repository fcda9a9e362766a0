"""Column hygiene: names are settled while the plan is built, fill ratios by one aggregate."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright import config
from coursewright.operators.quantiles import smallest

#: Share of rows below which an unnamed column is dropped.
SPARSE = 0.05
#: Words looked for in a nameless column's first values.
KEYWORDS = ("course", "title", "id", "date", "type", "category", "region")


def tidy_name(name: str) -> str:
    """Stripped, lower-case, other signs to one underscore, none at the edges."""
    return re.sub(r"_+", "_", re.sub(r"[^\w]", "_", name.strip().lower())).strip("_")


def tidy_names(df: DataFrame) -> DataFrame:
    """Tidy all names; a name that comes up again gets a running suffix."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = "unnamed: " + c.split(":")[-1].strip() if c.strip().lower().startswith("unnamed:") else tidy_name(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n] - 1}")
    return df.toDF(*names)


def apply_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]] = config.ALIASES) -> DataFrame:
    """Rename the first alias present to its standard name unless that is taken; further aliases stay."""
    taken, renames = set(df.columns), {}
    for standard, others in aliases.items():
        if standard in taken:
            continue
        for a in others:
            if a in taken and a not in renames:
                renames[a] = standard
                taken.add(standard)
                break
    return df.withColumnsRenamed(renames)


def standardize(df: DataFrame) -> DataFrame:
    return apply_aliases(tidy_names(df))


def column_type(name: str) -> str:
    """The Spark type of a standard column; text unless listed."""
    return config.COLUMN_TYPES.get(name, "string")


def is_required(name: str) -> bool:
    return name in config.REQUIRED_COLUMNS


def add_missing(df: DataFrame, columns: tuple[str, ...] = config.REQUIRED_COLUMNS) -> DataFrame:
    """Add required columns that are absent, as nulls of their type."""
    return df.withColumns({c: F.lit(None).cast(config.COLUMN_TYPES.get(c, "string")) for c in columns if c not in df.columns})


def cast_types(df: DataFrame, types: dict[str, str] = config.COLUMN_TYPES) -> DataFrame:
    """Cast known columns; values that do not fit become null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower().startswith("unnamed:")])


def settle_unnamed(df: DataFrame, sparse: float = SPARSE) -> DataFrame:
    """Drop unnamed columns with few values; name the others by the words in their first ten values, or by place.

    Two jobs, however many columns there are: one counts, one takes the first values of all.
    """
    unnamed = [c for c in df.columns if c.lower().startswith("unnamed:")]
    if not unnamed:
        return df
    filled = lambda c: F.trim(F.col(f"`{c}`").cast("string")) != ""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(filled(c)).alias(f"c{k}") for k, c in enumerate(unnamed)]).first()
    kept = [k for k in range(len(unnamed)) if counts["n"] and counts[f"c{k}"] >= max(sparse * counts["n"], 1)]
    samples: dict[int, list[str]] = {k: [] for k in kept}
    if kept:
        # the first values of all columns at once, in the order of the rows
        values = F.array(*[F.struct(F.lit(k).alias("k"), F.when(filled(unnamed[k]), F.lower(F.col(f"`{unnamed[k]}`").cast("string"))).alias("v")) for k in kept])
        long = df.select(F.monotonically_increasing_id().alias("at"), F.explode(values).alias("x")).select("at", "x.k", "x.v").where("v is not null")
        for r in smallest(long, "k", ("at",), 10, 10, salts=1).orderBy("k", "at").collect():
            samples[r["k"]].append(r["v"])
    out, names = df, set(df.columns)
    for k, c in enumerate(unnamed):
        if k not in samples:
            out = out.drop(c)
            continue
        sample = " ".join(samples[k])
        found = [w for w in KEYWORDS if w in sample]
        name = f"inferred_{'_'.join(found)}" if found else f"data_column_{k}"
        while name in names:
            name += "_2"
        names.add(name)
        out = out.withColumnRenamed(c, name)
    return out


def null_tokens(df: DataFrame, tokens: tuple[str, ...] = config.NA_TOKENS) -> DataFrame:
    """Texts that mean a missing value become null."""
    strings = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(F.trim(F.col(f"`{c}`")).isin(*tokens), None).otherwise(F.col(f"`{c}`")) for c in strings})


def fill_category(df: DataFrame, column: str = "category_name") -> DataFrame:
    c = F.trim(F.col(column))
    return df.withColumn(column, F.when(c.isNull() | (c == "") | (F.lower(c) == "nan"), "Uncategorized").otherwise(c))


def fill_counts(df: DataFrame, columns: tuple[str, ...] = ("learner_count", "total_2024_activity")) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns if c in df.columns})


def fill_missing(df: DataFrame, how: dict[str, str | int | float], as_of: str | None = None) -> DataFrame:
    """Fill columns by ``how``, or with a value; statistics come from one aggregate.

    Numbers: zero, mean, median, or ``default`` for the column's own. Dates:
    today (``as_of``), min, max. Texts: the value given, blanks included.
    """
    types = dict(df.dtypes)
    dates = {c for c in how if types.get(c, "").startswith(("date", "timestamp"))}
    of = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}
    stats = {c: m for c, m in how.items() if m in of and types[c] != "string"}
    values = df.agg(*[of[m](c).alias(c) for c, m in stats.items()]).first() if stats else {}

    def value(c: str, m: str | int | float):
        if c in stats:
            return values[c]
        if c in dates and m == "today":
            return as_of
        return 0 if m == "zero" else config.MISSING_DEFAULTS.get(c) if m == "default" else m

    filled = {c: v for c, m in how.items() if c in df.columns and (v := value(c, m)) is not None}
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if types[c] == "string" else F.col(c)
    return df.withColumns({c: F.coalesce(blank(c), F.lit(v).cast(types[c])) for c, v in filled.items()})


def fill_ratios(df: DataFrame) -> DataFrame:
    """``column, present, missing, share`` of every column, from one pass."""
    row = F.struct(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns)])
    one = df.agg(row.alias("r"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r.c{k}").alias("present"), F.col("r.n").alias("n")) for k, c in enumerate(df.columns)])
    x = one.select(F.explode(rows).alias("x")).select("x.*")
    return x.select("column", "present", (F.col("n") - F.col("present")).alias("missing"), F.round(F.try_divide(F.col("present") * 100.0, "n"), 4).alias("pct"))


def joins_between(schemas: dict[str, list[str]]) -> list[tuple[str, str, str, str, float]]:
    """Ways to join tables by their column names: (left, right, kind, columns, confidence)."""
    out = []
    names = sorted(schemas)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            both = [c for c in schemas[a] if c in schemas[b]]
            out += [(a, b, "primary_key_join", c, 0.9) for c in both if c.endswith(("_id", "_no")) or c == "id"]
            out += [(a, b, "categorical_join", c, 0.6) for c in both if c.endswith(("_name", "_type"))]
            time = [c for c in both if c.endswith(("_from", "_date")) or c == "last_updated"]
            if "region_entity" in both:
                out += [(a, b, "composite_join", f"region_entity,{c}", 0.7) for c in time]
    return out


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of all sources with the union of their columns, tagged with source and its rank."""
    tagged = [d.withColumn("data_source", F.lit(n)).withColumn("source_rank", F.lit(k)) for k, (n, d) in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def synthetic_keys(df: DataFrame, key: str = "course_no") -> DataFrame:
    """Give rows of a table without course numbers a key from source and row number."""
    made = F.concat_ws("_", F.lit("file"), F.col("source_rank").cast("string"), F.col("row_no").cast("string"))
    return df.withColumn(key, F.coalesce(key, made) if key in df.columns else made)
