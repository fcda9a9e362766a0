"""Order over whole tables without a task that sees all rows: exact quantiles, first rows of groups, neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.functions.storage import cut_lineage


def quantiles(df: DataFrame, value: str | Column, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``n`` and ``q0``, ``q1``, ... : exact quantiles with linear interpolation, as doubles.

    Equal values are counted first; the counts are range-partitioned by group
    and value and sorted, so a group of very many values lies in many tasks.
    The sums of each group's part in each partition, a row apiece, give where
    a partition's ranks begin, and each wanted rank is found where it falls.
    Null values are left out; a group that has no other gets nulls.
    """
    spark = df.sparkSession
    keys = [f"g{k}" for k in range(len(by))]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], v.alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(counts.repartitionByRange(parts, *keys, "v").withColumn("part", F.spark_partition_id()))
    size = F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0))
    whole = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    sums = dealt.groupBy(*keys, "part").agg(size.alias("s"))
    sums = sums.select(*[F.col(k).alias(f"h{k}") for k in keys], F.col("part").alias("at"), F.coalesce(F.sum("s").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(whole).alias("n"))
    same = F.col("part") == F.col("at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"h{k}"))
    x = dealt.join(sums, same)
    inside = Window.partitionBy("part", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("upto", F.col("before") + F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).over(inside))
    found = []
    for j, q in enumerate(shares):
        place = (F.col("n") - 1) * F.lit(float(q))
        for name, rank in ((f"lo{j}", F.floor(place)), (f"hi{j}", F.ceil(place))):
            holds = F.col("v").isNotNull() & (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c"))
            found.append(F.max(F.when(holds, F.col("v"))).alias(name))
    per = x.groupBy(*keys).agg(F.max("n").cast("long").alias("n"), *found)
    part = lambda q: (F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q)))
    between = lambda j, q: F.col(f"lo{j}") + (F.col(f"hi{j}") - F.col(f"lo{j}")) * part(q)
    return per.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", *[between(j, q).alias(f"q{j}") for j, q in enumerate(shares)])


def smallest(df: DataFrame, by: str, order: tuple[str, ...], k: int | Column, most: int, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group of ``by`` in the order of ``order``, at most ``most`` each.

    Ranks are cut twice: within parts of a group, where Spark keeps ``most``
    rows of each task before the shuffle, and then among what is left, at most
    ``most`` rows of each part. Row counts do not otherwise enter a task.
    """
    d = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(salts)))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    near = d.withColumn("__r", rank(by, "__part")).where(F.col("__r") <= most).drop("__r", "__part")
    limit = F.lit(k) if isinstance(k, int) else k
    return near.withColumn("__r", rank(by)).where((F.col("__r") <= most) & (F.col("__r") <= limit)).drop("__r")


def with_next(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the next larger value of a column of distinct values; null for the largest.

    Rows are range-partitioned and sorted; the last of a partition gets the
    first of the next, from a row for each partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(parts, column).withColumn("__part", F.spark_partition_id()))
    firsts = dealt.groupBy("__part").agg(F.min(column).alias("__first"))
    after = firsts.select("__part", F.lead("__first").over(Window.partitionBy(F.lit(0)).orderBy("__part")).alias("__after"))
    inside = F.lead(column).over(Window.partitionBy("__part").orderBy(column))
    return dealt.withColumn(name, inside).join(F.broadcast(after), "__part").withColumn(name, F.coalesce(name, "__after")).drop("__part", "__after")


def share_of(size: int, n: int) -> float:
    """A share of ``n`` uniform hashes that holds ``size`` of them but for one case in a billion."""
    return 1.0 if n <= 0 else min(1.0, (size + 6 * math.sqrt(size) + 36) / n)
