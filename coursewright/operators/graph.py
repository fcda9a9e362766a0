"""Connected components as iterated DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.functions.storage import cut_lineage, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every endpoint of ``edges`` with the smallest node of its component.

    Alternates large-star and small-star contractions, which need a number of
    rounds logarithmic in the component's diameter. Each round is one
    aggregation and one equi-join on the node, so a hub's edges are summed
    before they move and adaptive execution can split the join. Returns
    ``node, component`` (both of the type of ``src``). Self loops and null
    endpoints are ignored; an empty input gives no rows.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
        .where("hi > lo")
        .distinct()
    )
    e = cut_lineage(e)
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("p"))
            .select("p.hi", "p.lo")
            .where("hi > lo")
            .distinct()
        )
        e = cut_lineage(small)
        del both, low, large, small
        release(e.sparkSession)
        state = e.agg(F.count("*"), F.sum(F.col("lo").cast("decimal(38,0)")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"connected_components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
