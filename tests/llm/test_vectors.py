import numpy as np
import pytest

from coursewright.llm import vectors


@pytest.mark.parametrize("parts", [1, 5, 40, 70])
def test_sums_over_any_number_of_tasks(spark, parts):
    d = spark.range(0, 1000, 1, parts)

    def fn(batches):
        v = np.zeros(3)
        for b in batches:
            x = b.column(0).to_numpy()
            v += [len(x), x.sum(), 1]
        return v if v[0] else None

    assert vectors.sum_vectors(d, fn, 3)[:2].tolist() == [1000, 499500]
    assert vectors.sum_vectors(d.where("id < 0"), fn, 3).tolist() == [0, 0, 0]


def test_each_merging_task_has_its_own_partition(spark):
    from pyspark.sql import functions as F

    for n in (2, 3, 30, 119, 200):
        dealt = spark.range(0, 3 * n, 1, 4).withColumn("k", (F.col("id") % n).cast("int")).repartitionById(n, "k")
        got = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("k").alias("k")).collect()
        assert len(got) == n and all(r["k"] == 1 for r in got)


def test_half_floats_keep_range_and_sign(spark):
    d = spark.range(0, 40, 1, 20)
    v = np.array([1.0, -3e9, 2e-9, 0.0])
    got = vectors.sum_vectors(d, lambda b: v if sum(x.num_rows for x in b) else None, 4, "float32", "bfloat16")
    assert np.allclose(got, 20 * v, rtol=0.005)
