"""Sums of dense vectors that tasks compute: merged on executors, few reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that one merging task reads, and that the driver gets, at most.
FAN_IN, MERGED = 16, 4


def sum_vectors(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int, dtype: str = "float64", sent: str | None = None, tasks: int | None = None) -> np.ndarray:
    """Sum over all tasks of the vector of ``size`` that ``fn`` makes of a task's batches.

    Tasks send their vector as bytes of type ``sent`` (``dtype`` unless
    given, or ``bfloat16``). The sums are formed as a tree: each merging task
    reads at most ``FAN_IN`` vectors, one after the other, and holds one, so
    neither it nor the driver depends on the number of tasks. Pass ``tasks`` where ``df`` is not a plain scan, since
    counting its partitions would run it.
    """
    wire = sent or dtype
    n = tasks or df.rdd.getNumPartitions()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = fn(batches)
        if v is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(v, wire)], pa.binary())], names=["v"])

    def merge(wire: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros(size, dtype), False
            for b in batches:
                for v in b.column("v"):
                    total += _unpacked(v.as_buffer(), wire)
                    some = True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

        return run

    vectors = df.mapInArrow(each, "v binary")
    while True:
        n = max(1, -(-n // FAN_IN))
        keyed = vectors.withColumn("k", F.spark_partition_id() % n)
        vectors = keyed.repartitionById(n, "k").select("v").mapInArrow(merge(wire), "v binary")
        wire = dtype
        if n <= MERGED:
            break
    rows = vectors.collect()
    return np.sum([np.frombuffer(r["v"], dtype) for r in rows], axis=0) if rows else np.zeros(size, dtype)


def _packed(v: np.ndarray, kind: str) -> bytes:
    """The vector's bytes; ``bfloat16`` is the upper half of 32-bit floats, rounded."""
    if kind != "bfloat16":
        return v.astype(kind).tobytes()
    return ((v.astype("float32").view("uint32") + np.uint32(0x8000)) >> np.uint32(16)).astype("uint16").tobytes()


def _unpacked(b: pa.Buffer, kind: str) -> np.ndarray:
    if kind != "bfloat16":
        return np.frombuffer(b, kind)
    return (np.frombuffer(b, "uint16").astype("uint32") << np.uint32(16)).view("float32")
