"""Every two rows side by side: rows lie in packed blocks, and a task reads the blocks of two partitions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions.storage import cut_lineage, release

#: Blocks of a partition, about: a task holds those of one partition and compares them with those of another.
HELD = 8
#: Blocks that small tables are cut into, so that all cores have work, and partitions that they lie in.
FEWEST, SPREAD = 24, 8
#: Number of a partition's first block, times the partition.
FIRST = (1 << 20) + 1

X = TypeVar("X")


def block_pairs(rows: DataFrame, prepare: Callable[[pa.Table], X], compare: Callable[[X, X, bool], Iterator[pa.RecordBatch]], schema: str, block: int, order: tuple[str, ...] = (), meets: Callable[..., Column] | None = None, chained: bool = False) -> DataFrame:
    """``compare(a, b, same)`` of every two blocks of at most ``block`` rows, each pair once, and of each with itself.

    Rows are shuffled once, into blocks that lie as Arrow tables in the shared
    folder; ``order`` puts rows with near values into one block. A task reads
    two partitions of blocks and yields what ``compare`` makes of them, so
    pairs are neither shuffled nor stored, and copies of rows are never
    written. ``prepare`` is applied once to each block that a task reads, of
    which it holds at most ``2 * HELD`` beside its own. ``meets`` tells of the
    least and the largest value of the first column of ``order`` in either
    block whether two blocks need be compared. ``chained`` compares a block
    with itself and the one after it alone, so the work grows with the rows.
    """
    n = rows.count()
    size = max(1, min(block, math.ceil(n / FEWEST)))
    count = max(1, math.ceil(n / size))
    parts = max(min(SPREAD, count), math.ceil(count / HELD))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order) if order else rows.repartition(parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held, m = TaskContext.get().partitionId() * FIRST, [], 0

        def packed(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, tables[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(tables).combine_chunks())
            ends = [pc.min_max(pa.chunked_array([t.column(t.schema.names.index(order[0])) for t in tables]))] if meets else []
            ends = [pa.array([e[m].as_py()], e[m].type) for e in ends for m in ("min", "max")]
            return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), *ends], names=["k", "rows", "low", "high"][: 2 + len(ends)])

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, size - m)
                held.append(part)
                at, m = at + part.num_rows, m + part.num_rows
                if m == size:
                    yield packed(held)
                    k, held, m = k + 1, [], 0
        if held:
            yield packed(held)

    kind = dict(rows.dtypes)[order[0]] if meets else ""
    blocks = cut_lineage(dealt.mapInArrow(pack, "k long, rows binary" + (f", low {kind}, high {kind}" if meets else "")))
    del dealt
    release(rows.sparkSession)
    turn = F.when((F.col("i") + F.col("j")) % 2 == 0, F.col("i") <= F.col("j")).otherwise(F.col("i") > F.col("j"))
    if chained:
        after = F.explode(F.array("k", F.col("k") + 1, F.when(F.col("k") % FIRST == 0, F.col("k") + FIRST)))
        pairs = blocks.select(F.col("k").alias("i"), F.col("rows").alias("a"), after.alias("j")).join(blocks.toDF("j", "b"), "j").select("i", "a", "j", "b")
    elif meets:
        near = meets(*[F.col(c) for c in ("low_i", "high_i", "low_j", "high_j")])
        pairs = blocks.toDF("i", "a", "low_i", "high_i").join(blocks.toDF("j", "b", "low_j", "high_j").hint("shuffle_replicate_nl"), turn & near).select("i", "a", "j", "b")
    else:
        pairs = blocks.toDF("i", "a").join(blocks.toDF("j", "b").hint("shuffle_replicate_nl"), turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x, held = None, None, {}
        read = lambda rows: prepare(pa.ipc.open_stream(rows.as_buffer()).read_all().combine_chunks())
        for batch in batches:
            for i, a, j, b in zip(*batch.columns):
                i, j = i.as_py(), j.as_py()
                if i != last:
                    last, x = i, held[i] if i in held else read(a)
                y = x if i == j else held[j] if j in held else read(b)
                if len(held) < 2 * HELD:
                    held[j] = y
                yield from compare(x, y, i == j)

    return pairs.mapInArrow(run, schema)
