"""Exact deduplication: sorted runs of digests, merged as a tree whose tasks exchange ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.functions.storage import cut_lineage
from coursewright.llm.common import BLANKS, table

#: Runs that a task merges in each round.
FAN_IN = 4
#: What texts are told apart by: 256 bits of digest, verified by 64 bits of another hash and the length.
KEY = ["digest", "check", "size"]


def without_blanks(text: Column) -> Column:
    """The text without the six ASCII blanks; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A compact row for each document, kept in the shared folder, so that texts are read and hashed once.

    ``task`` is the task that read it, ``row`` tells repeated rows apart;
    ``best`` orders rows: most code points first, then smallest id, null last.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), without_blanks(F.col(text_col)).alias("bare"))
    row = F.monotonically_increasing_id()
    best = F.struct((-F.length("text")).alias("chars"), F.col("id").isNull().alias("null"), F.col("id"), row.alias("row"))
    key = [F.unhex(F.sha2("bare", 256)).alias("digest"), F.xxhash64("bare").alias("check"), F.octet_length("bare").alias("size")]
    return cut_lineage(d.select(F.spark_partition_id().alias("task"), *key, best.alias("best")))


def _range(parts: int) -> Column:
    """Which of ``parts`` equal ranges of digests; digests are uniform, so the bounds need no sample."""
    top = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return F.floor(top * F.lit(parts) / F.lit(2**32)).cast("int")


def merge_runs(runs: DataFrame, parts: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge runs of ``part, digest, check, size, best, n`` into one entry a text, in rounds.

    The ``fan_in ** rounds`` partitions are numbers of so many digits. In
    round k those that differ in digit k alone exchange: each takes the k-th
    digit of the digests' range, so a partition merges ``fan_in`` sorted runs,
    keeps the least ``best`` of each verified digest, and after the last round
    partition p has the p-th range of all. No partition ever holds more than
    its share, and a text that very many rows have is one entry in each run.
    """
    rounds = _rounds(parts, fan_in)
    n = fan_in**rounds
    e = runs.withColumn("range", _range(n))
    for k in reversed(range(rounds)):
        unit = fan_in**k
        digit = lambda c: F.floor(F.col(c) / unit).cast("int") % fan_in
        e = e.withColumn("part", F.col("part") + (digit("range") - digit("part")) * unit)
        e = e.repartitionById(n, "part").sortWithinPartitions("part", *KEY)
        e = e.groupBy("part", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.first("range").alias("range"))
    return e


def _rounds(parts: int, fan_in: int) -> int:
    """Rounds, two at least, after which there are ``parts`` ranges or more."""
    rounds = 2
    while fan_in**rounds < parts:
        rounds += 1
    return rounds


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal when they are identical without ASCII blanks; of equal
    ones the row with the most code points stays, then that with the smallest
    id. Texts are equal if SHA-256, a second hash and the length agree.

    Each task's rows are reduced to one entry a text before they move; entries
    are merged by ``merge_runs``. What has copies goes back to the runs it
    came from, one row a run, and there to the rows, so that a text of very
    many rows is never joined in one task.

    Null texts count as empty, and all empty texts are one group. Null ids
    come after all others. Of rows that repeat id and text one is kept, the
    others are not, and all are counted. Other columns are not read; an empty
    table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = fan_in ** _rounds(parts, fan_in)
    rows = digest_runs(docs, id_col, text_col).withColumn("part", F.col("task") % n)
    runs = rows.groupBy("part", *KEY).agg(F.min("best").alias("best"), F.count("*").alias("n"))
    groups = merge_runs(runs, parts, fan_in).where("n > 1").select(*KEY, F.col("best").alias("keep"), F.col("n").alias("group_size"))
    back = runs.select("part", *KEY).join(groups, KEY)
    out = rows.join(back, ["part", *KEY], "left")
    alone = F.col("keep").isNull()
    return out.select(
        F.col("best.id").alias("id"),
        F.when(alone, F.col("best.id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts, and whether it is the row that stays."""
    return exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE = """
with d as (
  select doc_id, coalesce(text, '') as t,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as bare
  from documents
), ranked as (
  select doc_id, bare, count(*) over (partition by bare) as group_size,
         first_value(doc_id) over best as keep_id, row_number() over best as place
  from d window best as (partition by bare order by length(t) desc, doc_id nulls last)
)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(bare) as text_sha256 from ranked
"""
