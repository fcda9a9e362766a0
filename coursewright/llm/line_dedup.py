"""Line deduplication: sorted line hashes in, keep bitmaps out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursewright.llm.common import BLANKS, ascii_lower, table


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


#: Ranges of the line hashes in the first sort; a key's rows are dealt over a number of document groups that grows with the partitions.
RANGES = 8


def _range_of(h: str, parts: int) -> Column:
    """Which of ``parts`` equal ranges of 64-bit hashes; hashes are uniform, so no sample is needed for the bounds."""
    return F.floor((F.col(h).cast("double") / F.lit(2.0**64) + F.lit(0.5)) * parts).cast("int")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Documents that lose lines, each with its dropped positions and its keep bitmap.

    A line's key is the line stripped of ASCII blanks with A-Z in lower case.
    A key of at least ``min_chars`` code points that several documents hold
    stays only in the smallest id. Keys travel as 128 bits of hash, not text.

    Rows are range-partitioned by hash, each range split by document group, and
    sorted by hash, document and position. A pass over a sorted partition drops
    what follows a key's first document. Only lines of first documents go on,
    one document a key and group; they are range-partitioned and sorted once
    more, and a second pass finds which are not the first of all groups. So a
    key that a third of all documents hold is spread over the groups, whose
    number grows with the partitions, and no key is gathered.

    Returns ``id, sig, dropped array<int>, keep_rle``; ``sig`` is the text's
    hash, which tells rows of one id apart. ``keep_rle`` is the bitmap as run
    lengths that begin with dropped lines: ``0,2,1,5`` keeps 2, drops 1, keeps 5.
    Null ids count as one document after all others. Null texts and texts
    without a shared line give no row; rows that repeat id and text share one
    bitmap; an empty table gives none; other columns are not read.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = -(-parts // RANGES)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sig"), _lines(F.col(text_col)).alias("lines"))
    keyed = (
        base.select("id", "sig", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
        .withColumn("key", _key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("id", "sig", "n", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    keyed = keyed.withColumn("part", _range_of("h1", RANGES) * groups + F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    first = lambda *keys: F.first("id").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("id"), "pos").rowsBetween(Window.unboundedPreceding, 0))
    local = keyed.repartitionById(RANGES * groups, "part").withColumn("first_id", first("part", "h1", "h2"))
    later = ~F.col("id").eqNullSafe(F.col("first_id"))
    row = ["id", "sig", "n", "pos"]
    firsts = local.where(~later).select(*row, "h1", "h2", _range_of("h1", parts).alias("range"))
    firsts = firsts.repartitionById(parts, "range").withColumn("first_id", first("range", "h1", "h2"))
    dropped = local.where(later).select(*row).union(firsts.where(later).select(*row))
    per_doc = dropped.groupBy("id", "sig").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("pos")).alias("dropped"))
    kept = kept_runs("dropped", "n")
    ends = F.transform("kept", lambda r: r["e"])
    steps = F.zip_with("kept", F.concat(F.array(F.lit(0)), ends), lambda r, last: F.when(r.isNotNull(), F.array(r["s"] - last, r["e"] - r["s"])).otherwise(F.array(F.col("n") - last)))
    per_doc = per_doc.withColumn("kept", kept).withColumn("steps", F.flatten(steps))
    shut = F.when(F.element_at("steps", -1) == 0, F.slice("steps", 1, F.size("steps") - 1)).otherwise(F.col("steps"))
    return per_doc.select("id", "sig", "dropped", F.array_join(shut.cast("array<string>"), ",").alias("keep_rle"))


def kept_runs(dropped: str, n: str) -> Column:
    """Runs (s, e) of lines between the dropped ones, e exclusive, none empty."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda d: d + 1))
    ends = F.concat(F.col(dropped), F.array(F.col(n)))
    return F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: r["e"] > r["s"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``kept_lines``, ``n_lines`` and ``n_dropped`` (and ``keep_rle``) to each document.

    A document without a bitmap keeps all its lines. Its text is split once
    and put together from the kept runs, in time linear in its lines.
    """
    marks = bitmaps.select(F.col("id").alias("__id"), F.col("sig").alias("__sig"), F.col("dropped").alias("__dropped"), F.col("keep_rle").alias("keep_rle"))
    d = docs.drop("keep_rle").withColumn("__s", F.xxhash64(text_col)).join(marks, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__s") == F.col("__sig")), "left")
    d = d.withColumn("__lines", _lines(F.col(text_col))).withColumn("n_lines", F.size("__lines").cast("long"))
    d = d.withColumn("n_lines_int", F.size("__lines"))
    kept = F.flatten(
        F.transform(kept_runs("__dropped", "n_lines_int"), lambda r: F.slice(F.col("__lines"), r["s"] + 1, r["e"] - r["s"]))
    )
    return (
        d.withColumn("kept_lines", F.when(F.col("__dropped").isNull(), F.col("__lines")).otherwise(kept))
        .withColumn("n_dropped", F.when(F.col("__dropped").isNull(), F.lit(0)).otherwise(F.size("__dropped")).cast("long"))
        .withColumn("keep_rle", F.coalesce("keep_rle", F.concat(F.lit("0,"), F.col("n_lines").cast("string"))))
        .drop("__id", "__sig", "__s", "__dropped", "__lines", "n_lines_int")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines, digest of what is kept and keep bitmap of every document; null texts are one empty line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"), "keep_rle")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, with only its first occurrences of shared lines and all its columns.

    ``n_chars`` follows a text that loses lines; a null text stays null. A
    document that loses all its lines stays, with an empty text. Rows that
    repeat id and text keep the same lines; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    out = apply_bitmaps(rows, keep_bitmaps(docs))
    lost = F.col("n_dropped") > 0
    text = F.when(lost, F.array_join("kept_lines", "\n")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(lost, F.length(text)).otherwise(F.col("__row.n_chars")).cast("long")} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents
), keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), first as (
  select k, min(doc_id) as first_id from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), marked as (
  select keyed.doc_id, pos, line, (first_id is not null and keyed.doc_id <> first_id) as gone
  from keyed left join first on keyed.k = first.k
), runs as (
  select doc_id, pos, gone, pos - row_number() over (partition by doc_id, gone order by pos) as grp from marked
), lens as (
  select doc_id, gone, min(pos) as p, count(*) as n from runs group by doc_id, gone, grp
), rle as (
  select doc_id, (case when min_by(gone, p) then '' else '0,' end) || string_agg(cast(n as varchar), ',' order by p) as keep_rle
  from lens group by doc_id
)
select m.doc_id, count(*) as n_lines, cast(sum(cast(gone as int)) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256,
       any_value(r.keep_rle) as keep_rle
from marked m join rle r using (doc_id)
group by m.doc_id
"""
