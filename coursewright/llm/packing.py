"""Packing documents into training sequences by best-fit decreasing."""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursewright.functions.storage import cut_lineage
from coursewright.llm.common import arrow_map, table

CAPACITY = 1024
END_ID = 0
#: Fixed value: how byte-level BPE of this vocabulary splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.cache
def _added(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """A pattern of the file's added tokens, which stand for one id wherever they occur, and those ids."""
    added = _spec(path).get("added_tokens", ())
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError(f"{path}: added tokens that take in blanks or stand at word ends are not supported")
    ids = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
    return re.compile("(" + "|".join(re.escape(c) for c in sorted(ids, key=len, reverse=True)) + ")") if ids else None, ids


@functools.cache
def _encoder(path: str):
    """A byte-level BPE encoder for a tokenizers JSON file, for text between its added tokens."""
    import tiktoken

    spec = _spec(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class _Pieces(dict):
    """Ids, as little-endian 32-bit integers, of what stands between two single spaces."""

    def __init__(self, path: str, lead: str) -> None:
        super().__init__()
        self.encode, self.lead = _encoder(path).encode_ordinary, lead

    def __missing__(self, part: str) -> bytes:
        self[part] = ids = array("I", self.encode(self.lead + part)).tobytes()
        return ids


@functools.cache
def _tables(path: str) -> tuple[_Pieces, _Pieces]:
    return _Pieces(path, ""), _Pieces(path, " ")


_ODD_SPACE = re.compile(r" (?:\s|$)|(?:^|\s) ")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_MOST_CACHED = 300_000


def token_bytes(text: str, path: str) -> bytes:
    """The text's ids as little-endian 32-bit integers; an added token's string in the text is its id."""
    pattern, ids = _added(path)
    if pattern is None or not pattern.search(text):
        return _plain_bytes(text, path)
    return b"".join(ids[x] if k % 2 else _plain_bytes(x, path) for k, x in enumerate(pattern.split(text)))


def _plain_bytes(text: str, path: str) -> bytes:
    """Ids of a text without added tokens.

    A space between two other characters always begins a piece of the
    pre-tokenization, so the text may be cut there and each part looked up.
    """
    first, spaced = _tables(path)
    if not text:
        return b""
    parts = text.split(" ") if not _ODD_SPACE.search(text) else _SINGLE.split(text)
    out = b"".join([first[parts[0]], *map(spaced.__getitem__, parts[1:])])
    for t in (first, spaced):
        if len(t) > _MOST_CACHED:
            t.clear()
    return out


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Tokenize each document, append the end id, and cut it into full windows and a rest.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens``. Null and empty
    texts are the end id alone; repeated rows are packed as often as they
    occur; an empty table gives no pieces.
    """
    path = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, start, length, crc, total = [], [], [], [], []
        end = END_ID.to_bytes(4, "little")
        for k, text in enumerate(batch.column(1).to_pylist()):
            ids = memoryview(token_bytes(text or "", path) + end)
            n = len(ids) // 4
            for a in range(0, n, capacity):
                b = min(n, a + capacity)
                doc.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                total.append(n)
        ids = batch.column(0).take(pa.array(doc, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(d, run, f"doc_id {dict(d.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long")


class CapacityTree:
    """A segment tree over remaining capacities: which open window is the tightest."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, remaining: int, windows: int) -> None:
        k = remaining + self.width
        while k:
            self.open[k] += windows
            k //= 2

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of at least ``size`` that an open window has."""
        k = size + self.width
        if self.open[k]:
            return size
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.width
            k //= 2
        return None


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of piece lengths.

    Pieces of one length are alike, so a run of windows with one remaining
    capacity is filled in one step; the work depends on the capacity, not on
    the number of pieces. Returns steps ``(length, first rank, pieces per
    window, first window, offset)`` and the number of windows: the piece of
    rank r lies in window ``first + (r - first rank) // per`` at ``offset +
    (r - first rank) % per * length``.
    """
    tree, runs, steps, windows = CapacityTree(capacity), defaultdict(list), [], 0

    def put(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            tree.add(remaining, count)
            runs[remaining].append((first, count))

    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            remaining = tree.tightest(size)
            if remaining is None:
                remaining, per = capacity, capacity // size
                count = -(-left // per)
                first, windows = windows, windows + count
            else:
                first, count = runs[remaining].pop()
                tree.add(remaining, -count)
                per = remaining // size
            full = min(count, left // per)
            placed = full * per
            used = full
            rest = 0
            if full < count and left > placed:
                rest = min(per, left - placed)
                used += 1
            steps.append((size, rank, per, first, capacity - remaining))
            rank, left = rank + placed + rest, left - placed - rest
            put(remaining - per * size, first, full)
            if rest:
                put(remaining - rest * size, first + full, 1)
            put(remaining, first + used, count - used)
    return steps, windows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of ``length`` at most ``capacity``.

    Full pieces are sequences by themselves. The others get a rank among the
    pieces of their length, task by task of ``pieces`` and moved on by the
    tasks before, so no length is ranked in one task, however many pieces or
    repeated rows have it. Only the histogram, ``capacity`` rows at most,
    reaches the driver. ``pieces`` is evaluated once.
    """
    p = cut_lineage(pieces.withColumn("bucket", F.spark_partition_id()))
    parts = p.where(F.col("length") < capacity)
    counts = cut_lineage(parts.groupBy("length", "bucket").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    steps, windows = plan_windows(histogram, capacity)
    steps.sort()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = parts.withColumn("rank", F.row_number().over(within) - 1).join(moved, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = [c for c in p.columns if c != "bucket"]
    key = np.array([s[0] << 40 | s[1] for s in steps], dtype=np.int64)
    table_ = np.array(steps, dtype=np.int64).reshape(-1, 5)

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        s = table_[np.searchsorted(key, length << 40 | rank, side="right") - 1]
        k = rank - s[:, 1]
        out = [batch.column(c) for c in columns]
        yield pa.RecordBatch.from_arrays([*out, pa.array(s[:, 3] + k // s[:, 2]), pa.array(s[:, 4] + k % s[:, 2] * length)], names=[*columns, "sequence_id", "offset"])

    ranked = ranked.select(*columns, F.col("rank").cast("long"))
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank") + ", sequence_id long, offset long"
    full = p.where(F.col("length") == capacity).select(*columns, (F.monotonically_increasing_id() + windows).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return arrow_map(ranked, place, schema, rows=1 << 16).unionByName(full)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and where they lie; null texts are the end id alone, repeated rows are packed each."""
    return pack(cut_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of every document and where they lie.

    Null and empty texts are the end id alone; rows that repeat are packed as
    often; other columns are not read; an empty table gives no pieces.
    """
    return pack(cut_pieces(docs))
