"""Aligning the tokens of two tokenizers by an associative product of byte-range fragments."""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.functions.storage import cut_lineage, stored
from coursewright.llm.common import table
from coursewright.llm.packing import _encoder, default_vocabulary

#: Bytes of a range; texts up to this long are one range.
CHUNK = 1 << 15
#: A range may end within a unit of at most so many bytes; a longer one stays in the range it begins in.
LONG_UNIT = 1 << 12
#: Fragments that one step of the tree composes.
FAN_IN = 8
#: Bits of the second id in a pair.
SECOND = 20
#: Most id pairs whose counts are broadcast, the most frequent ones; all others are joined.
FREQUENT = 1 << 15
#: Units whose ids a task remembers.
REMEMBERED = 120_000
#: Both tokenizers begin a token at a single space between two other characters.
UNIT = re.compile(r"(?<=\S) (?=\S)")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclasses.dataclass
class Tokens:
    """Ids of both tokenizers with the byte offsets at which they end."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(self, f.name), getattr(other, f.name)]) for f in dataclasses.fields(Tokens)))

    def moved(self, by: int) -> Tokens:
        return Tokens(self.a, self.a_end + by, self.b, self.b_end + by)

    def between(self, after: int, upto: int) -> Tokens:
        """Tokens that end in a range, as offsets from where it begins."""
        (i, j), (k, m) = (np.searchsorted(e, [after, upto], "right") for e in (self.a_end, self.b_end))
        return Tokens(self.a[i:j], self.a_end[i:j] - after, self.b[k:m], self.b_end[k:m] - after)


NONE = np.zeros(0, np.int64)


@dataclasses.dataclass
class Closed:
    """What is kept of closed groups: their number and tokens, text, and linked id pairs with counts."""

    n_groups: int
    n_a: int
    n_b: int
    text: bytes
    pairs: np.ndarray
    counts: np.ndarray

    def __add__(self, other: Closed) -> Closed:
        if not self.n_groups or not other.n_groups:
            return self if self.n_groups else other
        pairs, inverse = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, inverse, np.concatenate([self.counts, other.counts]))
        return Closed(self.n_groups + other.n_groups, self.n_a + other.n_a, self.n_b + other.n_b, self.text + b";" + other.text, pairs, counts)


NOTHING = Closed(0, 0, 0, b"", NONE, NONE)


@functools.cache
def _written(vocabulary: str, pieces: str) -> tuple[np.ndarray, int]:
    """Each id in decimal with the sign after it, inside a list and at its end; where those of the second tokenizer begin."""
    n, m = _encoder(vocabulary).max_token_value + 1, _pieces(pieces).get_piece_size()
    return np.array([f"{k}{s}" for size, signs in ((n, ",|"), (m, ",;")) for k in range(size) for s in signs], object), 2 * n


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What two rising sequences share."""
    if not len(b):
        return b
    return a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a]


def close(t: Tokens, vocabulary: str, pieces: str) -> Closed:
    """The groups of tokens that reach from a cut to a cut.

    Two tokens overlap in exactly one of the stretches between neighbouring
    ends of either tokenizer, so each stretch is a link.
    """
    if not len(t.a):
        return NOTHING
    cuts = _common(t.a_end, t.b_end)
    group_a, group_b = np.searchsorted(cuts, t.a_end), np.searchsorted(cuts, t.b_end)
    written, second = _written(vocabulary, pieces)
    last = lambda g: np.append(g[1:] != g[:-1], True)
    order = np.empty(len(t.a) + len(t.b), np.int64)
    order[np.arange(len(t.a)) + np.searchsorted(group_b, group_a)] = 2 * t.a + last(group_a)
    order[np.arange(len(t.b)) + np.searchsorted(group_a, group_b, "right")] = second + 2 * t.b + last(group_b)
    text = "".join(written[order].tolist())[:-1].encode()
    ends = np.sort(np.concatenate([t.a_end, t.b_end]), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])]
    links = t.a[np.searchsorted(t.a_end, ends)] << SECOND | t.b[np.searchsorted(t.b_end, ends)]
    pairs, counts = np.unique(links, return_counts=True)
    return Closed(len(cuts), len(t.a), len(t.b), text, pairs, counts)


@dataclasses.dataclass
class Fragment:
    """What a byte range of a text tells: tokens before its first cut, closed groups, tokens after its last cut.

    A token belongs to the range in which it ends; a cut is an offset at
    which tokens of both end. Without a cut all tokens are in ``head``. Ends
    in ``head`` count from where the range begins, those in ``tail`` from the
    last cut, which is ``tail_length`` bytes before the range's end.
    """

    length: int
    cut: bool
    broken: bool
    head: Tokens
    closed: Closed
    tail: Tokens
    tail_length: int

    def then(self, other: Fragment, vocabulary: str, pieces: str) -> Fragment:
        """The fragment of this range and the one after it; associative."""
        length, broken = self.length + other.length, self.broken or other.broken
        if not self.cut:
            return Fragment(length, other.cut, broken, self.head + other.head.moved(self.length), other.closed, other.tail, other.tail_length)
        open_ = self.tail + other.head.moved(self.tail_length)
        if not other.cut:
            return Fragment(length, True, broken, self.head, self.closed, open_, self.tail_length + other.length)
        closed = self.closed + close(open_, vocabulary, pieces) + other.closed
        return Fragment(length, True, broken, self.head, closed, other.tail, other.tail_length)


def empty() -> Fragment:
    """The neutral fragment."""
    none = Tokens(NONE, NONE, NONE, NONE)
    return Fragment(0, False, False, none, NOTHING, none, 0)


def compose(fragments: Iterable[Fragment], vocabulary: str, pieces: str) -> Fragment:
    """The product of neighbouring fragments, by halves."""
    level = list(fragments) or [empty()]
    while len(level) > 1:
        level = [level[k].then(level[k + 1], vocabulary, pieces) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


@functools.cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def _byte_tables(vocabulary: str, pieces: str) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """Bytes of the tokens of both, by id, and their lengths."""
    e, sp = _encoder(vocabulary), _pieces(pieces)
    a = [b""] * (e.max_token_value + 1)
    for word in e.token_byte_values():
        a[e.encode_single_token(word)] = word
    b = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode() for k in range(sp.get_piece_size()) for p in [sp.id_to_piece(k)]]
    size = lambda ws: np.array([len(w) for w in ws], np.int64)
    return a, b, size(a), size(b)


class Units(dict):
    """Ids of both tokenizers, as bytes, of units: what stands between two single spaces, with the space before it.

    No token of either goes on over such a space: the first tokenizer splits
    there, the second has no piece with a blank after another character,
    which is checked; without that, whole texts are units. New units of a
    text are encoded together for the same reason. ``broken`` has those
    whose tokens' bytes differ from theirs.
    """

    def __init__(self, vocabulary: str, pieces: str) -> None:
        super().__init__()
        self.first, self.second = _encoder(vocabulary).encode_ordinary, _pieces(pieces).encode
        self.bytes_a, self.bytes_b, self.size_a, self.size_b = _byte_tables(vocabulary, pieces)
        self.broken: set[str] = set()
        self.whole = any(re.search("[^▁]▁", _pieces(pieces).id_to_piece(k)) for k in range(len(self.bytes_b)))
        self.split = (lambda text: [text]) if self.whole else UNIT.split

    def learn(self, words: list[str]) -> None:
        """Encode the units of a text that are new; only the first and the last can begin or end with a blank."""
        units = set(words)
        new = [u for u in units if u not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            self.broken.clear()
            new = list(units)
        edges = {u for u in (words[0], words[-1]) if u.strip() != u or not u}
        plain = [] if self.whole else [u for u in new if u not in edges]
        if plain and self._together(plain):
            new = [u for u in new if u not in self]
        for u in new:
            full = " " + u
            a, b = self.first(full), self.second(u)
            self[u] = array("i", a).tobytes(), array("i", b).tobytes()
            if b"".join([self.bytes_b[x] for x in b]) != full.encode():
                self.broken.add(u)

    def _together(self, units: list[str]) -> bool:
        """Encode units in one text and cut the ids at their ends; False if that text is broken."""
        text = " ".join(units)
        full = (" " + text).encode()
        a, b = np.array(self.first(" " + text), np.int32), self.second(text)
        if b"".join([self.bytes_b[x] for x in b]) != full:
            return False
        b = np.array(b, np.int32)
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        cut = [np.searchsorted(size[x].cumsum(), ends, "right").tolist() for x, size in ((a, self.size_a), (b, self.size_b))]
        i = j = 0
        a, b = a.tobytes(), b.tobytes()
        for u, m, n in zip(units, *cut):
            self[u] = a[4 * i : 4 * m], b[4 * j : 4 * n]
            i, j = m, n
        return True


@functools.cache
def _units(vocabulary: str, pieces: str) -> Units:
    return Units(vocabulary, pieces)


def fragment(text: str, left: int, right: int, vocabulary: str, pieces: str) -> Fragment:
    """The fragment of bytes ``left`` to ``right`` of space + ``text``, from the ids of its units."""
    units = _units(vocabulary, pieces)
    words = units.split(text)
    units.learn(words)
    none, length = Tokens(NONE, NONE, NONE, NONE), right - left
    if units.broken and not units.broken.isdisjoint(words):
        return Fragment(length, False, True, none, NOTHING, none, 0)
    got = [units[w] for w in words]
    a, b = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in zip(*got))
    t = Tokens(a, units.size_a[a].cumsum(), b, units.size_b[b].cumsum())
    if left or right < t.a_end[-1]:
        t = t.between(left, right)
    cuts = _common(t.a_end, t.b_end)
    if not len(cuts):
        return Fragment(length, False, False, t, NOTHING, none, 0)
    first, last = int(cuts[0]), int(cuts[-1])
    tail = t.between(last, length) if last < length else none
    return Fragment(length, True, False, t.between(0, first), close(t.between(first, last), vocabulary, pieces), tail, length - last)


def ranges(text: str, chunk: int, long_unit: int = LONG_UNIT, split=UNIT.split) -> Iterator[tuple[int, str, int, int]]:
    """Cut space + ``text`` into byte ranges: number, the units that it touches, where it begins and ends in them.

    Ranges end at multiples of ``chunk``, also within a word or character;
    only where that falls into a unit of over ``long_unit`` bytes, at that
    unit's end, as its tokens cannot be found from a part of it.
    """
    units = split(text)
    end = np.cumsum([len(u.encode()) + 1 for u in units])
    start = np.append(0, end[:-1])
    nominal = np.arange(chunk, end[-1], chunk)
    at = np.searchsorted(end, nominal)
    bounds = np.unique(np.concatenate([np.where(end[at] - start[at] > long_unit, end[at], nominal), end[-1:]]))
    before = 0
    for k, b in enumerate(bounds.tolist()):
        i, j = int(np.searchsorted(end, before, "right")), int(np.searchsorted(end, b))
        yield k, " ".join(units[i : j + 1]), before - int(start[i]), b - int(start[i])
        before = b


#: Columns of a fragment's row and of a document's row, after ``key`` and ``id``.
_LISTS = [f"{part}_{c}" for part in ("head", "tail") for c in ("a", "a_end", "b", "b_end")]
_FRAGMENT = "k long, length long, cut boolean, broken boolean, n_groups long, n_a long, n_b long, text binary, pairs array<long>, counts array<long>, tail_length long, " + ", ".join(f"{c} array<long>" for c in _LISTS)
_DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>"


def _row(k: int, f: Fragment) -> list:
    lists = [getattr(getattr(f, c[:4]), c[5:]) for c in _LISTS]
    return [k, f.length, f.cut, f.broken, f.closed.n_groups, f.closed.n_a, f.closed.n_b, f.closed.text, f.closed.pairs, f.closed.counts, f.tail_length, *lists]


def _fragment_of(r: dict) -> Fragment:
    ints = lambda c: np.array(r[c], np.int64)
    head, tail = (Tokens(*(ints(f"{p}_{c}") for c in ("a", "a_end", "b", "b_end"))) for p in ("head", "tail"))
    return Fragment(r["length"], r["cut"], r["broken"], head, Closed(r["n_groups"], r["n_a"], r["n_b"], r["text"], ints("pairs"), ints("counts")), tail, r["tail_length"])


def _document(f: Fragment, vocabulary: str, pieces: str) -> list:
    """Row of a whole text: its beginning is a cut, so the open tokens before the first one are a group."""
    if f.broken or not f.cut or len(f.tail.a) or len(f.tail.b):
        return [0, 0, 0, 0, "", NONE, NONE]
    all_ = close(f.head, vocabulary, pieces) + f.closed
    return [all_.n_a, all_.n_b, all_.n_groups, int(all_.counts.sum()), hashlib.sha256(all_.text).hexdigest(), all_.pairs, all_.counts]


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``most``."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` makes rows of each row, given as a dictionary."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for k in range(b.num_rows):
                yield from fn({c: b.column(j)[k].as_py() for j, c in enumerate(b.schema.names)})

    return df.mapInArrow(lambda batches: _batches(rows(batches), arrow), schema)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pieces: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``key, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts`` of every row.

    The first tokenizer encodes space + text, the second the text, to which it
    adds the space. Byte offsets where tokens of both end cut them into
    groups. ``pairs`` are the document's linked ids, ``a << 20 | b``, with
    the number of links of each.

    A text of up to ``chunk`` bytes is one range. Longer ones are cut into
    byte ranges that are dealt to tasks; each gives a fragment, and rounds of
    a tree compose up to 8 neighbours at a time, in the tasks of their keys.

    Null and empty texts, and those whose tokens' bytes differ from space +
    text, have no tokens: zeros and ''. Repeated rows are rows of their own
    (``key``), null ids stay, other columns are not read, and an empty table
    gives no rows.
    """
    vocabulary, pieces = vocabulary or default_vocabulary(), pieces or default_pieces()
    d = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    head = f"key long, id {dict(d.dtypes)['id']}, "
    size = F.octet_length("t") + 1

    def whole(r: dict) -> Iterator[list]:
        f = fragment(r["t"], 0, len(r["t"].encode()) + 1, vocabulary, pieces) if r["t"] else empty()
        yield [r["key"], r["id"], *_document(f, vocabulary, pieces)]

    def cut(r: dict) -> Iterator[list]:
        for part in ranges(r["t"], chunk, split=_units(vocabulary, pieces).split):
            yield [r["key"], r["id"], *part]

    def one(r: dict) -> Iterator[list]:
        yield [r["key"], r["id"], *_row(r["k"], fragment(r["t"], r["left"], r["right"], vocabulary, pieces))]

    def finish(r: dict) -> Iterator[list]:
        yield [r["key"], r["id"], *_document(_fragment_of(r), vocabulary, pieces)]

    def group(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["k"])
        f = compose(map(_fragment_of, rows), vocabulary, pieces)
        return pa.Table.from_batches(_batches(iter([[rows[0]["key"], rows[0]["id"], *_row(rows[0]["k"] // FAN_IN, f)]]), t.schema), t.schema)

    short = _map(d.where(size <= chunk), whole, head + _DOCUMENT)
    long = d.where(size > chunk)
    longest = docs.agg(F.max(F.octet_length(F.col(text_col)))).first()[0] or 0
    if longest + 1 <= chunk:
        return short
    parts = _map(long, cut, head + "k long, t string, left long, right long").repartition("key", "k")
    fragments = _map(parts, one, head + _FRAGMENT)
    for _ in range(math.ceil(math.log(longest // chunk + 2, FAN_IN))):
        fragments = fragments.groupBy("key", F.floor(F.col("k") / FAN_IN)).applyInArrow(group, head + _FRAGMENT)
    return short.union(_map(fragments, finish, head + _DOCUMENT))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, total, best``: links of each id pair in all documents, and whether no pair of its second id has more."""
    total = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total"))
    total = total.withColumn("b", F.col("pair").bitwiseAND((1 << SECOND) - 1))
    most = total.groupBy("b").agg(F.max("total").alias("most"))
    return total.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def _threshold(totals: DataFrame, most: int) -> int:
    """The least count that at most ``most`` pairs reach, from a histogram over quarters of powers of two."""
    steps = totals.groupBy(F.floor(F.log2("total") * 4).alias("s")).count().collect()
    found, limit = 0, None
    for s, n in sorted(((r["s"], r["count"]) for r in steps), reverse=True):
        found += n
        if found > most:
            break
        limit = s
    return math.ceil(2 ** (limit / 4)) if limit is not None else 1 << 62


def link_scores(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to aligned documents, from the counts of their pairs.

    The counts of the most frequent pairs, ``frequent`` at most, are
    broadcast, so that a pair of nearly all documents is in no shuffle; all
    others, of few documents each, are joined.
    """
    totals = cut_lineage(pair_counts(aligned))
    limit = _threshold(totals, frequent)
    x = aligned.select("key", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    often = F.broadcast(totals.where(F.col("total") >= limit))
    found = x.join(often, "pair").select("key", "n", "total", "best")
    rest = x.join(often.select("pair"), "pair", "left_anti").join(totals.where(F.col("total") < limit), "pair").select("key", "n", "total", "best")
    sums = found.union(rest).groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.join(sums, "key", "left").select(*aligned.columns, zero("n_best"), zero("count_sum"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document, with corpus-wide counts of the links."""
    aligned = stored(align(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return link_scores(aligned).select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
