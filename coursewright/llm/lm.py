"""Language-model scoring by a hashed maximum-entropy model."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.functions.storage import cut_lineage, stored
from coursewright.llm.common import fold, table
from coursewright.llm.vectors import sum_vectors

#: The end of a text, as a token; words are never empty.
END = b""
#: Classes of words, by their last two bytes.
CLASSES = 16
#: Frequent words whose counts every task holds; rarer ones are joined. A bound, not a cut: base scores do not depend on it.
HEAD = 1 << 17
#: Training tokens for each hashed weight, and the least and most weights as powers of two.
TOKENS_PER_WEIGHT, LEAST_BITS, MOST_BITS = 4, 16, 20
#: Of the four features of a history (the word before; the two before; the second word before; the third), how many count within a class.
NODE_FEATURES = 2
#: Tokens of a computed batch; synchronised rounds over disjoint parts of the training texts.
BATCH, ROUNDS = 65_536, 2
#: Parts of a full Newton step that a round takes, one over the features that share a history: for class rows, for choices; the prior's curvature.
ROW_STEP, NODE_STEP, PRIOR = 0.25, 0.5, 4.0
_hash64 = xxhash.xxh64_intdigest


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII blanks, then the end."""
    return [*(text or "").encode("utf-8").lower().split(), END]


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, c`` of every token of all texts; summed per batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[bytes] = Counter()

            def out() -> pa.RecordBatch:
                words = pa.array(list(seen), pa.binary()).cast(pa.string())
                return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

            for t in b.column(0):
                seen.update(tokens_of(t.as_py()))
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
            yield out()

    return docs.select(text_col).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The head of the counts, and what is known of the words below it by class."""

    least: int
    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    rare_tokens: np.ndarray
    once: np.ndarray

    @property
    def floor(self) -> float:
        return float(np.log10(self.tokens + self.distinct + 1))

    @property
    def unseen(self) -> np.ndarray:
        """Share of each class's rare tokens that words never seen get: the share of those seen once."""
        return np.where(self.rare_tokens > 0, np.minimum((self.once + 0.5) / (self.rare_tokens + 1), 0.5), 1.0)


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    """Gather from ``word, c``: the most frequent words, ``HEAD`` at most, totals, and one row per class.

    A histogram over the counts' logarithms, of bounded size, tells from
    which count on all words fit; only those reach the driver.
    """
    bins = counts.groupBy(F.floor(F.log2("c") * 64).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("b")).collect()
    least, room = 1 << 62, HEAD
    for r in bins:
        if r["n"] > room:
            break
        least, room = r["c"], room - r["n"]
    head = counts.where(F.col("c") >= least).toArrow()
    top = sorted(zip((w.encode() for w in head.column("word").to_pylist()), head.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))
    del head
    k = F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % CLASSES
    rare = F.col("c") < least
    rows = counts.groupBy(k.cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once"), F.sum(F.when(rare, F.col("c")).otherwise(0)).alias("rare")).collect()
    rare_tokens, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rows:
        rare_tokens[r["k"]], once[r["k"]] = r["rare"], r["once"]
    return Vocabulary(least, [w for w, _ in top], np.array([c for _, c in top], np.int64), sum(r["n"] for r in rows), sum(r["v"] for r in rows), rare_tokens, once)


class Spelling:
    """A chain over bytes that gives every string a probability, for words below the head.

    Byte follows byte by the bigrams of the head's words, each once, with every
    byte possible after every other. A class's share of all strings follows
    from the expected visits to each byte; with the head's words taken out, the
    strings of a class add up to 1.
    """

    def __init__(self, words: list[bytes]) -> None:
        n = np.full((257, 257), 0.01)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words if w], np.int64)
        last = np.cumsum(sizes) - 1
        if len(flat):
            before = np.concatenate([[256], flat[:-1]]).astype(np.int64)
            before[last[:-1] + 1] = 256
            np.add.at(n, (before, flat), 1)
            np.add.at(n, (flat[last], np.full(len(last), 256)), 1)
        n[256, 256] = 0
        n /= n.sum(axis=1, keepdims=True)
        self.log = np.log(np.maximum(n, 1e-300))
        visits = np.linalg.solve((np.eye(256) - n[:256, :256]).T, n[256, :256])
        share = np.zeros(CLASSES)
        for a in range(256):
            share[class_of(bytes([a]))] += n[256, a] * n[a, 256]
            k = np.array([class_of(bytes([a, b])) for b in range(256)])
            np.add.at(share, k, visits[a] * n[a, :256] * n[:256, 256])
        k = np.array([class_of(w) for w in words if w], np.int64)
        np.add.at(share, k, -np.exp(self.of([w for w in words if w])))
        self.share = np.log(np.maximum(share, 1e-300))

    def of(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's probability among all strings; words are not empty."""
        if not words:
            return np.zeros(0)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes) - sizes
        before = np.concatenate([[256], flat[:-1]]).astype(np.int64)
        before[first] = 256
        return np.add.reduceat(self.log[before, flat], first) + self.log[flat[first + sizes - 1], 256]


@dataclass
class Tree:
    """The way to each word within its class: two-way choices, as many as its share of the class asks for.

    Each class is a Huffman tree over its head words and one more leaf for all
    words below the head; leaf ``len(words) + k`` is that of class ``k``. Leaf
    ``j`` has the choices ``node[start[j]:start[j + 1]]`` with outcomes ``bit``;
    ``odds`` is each node's log odds of outcome 1 by counts alone.
    """

    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    odds: np.ndarray
    classes: np.ndarray
    bias: np.ndarray


def build_tree(v: Vocabulary) -> Tree:
    n = len(v.words)
    classes = np.array([*map(class_of, v.words), *range(CLASSES)], np.int64)
    once_in_head = np.bincount(classes[:n][v.counts == 1], minlength=CLASSES)
    counts = np.concatenate([v.counts, v.rare_tokens + once_in_head + 0.5]).astype(float)
    parent, side, odds = np.full(n + CLASSES, -1, np.int64), np.zeros(n + CLASSES, np.int8), []
    up, up_side = [], []
    for k in range(CLASSES):
        heap = [(counts[j], j, False) for j in np.flatnonzero(classes == k).tolist()]
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            m = len(odds)
            odds.append(np.log(b[0] / a[0]))
            up.append(-1)
            up_side.append(0)
            for bit, (_, j, inner) in enumerate((a, b)):
                if inner:
                    up[j - n - CLASSES], up_side[j - n - CLASSES] = m, bit
                else:
                    parent[j], side[j] = m, bit
            heapq.heappush(heap, (a[0] + b[0], n + CLASSES + m, True))
    up, up_side = np.array([*up, -1]), np.array([*up_side, 0], np.int8)
    leaf, nodes, bits = [], [], []
    j, m, bit = np.arange(n + CLASSES), parent, side
    while len(j):
        j, m, bit = j[m >= 0], m[m >= 0], bit[m >= 0]
        leaf.append(j)
        nodes.append(m)
        bits.append(bit)
        m, bit = up[m], up_side[m]
    leaf, nodes, bits = (np.concatenate(x) for x in (leaf, nodes, bits))
    order = np.argsort(leaf, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=n + CLASSES))])
    mass = np.bincount(classes, weights=counts, minlength=CLASSES)
    return Tree(start, nodes[order].astype(np.int32), bits[order], np.array(odds, np.float32), classes.astype(np.int8), np.log(mass / mass.sum()).astype(np.float32))


def read_texts(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep: str = "part") -> DataFrame:
    """Every text as numbers: ``id, part, n_tokens, n_known, base_score, leaves, tail``.

    ``leaves`` are the leaves of its tokens as 32-bit integers. ``n_known`` and
    ``base_score`` are of the tokens in the head; ``tail`` lists each other
    token's 64-bit hash, class, and the part of its probability that is left to
    its spelling (a natural logarithm, given its leaf). ``part`` is the column
    ``keep``, carried on.
    """
    n = len(v.words)
    word_base = np.log10(v.counts + 1) - v.floor
    spelling = Spelling(v.words)
    left = np.log(v.unseen) - spelling.share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: k for k, w in enumerate(v.words)}

        def read(part: pa.RecordBatch) -> pa.RecordBatch:
            words = [tokens_of(t) for t in part.column(1).to_pylist()]
            sizes = np.array([len(w) for w in words])
            flat = [w for ws in words for w in ws]
            leaves = np.fromiter(map(ids.get, flat, repeat(-1)), np.int32, len(flat))
            at = np.flatnonzero(leaves < 0)
            rare = [flat[k] for k in at.tolist()]
            k = np.fromiter(map(zlib.crc32, [w[-2:] for w in rare]), np.int64, len(rare)) % CLASSES
            base = np.append(word_base, 0)[leaves]
            starts = np.cumsum(sizes) - sizes
            per_text = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(words))
            known = sizes - per_text
            leaves[at] = n + k
            tail = pa.StructArray.from_arrays(
                [
                    pa.array(np.fromiter(map(_hash64, rare, repeat(42)), np.uint64, len(rare)).view(np.int64)),
                    pa.array(k.astype(np.int8)),
                    # the end of a text may be below the head; it is no string, and has the share of one byte 0
                    pa.array((spelling.of([w or b"\0" for w in rare]) + left[k]).astype(np.float32)),
                ],
                names=["h", "k", "s"],
            )
            raw = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((4 * np.concatenate([[0], np.cumsum(sizes)])).astype(np.int32)), pa.py_buffer(leaves)])
            offsets = pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32))
            columns = [part.column(0), part.column(2), pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.add.reduceat(base, starts)), raw, pa.ListArray.from_arrays(offsets, tail)]
            return pa.RecordBatch.from_arrays(columns, names=["id", "part", "n_tokens", "n_known", "base_score", "leaves", "tail"])

        for b in batches:
            first = size = 0
            for k, n_bytes in enumerate(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
                size += n_bytes // 6 + 1
                if size >= 2 * BATCH or k == b.num_rows - 1:
                    yield read(b.slice(first, k + 1 - first))
                    first, size = k + 1, 0

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(keep).cast("int").alias("part"))
    return d.mapInArrow(run, f"id {dict(d.dtypes)['id']}, part int, n_tokens long, n_known long, base_score double, leaves binary, tail array<struct<h:long,k:tinyint,s:float>>")


def histories_of(leaves: np.ndarray, sizes: np.ndarray, padding: int) -> np.ndarray:
    """32-bit hashes of the features of each token's history; words below the head count as their class, places before a text as padding."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(leaves)) - np.repeat(starts, sizes)
    back = [np.where(place >= k, np.roll(leaves, k), padding).astype(np.uint32) for k in (1, 2, 3)]
    one, two, three = ((b + np.uint32(1)) * np.uint32(0x9E3779B1) for b in back)
    mix = lambda x, salt: (x ^ (x >> np.uint32(15)) ^ np.uint32(salt)) * np.uint32(0x85EBCA6B)
    return np.stack([mix(one, 1), mix(one + mix(two, 2), 3), mix(two, 4), mix(three, 5)])


@dataclass
class EntropyModel:
    """Class weights, a row per hashed feature, and weights per hashed feature and node."""

    tree: Tree
    bits: int
    rows: np.ndarray
    weights: np.ndarray

    @property
    def row_bits(self) -> int:
        return self.bits - CLASSES.bit_length() + 1


def empty_model(v: Vocabulary) -> EntropyModel:
    bits = min(MOST_BITS, max(LEAST_BITS, (v.tokens // TOKENS_PER_WEIGHT).bit_length()))
    return EntropyModel(build_tree(v), bits, np.zeros(((1 << bits) // CLASSES, CLASSES), np.float32), np.zeros(1 << bits, np.float32))


def class_scores(model: EntropyModel, histories: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Probabilities of all classes, by a softmax over the sum of the features' rows, and those rows' places."""
    rows = [(h >> np.uint32(32 - model.row_bits)).astype(np.uint16) for h in histories]
    z = np.take(model.rows, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(model.rows, r, axis=0)
    z += model.tree.bias
    np.exp(z, out=z)
    z *= 1 / (z @ np.ones((CLASSES, 1), np.float32))
    return z, rows


def choices(model: EntropyModel, leaves: np.ndarray, histories: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """All two-way choices on the tokens' ways to their leaves: how many of each token, outcome, its probability of 1, and places of the weights."""
    t = model.tree
    first = np.take(t.start, leaves)
    sizes = np.take(t.start, leaves + 1) - first
    flat = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    flat += np.arange(len(flat))
    node = np.take(t.node, flat)
    z = np.take(t.odds, node)
    salt = node.astype(np.uint32) * np.uint32(0xC2B2AE35)
    places = []
    for h in histories[:NODE_FEATURES]:
        x = np.repeat(h, sizes)
        x ^= salt
        x *= np.uint32(0x9E3779B1)
        x >>= np.uint32(32 - model.bits)
        places.append(x.astype(np.int64))
        z += np.take(model.weights, places[-1])
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return sizes, np.take(t.bit, flat), np.reciprocal(z, out=z), places


def gradient(model: EntropyModel, leaves: np.ndarray, histories: np.ndarray) -> np.ndarray:
    """Slope of the log-likelihood in every weight and how often it is used.

    In order: slopes of the class rows and of the nodes' weights, uses of the
    nodes' weights and of the class rows.
    """
    n = 1 << model.bits
    out = np.zeros(3 * n + n // CLASSES)
    p, rows = class_scores(model, histories)
    np.negative(p, out=p)
    p[np.arange(len(leaves)), np.take(model.tree.classes, leaves)] += 1
    off, places = p.ravel().astype(np.float64), np.empty(p.shape, np.int64)
    for r in rows:
        np.add(CLASSES * r.astype(np.int64)[:, None], np.arange(CLASSES), out=places)
        out[:n] += np.bincount(places.ravel(), off, n)
        out[3 * n :] += np.bincount(r, minlength=n // CLASSES)
    _, bit, one, places = choices(model, leaves, histories)
    off = np.subtract(bit, one, dtype=np.float64)
    for x in places:
        out[n : 2 * n] += np.bincount(x, off, n)
        out[2 * n : 3 * n] += np.bincount(x, minlength=n)
    return out


def log_probabilities(model: EntropyModel, leaves: np.ndarray, histories: np.ndarray) -> np.ndarray:
    """Natural logarithm of each token's leaf given its history: its class's, and that of its way within the class."""
    p, _ = class_scores(model, histories)
    out = np.log(np.maximum(p[np.arange(len(leaves)), model.tree.classes[leaves]], 1e-30)).astype(np.float64)
    sizes, bit, one, _ = choices(model, leaves, histories)
    picked = np.log(np.maximum(np.where(bit == 1, one, 1 - one), 1e-30))
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(picked, dtype=np.float64)])
    return out + total[ends] - total[ends - sizes]


def _batches(batches: Iterator[pa.RecordBatch], column: int, padding: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Leaves, histories and sizes of whole texts with about ``BATCH`` tokens at a time."""

    def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        leaves, sizes = np.frombuffer(b"".join(texts), np.int32), [len(t) // 4 for t in texts]
        return leaves, histories_of(leaves, np.array(sizes), padding), sizes

    for b in batches:
        held, size = [], 0
        for t in b.column(column).to_pylist():
            held.append(t)
            size += len(t) // 4
            if size >= BATCH:
                yield joined(held)
                held, size = [], 0
        if held:
            yield joined(held)


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> EntropyModel:
    """Fit all weights to ``part, leaves`` by rounds of distributed gradient updates.

    The texts of part k train in round k, those of other parts not. In a round
    every task sums the slopes of the log-likelihood over its texts at the
    weights of the round before, and how often each weight is used; their sums
    over all tasks give each weight a damped step, as long as slope by bound of
    the curvature (a quarter a use of a choice, what the class's share gives
    for a row). The result does not depend on how texts are dealt over tasks.
    The number of weights grows with the training tokens up to a bound; a task
    sends a vector of 16-bit numbers of that size, whatever it reads.
    """
    model = empty_model(vocabulary)
    n, padding = 1 << model.bits, len(vocabulary.words) + CLASSES
    for k in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], model: EntropyModel = model) -> np.ndarray | None:
            total = None
            for leaves, histories, _ in _batches(batches, 0, padding):
                for a in range(0, len(leaves), 2 * BATCH):
                    g = gradient(model, leaves[a : a + 2 * BATCH], histories[:, a : a + 2 * BATCH])
                    total = g if total is None else np.add(total, g, out=total)
            return total

        part = texts.where(F.col("part") == k).select("leaves")
        scans = part.rdd.getNumPartitions()
        tasks = min(scans, max(scans // 4, 2 * part.sparkSession.sparkContext.defaultParallelism))
        model = stepped(model, sum_vectors(part.coalesce(tasks), sums, 3 * n + n // CLASSES, "float32", "bfloat16", tasks))
    return model


def stepped(model: EntropyModel, total: np.ndarray) -> EntropyModel:
    """The model after a step along the summed ``gradient``."""
    n = 1 << model.bits
    share = np.exp(model.tree.bias)
    rows = total[:n].reshape(-1, CLASSES) / (total[3 * n :, None] * (share * (1 - share)) + PRIOR)
    weights = total[n : 2 * n] / (total[2 * n : 3 * n] / 4 + PRIOR)
    return EntropyModel(model.tree, model.bits, (model.rows + ROW_STEP * rows).astype(np.float32), (model.weights + NODE_STEP * weights).astype(np.float32))


def score_texts(texts: DataFrame, model: EntropyModel, vocabulary: Vocabulary, counts: DataFrame) -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` of every text that ``read_texts`` gave.

    A token's probability is that of its class given the three tokens before,
    times that of its way within the class given the same. Words below the head
    share a leaf of their class: there a word has its share of the class's rare
    training tokens, less what is kept for unseen words, plus its spelling's
    share of what is kept; over all strings probabilities add up to 1. Rare
    words' hashes are joined with the counts and come back as sums. Null and
    empty texts are the end token alone. One output row per input row, repeated
    rows included; an empty table gives an empty result.
    """
    v, padding = vocabulary, len(vocabulary.words) + CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for leaves, histories, sizes in _batches(iter([b]), 1, padding):
                logs = [log_probabilities(model, leaves[a : a + BATCH], histories[:, a : a + BATCH]) for a in range(0, len(leaves), BATCH)]
                out.append(np.add.reduceat(np.concatenate(logs), np.cumsum(sizes) - sizes) / np.log(10))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(np.concatenate(out) if out else np.zeros(0))], names=["row", "id", "n_tokens", "n_known", "base_score", "score"])

    columns = ["id", "n_tokens", "n_known", "base_score"]
    types = dict(texts.dtypes)
    numbered = texts.select("row", "leaves", *columns)
    scored = numbered.mapInArrow(run, f"row long, {', '.join(f'{c} {types[c]}' for c in columns)}, score double")
    rare = texts.select("row", F.inline("tail"))
    all_counts = counts.where(F.col("c") < v.least).select(F.xxhash64("word").alias("h"), "c")
    c = F.coalesce("c", F.lit(0))
    shares = np.where(v.rare_tokens > 0, (1 - v.unseen) / np.maximum(v.rare_tokens, 1), 0.0)
    seen = c * F.element_at(F.array(*[F.lit(float(x)) for x in shares]), F.col("k") + 1)
    joined = rare.join(all_counts, "h", "left").select(
        "row",
        (c > 0).cast("long").alias("more_known"),
        (F.log10(c + F.lit(1.0)) - v.floor).alias("more_base"),
        F.log10(seen + F.exp(F.col("s").cast("double"))).alias("more_score"),
    )
    sums = joined.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("more_known", "more_base", "more_score")])
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return scored.join(sums, "row", "left").select("id", "n_tokens", plus("n_known", "more_known"), plus("base_score", "more_base"), plus("score", "more_score"))


def fit_and_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Vocabulary]:
    """Learn from the texts where ``training`` holds, and score all; also gives the vocabulary.

    Texts are counted, then read into numbers once, which training and scoring share.
    """
    part = F.when(training, F.pmod(F.xxhash64(text_col), F.lit(ROUNDS))).otherwise(-1)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), part.alias("part"))
    counts = cut_lineage(count_tokens(d.where("part >= 0"), "t"))
    vocabulary = read_vocabulary(counts)
    texts = stored(read_texts(d, vocabulary, "id", "t").withColumn("row", F.monotonically_increasing_id()))
    return score_texts(texts, train(texts, vocabulary), vocabulary, counts), vocabulary


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document, learned from the folds other than 2 of 7; null texts are empty, repeated rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, vocabulary = fit_and_score(docs, fold("doc_id", 7) != 2)
    return out.select(
        F.col("id").alias("doc_id"),
        (fold("id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
