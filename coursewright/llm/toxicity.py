"""Toxicity by compression distance: which dictionary makes a window shorter."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.llm.common import arrow_map, fold, table

#: Bounds of the labelled sample, in rows of each class, and of a sampled row's characters by class.
TOXIC_ROWS, ORDINARY_ROWS = 2_500, 5_000
SAMPLE_CHARS = 6_000
#: Bytes of a window, and of the dictionaries trained on ordinary and on toxic text.
WINDOW = 96
ORDINARY_BYTES, TOXIC_BYTES = 8_192, 2_048
#: Characters of a run within a word that toxic text is reduced by, and how much rarer it is in ordinary text at least.
GRAM, RARE = 5, 20


def windows_of(text: str) -> list[bytes]:
    """The lower-cased text in windows of about ``WINDOW`` bytes, cut at spaces.

    A window begins with a space, and white space counts as one space, so a
    word looks alike wherever it stands. Longer words are cut.
    """
    flat = " ".join(text.lower().split()).encode("utf-8")
    out, at, n = [], 0, len(flat)
    while at < n:
        end = min(n, at + WINDOW)
        if end < n:
            space = flat.rfind(b" ", at + 1, end)
            end = space if space > 0 else end
        out.append(b" " + flat[at:end].strip(b" ") + b" ")
        at = end + (flat[end : end + 1] == b" ")
    return out


@dataclass
class DistanceModel:
    """Two dictionaries and the calibration of the gains of the toxic one."""

    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        level = zstandard.ZstdCompressionParameters.from_level(12, window_log=16, min_match=4, write_checksum=False, write_content_size=False, write_dict_id=False)
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            if d is not None:
                d.precompute_compress(compression_params=level)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=level))
        return out[0], out[1]

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.center) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def text_features(text: str | None, plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[float, float, float, float]:
    """How many bytes the toxic dictionary saves: in the best window, in the best three, in all (root), and the share of windows with a gain of three."""
    w = windows_of(text or "")
    if not w:
        return 0.0, 0.0, 0.0, 0.0
    gain = np.fromiter((len(plain.compress(x)) - len(toxic.compress(x)) for x in w), np.float64, len(w))
    best = np.sort(gain)[::-1]
    sure = gain[gain >= 3]
    return float(best[0]), float(best[:3].sum()), float(np.sqrt(sure.sum())), float(len(sure) / len(w))


def _train(size: int, samples: list[bytes], **how: int) -> bytes:
    """Raw content of a dictionary trained on the samples; the samples themselves where they are too few."""
    try:
        trained = zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    content = trained[-size:]
    # what stands before the content are entropy tables, which a raw dictionary does not use
    at = content.find(b" ")
    return content[at:] if at >= 0 else content


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[k : k + GRAM] for k in range(max(1, len(w) - GRAM + 1))]


def toxic_windows(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Windows of the toxic texts, reduced to what recurs in them and is rare in ordinary texts.

    A run of ``GRAM`` characters within a word (its start and end count as
    characters) is kept if it follows at least ``max(3, texts / 150)``
    different words, so the same passage in many copies of a text counts once,
    and ``RARE`` times as many, for the texts of each class, as ordinary texts
    hold it. Of each word the part from its first to its last kept run stays.
    """
    plain: Counter[str] = Counter()
    for t in ordinary:
        plain.update({g for w in set(t.lower().split()) for g in _grams(w)})
    after: dict[str, set[str]] = {}
    for t in toxic:
        words = t.lower().split()
        for before, w in zip(["", *words], words):
            for g in _grams(w):
                if plain[g] * RARE <= len(ordinary):
                    after.setdefault(g, set()).add(before)
    least = max(3, len(toxic) // 150)
    telling = {g for g, s in after.items() if len(s) >= least and len(s) * len(ordinary) >= RARE * plain[g] * len(toxic)}
    out = []
    for t in toxic:
        parts = []
        for w in t.lower().split():
            x = f" {w} "
            kept = [k for k in range(len(x) - GRAM + 1) if x[k : k + GRAM] in telling]
            if kept:
                parts.append(x[kept[0] : kept[-1] + GRAM].strip())
        out += windows_of(" ".join(parts))
    return out


def fit_distance(rows: list[tuple[int, str]]) -> DistanceModel:
    """Train the dictionaries on two thirds of (label, text) rows and calibrate on the rest.

    The ordinary dictionary is trained on windows of all ordinary texts, the
    toxic one on windows of the toxic texts, reduced as ``toxic_windows`` says:
    of whole toxic texts a dictionary learns the ordinary words among them and
    finds few toxic texts (figures are in the README). The toxic dictionary is
    put before the ordinary one, so the two compressors differ by it alone.
    Gains are calibrated by logistic regression. Without rows of both classes
    every text has the same low score.
    """
    rows = sorted(rows, key=lambda r: (zlib.crc32(r[1].encode()), r[1], r[0]))
    train = [r for k, r in enumerate(rows) if k % 3]
    rest = [r for k, r in enumerate(rows) if k % 3 == 0]
    toxic, ordinary = [t for y, t in train if y], [t for y, t in train if not y]
    model = DistanceModel(b"", b"", np.zeros(4), np.ones(4), np.zeros(4), -3.0)
    samples = [w for t in ordinary for w in windows_of(t)]
    model.ordinary = _train(ORDINARY_BYTES, samples, level=12) if samples else b""
    telling = toxic_windows(toxic, ordinary)
    if not telling:
        return model
    model.toxic = _train(TOXIC_BYTES, telling, k=24, d=6)
    plain, better = model.compressors()
    x = np.array([text_features(t, plain, better) for _, t in rest])
    y = np.array([float(bool(v)) for v, _ in rest])
    if not len(y) or y.min() == y.max():
        return model
    model.center, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - model.center) / model.scale
    w, b = np.zeros(4), 0.0
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        w -= 0.5 * (z.T @ (p - y) / len(y) + 1e-4 * w)
        b -= 0.5 * (p - y).mean()
    model.weights, model.bias = w, float(b)
    return model


def labelled_texts(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> list[tuple[int, str]]:
    """At most so many (label, text) rows of each class, drawn by the hash of the id.

    The rows are chosen from the labels alone; their texts follow by a join
    with that bounded list. Texts of a sampled row beyond ``SAMPLE_CHARS``
    are represented by as many windows spread evenly over the whole of it.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold("doc_id", 5) != 0)
    h = F.xxhash64("doc_id")
    drawn = known.where("toxic = 1").orderBy(h).limit(toxic_rows).union(known.where("toxic = 0").orderBy(h).limit(ordinary_rows))
    piece, n = F.ceil(F.length("text") / (SAMPLE_CHARS // 300)).cast("int"), SAMPLE_CHARS // 300
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("text").substr(k * piece + 1, F.lit(300))), " ")
    short = F.when(F.length("text") <= SAMPLE_CHARS, F.col("text")).otherwise(spread)
    rows = docs.where("text is not null").join(F.broadcast(drawn), "doc_id").select("toxic", short.alias("text"))
    return [(r["toxic"], r["text"]) for r in rows.collect()]


def score_toxicity(docs: DataFrame, model: DistanceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, best_gain`` of every text: its probability of being toxic and the bytes its most toxic window saves.

    Every window of the whole text is compressed with both dictionaries. Null
    and empty texts have no window and get the score of no gain. One output
    row per input row, no shuffle.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        plain, better = model.compressors()
        x = np.array([text_features(t, plain, better) for t in batch.column(1).to_pylist()]).reshape(-1, 4)
        p = model.probability(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(x[:, 0])], names=["id", "score", "best_gain"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return arrow_map(d, run, f"id {dict(d.dtypes)['id']}, score double, best_gain double", rows=2048)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; folds other than the held-out one give the labels. Null texts score as empty ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = score_toxicity(docs, fit_distance(labelled_texts(docs, labels)))
    return out.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "best_gain")
