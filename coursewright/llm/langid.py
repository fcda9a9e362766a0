"""Language identification of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursewright.llm.common import arrow_map, fold, table

#: Chains are computed in blocks of so many words, which pass messages on.
BLOCK = 64
#: Features are hashed to so many weights a language.
BUCKETS = 1 << 17
#: Letters of a word at most; longer runs, as of scripts without spaces, are several words.
WIDTH = 24
_WORD = re.compile(rf"[^\W\d_]{{1,{WIDTH}}}")
#: Bound of the labelled sample that the model is fitted on, in lines over all languages.
SAMPLE_LINES = 16_000
UNKNOWN = "und"


def words_of(line: str) -> list[str]:
    """The lower-cased runs of letters, cut after every ``WIDTH`` letters."""
    return _WORD.findall(line.lower())


def word_features(words: list[str]) -> np.ndarray:
    """Bucket of each feature of each word, 0 where a word is too short for one.

    The word itself (lexicon), prefixes and suffixes of one to three letters,
    and all inner letter pairs and triples.
    """
    chars = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH).astype(np.uint64)
    size = (chars != 0).sum(axis=1)
    rows = np.arange(len(words))

    def bucket(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(parts[0].shape, kind * 0x9E3779B1 + 7, np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        return (h % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int32)

    weights = np.array([pow(31, k, 1 << 64) for k in range(WIDTH)], np.uint64)
    out = [bucket(1, (chars * weights).sum(axis=1), size.astype(np.uint64))]
    for n in (1, 2, 3):
        enough = size >= n
        out.append(np.where(enough, bucket(1 + n, *(chars[:, k] for k in range(n))), 0))
        ends = [chars[rows, np.maximum(size - n + k, 0)] for k in range(n)]
        out.append(np.where(enough, bucket(4 + n, *ends), 0))
    grams = [np.stack(out, axis=1)]
    for n in (2, 3):
        g = bucket(7 + n, *(chars[:, k : WIDTH - n + 1 + k] for k in range(n)))
        inside = np.arange(WIDTH - n + 1)[None, :] + n <= size[:, None]
        grams.append(np.where(inside, g, 0))
    return np.concatenate(grams, axis=1)


@dataclass
class ChainModel:
    """Weights per feature and language, and per transition between languages."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for a in range(0, len(words), 20_000):
            f = word_features(words[a : a + 20_000])
            f = f[:, (f != 0).any(axis=0)]
            for k in range(f.shape[1]):
                out[a : a + len(f)] += self.weights[f[:, k]]
        return out


def marginals(emissions: np.ndarray, mask: np.ndarray, transitions: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Posterior of each label at each place of each chain, by forward-backward.

    ``emissions`` is chains x places x labels and ``mask`` says which places
    exist. Messages are scaled at each place. A chain may be a block of a
    longer one: ``before`` and ``after`` are the messages that come in at its
    ends, rows of zeros where it begins. With ``pairs`` the expected
    transition counts over all chains are returned as well.
    """
    c, t, n = emissions.shape
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    trans = np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(e), np.ones_like(e)
    if before is not None:
        e0 = e[:, 0] * np.where(before.any(axis=1, keepdims=True), before @ trans, 1)
        end = after
        backward[:, -1] = end
    else:
        e0, end = e[:, 0], 1.0
    forward[:, 0] = e0 / e0.sum(axis=1, keepdims=True)
    for k in range(1, t):
        a = (forward[:, k - 1] @ trans) * e[:, k]
        forward[:, k] = a / a.sum(axis=1, keepdims=True)
    for k in range(t - 2, -1, -1):
        b = (backward[:, k + 1] * e[:, k + 1]) @ trans.T
        b /= b.sum(axis=1, keepdims=True)
        backward[:, k] = np.where(mask[:, k + 1, None], b, end)
    post = forward * backward
    post /= post.sum(axis=2, keepdims=True)
    if not pairs:
        return post, None
    both = mask[:, 1:]
    joint = np.einsum("cti,ctj->ctij", forward[:, :-1], backward[:, 1:] * e[:, 1:]) * trans
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return post, (joint * both[:, :, None, None]).sum(axis=(0, 1))


def messages(emissions: np.ndarray, mask: np.ndarray, transitions: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The messages into both ends of each block of chains that are cut into blocks.

    Blocks of a chain stand one after the other and ``place`` numbers them from
    0. A block's transfer matrix is the product of its steps, so the blocks of
    all chains are multiplied at once and only the messages from block to block
    go one by one.
    """
    c, t, n = emissions.shape
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    trans = np.exp(transitions - transitions.max())
    m = np.eye(n, dtype=e.dtype)[None] * e[:, 0][:, None, :]
    for k in range(1, t):
        step = (m @ trans) * e[:, k][:, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        m = np.where(mask[:, k, None, None], step, m)
    before, after = np.zeros((c, n), e.dtype), np.ones((c, n), e.dtype)
    for j in range(1, int(place.max()) + 1):
        at = np.flatnonzero(place == j)
        f = before[at - 1]
        f = np.einsum("ci,cij->cj", np.where(f.any(axis=1, keepdims=True), f @ trans, 1), m[at - 1])
        before[at] = f / f.sum(axis=1, keepdims=True)
    for j in range(int(place.max()), 0, -1):
        at = np.flatnonzero(place == j)
        b = np.einsum("cij,cj->ci", m[at], after[at]) @ trans.T
        after[at - 1] = b / b.sum(axis=1, keepdims=True)
    return before, after


def chain_posteriors(rows: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, most: int = 2000) -> np.ndarray:
    """Posteriors of chains of any length, whose emissions ``rows`` stand one after the other; ``most`` blocks are computed at once."""
    blocks = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), blocks)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    sizes = np.minimum(BLOCK, lengths[chain] - place * BLOCK)
    starts = np.cumsum(sizes) - sizes
    post = np.empty_like(rows)
    single = blocks[chain] == 1
    alone = np.flatnonzero(single)
    alone = alone[np.argsort(sizes[alone], kind="stable")]
    groups = [(alone[a : a + most], False) for a in range(0, len(alone), most)]
    joined = np.flatnonzero(~single)
    ends = [0, *(np.searchsorted(chain[joined], np.unique(chain[joined]), side="right")).tolist()]
    a = 0
    for b, following in zip(ends[1:], [*ends[2:], None]):
        if following is None or following - a > most:
            groups.append((joined[a:b], True))
            a = b
    for part, more in groups:
        mask = _padded(sizes[part])
        at = (starts[part][:, None] + np.arange(mask.shape[1]))[mask]
        full = np.zeros((*mask.shape, rows.shape[1]), rows.dtype)
        full[mask] = rows[at]
        ends_ = messages(full, mask, transitions, place[part]) if more else (None, None)
        post[at] = marginals(full, mask, transitions, False, *ends_)[0][mask]
    return post


def chains_of(text: str) -> list[list[str]]:
    """The text's chains: lines that hold a word."""
    return [w for w in map(words_of, text.split("\n")) if w]


def _padded(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.max())[None, :] < lengths[:, None]


def fit_chains(lines: list[tuple[str, str]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> ChainModel:
    """Fit a model to (language, line) pairs; every word of a line carries its label.

    Maximises the conditional likelihood of the chains by AdaGrad steps over
    batches of them, with L2 decay; emissions and transitions are learned
    together. The result depends on the pairs and the seed alone.
    """
    languages = sorted({lang for lang, _ in lines})
    n = len(languages)
    model = ChainModel(languages, np.zeros((BUCKETS, n), np.float32), np.zeros((n, n), np.float32))
    chains = [(languages.index(lang), c) for lang, line in sorted(lines) for c in chains_of(line)]
    if n < 2 or not chains:
        return model
    ids: dict[str, int] = {}
    coded = [np.array([ids.setdefault(w, len(ids)) for w in c]) for _, c in chains]
    labels = np.array([y for y, _ in chains])
    features = _features_of_all(list(ids))
    seen_w, seen_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(chains)), max(1, len(chains) // 1500)):
            lengths = np.array([len(coded[k]) for k in batch])
            mask = _padded(lengths)
            flat = np.concatenate([coded[k] for k in batch])
            used, place = np.unique(flat, return_inverse=True)
            f = features[used]
            e = model.weights[f].sum(axis=1)
            full = np.zeros((*mask.shape, n), np.float32)
            full[mask] = e[place]
            post, expected = marginals(full, mask, model.transitions, pairs=True)
            y = np.repeat(labels[batch], lengths)
            diff = -post[mask]
            diff[np.arange(len(y)), y] += 1
            observed = np.diag(np.bincount(labels[batch], weights=lengths - 1, minlength=n))
            for k in range(n):
                per_word = np.bincount(place, weights=diff[:, k], minlength=len(used))
                g = np.bincount(f.ravel(), weights=np.repeat(per_word, f.shape[1]), minlength=BUCKETS).astype(np.float32) / len(batch)
                g -= decay * model.weights[:, k]
                g[0] = 0
                seen_w[:, k] += g * g
                model.weights[:, k] += rate * g / np.sqrt(seen_w[:, k])
            g = ((observed - expected) / len(batch) - 10 * decay * model.transitions).astype(np.float32)
            seen_t += g * g
            model.transitions += rate * g / np.sqrt(seen_t)
    return model


def sampled_lines(docs: DataFrame, most: int = SAMPLE_LINES) -> DataFrame | None:
    """At most ``most`` rows ``lang, line`` of ``doc_id, text, lang``, the same share (20 at least) for each language; None if no row tells a language.

    Documents are drawn by the hash of their id, and lines of those by their
    own hash, so the sample does not depend on partitions. A line is cut into
    pieces of at most 600 characters, which bounds the sample's size.
    """
    known = docs.where("lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id"))
    n = known.select("lang").distinct().count()
    if not n:
        return None
    share = max(20, most // n)
    # only languages and hashes are ranked, and only the first rows of each language leave a task; texts stay where they are
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    first = known.select("lang", "h").withColumn("place", place).where(F.col("place") <= max(share // 5, 40)).select("lang", "h").distinct()
    # a row for each drawn document; languages are few, as the model has BUCKETS weights for each
    drawn = known.join(F.broadcast(first) if n <= 1_000 else first, ["lang", "h"], "left_semi")
    pieces = (
        drawn.select("lang", F.explode(F.split("text", "\n")).alias("line"))
        .select("lang", F.explode(F.regexp_extract_all("line", F.lit(r"(?s).{1,600}"), F.lit(0))).alias("line"))
        .where(F.col("line").rlike(r"\p{L}"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("line"), "line"))
    return pieces.withColumn("rank", rank).where(F.col("rank") <= share).select("lang", "line")


def labelled_lines(docs: DataFrame, most: int = SAMPLE_LINES) -> list[tuple[str, str]]:
    """The rows of ``sampled_lines`` in order."""
    rows = sampled_lines(docs, most)
    return sorted((r["lang"], r["line"]) for r in rows.collect()) if rows is not None else []


def _features_of_all(words: list[str], part: int = 8_000) -> np.ndarray:
    """Features of many words, made part by part to keep the intermediate arrays small."""
    out = np.zeros((len(words), word_features(["a"]).shape[1]), np.int32)
    for a in range(0, len(words), part):
        out[a : a + part] = word_features(words[a : a + part])
    return out[:, (out != 0).any(axis=0)] if not (out != 0).any(axis=0).all() else out


class _Lexicon(dict):
    """Row of each word in a table of emissions that is filled batch by batch."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


def label_texts(docs: DataFrame, model: ChainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, n_words, runs`` of every text.

    ``runs`` lists the stretches of words of one language in code-switched
    text as ``language:first-last``, by each word's likeliest label. The
    text's language is the one with the largest summed posterior, ``score``
    its mean over the words. Null texts and texts without a letter are
    ``und`` with score 0 and no runs; so is every text if the model knows no
    language. One output row per input row, no shuffle; texts are taken in
    groups of bounded size.
    """
    n = len(model.languages)
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, rows = _Lexicon(), np.zeros((0, n), np.float32)

        def score(texts: list[str | None]) -> tuple[list, list, list, list]:
            nonlocal lexicon, rows
            chains: list[list[str]] = []
            per_doc = []
            for t in texts:
                c = chains_of(t) if t else []
                chains += c
                per_doc.append(sum(map(len, c)))
            per_doc = np.array(per_doc)
            lang, mean, runs = np.full(len(texts), n), np.zeros(len(texts)), [""] * len(texts)
            if chains and n:
                flat = np.fromiter((lexicon[w] for c in chains for w in c), np.int64, int(per_doc.sum()))
                if lexicon.new:
                    rows = np.concatenate([rows, model.emissions(lexicon.new)])
                    lexicon.new.clear()
                post = chain_posteriors(rows[flat], np.array([len(c) for c in chains]), model.transitions)
                if len(lexicon) > 200_000:
                    lexicon, rows = _Lexicon(), np.zeros((0, n), np.float32)
                some = np.flatnonzero(per_doc)
                first = np.cumsum(per_doc[some]) - per_doc[some]
                sums = np.add.reduceat(post, first, axis=0)
                lang[some] = sums.argmax(axis=1)
                mean[some] = np.clip(sums.max(axis=1) / per_doc[some], 0, 1)
                best = post.argmax(axis=1)
                for d, a in zip(some.tolist(), first.tolist()):
                    b = best[a : a + per_doc[d]]
                    cut = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist()]
                    runs[d] = ",".join(f"{names[b[s]]}:{s}-{e - 1}" for s, e in zip(cut, [*cut[1:], len(b)]))
            return names[lang].tolist(), mean.tolist(), per_doc.tolist(), runs

        for b in batches:
            texts = b.column(1).to_pylist()
            done, held, size = ([], [], [], []), [], 0
            for k, t in enumerate(texts):
                held.append(t)
                size += len(t or "")
                if size > 1_000_000 or k == len(texts) - 1:
                    for to, new in zip(done, score(held)):
                        to += new
                    held, size = [], 0
            values = [pa.array(v, t) for v, t in zip(done, (pa.string(), pa.float64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *values], names=["id", "lang_pred", "score", "n_words", "runs"])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.slice(k, 2048) for b in batches for k in range(0, b.num_rows, 2048))

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return d.mapInArrow(sliced, f"id {dict(d.dtypes)['id']}, lang_pred string, score double, n_words long, runs string")


def fit_language_model(docs: DataFrame, folds: int = 5, held: int = 0) -> ChainModel:
    """The model fitted on the documents outside fold ``held``.

    It is fitted in a task that reads the sample, of bounded size, so that the
    driver holds neither lines nor what fitting takes, only the weights.
    """
    rows = sampled_lines(docs.select("doc_id", "text", "lang").where(fold("doc_id", folds) != held))
    if rows is None:
        return fit_chains([])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = [pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if lines:
            m = fit_chains(lines)
            yield pa.RecordBatch.from_arrays([pa.array([m.languages], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (m.weights, m.transitions))], names=["languages", "weights", "transitions"])

    made = rows.repartition(1).mapInArrow(fit, "languages array<string>, weights binary, transitions binary").first()
    if made is None:
        return fit_chains([])
    n = len(made["languages"])
    weights, transitions = (np.frombuffer(made[c], np.float32).reshape(-1, n) for c in ("weights", "transitions"))
    return ChainModel(list(made["languages"]), weights, transitions)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that are not held out; null texts and texts without a letter are ``und``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = label_texts(docs, fit_language_model(docs))
    return out.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "lang_pred", "score", "n_words", "runs")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is known, with all their columns.

    Null, empty and other texts without a letter go, each row by its own id and
    text; where no row tells a language, all others stay. Repeated rows stay
    repeated; an empty table stays empty.
    """
    wide = docs.withColumn("__id", F.struct("doc_id", F.xxhash64("text").alias("h")))
    found = label_texts(wide, fit_language_model(docs), id_col="__id").where(F.col("n_words") == 0)
    gone = found.select(F.col("id.doc_id").alias("__id"), F.col("id.h").alias("__h")).distinct()
    keyed = docs.withColumn("__k", F.xxhash64("text"))
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__h")), "left_anti").select(*docs.columns)
