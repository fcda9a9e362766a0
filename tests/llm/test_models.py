"""The other operators against brute force, exact round trips or held-out accuracy."""

import collections
import functools
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from coursewright.llm import decontam, langid, lm, media, packing, simhash, toxicity

EN = "the of and to in that it for with was this are from".split()
DE = "der die das und ist nicht mit auch wird eine von den".split()
FR = "le la les des est une dans pour avec sur pas qui".split()


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "er", "ung" if words is DE else "ing" if words is EN else "eau"]) for _ in range(n))


# SimHash


def fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    c = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r, 42)
        for k in range(64):
            c[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * c[k] > len(runs))


def components(prints, radius):
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(prints))]


def test_simhash_components(spark):
    rnd = random.Random(1)
    base = prose(rnd, EN, 400).split()
    texts = [None, "", "one two", "One  TWO", prose(rnd, DE, 30)]
    for k in range(40):
        w = list(base)
        w[rnd.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [texts[7], texts[7]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit(1))
    got = {r["id"]: r for r in simhash.simhash_components(d).collect()}
    want = [fingerprint(t) for t in texts]
    assert [got[k]["f0"] & (1 << 64) - 1 for k in range(len(texts))] == want
    assert [got[k]["component_id"] for k in range(len(texts))] == components(want, 3)
    assert simhash.simhash_components(d.limit(0)).count() == 0


@pytest.mark.parametrize("most", [10, 20_000])
def test_links_survive_splitting(spark, most):
    """A dense ball and a third of all rows in one group, split by further bits or not."""
    rnd = random.Random(2)
    center = rnd.getrandbits(64)
    prints = {center}
    for _ in range(120):
        x = center
        for k in rnd.sample(range(64), rnd.choice([1, 2, 3, 5, 6])):
            x ^= 1 << k
        prints.add(x)
    prints |= {rnd.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    d = spark.createDataFrame([(s, s) for s in signed], "node long, f0 long")
    edges = simhash.hamming_links(d, 3, most).collect()
    parent = {s: s for s in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[root(e["src"])] = root(e["dst"])
    want = components(prints, 3)
    assert _groups([root(s) for s in signed]) == _groups(want)


def _groups(labels):
    by = collections.defaultdict(list)
    for k, x in enumerate(labels):
        by[x].append(k)
    return sorted(by.values())


def test_near_duplicates(spark):
    rnd = random.Random(3)
    texts, want = [], []
    for g in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(300)]
        for k in range(3):
            w = list(base)
            for _ in range(2 * k):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
            want.append(3 * g)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"]["id"] for r in simhash.near_duplicates(d).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert simhash.keep_one_of_each(spark, d, "").count() == 12


def test_links_do_not_depend_on_the_size_of_a_group(spark):
    """Chains of near fingerprints that agree in no key, in one group that is split or not."""
    rnd = random.Random(33)
    rows = []
    for k in range(90):
        x = rnd.getrandbits(128) if k % 9 == 0 else x
        for bit in rnd.sample(range(128), 12):
            x ^= 1 << bit
        f = [v - (1 << 64) if v >> 63 else v for v in (x & (1 << 64) - 1, x >> 64)]
        rows.append((k, *f, [1000 * j + k for j in range(40)], 0, 5))
    d = spark.createDataFrame(rows, "node long, f0 long, f1 long, keys array<long>, mask long, bits long")
    for most in (2, 7, 10**9):
        edges = [(r["src"], r["dst"]) for r in simhash._by_keys(d, 2, most, 12).collect()]
        label = list(range(90))
        for _ in rows:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert label == [k - k % 9 for k in range(90)], most


# Packing


def test_packing(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(4)
    odd = ["<|endoftext|>", " ", "  ", "\n", "a", "<|endoftext", "Straße", "|>", "\xa0", "é", "12", "'s"]
    mixed = ["".join(rnd.choices(odd, k=rnd.randrange(1, 30))) for _ in range(200)]
    texts = [None, "", " a  b \n c", "<|endoftext|>", "x\x1cy z\xa0 w", prose(rnd, DE, 5000)] + [prose(rnd, EN, rnd.randrange(1, 900)) for _ in range(40)] + mixed
    rows = [(k % 44, x) for k, x in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x"))
    out = packing.pack(packing.cut_pieces(d)).collect()
    whole = {x or "": t.encode(x or "", add_special_tokens=False).ids + [0] for _, x in rows}
    crcs = collections.Counter()
    for doc, x in rows:
        ids = whole[x or ""]
        for a in range(0, len(ids), 1024):
            part = ids[a : a + 1024]
            crcs[(doc, a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids))] += 1
    assert crcs == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 1024
    total = sum(len(whole[x or ""]) for _, x in rows)
    assert len(by) <= math.ceil(total / 1024) + 2
    assert packing.pack(packing.cut_pieces(d.limit(0))).count() == 0


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(5)
    sizes = [rnd.randrange(1, 100) for _ in range(400)]
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= s
        else:
            left.append(100 - s)
    _, windows = packing.plan_windows(dict(collections.Counter(sizes)), 100)
    assert windows == len(left)


# Media


def png(extra=b""):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x" + extra) + chunk(b"IEND", b"")


def test_media(spark):
    texts = [None, "", "a" * 64, "é" * 50, "BM and RIFF and %PDF-", "a" * 64]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.lit(1))
    for r in media.media_features(d).collect():
        raw = (texts[r["id"]] or "").encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert media.samples(media.store(pay)) == pay and r["media_bytes"] == len(pay) + 44 and r["n_embedded"] == 0
    assert media.media_features(d.limit(0)).count() == 0


def test_carving(spark):
    good, bad = png(), bytearray(png())
    bad[20] ^= 1
    gz = __import__("gzip").compress(b"hello" * 9)
    blob = b"junk" + good + bytes(bad) + gz + b"tail"
    kind, inside = media.sniff(blob)
    assert kind == "application/octet-stream"
    assert [(blob[a:e], k) for a, e, k in inside] == [(good, "image/png"), (gz, "application/gzip")]
    d = spark.createDataFrame([(1, bytearray(good), "image/jpeg"), (2, None, None)], "id long, blob binary, declared string")
    rows = media.carve(d, declared_col="declared").collect()
    assert [(r["type"], r["corrected"], bytes(r["bytes"])) for r in rows] == [("image/png", True, good)]


def test_lengths_of_formats():
    """Every validator ends an item where it ends, with other bytes after it, and none of its beginnings is confirmed."""
    import gzip
    import io
    import zipfile

    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("a.txt", "hello" * 20)
        z.writestr("b.txt", "x")
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    crc8 = lambda x: functools.reduce(lambda c, y: media._CRC8[c ^ y], x, 0)
    crc16 = lambda x: functools.reduce(lambda c, y: (c << 8 & 0xFFFF) ^ media._CRC16[c >> 8 ^ y], x, 0)
    flac = b"fLaC" + b"\x80\0\0\x22" + bytes(34)
    for k in range(3):
        head = bytes([0xFF, 0xF8, 0x69, 0x18, k, 0x0F])
        body = head + bytes([crc8(head)]) + bytes(range(40))
        flac += body + crc16(body).to_bytes(2, "big")
    page = lambda n: b"OggS\0" + bytes(21) + b"\x01" + bytes([n]) + bytes(n)
    items = {
        "image/png": png(b"more"),
        "image/jpeg": b"\xff\xd8\xff\xe0\0\x10" + bytes(14) + b"\xff\xda\0\x02" + bytes(30) + b"\xff\xd9",
        "image/gif": b"GIF89a" + bytes(7) + b"\x2c" + bytes(9) + b"\x02\x03abc\0\x3b",
        "image/bmp": b"BM" + struct.pack("<IIIIii", 70, 0, 54, 40, 2, 2) + bytes(44),
        "application/pdf": b"%PDF-1.4\n stuff %%EOF",
        "application/zip": archive.getvalue(),
        "application/gzip": gzip.compress(b"hello" * 50),
        "audio/flac": flac,
        "audio/ogg": page(20) + page(30),
        "audio/mpeg": b"ID3\x04\0\0\0\0\0\x05" + bytes(5) + 2 * frame,
        "audio/wav": media.store(b"abcd"),
    }
    for kind, item in items.items():
        outer, inside = media.sniff(b"\1\2" + item + b"\3 tail \4")
        assert [(a, e, k) for a, e, k in inside][:1] == [(2, 2 + len(item), kind)], kind
        assert media.sniff(item)[0] == kind
        assert all(k != kind for _, _, k in media.sniff(b"\1" + item[: len(item) // 3])[1])


def test_many_headers_before_one_mark():
    blob = b"%PDF-1" * 200_000 + b"PK\x03\x04" * 200_000 + b"%%EOF"
    assert media.sniff(blob)[0] == "application/pdf"


# Language


def test_language(spark):
    rnd = random.Random(6)
    sets = {"en": EN, "de": DE, "fr": FR}
    rows = [(k, prose(rnd, sets[lang], 40), lang) for k, lang in enumerate(list(sets) * 60)]
    mixed = prose(rnd, EN, 12) + " " + prose(rnd, DE, 12)
    d = spark.createDataFrame([*rows, (900, mixed, None), (901, None, "en"), (902, "12 -- !", "de"), (903, "", None)], "doc_id long, text string, lang string")
    out = {r["id"]: r for r in langid.label_texts(d, langid.fit_language_model(d)).collect()}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(out[k]["lang_pred"] == rows[k][2] for k in held) >= 0.95 * len(held)
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in (901, 902, 903))
    assert {r.split(":")[0] for r in out[900]["runs"].split(",")} >= {"en", "de"} and 0 <= out[900]["score"] <= 1
    assert sorted(r["doc_id"] for r in langid.drop_unknown_language(spark, d, "").where("doc_id >= 900").collect()) == [900]
    unlabelled = d.withColumn("lang", F.lit(None).cast("string"))
    assert langid.drop_unknown_language(spark, unlabelled, "").count() == 181
    nothing = langid.label_texts(d.limit(0), langid.fit_language_model(d.limit(0)))
    assert nothing.count() == 0


def test_language_model_is_not_fitted_on_the_driver(spark, monkeypatch):
    rows = [(k, f"{'der die und nicht' if k % 2 else 'the and with not'} {k}\nzwei two {k % 7}", ("en", "de")[k % 2]) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = langid.fit_chains(langid.labelled_lines(d.where(langid.fold("doc_id", 5) != 0)))
    here = []
    monkeypatch.setattr(langid, "fit_chains", lambda lines, fit=langid.fit_chains: here.append(len(lines)) or fit(lines))
    got = langid.fit_language_model(d)
    assert not any(here) and got.languages == want.languages == ["de", "en"]
    assert np.array_equal(got.weights, want.weights) and np.array_equal(got.transitions, want.transitions)


def test_blocks_of_a_chain_pass_messages_on():
    rng = np.random.default_rng(8)
    lengths = np.array([1, 64, 65, 300, 7, 128, 2000])
    rows, t = rng.normal(size=(lengths.sum(), 3)).astype(np.float32), 2 * rng.normal(size=(3, 3)).astype(np.float32)
    for most in (5, 2000):
        got, at = langid.chain_posteriors(rows, lengths, t, most), 0
        for n in lengths:
            want, _ = langid.marginals(rows[None, at : at + n], np.ones((1, n), bool), t)
            assert np.allclose(got[at : at + n], want[0], atol=1e-4)
            at += n


def test_every_letter_of_a_run_counts():
    assert langid.words_of("ab1" + "x" * 60) == ["ab", "x" * 24, "x" * 24, "x" * 12]


def test_marginals_are_exact():
    rng = np.random.default_rng(7)
    e, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    want, z = np.zeros((4, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = math.exp(sum(e[0, k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        z += p
        for k, y in enumerate(path):
            want[k, y] += p
    got, _ = langid.marginals(e, np.ones((1, 4), bool), t)
    assert np.allclose(got[0], want / z)


# Language model


def _lm_tokens(x):
    return [*(x or "").encode().lower().split(), b""]


def _token_log10(v, model, counts, spelling, history, word):
    """A token's probability the long way; ``history`` has the three leaves before, None before the text."""
    u32, n, t = (1 << 32) - 1, len(v.words), model.tree
    ids = {w: k for k, w in enumerate(v.words)}
    back = [(n + lm.CLASSES if x is None else x) + 1 for x in history]
    one, two, three = (b * 0x9E3779B1 & u32 for b in back)
    mix = lambda x, salt: (((x & u32) ^ ((x & u32) >> 15) ^ salt) * 0x85EBCA6B) & u32
    keys = [mix(one, 1), mix(one + mix(two, 2), 3), mix(two, 4), mix(three, 5)]
    z = [float(t.bias[k]) + sum(float(model.rows[h >> (32 - model.row_bits), k]) for h in keys) for k in range(lm.CLASSES)]
    k = zlib.crc32(word[-2:]) % lm.CLASSES
    out = z[k] - math.log(sum(map(math.exp, z)))
    leaf = ids.get(word, n + k)
    for c in range(t.start[leaf], t.start[leaf + 1]):
        node = int(t.node[c])
        at = [((h ^ node * 0xC2B2AE35 & u32) * 0x9E3779B1 & u32) >> (32 - model.bits) for h in keys[: lm.NODE_FEATURES]]
        odds = float(t.odds[node]) + sum(float(model.weights[x]) for x in at)
        out -= math.log(1 + math.exp(-odds if t.bit[c] else odds))
    if leaf >= n:
        share = v.unseen[k] * math.exp(spelling.of([word])[0] - spelling.share[k])
        if v.rare_tokens[k]:
            share += (1 - v.unseen[k]) * counts.get(word, 0) / v.rare_tokens[k]
        out += math.log(share)
    return out / math.log(10), leaf


@pytest.mark.parametrize("head", [1 << 17, 40])
def test_lm(spark, monkeypatch, head):
    """Every column against the long way, with all words in the head and with rare ones joined."""
    monkeypatch.setattr(lm, "HEAD", head)
    rnd = random.Random(8)
    texts = [prose(rnd, rnd.choice([EN, DE]), 60) for _ in range(300)] + [None, "", "Neverseen ÄB\x1cC", "the the", "the the"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tail", F.lit(0)).withColumn("part", F.lit("x")).withColumn("row", F.lit(1))
    d = d.union(d.where("doc_id = 5"))
    monkeypatch.setattr(lm, "table", lambda *a: d)
    kept = {}
    monkeypatch.setattr(lm, "train", lambda texts, v, real=lm.train: kept.setdefault("m", (v, real(texts, v)))[1])
    rows = lm.op1_lm_scoring(spark, "").collect()
    assert len(rows) == len(texts) + 1
    v, model = kept["m"]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    c = collections.Counter(t for k, x in [*enumerate(texts), (5, texts[5])] if not held(k) for t in _lm_tokens(x))
    assert (v.tokens, v.distinct) == (sum(c.values()), len(c)) and (head == 40) == bool(v.rare_tokens.sum())
    spelling = lm.Spelling(v.words)
    for r in rows:
        tokens, score, history = _lm_tokens(texts[r["doc_id"]]), 0.0, [None] * 3
        for t in tokens:
            p, leaf = _token_log10(v, model, c, spelling, history, t)
            score, history = score + p, [leaf, *history[:2]]
        base = sum(math.log10((c[t] + 1) / (v.tokens + v.distinct + 1)) for t in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(tokens), sum(t in c for t in tokens), v.tokens)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, rel=1e-4)
    some = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)


def test_lm_of_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "table", lambda *a: spark.createDataFrame([], "doc_id long, text string"))
    assert lm.op1_lm_scoring(spark, "").count() == 0
    monkeypatch.setattr(lm, "table", lambda *a: spark.createDataFrame([(18, "all held out")], "doc_id long, text string"))
    r = lm.op1_lm_scoring(spark, "").first()
    assert r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and -1000 < r["score"] < 0


def test_lm_probabilities_add_up():
    """Over all leaves given any history, and over the strings of a class by their spelling."""
    rng = np.random.default_rng(9)
    words = [b"", *[bytes([x]) for x in range(1, 200)], *[bytes([x, x]) for x in range(1, 100)]]
    counts = np.sort(rng.zipf(1.5, len(words)).clip(1, 1000))[::-1]
    v = lm.Vocabulary(1, words, counts, int(counts.sum()), len(words), rng.integers(0, 50, lm.CLASSES).astype(float), rng.integers(0, 9, lm.CLASSES).astype(float))
    model = lm.empty_model(v)
    model.rows[:], model.weights[:] = rng.normal(size=model.rows.shape), rng.normal(size=model.weights.shape)
    leaves = np.arange(len(words) + lm.CLASSES)
    for k in range(5):
        history = np.repeat(rng.integers(0, 1 << 32, (4, 1), dtype=np.uint64).astype(np.uint32), len(leaves), axis=1)
        assert np.exp(lm.log_probabilities(model, leaves, history)).sum() == pytest.approx(1, abs=1e-3)
    spelling = lm.Spelling(words)
    strings = [bytes([x]) for x in range(256)] + [bytes([x, y]) for x in range(256) for y in range(256)]
    p = np.exp(spelling.of(strings))
    long = 1 - p.sum()
    heads = np.exp(spelling.of(words[1:])).sum()
    by_class = np.bincount([lm.class_of(w) for w in strings if w not in set(words)], p[[w not in set(words) for w in strings]], lm.CLASSES)
    assert np.exp(spelling.share).sum() == pytest.approx(1 - heads)
    assert 0 <= long and (by_class <= np.exp(spelling.share) + 1e-9).all() and np.exp(spelling.share).sum() - by_class.sum() == pytest.approx(long)


def test_lm_gradient_is_the_slope():
    rng = np.random.default_rng(10)
    words = [b"", b"a", b"bb", b"cab", b"dd", b"e"]
    v = lm.Vocabulary(1, words, np.array([9, 7, 5, 3, 2, 1]), 27, 6, np.zeros(lm.CLASSES), np.zeros(lm.CLASSES))
    model = lm.empty_model(v)
    model.rows[:], model.weights[:] = rng.normal(size=model.rows.shape), rng.normal(size=model.weights.shape)
    leaves = rng.integers(0, 6, 40)
    history = lm.histories_of(leaves, np.array([25, 15]), len(words) + lm.CLASSES)
    g, n = lm.gradient(model, leaves, history), 1 << model.bits
    for at in rng.choice(np.flatnonzero(g[: 2 * n]), 12, replace=False):
        values = model.rows.ravel() if at < n else model.weights
        old, ends = values[at % n], []
        for x in (0.05, -0.05):
            values[at % n] = old + x
            ends.append(lm.log_probabilities(model, leaves, history).sum())
        values[at % n] = old
        assert (ends[0] - ends[1]) / 0.1 == pytest.approx(g[at], abs=2e-3)


# Decontamination


def test_leaks(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rnd.randrange(15, 60)) + ". " + text(6) + ".") for k in range(30)] + [(40, None), (41, "")]
    docs, want = [], set()
    for k in range(120):
        body = text(rnd.randrange(10, 300))
        if k % 6 == 0:
            i = k // 6
            body += " " + items[i][1].upper().replace(" ", "  ") + " " + text(40)
            want.add((k, i))
        docs.append((k, body))
    w = items[25][1].split()
    w[3:5], w[10] = ["other", "pair"], "changed"
    docs += [(200, text(50) + " " + " ".join(w) + " " + text(50)), (201, None), (202, "")]
    want.add((200, 25))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]) for r in decontam.find_leaks(d, b).collect()}
    assert got == want
    assert decontam.find_leaks(d, b.limit(0)).count() == 0 and decontam.find_leaks(d.limit(0), b).count() == 0


def _vocabulary(rnd, n):
    return ["".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(n)]


def test_leaks_of_a_hot_item(spark):
    """A third of all rows hold one item, so its words are in over a third of the documents."""
    rnd = random.Random(31)
    words = _vocabulary(rnd, 3000)
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [f"{text(20)}. {text(12)}." for _ in range(4)]
    rows, want = [], set()
    for k in range(120):
        item = 0 if k % 3 == 0 else k if k < 4 else None
        rows.append((k, text(80) if item is None else f"{text(30)} {items[item]} {text(45)}"))
        want |= set() if item is None else {(k, item)}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = decontam.find_leaks(d, b).collect()
    assert {(r["id"], r["item_id"]) for r in got} == want
    assert all(r["answer"] == 1 for r in got)


def test_leaks_over_several_blocks(spark, monkeypatch):
    """Documents outside the fitted sample leak items of every block, whose words are in no other document."""
    rnd = random.Random(32)
    words = _vocabulary(rnd, 2000)
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [" ".join(_vocabulary(rnd, 40)) for _ in range(8)]
    rows = [(k, text(60)) for k in range(150)] + [(1000 + k, f"{text(30)} {x} {text(30)}") for k, x in enumerate(items)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    monkeypatch.setattr(decontam, "BLOCK", 2)
    monkeypatch.setattr(decontam, "FITTED_DOCS", 1)
    got = {(r["id"], r["item_id"]) for r in decontam.find_leaks(d, b).collect()}
    assert got == {(1000 + k, k) for k in range(8)}


@pytest.mark.parametrize("size", [4, 8, 16])
def test_leaks_of_short_items(spark, size):
    """Items shorter than a passage, whole among other words, are all found."""
    rnd = random.Random(34)
    words = _vocabulary(rnd, 3000)
    text = lambda n: " ".join(rnd.sample(words, n))
    items = [text(size) for _ in range(60)]
    rows = [(k, f"{text(rnd.randrange(20, 40))} {x} {text(40)}") for k, x in enumerate(items)] + [(100 + k, text(80)) for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(r["id"], r["item_id"]) for r in decontam.find_leaks(d, b).collect()}
    assert got == {(k, k) for k in range(60)}


@pytest.mark.parametrize("length", [300, 3_000, 20_000])
def test_leaks_in_documents_of_any_length(spark, monkeypatch, length):
    """Against judging every passage of every document: copies and paraphrases, among words that all documents and items share."""
    rnd = random.Random(35)
    words = _vocabulary(rnd, 4000)
    share = [1 / (k + 2) for k in range(len(words))]
    text = lambda n: rnd.choices(words, share, k=n)
    items = [" ".join(text(rnd.randrange(26, 60))) + ". " + " ".join(text(6)) + "." for _ in range(20)]
    docs = []
    for k in range(60 if length > 3_000 else 150):
        body = text(length)
        if k % 3 == 0:
            w = items[k // 3 % 20].split()
            kept = w if k % 2 else [x if rnd.random() < 0.7 else rnd.choice(words) for x in w]
            at = rnd.randrange(length)
            body[at:at] = kept
        docs.append((k, " ".join(body)))
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").withColumn("terms", F.lit(1)).withColumn("item_id", F.lit(2))
    b = spark.createDataFrame(list(enumerate(items)), "item_id int, text string").withColumn("doc_id", F.lit(1))
    monkeypatch.setattr(decontam, "table", lambda spark, sf_dir, name: d if name == "documents" else b)
    rows = decontam.op2_decontamination(spark, "").collect()
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in rows)
    vocabulary = {w: k for k, w in enumerate(sorted({w for t in items for w in decontam.words_of(t)}), 1)}
    df = np.zeros(len(vocabulary) + 1)
    for _, t in [*docs, docs[0]]:
        for w in set(decontam.words_of(t)) & vocabulary.keys():
            df[vocabulary[w]] += 1
    weights = decontam.term_weights(df, len(docs) + 1)
    read = [decontam.read_item(k, t, vocabulary, weights) for k, t in enumerate(items)]
    want = set()
    for k, t in docs:
        terms = np.array([vocabulary.get(w, 0) for w in decontam.words_of(t)])
        for item in read:
            if any(decontam.judge(item, terms, at)[2] for at in range(0, len(terms), decontam.STEP)):
                want.add((k, item.key))
    planted = {(k, k // 3 % 20) for k in range(1, len(docs), 2) if k % 3 == 0}
    assert planted <= got.keys() and got.keys() <= want and len(got) >= 0.9 * len(want)
    assert {n for (k, _), n in got.items() if k == 0} <= {2} and {n for (k, _), n in got.items() if k} == {1}
    kept = decontam.drop_contaminated(spark, d, "")
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _ in [*docs, docs[0]] if k not in {x for x, _ in got})


def test_common_subsequence(monkeypatch):
    rnd = random.Random(11)
    for _ in range(50):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(a, b) == decontam.common_subsequence(a, b, decontam._bits(a)) == table[-1][-1]
        monkeypatch.setattr(decontam, "WORD", rnd.randrange(1, 7))
        assert decontam.common_subsequence(a, b) == table[-1][-1]
        monkeypatch.undo()


# Toxicity


def test_toxicity(spark):
    rnd = random.Random(12)
    bad = ["grublin", "snorvek", "plimfar"]
    rows, labels = [], []
    for k in range(600):
        w = prose(rnd, EN, 60).split()
        y = int(k % 4 == 0)
        if y:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad) + rnd.choice(["", "er", "ing"]))
        rows.append((k, " ".join(w)))
        labels.append((k, y))
    d, b = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")
    out = {r["id"]: r["score"] for r in toxicity.score_toxicity(d, toxicity.fit_distance(toxicity.labelled_texts(d, b))).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((out[k] >= 0.5) == labels[k][1] for k in held) >= 0.9 * len(held)
    assert all(0 <= s <= 1 for s in out.values()) and out[900] == out[901] < 0.5
    none = toxicity.fit_distance(toxicity.labelled_texts(d.limit(0), b.limit(0)))
    assert toxicity.score_toxicity(d.limit(5), none).count() == 5


def test_words_that_no_item_counts_are_not_looked_up(monkeypatch):
    """The bound looks only at words that some item counts, keeps what judge calls a leak, and is exact unless places are shared."""
    rnd = random.Random(12)
    vocabulary = {f"w{k}".encode(): k for k in range(1, 400)}
    texts = [" ".join(f"w{rnd.randrange(1, 200)}" for _ in range(rnd.randrange(10, 40))) + "." for _ in range(12)]
    weights = np.array([0] + [rnd.random() + (k < 150) for k in range(1, 400)], np.float32)
    items = [decontam.read_item(k, t, vocabulary, weights) for k, t in enumerate(texts)]
    terms = np.array([rnd.randrange(150, 400) for _ in range(900)], np.uint32)
    for k, x in enumerate(items):
        terms[60 * k + 10 : 60 * k + 10 + len(x.terms)] = x.terms
    at, item = (x.ravel() for x in np.meshgrid(np.arange(0, 900, decontam.STEP), np.arange(len(items))))
    leaks = np.array([decontam.judge(items[i], terms, a)[2] is not None for a, i in zip(at, item)])
    want = []
    for a, i in zip(at, item):
        rarer, need = decontam.rarer_words(items[i], weights)
        n = len(items[i].terms)
        want.append(len(set(rarer) & set(terms[max(0, a - n) : a + decontam.PASSAGE + n].tolist())) >= need)
    for places in (1 << 22, 500):
        monkeypatch.setattr(decontam, "PAIRS", places)
        bound = decontam.WordBound(items, weights)
        words, before = bound.within(terms)
        assert len(words) < 0.6 * len(terms) and before[-1] == len(words)
        kept = bound.kept(words, before, np.zeros(len(at), int), np.full(len(at), 900), at, item)
        assert leaks.sum() >= len(items) and not (leaks & ~kept).any() and not (np.array(want) & ~kept).any()
        assert places == 500 or kept.tolist() == want
