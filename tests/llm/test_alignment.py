"""Alignment against the tokenizers as loaded and all pairs of tokens."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coursewright.llm import alignment, packing

A, B = packing.default_vocabulary(), alignment.default_pieces()


def texts():
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdeghilmnorstuäéñ中文") for _ in range(rnd.randrange(1, 12)))
    prose = lambda n: " ".join(word() + rnd.choice(["", "", "", ",", ".", ".\n", "\n\n", "  ", "\t", "'s", " – ", "　", "\xa0", "\x1c"]) for _ in range(n))
    rows = [(k, prose(rnd.randrange(1, 60))) for k in range(30)]
    rows += [(40, None), (41, ""), (42, " "), (43, "  two  spaces "), (44, "a▁b c"), (45, "<s> </s> <unk> <|endoftext|> <0x41>"), (46, "\U0001f600 \U0001f600\U0001f601 ퟿"), (47, "\x00 nul \x00"), (48, "ﬁ ﬀ ①")]
    rows += [(50, prose(700)), (51, "x" * 3000 + " " + prose(300)), (52, "\U0001f601" * 900 + " " + prose(50)), (53, "word " * 900), (54, "中" * 2500), (55, prose(400) + " ▁ " + prose(400))]
    return [*rows, rows[0], rows[-4], (None, "no id"), (None, None), (0, "another text of that id")]


ROWS = texts()


def expected(rows):
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], collections.Counter()
    for d, t in rows:
        full = (" " + (t or "")).encode()
        a = [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in first.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, piece(i)) for i in second.encode(t)] if t else []
        if not t or b"".join(w for _, w in a) != full or b"".join(w for _, w in b) != full:
            a = b = []
        spans = lambda x: [(i, e - len(w), e) for (i, w), e in zip(x, np.cumsum([len(w) for _, w in x]).tolist())]
        a, b = spans(a), spans(b)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        said, links, before = [], [], 0
        for c in cuts:
            ga, gb = ([x for x in side if before < x[2] <= c] for side in (a, b))
            said.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if max(x[1], y[1]) < min(x[2], y[2])]
            before = c
        count.update(links)
        docs.append((d, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(said).encode()).hexdigest() if said else ""))
    most = collections.Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return collections.Counter((d, n_a, n_b, g, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha) for d, n_a, n_b, g, links, sha in docs)


@pytest.fixture(scope="module")
def want():
    return expected(ROWS)


@pytest.mark.parametrize("chunk,frequent", [(1 << 15, 1 << 15), (300, 1 << 15), (97, 50), (1 << 15, 0)])
def test_all_rows(spark, want, chunk, frequent):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("id", "key", "k", "t", "pairs", "left")})
    out = alignment.link_scores(alignment.cut_lineage(alignment.align(d, chunk=chunk)), frequent).collect()
    names = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert collections.Counter(tuple(r[c] for c in names) for r in out) == want


def test_query(spark, want, monkeypatch):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    monkeypatch.setattr(alignment, "table", lambda *a: d)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert collections.Counter(tuple(r[c] for c in names) for r in alignment.op11_alignment(spark, "").collect()) == want
    monkeypatch.setattr(alignment, "table", lambda *a: d.limit(0))
    assert alignment.op11_alignment(spark, "").collect() == []


def same(x, y):
    assert (x.length, x.cut, x.broken, x.tail_length, x.closed.text, x.closed.n_groups, x.closed.n_a, x.closed.n_b) == (y.length, y.cut, y.broken, y.tail_length, y.closed.text, y.closed.n_groups, y.closed.n_a, y.closed.n_b)
    for p, q in ((x.head, y.head), (x.tail, y.tail), (x.closed, y.closed)):
        for f in ("pairs", "counts") if hasattr(p, "pairs") else ("a", "a_end", "b", "b_end"):
            assert getattr(p, f).tolist() == getattr(q, f).tolist()


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_fragments_are_a_monoid(chunk):
    text = texts()[9][1] + " antidisestablishmentarianism \U0001f600\U0001f601 x"
    parts = [alignment.fragment(t, left, right, A, B) for _, t, left, right in alignment.ranges(text, chunk)]
    whole = alignment.fragment(text, 0, len(text.encode()) + 1, A, B)
    then = lambda x, y: x.then(y, A, B)
    left = parts[0]
    for p in parts[1:]:
        left = then(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = then(p, right)
    for x in (left, right, alignment.compose(parts, A, B), then(alignment.empty(), whole), then(whole, alignment.empty())):
        same(x, whole)
    rnd = random.Random(chunk)
    for _ in range(50):
        k = rnd.randrange(len(parts) - 2)
        x, y, z = parts[k : k + 3]
        same(then(then(x, y), z), then(x, then(y, z)))


def test_ranges_cover_a_text_once_and_keep_long_units_whole():
    text = "ab " * 50 + "y" * 9000 + " " + "cd " * 50
    parts = list(alignment.ranges(text, 100, long_unit=500))
    assert sum(r - left for _, _, left, r in parts) == len(text) + 1 and [k for k, *_ in parts] == list(range(len(parts)))
    assert sum(len(t) for _, t, _, _ in parts if len(t) > 5000) < 9300
