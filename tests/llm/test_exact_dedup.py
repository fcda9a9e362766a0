"""Exact deduplication against plain Python."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from coursewright.llm import exact_dedup

BLANK = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def expected(rows):
    """(id, keep_id, group_size, kept, digest) of each row; repeated rows are kept once."""
    groups = collections.defaultdict(list)
    for k, (d, t) in enumerate(rows):
        groups[(t or "").translate(BLANK)].append((-len(t or ""), d is None, d or 0, k))
    out = collections.Counter()
    for bare, members in groups.items():
        first = min(members)
        for m in members:
            d = rows[m[3]][0]
            same = m[:3] == first[:3]
            out[d, rows[first[3]][0], len(members), "maybe" if same else "no", hashlib.sha256(bare.encode()).hexdigest()] += 1
    return out


def check(spark, rows, **how):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in ("id", "part", "task", "row", "digest", "best", "n", "kept", "keep")})
    got = exact_dedup.exact_groups(d, **how).collect()
    want = expected(rows)
    seen, kept = collections.Counter(), collections.Counter()
    for r in got:
        best = next(w for w in want if (w[0], w[1], w[2], w[4]) == (r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) and (w[3] == "maybe" or not r["kept"]))
        seen[r["id"], r["text_sha256"]] += 1
        kept[r["text_sha256"]] += r["kept"]
        assert best
    assert seen == sum((collections.Counter({(w[0], w[4]): n}) for w, n in want.items()), collections.Counter())
    assert set(kept.values()) <= {1}


EDGES = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (None, "ab  "), (None, "other"), (None, None), (7, "a b"), (8, "A b"), (9, "é" * 70_000), (10, "é " * 70_000), (11, "\U0001f600"), (12, "\U0001f600 ")]


@pytest.mark.parametrize("fan_in", [2, 3, 4, 16])
def test_groups(spark, fan_in):
    check(spark, EDGES + [(100 + k, f"text {k % 40}" + " " * (k % 3)) for k in range(300)], fan_in=fan_in)


def test_a_third_of_all_rows_equal(spark):
    rows = [(k, "hot  text" if k % 3 == 0 else f"own text {k}") for k in range(900)] + [(5000, "hot text")]
    check(spark, rows)


def test_merging_keeps_ranges_apart(spark):
    d = spark.createDataFrame([(k, f"t{k % 500}") for k in range(2000)], "doc_id long, text string").repartition(7)
    runs = exact_dedup.digest_runs(d, "doc_id", "text").withColumn("part", F.col("task") % 16).groupBy("part", *exact_dedup.KEY).agg(F.min("best").alias("best"), F.count("*").alias("n"))
    merged = exact_dedup.merge_runs(runs, 8).withColumn("top", F.hex("digest")).collect()
    assert len(merged) == 500 and sum(r["n"] for r in merged) == 2000
    by_part = collections.defaultdict(list)
    for r in merged:
        by_part[r["part"]].append(r["top"])
    bounds = [(min(v), max(v)) for _, v in sorted(by_part.items())]
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:])) and len(bounds) == 16
    assert all(r["best"]["id"] == int(r["best"]["id"]) < 500 for r in merged)


def test_query(spark, monkeypatch):
    d = spark.createDataFrame(EDGES, "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "table", lambda *a: d)
    out = exact_dedup.op12_exact_dedup(spark, "")
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == len(EDGES)
    monkeypatch.setattr(exact_dedup, "table", lambda *a: d.limit(0))
    assert exact_dedup.op12_exact_dedup(spark, "").collect() == []
