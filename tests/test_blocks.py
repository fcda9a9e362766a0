"""Pairs in blocks, runs of words counted without their table, and what is made of both, against brute force."""

import random

import numpy as np
import pytest

from coursewright.operators import cells, profile, similarity, term_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unshuffled(df):
    """No pair is shuffled or joined; what lies below the blocks is checkpointed."""
    p = plan(df)
    assert "CartesianProduct" in p
    assert not any(x in p for x in ("Exchange", "SortMergeJoin", "ShuffledHashJoin", "FlatMapGroups")), p


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 10))
    return np.vstack([centres[rng.integers(0, 5, 120)] + rng.normal(0, 0.4, (120, 10)), rng.normal(0, 1, (60, 10))]).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, embedding array<float>")


def test_pairs_are_not_shuffled(spark, vectors):
    unshuffled(cells.vector_pairs(frame(spark, vectors), 0.3))
    texts = [(k, f"alpha beta gamma w{k % 7} w{k % 5}", f"d{k % 3}", "c", k, "t") for k in range(60)]
    courses = spark.createDataFrame(texts, "id long, text string, dept string, category string, activity long, title string")
    described = similarity.described_pairs(term_index.TermVectors.of(courses.select("id", "text")), courses, 0.5)
    unshuffled(described)
    pairs = described.select("id_1", "id_2", "score")
    columns = [c for c in described.columns if "title" not in c]
    joined = similarity.describe_pairs(pairs, courses).select(*columns)
    assert described.count() > 60 and sorted(map(str, described.select(*columns).collect())) == sorted(map(str, joined.collect()))


def test_a_task_prepares_a_block_once(spark):
    import uuid

    import pyarrow as pa
    from pyspark import TaskContext

    from coursewright.operators.blocks import block_pairs

    def compare(x, y, same):
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([x[0]]), pa.array([y[0]]), pa.array([x[1] * y[1] if not same else x[1] * (x[1] - 1) // 2])], names=["task", "x", "y", "pairs"])

    found = block_pairs(spark.range(3000), lambda t: (uuid.uuid4().hex, t.num_rows), compare, "task long, x string, y string, pairs long", 20).collect()
    assert sum(r["pairs"] for r in found) == 3000 * 2999 // 2
    blocks = {k: {r[c] for r in found if r["task"] == k for c in "xy"} for k in {r["task"] for r in found}}
    # at most those of two partitions, not one for each pair of blocks
    assert max(map(len, blocks.values())) <= 2 * 10 and max(sum(r["task"] == k for r in found) for k in blocks) > 20


def test_alike_texts_are_multiplied_as_a_matrix(monkeypatch):
    """Many pairs of alike texts and few of others, in one block: all that reach the threshold, with the products of all terms."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    dims, n = 400, 300
    full = np.zeros((n, dims))
    for k in range(n):
        some = rng.choice(100, 80, replace=False) + (k % 4) * 100 if k % 3 else rng.choice(dims, 6, replace=False)
        full[k, some] = rng.integers(1, 4, len(some))
    full[7], full[8] = full[9], full[9]
    lists = [np.flatnonzero(v) for v in full]
    t = pa.table({"id": list(range(n)), "ranks": pa.array(lists, pa.list_(pa.int16())), "counts": pa.array([full[k][x].astype(int) for k, x in enumerate(lists)], pa.list_(pa.int32())), "norm": np.linalg.norm(full, axis=1)})
    half = t.slice(0, 170), t.slice(170)
    want = unit(full) @ unit(full).T
    entries = []
    spans = term_index._spans
    monkeypatch.setattr(term_index, "_spans", lambda starts, sizes: entries.append(int(sizes.sum())) or spans(starts, sizes))
    got = {}
    for a, b in ((0, 0), (0, 1), (1, 1)):
        x, y = (term_index._Block.of(half[k], np.ones(dims)) for k in (a, b))
        for p, q, score in term_index._near(x, y, a == b, dims, 0.5):
            ids = [(min(i, j), max(i, j)) for i, j in zip(x.rows["id"].take(pa.array(p)).to_pylist(), y.rows["id"].take(pa.array(q)).to_pylist())]
            assert not got.keys() & set(ids) and len(set(ids)) == len(ids)
            got |= dict(zip(ids, score))
    hits = {(i, j) for i in range(n) for j in range(i + 1, n) if want[i, j] >= 0.5}
    assert hits <= set(got) and len(hits) > 500 and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert sum(entries) < 0.6 * sum(np.count_nonzero(full[j]) for _, j in got)


def test_course_pairs_by_brute_force(spark, monkeypatch, vectors):
    monkeypatch.setattr(similarity, "VECTORS", 25)
    n = len(vectors)
    texts, lengths = np.roll(vectors, 1, axis=0), [(k * 7) % 50 for k in range(n)]
    rows = [(k, [float(c) for c in vectors[k]], None if k % 9 == 0 else [float(c) for c in texts[k]], lengths[k]) for k in range(n)]
    d = spark.createDataFrame([*rows, (900, None, rows[1][2], 30)], "id long, title_vec array<float>, text_vec array<float>, text_length int")
    t, v = unit(vectors.astype(float)), unit(texts.astype(float))
    v[::9] = 0
    found = similarity.course_pairs(d, 0.3)
    unshuffled(found)
    got = {(r["id_1"], r["id_2"]): r["score"] for r in found.collect()}
    want = {}
    for a in range(n):
        for b in range(a + 1, n):
            x, y = lengths[a], lengths[b]
            w = 1.0 if 0 in (x, y) else 0.7 if min(x, y) < 20 else 0.4
            s = round(w * round(t[a] @ t[b], 6) + (1 - w) * round(v[a] @ v[b], 6), 8)
            if s >= 0.3:
                want[a, b] = s
    close = {k for k in set(got) | set(want) if abs(got.get(k, want.get(k)) - 0.3) < 3e-6}
    assert set(got) ^ set(want) <= close and all(abs(got[k] - want[k]) < 3e-6 for k in set(got) & set(want)) and len(want) > 100


def test_bands_are_counted(spark, monkeypatch, vectors):
    monkeypatch.setattr(cells, "VECTORS", 30)
    d = frame(spark, vectors)
    want = {r["band"]: r["n"] for r in similarity.histogram(cells.vector_pairs(d, 0.2), d).collect()}
    assert {r["band"]: r["n"] for r in similarity.vector_histogram(d).collect()} == want
    assert {r["band"]: r["n"] for r in similarity.vector_histogram(d.limit(0)).collect()} == {"very_low": 0}


def brute_clusters(s, least):
    near = (s >= 0.9) & ~np.eye(len(s), dtype=bool)
    core = near.sum(1) + 1 >= least
    label = np.where(core, np.arange(len(s)), -1)
    for _ in range(len(s)):
        for k in np.flatnonzero(core):
            label[k] = min(label[k], *label[near[k] & core], label[k])
    for k in np.flatnonzero(~core):
        if (near[k] & core).any():
            label[k] = label[np.flatnonzero(near[k] & core)[0]]
    return label.tolist()


def test_vector_clusters_by_brute_force(spark, monkeypatch, vectors):
    monkeypatch.setattr(cells, "VECTORS", 30)
    u = unit(vectors.astype(float))
    got = dict(profile.vector_clusters(frame(spark, vectors), 0.9, 4).collect())
    assert [got[k] for k in range(len(u))] == brute_clusters(np.round(u @ u.T, 6), 4) and len(set(got.values())) > 2
    links = spark.createDataFrame([(0, 1), (1, 0), (0, 1), (5, 6)], "id_1 long, id_2 long")
    assert dict(profile.density_clusters(spark.range(7), links, 3).collect()) == dict.fromkeys(range(7), -1)


@pytest.mark.parametrize("most,vocabulary,listed", [(1, 40, 1 << 17), (3, 40, 1 << 17), (3, 100_000, 1 << 17), (3, 60, 5), (2, 7, 1 << 17)])
def test_runs_are_counted_whole(spark, monkeypatch, most, vocabulary, listed):
    monkeypatch.setattr(term_index, "LISTED", listed)
    rnd = random.Random(most)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.8)) % 60}" for _ in range(rnd.randrange(0, 40))) for _ in range(80)]
    d = spark.createDataFrame([*enumerate(texts), (90, None), (91, "the"), (92, "é日本 w1 w2 w3")], "id long, text string")
    tf = term_index.gram_counts(d, most)
    want = {r["term"]: (r["total"], r["df"]) for r in term_index.top_by_total(tf, vocabulary).collect()}
    g = term_index.Grams.of(d, most, vocabulary)
    assert dict(zip(g.terms, zip(g.totals.tolist(), g.frequencies.tolist()))) == want
    counts = {(r["id"], g.terms[k]): n for r in g.rows.collect() for k, n in zip(r["ranks"], r["counts"])}
    assert counts == {(r["id"], r["term"]): r["tf"] for r in tf.collect() if r["term"] in want}


def test_slices_of_a_batch_are_small(monkeypatch):
    """However many texts come at once, what is held of them at a time has a bound; one long text is a slice of its own."""
    import pyarrow as pa

    monkeypatch.setattr(term_index, "HELD", 50)
    rnd = random.Random(4)
    texts = [[f"w{rnd.randrange(20)}" for _ in range(n)] for n in (0, 10, 40, 1, 300, 0, 0, 50, 7, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], names=["id", "t"])
    words = pa.array(sorted({w for t in texts for w in t})[:12])
    found = list(term_index._words([batch.slice(0, 6), batch.slice(6)], words))
    assert max(at[-1] for _, _, at in found if len(at) > 2) <= 50 and len(found) >= 4
    got = {i: x[a:b].tolist() for ids, x, at in found for i, a, b in zip(ids.to_pylist(), at, at[1:])}
    assert got == {k: [words.to_pylist().index(w) if w in words.to_pylist() else -1 for w in t] for k, t in enumerate(texts)}


def test_keywords_and_acronyms_are_found_in_their_row(spark):
    from pyspark.sql import functions as F

    from coursewright.functions import text

    d = spark.createDataFrame([(1, "bb aa aa cc"), (2, ""), (3, None), (4, "the of")], "id long, text string")
    found = profile.keywords(d, 2)
    assert "Exchange" not in plan(found) and dict(found.collect()) == {1: "aa,bb"}
    rnd = random.Random(9)
    parts = ["HR", "IT ", "Big Maker", " (x)", "((", ")", ": ", ";", " A.B.", "HR (IT) ", "éHR:", "HRé;", "xIT;", " ", " :", "of", "A1 (y", "B C (AB)"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12))) for _ in range(400)]
    bare = F.array_distinct(F.transform(text._found(F.col("t"), text.ACRONYMS), lambda a: F.regexp_replace(a, r"(?U)[^\w\s]", "")))
    said = lambda a, after: F.regexp_instr(F.col("t"), F.concat(F.lit("(?U)"), a, F.lit(after))) > 0
    twice = lambda a: F.size(F.split("t", F.concat(F.lit(r"\Q"), a, F.lit(r"\E")), -1)) > 2
    want = F.array_sort(F.filter(bare, lambda a: (F.length(a) >= 2) & (twice(a) | said(a, r"\s*\([^)]+\)") | said(F.concat(F.lit(r"\b"), a), r"\b\s*[:;]"))))
    got = text.acronyms(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", got.alias("got"), want.alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == [] and sum(len(r["got"]) for r in rows) > 300
    assert "regexp_instr" not in str(got)


def test_a_report_stores_no_pairs(spark, monkeypatch):
    """Parts of the report equal those made of all pairs one by one, though only their sums are kept."""
    rnd = random.Random(2)
    base = [" ".join(f"w{rnd.randrange(40)}" for _ in range(12)) for _ in range(6)]
    rows = []
    for k in range(150):
        words = base[k % 6].split()
        words[rnd.randrange(12)] = f"w{rnd.randrange(60)}"
        rows.append((k, f"t{k}", " ".join(words), None if k % 17 == 0 else "" if k % 13 == 0 else f"d{k % 4}", "c", k % 9))
    d = spark.createDataFrame(rows, "id long, title string, text string, dept string, category string, activity long")
    monkeypatch.setattr(term_index, "BLOCK", 40)
    r = similarity.content_report(d)
    pairs = similarity.described_pairs(term_index.TermVectors.of(similarity.representatives(d, "id", "text").select("id", "text")), d, 0.7).cache()
    nodes = similarity.network_nodes(pairs)
    want = {
        "counts": similarity.counts(pairs),
        "across": similarity.cross_department(pairs).select("id_1", "id_2", "score", "dept_1", "dept_2"),
        "consolidation": similarity.consolidation(pairs),
        "departments": similarity.department_matrix(pairs),
        "nodes": nodes,
        "edges": similarity.network_edges(pairs, nodes),
    }
    n = pairs.count()
    assert n > 500
    for k, w in want.items():
        assert sorted(map(str, r[k].collect())) == sorted(map(str, w.collect())), k
    assert {(x["part"], x["n"]) for x in r["totals"].collect()} == {("pairs", n), ("duplicates", pairs.where("score >= 0.8").count())}
    summary = similarity.pair_summary(term_index.TermVectors.of(d.select("id", "text")), d, 0.7)
    assert summary.where("part in ('group', 'degree')").count() < n / 2
    empty = similarity.content_report(d.limit(0))
    assert empty["counts"].first()["pairs"] == 0 and empty["nodes"].count() == empty["edges"].count() == 0


@pytest.mark.parametrize("repeated", [1 << 18, 0])
def test_distinct_texts_are_not_shuffled(spark, monkeypatch, repeated):
    rnd = random.Random(5)
    rows = [(k, f"text {k} {rnd.random()}") for k in range(200)]
    rows += [(900 + k, rows[k % 20][1]) for k in range(60)] + [(3, rows[3][1]), (3, "another"), (None, "another"), (None, "nobody's"), (5, ""), (6, ""), (7, None)]
    d = spark.createDataFrame(rows, "doc int, t string")
    want = {}
    for k, t in rows:
        if t is not None:
            least, n = want.get(t, (None, 0))
            want[t] = (k if least is None else least if k is None else min(k, least), n + 1)
    monkeypatch.setattr(similarity, "REPEATED", repeated)
    r = similarity.representatives(d, "doc", "t")
    assert {x["text"]: (x["id"], x["copies"]) for x in r.collect()} == want and r.count() == len(want)
    # texts that no other row has leave the plan before the one exchange of texts
    p = plan(r).split("Initial Plan")[-1]
    assert p.count("Exchange hashpartitioning(text") == 1 and ("LeftAnti" in p) == bool(repeated), p
    assert not repeated or p.index("LeftAnti") < p.index("LeftSemi") and p.index("Exchange hashpartitioning(text") < p.index("LeftSemi"), p


def shared_texts(spark, n=150):
    """Courses many of whose texts are alike, with departments that are null or empty."""
    rnd = random.Random(2)
    base = [" ".join(f"w{rnd.randrange(40)}" for _ in range(12)) for _ in range(6)]
    rows = []
    for k in range(n):
        words = base[k % 6].split()
        words[rnd.randrange(12)] = f"w{rnd.randrange(60)}"
        rows.append(((k * 37) % 1009, f"t{k}", " ".join(words), None if k % 17 == 0 else "" if k % 13 == 0 else f"d{k % 4}", None if k % 19 == 0 else f"c{k % 3}", k % 9))
    return spark.createDataFrame(rows, "id long, title string, text string, dept string, category string, activity long")


def counting(monkeypatch):
    """How often pairs of all blocks are computed."""
    runs, pairs = [], term_index.block_pairs
    monkeypatch.setattr(term_index, "block_pairs", lambda *a, **k: runs.append(1) or pairs(*a, **k))
    return runs


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_a_heatmap_finds_pairs_once_and_lists_none(spark, monkeypatch):
    d = shared_texts(spark)
    monkeypatch.setattr(term_index, "BLOCK", 40)
    v = term_index.TermVectors.of(d.select("id", "text"))
    want = similarity.department_matrix(similarity.described_pairs(v, d, 0.7)).collect()
    from coursewright.plans import text_queries

    monkeypatch.setattr(text_queries, "_vectors", lambda *_: v)
    monkeypatch.setattr(text_queries, "courses_text", lambda *_: d)
    runs = counting(monkeypatch)
    got = text_queries.dept_heatmap(spark, "")
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) > 15
    # no pair is left to find when the rows are read
    assert len(runs) == 1 and "PythonMapInArrow" not in plan(got) and "MapInArrow" not in plan(got)


def test_flags_are_told_where_pairs_are_found(spark, monkeypatch):
    d = shared_texts(spark)
    monkeypatch.setattr(term_index, "BLOCK", 40)
    v = term_index.TermVectors.of(d.select("id", "text"))
    from coursewright.plans import text_queries

    monkeypatch.setattr(text_queries, "_vectors", lambda *_: v)
    monkeypatch.setattr(text_queries, "courses_text", lambda *_: d)
    got = text_queries.tfidf_pairs(spark, "")
    assert same(got, similarity.described_pairs(v, d, 0.7)) and got.where("is_cross_dept and not is_cross_category").count() > 10
    # departments and categories do not leave the task with each pair
    assert "dept_" not in plan(got) and "category_" not in plan(got)


def test_clusters_skip_pairs_of_one_cluster(spark, monkeypatch):
    d = shared_texts(spark, 240)
    monkeypatch.setattr(term_index, "BLOCK", 20)
    v = term_index.TermVectors.of(d.select("id", "text"), 3)
    want = profile.density_clusters(d, term_index.similar_pairs(v, 0.7), 5)
    met, pairs = [], term_index.block_pairs

    def seen(*a, **k):
        found = pairs(*a, **k)
        met.append((a[5], a[6] is not None, a[7]))
        return found

    monkeypatch.setattr(term_index, "block_pairs", seen)
    got = profile.text_clusters(d.select("id", "text"))
    assert same(got, want) and len({r["cluster"] for r in got.collect()}) > 3
    # first neighbouring blocks alone, then only blocks that may add something
    assert met == [((), False, True), (("unknown", "id"), True, False), (("place", "id"), True, False)]


def test_blocks_that_are_apart_do_not_meet(spark):
    import pyarrow as pa

    from coursewright.operators.blocks import block_pairs

    def compare(x, y, same):
        a, b = (t["id"].to_pylist() for t in (x, y))
        yield pa.RecordBatch.from_arrays([pa.array([min(a)]), pa.array([min(b)])], names=["x", "y"])

    near = lambda low_i, high_i, low_j, high_j: (low_j <= high_i + 1) & (low_i <= high_j + 1)
    met = block_pairs(spark.range(1000), lambda t: t, compare, "x long, y long", 20, ("id",), near).collect()
    assert len(met) < 200 and all(abs(r["x"] - r["y"]) <= 21 for r in met) and {r["x"] for r in met if r["x"] == r["y"]}.issuperset({0})
    chained = block_pairs(spark.range(1000), lambda t: t, compare, "x long, y long", 20, chained=True).collect()
    assert 50 < len(chained) <= 2 * 60


def test_few_or_summed_pairs_equal_those_of_all_pairs(spark, monkeypatch):
    d = shared_texts(spark)
    monkeypatch.setattr(term_index, "BLOCK", 20)
    v = term_index.TermVectors.of(d.select("id", "text"))
    pairs = similarity.described_pairs(v, d, 0.7).cache()
    steep = pairs.orderBy(similarity.F.desc("score")).limit(60).agg({"score": "min"}).first()[0]
    monkeypatch.setattr(similarity, "STEEP", (1.0, steep, 0.71))
    runs = counting(monkeypatch)
    for part, made in (("across", similarity.cross_department), ("high", similarity.consolidation)):
        best = similarity.best_pairs(v, d, 0.7 if part == "across" else 0.8, part)
        columns = ["id_1", "id_2", "score", *(["dept_1", "dept_2"] if part == "across" else ["keep_course", "detail"])]
        assert same(made(best).select(*columns), made(pairs)) and made(pairs).count() == (5 if part == "across" else 20)
    # lower scores were not looked for once there were enough
    assert steep > 0.8 and len(runs) <= 4
    assert same(similarity.most_linked(v, 0.7), similarity.network_nodes(pairs))
    want = pairs.where("is_cross_dept and score >= 0.8").count(), pairs.where("score > 0.85").count()
    assert min(want) > 10 and tuple(similarity.duplicate_counts(v, d).first()) == want
    assert str(similarity.counts_of(similarity.pair_groups(v, d, 0.7)).first()) == str(similarity.counts(pairs).first())
