"""Similarity joins over TF-IDF and embeddings, and what is made of their pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions.numbers import similarity_bin
from coursewright.functions.storage import cut_lineage
from coursewright.operators.blocks import block_pairs
from coursewright.operators.cells import SLACK, VECTORS, matrix, unit_rows, vector_bands
from coursewright.operators.term_index import TermVectors, folded_pairs, similar_pairs


def weighted_text(title: Column, *others: Column) -> Column:
    """Title three times, then the other texts; missing parts are skipped."""
    return F.concat_ws(" ", title, title, title, *others)


def weighted_texts(courses: DataFrame, id_col: str, title: str, *others: str) -> DataFrame:
    """``id, text`` of the courses whose weighted text is not blank."""
    return courses.select(F.col(id_col).alias("id"), weighted_text(F.col(title), *map(F.col, others)).alias("text")).where(F.trim("text") != "")


def cross_department(described: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most similar pairs across departments."""
    return described.where("is_cross_dept").orderBy(F.desc("score"), "id_1", "id_2").limit(n)


#: Hashes of repeated texts that each task is sent; with more, all texts are grouped.
REPEATED = 1 << 18


def representatives(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, copies`` of each distinct text, under its smallest id: copies never multiply pairs.

    A text whose hash no other row has is distinct and stays where it is. Only
    those that share a hash are shuffled and compared, as whole texts. A small
    table that is read by fewer tasks than there are cores is dealt out first.
    """
    d = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() < cores:
        d = d.repartition(cores)
    hashed = d.withColumn("h", F.xxhash64("text"))
    repeated = cut_lineage(hashed.groupBy("h").count().where("count > 1").select("h"))
    grouped = lambda rows: rows.groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    if repeated.count() > REPEATED:
        return grouped(d).select("id", "text", "copies")
    alone = hashed.join(F.broadcast(repeated), "h", "left_anti").select("id", "text", F.lit(1).cast("long").alias("copies"))
    return alone.union(grouped(hashed.join(F.broadcast(repeated), "h", "left_semi")).select("id", "text", "copies"))


def members(df: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, representative`` of every row; texts meet by hash and are compared."""
    r = reps.select(F.xxhash64("text").alias("__h"), F.col("text").alias("__t"), F.col("id").alias("representative"))
    return df.withColumn("__h", F.xxhash64(text_col)).join(r, "__h").where(F.col(text_col) == F.col("__t")).select(F.col(id_col).alias("id"), "representative")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _attributes(courses: DataFrame, *columns: str) -> DataFrame:
    """``id`` and those of title, department, category and activity, one row an id; duplicate ids count once."""
    one = courses.groupBy("id").agg(F.max_by(F.struct("title", "dept", "category", "activity"), F.struct(F.coalesce("activity", F.lit(-1)), "title")).alias("c"))
    return one.select("id", *[F.coalesce("c.activity", F.lit(0)).alias(c) if c == "activity" else F.col(f"c.{c}").alias(c) for c in columns])


def _flagged(p: DataFrame, high: float) -> DataFrame:
    differ = lambda c: F.coalesce((F.col(f"{c}_1") != F.col(f"{c}_2")) & (F.col(f"{c}_1") != "") & (F.col(f"{c}_2") != ""), F.lit(False))
    return p.withColumns({"is_cross_dept": differ("dept"), "is_cross_category": differ("category"), "is_high": F.col("score") >= high, "priority": F.when(differ("dept"), 1).otherwise(2)})


def describe_pairs(pairs: DataFrame, courses: DataFrame, high: float = 0.9) -> DataFrame:
    """Pairs with both courses' title, department, category and activity, and flags; duplicate ids count once."""
    one = _attributes(courses, "title", "dept", "category", "activity")
    side = lambda k: one.select(*[F.col(c).alias(f"{c}_{k}") for c in one.columns])
    p = pairs.join(side(1), "id_1", "left").join(side(2), "id_2", "left")
    return _flagged(p.withColumns({f"activity_{k}": F.coalesce(f"activity_{k}", F.lit(0)) for k in (1, 2)}), high)


def described_pairs(vectors: TermVectors, courses: DataFrame, threshold: float, high: float = 0.9) -> DataFrame:
    """``describe_pairs`` of all similar pairs, without titles: the attributes go with the vectors, so pairs are never joined to them."""
    return _flagged(similar_pairs(vectors.carrying(_attributes(courses, "dept", "category", "activity")), threshold), high)


def potential_duplicates(described: DataFrame, threshold: float = 0.8) -> DataFrame:
    text = F.when(F.col("is_cross_dept"), "Cross-department duplicate - consider consolidation or collaboration").otherwise("Review for potential consolidation")
    return described.where(F.col("score") >= threshold).withColumn("recommendation", text)


def consolidation(described: DataFrame, threshold: float = 0.8, limit: int = 20) -> DataFrame:
    """Which course of a pair to keep: the more active one, the first on a tie."""
    first = F.col("activity_1") >= F.col("activity_2")
    d = described.where(F.col("score") >= threshold).select(
        "id_1",
        "id_2",
        "score",
        F.when(first, F.col("id_1")).otherwise(F.col("id_2")).alias("keep_course"),
        F.when(first, F.col("id_2")).otherwise(F.col("id_1")).alias("consolidate_course"),
        (F.col("activity_1") - F.col("activity_2")).alias("activity_diff"),
        F.when(F.col("is_cross_dept"), "Cross-department content overlap - consider collaboration").otherwise("Content duplicate - consider consolidation").alias("detail"),
    )
    return d.orderBy(F.desc("score"), "id_1", "id_2").limit(limit)


def counts(described: DataFrame) -> DataFrame:
    s = F.col("score")
    return described.agg(
        F.count("*").alias("pairs"),
        F.count_if(s >= 0.8).alias("high"),
        F.count_if((s >= 0.6) & (s < 0.8)).alias("medium"),
        F.count_if("is_cross_dept").alias("cross_dept"),
        F.round(F.avg(F.col("is_cross_dept").cast("double")) * 100, 4).alias("cross_dept_pct"),
        F.round(F.avg(s), 6).alias("avg_score"),
    )


def histogram(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs by similarity band; pairs that are not listed are very low."""
    n = nodes.agg(F.count("*").alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("all"))
    listed = pairs.where("score >= 0.2").groupBy(similarity_bin(F.col("score")).alias("band")).agg(F.count("*").alias("n"))
    rest = listed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).join(F.broadcast(n)).select(F.lit("very_low").alias("band"), (F.col("all") - F.col("n")).alias("n"))
    return listed.union(rest)


def vector_histogram(vectors: DataFrame) -> DataFrame:
    """``histogram`` of all pairs of ``id, embedding``, counted where they are multiplied; no pair is listed."""
    n = vectors.agg(F.count("*").alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("all"))
    listed = cut_lineage(vector_bands(vectors, (0.2, 0.4, 0.6, 0.8)).where("n > 0")).select(similarity_bin(F.col("least")).alias("band"), "n")
    rest = listed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).join(F.broadcast(n)).select(F.lit("very_low").alias("band"), (F.col("all") - F.col("n")).alias("n"))
    return listed.union(rest)


def network_nodes(pairs: DataFrame, least: float = 0.6, limit: int = 50) -> DataFrame:
    """Courses by their number of links, the most linked first."""
    ends = pairs.where(F.col("score") >= least).select(F.explode(F.array("id_1", "id_2")).alias("id"))
    return _most_linked(ends.groupBy("id").agg(F.count("*").alias("degree")), limit)


def _most_linked(degrees: DataFrame, limit: int = 50) -> DataFrame:
    return degrees.withColumn("size", 10 + 5 * F.col("degree")).orderBy(F.desc("degree"), "id").limit(limit)


def network_edges(pairs: DataFrame, nodes: DataFrame, least: float = 0.6) -> DataFrame:
    """Links between the given nodes."""
    ends = F.broadcast(nodes.select("id"))
    p = pairs.where(F.col("score") >= least)
    return p.join(ends.withColumnRenamed("id", "id_1"), "id_1", "left_semi").join(ends.withColumnRenamed("id", "id_2"), "id_2", "left_semi").select("id_1", "id_2", "score")


def department_matrix(described: DataFrame) -> DataFrame:
    """Mean similarity and pairs between departments, the same in both directions; 1 on the diagonal."""
    p = described.where("dept_1 is not null and dept_2 is not null and dept_1 <> dept_2").select("dept_1", "dept_2", "score")
    both = p.union(p.select("dept_2", "dept_1", "score"))
    off = both.groupBy("dept_1", "dept_2").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.count("*").alias("pairs"))
    diagonal = described.select(F.explode(F.array("dept_1", "dept_2")).alias("dept_1")).where("dept_1 is not null").groupBy("dept_1").agg(F.count("*").alias("pairs"))
    return off.union(diagonal.select("dept_1", F.col("dept_1").alias("dept_2"), F.lit(1.0).alias("mean_score"), "pairs"))


def combined_score(title: Column, description: Column, length_1: Column, length_2: Column, title_weight: float = 0.4) -> Column:
    """Weighted similarity; a description under 20 characters gives half of its weight to the title, a missing one all."""
    w = F.when((length_1 == 0) | (length_2 == 0), 1.0).when((length_1 < 20) | (length_2 < 20), title_weight + (1 - title_weight) / 2).otherwise(title_weight)
    return w * title + (1 - w) * F.coalesce(description, F.lit(0.0))


#: Scores from which a pair is a duplicate, and from which it is a link.
DUPLICATE, LINK = 0.8, 0.6
#: Pairs that the report lists across departments, and for consolidation.
ACROSS, CONSOLIDATED = 5, 20
KEYS = ("part", "id_1", "id_2", "score", "dept_1", "dept_2", "activity_1", "activity_2", "is_cross_dept", "band")


def _numbered(x: pa.Table, y: pa.Table, c: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of a column's values in two blocks, -1 for null, and the values."""
    both = pa.concat_arrays([part.cast(pa.string()) for t in (x, y) for part in t[c].chunks]).dictionary_encode()
    codes = pc.fill_null(both.indices, -1).to_numpy()
    return codes[: x.num_rows], codes[x.num_rows :], both.dictionary


def _differing(x: pa.Table, y: pa.Table, p: np.ndarray, q: np.ndarray, c: str) -> np.ndarray:
    """Whether two rows have different values of a column, neither of them null or empty."""
    a, b, values = _numbered(x, y, c)
    some = np.array([*[v != "" for v in values.to_pylist()], False])
    return (a[p] != b[q]) & some[a[p]] & some[b[q]]


def pair_summary(vectors: TermVectors, courses: DataFrame, threshold: float, parts: tuple[str, ...] = ("group", "degree", "across", "high")) -> DataFrame:
    """All that the report needs of the similar pairs, by ``KEYS``: their number ``n`` and sum of scores ``total``.

    ``part`` is one of ``parts``: ``group`` (by departments, whether they
    differ, and band: 2 for duplicates, 1 for links, else 0), ``degree`` (links
    by ``id_1``), ``across`` and ``high`` (each task's best pairs). Tasks sum
    up what they find, so no pair is stored or shuffled; the rows are those of
    the courses and departments.
    """
    v = vectors.carrying(_attributes(courses, "dept", "activity"))
    return cut_lineage(folded_pairs(v, threshold, *_summing(v, parts)).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("total").alias("total")))


def _summing(v: TermVectors, parts: tuple[str, ...]) -> tuple[Callable[..., pa.RecordBatch], str]:
    """What makes the parts of ``pair_summary`` of pairs, and its schema."""
    kinds = dict(v.rows.dtypes)
    schema = f"part string, id_1 {kinds['id']}, id_2 {kinds['id']}, score double, dept_1 string, dept_2 string, activity_1 long, activity_2 long, is_cross_dept boolean, band int, n long, total double"

    def fold(x: pa.Table, y: pa.Table, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        ids, others = (t["id"].combine_chunks() for t in (x, y))
        band = (score >= LINK).astype(np.int32) + (score >= DUPLICATE)
        found = {}

        def sides(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of some pairs, whether the first block's row comes first, and its number and that of the other."""
            return pc.less(ids.take(pa.array(p[k])), others.take(pa.array(q[k]))).to_numpy(zero_copy_only=False), p[k], q[k]

        def best(some: np.ndarray, k: int) -> pa.Table:
            some = np.flatnonzero(some)
            if len(some) > k:
                some = some[score[some] >= np.partition(score[some], -k)[-k]]
            first, a, b = sides(some)
            side = lambda c, one: pc.if_else(pa.array(one), x[c].combine_chunks().take(pa.array(a)), y[c].combine_chunks().take(pa.array(b)))
            rows = {"score": pa.array(score[some]), "band": pa.array(band[some]), "is_cross_dept": pa.array(_differing(x, y, a, b, "dept"))} | {f"{c}_{n}": side(c, one) for c in ("id", "dept", "activity") for n, one in ((1, first), (2, ~first))}
            return pa.table(rows).sort_by([("score", "descending"), ("id_1", "ascending"), ("id_2", "ascending")]).slice(0, k)

        if "group" in parts:
            a, b, values = _numbered(x, y, "dept")
            first, a, b = sides(slice(None))[0], a[p] + 1, b[q] + 1
            many = len(values) + 1
            keys, place = np.unique((np.where(first, a, b).astype(np.int64) * many + np.where(first, b, a)) * 3 + band, return_inverse=True)
            one, two = keys // 3 // many - 1, keys // 3 % many - 1
            some = np.array([*[d != "" for d in values.to_pylist()], False])
            name = lambda d: values.take(pa.array(d, pa.int64(), mask=d < 0))
            found["group"] = pa.table({"dept_1": name(one), "dept_2": name(two), "is_cross_dept": (one != two) & some[one] & some[two], "band": keys % 3, "n": np.bincount(place), "total": np.bincount(place, score)})
        if "degree" in parts:
            ends = [(t, np.bincount(k[band >= 1], minlength=t.num_rows)) for t, k in ((x, p), (y, q))]
            found["degree"] = pa.table({"id_1": pa.concat_arrays([t["id"].combine_chunks().take(pa.array(np.flatnonzero(n))) for t, n in ends]), "n": np.concatenate([n[n > 0] for _, n in ends])})
        if "across" in parts:
            found["across"] = best(_differing(x, y, p, q, "dept"), ACROSS)
        if "high" in parts:
            found["high"] = best(band == 2, CONSOLIDATED)
        types = pa.schema([("part", pa.string()), ("id_1", ids.type), ("id_2", ids.type), ("score", pa.float64()), ("dept_1", pa.string()), ("dept_2", pa.string()), ("activity_1", pa.int64()), ("activity_2", pa.int64()), ("is_cross_dept", pa.bool_()), ("band", pa.int32()), ("n", pa.int64()), ("total", pa.float64())])
        rows = [pa.table({f.name: pa.array([part] * d.num_rows, f.type) if f.name == "part" else pc.cast(d[f.name], f.type) if f.name in d.column_names else pa.nulls(d.num_rows, f.type) for f in types}, schema=types) for part, d in found.items()]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks else pa.array([], c.type) for c in pa.concat_tables(rows).combine_chunks().columns], schema=types)

    return fold, schema


#: Scores at which the best pairs are looked for first: the best of many are among the few that reach them.
STEEP = (1.0, 0.99, 0.95)


def best_pairs(vectors: TermVectors, courses: DataFrame, threshold: float, part: str) -> DataFrame:
    """The ``across`` or ``high`` part of ``pair_summary``, with its best pairs among them.

    Once as many pairs as are asked for reach a score, all better ones are
    among those that do, so lower pairs are looked for only while there are
    too few. Vectors as near as a high score asks for have near places (see
    ``TermVectors.placed``), and blocks lie in that order, so two blocks whose
    places are apart are not compared: the work for such a score grows about
    as the rows do, not as their pairs.
    """
    v = vectors.carrying(_attributes(courses, "dept", "activity")).placed()
    v = TermVectors(cut_lineage(v.rows), v.idf)
    for least in [s for s in STEEP if s > threshold] + [threshold]:
        # scores are rounded to six digits; unit vectors of a cosine c are sqrt(2 - 2c) apart
        reach = float(np.sqrt(2 * (1 - least) + 2e-6)) + 1e-9
        near = lambda low_i, high_i, low_j, high_j, reach=reach: (low_j <= high_i + reach) & (low_i <= high_j + reach)
        found = cut_lineage(folded_pairs(v, least, *_summing(v, (part,)), order=("place", "id"), meets=near))
        if found.count() >= {"across": ACROSS, "high": CONSOLIDATED}[part]:
            break
    return found


def pair_groups(vectors: TermVectors, courses: DataFrame, threshold: float) -> DataFrame:
    """The ``group`` part of ``pair_summary`` alone."""
    return pair_summary(vectors, courses, threshold, ("group",))


def flagged_pairs(vectors: TermVectors, courses: DataFrame, threshold: float, high: float = 0.9) -> DataFrame:
    """``id_1, id_2, score`` and the flags of ``describe_pairs`` of all similar pairs, told where a pair is found: no attribute goes with it."""
    v = vectors.carrying(_attributes(courses, "dept", "category"))
    kind = dict(v.rows.dtypes)["id"]

    def fold(x: pa.Table, y: pa.Table, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        a, b = x["id"].combine_chunks().take(pa.array(p)), y["id"].combine_chunks().take(pa.array(q))
        first = pc.less(a, b)
        flags = [pa.array(_differing(x, y, p, q, c)) for c in ("dept", "category")]
        return pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(score), *flags], names=["id_1", "id_2", "score", "is_cross_dept", "is_cross_category"])

    found = folded_pairs(v, threshold, fold, f"id_1 {kind}, id_2 {kind}, score double, is_cross_dept boolean, is_cross_category boolean")
    return found.withColumns({"is_high": F.col("score") >= high, "priority": F.when(F.col("is_cross_dept"), 1).otherwise(2)})


def link_degrees(vectors: TermVectors, threshold: float) -> DataFrame:
    """``id, degree``: how many rows each is similar to, counted where pairs are found."""

    def fold(x: pa.Table, y: pa.Table, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        ends = [(t, np.bincount(k, minlength=t.num_rows)) for t, k in ((x, p), (y, q))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([t["id"].combine_chunks().take(pa.array(np.flatnonzero(n))) for t, n in ends]), pa.array(np.concatenate([n[n > 0] for _, n in ends]))], names=["id", "n"])

    return folded_pairs(vectors, threshold, fold, f"id {dict(vectors.rows.dtypes)['id']}, n long").groupBy("id").agg(F.sum("n").alias("degree"))


def most_linked(vectors: TermVectors, threshold: float) -> DataFrame:
    """``network_nodes`` of all similar pairs of at least ``threshold``, which is that of a link."""
    return _most_linked(link_degrees(vectors, threshold))


def duplicate_counts(vectors: TermVectors, courses: DataFrame, threshold: float = 0.8, content: float = 0.85) -> DataFrame:
    """One row ``cross, content``: pairs of at least ``threshold`` across departments, and all above ``content``, which is not lower."""
    v = vectors.carrying(_attributes(courses, "dept"))

    def fold(x: pa.Table, y: pa.Table, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        n = int(_differing(x, y, p, q, "dept").sum()), int((score > content).sum())
        return pa.RecordBatch.from_arrays([pa.array([k]) for k in n], names=["cross", "content"])

    return folded_pairs(v, threshold, fold, "cross long, content long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cross", "content")])


def content_report(courses: DataFrame, threshold: float = 0.7) -> dict[str, DataFrame]:
    """All that is made of similar content, from ``id, title, text, dept, category, activity``.

    Pairs are computed once for all parts but ``pairs``, ``duplicates`` and the
    edges of the few nodes, in ``pair_summary``, and never stored, as they grow
    with the square of the courses. ``pairs`` and ``duplicates`` find them anew
    where they are read; ``totals`` has their numbers and sums of scores.
    """
    reps = representatives(courses, "id", "text")
    vectors = TermVectors.of(reps.select("id", "text"))
    described = described_pairs(vectors, courses, threshold)
    summary = pair_summary(vectors, courses, threshold)
    part = lambda name: summary.where(F.col("part") == name)
    groups, nodes = part("group"), cut_lineage(_most_linked(part("degree").groupBy(F.col("id_1").alias("id")).agg(F.sum("n").alias("degree"))))
    total = lambda name, d: d.agg(F.lit(name).alias("part"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"))
    return {
        "copies": members(courses, reps, "id", "text"),
        "pairs": described,
        "counts": counts_of(groups),
        "duplicates": potential_duplicates(described, DUPLICATE),
        "across": cross_department(part("across"), ACROSS).select("id_1", "id_2", "score", "dept_1", "dept_2"),
        "consolidation": consolidation(part("high"), DUPLICATE, CONSOLIDATED),
        "departments": matrix_of(groups),
        "nodes": nodes,
        "edges": network_edges(similar_pairs(vectors.among(nodes.select("id")), threshold), nodes),
        "totals": total("pairs", groups).union(total("duplicates", groups.where("band = 2"))),
    }


def counts_of(groups: DataFrame) -> DataFrame:
    """``counts`` from groups of pairs."""
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    every = n(F.lit(True))
    return groups.agg(
        every.alias("pairs"),
        n(F.col("band") == 2).alias("high"),
        n(F.col("band") == 1).alias("medium"),
        n(F.col("is_cross_dept")).alias("cross_dept"),
        F.round(F.try_divide(n(F.col("is_cross_dept")), every) * 100, 4).alias("cross_dept_pct"),
        F.round(F.sum("total") / F.sum("n"), 6).alias("avg_score"),
    )


def matrix_of(groups: DataFrame) -> DataFrame:
    """``department_matrix`` from groups of pairs."""
    p = groups.where("dept_1 <> dept_2").select("dept_1", "dept_2", "n", "total")
    off = p.union(p.select("dept_2", "dept_1", "n", "total")).groupBy("dept_1", "dept_2").agg(F.round(F.sum("total") / F.sum("n"), 4).alias("mean_score"), F.sum("n").alias("pairs"))
    diagonal = groups.select(F.explode(F.array("dept_1", "dept_2")).alias("dept_1"), "n").where("dept_1 is not null").groupBy("dept_1").agg(F.sum("n").alias("pairs"))
    return off.union(diagonal.select("dept_1", F.col("dept_1").alias("dept_2"), F.lit(1.0).alias("mean_score"), "pairs"))


def same_number_pairs(courses: DataFrame) -> DataFrame:
    """Courses whose numbers agree in digits but are written differently.

    Written forms are merged first, so a number in many copies gives one row
    per pair of forms.
    """
    forms = courses.where("numeric_course_id <> ''").groupBy("numeric_course_id", "course_no").agg(F.count("*").alias("n"))
    a = forms.select("numeric_course_id", F.col("course_no").alias("number_1"), F.col("n").alias("n_1"))
    b = forms.select("numeric_course_id", F.col("course_no").alias("number_2"), F.col("n").alias("n_2"))
    return a.join(b, "numeric_course_id").where("number_1 < number_2")


#: A description of fewer characters counts half, and the title makes up for it.
SHORT = 20


def course_pairs(courses: DataFrame, high: float = 0.6, title_weight: float = 0.4) -> DataFrame:
    """``id_1, id_2, title_score, text_score, score`` of courses of ``id, title_vec, text_vec, text_length`` with a combined score of at least ``high``.

    The titles' weight depends on the shorter description: ``title_weight``
    for long ones, half of the rest more for short ones, all without one.
    Courses lie in blocks, and every two blocks meet in a task that multiplies
    both directions, in single precision first; pairs carry their own scores,
    so they are neither shuffled nor joined. Courses without a title vector
    are left out; a text vector that is missing has a cosine of 0 with all, as
    has a vector with null or non-finite entries.
    """
    if high <= 0:
        raise ValueError("the least score must be above 0")
    c = courses.where("title_vec is not null")
    size = lambda v: (c.where(f"{v} is not null").select(F.size(v)).first() or (0,))[0]
    dims = {"title_vec": size("title_vec"), "text_vec": size("text_vec")}
    fine = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vector = lambda v: F.when(fine(F.col(v)), F.col(v).cast("array<float>")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dims[v])).alias(v)
    rows = c.select("id", F.coalesce(F.col("text_length").cast("long"), F.lit(SHORT)).alias("n"), vector("title_vec"), vector("text_vec"))
    kind = dict(c.dtypes)["id"]

    def prepare(t: pa.Table) -> tuple:
        both = [unit_rows(matrix(t[v], d)) for v, d in dims.items()]
        return t["id"].combine_chunks(), t["n"].to_numpy(), both, [x.astype(np.float32) for x in both]

    def weight(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        short = np.minimum(n, m)
        empty = (n == 0) | (m == 0)
        return np.where(empty, 1.0, np.where(short < SHORT, title_weight + (1 - title_weight) / 2, title_weight))

    def compare(x: tuple, y: tuple, same: bool):
        (ids, n, own, single), (others, m, their, theirs) = x, y
        for s in range(0, len(n), 256):
            e = slice(s, s + 256)
            w = weight(n[e, None], m[None, :]).astype(np.float32)
            score = w * (single[0][e] @ theirs[0].T) + (1 - w) * (single[1][e] @ theirs[1].T)
            may = score >= high - SLACK
            if same:
                may &= np.arange(len(m)) > np.arange(s, s + len(may))[:, None]
            p, q = np.divmod(np.flatnonzero(may), len(m))
            for k in range(0, len(p), 1 << 16):
                a, b = p[k : k + (1 << 16)] + s, q[k : k + (1 << 16)]
                title, text = (np.round(np.einsum("ij,ij->i", u[a], v[b]), 6) for u, v in zip(own, their))
                w = weight(n[a], m[b])
                total = np.round(w * title + (1 - w) * text, 8)
                hit = total >= high
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[hit])), others.take(pa.array(b[hit])), *(pa.array(z[hit]) for z in (title, text, total))], names=["a", "b", "title_score", "text_score", "score"])

    found = block_pairs(rows, prepare, compare, f"a {kind}, b {kind}, title_score double, text_score double, score double", VECTORS)
    return found.select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"), "title_score", "text_score", "score")
