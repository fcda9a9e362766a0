"""Profiles of metadata, numbering, terms and departments."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright import config
from coursewright.functions.storage import cut_lineage
from coursewright.functions.text import category_confidence, exploded_tokens, tokens
from coursewright.operators.cells import vector_pairs
from coursewright.operators.graph import connected_components
from coursewright.operators.metrics import distinct_counts, filled, to_rows
from coursewright.operators.quantiles import quantiles, share_of, smallest
from coursewright.operators.term_index import Grams, TermVectors, folded_pairs


def metadata_quality(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``field, total, non_null, non_blank, rate, distinct, advice`` of each column."""
    one = df.agg(F.count("*").alias("n"), *[x for c in columns for x in (F.count(c).alias(f"{c}__a"), F.count_if(filled(c)).alias(f"{c}__b"))])
    one = one.withColumns({f"{c}__r": F.round(F.try_divide(F.col(f"{c}__b") * 1.0, "n"), 6) for c in columns})
    rows = to_rows(one, [(c, "n", f"{c}__a", f"{c}__b", f"{c}__r") for c in columns], ("field", "total", "non_null", "non_blank", "rate"))
    rows = rows.join(F.broadcast(distinct_counts(df, columns)), "field", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    return rows.withColumn("advice", F.when(F.col("rate") < 0.9, "complete").when(F.col("distinct_values") < 5, "diversify").otherwise("ok"))


def numbering(df: DataFrame, column: str = "course_no") -> DataFrame:
    """Prefixes of letters before digits, and how often they occur."""
    p = F.regexp_extract(column, r"([A-Za-z]+)(\d+)", 1)
    return df.where(F.col(column).rlike(r"[A-Za-z]+\d+")).groupBy(p.alias("prefix")).agg(F.count("*").alias("n"))


def numbering_statistics(df: DataFrame, column: str = "course_no") -> DataFrame:
    """Count, mean, deviation and quartiles of the digits after a prefix."""
    x = F.regexp_extract(column, r"([A-Za-z]+)(\d+)", 2).try_cast("double")
    one = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(df.select(x.alias("x")), "x", (0.25, 0.5, 0.75))
    r = lambda c: F.round(c, 4)
    found = one.join(F.broadcast(q), how="left")
    return found.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), r("mean").alias("mean"), r("std").alias("std"), "min", r("q0").alias("q1"), r("q1").alias("q2"), r("q2").alias("q3"), "max")


def correlations(df: DataFrame, columns: tuple[str, ...], least: float = 0.7) -> DataFrame:
    """Pearson correlation of each pair of columns over rows with both; null where one does not vary."""
    pairs = list(combinations(columns, 2))

    def corr(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        vary = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(vary, F.round(F.corr(x, y), 6))

    one = df.agg(*[corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = to_rows(one, [(f"{a}|{b}", f"r{k}") for k, (a, b) in enumerate(pairs)], ("pair", "r"))
    return rows.where(F.abs("r") > least)


#: Hashes of a column's values that its sketch holds.
SKETCH = 256


def _values(tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """``c, v``: the distinct values, as texts, of each column, named ``table.column`` (or as the column, if the table has no name)."""
    long = []
    for name, (df, columns) in tables.items():
        pairs = F.array(*[F.struct(F.lit(f"{name}.{c}" if name else c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
        long.append(df.select(F.explode(pairs).alias("x")).select("x.*").where("v is not null"))
    return reduce(DataFrame.union, long).distinct()


def may_contain(child: list[int], parent: list[int], size: int = SKETCH) -> bool:
    """Whether two bottom-k sketches allow that the second column has all values of the first.

    What is at most the largest hash of a full sketch of the second must be
    in it; a sketch that is not full holds all hashes.
    """
    known, top = set(parent), max(parent, default=None) if len(parent) >= size else None
    return all(h in known or (top is not None and h > top) for h in child)


def containment(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``table_containment`` between columns of one table."""
    return table_containment({"": (df, columns)})


def table_containment(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], size: int = SKETCH) -> DataFrame:
    """``child, parent, distinct_values, confidence``: column pairs where all distinct values of the first are values of the second.

    Each column's smallest value hashes, ``size`` at most, rule out nearly all
    pairs; these sketches are all that reaches the driver. Only columns of
    pairs that are left meet by value, where a single missing value refutes a
    pair. Values are made distinct per column first, so the join sees each
    once per column and pair. Columns without a value are in no pair.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    values = cut_lineage(_values(tables))
    hashed = values.select("c", F.xxhash64("v").alias("h"))
    sketches: dict[str, list[int]] = {}
    for r in smallest(hashed, "c", ("h",), size, size).collect():
        sketches.setdefault(r["c"], []).append(r["h"])
    left = [(a, b) for a in sketches for b in sketches if a != b and may_contain(sketches[a], sketches[b], size)]
    pairs = spark.createDataFrame(left, "child string, parent string")
    need = values.join(F.broadcast(pairs), F.col("c") == F.col("child")).select("child", "parent", "v")
    missing = need.join(values.select(F.col("c").alias("parent"), "v"), ["parent", "v"], "left_anti").select("child", "parent").distinct()
    n = values.groupBy(F.col("c").alias("child")).agg(F.count("*").alias("n"))
    return pairs.join(missing, ["child", "parent"], "left_anti").join(F.broadcast(n), "child").select("child", "parent", F.col("n").alias("distinct_values"), F.lit(0.8).alias("confidence"))


def column_confidence(df: DataFrame, numeric: tuple[str, ...], text: tuple[str, ...]) -> DataFrame:
    """Share of non-nulls, less outliers beyond three deviations for numbers, times 0.8 for texts that hardly repeat."""
    stats = df.agg(*[x for c in numeric for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]) if numeric else None
    d = df.join(F.broadcast(stats)) if stats is not None else df
    far = lambda c: F.avg((F.abs(F.try_divide(F.col(c) - F.col(f"{c}__m"), F.col(f"{c}__s"))) > 3).cast("double"))
    some = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    aggs = [F.round(some(c) * (1 - F.coalesce(far(c), F.lit(0.0))), 4).alias(c) for c in numeric]
    aggs += [F.round(some(c) * F.when(F.countDistinct(c) / F.count("*") > 0.8, 0.8).otherwise(1.0), 4).alias(c) for c in text]
    return to_rows(d.agg(*aggs), [(c, c) for c in (*numeric, *text)], ("field", "confidence"))


def text_patterns(df: DataFrame, column: str, order: str, rows: int = 100) -> DataFrame:
    """Share of forms among the first values of a column (a sampling operator: ``rows`` is its sample)."""
    c = F.col(column)
    sample = df.where(c.isNotNull()).orderBy(order).limit(rows)
    forms = {
        "all_caps": (F.upper(c) == c) & c.rlike("[A-Za-z]"),
        "title_case": F.initcap(c) == c,
        "has_digit": c.rlike(r"\d"),
        "has_special": c.rlike("[^A-Za-z0-9]"),
        "formatted_code": c.rlike("^[A-Z0-9_-]+$"),
    }
    return to_rows(sample.agg(*[F.round(F.avg(x.cast("double")) * 100, 4).alias(n) for n, x in forms.items()]), [(n, n) for n in forms], ("form", "pct"))


def top_terms(docs: DataFrame, limit: int = 20, most: int = 3, vocabulary: int = 5000) -> DataFrame:
    """``term, score`` with the largest summed TF-IDF over n-grams of up to ``most`` words (unnormalised weights)."""
    g = Grams.of(docs, most, vocabulary)
    terms = docs.sparkSession.createDataFrame(list(zip(g.terms, g.totals.tolist(), g.frequencies.tolist())), "term string, total long, df long")
    n = docs.agg(F.count("*").alias("n"))
    score = F.col("total") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1)
    return terms.join(F.broadcast(n)).select("term", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "term").limit(limit)


def keywords(docs: DataFrame, n: int = 10) -> DataFrame:
    """Each text's ``n`` most frequent tokens, in alphabetical order; ties in that order too.

    A text's tokens are counted in the task that reads it and never shuffled.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, out = b.slice(k, 256), []
                for t in part.column(1).to_pylist():
                    top = heapq.nsmallest(n, ((-m, w) for w, m in Counter(t).items()))
                    out.append(",".join(sorted(w for _, w in top)) if top else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["id", "keywords"])

    found = docs.select("id", tokens(F.col("text")).alias("t")).mapInArrow(best, f"id {dict(docs.dtypes)['id']}, keywords string")
    return found.where("keywords is not null")


def department_overlap(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """TF-IDF cosine of each pair of departments' texts, with idf over just the two.

    A term of both weighs 1, of one alone ln(3/2) + 1. Texts are read and
    counted once: a term's departments are put side by side in one row, which
    gives its pairs, and each department with itself for the squared sums.
    Such a row holds as many counts as there are departments.
    """
    tf = exploded_tokens(docs.where("dept is not null"), "text", "dept").groupBy("dept", "term").agg(F.count("*").cast("double").alias("tf"))
    of_term = tf.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("dept", "tf"))).alias("e"))
    first = of_term.select("e", F.posexplode("e").alias("k", "a"))
    pairs = first.select("a", F.explode(F.slice("e", F.col("k") + 1, F.size("e"))).alias("b")).select(F.col("a.dept").alias("dept_1"), F.col("b.dept").alias("dept_2"), F.col("a.tf").alias("x"), F.col("b.tf").alias("y"))
    total = lambda x, y: F.sum(F.col(x) * F.col(y))
    d = pairs.groupBy("dept_1", "dept_2").agg(total("x", "y").alias("dot"), total("x", "x").alias("xx"), total("y", "y").alias("yy"), F.count("*").alias("terms"))
    own = F.when(F.col("dept_1") == F.col("dept_2"), F.col("xx"))
    d = d.withColumns({f"s{k}": F.max(own).over(Window.partitionBy(f"dept_{k}")) for k in (1, 2)}).where("dept_1 < dept_2")
    k = 1.4054651081081644**2
    norm = lambda s, own: F.sqrt(F.col(own) + k * (F.col(s) - F.col(own)))
    out = d.select("dept_1", "dept_2", "terms", F.round(F.try_divide(F.col("dot"), norm("s1", "xx") * norm("s2", "yy")), 6).alias("similarity"))
    return out.where(F.col("similarity") > least)


def categories(df: DataFrame, text: Column) -> DataFrame:
    """Add each training category's confidence and flag."""
    conf = {f"{c}_confidence": F.round(category_confidence(text, c), 6) for c in config.TRAINING_CATEGORIES}
    return df.withColumns(conf).withColumns({f"is_{c}": F.col(f"{c}_confidence") >= config.CATEGORY_FLAG for c in config.TRAINING_CATEGORIES})


def category_overlap(flagged: DataFrame) -> DataFrame:
    """Percentage of rows in both of two categories."""
    names = list(config.TRAINING_CATEGORIES)
    pairs = [(a, b) for a in names for b in names]
    one = flagged.agg(*[F.round(F.avg((F.col(f"is_{a}") & F.col(f"is_{b}")).cast("double")) * 100, 4).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    items = [F.struct(F.lit(a).alias("category_1"), F.lit(b).alias("category_2"), F.col(f"p{k}").alias("pct")) for k, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def _rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of edges, each once, and the smallest that each is joined to."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # roots learn of smaller ones, then every node takes its root's
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
        some = label[x] != label[y]
        x, y = x[some], y[some]
    return ids, ids[label]


def _forest(batches: Iterator[pa.RecordBatch], src: str, dst: str) -> Iterator[pa.RecordBatch]:
    """Edges between the same nodes that join what a task's edges join: one a node at most."""
    a, b = np.zeros(0, object), np.zeros(0, object)

    def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, roots = _rooted(a, b)
        other = ids != roots
        return ids[other], roots[other]

    for t in batches:
        x, y = (t.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        a, b = (np.concatenate([u, v]) if len(u) else v for u, v in ((a, x), (b, y)))
        if len(a) > 1 << 20:
            a, b = joined(a, b)
    if len(a):
        a, b = joined(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=[src, dst])


def density_clusters(nodes: DataFrame, links: DataFrame, least: int = 5, flagged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """DBSCAN: ``id, cluster`` from neighbour links ``id_1, id_2`` within the radius.

    A core has ``least`` neighbours, itself included. Cores linked to each
    other form clusters, named by their smallest id; a border point joins its
    smallest core's cluster; the rest is noise, -1. Links are neither stored
    nor shuffled one by one: tasks sum up degrees, keep a spanning forest of
    the links between cores, and the smallest core next to a border point.
    ``flagged`` gives the links once more, with ``core_1`` and ``core_2``, for
    ``id, core``, each once; without it links are made distinct and joined to the cores.
    """
    if flagged is None:
        links = links.select(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2")).where("id_1 < id_2").distinct()
    degree = links.select(F.explode(F.array("id_1", "id_2")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    core = cut_lineage(degree.where(F.col("n") + 1 >= least).select("id", F.lit(True).alias("core")))
    if flagged is None:
        side = lambda k: core.toDF(f"id_{k}", f"core_{k}")
        pairs = links.select("id_1", "id_2").join(side(1), "id_1", "left").join(side(2), "id_2", "left")
    else:
        pairs = flagged(core)
    pairs = pairs.select("id_1", "id_2", *[F.coalesce(f"core_{k}", F.lit(False)).alias(f"core_{k}") for k in (1, 2)])
    kind = dict(links.dtypes)["id_1"]
    inner = pairs.where("core_1 and core_2").select("id_1", "id_2").mapInArrow(lambda b: _forest(b, "id", "other"), f"id {kind}, other {kind}")
    comps = connected_components(inner, "id", "other").toDF("id", "cluster")
    cores = core.join(comps, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
    outer = pairs.where("core_1 <> core_2").select(F.when(F.col("core_1"), F.col("id_2")).otherwise(F.col("id_1")).alias("id"), F.when(F.col("core_1"), F.col("id_1")).otherwise(F.col("id_2")).alias("other"))
    border = outer.groupBy("id").agg(F.min("other").alias("other")).join(cores.toDF("other", "cluster"), "other").select("id", "cluster")
    return nodes.select("id").join(cores.union(border), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def vector_clusters(vectors: DataFrame, threshold: float, least: int) -> DataFrame:
    """DBSCAN over ``id, embedding``: neighbours have a cosine of at least ``threshold``."""
    v = vectors.select("id", "embedding")
    return density_clusters(v, vector_pairs(v, threshold), least, lambda core: vector_pairs(v.join(core, "id", "left"), threshold))


def text_clusters(docs: DataFrame, radius: float = 0.3, least: int = 5, most: int = 3, vocabulary: int = 5000) -> DataFrame:
    """DBSCAN over ``id, text``: TF-IDF vectors over runs of up to ``most`` words, neighbours within a cosine distance of ``radius``.

    Texts without a term of the vocabulary are noise. The clusters are those
    of ``density_clusters``, but most links are never multiplied out: blocks
    that are compared with themselves and the next one tell many cores and
    join most of them. Rows that are not known as cores by then are compared
    with all, to count their neighbours; then cores with those of other
    clusters and with other rows. Blocks of one cluster alone are not compared.
    """
    v = TermVectors.of(docs, most, vocabulary)
    v = TermVectors(cut_lineage(v.rows), v.idf)
    kind, near, need = dict(v.rows.dtypes)["id"], 1 - radius, max(1, least - 1)

    def joined(x: pa.Table, y: pa.Table, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        """Rows with enough of the given neighbours, and a row that each is joined to by links among them."""
        ids = pa.concat_arrays([part for t in ([x] if x is y else [x, y]) for part in t["id"].chunks])
        q = q if x is y else q + x.num_rows
        core = np.bincount(np.append(p, q), minlength=len(ids)) >= need
        root, some = np.arange(len(ids)), core[p] & core[q]
        ends, roots = _rooted(p[some], q[some])
        root[ends] = roots
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.flatnonzero(core))), ids.take(pa.array(root[core]))], names=["id", "other"])

    first = cut_lineage(folded_pairs(v, near, joined, f"id {kind}, other {kind}", chained=True))
    known = first.select("id").distinct().join(connected_components(first, "id", "other").toDF("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    known = cut_lineage(known)

    def unknown(t: pa.Table) -> np.ndarray:
        return t["unknown"].to_numpy() == 1

    def counted(x: pa.Table, y: pa.Table, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        ends = [(t, np.where(unknown(t), np.bincount(k, minlength=t.num_rows), 0)) for t, k in ((x, p), (y, q))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([t["id"].combine_chunks().take(pa.array(np.flatnonzero(n))) for t, n in ends]), pa.array(np.concatenate([n[n > 0] for _, n in ends]))], names=["id", "n"])

    def one_unknown(x: pa.Table, y: pa.Table) -> Callable[[slice], np.ndarray]:
        own, other = unknown(x), unknown(y)
        return lambda rows: own[rows, None] | other[None, :]

    rest = v.carrying(known.select("id", F.lit(0).alias("unknown")))
    rest = TermVectors(rest.rows.withColumn("unknown", F.coalesce("unknown", F.lit(1))), v.idf)
    degree = folded_pairs(rest, near, counted, f"id {kind}, n long", one_unknown, order=("unknown", "id"), meets=lambda low_i, high_i, low_j, high_j: (high_i == 1) | (high_j == 1))
    core = cut_lineage(known.union(degree.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= need).select("id", F.col("id").alias("label"))))

    def places(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the rows' clusters, one for all rows that are no cores."""
        codes = pa.concat_arrays([part for t in (x, y) for part in t["place"].chunks]).dictionary_encode().indices.to_numpy()
        return codes[: x.num_rows], codes[x.num_rows :]

    def apart(x: pa.Table, y: pa.Table) -> Callable[[slice], np.ndarray]:
        own, other = places(x, y)
        return lambda rows: own[rows, None] != other[None, :]

    def linked(x: pa.Table, y: pa.Table, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        """Clusters that links join, and other rows with the cores next to them."""
        ids, labels = ([t[c].combine_chunks() for t in (x, y)] for c in ("id", "label"))
        cores = [c.is_valid().to_numpy(zero_copy_only=False) for c in labels]
        own, other = places(x, y)
        some = cores[0][p] & cores[1][q]
        numbers, at = np.unique(np.append(own, other), return_index=True)
        ends, roots = _rooted(own[p[some]], other[q[some]])
        label = lambda n: pa.concat_arrays(labels).take(pa.array(at[np.searchsorted(numbers, n)]))
        found = [(label(ends), label(roots), False)]
        for k, a, b in ((0, p, q), (1, q, p)):
            s = ~some & cores[k][a]
            found.append((ids[1 - k].take(pa.array(b[s])), ids[k].take(pa.array(a[s])), True))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([f[0] for f in found]), pa.concat_arrays([f[1] for f in found]), pa.array([f[2] for f in found for _ in range(len(f[0]))], pa.bool_())], names=["id", "other", "border"])

    rows = v.carrying(core).rows.withColumn("place", F.when(F.col("label").isNotNull(), F.concat(F.lit("core "), F.col("label").cast("string"))).otherwise("none"))
    same = lambda low_i, high_i, low_j, high_j: (low_i == high_i) & (low_j == high_j) & (low_i == low_j)
    links = cut_lineage(folded_pairs(TermVectors(rows, v.idf), near, linked, f"id {kind}, other {kind}, border boolean", apart, order=("place", "id"), meets=lambda *ends: ~same(*ends)))
    comps = connected_components(links.where("not border"), "id", "other").toDF("label", "cluster")
    cores = core.join(comps, "label", "left").select("id", F.coalesce("cluster", "label").alias("cluster"))
    border = links.where("border").groupBy("id").agg(F.min("other").alias("other")).join(cores.toDF("other", "cluster"), "other").select("id", "cluster")
    return docs.select("id").join(cores.union(border), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def stratified_sample(df: DataFrame, by: str | None, key: str, size: int = 10_000, groups: int = 20, least: int = 50, seed: int = 1) -> DataFrame:
    """About ``size`` rows, drawn by a hash of the key (a sampling operator).

    Each of the largest groups of ``by`` gives the same share; what is then
    missing of ``size`` comes from all rows left. Without ``by`` all rows are
    one group. Keys are distinct. After one count by group, a single scan
    keeps what a bound on the hash allows, about the sample's size; the ranks
    are exact and taken among that, cut in each task before the shuffle.
    """
    d = df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")))
    if by is None or by not in df.columns:
        return d.orderBy("__h", key).limit(size).drop("__h")
    groups_of = df.groupBy(by).agg(F.count("*").alias("__n"))
    top = groups_of.where(F.col(by).isNotNull()).orderBy(F.desc("__n"), by).limit(groups).withColumn("__quota", F.least("__n", F.greatest(F.lit(least), F.lit(size // groups))))
    quotas, rows = [(r[by], r["__quota"]) for r in top.select(by, "__quota").collect()], df.count()
    missing, most = max(0, size - sum(q for _, q in quotas)), max([q for _, q in quotas], default=0)
    listed = F.broadcast(top.select(by, "__quota"))
    # one scan: what may be drawn for a group is below its share of hashes; what fills up, below a share of all
    place = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = d.join(F.broadcast(top), by, "left").withColumn("__place", place)
    bound = lambda k, n: (k + 6 * F.sqrt(k) + 36) / n
    own = F.col("__place") <= bound(F.col("__quota"), F.col("__n"))
    fill = F.col("__place") <= F.lit(share_of(size, rows))
    near = cut_lineage(near.where(F.coalesce(own, F.lit(False)) | (fill if missing else F.lit(False))).select(*df.columns, "__h", "__quota"))
    drawn = smallest(near.where("__quota is not null"), by, ("__h", key), F.col("__quota"), max(most, 1))
    if not missing:
        return drawn.select(*df.columns)
    rest = near.join(drawn.select(F.col("__h").alias("__d")), F.col("__h") == F.col("__d"), "left_anti")
    return drawn.select(*df.columns).union(rest.orderBy("__h", key).limit(missing).select(*df.columns))


def insights(metadata: DataFrame, terms: DataFrame, overlap: DataFrame) -> DataFrame:
    """Findings of the three profiles as rows ``kind, subject, value``."""
    m = metadata.where("advice <> 'ok'").select(F.lit("metadata").alias("kind"), F.col("field").alias("subject"), F.col("rate").alias("value"))
    t = terms.select(F.lit("term"), "term", "score")
    o = overlap.select(F.lit("overlap"), F.concat_ws(" | ", "dept_1", "dept_2"), "similarity")
    return reduce(DataFrame.union, [m, t, o])
