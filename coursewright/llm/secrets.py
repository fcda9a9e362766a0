"""Secret scans: patterns plus a randomness test battery, in SQL functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursewright.functions.storage import cut_lineage
from coursewright.llm.common import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Maximal runs of secret-like characters; shorter ones hold too little evidence.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings in the order they are tried: name, pattern, alphabet in index order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64", "", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Levels the false-discovery control chooses from, loosest first.
ALPHAS = (0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7)
#: Length strata: lower bounds.
STRATA = (16, 20, 24, 32, 48)


def _matches(kind: int, text: Column, pattern: str, ok: Column | None = None) -> Column:
    """All matches of ``pattern``, left to right: how much text stands before each since the last, its length and, of candidates, the token.

    The pieces between the matches and the matches themselves make up the
    text, so their running lengths are the positions. ``ok`` says of each
    match whether it counts.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    token = (lambda m: m) if kind == len(KINDS) - 1 else (lambda m: F.lit(None).cast("string"))
    item = lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), token(m).alias("token"))
    # the arrays that a match's own place picks from are made once, as variables of an outer transform
    rows = F.transform(F.array(F.struct(F.zip_with(gaps, found, item).alias("m"), (F.array().cast("array<boolean>") if ok is None else ok).alias("ok"))), lambda x: F.transform(
        x["m"],
        lambda m, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), m["gap"].alias("gap"), m["len"].alias("len"), (F.lit(True) if ok is None else F.get(x["ok"], k)).alias("ok"), m["token"].alias("token")),
    ))
    return F.when(text.rlike(pattern), F.element_at(rows, 1)).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,len:int,ok:boolean,token:string>>"))


def _normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal, by the logistic approximation of Bowling et al. (error under 0.0002)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def _encoding(token: Column) -> Column:
    out = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(token.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(out)
    return out


def battery(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Add ``encoding``, ``p_uniform``, ``p_runs``, ``p_serial``, ``p_value`` of each token.

    The encoding is the smallest listed alphabet that holds the token. Chi
    squared compares character counts with a uniform alphabet (Wilson and
    Hilferty's normal form, upper tail). The runs test counts changes between
    the lower and the upper half of the alphabet against their mean, two-sided.
    The serial test is the lag-one correlation of alphabet positions,
    two-sided. ``p_value`` is their combination by the smallest, corrected for
    three tests: small for tokens that are not random.
    """
    t = tokens.withColumn("encoding", _encoding(F.col(token))).withColumn("__n", F.length(token).cast("double"))
    size = F.element_at(F.array(*[F.lit(float(len(a))) for _, _, a in ENCODINGS]), F.col("encoding") + 1)
    alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), F.col("encoding") + 1)
    t = t.withColumn("__m", size).withColumn("__a", alphabet).withColumn("__c", F.filter(F.split(token, ""), lambda c: c != ""))
    squares = F.aggregate(
        F.array_distinct("__c"),
        F.lit(0.0),
        lambda acc, c: acc + F.pow(F.col("__n") - F.length(F.replace(F.col(token), c, F.lit(""))), F.lit(2)),
    )
    t = t.withColumn("__chi", F.col("__m") / F.col("__n") * squares - F.col("__n")).withColumn("__i", F.transform("__c", lambda c: F.instr(F.col("__a"), c).cast("double")))
    df = F.col("__m") - 1
    third = F.pow(F.greatest(F.col("__chi"), F.lit(0.0)) / df, F.lit(1 / 3))
    t = t.withColumn("p_uniform", _normal_tail((third - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))))
    pairs = F.zip_with(F.slice("__i", 1, F.size("__i") - 1), F.slice("__i", 2, F.size("__i") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    t = t.withColumn("__p", pairs)
    half = F.col("__m") / 2
    changes = F.aggregate("__p", F.lit(0.0), lambda acc, p: acc + ((p["a"] <= half) != (p["b"] <= half)).cast("double"))
    k = F.col("__n") - 1
    t = t.withColumn("p_runs", F.least(F.lit(1.0), 2 * _normal_tail(F.abs(changes - k / 2) / F.sqrt(k / 4))))
    mean = (F.col("__m") + 1) / 2
    product = F.aggregate("__p", F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean))
    spread = (F.col("__m") * F.col("__m") - 1) / 12
    t = t.withColumn("p_serial", F.least(F.lit(1.0), 2 * _normal_tail(F.abs(product / spread) / F.sqrt(k))))
    p = F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial"))
    return t.withColumn("p_value", p).drop("__n", "__m", "__a", "__c", "__chi", "__i", "__p")


def _stratum(n: Column) -> Column:
    out = F.lit(STRATA[0])
    for low in STRATA[1:]:
        out = F.when(n >= low, F.lit(low)).otherwise(out)
    return out


def choose_levels(tested: DataFrame, max_false: float = 0.05) -> dict[int, float]:
    """The loosest level for each length stratum whose estimated share of false discoveries is at most ``max_false``.

    ``tested`` has ``ordinary`` (words of letters only), ``len`` and
    ``p_value``. A token is discovered if its p-value exceeds the level. Plain
    text among the tokens in question passes a level as often as the ordinary
    words of that length do; how much plain text there is shows in the tokens
    that fail. The result has one entry per stratum at most, none where no
    level qualifies. Only these counts, one row per stratum, reach the driver.
    """
    counts = [F.sum((~F.col("ordinary")).cast("long")).alias("n"), F.sum(F.col("ordinary").cast("long")).alias("m")]
    for k, a in enumerate(ALPHAS):
        passed = F.col("p_value") > a
        counts += [F.sum((passed & ~F.col("ordinary")).cast("long")).alias(f"n{k}"), F.sum((passed & F.col("ordinary")).cast("long")).alias(f"m{k}")]
    rows = tested.groupBy(_stratum(F.col("len")).alias("stratum")).agg(*counts).collect()
    levels = {}
    for r in rows:
        for k, a in enumerate(ALPHAS):
            found, rate = r[f"n{k}"], (r[f"m{k}"] + 1) / (r["m"] + 2)
            # tokens that fail the level show how many plain ones there are
            plain = min(r["n"], (r["n"] - found) / max(1e-9, 1 - rate))
            if found and rate * plain / found <= max_false:
                levels[r["stratum"]] = a
                break
    return levels


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_false: float = 0.05) -> DataFrame:
    """Each row's spans: ``id, spans array<struct<start, kind, end>>``, sorted.

    ``kind`` indexes ``KINDS``. Base kinds are leftmost non-overlapping
    matches: assignments with a value of 6 or more characters, access keys of
    20 or more, hexadecimal runs of 24 or more. The battery adds ``random``
    spans: candidate runs that are no plain word of letters, that no base span
    touches and whose p-value exceeds the level of their length. Plain words
    show how often ordinary text passes the battery. Positions are code points,
    ends exclusive. Null texts count as empty and have no spans; rows keep
    their number and ids, repeated or null; other columns are not read; an
    empty table gives an empty result. Texts are read once and never move: only
    lengths and candidates do. Positions are running sums over a row's matches
    and overlaps are found by two passes over its sorted spans, so the time is
    linear in the matches (but for sorting), however long a text is.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    values = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    found = F.concat(_matches(0, t, ASSIGN, values), _matches(1, t, ACCESS), _matches(2, t, HEX), _matches(3, t, CANDIDATE))
    d = cut_lineage(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), found.alias("found")))
    running = lambda *order: Window.partitionBy(*order[0]).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    spans = d.select("row", F.inline("found")).repartition("row")
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(running(["row", "kind"], "k")).cast("int")).where("ok")
    spans = spans.withColumn("start", F.col("end") - F.col("len"))
    base = F.col("kind") < len(KINDS) - 1
    spans = spans.withColumn("reached", F.max(F.when(base, F.col("end"))).over(running(["row"], "start", "kind")))
    spans = spans.withColumn("ahead", F.min(F.when(base, F.col("start"))).over(running(["row"], F.desc("start"), F.desc("kind"))))
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("end")))
    spans = spans.where(base | free).withColumn("ordinary", F.col("token").rlike("^[A-Z]?[a-z]+$"))
    tested = cut_lineage(battery(spans).select("row", "kind", "start", "end", "ordinary", "len", "p_value"))
    levels = choose_levels(tested.where("ordinary is not null"), max_false)
    level = functools.reduce(lambda c, x: F.when(_stratum(F.col("len")) == x[0], F.lit(x[1])).otherwise(c), levels.items(), F.lit(1.0))
    kept = tested.where(F.col("ordinary").isNull() | (~F.col("ordinary") & (F.col("p_value") > level)))
    span = F.struct("start", "kind", "end")
    per_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return d.select("id", "row").join(per_row, "row", "left").select("id", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document; null texts are empty, and repeated rows stay."""
    s = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = {k: _count(i) for i, k in enumerate(KINDS)}
    return s.select(
        F.col("id").alias("doc_id"),
        count["assign"].alias("n_assign"),
        count["access"].alias("n_access"),
        count["hex"].alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
