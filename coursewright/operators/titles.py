"""Ratios of strings, and pairs of titles that are written alike."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.operators.cells import cell_join, sampled, visiting

#: Titles of a cell, about.
CELL = 128
#: Letters that titles are counted by; all others count as one more.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Longest texts that are compared as padded arrays.
WIDE = 128


def string_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``indel`` (2 LCS over both lengths, in hundredths) and ``jaro_winkler`` of two text columns, by an Arrow UDF."""
    @F.pandas_udf("double")
    def indel(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(p or "", q or "") for p, q in zip(x, y)])

    @F.pandas_udf("double")
    def winkler(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(jaro_winklers([p or "" for p in x], [q or "" for q in y]))

    return pairs.withColumns({"indel": indel(F.lower(a), F.lower(b)), "jaro_winkler": winkler(a, b)})


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, to two digits."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return round(200 * (len(a) - v.bit_count()) / (len(a) + len(b))) / 100


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity; above 0.7, up to four characters of common prefix weigh 0.1 each."""
    if a == b:
        return 1.0 if a else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for k, c in enumerate(a):
        for j in range(max(0, k - reach), min(len(b), k + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    m = len(hits)
    swaps = sum(x != y for x, y in zip(hits, [c for c, u in zip(b, used) if u])) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of each pair of two lists, many pairs at once."""
    out = np.zeros(len(a))
    size_a, size_b = (np.array([len(t) for t in x], int) for x in (a, b))
    wide = np.maximum(size_a, size_b)
    for k in np.flatnonzero(wide > WIDE).tolist():
        out[k] = jaro_winkler(a[k], b[k])
    order = np.flatnonzero((wide <= WIDE) & (np.minimum(size_a, size_b) > 0))
    order = order[np.argsort(wide[order], kind="stable")]
    for s in range(0, len(order), 2048):
        some = order[s : s + 2048]
        out[some] = _winklers([a[k] for k in some], [b[k] for k in some], size_a[some], size_b[some])
    return out


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width)


def _winklers(a: list[str], b: list[str], size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Of pairs of similar width, none empty: one step for each character of the first texts."""
    x, y = _codes(a, int(size_a.max())), _codes(b, int(size_b.max()))
    place, row = np.arange(y.shape[1]), np.arange(len(a))
    reach = np.maximum(np.maximum(size_a, size_b) // 2 - 1, 0)
    free, hit = place < size_b[:, None], np.zeros(x.shape, bool)
    for k in range(x.shape[1]):
        near = free & (y == x[:, k : k + 1]) & (np.abs(place - k) <= reach[:, None])
        j = near.argmax(axis=1)
        found = near[row, j] & (k < size_a)
        free[row[found], j[found]] = False
        hit[:, k] = found
    used = ~free & (place < size_b[:, None])
    m, width = hit.sum(axis=1), min(x.shape[1], y.shape[1])
    first = lambda v, on: np.take_along_axis(v, np.argsort(~on, axis=1, kind="stable"), axis=1)[:, :width]
    swaps = ((first(x, hit) != first(y, used)) & (np.arange(width) < m[:, None])).sum(axis=1) // 2
    jaro = np.where(m > 0, (m / size_a + m / size_b + (m - swaps) / np.maximum(m, 1)) / 3, 0.0)
    head = min(4, width)
    prefix = np.logical_and.accumulate((x[:, :head] == y[:, :head]) & (np.arange(head) < np.minimum(size_a, size_b)[:, None]), axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def _letter_counts(titles: list[str]) -> np.ndarray:
    """Counts of each of ``LETTERS``, and of all other characters."""
    n = len(LETTERS) + 1
    codes = np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32)
    known = np.full(128, n - 1)
    known[[ord(c) for c in LETTERS]] = np.arange(n - 1)
    kind = np.where(codes < 128, known[np.minimum(codes, 127)], n - 1)
    row = np.repeat(np.arange(len(titles)), [len(t) for t in titles])
    return np.bincount(row * n + kind, minlength=len(titles) * n).reshape(-1, n).astype(np.int32)


def _heads(titles: list[str]) -> np.ndarray:
    return _codes([t[:4] for t in titles], 4) if titles else np.zeros((0, 4), np.uint32)


@dataclasses.dataclass(frozen=True)
class TitleCells:
    """Cells of titles around pivots of letter counts, with what bounds a member's likeness to a title.

    ``radius`` is the largest distance (sum of differences) of a member to
    the pivot, ``low`` and ``high`` bound its count of each letter,
    ``shortest`` and ``longest`` its length; ``starts`` has the letters that
    members begin with.
    """

    pivots: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, titles: DataFrame) -> TitleCells:
        """Cells of ``title``; what the tasks find of each is merged before it reaches the driver."""
        pivots = _letter_counts(sampled(titles, "title", "title", CELL))
        k, n = pivots.shape
        begin, home = _letter_counts, cls._homes

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds: dict[tuple[int, int], list[int]] = {}
            for b in batches:
                texts = b.column(0).to_pylist()
                c = begin(texts)
                own, far = home(c, pivots)
                first = begin([t[0] for t in texts]).argmax(axis=1)
                facts = np.hstack([c, c.sum(axis=1, keepdims=True), far[:, None], 1000 + first[:, None]])
                for cell in np.unique(own).tolist():
                    mine = facts[own == cell]
                    for j in range(n + 2):
                        lo, hi = int(mine[:, j].min()), int(mine[:, j].max())
                        old = bounds.setdefault((cell, j), [lo, hi])
                        bounds[cell, j] = [min(old[0], lo), max(old[1], hi)]
                    for f in np.unique(mine[:, n + 2]).tolist():
                        bounds[cell, f] = [1, 1]
            rows = [(*key, *v) for key, v in bounds.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["cell", "fact", "lo", "hi"])

        low, high, starts = np.full((k, n + 2), 0), np.full((k, n + 2), -1), np.zeros((k, n), bool)
        for r in titles.select("title").mapInArrow(found, "cell long, fact long, lo long, hi long").groupBy("cell", "fact").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
            if r["fact"] >= 1000:
                starts[r["cell"], r["fact"] - 1000] = True
            else:
                low[r["cell"], r["fact"]], high[r["cell"], r["fact"]] = r["lo"], r["hi"]
        return cls(pivots, high[:, n + 1], low[:, :n], high[:, :n], low[:, n], high[:, n], starts)

    @staticmethod
    def _homes(counts: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each title and its distance."""
        home, far = np.zeros(len(counts), int), np.zeros(len(counts), int)
        for s in range(0, len(counts), 64):
            d = np.abs(counts[s : s + 64, None, :] - pivots[None]).sum(axis=2)
            home[s : s + 64], far[s : s + 64] = d.argmin(axis=1), d.min(axis=1)
        return home, far

    def bounds(self, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For titles and cells: what a Jaro-Winkler similarity to a member is at most.

        Members differ from a title by what it is farther from the pivot than
        the radius, and by what its counts are outside the cell's. Twice the
        matching characters are both lengths less the difference; with the
        difference given, the bound is largest at one of the cell's lengths.
        """
        size = counts.sum(axis=1)[:, None].astype(float)
        far = np.abs(counts[:, None, :] - self.pivots[None]).sum(axis=2) - self.radius
        outside = (np.maximum(counts[:, None, :] - self.high[None], 0) + np.maximum(self.low[None] - counts[:, None, :], 0)).sum(axis=2)
        apart = np.maximum(np.maximum(far, outside), 0)

        def shares(b: np.ndarray) -> np.ndarray:
            return (size + b - apart) / 2 * (1 / size + 1 / b)

        lo, hi = np.maximum(self.shortest, 1)[None].astype(float), np.maximum(self.longest, 1)[None].astype(float)
        near = np.clip(size, lo, hi)
        most = np.minimum(np.maximum(shares(lo), shares(hi)), 1 + np.minimum(size, near) / np.maximum(size, near))
        jaro = np.clip((most + 1) / 3, 0, 1)
        return np.where(self.longest[None] < 0, 0.0, jaro + np.where(self.starts.T[first], 0.4, 0.0) * (1 - jaro))

    def visits(self, titles: DataFrame, least: float) -> DataFrame:
        """``cell, visitor, title, n``: every title at home, and in the cells whose bound reaches ``least``."""
        begin, homes, bounds, pivots = _letter_counts, self._homes, self.bounds, self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 64):
                    part = b.slice(s, 64)
                    texts = part.column(0).to_pylist()
                    c = begin(texts)
                    row, cell, guest = visiting(homes(c, pivots)[0], bounds(c, begin([t[0] for t in texts]).argmax(axis=1)) >= least - 1e-4)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(guest), *part.take(pa.array(row)).columns], names=["cell", "visitor", "title", "n"])

        return titles.mapInArrow(run, "cell long, visitor boolean, title string, n long")


def fuzzy_titles(courses: DataFrame, least: float = 0.85) -> DataFrame:
    """``title_1, title_2, n_1, n_2, similarity`` of different titles with a Jaro-Winkler similarity of at least ``least``; none is lost.

    A title in many courses is compared once. Titles are indexed by their
    letter counts: cells around sampled pivots, and a title meets its own
    cell and those whose bound reaches ``least``. Two titles have at most as
    many matching characters as they share letters, which bounds their Jaro
    similarity, and ``k`` equal first letters add a tenth each of what is
    missing to 1; only pairs whose bound reaches ``least`` are compared
    character by character, many at once.
    """
    t = courses.where("title is not null").groupBy(F.lower(F.trim("title")).alias("title")).agg(F.count("*").alias("n")).where("title <> ''")
    schema = "title_1 string, title_2 string, n_1 long, n_2 long, similarity double"
    cells = TitleCells.of(t)
    if not len(cells.pivots):
        return courses.sparkSession.createDataFrame([], schema)

    def compare(home: pa.Table, other: pa.Table, same: bool) -> pa.Table:
        x, y = home["title"].to_pylist(), other["title"].to_pylist()
        cx, cy, hx, hy = _letter_counts(x), _letter_counts(y), _heads(x), _heads(y)
        size_x, size_y = cx.sum(axis=1), cy.sum(axis=1)
        p, q = [], []
        for s in range(0, len(x), 32):
            e = slice(s, s + 32)
            shared = np.minimum(cx[e, None, :], cy[None]).sum(axis=2)
            jaro = (shared / size_x[e, None] + shared / size_y[None] + 1) / 3
            prefix = np.logical_and.accumulate((hx[e, None, :] == hy[None]) & (hy[None] > 0), axis=2).sum(axis=2)
            may = jaro + 0.1 * prefix * (1 - jaro) >= least - 1e-4
            if same:
                may &= np.arange(len(y)) > np.arange(s, s + len(may))[:, None]
            i, j = np.nonzero(may)
            p.append(i + s)
            q.append(j)
        p, q = (np.concatenate(v) if v else np.zeros(0, int) for v in (p, q))
        turned = np.array([x[i] > y[j] for i, j in zip(p, q)], bool)
        a, b = [y[j] if z else x[i] for i, j, z in zip(p, q, turned)], [x[i] if z else y[j] for i, j, z in zip(p, q, turned)]
        score = np.round(jaro_winklers(a, b), 4)
        n_x, n_y = home["n"].to_numpy()[p], other["n"].to_numpy()[q]
        hit = np.flatnonzero(score >= least)
        out = [pa.array([a[k] for k in hit], pa.string()), pa.array([b[k] for k in hit], pa.string()), *(pa.array(v[hit]) for v in (np.where(turned, n_y, n_x), np.where(turned, n_x, n_y), score))]
        return pa.table(out, names=["title_1", "title_2", "n_1", "n_2", "similarity"])

    return cell_join(cells.visits(t, least), "title", compare, schema)
