"""SimHash near-duplicates over a Gray-order hierarchical index."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.functions.storage import cut_lineage, release
from coursewright.llm.common import arrow_map, table
from coursewright.operators.graph import connected_components

#: A group of more rows is split by further bits before it is searched.
MOST_IN_GROUP = 20_000
#: Runs of sorted fingerprints under one node, level by level.
FAN_OUT, LEVELS = 8, 5
#: Sets of spanning links that are given where links may turn out wrong.
FORESTS = 4
_ONES = np.uint64(0x0101010101010101)
_hash = functools.partial(xxhash.xxh64_intdigest, seed=42)


# Fingerprints


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; fewer words make one run."""
    w = (text or "").encode("utf-8").lower().split()
    if len(w) <= words:
        return np.array([_hash(b" ".join(w))] if w else [], dtype=np.uint64)
    runs = map(b" ".join, zip(*(w[k:] for k in range(words))))
    return np.fromiter(map(_hash, runs), np.uint64, len(w) - words + 1)


def lane(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th independent 64-bit hash of each hash; lane 0 is the hash itself."""
    if k == 0:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of ``sizes`` hashes, the bits set in more than half of them.

    One bit of every byte is summed at a time, in byte-wide counters over runs
    of at most 255 hashes.
    """
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some]
    ends = np.cumsum(n)
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    starts = np.repeat(ends - n, parts) + 255 * within
    bits = np.zeros(len(some), np.uint64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        won = (2 * counts > n[:, None]).astype(np.uint8)
        bits |= np.ascontiguousarray(won).view(np.uint64).ravel() << np.uint64(k)
    out[some] = bits
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1, more: tuple[int, int] | None = None) -> DataFrame:
    """``id, f0 .. f<lanes-1>``: the SimHash of each text's word shingles, 64 bits a lane.

    ``more`` adds ``g0 ..``: (words, lanes) of a second one. Null texts and
    texts without a word have fingerprint zero. One output row per input row.
    """
    kinds = [("f", words, lanes), *([("g", *more)] if more else [])]
    names = [f"{c}{k}" for c, _, n in kinds for k in range(n)]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done: list[list[np.ndarray]] = []
        held: list[list[np.ndarray]] = [[] for _ in kinds]
        total = 0

        def flush() -> None:
            nonlocal held, total
            if held[0]:
                prints = []
                for h, (_, _, n) in zip(held, kinds):
                    flat, sizes = np.concatenate(h), np.array([len(x) for x in h])
                    prints += [majority_bits(lane(flat, k), sizes) for k in range(n)]
                done.append(prints)
                held, total = [[] for _ in kinds], 0

        for t in batch.column(1).to_pylist():
            for h, (_, n, _) in zip(held, kinds):
                h.append(shingle_hashes(t, n))
            total += len(held[0][-1])
            if total > 100_000:
                flush()
        flush()
        cols = [pa.array(np.concatenate([d[k] for d in done]).view(np.int64)) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *names])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return arrow_map(d, run, f"id {dict(d.dtypes)['id']}, " + ", ".join(f"{c} long" for c in names))


# The index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class GrayIndex:
    """A tree over fingerprints sorted by group and Gray rank.

    A node stands for up to ``FAN_OUT`` neighbours of the level below and keeps
    what all of them share: a mask of the bits that agree and their pattern.
    Gray order puts fingerprints that differ in few bits side by side, so
    upper nodes share long patterns. Two nodes whose shared bits differ in more
    than the radius have no linked pair below them and are dropped whole; a
    child's mask holds its parent's, so differences add up on the way down.
    Nodes whose members are all in one component already are dropped as well,
    which keeps dense groups from being compared pair by pair. Rows of a group
    that have one ``label`` are in one component from the start.
    """

    def __init__(self, group: np.ndarray, prints: np.ndarray, label: np.ndarray | None = None) -> None:
        n = len(group)
        self.prints, self.group, self.parent = prints, group, np.arange(n)
        if label is not None and n:
            order = np.lexsort((np.arange(n), label, group))
            new = np.append(True, (group[order][1:] != group[order][:-1]) | (label[order][1:] != label[order][:-1]))
            self.parent[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        self.edges: list[np.ndarray] = []
        self.used = np.zeros(0, np.int64)
        self.every = False
        self.starts = [np.arange(n)]
        self.same, self.pattern = [np.full_like(prints, 0xFFFFFFFFFFFFFFFF)], [prints]
        while len(self.starts) < LEVELS and len(self.starts[-1]) > 1:
            at = np.arange(0, len(self.starts[-1]), FAN_OUT)
            every = np.bitwise_and.reduceat(self.pattern[-1], at, axis=0)
            some = np.bitwise_or.reduceat(self.pattern[-1], at, axis=0)
            held = np.bitwise_and.reduceat(self.same[-1], at, axis=0)
            self.same.append(~(every ^ some) & held)
            self.pattern.append(every)
            self.starts.append(self.starts[-1][at])

    def _bounds(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        first = self.starts[level]
        last = np.append(first[1:], len(self.group)) - 1
        return first, last

    def _differences(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shared = self.same[level][i] & self.same[level][j]
        return np.bitwise_count((self.pattern[level][i] ^ self.pattern[level][j]) & shared).sum(axis=1)

    def _root(self, k: int) -> int:
        p = self.parent
        while p[k] != k:
            p[k] = p[p[k]]
            k = p[k]
        return k

    def _unite(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the components of linked rows; the links that do so are kept as edges."""
        roots = np.stack([self.parent[i], self.parent[j]], axis=1)
        roots.sort(axis=1)
        _, one = np.unique(roots, axis=0, return_index=True)
        kept = []
        for k, a, b in zip(one.tolist(), i[one].tolist(), j[one].tolist()):
            a, b = self._root(a), self._root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                kept.append(k)
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                break
            self.parent = up
        self.edges.append(np.stack([i[kept], j[kept]], axis=1))

    def _pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.minimum(i, j) * len(self.group) + np.maximum(i, j)

    def forest(self, radii: tuple[int, ...], sure: int | None = None, forests: int | None = FORESTS) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs that span each component, with their differences.

        Rows of a group link if they differ in at most the last of ``radii``.
        The radii are gone through in order, so components are joined by links
        that are short, to within a step between radii. Links of more than
        ``sure`` bits may turn out wrong, so ``forests`` sets of them are given
        that have no pair in common, each spanning what the sure ones leave.
        With ``forests`` None all links of up to the last radius are given.
        """
        if forests is None:
            self.every = True
            self._descend(radii[-1])
            e = np.concatenate(self.edges) if self.edges else np.zeros((0, 2), np.int64)
            return e, np.bitwise_count(self.prints[e[:, 0]] ^ self.prints[e[:, 1]]).sum(axis=1)
        certain = [r for r in radii if sure is None or r <= sure]
        for radius in certain:
            self._join(radius)
        base = self.parent.copy()
        for _ in range(forests if len(certain) < len(radii) else 0):
            self.parent, before = base.copy(), len(self.edges)
            for radius in radii[len(certain) :]:
                self._join(radius)
            if len(self.edges) == before:
                break
            self.used = np.unique(np.concatenate([self.used, *[self._pairs(e[:, 0], e[:, 1]) for e in self.edges[before:]]]))
        e = np.concatenate(self.edges) if self.edges else np.zeros((0, 2), np.int64)
        return e, np.bitwise_count(self.prints[e[:, 0]] ^ self.prints[e[:, 1]]).sum(axis=1)

    def _join(self, radius: int) -> None:
        g = self.group
        near = np.flatnonzero((g[1:] == g[:-1]) & (np.bitwise_count(self.prints[1:] ^ self.prints[:-1]).sum(axis=1) <= radius) & (self.parent[1:] != self.parent[:-1]))
        near = near[~np.isin(self._pairs(near, near + 1), self.used)]
        if len(near):
            self._unite(near + 1, near)
        self._descend(radius)

    def _descend(self, radius: int) -> None:
        g, n = self.group, len(self.group)
        if n < 2:
            return
        top = len(self.starts) - 1
        first, last = self._bounds(top)
        reach = np.searchsorted(g[first], g[last], side="right")
        count = reach - np.arange(len(first))
        block = 1 << 13
        stack = []
        for a in range(0, len(first), 64):
            c = count[a : a + 64]
            i = np.repeat(np.arange(a, a + len(c)), c)
            j = i + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            stack += [(top, i[k : k + block], j[k : k + block]) for k in range(0, len(i), block)]
        while stack:
            level, i, j = stack.pop()
            keep = self._differences(level, i, j) <= radius
            i, j = i[keep], j[keep]
            if level == 0:
                new = self.parent[i] != self.parent[j]
                if self.every:
                    self.edges.append(np.stack([i[new], j[new]], axis=1))
                    continue
                if len(self.used) and new.any():
                    new[new] = ~np.isin(self._pairs(i[new], j[new]), self.used)
                if new.any():
                    self._unite(i[new], j[new])
                continue
            first, last = self._bounds(level)
            low = np.minimum.reduceat(self.parent, first)
            high = np.maximum.reduceat(self.parent, first)
            open_ = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            i, j = i[open_], j[open_]
            if not len(i):
                continue
            below = len(self.starts[level - 1])
            a, b = np.divmod(np.arange(FAN_OUT * FAN_OUT), FAN_OUT)
            ci = (i[:, None] * FAN_OUT + a).ravel()
            cj = (j[:, None] * FAN_OUT + b).ravel()
            ok = (ci <= cj if level > 1 else ci < cj) & (cj < below)
            ci, cj = ci[ok], cj[ok]
            first, last = self._bounds(level - 1)
            ok = g[last[ci]] >= g[first[cj]]
            ci, cj = ci[ok], cj[ok]
            stack += [(level - 1, ci[k : k + block], cj[k : k + block]) for k in range(0, len(ci), block)]


def _search(keyed: DataFrame, lanes: int, *radii: int, sure: int | None = None, forests: int | None = FORESTS) -> DataFrame:
    """Spanning edges ``src, dst, apart`` of the links within each group of ``mask, bits``.

    With ``sure`` they are linked pairs with their differing bits, with
    ``forests`` None all of these, else stars. Stars are between labels, if rows have
    a ``label``: a group whose rows are in one component already gives none.
    """
    prints, labelled = [f"f{k}" for k in range(lanes)], "label" in keyed.columns

    def link(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        node, mask, bits = (t.column(c).to_numpy() for c in ("node", "mask", "bits"))
        p = np.stack([t.column(c).to_numpy() for c in prints], axis=1).view(np.uint64)
        order = np.lexsort((gray_rank(p[:, 0]), bits, mask))
        node, mask, bits, p = node[order], mask[order], bits[order], p[order]
        label = t.column("label").to_numpy()[order] if labelled else node
        group = np.concatenate([[0], np.cumsum((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1]))])
        pair = np.zeros(len(group), bool)
        pair[1:] = group[1:] == group[:-1]
        pair[:-1] |= pair[1:].copy()
        node, label, group, p = node[pair], label[pair], group[pair], np.ascontiguousarray(p[pair])
        index = GrayIndex(group, p, label if labelled else None)
        e, apart = index.forest(radii, sure, forests) if len(node) else (np.zeros((0, 2), np.int64), np.zeros(0))
        if sure is None and forests is not None and len(node):
            # where only components matter, all keys give a row the same edge: to the first of its component
            far = np.flatnonzero(label != label[index.parent])
            links = np.unique(np.stack([label[far], label[index.parent[far]]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1]), pa.array(np.zeros(len(links), np.int32))], names=["src", "dst", "apart"])
        return pa.RecordBatch.from_arrays([pa.array(node[e[:, 0]]), pa.array(node[e[:, 1]]), pa.array(apart.astype(np.int32))], names=["src", "dst", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < 20_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            mask, bits = t.column("mask").to_numpy(), t.column("bits").to_numpy()
            cut = n - 1
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1]))
            if not len(change):
                held = t.to_batches()
                continue
            cut = int(change[-1]) + 1
            yield link(t.slice(0, cut).to_batches())
            held = t.slice(cut).combine_chunks().to_batches()
            n -= cut
        if n:
            yield link(held)

    dealt = keyed.repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return dealt.mapInArrow(run, "src long, dst long, apart int")


def _split_masks(free: int, parts: int) -> list[int]:
    """The set bits of ``free`` in ``parts`` runs, as masks."""
    bits = [k for k in range(64) if free >> k & 1]
    size = -(-len(bits) // parts)
    return [sum(1 << k for k in bits[a : a + size]) for a in range(0, len(bits), size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _refine(rows: DataFrame, masks: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """Key each row by its mask plus each of ``radius + 1`` parts of its free bits.

    Two fingerprints that agree under a mask and differ in at most ``radius``
    bits agree in one of the parts as well, so no link is lost.
    """
    wider = {m: [m | s for s in _split_masks(~m & (1 << 64) - 1, radius + 1)] for m in masks}
    literal = lambda m: F.lit(_signed(m)).cast("long")
    if masks == [0]:
        nexts = F.array(*[literal(m) for m in wider[0]])
    else:
        nexts = F.element_at(F.create_map(*[x for m in masks for x in (literal(m), F.array(*[literal(w) for w in wider[m]]))]), F.col("mask"))
    out = rows.drop("mask", "bits").withColumn("mask", F.lit(0)) if masks == [0] else rows
    out = out.withColumn("mask", F.explode(nexts)).withColumn("bits", F.col("f0").bitwiseAND(F.col("mask")))
    return out, sorted({w for ws in wider.values() for w in ws})


def hamming_links(prints: DataFrame, radius: int = 3, most: int = MOST_IN_GROUP) -> DataFrame:
    """Spanning edges between distinct 64-bit fingerprints ``node, f0`` that differ in at most ``radius`` bits.

    Links never leave a group of fingerprints that agree in one of ``radius +
    1`` parts of the bits. A group of more than ``most`` rows is keyed again by
    parts of the bits that are still free. After four rounds 20 bits at most
    are free, so no group holds more than about a million fingerprints,
    whatever the input; it is searched in one task with a few tens of MB.
    """
    keyed, masks = _refine(prints, [0], radius)
    found: list[DataFrame] = []
    for round_ in range(4):
        if round_ == 3:
            found.append(_search(keyed, 1, radius))
            break
        big = cut_lineage(keyed.groupBy("mask", "bits").count().where(F.col("count") > most).drop("count"))
        if big.isEmpty():
            found.append(_search(keyed, 1, radius))
            break
        found.append(_search(keyed.join(F.broadcast(big) if big.count() < 10_000 else big, ["mask", "bits"], "left_anti"), 1, radius))
        keyed, masks = _refine(keyed.join(big, ["mask", "bits"], "left_semi"), masks, radius)
    return functools.reduce(DataFrame.union, found)


def components_of(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component_id`` of distinct ``node, first_id``: the smallest id reachable over the edges."""
    linked = connected_components(edges)
    least = linked.join(prints.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_node = linked.join(least, "component").select("node", "component_id")
    return prints.select("node", "first_id").join(by_node, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``id, f0, component_id`` of every document.

    Documents link if their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable. Copies are merged into one
    fingerprint first and are never expanded into pairs. Null texts have
    fingerprint zero, which links like any other. A null id is never the
    smallest unless all are null. Repeated rows stay repeated; an empty table
    gives an empty result.
    """
    every = cut_lineage(fingerprints(docs, id_col, text_col, words))
    prints = cut_lineage(every.groupBy(F.col("f0").alias("node")).agg(F.min("id").alias("first_id")).withColumn("f0", F.col("node")))
    labels = components_of(prints, hamming_links(prints.select("node", "f0"), radius))
    return every.join(labels, every["f0"] == labels["node"]).select("id", "f0", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null texts have fingerprint zero, repeated rows stay."""
    out = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), _hex(F.col("f0")).alias("fingerprint"), "component_id")


def _hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


# Near duplicates by shingle similarity

#: Lanes over three-word shingles: two are compared to find candidates, the others make keys of 16 bits.
WIDE, COMPARED = 12, 2
#: Bits of those 128 in which candidates differ at most. Texts of five-word similarity 0.8 differ in 15 where words are changed here and there, in 19 where a block is.
WIDE_RADIUS = 30
#: Lanes over five-word shingles, and how many of them make keys as well.
FINE, FINE_KEYS = 8, 4
#: Of those 512 bits texts of similarity 0.8 differ in 77, with a deviation of 8: so many and fewer are links, those up to the last are counted exactly.
SURE, STEPS = 50, (50, 64, 77, 90, 104)
SHINGLE, SIMILAR = 5, 0.8
#: Keys after which the candidates found so far are joined.
KEY_ROUNDS = (8,)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_IN_GROUP, forests: int | None = FORESTS) -> DataFrame:
    """``id, sig, component`` of every document, linking texts whose sets of five-word shingles have a similarity of 0.8 or more.

    Candidates: a fingerprint over three-word shingles has 768 bits and one
    over five-word shingles 512. A pair that agrees in one of 56 keys of 16 bits
    is compared in 128 others by the Gray index. Decision: within each group
    of candidates the index compares the 512 bits and joins components by short
    links first. Links of ``SURE`` bits stand (the similarity is then about
    0.9, and under 0.8 in one of 2,000); longer ones between components are
    counted on the texts' whole shingle sets and stand from ``SIMILAR``. A
    group of more than ``most`` rows is searched by pairs of its parts, with
    the same links. Of a group's longer links ``forests`` disjoint spanning sets
    are counted. With None every pair of a group of candidates that differs in
    up to the last of ``STEPS`` bits is counted, short or long, so no link
    rests on bits alone and none is lost to the number of sets; the pairs of a
    group then grow with its square.

    Keys are gone through in rounds, few first: rows that one round has joined
    have one label in the next, where a key tells only of labels that it
    joins, so many keys of a large group do not repeat its links.

    ``sig`` is the text's hash, ``component`` the smallest ``(id is null, id,
    sig)`` of its group. Null and empty texts are copies of each other. A null
    id is never the smallest unless all are null; rows that repeat id and text
    have the same values; an empty table gives an empty result.
    """
    exact = forests is None
    wide, fine = [f"f{k}" for k in range(WIDE)], [f"g{k}" for k in range(FINE)]
    d = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sig")).alias("key"), F.col(text_col).alias("t"))
    every = cut_lineage(fingerprints(d, "key", "t", 3, WIDE, more=(SHINGLE, FINE)).select("id.id", "id.sig", F.xxhash64(*wide, *fine).alias("node"), *wide, *fine))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sig"))
    prints = cut_lineage(every.groupBy("node").agg(least.alias("first_id"), *[F.first(c).alias(c) for c in (*wide, *fine)]))
    keys = [F.shiftrightunsigned(F.col(c), 16 * k).bitwiseAND(F.lit(0xFFFF)) for c in (*wide[COMPARED:], *fine[:FINE_KEYS]) for k in range(4)]
    labels, first = prints.select("node", F.col("node").alias("label")), 0
    for last in (*KEY_ROUNDS, len(keys)):
        rows = prints.join(labels, "node") if first else prints.withColumn("label", F.col("node"))
        keyed = rows.select("node", "label", *wide[:COMPARED], F.posexplode(F.array(*keys[first:last])).alias("mask", "bits"))
        edges = _by_keys(keyed.withColumn("mask", F.col("mask").cast("long")), COMPARED, most, WIDE_RADIUS)
        labels, first = cut_lineage(relabelled(labels, connected_components(edges))), last
        del rows, keyed, edges
        release(docs.sparkSession)
    several = labels.groupBy("label").count().where("count > 1").select("label")
    rows = labels.join(several, "label").join(prints, "node").select("node", *[F.col(c).alias(f"f{k}") for k, c in enumerate(fine)], F.lit(0).cast("long").alias("mask"), F.col("label").alias("bits"))
    links = cut_lineage(_by_keys(cut_lineage(rows), FINE, most, *STEPS, sure=None if exact else SURE, forests=forests))
    sure = links.where(F.col("apart") <= (-1 if exact else SURE))
    joined = cut_lineage(relabelled(prints.select("node", F.col("node").alias("label")), connected_components(sure)))
    more = _similar(d, prints, links.where(F.col("apart") > (-1 if exact else SURE)), joined)
    labels = cut_lineage(relabelled(joined, connected_components(more)))
    least = labels.join(prints.select("node", "first_id"), "node").groupBy("label").agg(F.min("first_id").alias("component"))
    by_node = labels.join(least, "label").select("node", F.col("component").alias("c"))
    return every.select("id", "sig", "node").join(by_node, "node").select("id", "sig", F.col("c").alias("component"))


def relabelled(labels: DataFrame, components: DataFrame) -> DataFrame:
    """``node, label`` with each label that ``components`` (``node, component``) names replaced by its component."""
    to = components.select(F.col("node").alias("label"), "component")
    return labels.join(to, "label", "left").select("node", F.coalesce("component", "label").alias("label"))


def _similar(d: DataFrame, prints: DataFrame, links: DataFrame, joined: DataFrame) -> DataFrame:
    """The labels of ``joined`` that a link connects whose texts are similar by their whole shingle sets, as ``src, dst``."""
    for side in ("src", "dst"):
        links = links.join(joined.select(F.col("node").alias(side), F.col("label").alias(f"{side}_in")), side)
    links = cut_lineage(links.where("src_in <> dst_in").select("src", "dst", "src_in", "dst_in").distinct())
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    texts = prints.join(nodes, "node").select("node", F.col("first_id.sig").alias("sig"))

    def shingles(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [np.unique(shingle_hashes(t, SHINGLE)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    held = d.select(F.col("key.sig").alias("sig"), "t").join(texts, "sig").groupBy("node").agg(F.first("t").alias("t"))
    sets = cut_lineage(arrow_map(held, shingles, "node long, set array<long>", rows=64))
    pairs = links.join(sets.select(F.col("node").alias("src"), F.col("set").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("set").alias("b")), "dst")
    both = F.size(F.array_intersect("a", "b"))
    return pairs.where(both >= SIMILAR * (F.size("a") + F.size("b") - both)).select(F.col("src_in").alias("src"), F.col("dst_in").alias("dst")).distinct()


def _by_keys(keyed: DataFrame, lanes: int, most: int, *radii: int, sure: int | None = None, forests: int | None = FORESTS) -> DataFrame:
    """Edges within the groups ``mask, bits``.

    A group of more than ``most`` rows is cut into parts of about half as many,
    and each two parts are searched together, so that every pair meets.
    """
    prints = [*(["label"] if "label" in keyed.columns else []), *[f"f{k}" for k in range(lanes)]]
    big = cut_lineage(keyed.groupBy("mask", "bits").count().where(F.col("count") > most))
    lean = keyed.select("node", *prints, "mask", "bits")
    if big.isEmpty():
        return _search(lean, lanes, *radii, sure=sure, forests=forests)
    n_parts = F.ceil(2 * F.col("count") / F.lit(most)).cast("long")
    hot = lean.join(big.select("mask", "bits", n_parts.alias("n")), ["mask", "bits"])
    hot = hot.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).where("part <> other")
    pair = F.xxhash64("bits", F.least("part", "other"), F.greatest("part", "other"))
    second = hot.select("node", *prints, (F.col("mask") + 1000).alias("mask"), pair.alias("bits"))
    rest = _search(lean.join(big, ["mask", "bits"], "left_anti"), lanes, *radii, sure=sure, forests=forests)
    return rest.union(_search(second, lanes, *radii, sure=sure, forests=forests))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates one document, with all its columns.

    The one with the smallest id stays, a null id last; of rows that repeat id
    and text any one. Another text under the id of a row that goes stays. Null
    and empty texts are one group; an empty table stays empty.
    """
    found = near_duplicates(docs).groupBy("id", "sig").agg(F.first("component").alias("c"), F.count("*").alias("n"))
    found = found.where((F.struct("id", "sig") != F.struct("c.id", "c.sig")) | F.col("id").isNull() & F.col("c.id").isNotNull() | (F.col("n") > 1))
    gone = ~(F.col("id").eqNullSafe(F.col("c.id")) & (F.col("sig") == F.col("c.sig")))
    marked = cut_lineage(found.select(F.col("id").alias("__id"), F.col("sig").alias("__sig"), gone.alias("__gone")))
    own = docs.withColumn("__h", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__sig"))
    once = own.join(marked, same, "left_anti")
    again = own.join(marked.where("not __gone"), same, "left_semi").dropDuplicates(["doc_id", "__h"])
    return once.unionByName(again).select(*docs.columns)
