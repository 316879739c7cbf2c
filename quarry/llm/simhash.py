"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints, one row each, are looked up among themselves.  The 64
bits are cut into ``distance + r`` blocks; two fingerprints within ``distance``
agree on at least ``r`` of them, so each choice of ``r`` blocks is one table
whose upper nodes are the shared bit patterns under that choice's mask.  Below
such a node fingerprints are sorted by Gray rank, where neighbours differ in
few bits, and runs of them form a tree: a node keeps the mask of the bits that
all of its fingerprints share and their pattern.  Two nodes differ at least in
the bits where both masks are set and the patterns differ; as masks grow
downwards these differences accumulate, and a pair of groups beyond the
distance is pruned whole.  A pair whose fingerprints are already in one
component is pruned too, so a dense group costs about its size and never its
square.  Nodes emit a star for each component they find, not their pairs.

``r`` grows with the number of fingerprints so that upper nodes stay small;
every choice finds all links.  An upper node of more than ``HOT`` fingerprints
is cut by the same rule into lower ones, on the bits that its mask leaves; what
is still larger is cut into blocks, and each pair of blocks is a task of its own.

Components are joined across nodes by alternating large-star and small-star
rounds on written tables.

Defined cases: a null text is empty; a text without words has fingerprint 0
and links like any other; fewer words than a shingle make one shingle;
repeated rows share a fingerprint and so a component; a null doc_id belongs to
its component but never names it unless no other id does; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import column, key, numbered
from quarry.session import ship
from quarry.storage import broadcast_if_small, materialize, small_batches

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: An upper node of more fingerprints is searched by several tasks.
HOT = 200_000
#: Dropped documents are broadcast up to this many rows (about 80 bytes each), else joined by a shuffle of the texts.
BROADCAST_IDS = 500_000
#: Children of a node.
FAN = 16
#: Pairs compared at once, and pairs of nodes expanded at once, each into FAN * FAN at most; they bound a worker's arrays.
FRONTIER, EXPAND = 1 << 18, 1 << 13


# Fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the contract's white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))]
    return _majority(np.array(hashes, dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and the fingerprint as a signed long."""
    from pyspark.sql.functions import pandas_udf

    ship(docs.sparkSession)

    @pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64))

    keep = docs.columns if keep is None else keep
    return docs.select(*keep, run(F.col(text)).alias(name))


# The index


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def blocks(n: int) -> list[int]:
    """Masks of ``n`` nearly equal runs of the 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def tables(n: int, distance: int = DISTANCE, least: int = 1) -> list[int]:
    """A mask for each table: all choices of r of distance + r blocks.

    r is the smallest at which an upper node has 512 of ``n`` spread
    fingerprints at most, 4 at most.
    """
    r = least
    while r < 4 and n / 2 ** (64 * r / (distance + r)) > 512:
        r += 1
    b = blocks(distance + r)
    return [sum(c) for c in combinations(b, r)]


def finer(mask: int, distance: int = DISTANCE, r: int = 2) -> list[int]:
    """Masks of the tables below a node with ``mask``: all choices of r of distance + r runs of the other bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // (distance + r) for i in range(distance + r + 1)]
    runs = [sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(runs, r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Forest:
    """Trees over fingerprints sorted by (upper node, Gray rank), one for each upper node."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.levels = []  # (mask of shared bits, pattern, first child, past the last child)
        full = np.full(len(codes), ~np.uint64(0))
        self.levels.append((full, codes, None, None))
        while len(np.unique(group)) < len(group):
            # Runs of FAN nodes that don't cross an upper node.
            start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            length = np.diff(np.append(start, len(group)))
            offset = np.arange(len(group)) - np.repeat(start, length)
            first = np.flatnonzero(offset % FAN == 0)
            mask, pattern = self.levels[-1][:2]
            ones = np.bitwise_and.reduceat(pattern & mask, first)
            both = np.bitwise_and.reduceat(mask, first)
            some = np.bitwise_or.reduceat(pattern & mask, first)
            same = both & ~(ones ^ some)
            self.levels.append((same, ones & same, first, np.append(first[1:], len(group))))
            group = group[first]
        self.labels = np.arange(len(codes))

    def search(self, distance: int) -> np.ndarray:
        """Labels of the components under links within ``distance`` in each tree."""
        top = np.arange(len(self.levels[-1][0]))
        stack = [(len(self.levels) - 1, top, top)]
        uniform = self._uniform()
        while stack:
            level, a, b = stack.pop()
            most = EXPAND if level else FRONTIER
            if len(a) > most:
                stack.append((level, a[most:], b[most:]))
                a, b = a[:most], b[:most]
            # Pairs of nodes whose fingerprints are all in one component have nothing to add.
            u = uniform[level]
            open_ = (u[a] < 0) | (u[a] != u[b])
            a, b = a[open_], b[open_]
            mask, pattern, _, _ = self.levels[level]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
            a, b = a[near], b[near]
            if not len(a):
                continue
            if level == 0:
                if self._join(a, b):
                    uniform = self._uniform()
                continue
            stack.append((level - 1, *self._children(level, a, b)))
        return self.labels

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, first, last = self.levels[level]
        na, nb = last[a] - first[a], last[b] - first[b]
        n = na * nb
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(nb, n)
        x, y = np.repeat(first[a], n) + at // width, np.repeat(first[b], n) + at % width
        keep = (x < y) if level == 1 else (x <= y)
        keep |= np.repeat(a != b, n)
        return x[keep], y[keep]

    def _join(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Merge the components of each pair; each label is the smallest position of its component."""
        labels, changed = self.labels, False
        x, y = labels[a], labels[b]
        while True:
            differ = x != y
            if not differ.any():
                return changed
            changed = True
            x, y = x[differ], y[differ]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(labels, high, low)
            while True:  # to the roots
                up = labels[labels]
                if (up == labels).all():
                    break
                labels[:] = up
            x, y = labels[low], labels[high]

    def _uniform(self) -> list[np.ndarray]:
        """For each node the one label of all of its fingerprints, or -1."""
        out = [self.labels]
        for _, _, first, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(out[-1], first), np.maximum.reduceat(out[-1], first)
            out.append(np.where(low == high, low, -1))
        return out


def stars(group: np.ndarray, codes: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smaller fingerprint of its component) of each linked one within each upper node."""
    rank = gray_rank(codes)
    order = np.lexsort((rank, group))
    group, codes = group[order], codes[order]
    labels = Forest(group, codes).search(distance)
    # The smallest code of each component is its root.
    root = np.full(len(codes), ~np.uint64(0))
    np.minimum.at(root, labels, codes)
    root = root[labels]
    far = root != codes
    return codes[far], root[far]


# Distribution


def links(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT, least: int = 1) -> DataFrame:
    """Edges (u, v), u > v as signed longs, whose components are those of all links among distinct ``fp``."""
    spark = prints.sparkSession
    ship(spark)
    n = prints.count()
    masks = tables(n, distance, least)
    below = lambda ms: F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in ms])
    node = ["tab", "key", "sub", "part"]
    keyed = prints.select("fp", F.posexplode(below(masks)).alias("tab", "key")).select("fp", "tab", "key", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("part"))

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of nodes that one task may hold, lone fingerprints left out, and the larger nodes with their sizes."""
        sizes = materialize(rows.groupBy(*node).agg(F.count("*").alias("n")).where(F.col("n") > 1), "simhash-nodes")
        return rows.join(sizes.where(F.col("n") <= hot).select(*node), node, "left_semi"), sizes.where(F.col("n") > hot)

    one = [F.lit(0).alias("i"), F.lit(0).alias("j")]
    plain, large = parted(keyed)
    work = plain.select("fp", *node, *one)
    if not large.isEmpty():
        deep = F.element_at(F.array(*[below(finer(m, distance)) for m in masks]), F.col("tab") + 1)
        lower = keyed.join(broadcast_if_small(large.select(*node), 100_000), node, "left_semi").select("fp", "tab", "key", F.posexplode(deep).alias("sub", "part"))
        plain, large = parted(lower)
        work = work.unionByName(plain.select("fp", *node, *one))
        if not large.isEmpty():
            parts = large.select(*node, F.ceil(F.col("n") / hot).cast("int").alias("parts"))
            cut = lower.join(broadcast_if_small(parts, 100_000), node).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
            pairs = cut.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            work = work.unionByName(pairs.select("fp", *node, F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")))
    dealt = [*node, "i", "j"]
    parts = work.repartition(*dealt).sortWithinPartitions(*dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def search(t: pa.Table, whole: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            cols = [t[c].to_numpy() for c in dealt]
            new = np.zeros(len(t), bool)
            new[:1] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            cut = len(t) if whole else int(starts[-1])  # the last node may go on in the next batch
            if not cut:
                return None, t
            group = np.cumsum(new)[:cut]
            codes = t["fp"].to_numpy()[:cut].astype(np.int64).view(np.uint64)
            u, v = stars(group, codes, distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"]), t.slice(cut)

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += len(b)
            if rows >= 100_000:
                out, rest = search(pa.concat_tables(held).combine_chunks(), False)
                held, rows = [rest], len(rest)
                if out is not None:
                    yield out
        if rows:
            yield search(pa.concat_tables(held).combine_chunks(), True)[0]

    edges = parts.mapInArrow(run, "u long, v long").distinct()
    # Roots are smallest as unsigned numbers; as signed ones the edge may point up.
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every vertex: alternating large-star and small-star until nothing changes.

    Each vertex ends on the smallest (signed) vertex of its component.  Both
    sides of a join are written tables, so that it has plain exchanges and the
    hub of a large component, a hot key, is split by adaptive execution.
    """
    edges = materialize(edges.where("u <> v").distinct(), "components")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    state = mark(edges)
    while state[0]:
        # Large star: each larger neighbour of a vertex links to the smallest of it and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components-large")
        # Small star: a vertex and its smaller neighbours link to the smallest.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = mark(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def classes(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT, least: int = 1) -> DataFrame:
    """doc_id, fp, component_id and root (the component's fingerprint) of a written table (doc_id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), distance, hot, least))
    placed = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "simhash-placed")
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1").select("root", F.col("component_id").alias("c"))
    by_print = placed.join(names, "root", "left").select(F.col("fp").alias("_fp"), F.coalesce("c", "first").alias("component_id"), "root")
    by_print = materialize(by_print, "simhash-classes")
    # A fingerprint may hold a third of the rows: both sides are plain exchanges, which adaptive execution splits.
    return prints.join(by_print, F.col("fp") == F.col("_fp")).drop("_fp")


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links) of each document."""
    d = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    with small_batches(docs.sparkSession):
        prints = materialize(with_fingerprints(d, keep=["doc_id"]), "simhash-prints")
    return classes(prints, distance).drop("root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One document of each component, its smallest doc_id, with the columns of ``docs``.

    Of rows that repeat that doc_id the one with the smallest text hash stays.
    """
    rows = numbered(docs)
    doc_id, text = key(docs, doc_id), key(docs, text)
    with small_batches(docs.sparkSession):
        table = materialize(with_fingerprints(rows, text, "_fp"), "simhash-documents")
    found = materialize(classes(table.select(F.col(doc_id).alias("doc_id"), F.col("_fp").alias("fp")), distance), "simhash-found")
    names = F.expr("doc_id <=> component_id")
    dropped = materialize(found.where(~names).select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f")).distinct(), "simhash-dropped")
    left = table.join(broadcast_if_small(dropped, BROADCAST_IDS), F.col(doc_id).eqNullSafe(F.col("_d")) & (F.col("_fp") == F.col("_f")), "left_anti")
    # Components whose naming doc_id is in several rows.
    again = materialize(found.where(names).groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "simhash-repeats")
    if again.isEmpty():
        return left.select(*rows.columns).toDF(*docs.columns)
    prints = found.join(again, "root", "left_semi").select(F.col("fp").alias("_f"), F.col("root").alias("_root")).distinct()
    here = F.col("_fp") == F.col("_f")
    row = F.struct(*rows.columns)
    one = left.join(prints, here).groupBy("_root").agg(F.min_by(row, F.xxhash64(F.col(text))).alias("_row")).select("_row.*")
    return left.join(prints, here, "left_anti").select(*rows.columns).unionByName(one).toDF(*docs.columns)
