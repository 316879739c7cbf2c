"""Source divergence audit: how far the sources of a language are from each other in what words they use.

A language keeps the terms that at least ``MIN_DOCS`` of its documents hold.
Each (language, source) group, and each language, gives each kept term a
smoothed share in billionths, ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``
with N the group's occurrences of kept terms and V their number.  Two sources
differ by the sum over all kept terms of their shares' absolute differences.

Counts are columns of a wide table, one for each term, and mostly zero.  Terms
with the same sparse vector of (source, count) are one vector with a
multiplicity.  A source that lacks a term has the same floor share for all
such terms, so the sum over all terms splits into

* V times the difference of the two floors;
* for each source what its own terms add against another's floor, which hangs
  on its counts alone: a histogram of counts, met by binary search;
* for each distinct vector and each pair of sources in it what the pair adds
  beyond that, times the vector's multiplicity.

So no work is done for the zeros.  Sources of a language are cut into blocks
of ``BLOCK``, so a task holds one matrix of two blocks, however many there are.
All numbers are whole, shares from decimals of 38 digits, so sums are exact.

A row of the vocabulary holds a number for each source that has the term, and
the result a row for each ordered pair of sources, as the audit asks for; both
grow with the number of sources and not with the documents.

Defined cases: null lang, source or text are empty strings, and an empty lang
or source is one like any other; a group without kept terms has all of its
pairs, and value 0 everywhere if its language keeps no term; ties are ordered
by the item's UTF-8 bytes; repeated rows count as often as they stand; very
long texts are counted in pieces; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.columns import key, numbered
from quarry.session import release_memory, ship
from quarry.storage import broadcast_if_small, materialize, small_batches

MIN_DOCS = 30
RANKS = 50
#: Sources of a language that one side of a task's matrix holds.
BLOCK = 512
#: Tasks over which the vectors of one pair of blocks are spread.
SALTS = 32
#: Groups are broadcast up to this many rows (about 80 bytes each), else joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: Distinct terms that a worker counts before it hands them on, and bytes of text it cuts at a time.
HELD_TERMS, PIECE = 200_000, 1 << 20

#: Bytes of terms, A to Z lower-cased; all others become blanks.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, of a bounded run of bytes at a time."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            folded = raw[at:end].translate(_FOLD)
            cut = folded.rfind(b" ")
            if cut < 0:  # a term longer than a piece
                while end < len(raw) and raw[end : end + 1].translate(_FOLD) != b" ":
                    end += 1
                yield raw[at:end].translate(_FOLD).split()
            else:
                end = at + cut + 1
                yield folded[:cut].split()
        else:
            yield raw[at:].translate(_FOLD).split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of what a task has read, and a row without a term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = [None, *n]
            size = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(df[t] for t in n)], pa.int64())],
                names=["lang", "source", "term", "n", "df"],
            )
        held.clear()

    for batch in batches:
        for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            own: Counter = Counter()
            for words in pieces(raw.as_py()):
                own.update(words)
            n.update(own)
            df.update(own.keys())
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from out()
    yield from out()
    release_memory()


def vocabulary(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, counts), written: the kept terms with (source, n) for each source; without a term: all sources of the language."""
    ship(docs.sparkSession)
    filled = lambda c: F.coalesce(F.col(key(docs, c)).cast("string"), F.lit(""))
    rows = numbered(docs).select(filled(lang).alias("lang"), filled(source).alias("source"), filled(text).alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    # Dealt by term, so that both groupings need this one exchange.
    cells = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = cells.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    with small_batches(docs.sparkSession):
        return materialize(terms.where(F.col("term").isNull() | (F.col("df") >= min_docs)).drop("df"), "divergence-terms")


def _share(count: Column, total: Column, terms: Column) -> Column:
    return F.when(terms > 0, F.lit(1).cast("long") + F.call_function("div", ((count + 5).cast("decimal(28,0)") * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,0)"), (total + 5 * terms).cast("decimal(38,0)"))).otherwise(F.lit(0).cast("long"))


def groups_of(vocab: DataFrame) -> DataFrame:
    """(lang, s, source, total, z, terms, lang_total), written: each group with its place ``s`` among the language's sources and its floor share."""
    kept = vocab.where("term is not null")
    totals = vocab.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    langs = vocab.groupBy("lang").agg(F.count("term").alias("terms"), F.sum("n").alias("lang_total"))
    names = vocab.where("term is null").select("lang", F.posexplode(F.transform("counts", lambda c: c["source"])).alias("s", "source"))
    langs = broadcast_if_small(materialize(langs, "divergence-langs"), BROADCAST_GROUPS)
    out = names.join(totals, ["lang", "source"]).join(langs, "lang")
    return materialize(out.withColumn("z", _share(F.lit(0), F.col("total"), F.col("terms"))), "divergence-groups")


def _apart(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each two sources what the distinct vectors add; rows come by (lang, a, b), the blocks of the two sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "lo", "hi", "x"]
        at, sums = None, np.zeros((block, block), np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            if at is not None:
                lang, a, b = at
                i, j = np.nonzero(sums)
                keep = (i < j) if a == b else slice(None)
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array((a * block + i).astype(np.int32)), pa.array((b * block + j).astype(np.int32)), pa.array(sums[i, j])], names=names)
                sums[:] = 0

        def lists(col: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
            values = col.values
            return col.offsets.to_numpy(), [values.field(k).to_numpy() for k in ("s", "p", "z")]

        for batch in batches:
            lo, (ls, lp, lz) = lists(batch.column(4))
            ro, (rs, rp, rz) = lists(batch.column(5))
            times = batch.column(3).to_numpy()
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if key != at:
                    yield from out()
                    at = key
                i = slice(lo[k], lo[k + 1])
                s, p, z = ls[i], lp[i][:, None], lz[i][:, None]
                if key[1] == key[2]:
                    t, q, y = ls[i], lp[i], lz[i]
                else:
                    j = slice(ro[k], ro[k + 1])
                    t, q, y = rs[j], rp[j], rz[j]
                sums[np.ix_(s % block, t % block)] += times[k] * (np.abs(p - q) - np.abs(p - y) - np.abs(q - z) + np.abs(z - y))
        yield from out()

    return run


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each source, against each other one's floor, what its own terms add; and the floors' difference once for each pair."""
    for batch in batches:
        for lang, s, z, terms, ps, hs, ts, ys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            p, h = np.array(ps or [], np.int64), np.array(hs or [], np.int64)
            below, weight = np.r_[0, np.cumsum(h)], np.r_[0, np.cumsum(h * p)]
            t, y = np.array(ts, np.int64), np.array(ys, np.int64)
            k = np.searchsorted(p, y)  # so many shares lie below the other's floor
            over, much = below[-1] - below[k], weight[-1] - weight[k]
            x = (y * below[k] - weight[k]) + (much - y * over) - below[-1] * np.abs(z - y) + np.where(t > s, terms, 0) * np.abs(z - y)
            t, x = t[t != s], x[t != s]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t), pa.string()), pa.array(np.minimum(t, s).astype(np.int32)), pa.array(np.maximum(t, s).astype(np.int32)), pa.array(x)], names=["lang", "lo", "hi", "x"])


def _cells(vocab: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, s, c, p, z, q): each kept term in each group that has it, with the group's and the language's share."""
    each = vocab.where("term is not null").select("lang", "term", F.col("n").alias("in_lang"), F.inline("counts")).where("n > 0")
    out = each.join(groups, ["lang", "source"])
    share = lambda n, total: _share(F.col(n), F.col(total), F.col("terms"))
    return out.select("lang", "term", "s", F.col("n").alias("c"), share("n", "total").alias("p"), "z", share("in_lang", "lang_total").alias("q"))


def pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, lo, hi, value): the divergence of each two sources of a language, by their places."""
    ship(cells.sparkSession)
    schema = "lang string, lo int, hi int, x long"
    by_term = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("s", "c", "p", "z"))).alias("vector"))
    vectors = by_term.where(F.size("vector") > 1).groupBy("lang", "vector").agg(F.count("*").alias("times"))
    block = lambda x: F.floor(x["s"] / BLOCK).cast("int")
    of = lambda k: F.transform(F.filter("vector", lambda x: block(x) == F.col(k)), lambda x: F.struct(x["s"].alias("s"), x["p"].alias("p"), x["z"].alias("z")))
    here = F.array_distinct(F.transform("vector", block))
    both = F.flatten(F.transform(here, lambda a: F.transform(F.filter(here, lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    cut = vectors.select("lang", "vector", "times", F.inline(both))
    cut = cut.select("lang", "a", "b", "times", of("a").alias("left"), F.when(F.col("a") < F.col("b"), of("b")).otherwise(F.slice(of("a"), 1, 0)).alias("right"))
    dealt = cut.repartition("lang", "a", "b", F.pmod(F.xxhash64("left", "right"), F.lit(SALTS))).sortWithinPartitions("lang", "a", "b")
    apart = dealt.mapInArrow(_apart(BLOCK), schema)

    # How many terms of a group have which share, so that a group is as large as its distinct counts.
    hist = cells.groupBy("lang", "s", "p").agg(F.count("*").alias("h")).groupBy("lang", "s").agg(F.sort_array(F.collect_list(F.struct("p", "h"))).alias("hist"))
    floors = groups.groupBy("lang", F.floor(F.col("s") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("s", "z"))).alias("others"))
    floors = broadcast_if_small(floors, BROADCAST_GROUPS // BLOCK).drop("block")
    mine = groups.select("lang", "s", "z", "terms").join(hist, ["lang", "s"], "left").join(floors, "lang")
    field = lambda c, k: F.transform(c, lambda x: x[k])
    alone = mine.select("lang", "s", "z", "terms", field("hist", "p").alias("p"), field("hist", "h").alias("h"), field("others", "s").alias("t"), field("others", "z").alias("y")).mapInArrow(_alone, schema)
    return apart.unionByName(alone).groupBy("lang", "lo", "hi").agg(F.sum("x").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by divergence (``pair``), and each source's most overused terms (``term``)."""
    vocab = vocabulary(docs, lang, source, text, min_docs)
    groups = groups_of(vocab)
    near = broadcast_if_small(groups, BROADCAST_GROUPS)
    cells = materialize(_cells(vocab, near), "divergence-cells")
    apart = materialize(pairs(cells, groups), "divergence-pairs")
    ways = F.inline(F.array(F.struct(F.col("lo").alias("s"), F.col("hi").alias("o")), F.struct(F.col("hi").alias("s"), F.col("lo").alias("o"))))
    of_source = Window.partitionBy("lang", "s")
    # Places are in the order of the sources' names, so ties end on them.
    ranked = apart.select("lang", "value", ways).withColumn("rank", F.row_number().over(of_source.orderBy(F.desc("value"), "o")))
    named = near.select("lang", "s", "source")
    others = named.select("lang", F.col("s").alias("o"), F.col("source").alias("item"))
    pair = ranked.join(named, ["lang", "s"]).join(others, ["lang", "o"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    over = cells.where("p > q").select("lang", "s", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = over.withColumn("rank", F.row_number().over(of_source.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks)
    return pair.unionByName(top.join(named, ["lang", "s"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
