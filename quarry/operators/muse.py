"""Mid-band recall: neighbours of a seed chunk that are related but no near-copies, spread over the band."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import excerpt
from quarry.functions.vector import dot
from quarry.functions.words import plain_words
from quarry.operators.nearest import nearest
from quarry.operators.search import distinct_chunks, keyword_leg, phrases, source_of
from quarry.session import ship
from quarry.storage import broadcast_if_small, materialize, ranged, running_total

SAMPLE = 400
SKIP_MULT, WINDOW_MULT, WINDOW_SHARE = 3, 4, 0.05
NO_FLOOR = -2.0
# The flags of a degraded answer.
TINY, FLOOR, SKIP, SAME_SOURCE, NO_BIAS, THIN, NO_ESTIMATE, REPEAT = 1, 2, 4, 8, 16, 32, 64, 128
MASK = (1 << 64) - 1


class Random:
    """SplitMix64 seeding of xorshift64*; draws are remainders.

    Fixed values: the shifts and multipliers are those of the published generators.
    """

    def __init__(self, seed: int):
        z = (seed + 0x9E3779B97F4A7C15) & MASK
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        z ^= z >> 31
        self.state = z or 0x9E3779B97F4A7C15

    def below(self, n: int) -> int:
        if n <= 1:
            return 0
        x = self.state
        x ^= x >> 12
        x = (x ^ (x << 25)) & MASK
        x ^= x >> 27
        self.state = x
        return (x * 2685821657736338717 & MASK) % n


class NoCorpus(ValueError):
    """Nothing to muse over, or no such model or seed."""


def choose_model(chunks: DataFrame, wanted: str | None = None, own: str | None = None) -> tuple[str, int]:
    """The epoch to use and its embedded rows: the wanted one or an error, else the embedder's, else the most populated."""
    embedded = chunks.where("embedding is not null")
    for name in filter(None, (wanted, own)):
        n = embedded.where(F.col("model_id") == name).count()
        if n:
            return name, n
        if name == wanted:
            raise NoCorpus(f"no embedded chunks under {name}")
    row = embedded.groupBy("model_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model_id").first()
    if row is None:
        raise NoCorpus("no embedded chunks")
    return row[0], row[1]


def numbered(chunks: DataFrame, model_id: str) -> DataFrame:
    """The epoch's embedded chunks with ``row`` from 0 by (content_hash, chunk_ix).

    Numbers come from range partitions and their counts.
    """
    own = chunks.where((F.col("model_id") == model_id) & F.col("embedding").isNotNull()).drop("model_id")
    keys = ["content_hash", "chunk_ix"]
    return running_total(ranged(own, keys, "muse-order"), {"row": F.lit(1).cast("long")}, keys).drop("_pid")


def stride_sample(rows: DataFrame, n: int, want: int = SAMPLE) -> DataFrame:
    """Every ``ceil(n / want)``-th row, ``want`` at most; a function of the corpus alone."""
    want = min(n, want)
    stride = -(-n // want) if want else 1
    return rows.where((F.col("row") % stride == 0) & (F.col("row") < stride * want))


def upper_median(vectors: np.ndarray) -> float:
    """Element n // 2 of the sorted pairwise products, as single-precision numbers; NO_FLOOR below two vectors."""
    if len(vectors) < 2:
        return NO_FLOOR
    v = vectors.astype(np.float64)
    i, j = np.triu_indices(len(v), 1)
    s = np.sort((v @ v.T)[i, j].astype(np.float32))
    return float(s[len(s) // 2])


def floor_of(rows: DataFrame, n: int) -> float:
    """The corpus' median cosine over the stride sample, which is bounded by ``SAMPLE`` vectors."""
    got = [r[0] for r in stride_sample(rows, n).orderBy("row").select("embedding").collect()]
    return upper_median(np.array(got, dtype=np.float32)) if got else NO_FLOOR


def band_size(n: int, k: int) -> tuple[int, int]:
    """How many nearest neighbours to skip, and the window after them."""
    skip, window = SKIP_MULT * k, max(WINDOW_MULT * k, int(WINDOW_SHARE * n + 0.999))
    if skip + window > n - 1:
        skip = (n - 1) // 3
        window = max(1, n - 1 - skip)
    return skip, window


def neighbours(rows: DataFrame, seed_hash: str, seed_ix: int, most: int) -> DataFrame:
    """(content_hash, chunk_ix, cos, rank) of the seed's ``most`` nearest others, with their partition as ``_pid``.

    Ranks come from range partitions of the cosines and their counts, so no
    task holds more than one of these.
    """
    here = (F.col("content_hash") == seed_hash) & (F.col("chunk_ix") == seed_ix)
    seed = rows.where(here).select(F.col("embedding").alias("seed"))
    near = rows.where(~here).crossJoin(F.broadcast(seed)).select("content_hash", "chunk_ix", dot(F.col("embedding"), F.col("seed")).alias("cos"))
    order = [F.desc("cos"), F.col("content_hash"), F.col("chunk_ix")]
    placed = running_total(ranged(near, order, "muse-near"), {"_before": F.lit(1).cast("long")}, order)
    return placed.withColumn("rank", (F.col("_before") + 1).cast("int")).where(F.col("rank") <= most).drop("_before")


def in_order(near: DataFrame, which: Column | None = None) -> DataFrame:
    """The rows of written :func:`neighbours` that ``which`` keeps, with their place ``i`` from 0, written."""
    some = near if which is None else near.where(which)
    return materialize(running_total(some, {"i": F.lit(1).cast("long")}, ["rank"]), "muse-band")


def oldest(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Chunks with a known age, by (earliest mtime, content_hash, chunk_ix)."""
    age = source.where("mtime > 0").groupBy("content_hash").agg(F.min("mtime").alias("age"))
    return rows.join(age, "content_hash")


def by_age(aged: DataFrame) -> DataFrame:
    """:func:`oldest` with each chunk's place ``row`` from 0, the oldest first."""
    order = ["age", "content_hash", "chunk_ix"]
    return running_total(ranged(aged.select("age", "content_hash", "chunk_ix"), order, "muse-age"), {"row": F.lit(1).cast("long")}, order).drop("_pid")


def oldest_tertile(aged: DataFrame) -> DataFrame:
    """The oldest third of the chunks with a known age."""
    placed = materialize(by_age(aged), "muse-ages")
    return placed.where(F.col("row") < placed.count() // 3)


def strata(n: int, k: int) -> list[tuple[int, int]]:
    return [(s * n // k, (s + 1) * n // k) for s in range(k)]


@dataclass
class Info:
    """What happened on the way."""

    model_id: str = ""
    n_corpus: int = 0
    seed: tuple[str, int] | None = None
    floor: float = NO_FLOOR
    skip: int = 0
    window: int = 0
    n_band: int = 0
    band_docs: int = 0
    result_docs: int = 0
    age_usable: int = 0
    age_distinct: int = 0
    degraded: int = 0
    results: list[dict] = field(default_factory=list)


def chosen_band(near: DataFrame, k: int, info: Info, seed_hash: str, same_source: bool) -> DataFrame:
    """The band of written :func:`neighbours`, or what it is relaxed to, in order; ``info`` tells how."""
    after, related, other = F.col("rank") > info.skip, F.col("cos") >= info.floor, F.col("content_hash") != seed_hash
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    n_strict, n_loose, n_after, n_all = near.agg(count(after & related & other), count(after & related), count(after), F.count("*")).first()
    which, n = (after & related, n_loose) if same_source or n_strict < k else (after & related & other, n_strict)
    if n < k and n_after > n:
        which, n = after, n_after
        info.degraded |= FLOOR
        info.floor = NO_FLOOR
    if not n and n_all:
        which, n = None, n_all
        info.degraded |= SKIP
        info.skip = 0
    if n < k:
        info.degraded |= THIN
    band = in_order(near, which)
    info.n_band, info.band_docs = n, band.agg(F.count_distinct("content_hash")).first()[0]
    return band


def pick(band: DataFrame, k: int, info: Info, rng: Random, seed_hash: str, same_source: bool) -> None:
    """One chunk of each stratum: the first from a drawn place on whose document has none yet.

    Of a stratum at most ``k`` documents, each with its nearest chunk to the
    drawn place, reach the driver; fewer than that are in use.
    """
    bounds = [(lo, hi) for lo, hi in strata(info.n_band, k) if hi > lo]
    if not bounds:
        return
    draws = [rng.below(hi - lo) for lo, hi in bounds]
    lo, size, at = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in zip(*[(a, b - a, d) for (a, b), d in zip(bounds, draws, strict=True)], strict=True))
    stratum = sum((F.when(F.col("i") >= a, 1).otherwise(0) for a, _ in bounds[1:]), F.lit(1))
    of = lambda xs: F.element_at(xs, F.col("s"))
    placed = band.withColumn("s", stratum).withColumn("far", F.pmod(F.col("i") - of(lo) - of(at), of(size)))
    docs = placed.groupBy("s", "content_hash").agg(F.min(F.struct("far", "chunk_ix", "cos", "rank")).alias("best"))
    first = docs.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("best.far"))).where(F.col("n") <= k)
    turns: dict[int, list] = {}
    for r in first.select("s", "content_hash", "best.*").orderBy("s", "far").collect():
        turns.setdefault(r["s"], []).append(r)
    used: set[str] = set()
    for _, turn in sorted(turns.items()):
        got = next((r for r in turn if r["content_hash"] not in used), None)
        if got is None:
            got = turn[0]
            info.degraded |= REPEAT
        used.add(got["content_hash"])
        info.results.append({c: got[c] for c in ("content_hash", "chunk_ix", "cos", "rank")})
    info.result_docs = len(used)
    if not same_source and seed_hash in used:
        info.degraded |= SAME_SOURCE


def muse(chunks: DataFrame, source: DataFrame, k: int = 5, seed: int = 1, at: tuple[str, int] | None = None, old: bool = False, same_source: bool = False, model_id: str | None = None, own_model: str | None = None, chars: int = 240) -> Info:
    """``k`` chunks across the band of the seed; ``seed`` makes the run repeatable.

    The band is a twentieth of the corpus and stays distributed; the driver gets
    the seed, the bounded sample of the floor and at most k * k candidates.
    """
    k, chars = (5 if k <= 0 else min(k, 32)), max(1, min(chars, 1000))
    info = Info()
    info.model_id, info.n_corpus = choose_model(chunks, model_id, own_model)
    n = info.n_corpus
    if n < 2:
        info.degraded |= TINY
        return info
    rng = Random(seed)
    rows = numbered(chunks, info.model_id)
    if at is not None:
        found = rows.where((F.col("content_hash") == at[0]) & (F.col("chunk_ix") == max(at[1], 0))).select("content_hash", "chunk_ix").first()
        if found is None:
            raise NoCorpus(f"no embedded chunk {at[0]}#{at[1]}")
    else:
        found = None
        if old:
            aged = oldest(rows, source)
            info.age_usable, info.age_distinct = aged.agg(F.count("*"), F.countDistinct("age")).first()
            if info.age_usable < 3 or info.age_distinct < 3:
                info.degraded |= NO_BIAS
            else:
                place = rng.below(max(1, info.age_usable // 3))
                found = by_age(aged).where(F.col("row") == place).select("content_hash", "chunk_ix").first()
        if found is None:
            found = rows.where(F.col("row") == rng.below(n)).select("content_hash", "chunk_ix").first()
    info.seed = (found[0], found[1])
    info.floor = floor_of(rows, n)
    if info.floor == NO_FLOOR:
        info.degraded |= NO_ESTIMATE
    info.skip, info.window = band_size(n, k)
    if info.skip < SKIP_MULT * k:
        info.degraded |= TINY
    near = materialize(neighbours(rows, *info.seed, info.skip + info.window), "muse-ranked")
    pick(chosen_band(near, k, info, info.seed[0], same_source), k, info, rng, info.seed[0], same_source)
    spark = chunks.sparkSession
    if info.results:
        ids = spark.createDataFrame([(r["content_hash"], r["chunk_ix"]) for r in info.results], "content_hash string, chunk_ix int")
        texts = rows.join(F.broadcast(ids), ["content_hash", "chunk_ix"]).join(source_of(source), "content_hash", "left")
        dress = {(r[0], r[1]): (r[2], r[3]) for r in texts.select("content_hash", "chunk_ix", excerpt(F.col("chunk_text"), chars), "path").collect()}
        for r in info.results:
            r["excerpt"], r["source"] = dress[r["content_hash"], r["chunk_ix"]]
    return info


def band(rows: DataFrame, seed_hash: str, seed_ix: int, n: int, k: int, floor: float) -> DataFrame:
    """The strict band as a DataFrame with stratum numbers, before any draw."""
    skip, window = band_size(n, k)
    near = materialize(neighbours(rows, seed_hash, seed_ix, skip + window), "muse-ranked")
    placed = in_order(near, (F.col("rank") > skip) & (F.col("cos") >= floor) & (F.col("content_hash") != seed_hash))
    # The stratum whose bounds s * n // k and (s + 1) * n // k hold the place.
    stratum = F.floor(((F.col("i") + 1) * k - 1) / placed.count()).cast("int")
    return placed.withColumn("stratum", stratum).drop("i", "_pid")


# Musing on a text


#: A text of fewer characters is one probe; of a longer one come as many paragraphs at most.
SHORT, PROBES = 400, 8
#: Candidates of each probe, and how much words shared with the probe and likeness to what is chosen count against one.
PER_PROBE, SHARED_WORDS, LIKENESS = 40, 0.3, 0.5
#: Candidates are broadcast up to this many rows (about 100 bytes each), else joined by a shuffle.
BROADCAST_CANDIDATES = 200_000
#: Rarest words that a probe without a vector is sought by.
RAREST = 5


def probes_of(text: str, short: int = SHORT, most: int = PROBES) -> list[str]:
    """A working text as probes: itself if short, else its first paragraphs."""
    if len(text) < short:
        return [text.strip()] if text.strip() else []
    return [p.strip() for p in re.split(r"\n[\x20\t]*\n", text) if p.strip()][:most]


def with_neighbours(found: DataFrame, keep: list[str]) -> DataFrame:
    """The found chunks (``keep``, content_hash, chunk_ix) and those before and after them, each once."""
    beside = F.explode(F.array(F.col("chunk_ix") - 1, F.col("chunk_ix"), F.col("chunk_ix") + 1))
    return found.select(*keep, "content_hash", beside.alias("chunk_ix")).where("chunk_ix >= 0").distinct()


def _greedy(k: int, likeness: float):
    """``k`` rows of a context, one for each source: the most relevant less its likeness to what is chosen already."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["content_hash", "chunk_ix"]).reset_index(drop=True)
        v = np.array(rows["embedding"].tolist(), dtype=np.float64)
        rel, like = rows["rel"].to_numpy(), np.full(len(rows), -np.inf)
        source, free = rows["source"].to_numpy(), np.ones(len(rows), bool)
        out = []
        while len(out) < k and free.any():
            score = np.where(np.isneginf(like), rel, rel - likeness * like)
            i = int(np.argmax(np.where(free, np.round(score, 9), -np.inf)))  # the first of equals, which is the first key
            out.append((i, score[i]))
            free &= source != source[i]
            like = np.maximum(like, v @ v[i])
        chosen = rows.iloc[[i for i, _ in out]]
        return pd.DataFrame({"ctx": chosen["ctx"].to_numpy(), "rank": np.arange(1, len(out) + 1, dtype=np.int32), "content_hash": chosen["content_hash"].to_numpy(), "chunk_ix": chosen["chunk_ix"].to_numpy(), "source": chosen["source"].to_numpy(), "rel": chosen["rel"].to_numpy(), "score": [s for _, s in out]})

    return run


def context(chunks: DataFrame, source: DataFrame, probes: DataFrame, model_id: str, k: int = 5, per_probe: int = PER_PROBE, shared_words: float = SHARED_WORDS, likeness: float = LIKENESS) -> DataFrame:
    """(ctx, rank, content_hash, chunk_ix, source, rel, score): what a working text brings to mind, unlike itself and each other.

    ``probes`` is (ctx, probe, text, vec), any number of contexts at once; vec
    null is no probe. One scan finds the ``per_probe`` nearest chunks of each
    probe; their neighbours in the same document join them. A candidate's
    relevance is its best cosine less ``shared_words`` for the part of the
    probe's words that it holds, as plain retrieval finds those anyway. Then
    each context picks ``k``, one for each source: at each step the one whose
    relevance, less ``likeness`` times its greatest cosine with those picked, is
    highest, ties by (content_hash, chunk_ix).

    Candidates of a context number at most 3 * ``per_probe`` for each probe.
    """
    ship(chunks.sparkSession)
    probes = materialize(probes.where("vec is not null").withColumn("_id", F.monotonically_increasing_id()), "muse-probes")
    own = distinct_chunks(chunks.where((F.col("model_id") == model_id) & F.col("embedding").isNotNull()))
    hits = nearest(own, probes.select(F.col("_id").alias("qid"), "vec"), ["content_hash", "chunk_ix"], "embedding", per_probe)
    near = materialize(with_neighbours(hits.withColumnRenamed("qid", "_id"), ["_id"]), "muse-near")
    asked = probes.select("_id", "ctx", "vec", F.array_distinct(plain_words(F.col("text"))).alias("_asked"))
    pairs = own.join(broadcast_if_small(near, BROADCAST_CANDIDATES), ["content_hash", "chunk_ix"]).join(broadcast_if_small(asked, BROADCAST_CANDIDATES // 10), "_id")
    held = F.size(F.array_intersect("_asked", plain_words(F.col("chunk_text")))) / F.greatest(F.size("_asked"), F.lit(1))
    rel = dot(F.col("embedding"), F.col("vec")) - shared_words * held
    best = pairs.groupBy("ctx", "content_hash", "chunk_ix").agg(F.max(rel).alias("rel"), F.first("embedding").alias("embedding"))
    named = best.join(source_of(source).select("content_hash", "path"), "content_hash", "left").withColumn("source", F.coalesce("path", "content_hash")).drop("path")
    ctx = probes.schema["ctx"].dataType.simpleString()
    return named.groupBy("ctx").applyInPandas(_greedy(k, likeness), f"ctx {ctx}, rank int, content_hash string, chunk_ix int, source string, rel double, score double")


def context_by_words(chunks: DataFrame, source: DataFrame, index: DataFrame, stats: DataFrame, probes: dict[str, str], k: int = 5, rarest: int = RAREST) -> DataFrame:
    """:func:`context` without a model: (ctx, rank, content_hash, chunk_ix, source) by the probe's rarest words, one for each source.

    ``probes`` maps a context to its text. A neighbour stands right after the
    chunk that it joins.
    """
    spark = chunks.sparkSession
    words = {c: sorted({t for p in phrases(text) for t in p}) for c, text in probes.items()}
    every = sorted({w for ws in words.values() for w in ws})
    df = dict(map(tuple, index.where(F.col("term").isin(every)).groupBy("term").agg(F.count("*")).collect()))  # a number for each word of the probes
    asked = {c: " ".join(sorted((w for w in ws if w in df), key=lambda w: (df[w], w))[:rarest]) for c, ws in words.items()}
    hits = keyword_leg(index, stats, {c: q for c, q in asked.items() if q}, 4 * k).select(F.col("qid").alias("ctx"), "content_hash", "chunk_ix", "leg_rank")
    beside = F.explode(F.array(*[F.struct((F.col("chunk_ix") + d).alias("chunk_ix"), F.lit(abs(d)).alias("away")) for d in (0, -1, 1)]))
    there = distinct_chunks(chunks).select("content_hash", "chunk_ix")
    near = hits.select("ctx", "content_hash", "leg_rank", beside.alias("b")).select("ctx", "content_hash", "b.chunk_ix", "leg_rank", "b.away").join(there, ["content_hash", "chunk_ix"], "left_semi")
    named = near.join(source_of(source).select("content_hash", "path"), "content_hash", "left").withColumn("source", F.coalesce("path", "content_hash"))
    order = ["leg_rank", "away", "content_hash", "chunk_ix"]
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("ctx", "source").orderBy(*order))).where("_n = 1")
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("ctx").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("ctx", "rank", "content_hash", "chunk_ix", "source") if words else spark.createDataFrame([], "ctx string, rank int, content_hash string, chunk_ix int, source string")
