"""Hybrid top-k retrieval: keyword, literal and vector legs fused by reciprocal rank.

All legs take a batch of queries and scan the chunks once; the query side, a
few rows, is what gets broadcast.  A leg is a DataFrame (qid, content_hash,
chunk_ix, leg, leg_rank, cos).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import ascii_lower, is_cut, prefix, trim_excerpt
from quarry.functions.words import plain_words, plain_words_py, porter_words, snippet
from quarry.operators.nearest import nearest
from quarry.session import ship
from quarry.storage import broadcast_if_small, distinct_by, let, materialize, ranged, running_total

POOL, PER_HIT, RRF_K, EXCERPT = 40, 4, 60.0, 140
FTS, VEC, LIT = 1, 2, 4
HEAD, TAIL, CUT = 1, 2, 4
#: Legs enter the shared pool in this order.
LEG_ORDER = {FTS: 0, LIT: 1, VEC: 2}
K1, B = 1.2, 0.75
LITERAL_TERMS = 8

#: Literal terms that are looked for by one expression; more by a join over their first ``GRAM`` characters.
TERMS_AT_ONCE, GRAM = 32, 3
#: Contents and words that are looked up by a filter; more by a join.
PUSHED = 1000
#: Places of missed terms, and words that hold a term, are broadcast up to this many rows (about 60 bytes each), else joined by a shuffle.
BROADCAST_PLACES = 500_000

# Words whose presence orders nothing.
STOP_WORDS = (
    "the and for that with this from are was not but its one all any can will has have had then than when what where who how some more most "
    "other into out over under about only same such each per see use used using been being does did here there their would could should must "
    "may might you your they them doing why which while also just like very much cost costs get gets"
).split()


def pool_size(k: int) -> int:
    return max(1, min(PER_HIT * k, POOL))


# Literal terms


def _trim(token: str) -> str:
    return token.strip("\"'`(),;:[]{}<>*!?").rstrip(".")


def is_hard(token: str) -> bool:
    """Carries identity: a digit, one of ``_-/.:`` or two capitals, and some letter or digit."""
    if len(token.encode()) < 2 or not re.search("[A-Za-z0-9]", token):
        return False
    return bool(re.search(r"[0-9_\-/.:]", token)) or len(re.findall("[A-Z]", token)) >= 2


def literal_terms(query: str, most: int = LITERAL_TERMS) -> list[str]:
    """The query's anchors in ASCII lower case: hard tokens first, then the longest others."""
    tokens = [t for t in map(_trim, re.split(r"[\x00-\x20]+", query)) if len(t.encode()) >= 3]
    fold = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    stop = set(STOP_WORDS)
    soft = [t for t in tokens if t not in stop]  # entries are lower-case and compared as they are
    passes = [[t for t in tokens if is_hard(t)], *([t for t in soft if len(t.encode()) >= n] for n in range(12, 2, -1))]
    return list(dict.fromkeys(fold(t) for p in passes for t in p))[:most]


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each (content_hash, chunk_ix); its text is the same in all epochs."""
    return distinct_by(chunks, ["content_hash", "chunk_ix"])


def ranked(hits: DataFrame, leg: int, order: list[Column], most: int | None) -> DataFrame:
    """``hits`` with leg and leg_rank, at most ``most`` for each query.

    Without a limit the ranks come from range partitions and their counts, so a
    query that matches everything is spread over many tasks.
    """
    if most is None:
        line = ["qid", *order, "content_hash", "chunk_ix"]
        placed = running_total(ranged(hits, line, "ranked"), {"_before": F.lit(1).cast("long")}, line, within=["qid"])
        out = placed.withColumn("leg_rank", (F.col("_before") + 1).cast("int"))
    else:
        w = Window.partitionBy("qid").orderBy(*order, "content_hash", "chunk_ix")
        out = hits.withColumn("leg_rank", F.row_number().over(w)).where(F.col("leg_rank") <= most)
    return out.select("qid", "content_hash", "chunk_ix", F.lit(leg).alias("leg"), "leg_rank", "cos")


def term_weights(chunks: DataFrame, terms: list[str]) -> list[float]:
    """1/df of each term, 0 for those in no row or in all; one scan for all terms."""
    if not terms:
        return []
    low = ascii_lower(F.col("chunk_text"))
    row = chunks.agg(F.count("*"), *[F.sum(F.contains(low, F.lit(t)).cast("long")) for t in terms]).first()
    return [1.0 / df if df and df < row[0] else 0.0 for df in row[1:]]


def literal_leg(chunks: DataFrame, queries: dict[str, str], most: int | None = POOL) -> DataFrame:
    """Chunks by the rarity-weighted sum of the literal terms that they hold.

    Every row, of every epoch, counts for rarity; chunks are ranked once.
    """
    spark = chunks.sparkSession
    terms = {q: literal_terms(text) for q, text in queries.items()}
    every = sorted({t for ts in terms.values() for t in ts})
    if len(every) > TERMS_AT_ONCE:
        return _literal_leg_of_many(chunks, terms, every, most)
    # The texts are read once; what a chunk holds is a flag for each term.
    low = chunks.select("content_hash", "chunk_ix", ascii_lower(F.col("chunk_text")).alias("_low"))
    flags = materialize(low.select("content_hash", "chunk_ix", *[F.contains("_low", F.lit(t)).alias(f"_t{i}") for i, t in enumerate(every)]), "literal-flags")
    row = flags.agg(F.count("*"), *[F.sum(F.col(f"_t{i}").cast("long")) for i in range(len(every))]).first()
    held = {t: F.when(F.col(f"_t{i}"), F.lit(1.0 / df)).otherwise(F.lit(0.0)) for i, (t, df) in enumerate(zip(every, row[1:], strict=True)) if df and df < row[0]}
    scores = [F.struct(F.lit(q).alias("qid"), sum((held[t] for t in ts if t in held), F.lit(0.0)).alias("score")) for q, ts in terms.items()]
    if not scores:
        return spark.createDataFrame([], "qid string, content_hash string, chunk_ix int, leg int, leg_rank int, cos double")
    hits = distinct_chunks(flags).select("content_hash", "chunk_ix", F.inline(F.filter(F.array(*scores), lambda s: s["score"] > 0)))
    return ranked(hits.withColumn("cos", F.lit(None).cast("double")), LIT, [F.desc("score")], most)


def _literal_leg_of_many(chunks: DataFrame, terms: dict[str, list[str]], every: list[str], most: int | None) -> DataFrame:
    """:func:`literal_leg` of many queries, scored where the chunks lie.

    A written row holds the numbers of a chunk's terms; what a query makes of
    them is summed from that row, so no pair of a chunk and a term, a word or a
    query is shuffled or written.
    """
    spark = chunks.sparkSession
    ship(spark)
    held = chunks.select("content_hash", "chunk_ix", "chunk_text").mapInArrow(_holder(every), "content_hash string, chunk_ix int, terms array<int>")
    held = materialize(held, "literal-held", compression="zstd")
    n = held.count()
    df = dict(map(tuple, held.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))  # of the batch's terms
    weight = [1.0 / df[i] if 0 < df.get(i, 0) < n else 0.0 for i in range(len(every))]
    number = {t: i for i, t in enumerate(every)}
    pairs = [(number[t], q, 1) for q, ts in enumerate(terms.values()) for t in ts]
    summed = distinct_chunks(held.where(F.size("terms") > 0)).mapInArrow(_weigher(pairs, weight, len(terms)), SUMS)
    return ranked(each_query(summed, list(terms)).withColumn("cos", F.lit(None).cast("double")), LIT, [F.desc("score")], most)


def _holder(terms: list[str]):
    """Batches of chunks to batches of the numbers of the terms that each holds.

    Terms are of three bytes at least. Where the first three bytes of one, or
    six of a longer one, stand in the folded texts, the rest is compared.
    """
    raw = [t.encode() for t in terms]
    size, width = np.array([len(t) for t in raw]), max(map(len, raw))
    table = np.array([list(t.ljust(width, b"\0")) for t in raw], np.uint8)
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    flag = lambda code: (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    leads = []
    for n, own in ((3, np.flatnonzero(size < 6)), (6, np.flatnonzero(size >= 6))):
        lead = np.array([int.from_bytes(raw[i][:n], "little") for i in own], np.uint64)
        order = np.argsort(lead, kind="stable")
        codes, begin, count = np.unique(lead[order], return_index=True, return_counts=True)
        flags = np.zeros(1 << 20, bool)
        flags[flag(codes)] = True
        if len(own):
            leads.append((n, own[order], codes, begin, count, flags))
    window = 1 << 18

    def starts(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of terms that begin in the first ``window`` bytes, with the terms."""
        wide = text.astype(np.uint64)
        three = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)
        for n, own, codes, begin, count, flags in leads:
            code = (three if n == 3 else three[:-3] | three[3:] << np.uint64(24))[:window]
            place = np.flatnonzero(flags[flag(code)])
            lead = np.minimum(np.searchsorted(codes, code[place]), len(codes) - 1)
            same = codes[lead] == code[place]
            place, lead = place[same], lead[same]
            each = np.repeat(np.arange(len(place)), count[lead])  # a place, once for each term with that lead
            term = own[begin[lead][each] + np.arange(len(each)) - np.repeat(np.cumsum(count[lead]) - count[lead], count[lead])]
            place = place[each]
            inside = place + size[term] <= len(text)
            place, term = place[inside], term[inside]
            for k in range(n, width):
                same = size[term] <= k
                if same.all():
                    break
                same[~same] = text[place[~same] + k] == table[term[~same], k]
                place, term = place[same], term[same]
            yield place, term

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column("chunk_text"), "").cast(pa.binary())
            at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            keys = [np.zeros(0, np.int64)]
            for w in range(at[0], at[-1], window):
                text = fold[data[w : min(w + window + width, at[-1])]]
                for place, term in starts(text) if len(text) >= 6 else starts(np.append(text, np.zeros(6, np.uint8))):
                    row = np.searchsorted(at, place + w, "right") - 1
                    whole = place + w + size[term] <= at[row + 1]
                    keys.append(np.unique(row[whole] * len(raw) + term[whole]))
            key = np.unique(np.concatenate(keys))
            ends = pa.array(np.searchsorted(key, np.arange(len(texts) + 1) * len(raw)), pa.int32())
            held = pa.ListArray.from_arrays(ends, pa.array(key % len(raw), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("content_hash"), b.column("chunk_ix"), held], ["content_hash", "chunk_ix", "terms"])

    return run


#: What :func:`query_sums` makes of a chunk: the numbers of its queries and their scores.
SUMS = "content_hash string, chunk_ix int, qids array<int>, scores array<double>"


def query_sums(pairs: list[tuple[int, int, int]], n_items: int, n_queries: int):
    """A function of (rows, row, item, value), arrays of what each row holds, to lists of each row's queries and their sums above 0.

    ``pairs`` are (item, query, times).
    """
    of, query, times = np.array(sorted(pairs), dtype=np.int64).T
    begin = np.searchsorted(of, np.arange(n_items))
    size = np.searchsorted(of, np.arange(n_items), side="right") - begin

    def run(rows: int, row: np.ndarray, item: np.ndarray, value: np.ndarray) -> list[pa.Array]:
        each = np.repeat(np.arange(len(item)), size[item])  # an item of a row, once for each query that asks it
        at = begin[item][each] + np.arange(len(each)) - np.repeat(np.cumsum(size[item]) - size[item], size[item])
        sums = np.bincount(row[each] * n_queries + query[at], value[each] * times[at], rows * n_queries)
        met = np.flatnonzero(sums)
        ends = pa.array(np.searchsorted(met, np.arange(rows + 1) * n_queries), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((met % n_queries, pa.int32()), (sums[met], pa.float64()))]

    return run


def rows_at_once(n_queries: int) -> int:
    """How many chunks :func:`query_sums` is given, so that its table of sums stays small."""
    return max(1, 200_000 // n_queries)


def _weigher(pairs: list[tuple[int, int, int]], weight: list[float], n_queries: int):
    """Batches of :func:`_holder` to batches of ``SUMS``."""
    sums, each, step = query_sums(pairs, len(weight), n_queries), np.array(weight), rows_at_once(n_queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, step):
                b = big.slice(k, step)
                term = b.column("terms").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column("content_hash"), b.column("chunk_ix"), *sums(b.num_rows, row, term, each[term])], ["content_hash", "chunk_ix", "qids", "scores"])

    return run


def each_query(summed: DataFrame, names: list[str]) -> DataFrame:
    """(qid, content_hash, chunk_ix, score) of ``SUMS``; rounded, so that sums in another order are alike."""
    each = summed.select("content_hash", "chunk_ix", F.inline(F.arrays_zip(F.col("qids").alias("_q"), F.col("scores").alias("score"))))
    return each.join(F.broadcast(summed.sparkSession.createDataFrame(list(enumerate(names)), "_q int, qid string")), "_q").select("qid", "content_hash", "chunk_ix", F.round("score", 9).alias("score"))


def raw_words(chunks: DataFrame) -> DataFrame:
    """(word, content_hash, chunk_ix): each chunk's distinct blank-separated words, folded.

    A literal term holds no blank, so a chunk holds it exactly if one of these does.
    """
    words = F.array_distinct(F.split(ascii_lower(F.col("chunk_text")), r"[\x00-\x20]+", -1))
    return distinct_chunks(chunks).select(F.explode(words).alias("word"), "content_hash", "chunk_ix").where("word <> ''")


def _grams(word: Column, n: int) -> Column:
    """All runs of ``n`` characters."""
    runs = F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substr(word, i, F.lit(n)))
    return F.when(F.length(word) >= n, runs).otherwise(F.array().cast("array<string>"))


def word_grams(words: DataFrame) -> DataFrame:
    """(gram, word): the runs of ``GRAM`` characters of the distinct words; shorter words have themselves."""
    each = words.select("word").distinct()
    own = F.when(F.length("word") >= GRAM, F.array_distinct(_grams(F.col("word"), GRAM))).otherwise(F.array("word"))
    return each.select(F.explode(own).alias("gram"), "word")


def words_holding(grams: DataFrame, terms: list[str]) -> DataFrame:
    """(term, word): the words of :func:`word_grams` that hold each term.

    The words that have a term's rarest gram are looked at; a term below
    ``GRAM`` characters has none, so words are then found by grams that begin or
    end with it, or are it.
    """
    spark = grams.sparkSession
    long = {t: sorted({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}) for t in terms if len(t) >= GRAM}
    short = [t for t in terms if t and len(t) < GRAM]
    found = spark.createDataFrame([], "term string, word string")
    if long:
        of_gram = lambda gs: grams.where(F.col("gram").isin(gs)) if len(gs) <= PUSHED else grams.join(F.broadcast(spark.createDataFrame([(g,) for g in gs], "gram string")), "gram", "left_semi")
        n = dict(map(tuple, of_gram(sorted({g for gs in long.values() for g in gs})).groupBy("gram").count().collect()))  # of the batch's terms
        lead = {t: min(gs, key=lambda g: (n.get(g, 0), g)) for t, gs in long.items()}
        lead = {t: g for t, g in lead.items() if g in n}
        if lead:
            asked = F.broadcast(spark.createDataFrame([(g, t) for t, g in lead.items()], "gram string, term string"))
            met = of_gram(sorted(set(lead.values()))).join(asked, "gram").where(F.contains("word", "term"))
            found = found.unionByName(met.select("term", "word").distinct())
    if short:
        has = grams.where(reduce(Column.__or__, [F.contains("gram", F.lit(t)) for t in short]))
        of = F.explode(F.filter(F.array(*map(F.lit, short)), lambda t: F.contains("gram", t)))
        found = found.unionByName(has.select(of.alias("term"), "word").distinct())
    return found


def literal_leg_stored(words: DataFrame, chunks: DataFrame, queries: dict[str, str], most: int | None = POOL, grams: DataFrame | None = None) -> DataFrame:
    """:func:`literal_leg` over the stored :func:`raw_words`; of ``chunks`` only the keys are read.

    Given the stored ``grams`` of the words, only the words that hold a term
    are read, by a filter that skips row groups if they are few.
    """
    spark = words.sparkSession
    asked = [(q, t) for q, text in queries.items() for t in literal_terms(text)]
    every = sorted({t for _, t in asked})
    if not every:
        return literal_leg(chunks, {}, most)
    if grams is None:
        grams = word_grams(materialize(words.select("word").distinct(), "literal-vocabulary"))
    found = materialize(words_holding(grams, every), "literal-words")
    few = [r[0] for r in found.select("word").distinct().limit(PUSHED + 1).collect()]
    some = words.where(F.col("word").isin(few)) if len(few) <= PUSHED else words
    held = some.join(broadcast_if_small(found, BROADCAST_PLACES), "word").select("content_hash", "chunk_ix", "term")
    held = materialize(held.distinct(), "literal-hits")
    # Epochs are counted of the chunks that hold a term only.
    here = held.select("content_hash").distinct()
    near = [r[0] for r in here.limit(PUSHED + 1).collect()]
    own = chunks.where(F.col("content_hash").isin(near)) if len(near) <= PUSHED else chunks
    epochs = own.groupBy("content_hash", "chunk_ix").agg(F.count("*").alias("n"))
    df = held.join(epochs, ["content_hash", "chunk_ix"]).groupBy("term").agg(F.sum("n").alias("df"))
    n = chunks.count()
    weight = df.where(F.col("df") < n).select("term", (1.0 / F.col("df")).alias("weight"))
    pairs = F.broadcast(spark.createDataFrame(asked, "qid string, term string"))
    hits = held.join(F.broadcast(weight), "term").join(pairs, "term").groupBy("qid", "content_hash", "chunk_ix").agg(F.sum("weight").alias("score"))
    return ranked(hits.withColumn("cos", F.lit(None).cast("double")), LIT, [F.desc(F.round("score", 9))], most)


# Keyword leg


def postings(chunks: DataFrame, tokens: Callable[[Column], Column] = plain_words, only: list[str] | None = None) -> DataFrame:
    """(term, content_hash, chunk_ix, dl, positions, tf): the inverted index of the distinct chunks.

    ``only`` restricts it to some terms, so that a scan without a stored index
    makes no more than the queries need. A chunk is one row, so its places are
    sorted and cut by term within it and no token is shuffled.
    """
    ship(chunks.sparkSession)
    words = distinct_chunks(chunks).select("content_hash", "chunk_ix", tokens(F.col("chunk_text")).alias("w"))
    return words.mapInArrow(_inverted(only), "term string, content_hash string, chunk_ix int, dl int, positions array<int>, tf int")


def _inverted(only: list[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of chunks with their words to batches of postings; words are sorted as numbers of a dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if only is None else pa.array(only, pa.string())
        for big in batches:
            for k in range(0, big.num_rows, 500):
                b = big.slice(k, 500)
                size = pc.fill_null(pc.list_value_length(b.column("w")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                words = b.column("w").flatten().cast(pa.string()).dictionary_encode()
                row, code = np.repeat(np.arange(len(size)), size), words.indices.to_numpy(zero_copy_only=False)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                if wanted is not None:
                    kept = pc.is_in(words.dictionary, value_set=wanted).to_numpy(zero_copy_only=False)[code]
                    row, code, at = row[kept], code[kept], at[kept]
                key = row * len(words.dictionary) + code
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                row, code, ends = row[order][first], code[order][first], np.append(first, len(order))
                places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order], pa.int32()))
                held = b.select(["content_hash", "chunk_ix"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code)), held.column("content_hash"), held.column("chunk_ix"), pa.array(size[row], pa.int32()), places, pa.array(np.diff(ends), pa.int32())], ["term", "content_hash", "chunk_ix", "dl", "positions", "tf"])

    return run


def chunk_terms(chunks: DataFrame, tokens: Callable[[Column], Column] = plain_words) -> DataFrame:
    """(term, content_hash, chunk_ix): :func:`postings` without places, for what only counts chunks."""
    return distinct_chunks(chunks).select(F.explode(F.array_distinct(tokens(F.col("chunk_text")))).alias("term"), "content_hash", "chunk_ix")


def doc_lengths(chunks: DataFrame, tokens: Callable[[Column], Column] = plain_words) -> DataFrame:
    """(n, avgdl) over the distinct chunks, one row."""
    return distinct_chunks(chunks).select(F.size(tokens(F.col("chunk_text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def phrases(query: str, tokens: Callable[[str], list[str]] = plain_words_py) -> list[list[str]]:
    """One phrase for each blank-separated term; repeated terms repeat."""
    return [p for p in map(tokens, re.split(r"[\x00-\x20]+", query)) if p]


def keyword_leg(index: DataFrame, stats: DataFrame, queries: dict[str, str], most: int | None = POOL, tokens: Callable[[str], list[str]] = plain_words_py, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 over the OR of phrases; a term of several tokens must stand in a row.

    The inverse document frequency is at least 1e-6.
    """
    spark = index.sparkSession
    rows = [(q, n, len(p), i, t) for q, text in queries.items() for n, p in enumerate(phrases(text, tokens)) for i, t in enumerate(p)]
    asked = F.broadcast(spark.createDataFrame(rows, "qid string, phrase int, length int, offset int, term string"))
    found = materialize(index.join(asked, "term"), "keyword-hits")  # read four times below
    one = found.where("length = 1").select("qid", "phrase", "content_hash", "chunk_ix", "dl", "tf")
    starts = F.transform("positions", lambda p: p - F.col("offset"))
    many = found.where("length > 1").groupBy("qid", "phrase", "length", "content_hash", "chunk_ix", "dl").agg(F.collect_list(starts).alias("s"))
    common = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.col("s")[0], lambda a, x: F.array_intersect(a, x))
    many = many.where(F.size("s") == F.col("length")).withColumn("tf", F.size(common)).where("tf > 0")
    hits = one.unionByName(many.select(*one.columns))
    df = hits.groupBy("qid", "phrase").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), ["qid", "phrase"]).crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    total = scored.groupBy("qid", "content_hash", "chunk_ix").agg(F.sum(part).alias("score"))
    # Rounded for the order, so that sums in another order rank alike.
    return ranked(total.withColumn("cos", F.lit(None).cast("double")), FTS, [F.desc(F.round("score", 9))], most)


# Vector leg


def vector_leg(chunks: DataFrame, queries: DataFrame, model_id: str, most: int = POOL) -> DataFrame:
    """Exact cosine of every embedded chunk of the epoch; ``queries`` is (qid, vec), unit vectors."""
    own = chunks.where((F.col("model_id") == model_id) & F.col("embedding").isNotNull()).select("content_hash", "chunk_ix", "embedding")
    hits = nearest(own, queries, ["content_hash", "chunk_ix"], "embedding", most)
    return hits.select("qid", "content_hash", "chunk_ix", F.lit(VEC).alias("leg"), F.col("rank").alias("leg_rank"), "cos")


# Fusion


def fuse(legs: DataFrame, k: int, pool: int = POOL) -> DataFrame:
    """Admission to the shared pool, reciprocal-rank sums and the final ranks.

    Candidates enter in leg order and then by rank; once ``pool`` distinct
    chunks are in, new ones are not admitted, while further hits on admitted
    ones still count.  Ties end on (content_hash, chunk_ix).
    """
    size = pool_size(k)
    order = F.create_map(*[F.lit(x) for kv in LEG_ORDER.items() for x in kv])[F.col("leg")]
    each = legs.where(F.col("leg_rank") <= size).groupBy("qid", "content_hash", "chunk_ix", "leg").agg(F.min("leg_rank").alias("leg_rank"), F.max("cos").alias("cos"))
    found = each.groupBy("qid", "content_hash", "chunk_ix").agg(
        F.min(order * F.lit(1 << 20) + F.col("leg_rank")).alias("first"),  # one number keeps the aggregate hashed
        F.sum(1.0 / (RRF_K + F.col("leg_rank"))).alias("rrf"),
        F.bit_or("leg").alias("legs"),
        F.max("cos").alias("cos"),
    )
    admitted = found.withColumn("slot", F.row_number().over(Window.partitionBy("qid").orderBy("first", "content_hash", "chunk_ix"))).where(F.col("slot") <= pool)
    last = Window.partitionBy("qid").orderBy(F.desc(F.round("rrf", 12)), "content_hash", "chunk_ix")
    best = Window.partitionBy("qid")
    return admitted.withColumn("best_cos", F.max("cos").over(best)).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("qid", "rank", "content_hash", "chunk_ix", "rrf", "legs", "cos", "best_cos")


def confident(results: DataFrame, min_cos: float) -> DataFrame:
    """Without the whole result of a query whose best cosine, over its pool, is known and below ``min_cos``."""
    return results.where(~((F.lit(min_cos) > 0) & F.coalesce(F.col("best_cos") < min_cos, F.lit(False))))


def suppressed(results: DataFrame, min_cos: float) -> DataFrame:
    """(qid, n_suppressed, best_cos) of the queries that :func:`confident` empties."""
    low = results.where((F.lit(min_cos) > 0) & (F.col("best_cos") < min_cos))
    return low.groupBy("qid").agg(F.count("*").alias("n_suppressed"), F.max("best_cos").alias("best_cos"))


# What results carry


def source_of(source: DataFrame) -> DataFrame:
    """(content_hash, path, ts): the first path and the latest time of each content."""
    return source.groupBy("content_hash").agg(F.min("path").alias("path"), F.max("ts").alias("ts"))


def extent(chunks: DataFrame) -> DataFrame:
    """(content_hash, max_ix) over all epochs."""
    return chunks.groupBy("content_hash").agg(F.max("chunk_ix").alias("max_ix"))


def fragment_flags(rows: DataFrame, chunks: DataFrame, cut: Column | None = None) -> DataFrame:
    """``rows`` with chunk_count and frag: HEAD after the first chunk, TAIL before the last or if unknown, CUT."""
    out = rows.join(extent(chunks), "content_hash", "left")
    head = F.when(F.col("chunk_ix") > 0, HEAD).otherwise(0)
    tail = F.when(F.col("max_ix").isNull() | (F.col("chunk_ix") < F.col("max_ix")), TAIL).otherwise(0)
    cuts = F.lit(0) if cut is None else F.when(cut, CUT).otherwise(0)
    return out.withColumn("chunk_count", F.coalesce(F.col("max_ix") + 1, F.lit(0))).withColumn("frag", head.bitwiseOR(tail).bitwiseOR(cuts)).drop("max_ix")


def dressed(results: DataFrame, chunks: DataFrame, source: DataFrame, width: int = EXCERPT) -> DataFrame:
    """Results with source path, citation, excerpt and fragment flags.

    ``results`` has at most k rows for each query of a batch that the driver
    holds.  It is written once; chunks and sources are reduced to its contents
    before they are grouped, so no more than those is shuffled.
    """
    results = materialize(results, "ask-results")
    here = results.select("content_hash").distinct()
    few = [r[0] for r in here.limit(PUSHED + 1).collect()]
    if len(few) <= PUSHED:  # a filter that skips row groups of a sorted table
        chunks, source = (x.where(F.col("content_hash").isin(few)) for x in (chunks, source))
    else:
        chunks, source = (x.join(F.broadcast(here), "content_hash", "left_semi") for x in (chunks, source))
    texts = distinct_chunks(chunks).select("content_hash", "chunk_ix", prefix(F.col("chunk_text"), width).alias("excerpt"), is_cut(F.col("chunk_text"), width).alias("_cut"))
    out = F.broadcast(results).join(texts, ["content_hash", "chunk_ix"]).join(source_of(source), "content_hash", "left")
    out = fragment_flags(out, chunks, F.col("_cut")).drop("_cut")
    return out.withColumn("source", F.coalesce("path", F.lit("(source path unknown)"))).withColumn("citation", F.concat_ws("#", "content_hash", F.col("chunk_ix").cast("string")))


def ask(chunks: DataFrame, source: DataFrame, queries: dict[str, str], k: int = 5, vectors: DataFrame | None = None, model_id: str | None = None, min_cos: float = 0.0, index: DataFrame | None = None, stats: DataFrame | None = None, pool: int = POOL, words: DataFrame | None = None, grams: DataFrame | None = None, tokens: Callable[[str], list[str]] = plain_words_py) -> DataFrame:
    """The top ``k`` chunks of each query with everything that they carry.

    Without ``vectors`` (qid, vec) only the keyword and literal legs run.
    ``index``, ``stats``, ``words`` and ``grams`` are stored tables, ``tokens`` cuts
    queries as the index was cut; without them the chunks' texts are scanned.
    """
    size = pool_size(k)
    terms = sorted({t for q in queries.values() for p in phrases(q, tokens) for t in p})
    index = postings(chunks, only=terms) if index is None else index.where(F.col("term").isin(terms))
    stats = doc_lengths(chunks) if stats is None else stats
    literal = literal_leg(chunks, queries, size) if words is None else literal_leg_stored(words, chunks, queries, size, grams)
    legs = keyword_leg(index, stats, queries, size, tokens).unionByName(literal)
    if vectors is not None and model_id is not None:
        legs = legs.unionByName(vector_leg(chunks, vectors, model_id, size))
    return dressed(confident(fuse(legs, k, pool), min_cos), chunks, source)


def with_snippets(results: DataFrame, chunks: DataFrame, queries: dict[str, str], width: int = 24) -> DataFrame:
    """``results`` with ``snippet``: the window of ``width`` words of the chunk with most of the query's words, these in marks."""
    from pyspark.sql.functions import pandas_udf

    ship(results.sparkSession)
    terms = {q: set(porter_words(text)) for q, text in queries.items()}

    @pandas_udf("string")
    def run(qids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([snippet(t, terms[q], width) for q, t in zip(qids, texts, strict=True)], dtype=object)

    few = [r[0] for r in results.select("content_hash").distinct().limit(PUSHED + 1).collect()]
    some = chunks.where(F.col("content_hash").isin(few)) if len(few) <= PUSHED else chunks
    texts = distinct_chunks(some).select("content_hash", "chunk_ix", "chunk_text")
    return F.broadcast(results).join(texts, ["content_hash", "chunk_ix"]).withColumn("snippet", run("qid", "chunk_text")).drop("chunk_text")


def hit_lines(results: DataFrame) -> DataFrame:
    """One printable line for each result, with marks where the document goes on."""
    flag = lambda bit: F.col("frag").bitwiseAND(F.lit(bit)) != 0
    body = F.concat(F.when(flag(HEAD), F.lit("[...] ")).otherwise(F.lit("")), trim_excerpt(F.col("excerpt")), F.when(flag(TAIL) | flag(CUT), F.lit(" [...]")).otherwise(F.lit("")))
    line = F.concat(F.format_string("[%d] rrf=%.4f  %s  %s", "rank", "rrf", "citation", "source"), F.lit("\n    "), body)
    return results.select("qid", "rank", line.alias("line"))


def lookup(chunks: DataFrame, content_hash: str, chunk_ix: int) -> DataFrame:
    """The chunk of a citation."""
    return distinct_chunks(chunks.where((F.col("content_hash") == content_hash) & (F.col("chunk_ix") == chunk_ix)))


def _edits(length: Column) -> Column:
    """How many edits a missed term of that length may have."""
    return F.when(length >= 8, 2).when(length >= 4, 1).otherwise(0)


def _cut(word: Column, n: int) -> Column:
    """(n, k, length, piece): ``word`` in ``n`` pieces of about equal length."""
    size = F.length(word)
    at = lambda k: F.floor(size * k / n).cast("int")
    return F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), size.alias("length"), F.substr(word, at(k) + 1, at(k + 1) - at(k)).alias("piece")) for k in range(n)])


def word_pieces(vocabulary: DataFrame, word: str = "suggestion") -> DataFrame:
    """``vocabulary`` with (n, k, length, piece): each word in two and in three pieces, for :func:`corrected` to meet."""
    w = F.col(word)
    return vocabulary.where(F.length(w) >= 3).select("*", F.inline(F.concat(_cut(w, 2), _cut(w, 3))))


def corrected(terms: list[str], index: DataFrame, spark: SparkSession) -> DataFrame:
    """(term, suggestion, distance) for query terms that the index lacks: the nearest index term.

    The allowed edits grow with the length; exact terms are never replaced.
    Of a word in one piece more than it has edits, one piece stays whole and
    moves by no more places than there are edits.  So missed terms and words
    meet on (length, piece) by hash, and only those that do are compared.
    ``index`` has one row for each term and chunk.
    """
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    vocabulary = index.groupBy(F.col("term").alias("suggestion")).agg(F.count("*").alias("df"))
    vocabulary = materialize(vocabulary, "typo-vocabulary")
    missed = asked.join(vocabulary, F.col("term") == F.col("suggestion"), "left_anti").withColumn("edits", _edits(F.length("term"))).where("edits > 0")
    length = F.length("term")
    # What a word of each allowed length has as its k-th piece stands in the term at one of these places.
    shifts = lambda f: F.transform(F.sequence(-F.col("edits"), F.col("edits")), f)
    n = F.col("edits") + 1
    at = lambda size, k: F.floor(size * k / n).cast("int")

    def key(d: Column, k: Column, s: Column) -> Column:
        size = length + d
        start, end = at(size, k), at(size, k + 1)
        here = F.when((start + s >= 0) & (end + s <= length), F.substr(F.col("term"), start + s + 1, end - start))
        return F.struct(n.alias("n"), k.alias("k"), size.alias("length"), here.alias("piece"))

    keys = F.flatten(F.flatten(shifts(lambda d: F.transform(F.sequence(F.lit(0), F.col("edits")), lambda k: shifts(lambda s: key(d, k, s))))))
    places = missed.select("term", "edits", F.inline(F.array_distinct(keys))).where("piece is not null")
    met = word_pieces(vocabulary).join(broadcast_if_small(materialize(places, "typo-places"), BROADCAST_PLACES), ["n", "k", "length", "piece"])
    near = met.select("term", "edits", "suggestion", "df").distinct().withColumn("distance", F.levenshtein("term", "suggestion")).where("distance <= edits")
    w = Window.partitionBy("term").orderBy("distance", F.desc("df"), "suggestion")
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("term", "suggestion", "distance")
