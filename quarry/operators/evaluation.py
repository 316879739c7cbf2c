"""Evaluation of retrieval against labelled queries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.search import B, FTS, K1, SUMS, distinct_chunks, each_query, keyword_leg, phrases, query_sums, ranked, rows_at_once, word_grams, words_holding
from quarry.session import ship
from quarry.storage import broadcast_if_small, materialize

#: Labelled queries and what leads to their chunks are broadcast up to this many rows (about 200 bytes each), else joined by a shuffle.
LABELLED = 100_000

QUERY = "id string, split string, class string, expect string, artifact string, query string, anchor string, trap string"


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """The labelled set: tab-separated, ``#`` comments, empty fields kept as ''."""
    return spark.read.csv(path, sep="\t", schema=QUERY, comment="#", quote="", nullValue="\0").na.fill("")


def resolve(chunks: DataFrame, queries: DataFrame, text: str = "anchor") -> DataFrame:
    """(id, content_hash, chunk_ix): the chunks that hold the query's ``text``; empty texts resolve to none.

    Blanks cut texts into words. What stands between a text's first and last
    word are whole words of any chunk that holds it, so the rarest of them
    leads by a hash join to few chunks, which are then searched. A text of one
    or two words may stand within others; its longest part leads to the
    corpus' words that hold it, and these to the chunks. A text of blanks alone
    is sought in all chunks.
    """
    blank = r"[\x00-\x20]+"
    asked = queries.where(F.coalesce(text, F.lit("")) != "").select("id", F.col(text).alias("_t"))
    parts = F.split("_t", blank, -1)
    inner = F.array_distinct(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != ""))
    longest = F.element_at(F.array_sort(F.transform(parts, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1)["x"]
    asked = materialize(asked.select("id", "_t", inner.alias("_inner"), longest.alias("_part")), "anchors")
    here = distinct_chunks(chunks).select("content_hash", "chunk_ix", "chunk_text")
    words = here.select("content_hash", "chunk_ix", F.explode(F.array_distinct(F.split("chunk_text", blank, -1))).alias("_w"))
    few = lambda df: broadcast_if_small(df, LABELLED)

    each = asked.select("id", F.explode("_inner").alias("_w"))
    keys = each.select("_w").distinct()
    n_words = asked.agg(F.coalesce(F.sum(F.size("_inner")), F.lit(0))).first()[0]
    df = words.join(F.broadcast(keys) if n_words <= LABELLED else keys, "_w", "left_semi").groupBy("_w").agg(F.count("*").alias("_df"))
    rarest = each.join(df, "_w", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "_w"))["_w"].alias("_w"))
    leads = rarest
    loose = asked.where((F.size("_inner") == 0) & (F.col("_part") != "")).select("id", "_part")
    sought = [r[0] for r in loose.select("_part").distinct().collect()]  # of a labelled set, which people write
    if sought:
        vocabulary = words.select(F.col("_w").alias("word")).where("word <> ''")
        holding = words_holding(word_grams(vocabulary), sought)
        leads = leads.unionByName(holding.join(few(loose), F.col("term") == F.col("_part")).select("id", F.col("word").alias("_w")))
    leads = materialize(leads.join(asked.select("id", "_t"), "id"), "anchor-leads")
    near = words.join(few(leads), "_w").select("id", "_t", "content_hash", "chunk_ix").distinct()
    found = here.join(few(materialize(near, "anchor-near")), ["content_hash", "chunk_ix"]).where(F.contains("chunk_text", "_t"))
    out = found.select("id", "content_hash", "chunk_ix")
    empty = asked.where((F.size("_inner") == 0) & (F.col("_part") == ""))
    if not empty.isEmpty():
        out = out.unionByName(here.join(few(empty), F.contains("chunk_text", "_t")).select(*out.columns))
    return out.distinct()


def defects(queries: DataFrame, gold: DataFrame, traps: DataFrame) -> DataFrame:
    """(id, defect) of queries that can't be scored."""
    has_gold, has_trap = gold.select("id").distinct().withColumn("_g", F.lit(True)), traps.select("id").distinct().withColumn("_t", F.lit(True))
    both = gold.join(traps, ["id", "content_hash", "chunk_ix"]).select("id").distinct().withColumn("_b", F.lit(True))
    j = queries.select("id", "expect", "trap").join(has_gold, "id", "left").join(has_trap, "id", "left").join(both, "id", "left")
    why = F.when((F.col("expect") == "indexed") & F.col("_g").isNull(), "anchor resolves to no chunk")
    why = why.when((F.col("trap") != "") & F.col("_t").isNull(), "trap resolves to no chunk")
    why = why.when((F.col("trap") != "") & F.col("_b").isNotNull(), "trap and gold share a chunk")
    return j.withColumn("defect", why).where("defect is not null").select("id", "defect")


def full_ranking(index: DataFrame, stats: DataFrame, queries: dict[str, str], **kw) -> DataFrame:
    """The keyword leg's whole ranking, without a limit."""
    return keyword_leg(index, stats, queries, None, **kw)


def scored(chunks: DataFrame, queries: dict[str, str], k1: float = K1, b: float = B) -> DataFrame:
    """(qid, content_hash, chunk_ix, score): the keyword leg's whole result without ranks, for many queries.

    A query of common words meets most chunks, so nothing is shuffled for each
    pair of the two: the phrases of all queries are counted chunk by chunk,
    and with their document frequencies each chunk's scores are summed where
    it lies. A written row holds a chunk's counts, which are far fewer than its
    scores; these are made again by each reader and never written. Queries and
    chunks are cut into plain words.
    """
    spark = chunks.sparkSession
    cut = [(q, tuple(p)) for q, text in queries.items() for p in phrases(text)]
    if not cut:
        return spark.createDataFrame([], "qid string, content_hash string, chunk_ix int, score double")
    every = {p: i for i, p in enumerate(dict.fromkeys(p for _, p in cut))}
    names = list(queries)
    ship(spark)
    places = distinct_chunks(chunks).select("content_hash", "chunk_ix", "chunk_text").mapInArrow(_counter(list(every)), "content_hash string, chunk_ix int, dl int, phrases array<int>, tfs array<int>")
    counted = materialize(places, "phrase-counts", compression="zstd")
    n, avgdl = counted.agg(F.count("*"), F.avg("dl")).first()
    df = dict(map(tuple, counted.select(F.explode("phrases").alias("p")).groupBy("p").count().collect()))  # of the labelled set's phrases
    idf = [max(math.log((n - df.get(i, 0) + 0.5) / (df.get(i, 0) + 0.5)), 1e-6) for i in range(len(every))]
    at = {q: i for i, q in enumerate(names)}
    pairs = [(p, q, times) for (p, q), times in Counter((every[p], at[q]) for q, p in cut).items()]
    return each_query(counted.where(F.size("phrases") > 0).mapInArrow(_scorer(pairs, idf, len(names), avgdl, k1, b), SUMS), names)


def _counter(asked: list[tuple[str, ...]]):
    """Batches of chunks to batches of their sizes and of how often each phrase stands in them.

    Words are numbers of the phrases' own words; where a phrase's first word stands, the next ones are compared.
    """
    vocabulary = sorted({t for p in asked for t in p})
    number = {t: i for i, t in enumerate(vocabulary)}
    size, longest = np.array([len(p) for p in asked]), max(map(len, asked))
    table = np.array([[number[t] for t in p] + [-1] * (longest - len(p)) for p in asked])
    order = np.argsort(table[:, 0], kind="stable")
    begin = np.searchsorted(table[order, 0], np.arange(len(vocabulary)))
    count = np.searchsorted(table[order, 0], np.arange(len(vocabulary)), side="right") - begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for big in batches:
            for k in range(0, big.num_rows, 1000):
                b = big.slice(k, 1000)
                n = b.num_rows
                words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(b.column("chunk_text").cast(pa.string()), "")), "[^a-z0-9]+")
                full = pc.not_equal(words.flatten(), "")
                row = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy(zero_copy_only=False))[full.to_numpy(zero_copy_only=False)]
                word = pc.fill_null(pc.index_in(words.flatten().filter(full), value_set=known), -1).to_numpy(zero_copy_only=False)
                place = np.flatnonzero(word >= 0)
                first = word[place]
                each = np.repeat(np.arange(len(place)), count[first])  # a place, once for each phrase that begins with its word
                phrase = order[begin[first][each] + np.arange(len(each)) - np.repeat(np.cumsum(count[first]) - count[first], count[first])]
                place = place[each]
                for j in range(1, longest):
                    same = size[phrase] <= j
                    inside = np.flatnonzero(~same & (place + j < len(word)))
                    at = place[inside] + j
                    same[inside] = (row[at] == row[place[inside]]) & (word[at] == table[phrase[inside], j])
                    place, phrase = place[same], phrase[same]
                key, tf = np.unique(row[place] * len(asked) + phrase, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(n + 1) * len(asked)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % len(asked), tf)]
                yield pa.RecordBatch.from_arrays([b.column("content_hash"), b.column("chunk_ix"), pa.array(np.bincount(row, minlength=n), pa.int32()), *lists], ["content_hash", "chunk_ix", "dl", "phrases", "tfs"])

    return run


def _scorer(pairs: list[tuple[int, int, int]], idf: list[float], n_queries: int, avgdl: float, k1: float, b: float):
    """Batches of phrase counts to batches of BM25 sums; ``pairs`` are (phrase, query, times)."""
    sums, weight, step = query_sums(pairs, len(idf), n_queries), np.array(idf), rows_at_once(n_queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, step):
                rows = big.slice(k, step)
                held, tf = rows.column("phrases"), rows.column("tfs").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(held).to_numpy(zero_copy_only=False))
                p, dl = held.flatten().to_numpy(zero_copy_only=False), rows.column("dl").to_numpy(zero_copy_only=False)[row]
                part = weight[p] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                yield pa.RecordBatch.from_arrays([rows.column("content_hash"), rows.column("chunk_ix"), *sums(rows.num_rows, row, p, part)], ["content_hash", "chunk_ix", "qids", "scores"])

    return run


def matches(hits: DataFrame) -> DataFrame:
    """(qid, matches): how many chunks each query met."""
    return hits.groupBy("qid").agg(F.count("*").alias("matches"))


def best(hits: DataFrame, most: int) -> DataFrame:
    """The keyword leg of :func:`scored` hits, at most ``most`` for each query.

    Whole points of score are counted first, so only hits that may be among
    the best are sorted.
    """
    points = F.floor("score").cast("int")
    n = hits.groupBy("qid", points.alias("_p")).agg(F.count("*").alias("_n"))
    above = Window.partitionBy("qid").orderBy(F.desc("_p"))
    floor = n.withColumn("_sum", F.sum("_n").over(above)).groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("_sum") >= most, F.col("_p"))), F.lit(0)).alias("_floor"))
    some = hits.join(F.broadcast(materialize(floor, "score-floors")), "qid").where(points >= F.col("_floor")).drop("_floor")  # a row for each query
    return ranked(some.withColumn("cos", F.lit(None).cast("double")), FTS, [F.desc("score")], most)


def placed(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, bm25_rank, bm25_matches): the rank of each query's first gold chunk among :func:`scored` hits, and their number.

    The rank is one more than the hits before it, so nothing is sorted.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("content_hash").alias("h"), F.col("chunk_ix").alias("i"))
    wanted = broadcast_if_small(materialize(gold.select(F.col("id").alias("qid"), "content_hash", "chunk_ix").distinct(), "gold"), LABELLED)
    first = hits.join(wanted, ["qid", "content_hash", "chunk_ix"]).groupBy("qid").agg(F.min(order).alias("_first"))
    first = broadcast_if_small(materialize(first, "first-gold"), LABELLED)
    before = F.count(F.when(order < F.col("_first"), 1))
    near = hits.join(first, "qid", "left").groupBy(F.col("qid").alias("id"))
    return near.agg(F.when(F.max(F.col("_first").isNotNull()), before + 1).cast("int").alias("bm25_rank"), F.count("*").alias("bm25_matches"))


def first_rank(hits: DataFrame, targets: DataFrame, name: str = "rank") -> DataFrame:
    """(id, rank of the first target hit); ``hits`` is (qid, content_hash, chunk_ix, rank)."""
    return hits.withColumnRenamed("qid", "id").join(targets, ["id", "content_hash", "chunk_ix"]).groupBy("id").agg(F.min("rank").alias(name))


def outcomes(queries: DataFrame, hybrid: DataFrame, keyword_only: DataFrame, ranking: DataFrame, gold: DataFrame, traps: DataFrame, pool: int) -> DataFrame:
    """One row for each query with its ranks in every run, what stood next to it and one diagnosis.

    ``ranking`` is the keyword leg's whole ranking, or what :func:`placed` tells of it.
    """
    rank = first_rank(hybrid, gold, "rank")
    degraded = first_rank(keyword_only, gold, "deg_rank")
    trap = first_rank(hybrid, traps, "trap_rank")
    if "bm25_rank" in ranking.columns:
        keyword = [ranking]
    else:
        keyword = [first_rank(ranking.withColumnRenamed("leg_rank", "rank"), gold, "bm25_rank"), ranking.groupBy(F.col("qid").alias("id")).agg(F.count("*").alias("bm25_matches"))]
    n_gold = gold.groupBy("id").agg(F.count("*").alias("n_gold"))
    docs = gold.select("id", "content_hash").distinct()
    other = hybrid.withColumnRenamed("qid", "id").join(docs, ["id", "content_hash"]).join(gold, ["id", "content_hash", "chunk_ix"], "left_anti")
    neighbour = other.groupBy("id").agg(F.min("rank").alias("neighbour_rank"))
    out = queries
    for part in (n_gold, rank, degraded, *keyword, neighbour, trap):
        out = out.join(part, "id", "left")
    out = out.na.fill(0, ["n_gold", "bm25_matches"])
    return out.withColumn("diagnosis", diagnosis(pool))


def diagnosis(pool: int) -> Column:
    """One label for each query, so that labels add up over a run."""
    rank, deg, bm25 = F.col("rank"), F.col("deg_rank"), F.col("bm25_rank")
    stale = F.col("trap_rank").isNotNull() & (rank.isNull() | (F.col("trap_rank") < rank))
    label = F.when(F.col("n_gold") == 0, "NOT_INDEXED")
    label = label.when((rank > 1) & stale, "STALE_OUTRANKS").when(rank == 1, "HIT@1").when(rank <= 5, "HIT@5").when(rank.isNotNull(), "HIT@K")
    label = label.when(stale, "STALE_OUTRANKS").when(F.col("neighbour_rank").isNotNull(), "NEIGHBOUR_CHUNK")
    label = label.when(bm25.isNull() & deg.isNull(), "BOTH_LEGS_MISSED").when(bm25.isNull(), "KEYWORD_NO_MATCH")
    return label.when(bm25 > pool, "KEYWORD_TOO_DEEP").otherwise("FUSED_OUT")


def scores(results: DataFrame, by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """n, recall at 1, at 5 and at all, and mean reciprocal rank, for each value of ``by``."""
    r = F.col(rank)
    hit = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return results.groupBy(*(by or [])).agg(F.count("*").alias("n"), hit(r == 1).alias("r1"), hit(r <= 5).alias("r5"), hit(r.isNotNull()).alias("rk"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"))


def against_control(results: DataFrame) -> DataFrame:
    """How many queries the other legs helped, hurt or moved down against the keyword leg alone."""
    r, d = F.col("rank"), F.col("deg_rank")
    kind = F.when(r.isNotNull() & d.isNull(), "helped").when(r.isNull() & d.isNotNull(), "hurt").when(r > d, "demoted").when(r < d, "promoted").otherwise("same")
    return results.groupBy(kind.alias("effect")).agg(F.count("*").alias("n"))


def coverage(results: DataFrame) -> DataFrame:
    """By artifact: queries, those whose answer is in the index and those that were marked as not."""
    return results.groupBy("artifact").agg(F.count("*").alias("n"), F.sum((F.col("n_gold") > 0).cast("int")).alias("covered"), F.sum(((F.col("expect") == "unindexed") & (F.col("n_gold") > 0)).cast("int")).alias("closed"))


def selectivity(ranking: DataFrame) -> DataFrame:
    """The upper median of how many chunks each query's keywords matched."""
    return median_of(matches(ranking))


def median_of(found: DataFrame) -> DataFrame:
    """The upper median of :func:`matches`."""
    place = found.withColumn("_i", F.row_number().over(Window.orderBy("matches", "qid")) - 1).withColumn("_c", F.count("*").over(Window.partitionBy()))
    return place.where(F.col("_i") == F.floor(F.col("_c") / 2)).select(F.col("matches").alias("median_matches"))


def labels(results: DataFrame) -> DataFrame:
    return results.groupBy("diagnosis").agg(F.count("*").alias("n"))
