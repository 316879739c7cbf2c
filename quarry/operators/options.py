"""What the defaults leave off: forms, common terms, centred vectors, scales, several stores, focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import iso_plus
from quarry.functions.words import plain_words
from quarry.operators.ingest import lines_of
from quarry.storage import broadcast_if_small, materialize

#: Common terms are broadcast up to this many (about 30 bytes each), else joined by a shuffle.
BROADCAST_COMMON = 500_000


def best_form(hits: DataFrame) -> DataFrame:
    """(qid, content_hash, chunk_ix, score): of a chunk that was indexed under several forms, the best one counts."""
    return hits.groupBy("qid", "content_hash", "chunk_ix").agg(F.max("score").alias("score"))


def without_common(index: DataFrame, n: int, share: float = 0.5) -> DataFrame:
    """Postings without the terms that more than ``share`` of the ``n`` chunks hold."""
    common = materialize(index.groupBy("term").agg(F.count("*").alias("_df")).where(F.col("_df") > share * n).select("term"), "common-terms")
    return index.join(broadcast_if_small(common, BROADCAST_COMMON), "term", "left_anti")


def centred(chunks: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and the embeddings less their mean, at length one; for queries only, the stored vectors stay."""
    own = chunks.where("embedding is not null")
    means = own.select(F.posexplode("embedding").alias("_p", "_x")).groupBy("_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    centre = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("_centre"))  # a row for each dimension
    moved = own.crossJoin(F.broadcast(centre)).select(*key, F.zip_with("embedding", "_centre", lambda a, b: a.cast("double") - b).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda t, x: t + x * x))
    return moved.withColumn("_n", norm).select(*key, F.transform("_v", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)).alias("embedding"))


def scaled(chunks: DataFrame, scale: int) -> DataFrame:
    """(content_hash, chunk_ix, scale, chunk_text): runs of ``scale`` neighbouring chunks as one, numbered anew."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_ix", "chunk_text")))
    ix = F.floor(F.col("chunk_ix") / scale).cast("int")
    runs = chunks.groupBy("content_hash", ix.alias("_ix")).agg(parts.alias("_parts"))
    return runs.select("content_hash", F.col("_ix").alias("chunk_ix"), F.lit(scale).alias("scale"), F.array_join(F.transform("_parts", lambda p: p["chunk_text"]), "").alias("chunk_text"))


def answered_from(hits: DataFrame, registry: DataFrame) -> DataFrame:
    """(store_id, n_hits, local): hits of each registered store, and whether it is here at all."""
    n = hits.groupBy("store_id").agg(F.count("*").alias("n_hits"))
    return registry.select("store_id", "local").join(n, "store_id", "left").na.fill(0, ["n_hits"])


def quiet(notes: DataFrame, now: str, days: int) -> DataFrame:
    """Open notes of which nothing was heard for ``days`` days, the longest silence first."""
    return notes.where((F.col("state") == "open") & (F.col("ts") < iso_plus(now, -86400 * days))).orderBy("ts", "note_id")


def focus(notes: DataFrame, who: str, most: int = 3) -> DataFrame:
    """At most three things to do: what ``who`` holds, the earliest due first, then the oldest."""
    mine = notes.where((F.col("state") == "open") & (F.col("who") == who))
    return mine.orderBy(F.when(F.col("due") == "", 1).otherwise(0), "due", "ts", "note_id").limit(most)


def token_chunks(contents: DataFrame, budget: int, tokens=plain_words, text: str = "text") -> DataFrame:
    """``contents`` in chunks of whole lines with at most ``budget`` tokens each; a longer line stands alone."""
    keep = [c for c in contents.columns if c != text]
    lines = F.transform(lines_of(F.col(text)), lambda x: F.struct(x.alias("line"), F.size(tokens(x)).alias("n")))

    def step(state: Column, x: Column) -> Column:
        fits = (F.size(state["out"]) > 0) & (state["used"] + x["n"] <= budget)
        ix = F.when(fits, state["ix"]).otherwise(state["ix"] + 1)
        return F.struct(ix.alias("ix"), F.when(fits, state["used"] + x["n"]).otherwise(x["n"]).alias("used"), F.concat(state["out"], F.array(ix)).alias("out"))

    start = F.struct(F.lit(-1).alias("ix"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))
    cut = contents.withColumn("_l", lines).where(F.size("_l") > 0).withColumn("_at", F.aggregate("_l", start, step)["out"])
    each = F.transform(F.sequence(F.lit(0), F.element_at("_at", -1)), lambda i: F.array_join(F.transform(F.filter(F.arrays_zip("_l", "_at"), lambda p: p["_at"] == i), lambda p: p["_l"]["line"]), ""))
    return cut.select(*keep, F.posexplode(each).alias("chunk_ix", "chunk_text"))
