"""The index run: scanned texts to a new version of the store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.words import plain_words, plain_words_py, porter_udf, porter_words
from quarry.operators import ingest, notes, search
from quarry.plans.store import OPTIONS, SEGMENT, Conflict, Store, bucket_of
from quarry.schema import DEAD, NO_MODEL
from quarry.storage import broadcast_if_small, delete, materialize, recording, small_splits

#: Paths and contents of a run are broadcast up to this many (about 80 bytes each), else joined by a shuffle.
BROADCAST_CONTENTS = 200_000


@dataclass
class Report:
    store: Store
    version: str
    retired: int
    at: dict

    @property
    def sources(self) -> int:
        return self.store.read("source", self.at).count()

    @property
    def chunks(self) -> int:
        return self.store.read("chunk", self.at).count()


def index(store: Store, scanned: DataFrame, authority: set[str], folder: str = ".", embed=None, model_id: str = NO_MODEL, captures: DataFrame | None = None, incremental: bool = False, mark: tuple[str, int] | None = None, same: DataFrame | None = None) -> Report:
    """Bring the store to what ``scanned`` (path, text, mtime, and readable if known) tells.

    Rows without text but unreadable are kept as they were; rows with empty
    text are withdrawn.  ``embed`` maps a chunk-text column to vectors.  An
    incremental run has no authority, so it retires no source; what an edited
    source no longer has is collected all the same.  It reads and writes only
    what its paths and contents touch.  ``same`` (path) are sources
    that were found unchanged and so not read.  Notes' field events are a table
    of their own, which ``captures`` leaves alone.
    """
    at = store.pointer()
    if "readable" not in scanned.columns:
        scanned = scanned.withColumn("readable", F.col("text").isNotNull())
    with recording() as texts:
        contents = materialize(ingest.compose(scanned.where("readable")), "index-contents", **OPTIONS)
    extra = {} if captures is None else {"note": notes.one_each(notes.project(captures))}
    if incremental and "ref" in at["tables"]:
        return _increment(store, at, contents, embed, model_id, mark, extra)
    source, chunks = store.read("source", at), store.read("chunk", at)
    kept = scanned.where(~F.col("readable")).select("path")
    seen = contents.select("path").unionByName(kept)
    if same is not None:
        seen = seen.unionByName(same.select("path"))
    rights = set() if incremental else authority
    gone = ingest.retired(source, seen, rights, folder).select("path")
    after = materialize(ingest.upsert(source.join(gone, "path", "left_anti"), contents.drop("text")), "index-source")
    n_gone = gone.count()
    with small_splits(store.spark, SEGMENT):
        fresh = ingest.new_chunks(contents, chunks, model_id, deal=False)
        if embed is not None:
            fresh = fresh.withColumn("embedding", embed(F.col("chunk_text")))
        fresh = materialize(ingest.collect_garbage(fresh, after), "index-fresh", **OPTIONS)
    delete(store.spark, texts)  # all that follows reads the chunks
    old = materialize(chunks.select("content_hash").distinct(), "index-known")
    garbage = bool(at["tables"].get("dead")) or not old.join(after, "content_hash", "left_anti").isEmpty()
    changes = keyword_index(store, at, old, fresh, after if garbage else None)
    if garbage:
        live = materialize(ingest.collect_garbage(chunks, after).unionByName(fresh), "index-chunks")
        version = store.commit(mark=mark, at=at, source=after, chunk=live, dead=ingest.empty(store.spark, DEAD), **changes, **extra)
    else:
        version = store.commit(mark=mark, at=at, source=after, append={"chunk": fresh} | {t: changes.pop(t) for t in ("posting", "word", "gram")}, **changes, **extra)
    return Report(store, version, n_gone, store.pointer())


def _of(table: DataFrame, contents: DataFrame) -> DataFrame:
    """The rows of ``table`` of some contents: by a filter that skips row groups if they are few, else by a join."""
    few = [r[0] for r in contents.limit(search.PUSHED + 1).collect()]
    if len(few) <= search.PUSHED:
        return table.where(F.col("content_hash").isin(few))
    return table.join(broadcast_if_small(contents, BROADCAST_CONTENTS), "content_hash", "left_semi")


def _buckets(rows: DataFrame, key: str) -> set[int]:
    """The buckets that ``rows`` fall into; there are :data:`BUCKETS` at most."""
    return {r[0] for r in rows.select(bucket_of(key)).distinct().collect()}


def _increment(store: Store, at: dict, contents: DataFrame, embed, model_id: str, mark: tuple[str, int] | None, extra: dict[str, DataFrame]) -> Report:
    """A run that only puts in ``contents``: it reads the buckets of their paths and contents, and writes rows of its own only.

    A content that its last path has lost is told dead, one that comes back
    alive again; chunks, postings and words of neither are written.
    """
    spark, none = store.spark, "content_hash string"
    paths = contents.select("path").distinct()
    before = materialize(store.merged("source", at, _buckets(paths, "path")).join(broadcast_if_small(paths, BROADCAST_CONTENTS), "path", "left_semi"), "index-before")
    after = materialize(ingest.upsert(before, contents.drop("text")), "index-source")
    now = after.select("content_hash", "path")
    lost = materialize(before.select("content_hash", "path").join(now, ["content_hash", "path"], "left_anti"), "index-lost")
    left = lost.select("content_hash").distinct()
    held = store.merged("ref", at, _buckets(left, "content_hash")).join(lost, ["content_hash", "path"], "left_anti").unionByName(now)
    withdrawn = materialize(left.join(held, "content_hash", "left_anti"), "index-withdrawn")
    need = materialize(now.select("content_hash").distinct(), "index-need")
    back = materialize(need.join(store.dead(at), "content_hash", "left_semi") if at["tables"].get("dead") else ingest.empty(spark, none), "index-back")

    stored = store._appended("chunk", at)
    ever = materialize(_of(stored, need).select("content_hash", "model_id").distinct(), "index-known")
    with small_splits(spark, SEGMENT):
        fresh = ingest.new_chunks(contents, ever, model_id, deal=False)
        if embed is not None:
            fresh = fresh.withColumn("embedding", embed(F.col("chunk_text")))
        fresh = materialize(fresh, "index-fresh", **OPTIONS)
    changes = keyword_index(store, at, ever.select("content_hash").distinct(), fresh, None)
    cut = porter_udf() if store.stemmed else plain_words
    counted = lambda hashes, sign: search.distinct_chunks(_of(stored, hashes)).select(F.size(cut(F.col("chunk_text"))).alias("dl")).agg((sign * F.count("*")).alias("n"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("total"))
    stat = changes.pop("stat").unionByName(counted(back, 1)).unionByName(counted(withdrawn, -1)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    mine = F.lit(at["number"] + 1).cast("long").alias("seq")
    dead = materialize(withdrawn.select("content_hash", F.lit(True).alias("gone"), mine).unionByName(back.select("content_hash", F.lit(False).alias("gone"), mine)), "index-dead")
    append = {"chunk": fresh, **changes} | ({} if dead.isEmpty() else {"dead": dead})
    append = {t: df for t, df in append.items() if not df.isEmpty()}
    refs = now.withColumn("gone", F.lit(False)).unionByName(lost.select("content_hash", "path", F.lit(True).alias("gone")))
    merge = {} if after.isEmpty() else {"source": after.withColumn("gone", F.lit(False)), "ref": refs}
    version = store.commit(mark=mark, at=at, append=append, merge=merge, stat=materialize(stat, "index-stat"), **extra)
    return Report(store, version, 0, store.pointer())


def keyword_index(store: Store, at: dict, old: DataFrame, fresh: DataFrame, source: DataFrame | None) -> dict[str, DataFrame]:
    """posting, word, gram and stat after a run.

    ``fresh`` holds its new chunks and ``old`` the contents that had chunks
    before; only contents without any are tokenised.  Given ``source``, the
    tables are whole and without contents that it lacks; else ``posting``,
    ``word`` and ``gram`` are what is to be appended.
    """
    added = fresh.join(old, "content_hash", "left_anti")
    cut = porter_udf() if store.stemmed else plain_words
    posting, word = search.postings(added, cut), search.raw_words(added)
    lengths = search.distinct_chunks(added).select(F.size(cut(F.col("chunk_text"))).alias("dl"))
    new = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    if source is None:
        stat = store.read("stat", at).select("n", "total").unionByName(new).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return {"posting": posting, "word": word, "gram": _grams(word), "stat": stat}
    kept = ingest.collect_garbage(store.read("posting", at), source)
    word = ingest.collect_garbage(store.read("word", at), source).unionByName(word)
    live = ingest.collect_garbage(store.read("chunk", at).select("content_hash", "chunk_ix"), source).unionByName(fresh.select("content_hash", "chunk_ix"))
    n = live.agg(F.count_distinct("content_hash", "chunk_ix").alias("n"))
    total = kept.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")).unionByName(new.select("total")).agg(F.sum("total").alias("total"))
    return {"posting": kept.unionByName(posting), "word": word, "gram": _grams(word), "stat": n.crossJoin(total)}


def _grams(word: DataFrame) -> DataFrame:
    """The grams of the words' vocabulary, which alone is written."""
    return search.word_grams(materialize(word.select("word").distinct(), "index-vocabulary", **OPTIONS))


def rebuilt(store: Store) -> str:
    """Build the keyword tables of all chunks anew, as after a merge."""
    at = store.pointer()
    chunks = store.read("chunk", at)
    none = ingest.empty(store.spark, "content_hash string")
    return store.commit(at=at, reads=("chunk",), **keyword_index(store, {"tables": {}}, none, search.distinct_chunks(chunks), None))


def ask(store: Store, queries: dict[str, str], k: int = 5, vectors: DataFrame | None = None, model_id: str | None = None, min_cos: float = 0.0) -> DataFrame:
    """:func:`quarry.operators.search.ask` over the stored keyword tables of one version."""
    at = store.pointer()
    get = lambda t: store.read(t, at)
    stats = get("stat").select("n", (F.col("total") / F.col("n")).alias("avgdl"))
    return search.ask(get("chunk"), get("source"), queries, k, vectors, model_id, min_cos, get("posting"), stats, words=get("word"), grams=get("gram") if at["tables"].get("gram") else None, tokens=porter_words if store.stemmed else plain_words_py)


def edit_note(store: Store, note_id: str, change: Callable[[notes.Claim], dict[str, str]], now: str) -> dict[str, str]:
    """Append the events of ``change`` of the note's claim.

    The claim is read again and the change made anew whenever another edit came
    between, so of two that race for a note one sees the other's.
    """
    while True:
        at = store.pointer()
        fields = change(notes.claim_of(store.notes(at), note_id))
        try:
            if fields:
                store.commit(at=at, reads=("note",), append={"note_event": notes.events_of(store.spark, note_id, fields, at["number"] + 1, now)})
            return fields
        except Conflict:
            continue


def pull(store: Store, peer: Store) -> str:
    """Merge another store's chunks and sources in; what is here wins."""
    at = store.pointer()
    chunk = ingest.merge(store.read("chunk", at), peer.read("chunk"), ["content_hash", "model_id", "chunk_ix"])
    source = ingest.merge(store.read("source", at), peer.read("source"), ["path"])
    store.commit(at=at, chunk=materialize(chunk, "pull-chunk"), source=materialize(source, "pull-source"), dead=ingest.empty(store.spark, DEAD))
    return rebuilt(store)


def push(store: Store, peer: Store) -> str:
    """Publish a snapshot of this store as the peer's new version, and verify its row counts."""
    mine = store.snapshot()
    version = peer.commit(mark=store.pointer()["mark"], **mine)
    for name, table in peer.snapshot().items():
        if table.count() != mine[name].count():
            raise OSError(f"{name} did not arrive whole")
    return version
