"""Unranked regular-expression scan over the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import ere, is_cut, prefix
from quarry.operators.search import distinct_chunks, fragment_flags, source_of


def grep(chunks: DataFrame, source: DataFrame, pattern: str, ignore_case: bool = False, source_like: str | None = None, since: str = "", until: str = "", newest: bool = False, width: int = 160, most: int | None = None) -> DataFrame:
    """Chunks that match a POSIX extended pattern, by lines.

    A source filter keeps contents with a path LIKE it, whatever the case of
    ASCII letters.  Contents without a time fail every ``since`` and pass every
    ``until``.  Matches come by (content_hash, chunk_ix), or the newest first.
    """
    width = width if width > 0 else 160
    hits = chunks.where(F.col("chunk_text").rlike(ere(pattern, ignore_case)))
    if source_like is not None:
        named = source.where(F.col("path").ilike(source_like)).select("content_hash").distinct()
        hits = hits.join(named, "content_hash", "left_semi")
    hits = distinct_chunks(hits).join(source_of(source), "content_hash", "left")
    if since:
        hits = hits.where(F.col("ts") >= since)
    if until:
        hits = hits.where(F.col("ts") <= until)
    hits = fragment_flags(hits, chunks, is_cut(F.col("chunk_text"), width))
    out = hits.select("content_hash", "chunk_ix", prefix(F.col("chunk_text"), width).alias("excerpt"), "path", "ts", "chunk_count", "frag")
    out = out.orderBy(*([F.desc("ts")] if newest else []), "content_hash", "chunk_ix")
    return out if most is None else out.limit(most)
