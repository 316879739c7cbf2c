"""From scanned text to chunks, and the upkeep of the source and chunk tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import artifact_time
from quarry.schema import CHUNK_LINES, NAMESPACES, NO_MODEL
from quarry.storage import broadcast_if_small, distinct_by, materialize

#: Open branches of a digest tree are broadcast up to this many (20 bytes each), else joined by a shuffle.
BROADCAST_BRANCHES = 500_000


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, 64 lower-case hex digits."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def lines_of(text: Column) -> Column:
    """The lines with their terminators; the last may lack one."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0))


def chunk(contents: DataFrame, lines: int = CHUNK_LINES, text: str = "text", stride: int | None = None) -> DataFrame:
    """``contents`` exploded into chunk_ix and chunk_text, ``lines`` lines each.

    ``stride`` below ``lines`` makes chunks overlap.  Texts without a character
    have no chunk.
    """
    stride = stride or lines
    cut = contents.withColumn("_lines", lines_of(F.col(text))).where(F.size("_lines") > 0)
    last = F.greatest(F.ceil((F.size("_lines") - lines) / stride), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("_lines", i * stride + 1, lines), ""))
    keep = [c for c in contents.columns if c != text]
    return cut.select(*keep, F.posexplode(parts).alias("chunk_ix", "chunk_text"))


def compose(scanned: DataFrame) -> DataFrame:
    """(path, content_hash, mtime, ts, text) of what has text; the rest was seen at most."""
    return scanned.where(F.length("text") > 0).select("path", content_hash(F.col("text")).alias("content_hash"), "mtime", artifact_time(F.col("text"), F.col("mtime")).alias("ts"), "text")


def new_chunks(contents: DataFrame, chunks: DataFrame, model_id: str = NO_MODEL, lines: int = CHUNK_LINES, deal: bool = True) -> DataFrame:
    """Chunks of the contents of which ``chunks`` has none under ``model_id``; each content once.

    Contents are dealt out by their hash, so that a few large files are worked
    on by all tasks; not so with ``deal=False``, for a table of small row groups.
    """
    known = chunks.where(F.col("model_id") == model_id).select("content_hash").distinct()
    fresh = distinct_by(contents.select("content_hash", "text"), ["content_hash"]).join(known, "content_hash", "left_anti")
    out = chunk(fresh.repartition("content_hash") if deal else fresh, lines)
    return out.select("content_hash", F.lit(model_id).alias("model_id"), "chunk_ix", "chunk_text", F.lit(None).cast("array<float>").alias("embedding"))


def unchanged(listing: DataFrame, source: DataFrame, chunks: DataFrame, model_id: str = NO_MODEL) -> DataFrame:
    """Paths of ``listing`` (path, mtime) that need no reading: same non-zero mtime, and chunks are there."""
    there = chunks.where(F.col("model_id") == model_id).select("content_hash").distinct()
    known = source.where("mtime <> 0").join(there, "content_hash", "left_semi").select("path", "mtime")
    return listing.join(known, ["path", "mtime"], "left_semi")


def upsert(source: DataFrame, seen: DataFrame) -> DataFrame:
    """``source`` with the rows of ``seen`` put in by path; an empty ``ts`` keeps the one that was there."""
    old, new = source.alias("o"), seen.dropDuplicates(["path"]).alias("n")
    pick = lambda c: F.when(F.col("n.path").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    ts = F.when(F.coalesce(F.col("n.ts"), F.lit("")) != "", F.col("n.ts")).when(F.col("n.content_hash") == F.col("o.content_hash"), F.coalesce(F.col("o.ts"), F.lit(""))).when(F.col("n.path").isNotNull(), F.lit("")).otherwise(F.col("o.ts"))
    return old.join(new, F.col("o.path") == F.col("n.path"), "full_outer").select(F.coalesce("n.path", "o.path").alias("path"), pick("content_hash").alias("content_hash"), pick("mtime").alias("mtime"), ts.alias("ts"))


# Retiring


def canonical_path(path: str) -> str | None:
    """``path`` without empty and ``.`` segments; None if it has ``..``."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    return None if ".." in parts else ("/" if path.startswith("/") else "") + "/".join(parts)


def in_scope(path: Column, folder: str) -> Column:
    """Whether ``path`` lies below ``folder``, judged by the text alone; doubt is false."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(^|/)(\./)+", "$1"), r"(^|/)\.?$", "$1")
    clean = F.when(F.length(clean) > 1, F.regexp_replace(clean, "/$", "")).otherwise(clean)
    ok = ~path.rlike(r"(^|/)\.\.(/|$)")
    top = canonical_path(folder)
    if top is None:
        return F.lit(False)
    if top == "":
        return ok & (clean != "") & ~F.startswith(clean, F.lit("/"))
    if top == "/":
        return ok & F.startswith(clean, F.lit("/")) & (F.length(clean) > 1)
    return ok & F.startswith(clean, F.lit(top + "/"))


def namespace(path: Column) -> Column:
    """The registered namespace, ``?`` for the look of an unregistered one, '' for a file."""
    word = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9_-]*):", 1)
    return F.when(word.isin(NAMESPACES), word).when(word != "", F.lit("?")).otherwise(F.lit(""))


def retired(source: DataFrame, seen: DataFrame, authority: set[str], folder: str = ".") -> DataFrame:
    """Rows of ``source`` that a run may drop: unseen, in a namespace that it observed whole.

    ``authority`` names the observed namespaces, ``file`` for a complete walk of
    ``folder``.  Without authority nothing goes.
    """
    unseen = source.join(seen.select("path").distinct(), "path", "left_anti")
    ns = namespace(F.col("path"))
    may = ns.isin(sorted(authority - {"file"})) if authority - {"file"} else F.lit(False)
    if "file" in authority:
        may = may | ((ns == "") & in_scope(F.col("path"), folder))
    return unseen.where(may)


def sweep(source: DataFrame, seen: DataFrame, authority: set[str], folder: str = ".") -> DataFrame:
    """``source`` without what :func:`retired` finds."""
    return source.join(retired(source, seen, authority, folder).select("path"), "path", "left_anti")


def collect_garbage(chunks: DataFrame, source: DataFrame) -> DataFrame:
    """Chunks, of every epoch, whose content some source still has."""
    return chunks.join(source.select("content_hash").distinct(), "content_hash", "left_semi")


# Merging and reporting


def merge(local: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Keyed union; the local row wins."""
    fresh = incoming.dropDuplicates(key).join(local.select(*key), key, "left_anti")
    return local.unionByName(fresh, allowMissingColumns=True)


def migrate(table: DataFrame, schema) -> DataFrame:
    """``table`` with the columns of ``schema``; missing ones are null."""
    empty = table.sparkSession.createDataFrame([], schema)
    return empty.unionByName(table, allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType) for f in schema])


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def models(chunks: DataFrame) -> DataFrame:
    """Embedded chunks of each epoch, the most populated first, then by name."""
    return chunks.where("embedding is not null").groupBy("model_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model_id")


def corpus_fingerprint(source: DataFrame, volatile: tuple[str, ...] = ("uv",)) -> DataFrame:
    """16 hex digits that name the corpus: of the sorted ``path hash`` lines outside volatile namespaces.

    The digest is of one string, so the list of paths meets in one task; it
    serves evaluation corpora.  :func:`corpus_digest` names larger ones.
    """
    keep = source.where(~namespace(F.col("path")).isin(list(volatile)))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("path", "content_hash"))), lambda x: F.concat(x["path"], F.lit(" "), x["content_hash"], F.lit("\n")))
    return keep.agg(F.substring(F.sha2(F.array_join(lines, ""), 256), 1, 16).alias("fingerprint"), F.count("*").alias("n_sources"))


def corpus_digest(source: DataFrame, volatile: tuple[str, ...] = ("uv",), digits: int = 3) -> DataFrame:
    """16 hex digits that name a corpus of any size, and its sources.

    The lines of :func:`corpus_fingerprint` are dealt by the first ``digits`` of
    their path's SHA-256; each group is sorted and digested by itself, and the
    digest of the groups' digests in order is the name.
    """
    keep = source.where(~namespace(F.col("path")).isin(list(volatile)))
    lines = lambda x: F.transform(F.sort_array(x), lambda y: F.concat(y["path"], F.lit(" "), y["content_hash"], F.lit("\n")))
    group = F.substring(F.sha2("path", 256), 1, digits).alias("g")
    each = keep.groupBy(group).agg(F.sha2(F.array_join(lines(F.collect_list(F.struct("path", "content_hash"))), ""), 256).alias("h"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: F.concat(x["g"], x["h"])), "")
    return each.agg(F.substring(F.sha2(whole, 256), 1, 16).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_sources"))


# The digest tree


def digest_tree(source: DataFrame, digits: int = 4) -> DataFrame:
    """(level, prefix, digest, n), written: a tree over the sources by the hexadecimal digits of their path's SHA-256.

    A leaf, at level ``digits``, adds up two numbers of each source's digest, so
    nothing is gathered however many it holds; a node above digests its
    children, sixteen at most. Level 0 names the whole. Sources that stand
    twice count twice.
    """
    line = F.sha2(F.concat_ws(" ", F.col("path"), F.coalesce("content_hash", F.lit(""))), 256)
    number = lambda at: F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(20,0)")
    leaves = source.groupBy(F.substring(F.sha2("path", 256), 1, digits).alias("prefix")).agg(F.sum(number(1)).alias("a"), F.sum(number(16)).alias("b"), F.count("*").alias("n"))
    said = F.concat_ws(":", *[F.col(c).cast("string") for c in ("a", "b", "n")])
    level = materialize(leaves.select("prefix", F.sha2(said, 256).alias("digest"), "n"), "digest-leaves")
    out = level.select(F.lit(digits).alias("level"), "prefix", "digest", "n")
    for i in range(digits - 1, -1, -1):
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], x["digest"])), ",")
        level = level.groupBy(F.substring("prefix", 1, i).alias("prefix")).agg(F.sha2(children, 256).alias("digest"), F.sum("n").alias("n"))
        out = out.unionByName(level.select(F.lit(i).alias("level"), "prefix", "digest", "n"))
    return materialize(out, "digest-tree")


def corpus_difference(mine: DataFrame, theirs: DataFrame, my_tree: DataFrame | None = None, their_tree: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """(path, change, mine, theirs): what two corpora have differently, ``added`` and ``removed`` as seen from ``mine``.

    Given their stored :func:`digest_tree`, only branches whose digests differ
    are walked, and only sources below leaves that differ are compared.
    Paths are taken to stand once in a corpus.
    """
    my_tree = digest_tree(mine, digits) if my_tree is None else my_tree
    their_tree = digest_tree(theirs, digits) if their_tree is None else their_tree
    spark = mine.sparkSession
    open_ = materialize(spark.range(1).select(F.lit("").alias("prefix")), "digest-open")
    for i in range(digits + 1):
        at = lambda tree: tree.where(F.col("level") == i).select("prefix", "digest").join(broadcast_if_small(open_.withColumnRenamed("prefix", "_p"), BROADCAST_BRANCHES), F.substring("prefix", 1, max(i - 1, 0)) == F.col("_p"), "left_semi")  # noqa: B023, E731
        both = at(my_tree).join(at(their_tree).withColumnRenamed("digest", "_other"), "prefix", "full_outer")
        open_ = materialize(both.where(~F.col("digest").eqNullSafe(F.col("_other"))).select("prefix"), "digest-open")
    leaves = broadcast_if_small(open_, BROADCAST_BRANCHES)
    below = lambda s: s.select("path", "content_hash").join(leaves, F.substring(F.sha2("path", 256), 1, digits) == F.col("prefix"), "left_semi")
    both = below(mine).withColumnRenamed("content_hash", "mine").join(below(theirs).withColumnRenamed("content_hash", "theirs"), "path", "full_outer")
    change = F.when(F.col("mine").isNull(), "added").when(F.col("theirs").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("mine").eqNullSafe(F.col("theirs"))).select("path", change.alias("change"), "mine", "theirs")


# The high-water mark


def new_since(rows: DataFrame, mark: tuple[str, int] | None, project: str, seq: str = "rcvid") -> tuple[DataFrame, bool]:
    """Rows received after ``mark``, and whether the run is incremental.

    No mark, or one of another project, makes a full pass.  An incremental run
    has no authority to retire anything.
    """
    if mark is None or mark[0] != project:
        return rows, False
    return rows.where(F.col(seq) > mark[1]), True


def next_mark(rows: DataFrame, mark: tuple[str, int] | None, project: str, seq: str = "rcvid") -> tuple[str, int]:
    """The mark to write after the run's commit; it never goes back within a project."""
    top = rows.agg(F.coalesce(F.max(seq), F.lit(0)).cast("long")).first()[0]
    return project, max(top, mark[1] if mark and mark[0] == project else 0)


def parse_mark(line: str) -> tuple[str, int] | None:
    m = re.fullmatch(r"\s*(\S+)\s+(\d+)\s*", line)
    return (m[1], int(m[2])) if m else None


def empty(spark: SparkSession, schema) -> DataFrame:
    """A table without rows, which the planner knows, so that a join with it shuffles nothing."""
    return spark.createDataFrame([], schema).where("false")
