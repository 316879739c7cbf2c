"""The versioned store: immutable Parquet folders and a log whose newest entry names the current ones.

An entry lists the folders of each table, so a commit writes only what it
changes: a replaced table gets one new folder, an appended one a further
folder, and all others keep theirs.  Entries are numbered and created
exclusively, after the data, so readers see the old tables or the new ones, a
failed run leaves only unreferenced folders, and of two commits on one state
the later one sees the other's: it goes on if that left its tables alone and is
refused if not.

``source``, and ``ref`` that turns it round, are dealt to buckets by their
key's hash, and the entry names the folders of each bucket one by one: a base
and deltas on it, of which the newest row of a key counts.  A commit that merges
rows in writes a delta for the buckets that it touches and reads no other.  The
deltas of a bucket become one when there are many, and a new base when they
have grown as large as that, so what a commit writes goes with its rows and not
with the store.

Contents that no path has any more are told by ``dead`` and left out on
reading; the next full run drops their chunks, postings and words.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quarry.operators.ingest import empty
from quarry.schema import CHUNK, DEAD, GRAMS, NOTE, NOTE_EVENT, POSTING, REF, SOURCE, STAT, WORD
from quarry.storage import broadcast_if_small, materialize, small_splits

TABLES = {"chunk": CHUNK, "source": SOURCE, "note": NOTE, "note_event": NOTE_EVENT, "posting": POSTING, "word": WORD, "gram": GRAMS, "stat": STAT}
#: Tables that are looked up by these columns are written in their order, so that a filter skips files and row groups.
SORTED = {"chunk": ["content_hash", "chunk_ix"]}
#: Tables of a row for each word of a chunk or gram of a word: each task writes a segment of the chunks or words that it
#: reads, in the order of these columns, so that no such row is shuffled and the few contents of a segment stand once in
#: its dictionary.
SEGMENTS = {"posting": ["term", "content_hash"], "word": ["word", "content_hash"], "gram": ["gram", "word"]}
#: Bytes of chunks in a segment, and of their row groups.
SEGMENT = 4 << 20
OPTIONS = {"compression": "zstd", "parquet.block.size": str(SEGMENT)}
#: Tables that other tables' keys lead to; a snapshot makes its own.
INTERNAL = {"ref": REF, "dead": DEAD}
#: Bucketed tables: by which column a row's bucket is told, and of which columns one row counts.
KEYED = {"source": ("path", ["path"]), "ref": ("content_hash", ["content_hash", "path"])}
#: Tables of contents, from which :data:`DEAD` takes away.
OF_CONTENTS = ("chunk", "posting", "word")
RECIPE = 3
#: A table of more folders is put together by the next commit that appends to it.
FOLDERS = 50
#: Buckets of a keyed table, and deltas of one that become one.
BUCKETS, DELTAS = 64, 16
#: Withdrawn contents are broadcast up to this many (64 bytes each), else joined by a shuffle.
BROADCAST_DEAD = 200_000


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def bucket_in(folder: str) -> int:
    return int(folder.rsplit("=", 1)[1])


def is_delta(folder: str) -> bool:
    return "-delta/" in folder


def newest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of each key with the highest ``seq``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).where("_n = 1").drop("_n")


class Conflict(Exception):
    """Another commit changed a table that this one read or writes."""


class Store:
    """``stemmed`` tells how the keyword tables are cut: into stems or into plain words, the same in every run."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = True):
        self.spark, self.path, self.stemmed = spark, path.rstrip("/"), stemmed

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _log(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_log")
        return sorted(int(n[:-5]) for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()) if fs.exists(p) else []

    def _entry(self, n: int) -> str:
        return f"{self.path}/_log/{n:012d}.json"

    def _publish(self, n: int, text: str) -> bool:
        """Create entry ``n`` whole; false if it is there already."""
        fs, p = self._fs(self._entry(n))
        _, tmp = self._fs(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.getUri().getScheme() == "file":  # its rename looks first and then moves; a link is one step
            try:
                os.link(tmp.toUri().getPath(), p.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(tmp, False)
        jvm = self.spark._jvm
        how = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(tmp), context.makeQualified(p), how)
            return True
        except Exception:
            if fs.exists(p):
                fs.delete(tmp, False)
                return False
            raise

    def pointer(self) -> dict:
        """The newest entry: version, number, recipe, mark and the folders of each table."""
        log = self._log()
        if not log:
            return {"version": None, "number": 0, "recipe": RECIPE, "mark": None, "tables": {}}
        return json.loads(self.spark.read.text(self._entry(log[-1]), wholetext=True).first()[0])

    def read(self, table: str, at: dict | None = None) -> DataFrame:
        """A table as the entry ``at`` has it, the newest by default."""
        at = at or self.pointer()
        if table in KEYED:
            return self.merged(table, at)
        rows = self._appended(table, at)
        if table in OF_CONTENTS and at["tables"].get("dead"):
            rows = rows.join(broadcast_if_small(self.dead(at), BROADCAST_DEAD), "content_hash", "left_anti")
        return rows

    def _schema(self, table: str) -> StructType:
        return (TABLES | INTERNAL)[table]

    def _appended(self, table: str, at: dict) -> DataFrame:
        """The rows of all folders, of withdrawn contents too."""
        schema, folders = self._schema(table), at["tables"].get(table, [])
        if not folders:
            return empty(self.spark, schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in folders])

    def dead(self, at: dict) -> DataFrame:
        """(content_hash) of the contents that no path has."""
        return newest(self._appended("dead", at), ["content_hash"]).where("gone").select("content_hash")

    def _kept(self, table: str, folders: list[str]) -> DataFrame:
        """The stored rows of a keyed table's folders."""
        schema = StructType([*self._schema(table).fields, StructField("seq", LongType()), StructField("gone", BooleanType())])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else empty(self.spark, schema)

    def merged(self, table: str, at: dict, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a keyed table that count, of some buckets only or of all; buckets without deltas are read as they are."""
        of: dict[int, list[str]] = {}
        for f in at["tables"].get(table, []):
            if buckets is None or bucket_in(f) in buckets:
                of.setdefault(bucket_in(f), []).append(f)
        plain = [f for fs in of.values() if len(fs) == 1 for f in fs]
        mixed = [f for fs in of.values() if len(fs) > 1 for f in fs]
        rows = self._kept(table, plain)
        if mixed:
            rows = rows.unionByName(newest(self._kept(table, mixed), KEYED[table][1]))
        return rows.where("not gone").select(*self._schema(table).fieldNames())

    def notes(self, at: dict | None = None) -> DataFrame:
        """The captured notes with their field events put in."""
        from quarry.operators.notes import structured

        at = at or self.pointer()
        return structured(self.read("note", at), self.read("note_event", at))

    def _write(self, version: str, name: str, df: DataFrame) -> list[str]:
        out = df.select(*self._schema(name).fieldNames())
        if name in KEYED:
            return self._write_buckets(version, name, out.withColumns({"seq": F.lit(0).cast("long"), "gone": F.lit(False)}))
        if name in SORTED:
            out = out.repartitionByRange(*SORTED[name]).sortWithinPartitions(*SORTED[name])
        if name in SEGMENTS:
            out = out.sortWithinPartitions(*SEGMENTS[name])
        folder = f"{version}/{name}"
        write = out.write.options(**OPTIONS)
        with small_splits(self.spark, SEGMENT):
            (write.partitionBy("model_id") if name == "chunk" else write).parquet(f"{self.path}/{folder}")
        return [folder]

    def _write_buckets(self, version: str, name: str, rows: DataFrame, delta: bool = False) -> list[str]:
        """Write stored rows by bucket and give the folders that came of it."""
        key = KEYED[name][0]
        folder = f"{version}/{name}-delta" if delta else f"{version}/{name}"
        rows.withColumn("bucket", bucket_of(key)).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(f"{folder}/{n}" for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("bucket="))

    def _bytes(self, folder: str) -> int:
        fs, p = self._fs(f"{self.path}/{folder}")
        return fs.getContentSummary(p).getLength()

    def _merge(self, version: str, name: str, rows: DataFrame, number: int, before: list[str]) -> list[str]:
        """The folders of a keyed table after ``rows`` (with ``gone``) are merged in; touched buckets with many deltas are put together."""
        rows = rows.select(*self._schema(name).fieldNames(), F.lit(number).cast("long").alias("seq"), "gone")
        fresh = self._write_buckets(version, name, rows, delta=True)
        after = [*before, *fresh]
        touched = {bucket_in(f) for f in fresh}
        of: dict[int, list[str]] = {}
        for f in after:
            of.setdefault(bucket_in(f), []).append(f)
        full, some = [], []
        for b in sorted(touched):
            deltas, base = [f for f in of[b] if is_delta(f)], [f for f in of[b] if not is_delta(f)]
            if len(deltas) >= DELTAS:
                (full if sum(map(self._bytes, deltas)) >= sum(map(self._bytes, base)) else some).append(b)
        made: list[str] = []
        if full:
            parts = [f for b in full for f in of[b]]
            made += self._write_buckets(f"{version}/full", name, newest(self._kept(name, parts), KEYED[name][1]).where("not gone"))
        if some:
            parts = [f for b in some for f in of[b] if is_delta(f)]
            made += self._write_buckets(f"{version}/some", name, newest(self._kept(name, parts), KEYED[name][1]), delta=True)
        gone = {f for b in full for f in of[b]} | {f for b in some for f in of[b] if is_delta(f)}
        return [f for f in after if f not in gone] + made

    def commit(self, mark: tuple[str, int] | None = None, at: dict | None = None, reads: tuple[str, ...] = (), append: dict[str, DataFrame] | None = None, merge: dict[str, DataFrame] | None = None, **tables: DataFrame) -> str:
        """Write ``tables`` anew, ``append`` to others and ``merge`` rows into keyed ones, then publish; tables left out stay as they are.

        ``at`` is the entry that the caller worked on.  If a later one changed
        a table that is written here or named in ``reads``, :class:`Conflict` is
        raised and nothing is published.  Rows to merge have a column ``gone``
        that takes their key away.
        """
        at = at or self.pointer()
        append, merge = dict(append or {}), merge or {}
        for name in [n for n in append if len(at["tables"].get(n, [])) >= FOLDERS]:
            tables[name] = self._appended(name, at).unionByName(append.pop(name).select(*self._schema(name).fieldNames()))
        version = f"v={at['number'] + 1:06d}-{uuid.uuid4().hex[:8]}"
        if "source" in tables:
            tables["source"] = materialize(tables["source"].select(*SOURCE.fieldNames()), "store-source")
            tables.setdefault("ref", tables["source"].select("content_hash", "path"))
        folders = {name: self._write(version, name, df) for name, df in tables.items()}
        folders |= {name: [*at["tables"].get(name, []), *self._write(version, name, df)] for name, df in append.items()}
        folders |= {name: self._merge(version, name, df, at["number"] + 1, at["tables"].get(name, [])) for name, df in merge.items()}
        while True:
            now = self.pointer()
            changed = sorted(t for t in {*folders, *reads} if now["tables"].get(t) != at["tables"].get(t))
            if changed:
                raise Conflict(f"changed meanwhile: {', '.join(changed)}")
            entry = {"version": version, "number": now["number"] + 1, "recipe": RECIPE, "mark": mark if mark is not None else now["mark"], "tables": now["tables"] | folders}
            if self._publish(entry["number"], json.dumps(entry)):
                return version

    def snapshot(self) -> dict[str, DataFrame]:
        """All tables of one version; later commits don't touch them."""
        at = self.pointer()
        return {t: self.read(t, at) for t in TABLES}

    def drop_old(self, keep: int = 2) -> list[str]:
        """Delete all but the newest ``keep`` entries, and the version folders that none of these names."""
        log = self._log()
        fs, p = self._fs(self.path)
        kept = [json.loads(self.spark.read.text(self._entry(n), wholetext=True).first()[0]) for n in log[-keep:]]
        used = {f.split("/")[0] for e in kept for fs_ in e["tables"].values() for f in fs_}
        # Folders of commits that are still being written have higher numbers than any entry.
        top = log[-1] if log else 0
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("v="))
        gone = [n for n in names if n not in used and int(n[2:].split("-")[0]) <= top]
        for n in log[:-keep]:
            fs.delete(self._fs(self._entry(n))[1], False)
        for n in gone:
            fs.delete(self._fs(f"{self.path}/{n}")[1], True)
        return gone


def checked_copy(spark: SparkSession, source: str, target: str, sha256: str | None = None) -> bool:
    """Copy a file and tell whether its bytes have the digest; a wrong copy is removed."""
    from pyspark.sql import functions as F

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    got = spark.read.format("binaryFile").load(target).select(F.sha2("content", 256)).first()[0]
    if sha256 is not None and got != sha256:
        b.getFileSystem(conf).delete(b, False)
        return False
    return True


def publish_model(spark: SparkSession, files: dict[str, str], manifest: dict, target: str) -> bool:
    """Blobs first and the manifest last; nothing is done if the same manifest is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{target}/manifest.json")
    fs = at.getFileSystem(conf)
    text = json.dumps(manifest, sort_keys=True)
    if fs.exists(at) and spark.read.text(at.toString(), wholetext=True).first()[0] == text:
        return False
    for name, path in files.items():
        if not checked_copy(spark, path, f"{target}/{name}", manifest.get("sha256", {}).get(name)):
            raise OSError(f"{name} does not have the manifest's digest")
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    return True
