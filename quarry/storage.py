"""Shared folder, written intermediate tables and distributed running totals."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys or hashes of keys that several rows have are broadcast up to this many (100 bytes each at most), else joined by a shuffle.
BROADCAST_KEYS = 300_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset, a local
    master gets a temporary folder of its own and any other master a folder
    under the warehouse, unless that is local to each machine, which is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if fs.getUri().getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            _own[app] = fs.makeQualified(path).toString().rstrip("/") + "/quarry-shared"
    return _own[app]


#: The open recordings of this thread of control, so that runs beside each other keep theirs apart.
_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for r in _recorders.get():
        r.append(path)
    if spark.sparkContext.applicationId not in _cleaned:
        _cleaned.add(spark.sparkContext.applicationId)
        atexit.register(_at_exit, spark)
    return path


_cleaned: set[str] = set()


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        cleanup(spark)


@contextmanager
def recording():
    """Collects the paths that :func:`new_path` gives out meanwhile, to :func:`delete` them later."""
    paths: list[str] = []
    token = _recorders.set((*_recorders.get(), paths))
    try:
        yield paths
    finally:
        _recorders.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every intermediate table that this application wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs no more than the tasks that
    ran on it, and later readers prune columns and push filters down.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.format(fmt).options(**options).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_splits(spark: SparkSession, size: int):
    """Deal files of ``size`` bytes at most to each task of what runs meanwhile, as far as their row groups allow."""
    return _setting(spark, "spark.sql.files.maxPartitionBytes", str(size))


def small_batches(spark: SparkSession, rows: int = 500):
    """Hand Python workers at most ``rows`` rows at once in what runs meanwhile.

    Documents may be long; Spark's default of 10,000 rows would let one batch
    outgrow a worker.
    """
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows, else leave it alone.

    ``df`` should be cheap to count: a written table or an aggregate of one.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def distinct_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ``df`` for each value of ``keys``, null being one; the rows of a key should be alike.

    Hashes of the keys alone are counted by a shuffle, 8 bytes for each. Whole
    rows are shuffled only of hashes that several rows have, so long texts that
    stand once stay where they are; there the keys themselves decide.
    """
    key = F.xxhash64(*keys)
    several = materialize(df.groupBy(key.alias("_hash")).agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"), "repeated-keys")
    if several.isEmpty():
        return df
    several = broadcast_if_small(several, BROADCAST_KEYS)
    on = key == F.col("_hash")
    return df.join(several, on, "left_anti").unionByName(df.join(several, on, "left_semi").dropDuplicates(keys))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Lambda variables are bound by value, so ``body`` may use it any number of
    times, also inside other lambdas, without evaluating it again.
    """
    return F.transform(F.array(value), body)[0]


def ranged(df: DataFrame, keys: list[str | Column], name: str, pid: str = "_pid") -> DataFrame:
    """``df`` range-partitioned by ``keys``, with the partition number as column ``pid``, written."""
    return materialize(df.repartitionByRange(*keys).withColumn(pid, F.spark_partition_id()), name)


def running_total(df: DataFrame, values: dict[str, Column], keys: list, pid: str = "_pid", within: list[str] | None = None) -> DataFrame:
    """Add exclusive running totals over the global order ``keys`` of a :func:`ranged` table.

    Each partition is summed on its own; the per-partition totals, one row per
    partition, are prefix-summed and added back.  No task sees more than one
    range partition.

    ``values`` maps each new column to the long or decimal expression it sums.
    ``within`` starts the totals anew for each value of those columns, which
    must lead ``keys``.
    """
    within = within or []
    if within:
        start = _carried(df, values, pid, within)
    else:
        part = df.groupBy(pid).agg(*[F.sum(v).alias(f"_t_{c}") for c, v in values.items()])
        before = Window.partitionBy(F.lit(0)).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
        start = part.select(F.col(pid).alias("_p"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in values])
    on = F.col(pid) == F.col("_p")
    for i, c in enumerate(within):
        on = on & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    rows = Window.partitionBy(pid, *within).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.coalesce(F.sum(v).over(rows), F.lit(0)).alias(f"_l_{c}") for c, v in values.items()])
    out = local.join(F.broadcast(start), on, "left")
    keep = [F.col(c) for c in df.columns]
    return out.select(*keep, *[(F.col(f"_l_{c}") + F.coalesce(f"_s_{c}", F.lit(0))).alias(c) for c in values])


def _carried(df: DataFrame, values: dict[str, Column], pid: str, within: list[str]) -> DataFrame:
    """(_p, _w0.., _s_*): what earlier partitions hold of the group that each range partition begins with.

    Only a partition's last group can go on in the next one, so one row for
    each partition is enough, however many groups there are.
    """
    ends = df.groupBy(F.col(pid).alias("_p")).agg(F.min(F.struct(*within)).alias("_lo"), F.max(F.struct(*within)).alias("_hi"))
    ends = materialize(ends, "range-ends")
    totals = [F.sum(v).alias(f"_t_{c}") for c, v in values.items()]
    last = df.join(F.broadcast(ends), (F.col(pid) == F.col("_p")) & F.struct(*within).eqNullSafe(F.col("_hi"))).groupBy("_p").agg(F.first("_hi").alias("_w"), *totals)
    asked = ends.select("_p", F.col("_lo").alias("_w"), F.lit(0).alias("_k"))
    held = last.withColumn("_k", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    before = Window.partitionBy("_w").orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, -1)
    summed = held.select("_p", "_w", "_k", *[F.sum(f"_t_{c}").over(before).alias(f"_s_{c}") for c in values])
    return summed.where("_k = 0").select("_p", *[F.col("_w")[c].alias(f"_w{i}") for i, c in enumerate(within)], *[f"_s_{c}" for c in values])


def reached(edges: DataFrame, start: str) -> DataFrame:
    """(node, depth): all that edges (src, dst) reach from ``start``, itself at 0, by the fewest steps.

    Each round joins the distinct new nodes with the edges and leaves out what
    was reached before, so loops end and paths that meet again don't multiply.
    """
    edges = materialize(edges.select("src", "dst").where("src is not null and dst is not null"), "reached-edges")
    done = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("depth"))
    done = front = materialize(done, "reached")
    depth = 0
    while True:
        depth += 1
        near = edges.join(broadcast_if_small(front.select(F.col("node").alias("src")), 100_000), "src").select(F.col("dst").alias("node")).distinct()
        front = materialize(near.join(done, "node", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if front.isEmpty():
            return done
        done = done.unionByName(front)
