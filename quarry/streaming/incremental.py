"""Incremental ingest as a stream: new rows are upserted, nothing is ever retired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import ingest
from quarry.plans.index import index
from quarry.plans.store import Store
from quarry.schema import NO_MODEL


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over Parquet files of (path, text, mtime, rcvid) that land in ``folder``."""
    return spark.readStream.schema("path string, text string, mtime long, rcvid long").parquet(folder)


def ingest_stream(rows: DataFrame, store: Store, checkpoint: str, project: str, embed=None, model_id: str = NO_MODEL):
    """Write each micro-batch into the store as an incremental run.

    Within a batch the highest ``rcvid`` of a path wins.  The mark only rises,
    and rows at or below it are skipped, so a batch that is replayed after a
    failure changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        mark = store.pointer()["mark"]
        mark = tuple(mark) if mark else None
        fresh, _ = ingest.new_since(batch, mark, project)
        newest = ingest.latest(fresh, ["path"], [F.desc("rcvid")])
        if newest.isEmpty():
            return
        index(store, newest.drop("rcvid"), set(), embed=embed, model_id=model_id, incremental=True, mark=ingest.next_mark(fresh, mark, project))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lapsed(claims: DataFrame, ticks: DataFrame) -> DataFrame:
    """(note_id, who, lease, now): leases that are over at each tick of a stream of (now)."""
    held = claims.where((F.coalesce("who", F.lit("")) != "") & (F.coalesce("lease", F.lit("")) != ""))
    return ticks.join(held.select("note_id", "who", "lease"), F.col("lease") < F.col("now")).select("note_id", "who", "lease", "now")
