"""Leases on notes as a stream: each has a timer, and one row tells that it is over."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from quarry.session import ship
from quarry.storage import new_path

#: How late an event may come.
DELAY = "1 hour"
EXPIRED = "note_id string, who string, claimed timestamp, lease timestamp"
STATE = "at long, seq long, who string, claimed long, lease long"


class Leases(StatefulProcessor):
    """A note's holder and lease; times in the state are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", STATE)

    def _timer(self, lease: int) -> int:
        return -(-lease // 1000)

    def _row(self, key: tuple, state: Row) -> Row:
        return Row(note_id=key[0], who=state.who, claimed=_time(state.claimed), lease=_time(state.lease))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        state = Row(**dict(zip(("at", "seq", "who", "claimed", "lease"), self.held.get(), strict=True))) if self.held.exists() else None
        timer = self._timer(state.lease) if state and state.who else None
        for r in sorted(rows, key=lambda r: (r.at_us, r.seq)):
            if state and (r.at_us, r.seq) <= (state.at, state.seq):
                continue  # one that came again, or after a newer one
            if state and state.who and state.lease < r.at_us:
                yield self._row(key, state)
                state = None
            who = r.who if r.lease_us is not None else ""
            same = state and state.who == who
            state = Row(at=r.at_us, seq=r.seq, who=who, claimed=state.claimed if same else r.at_us, lease=r.lease_us or 0)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if state:
            self.held.update(tuple(state))
            if state.who:
                self.handle.registerTimer(self._timer(state.lease))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        at, seq, who, claimed, lease = self.held.get()
        yield self._row(key, Row(at=at, seq=seq, who=who, claimed=claimed, lease=lease))
        # The last event stays known, so that one which comes again claims nothing.
        self.held.update((at, seq, "", 0, 0))

    def close(self) -> None:
        pass


def _time(us: int):
    from datetime import datetime, timedelta, timezone

    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def expiries(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """(note_id, who, claimed, lease): each lease that ran out, once.

    ``events`` is a stream of (note_id, who, lease, at, seq): at time ``at``
    the note's lease became ``lease``, which moves its timer; a null lease or an
    empty ``who`` gives the note up. Events of equal time are ordered by
    ``seq``. A lease is over if no event of its note comes by its end: at once
    if a later event shows it, else when the watermark, ``delay`` behind the
    newest event, has passed it. An event that comes again or after a newer one
    of its note changes nothing. Whatever the micro-batches, the rows are the
    same, as long as no event is later than ``delay``.

    A note's events of one micro-batch are put in order in memory; the source's
    ``maxFilesPerTrigger`` bounds them. Needs the RocksDB state store, see
    :func:`rocksdb`.
    """
    ship(events.sparkSession)
    us = lambda c: F.unix_micros(c).alias(f"{c}_us")
    lean = events.select("note_id", F.coalesce("who", F.lit("")).alias("who"), us("lease"), "at", us("at"), F.col("seq").cast("long").alias("seq")).where("note_id is not null and at is not null")
    return lean.withWatermark("at", delay).groupBy("note_id").transformWithState(statefulProcessor=Leases(), outputStructType=EXPIRED, outputMode="Append", timeMode="EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start meanwhile keep their state in RocksDB, which timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def run_once(spark: SparkSession, expired: DataFrame, target: str | None = None, checkpoint: str | None = None) -> str:
    """Write what :func:`expiries` finds in all that is there now, below the shared folder by default, and give the target.

    A run with the same checkpoint goes on where the last one stopped.
    """
    target, checkpoint = target or new_path(spark, "expired"), checkpoint or new_path(spark, "expired-state")
    with rocksdb(spark):
        stream = expired.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        stream.awaitTermination()
    return target
