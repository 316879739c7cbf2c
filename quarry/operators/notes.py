"""Structured notes: an append-only log of capture blocks and field events, and its projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import KEY_SIZES, duration_py, ere, iso_plus, normalize_key_py
from quarry.schema import NOTE, NOTE_FIELDS, NOTE_TYPES
from quarry.session import ship
from quarry.storage import reached

#: Field lines of a block and the column each one sets.
LINES = {"note": "note_id", "at": "ts", "type": "type", "place": "place", "who": "who", "due": "due", "state": "state", "closes": "closes", "claimed": "claimed", "lease": "lease", "challenge": "challenge", "stolen-from": "stolen_from"}
TEXT_BYTES = 1023
#: Parsed notes that a worker hands over at once.
ROWS_AT_ONCE = 5000
EVENT = "note_id string, field string, value string, seq long, ts string"


class Refused(Exception):
    """A change that the rules of claims don't allow."""


# Capture and projection


def note_id(now: str) -> str:
    """The time without punctuation: ``YYYYMMDD-HHMMSS-micros``."""
    d, t = now.split("T")
    return f"{d.replace('-', '')}-{t[:8].replace(':', '')}-{(t[9:15] or '0').ljust(6, '0').rstrip('Z')}"


def capture_block(text: str, now: str, **fields: str | None) -> str:
    """The block to append to the month's file; a task without a state is open."""
    if not text:
        raise Refused("empty text")
    if not fields.get("state") and fields.get("type") == "task":
        fields["state"] = "open"
    head = [f"@note {note_id(now)}", f"@at {now}"] + [f"@{k} {fields[k]}" for k in ("type", "place", "who", "due", "state") if fields.get(k)]
    return "\n".join([*head, text, "", ""])


def parse_blocks(text: str, path: str) -> list[dict]:
    """The notes of a capture file in order.

    ``@key value`` lines set fields; a blank line or a new ``@note`` ends a
    block; other lines join to the text.  The data model's text holds
    ``TEXT_BYTES`` bytes, and what goes beyond is cut, as notes are one line.
    Blocks without an id are dropped.
    """
    out, cur = [], {}

    def flush() -> None:
        nonlocal cur
        if cur.get("note_id"):
            out.append({f: cur.get(f, "") for f in NOTE_FIELDS} | {"source_path": path})
        cur = {}

    for line in text.split("\n"):
        line = line.rstrip("\r")
        if line.startswith("@"):
            key, _, value = line[1:].partition(" ")
            if key == "note":
                flush()
            if column := LINES.get(key):
                cur[column] = normalize_key_py(value, KEY_SIZES[column]) if column in KEY_SIZES else value
        elif not line:
            flush()
        elif cur.get("note_id"):
            joined = f"{cur['text']} {line}" if cur.get("text") else line
            cur["text"] = joined.encode()[:TEXT_BYTES].decode("utf-8", "ignore")
    flush()
    return out


def project(files: DataFrame) -> DataFrame:
    """Notes of capture files (path, text), with their place as ``seq``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=[*NOTE_FIELDS, "seq"])
        for b in batches:
            rows = []  # a frame for each file would cost more than its parsing
            for path, text in zip(b["path"], b["text"], strict=True):
                rows += [r | {"seq": i} for i, r in enumerate(parse_blocks(text or "", path))]
                if len(rows) >= ROWS_AT_ONCE:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    schema = ", ".join(f"{f} string" for f in NOTE_FIELDS) + ", seq int"
    return files.select("path", "text").mapInPandas(run, schema)


def one_each(parsed: DataFrame) -> DataFrame:
    """The last block of each id, by path and place."""
    w = Window.partitionBy("note_id").orderBy(F.desc("source_path"), F.desc("seq"))
    return parsed.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*NOTE_FIELDS)


def duplicate_ids(parsed: DataFrame) -> DataFrame:
    """Ids of several blocks, of which all but one are lost."""
    return parsed.groupBy("note_id").agg(F.count("*").alias("blocks"), F.sort_array(F.collect_set("source_path")).alias("paths")).where("blocks > 1")


def unknown_types(notes: DataFrame) -> DataFrame:
    """Types outside the vocabulary; they are kept, and reported here."""
    return notes.where((F.col("type") != "") & ~F.col("type").isin(NOTE_TYPES)).groupBy("type").agg(F.count("*").alias("n"))


# Queries


def query(notes: DataFrame, now: str, place: str = "", type: str = "", state: str = "", who: str = "", since: str = "", grep: str = "", closes: str = "", unclaimed: bool = False, stale: bool = False, stale_after: str = "1d", pending: bool = False, last: bool = False, most: int | None = 50) -> DataFrame:
    """Notes by the given filters, an empty one being none; newest first, pending ones oldest first.

    ``most`` is the reader's page, 0 its default of 50; None gives all rows.  A claim is stale when its lease is over, or when it has no lease and is
    older than ``stale_after``; one without a claim time is undecided and never
    stale.
    """
    out = notes
    for column, value in (("place", place), ("type", type), ("state", state), ("who", who)):
        if key := normalize_key_py(value, KEY_SIZES[column]):
            out = out.where(F.col(column) == key)
    if since:
        out = out.where(F.col("ts") >= since)
    if grep:
        out = out.where(F.col("text").rlike(ere(grep)))
    if closes:
        out = out.where(F.col("closes") == closes)
    if unclaimed:
        out = out.where(F.coalesce("who", F.lit("")) == "")
    if pending:
        out = out.where(F.coalesce("type", F.lit("")) == "")
    if stale:
        edge = iso_plus(now, -(duration_py(stale_after) or 86400))
        lease, claimed = F.coalesce("lease", F.lit("")), F.coalesce("claimed", F.lit(""))
        over = ((lease != "") & (lease < now)) | ((lease == "") & (claimed != "") & (claimed < edge))
        out = out.where((F.coalesce("who", F.lit("")) != "") & over)
    order = [F.asc("ts") if pending else F.desc("ts"), F.col("note_id")]
    out = out.orderBy(*order)
    return out if most is None and not last else out.limit(1 if last else most if most and most > 0 else 50)


def pending(notes: DataFrame, now: str, most: int = 100) -> DataFrame:
    """Captures that await structure, oldest first."""
    return query(notes, now, pending=True, most=most)


def closing_chain(notes: DataFrame, start: str) -> DataFrame:
    """(note_id, depth): what ``start`` closes, what that closes and so on; loops end."""
    edges = notes.where(F.col("closes") != "").select(F.col("note_id").alias("src"), F.col("closes").alias("dst"))
    return reached(edges, start).withColumnRenamed("node", "note_id")


# Field events and claims


def structured(notes: DataFrame, events: DataFrame) -> DataFrame:
    """``notes`` with the latest event of each field put in; '' deletes a value, null never happens."""
    now = events.groupBy("note_id").pivot("field", [f for f in NOTE_FIELDS if f not in ("note_id", "ts", "text", "source_path")]).agg(F.max_by("value", "seq"))
    fields = [c for c in now.columns if c != "note_id"]
    joined = notes.alias("n").join(now.alias("e"), "note_id", "left")
    return joined.select(*[F.coalesce(F.col(f"e.{f}"), F.col(f"n.{f}")).alias(f) if f in fields else F.col("note_id") if f == "note_id" else F.col(f"n.{f}") for f in NOTE_FIELDS])


@dataclass
class Claim:
    """Who holds a note, as the projection tells it."""

    who: str = ""
    claimed: str = ""
    lease: str = ""
    challenge: str = ""
    stolen_from: str = ""

    def live(self, now: str) -> bool:
        return bool(self.lease) and now < self.lease


def claim_of(notes: DataFrame, note_id: str) -> Claim:
    row = notes.where(F.col("note_id") == note_id).select("who", "claimed", "lease", "challenge", "stolen_from").first()
    if row is None:
        raise Refused(f"no note {note_id}")
    return Claim(*[x or "" for x in row])


def take(c: Claim, who: str, now: str, lease: str = "", force: bool = False) -> dict[str, str]:
    """Set the holder; only ``force`` displaces another one.  An empty ``who`` releases the claim whole."""
    if not who:
        return {"who": "", "claimed": "", "lease": "", "challenge": "", "stolen_from": ""}
    if c.who and c.who != who and not force:
        raise Refused(f"held by {c.who}" + (f" until {c.lease}" if c.lease else ""))
    out = {"who": who, "claimed": now}
    if lease:
        if not duration_py(lease):
            raise Refused(f"no duration: {lease}")
        out["lease"] = iso_plus(now, duration_py(lease))
    return out


def heartbeat(c: Claim, now: str, lease: str = "") -> dict[str, str]:
    """The holder is still there: the claim is renewed and a challenge answered."""
    if not c.who:
        raise Refused("nobody holds it")
    return {"claimed": now, "challenge": ""} | ({"lease": iso_plus(now, duration_py(lease))} if duration_py(lease) else {})


def challenge(c: Claim, by: str, now: str) -> dict[str, str]:
    """Ask the holder to answer; a live lease refuses."""
    if not c.who:
        raise Refused("unclaimed: take it instead")
    if c.live(now):
        raise Refused(f"live lease until {c.lease}")
    return {"challenge": f"{by} {now}"}


def steal(c: Claim, by: str, now: str, grace: str = "60s", lease: str = "") -> dict[str, str]:
    """Take over after an unanswered challenge older than ``grace``; a future challenge refuses."""
    if not c.who:
        raise Refused("unclaimed: take it instead")
    if c.live(now):
        raise Refused(f"live lease until {c.lease}")
    if not c.challenge:
        raise Refused("no challenge on record")
    when = c.challenge.split(" ")[-1]
    if when > now:
        raise Refused("the challenge is in the future")
    if when > iso_plus(now, -(duration_py(grace) or 60)):
        raise Refused("the challenge is too young")
    out = {"who": by, "claimed": now, "challenge": "", "stolen_from": c.who}
    return out | ({"lease": iso_plus(now, duration_py(lease))} if duration_py(lease) else {})


def events_of(spark: SparkSession, note_id: str, fields: dict[str, str], seq: int, now: str) -> DataFrame:
    """Field events to append; closing another note closes that one in the same batch."""
    rows = [(note_id, f, v, seq, now) for f, v in fields.items()]
    if fields.get("closes"):
        rows.append((fields["closes"], "state", "closed", seq, now))
    return spark.createDataFrame(rows, EVENT)


def empty_notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NOTE)
