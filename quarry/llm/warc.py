"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The reader walks the members of a ``.warc.gz`` (or the records of a ``.warc``)
by their stated lengths.  Where a member does not inflate, a header does not
parse, a length does not fit or a digest differs, it searches for the next
place that starts a valid member or version line, goes on from there and logs
the bytes between as a quarantined gap.

Files are reached through ``pyarrow.fs`` URIs, so the shared folder may be
local, HDFS or an object store.  A task writes one archive under a name of its
own and returns it in a manifest row; only archives in the manifest of
successful tasks are read, so retries leave nothing twice.

Defined cases: a null html is an empty payload; a null page_id is written with
an empty id, is never the target of a revisit that has another choice, and
revisits the largest id of its group; rows that repeat the largest page_id of
their payload are all responses; an empty table writes no archive and gives an
empty result; extra columns are ignored.  Headers, blocks and members may have
any length: they are hashed as they are read, and only the payload cell of a
record beyond ``HOLD`` bytes is null, its digest and length being there.  A
member that doesn't inflate to its end is a gap with all that it holds, as no
digest covers the headers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import ship
from quarry.storage import broadcast_if_small, materialize, new_path, small_batches

VERSION = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads under this many bytes are always stored.
REVISIT_BYTES = 1000
#: Revisits are broadcast up to this many rows (about 40 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Payloads beyond this are checked and measured but not handed out; a Spark cell holds less than 2 GB.
HOLD = 1 << 30
STEP = 1 << 16

MANIFEST = "file string, bytes long, records long"
RECORD = "file string, offset long, record_id string, record_type string, uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"
GAP = "file string, start long, end long, reason string"


def sha1_32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> list[bytes]:
    """The parts of one WARC record; a revisit keeps the HTTP header and the digest and length of its payload."""
    block = [HTTP, payload] if kind == "response" else [HTTP]
    whole = hashlib.sha1()
    for x in block:
        whole.update(x)
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", sha1_32(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", sha1_32(whole.digest())),
        ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(sum(map(len, block))))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return [VERSION + lines.encode() + b"\r\n", *block, b"\r\n\r\n"]


def member(parts: list[bytes], level: int = 3) -> Iterator[bytes]:
    """A gzip member of ``parts``, piece by piece."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    for x in parts:
        yield c.compress(x)
    yield c.flush()


def page_urn(page_id) -> str:
    return "urn:page:" + ("" if page_id is None or pd.isna(page_id) else str(int(page_id)))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of (page_id, url, html) under ``folder``; returns the manifest."""
    ship(pages.sparkSession)
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1("html").alias("digest")
    ids = p.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", digest)
    largest = ids.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1")
    again = materialize(ids.join(largest, "digest").where("not (page_id <=> target)").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "target").where("target is not null").distinct(), "warc-revisits")
    rows = p.join(broadcast_if_small(again, BROADCAST_ROWS), F.col("page_id").eqNullSafe(F.col("p")) & (F.octet_length("html") >= REVISIT_BYTES) & (F.sha1("html") == F.col("d")), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
        for batch in batches:
            for page_id, url, html, target in zip(batch["page_id"], batch["url"], batch["html"], batch["target"], strict=True):
                if out is None:
                    system, at = _filesystem(folder)
                    system.create_dir(at, recursive=True)
                    out = system.open_output_stream(f"{at}/{name}", compression=None)
                payload, uri = html.encode(), url if isinstance(url, str) else ""
                uri = uri.replace("\r", "%0D").replace("\n", "%0A")
                if pd.isna(target):
                    parts = record("response", page_urn(page_id), uri, payload)
                else:
                    parts = record("revisit", page_urn(page_id), uri, payload, page_urn(target))
                for data in member(parts):
                    out.write(data)
                    size += len(data)
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    with small_batches(pages.sparkSession):
        return materialize(rows.select(F.col("page_id").cast("decimal(20,0)").cast("string").alias("page_id"), "url", "html", F.col("target").cast("string").alias("target")).mapInPandas(run, MANIFEST), "warc-manifest")


class Window:
    """Seek and read over a file that has ``seek`` and ``read``, with one buffered block."""

    def __init__(self, raw, block: int = 1 << 20):
        self.raw, self.block, self.start, self.data, self.at = raw, block, 0, b"", 0

    def seek(self, offset: int) -> None:
        self.at = offset

    def read(self, n: int) -> bytes:
        if not self.start <= self.at <= self.at + n <= self.start + len(self.data):
            self.raw.seek(self.at)
            self.start, self.data = self.at, self.raw.read(max(n, self.block))
        out = self.data[self.at - self.start : self.at - self.start + n]
        self.at += len(out)
        return out


class Bad(Exception):
    """A failed check; its text is the reason in the log."""


class Broken(Bad):
    """The gzip member itself can't be read on."""


class Member:
    """Seek and read over the content of the gzip member at ``offset``; ``end`` is the file's offset after it."""

    def __init__(self, f, offset: int):
        self.f, self.offset, self.end, self.at = f, offset, None, 0
        self._restart()

    def _restart(self) -> None:
        self.z, self.taken, self.tail, self.start, self.data = zlib.decompressobj(31), self.offset, b"", 0, bytearray()

    def seek(self, offset: int) -> None:
        self.at = offset
        if offset < self.start:
            self._restart()

    def read(self, n: int) -> bytes:
        while self.start + len(self.data) < self.at + n and not self.z.eof:
            old = min(self.at, self.start + len(self.data)) - STEP - self.start
            if old > STEP:  # what a search may go back to stays
                del self.data[:old]
                self.start += old
            if not self.tail:
                self.f.seek(self.taken)
                self.tail = self.f.read(STEP)
                if not self.tail:
                    raise Broken("member is cut off")
                self.taken += len(self.tail)
            try:
                self.data += self.z.decompress(self.tail, 4 * STEP)
            except zlib.error:
                raise Broken("member does not inflate") from None
            self.tail = self.z.unconsumed_tail
        if self.z.eof:
            self.end = self.taken - len(self.z.unused_data)
        out = bytes(self.data[self.at - self.start : self.at - self.start + n])
        self.at += len(out)
        return out


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch("[0-9]{1,18}", value) else None


def _differs(stated: str | None, digest: bytes) -> bool:
    """Whether a SHA-1 is stated and is another one."""
    label, _, value = (stated or "").partition(":")
    return label.lower() == "sha1" and value.strip().upper() not in (sha1_32(digest)[5:], digest.hex().upper())


def _fields(f, offset: int) -> tuple[dict[str, str], int]:
    """The header fields of the record at ``offset`` and where its block starts."""
    f.seek(offset)
    head, line, done = bytearray(), 0, -1
    while done < 0:
        chunk = f.read(STEP)
        known = max(0, len(head) - 3)
        head += chunk
        if not head.startswith(b"WARC/1."):
            raise Bad("no version line")
        done = head.find(b"\r\n\r\n", known)
        while (end := head.find(b"\r\n", line)) >= 0 and (done < 0 or end <= done):
            if line and head.find(b":", line, end) < 0:
                raise Bad("malformed header line" if end > line or done >= 0 else "header does not end")
            line = end + 2
        if done < 0 and not chunk:
            raise Bad("header does not end")
    fields = {}
    for x in bytes(head[:done]).split(b"\r\n")[1:]:
        k, _, v = x.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return fields, offset + done + 4


def parse(f, offset: int, size: int | None, payloads: bool = True) -> tuple[dict, int]:
    """The row of the record at ``offset`` and the offset after it.

    Every check is made; ``size`` is where the file ends, if known.
    """
    fields, at = _fields(f, offset)
    n = _number(fields.get("content-length"))
    if n is None:
        raise Bad("no content length")
    if size is not None and at + n + 4 > size:
        raise Bad("length does not fit")
    kind = fields.get("warc-type", "")
    http = "application/http" in fields.get("content-type", "")
    block, body, length, held = hashlib.sha1(), hashlib.sha1(), 0, []
    keep = payloads and kind != "revisit" and n <= HOLD
    head = b"" if http else None  # the end of what was read of the HTTP header, None once it is over
    f.seek(at)
    left = n
    while left:
        chunk = f.read(min(left, 4 * STEP))
        if not chunk:
            raise Bad("length does not fit")
        left -= len(chunk)
        block.update(chunk)
        if head is not None:
            both = head + chunk
            cut = both.find(b"\r\n\r\n")
            head, chunk = (both[-3:], b"") if cut < 0 else (None, both[cut + 4 :])
        body.update(chunk)
        length += len(chunk)
        if keep:
            held.append(chunk)
    if f.read(4) != b"\r\n\r\n":
        raise Bad("length does not fit")
    if _differs(fields.get("warc-block-digest"), block.digest()):
        raise Bad("block digest differs")
    digest = fields.get("warc-payload-digest")
    if kind != "revisit":
        if _differs(digest, body.digest()):
            raise Bad("payload digest differs")
        bare = body.hexdigest()
    else:
        length = _number(fields.get("x-payload-length"))
        value = (digest or "").partition(":")[2].strip()
        try:
            bare = None if digest is None else value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else base64.b32decode(value, casefold=True).hex()
        except ValueError:
            raise Bad("malformed payload digest") from None
    strip = lambda x: x.strip("<>") if x else None
    row = {"record_id": strip(fields.get("warc-record-id")), "record_type": kind, "uri": fields.get("warc-target-uri"), "refers_to_id": strip(fields.get("warc-refers-to")), "payload_digest": bare, "payload_bytes": length, "payload": b"".join(held) if keep else None}
    return row, at + n + 4


def _next(f, offset: int, mark: bytes, size: int | None = None) -> int:
    """The first offset from ``offset`` on where ``mark`` stands, else the end."""
    keep = b""
    f.seek(offset)
    at = offset
    while chunk := f.read(STEP):
        data = keep + chunk
        found = data.find(mark)
        if found >= 0:
            return at - len(keep) + found
        at += len(chunk)
        keep = data[-(len(mark) - 1) :]
    return at if size is None else size


def _members(f, offset: int, payloads: bool) -> Iterator[tuple[str, dict | str | int]]:
    """("record", row), ("gap", reason) of each run without one, and last ("end", offset after) or ("broken", reason)."""
    inner, at, sure = Member(f, offset), 0, False
    try:
        while True:
            inner.seek(at)
            if not inner.read(1):
                break
            try:
                row, at = parse(inner, at, None, payloads)
            except Broken:
                raise
            except Bad as e:
                begin, at = at, _next(inner, at + 1, b"WARC/1.")
                yield "gap", f"{e} (bytes {begin} to {at} of the member)"
                continue
            if not sure:  # the member's own check comes before its first record counts
                inner.seek(at)
                while inner.read(STEP):
                    pass
                sure = True
            yield "record", row
    except Broken as e:
        yield "broken", str(e)
        return
    yield "end", inner.end


def salvage(f, size: int, file: str, payloads: bool = True) -> Iterator[tuple[str, dict]]:
    """("record", row) for each valid record and ("gap", row) for each run of bytes without one.

    A gzip member that holds bad records beside good ones is a gap of its own,
    whose reason names the bytes of its content.
    """
    zipped = True if size == 0 else _sniff(f, size)
    mark = b"\x1f\x8b\x08" if zipped else b"WARC/1."
    offset, gap, why = 0, None, ""

    def ended(at: int) -> Iterator[tuple[str, dict]]:
        if gap is not None and gap < at:
            yield "gap", {"file": file, "start": gap, "end": at, "reason": why}

    while offset < size:
        if not zipped:
            try:
                row, after = parse(f, offset, size, payloads)
            except Bad as e:
                gap, why = (offset, str(e)) if gap is None else (gap, why)
                offset = _next(f, offset + 1, mark, size)
                continue
            yield from ended(offset)
            gap = None
            yield "record", {"file": file, "offset": offset} | row
            offset = after
            continue
        found, gaps = False, []
        for kind, what in _members(f, offset, payloads):
            if kind == "record":
                if not found:
                    yield from ended(offset)
                    gap, found = None, True
                yield "record", {"file": file, "offset": offset} | what
            elif kind == "gap":
                gaps.append(what)
            elif kind == "broken":
                gap, why = (offset, what) if gap is None else (gap, why)
                offset = _next(f, offset + 1, mark, size)
            elif found:
                for reason in gaps:
                    yield "gap", {"file": file, "start": offset, "end": what, "reason": reason}
                offset = what
            else:
                gap, why = (offset, gaps[0] if gaps else "member is empty") if gap is None else (gap, why)
                offset = what
    yield from ended(size)


def _sniff(f, size: int) -> bool:
    """Whether gzip members come before the first version line."""
    z, p = _next(f, 0, b"\x1f\x8b\x08", size), _next(f, 0, b"WARC/1.", size)
    return z < p


def read(manifest: DataFrame, payloads: bool = True, batch: int = 500, gaps: bool = False) -> DataFrame:
    """The valid records of the archives in column ``file`` of ``manifest``, or their gaps.

    Each archive is read by one task, which holds one batch of payloads at most.
    """
    ship(manifest.sparkSession)
    files = manifest.select("file")
    n = max(1, min(files.count(), 100_000))
    want, schema = ("gap", GAP) if gaps else ("record", RECORD)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"]:
                system, at = _filesystem(file)
                size, held, rows = system.get_file_info(at).size, 0, []
                with system.open_input_file(at) as raw:
                    for kind, row in salvage(Window(raw), size, file, payloads):
                        if kind == want:
                            rows.append(row)
                            held += len(row.get("payload") or b"")
                        if len(rows) >= batch or held > 32 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.repartition(n).mapInPandas(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    manifest = write(pages, new_path(pages.sparkSession, "warc"))
    return read(manifest, payloads=False)
