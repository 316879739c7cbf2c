"""Virtual sources: repository tables to (path, text) rows, one function for each class.

Inputs are DataFrames of the repository's tables (read from Parquet, JDBC or
anything else); a path is ``namespace:key`` and the text starts with the
class's frozen header.  Each result has text for what is there and null text
for what was seen but could not be understood, so that it is kept.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import compose, header, julian_iso, unquote, unquote_py
from quarry.session import ship


def _sourced(ns: str, key: Column, text: Column) -> list[Column]:
    return [F.concat(F.lit(f"{ns}:"), key).alias("path"), text.alias("text"), F.lit(0).cast("long").alias("mtime")]


def wiki(pages: DataFrame) -> DataFrame:
    """pages(name, content): the current text of each page as it is."""
    return pages.select(*_sourced("wiki", F.col("name"), F.col("content")))


def tickets(report: DataFrame) -> DataFrame:
    """Rows of the ticket report, whose columns are found by name and hold escaped text."""
    c = {x.lower(): x for x in report.columns}
    get = lambda k: F.coalesce(unquote(F.col(c[k])), F.lit("")) if k in c else F.lit("")
    uuid = get("tkt_uuid") if "tkt_uuid" in c else get("uuid")
    text = F.concat(F.lit("Ticket "), uuid, F.lit("\nStatus: "), get("status"), F.lit("\nTitle: "), get("title"), F.lit("\n"), get("comment"))
    return report.where(uuid != "").select(*_sourced("ticket", uuid, text))


def read_ticket_report(spark, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="")


def counted_body(manifest: str) -> tuple[int, str] | None:
    """Where the counted ``W`` card's body starts, and the body; lengths count bytes."""
    data = manifest.encode()
    for m in re.finditer(rb"(?m)^W (\d+)\n", data):
        n = int(m[1])
        if 0 < n <= len(data) - m.end():
            return m.end(), data[m.end() : m.end() + n].decode("utf-8", "replace")
        return None
    return None


def line_card(manifest: str, limit: int, letter: str) -> str | None:
    """The unescaped value of a single-line card before byte ``limit``."""
    m = re.search(rf"(?m)^{letter} (.*)$", manifest.encode()[:limit].decode("utf-8", "replace"))
    return unquote_py(m[1]) if m else None


def parsed_cards(manifest: Column, letter: str) -> Column:
    """struct(title, body) of a manifest with a counted body; null where there is none."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("title string, body string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = counted_body(t) if isinstance(t, str) else None
            out.append((line_card(t, found[0], letter), found[1]) if found else (None, None))
        return pd.DataFrame(out, columns=["title", "body"])

    return run(manifest)


def _cards(rows: DataFrame, ns: str, letter: str, head: Column | None) -> DataFrame:
    ship(rows.sparkSession)
    p = rows.withColumn("_p", parsed_cards(F.col("manifest"), letter))
    text = F.when(F.col("_p.body").isNotNull(), compose(*([head] if head is not None else []), F.col("_p.title"), F.col("_p.body")))
    return p.select(*_sourced(ns, F.col("key"), text))


def forum(event: DataFrame, blob: DataFrame, forumpost: DataFrame) -> DataFrame:
    """Posts that no later edit replaces; the title, if any, before the body."""
    posts = event.where("type = 'f'").join(blob, event["objid"] == blob["rid"])
    old = forumpost.where("fprev is not null").select(F.col("fprev").alias("objid"))
    return _cards(posts.join(old, "objid", "left_anti").select(F.col("uuid").alias("key"), F.col("content").alias("manifest")), "forum", "H", None)


def checkins(event: DataFrame, blob: DataFrame, tagxref: DataFrame, tag: DataFrame) -> DataFrame:
    """Comments of check-ins, amended ones as amended, with user and branch."""
    branch = tagxref.join(tag.where("tagname = 'branch'"), "tagid").groupBy(F.col("rid").alias("objid")).agg(F.max("value").alias("branch"))
    text = F.coalesce("ecomment", "comment", F.lit(""))
    rows = event.where((F.col("type") == "ci") & (text != "")).join(blob, event["objid"] == blob["rid"]).join(branch, "objid", "left")
    head = header("ckin", uuid=F.col("uuid"), ts=julian_iso(F.col("mtime")), user=F.coalesce("euser", "user"), branch=F.col("branch"))
    return rows.select(*_sourced("ckin", F.col("uuid"), compose(head, text)))


def technotes(event: DataFrame, blob: DataFrame, tag: DataFrame) -> DataFrame:
    """Tech notes under their stable id."""
    ids = tag.where("tagname like 'event-%'").select("tagid", F.substr("tagname", F.lit(7)).alias("key"))
    rows = event.where("type = 'e'").join(blob, event["objid"] == blob["rid"]).join(ids, "tagid")
    head = header("note", uuid=F.col("key"), ts=julian_iso(F.col("mtime")), user=F.coalesce("euser", "user"))
    return _cards(rows.select("key", F.col("content").alias("manifest"), head.alias("_head")), "note", "C", F.col("_head"))


def ticket_changes(ticketchng: DataFrame, blob: DataFrame, ticket: DataFrame) -> DataFrame:
    """``name: value`` lines of each change's field cards; changes without one are left out."""
    rows = ticketchng.join(blob, ticketchng["tkt_rid"] == blob["rid"]).join(ticket.select("tkt_id", "tkt_uuid"), "tkt_id", "left")
    cards = F.filter(F.split("content", "\n", -1), lambda x: F.startswith(x, F.lit("J ")) & (F.length(x) > 2))
    body = F.transform(cards, lambda x: F.substr(x, F.lit(3)))
    name = lambda x: F.substring_index(x, " ", 1)
    value = lambda x: F.when(F.contains(x, F.lit(" ")), unquote(F.substr(x, F.length(name(x)) + 2))).otherwise(F.lit(""))
    fields = F.array_join(F.transform(body, lambda x: F.concat(name(x), F.lit(": "), value(x), F.lit("\n"))), "")
    head = header("tchg", uuid=F.coalesce("tkt_uuid", F.lit("?")), ts=julian_iso(F.col("tkt_mtime")), user=F.col("tkt_user"))
    return rows.withColumn("_f", fields).where("_f <> ''").select(*_sourced("tchg", F.col("uuid"), compose(head, F.col("_f"))))


def _text_of(content: Column) -> Column:
    """Bytes as text; null if a NUL stands among the first 8 KB."""
    nul = F.instr(F.hex(F.substring(content, 1, 8192)), "00")
    aligned = F.regexp_count(F.hex(F.substring(content, 1, 8192)), F.lit(r"\G(?:(?!00)..)*00")) > 0
    return F.when((nul == 0) | ~aligned, F.decode(content, "UTF-8"))


def attachments(attachment: DataFrame, blob: DataFrame) -> DataFrame:
    """Current, undeleted text attachments by content id."""
    rows = attachment.where("isLatest and src <> ''").join(blob, attachment["src"] == blob["uuid"])
    head = header("attach", file=F.col("filename"), target=F.col("target"), ts=julian_iso(F.col("mtime")))
    text = _text_of(F.col("content"))
    return rows.select(*_sourced("attach", F.col("src"), F.when(text.isNotNull(), compose(head, text)))).dropDuplicates(["path"])


def unversioned(files: DataFrame, own: tuple[str, ...] = ("cache.db", "model.onnx", "vocab.txt", "manifest.json"), own_prefix: str = "quarry/") -> DataFrame:
    """Latest unversioned text files, without what this library publishes."""
    name = F.col("name")
    rows = files.where(~name.isin(list(own)) & ~F.startswith(name, F.lit(own_prefix)))
    newest = rows.groupBy("name").agg(F.max_by("content", "mtime").alias("content"))
    text = _text_of(F.col("content"))
    return newest.select(*_sourced("uv", name, F.when(text.isNotNull(), compose(header("uv", name=name), text))))


# A framed byte stream of records

FRAME_END = "#quarry-eof"


def frames(data: bytes, end: str = FRAME_END) -> tuple[list[tuple[str, str, bytes]], bool]:
    """(key, header, payload) of ``<key> <bytes> <header>\\n<payload>\\n`` records, and whether the end line came.

    A malformed record ends the stream without the end, so nothing that was
    not seen counts as gone.
    """
    out, at = [], 0
    while at < len(data):
        nl = data.find(b"\n", at)
        line = data[at : nl if nl >= 0 else len(data)]
        if line == end.encode():
            return out, True
        m = re.match(rb"(\S+) (\d+) (.*)\Z", line, re.S)
        if not m or nl < 0 or nl + 1 + int(m[2]) >= len(data) or data[nl + 1 + int(m[2]) : nl + 2 + int(m[2])] != b"\n":
            return out, False
        out.append((m[1].decode(), m[3].decode("utf-8", "replace"), data[nl + 1 : nl + 1 + int(m[2])]))
        at = nl + 2 + int(m[2])
    return out, False


def framed(spark, outputs: dict[str, tuple[bytes, str]]) -> tuple[DataFrame, set[str]]:
    """Rows (path, text, mtime) of framed outputs by namespace, and the namespaces that were seen whole.

    An output comes with the status of :func:`captured`.  One that failed, or
    whose end line is missing, still gives its rows but no authority, so a run
    retires nothing of that namespace; a payload with a NUL is seen without text.
    """
    rows, whole = [], set()
    for ns, (data, status) in outputs.items():
        found, ended = frames(data)
        for key, head, payload in found:
            body = None if b"\0" in payload[:8192] else payload.decode("utf-8", "replace")
            rows.append((f"{ns}:{key}", None if body is None else f"{head}\n\n{body}" if head else body, 0))
        if ended and status == "ok":
            whole.add(ns)
    return spark.createDataFrame(rows, "path string, text string, mtime long"), whole


def exported(spark, pages: dict[str, tuple[bytes, str]], listed: str) -> tuple[DataFrame, set[str]]:
    """Wiki pages by name with the status of each export; authority needs the list and every export."""
    rows = [(f"wiki:{name}", data.decode("utf-8", "replace") if status == "ok" else None, 0) for name, (data, status) in pages.items()]
    whole = listed == "ok" and all(status == "ok" for _, status in pages.values())
    return spark.createDataFrame(rows, "path string, text string, mtime long"), {"wiki"} if whole else set()


def captured(command: list[str], timeout: float = 600) -> tuple[bytes, str]:
    """Output of a command and ``ok``, ``failed`` or ``unavailable``."""
    import subprocess

    try:
        done = subprocess.run(command, capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return b"", "unavailable"
    return done.stdout, "ok" if done.returncode == 0 else "failed"
