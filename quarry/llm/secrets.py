"""Secret scans with an incremental blob ledger.

Every historical version of every path is content-addressed by SHA-256.  The
ledger holds which rule versions have scanned which blob and what they found;
a scan reads only the texts of (blob, rule version) pairs that the ledger
lacks, once per blob however many paths hold it, appends to the ledger and
joins the findings back to all paths.

Defined cases: a null text is empty and finds nothing; repeated rows give
repeated result rows; a null path is a path like any other; an empty table
gives an empty result and leaves the ledger as it is; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import column
from quarry.session import ship
from quarry.storage import broadcast_if_small, materialize, small_batches

#: name -> (version, pattern, flags, group whose length counts, least length, literals of which a lower-cased text must hold one)
RULES = {
    "assign": (1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12, ("passw", "secret", "token", "apikey", "api_key")),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 0, 18, ("akia",)),
    "hex": (1, r"[0-9a-f]+", 0, 0, 16, ()),
    "private_key": (1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0, 0, 1, ("private key-----",)),
    "github": (1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    "jwt": (1, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 1, ("eyj",)),
    "slack": (1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, 1, ("xox",)),
    "url_login": (1, r"\b[a-z][a-z0-9+.-]*://[^\s/@:]+:[^\s/@]+@", re.I | re.A, 0, 1, ("://",)),
}
#: Unseen blobs are broadcast up to this many rows (a digest, a path and rule names each, about 300 bytes), else joined by a shuffle.
BROADCAST_BLOBS = 100_000
BASE = ["assign", "access", "hex"]
FINDING = "array<struct<start:int,rank:int,end:int,kind:string,rule:string>>"
LEDGER = f"blob string, scanned array<string>, findings {FINDING}"


def rule_id(kind: str, rules: dict = RULES) -> str:
    return f"{kind}@{rules[kind][0]}"


#: A run of 16 or more; its matches are those of [0-9a-f]+ that are long enough, and it skips short runs faster.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
_LOGIN = re.compile(r"://[^\s/@:]++:[^\s/@]++@", re.A)
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")


def _jwts(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern; where a start in a run of its characters fails, all later ones in that run do."""
    at = text.find("eyJ")
    while at >= 0:
        if m := _JWT.match(text, at):
            yield m.span()
            at = text.find("eyJ", m.end())
        elif at and (text[at - 1].isalnum() or text[at - 1] == "_"):  # no word boundary
            at = text.find("eyJ", at + 1)
        else:
            at = text.find("eyJ", _JWT_RUN.match(text, at).end())


def _logins(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern, each found at its ``://`` and led back to the first place where its scheme may start."""
    done, at = 0, text.find("://")
    while at >= 0:
        m, start = _LOGIN.match(text, at), at
        while m and start > done and text[start - 1] in _SCHEME:
            start -= 1
        while m and start < at:
            before = text[start - 1] if start else " "
            if text[start].isalpha() and not (before.isascii() and (before.isalnum() or before == "_")):
                yield start, m.end()
                done = m.end()
                break
            start += 1
        at = text.find("://", max(at + 1, done))


#: The linear search of patterns that a plain search would start anew at each place of a long run.
_LINEAR = {"jwt": _jwts, "url_login": _logins}


def _spans(kind: str, pattern: str, flags: int, group: int, least: int, text: str) -> Iterator[tuple[int, int]]:
    if kind in _LINEAR and pattern == RULES[kind][1]:
        return _LINEAR[kind](text)
    found = _LONG_HEX if pattern == "[0-9a-f]+" and least == 16 else re.compile(pattern, flags)
    return (m.span() for m in found.finditer(text) if m.end(group) - m.start(group) >= least)


def find(text: str, kinds: list[str], rules: dict = RULES) -> list[dict]:
    """The spans of ``kinds`` in ``text`` in code points, by start and then by the order of ``rules``."""
    out, low = [], None
    for rank, (kind, (_, pattern, flags, group, least, literals)) in enumerate(rules.items()):
        if kind not in kinds:
            continue
        if literals:
            low = text.lower() if low is None else low
            if not any(x in low for x in literals):
                continue
        out += [{"start": a, "rank": rank, "end": b, "kind": kind, "rule": rule_id(kind, rules)} for a, b in _spans(kind, pattern, flags, group, least, text)]
    return sorted(out, key=lambda x: (x["start"], x["rank"]))


def scan(versions: DataFrame, ledger: str, path: str = "path", text: str = "text", rules: dict = RULES) -> DataFrame:
    """Scan what ``ledger`` (a folder, which may not exist yet) lacks.

    Returns a row for each row of ``versions``: path, blob and findings, sorted
    by start and kind.
    """
    spark = versions.sparkSession
    ship(spark)
    want = [rule_id(k, rules) for k in rules]
    v = versions.select(column(versions, path).alias("path"), F.coalesce(column(versions, text), F.lit("")).alias("text"))
    v = v.withColumn("blob", F.sha2("text", 256))
    ids = materialize(v.select("path", "blob"), "secret-paths")
    # One path speaks for each blob; its rows are few bytes each, and no blob's rows meet in a task.
    todo = ids.groupBy("blob").agg(F.min("path").alias("at"))
    jpath = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        todo = todo.join(seen, "blob", "left").select("blob", "at", F.array_except(F.array(*map(F.lit, want)), F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
        # Where little is new, no text is shuffled.
        todo = broadcast_if_small(materialize(todo, "secret-unseen"), BROADCAST_BLOBS)
    else:
        todo = todo.withColumn("todo", F.array(*map(F.lit, want)))
    todo = todo.withColumnRenamed("blob", "b")
    unseen = v.join(todo, F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("b"))).select("blob", "text", "todo")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {rule_id(k, rules): k for k in rules}
        for batch in batches:
            found = [find(t, [kinds[r] for r in do], rules) for t, do in zip(batch["text"], batch["todo"], strict=True)]
            yield pd.DataFrame({"blob": batch["blob"], "scanned": batch["todo"], "findings": found})

    with small_batches(spark):
        unseen.mapInPandas(run, LEDGER).write.mode("append").parquet(ledger)
    found = spark.read.schema(LEDGER).parquet(ledger).where(F.size("findings") > 0).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("f"))
    # Written, so that both sides of the join are plain exchanges and a blob with many paths is split.
    found = materialize(found, "secret-findings")
    now = F.filter("f", lambda x: x["rule"].isin(want))
    return ids.join(found, "blob", "left").select("path", "blob", F.coalesce(now, F.array().cast(FINDING)).alias("findings"))
