"""Command line: index, ask, grep, muse, capture, notes, structure, push, pull, serve."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.embed import embedder
from quarry.functions.text import iso_now
from quarry.operators import grep, ingest, muse, notes, search
from quarry.plans.index import ask, edit_note, index, pull, push
from quarry.plans.store import Store
from quarry.schema import NO_MODEL
from quarry.sources.files import list_folder, read_captures, read_listed
from quarry.storage import materialize


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--store", default=".quarry/store")
    p.add_argument("--captures", default="captures")
    p.add_argument("--model", help="folder with model.onnx and vocab.txt")
    sub = p.add_subparsers(dest="verb", required=True)
    a = sub.add_parser("index")
    a.add_argument("dir", nargs="?", default=".")
    a = sub.add_parser("ask")
    a.add_argument("query")
    a.add_argument("--k", type=int, default=5)
    a.add_argument("--min-cos", type=float, default=0.0)
    a = sub.add_parser("grep")
    a.add_argument("pattern")
    a.add_argument("-i", dest="ignore_case", action="store_true")
    a.add_argument("--source", help="LIKE pattern of a path")
    a.add_argument("--since", default="")
    a.add_argument("--until", default="")
    a.add_argument("--newest", action="store_true")
    a.add_argument("--max", type=int, default=50)
    a.add_argument("--chars", type=int, default=160)
    a = sub.add_parser("muse")
    a.add_argument("--k", type=int, default=5)
    a.add_argument("--seed", type=int, default=None)
    a.add_argument("--from", dest="at", help="content_hash#chunk_ix")
    a.add_argument("--bias", choices=["old"])
    a.add_argument("--same-source", action="store_true")
    a.add_argument("--model-id")
    a.add_argument("--chars", type=int, default=240)
    a = sub.add_parser("capture")
    a.add_argument("text")
    for f in ("type", "place", "who", "due", "state"):
        a.add_argument(f"--{f}")
    a = sub.add_parser("notes")
    for f in ("place", "type", "state", "who", "since", "grep", "closes"):
        a.add_argument(f"--{f}", default="")
    for f in ("unclaimed", "stale", "pending", "last"):
        a.add_argument(f"--{f}", action="store_true")
    a.add_argument("--stale-after", default="1d")
    a.add_argument("--max", type=int, default=50)
    a = sub.add_parser("structure")
    a.add_argument("id")
    for f in ("type", "place", "who", "due", "state", "closes"):
        a.add_argument(f"--{f}")
    a.add_argument("--lease", default="")
    a.add_argument("--force", action="store_true")
    a.add_argument("--heartbeat", action="store_true")
    a.add_argument("--challenge")
    a.add_argument("--steal")
    a.add_argument("--grace", default="60s")
    for verb in ("push", "pull"):
        sub.add_parser(verb).add_argument("peer")
    a = sub.add_parser("serve")
    a.add_argument("--port", type=int, default=8077)
    return p


def structure(spark: SparkSession, store: Store, a: argparse.Namespace, now: str) -> dict[str, str]:
    """The change that the arguments ask for, appended to the store's note events."""

    def change(claim: notes.Claim) -> dict[str, str]:
        if a.heartbeat:
            out = notes.heartbeat(claim, now, a.lease)
        elif a.challenge:
            out = notes.challenge(claim, a.challenge, now)
        elif a.steal:
            out = notes.steal(claim, a.steal, now, a.grace, a.lease)
        else:
            out = {} if a.who is None else notes.take(claim, a.who, now, a.lease, a.force)
        return out | {f: v for f in ("type", "place", "due", "state", "closes") if (v := getattr(a, f)) is not None}

    return edit_note(store, a.id, change, now)


def run(spark: SparkSession, a: argparse.Namespace, out=print) -> int:
    store, now = Store(spark, a.store), iso_now()
    if a.verb == "index":
        captures = read_captures(spark, a.captures) if os.path.isdir(a.captures) and os.listdir(a.captures) else None
        listing = materialize(list_folder(spark, a.dir), "listing")
        rights = {"file"} if listing.where(~F.col("complete")).isEmpty() and os.path.isdir(a.dir) else set()
        embed = embedder(a.model)
        model = os.path.basename(a.model) if embed else NO_MODEL
        same = ingest.unchanged(listing.select("path", "mtime"), store.read("source"), store.read("chunk"), model).select("path")
        same = materialize(same, "unchanged")
        scan = read_listed(listing.join(same, "path", "left_anti"))
        r = index(store, scan, rights, a.dir, embed, model, captures, same=same)
        out(f"{r.sources} sources, {r.chunks} chunks, {r.retired} retired, {r.version}")
    elif a.verb == "ask":
        vectors, model = None, None
        if (embed := embedder(a.model)) is not None:
            model = os.path.basename(a.model)
            vectors = spark.createDataFrame([("q", a.query)], "qid string, text string").select("qid", embed(F.col("text")).alias("vec"))
        found = ask(store, {"q": a.query}, a.k, vectors, model, a.min_cos)
        rows = search.hit_lines(found).orderBy("rank").collect()
        for r in rows:
            out(r.line)
        return 0 if rows else 1
    elif a.verb == "grep":
        rows = grep.grep(store.read("chunk"), store.read("source"), a.pattern, a.ignore_case, a.source, a.since, a.until, a.newest, a.chars, a.max).collect()
        for r in rows:
            out(f"[{r.content_hash}#{r.chunk_ix}] {r.path} {r.ts or ''}\n    {r.excerpt}")
        return 0 if rows else 1
    elif a.verb == "muse":
        at = (a.at.split("#")[0], int(a.at.split("#")[1])) if a.at else None
        seed = a.seed if a.seed is not None else int.from_bytes(os.urandom(8), "big")
        info = muse.muse(store.read("chunk"), store.read("source"), a.k, seed, at, a.bias == "old", a.same_source, a.model_id, chars=a.chars)
        for i, r in enumerate(info.results, 1):
            out(f"[{i}] cos={r['cos']:.4f} rank={r['rank']}  {r['content_hash']}#{r['chunk_ix']}  {r['source']}\n    {r['excerpt']}")
        return 0 if info.results else 1
    elif a.verb == "capture":
        block = notes.capture_block(a.text, now, **{f: getattr(a, f) for f in ("type", "place", "who", "due", "state")})
        os.makedirs(a.captures, exist_ok=True)
        with open(f"{a.captures}/{now[:7]}.md", "a", encoding="utf-8") as f:
            f.write(block)
        out(notes.note_id(now))
    elif a.verb == "notes":
        picked = {f: getattr(a, f) for f in ("place", "type", "state", "who", "since", "grep", "closes", "unclaimed", "stale", "stale_after", "pending", "last")}
        for r in notes.query(store.notes(), now, most=a.max, **picked).collect():
            out("\t".join((r.note_id, r.ts, r.type, r.place, r.who, r.state, r.text)))
    elif a.verb == "structure":
        out(f"{a.id} " + " ".join(f"{k}={v}" for k, v in structure(spark, store, a, now).items()))
    elif a.verb == "push":
        out(push(store, Store(spark, a.peer)))
    elif a.verb == "pull":
        out(pull(store, Store(spark, a.peer)))
    elif a.verb == "serve":
        from quarry.serve import Api, serve

        embed = embedder(a.model)
        serve(Api(spark, store, a.captures, embed=embed, model_id=os.path.basename(a.model) if embed else None), a.port).serve_forever()
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, a)
    except (notes.Refused, muse.NoCorpus, ValueError) as e:
        print(f"quarry: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
