"""The library as JSON over HTTP: ask, chunk, health, notes, pending, capture, structure, reindex."""

from __future__ import annotations

import json
import os
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import iso_now, link_for, link_label
from quarry.operators import notes, search
from quarry.plans.index import ask, edit_note
from quarry.plans.store import Store
from quarry.storage import materialize

PAGE = "<!doctype html><title>quarry</title><form action=/api/ask><input name=q><button>ask</button></form>"
CAPTURE_PAGE = "<!doctype html><title>capture</title><p>POST /api/capture with X-Quarry-Local and a text."


def as_json(rows: DataFrame) -> list[dict]:
    """Rows of a bounded result."""
    return [json.loads(x[0]) for x in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


class Api:
    """The routes as plain functions of parameters, so that tests need no socket."""

    def __init__(self, spark: SparkSession, store: Store, captures: str, base: str = "", reindex=None, embed=None, model_id: str | None = None):
        self.spark, self.store, self.captures, self.base, self.run = spark, store, captures, base, reindex
        self.embed, self.model_id = embed, model_id

    def get(self, path: str, q: dict[str, str]) -> tuple[int, object]:
        if path == "/":
            return 200, PAGE
        if path == "/capture":
            return 200, CAPTURE_PAGE
        if path == "/api/health":
            return 200, {"ok": True, "version": self.store.pointer()["version"], "chunks": self.store.read("chunk").count()}
        if path == "/api/ask":
            if not q.get("q"):
                return 400, {"error": "q is missing"}
            k = min(max(int(q.get("k", "5") or 5), 1), 40)
            vectors = None
            if self.embed is not None:
                vectors = self.spark.createDataFrame([("q", q["q"])], "qid string, text string").select("qid", self.embed(F.col("text")).alias("vec"))
            found = ask(self.store, {"q": q["q"]}, k, vectors, self.model_id, float(q.get("minCos", "0") or 0))
            found = search.with_snippets(materialize(found, "served"), self.store.read("chunk"), {"q": q["q"]})
            out = found.withColumn("link", link_for(self.base, F.col("path"))).withColumn("label", link_label(F.col("path"))).orderBy("rank")
            return 200, {"query": q["q"], "results": as_json(out)}
        if path == "/api/chunk":
            got = as_json(search.lookup(self.store.read("chunk"), q.get("hash", ""), int(q.get("ix", "0") or 0)).select("content_hash", "chunk_ix", "chunk_text"))
            return (200, got[0]) if got else (404, {"error": "no such chunk"})
        if path in ("/api/notes", "/api/pending"):
            keys = ("place", "type", "state", "who", "since", "grep", "closes")
            only = {k: q[k] for k in keys if q.get(k)}
            flags = {k: q.get(k) == "1" for k in ("unclaimed", "stale", "last")}
            rows = notes.query(self.store.notes(), iso_now(), **only, **flags, pending=path == "/api/pending")
            return 200, {"notes": as_json(rows)}
        return 404, {"error": "no such page"}

    def post(self, path: str, headers: dict[str, str], body: dict) -> tuple[int, object]:
        if headers.get("x-quarry-local") != "1":
            return 403, {"error": "X-Quarry-Local is missing"}
        if path == "/api/capture":
            now = iso_now()
            try:
                block = notes.capture_block(body.get("text", ""), now, **{k: body.get(k) for k in ("type", "place", "who", "due", "state")})
            except notes.Refused as e:
                return 400, {"error": str(e)}
            os.makedirs(self.captures, exist_ok=True)
            with open(f"{self.captures}/{now[:7]}.md", "a", encoding="utf-8") as f:
                f.write(block)
            return 200, {"id": notes.note_id(now)}
        if path == "/api/structure":
            now = iso_now()

            def change(claim: notes.Claim) -> dict[str, str]:
                if "who" in body:
                    out = notes.take(claim, body["who"], now, body.get("lease", ""), bool(body.get("force")))
                elif body.get("heartbeat"):
                    out = notes.heartbeat(claim, now, body.get("lease", ""))
                elif body.get("challenge"):
                    out = notes.challenge(claim, body["challenge"], now)
                elif body.get("steal"):
                    out = notes.steal(claim, body["steal"], now, body.get("grace", "60s"), body.get("lease", ""))
                else:
                    out = {}
                return out | {k: body[k] for k in ("type", "place", "due", "state", "closes") if k in body}

            try:
                return 200, edit_note(self.store, body["id"], change, now)
            except (KeyError, notes.Refused) as e:
                return 409, {"error": str(e)}
        if path == "/api/reindex":
            if self.run is None:
                return 501, {"error": "no index run is set up"}
            return 200, {"version": self.run().version}
        return 404, {"error": "no such page"}


def serve(api: Api, port: int = 8077) -> HTTPServer:
    """A server on the loopback address; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, what: object) -> None:
            page = isinstance(what, str)
            data = (what if page else json.dumps(what)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if page else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            u = urlsplit(self.path)
            self._send(*api.get(u.path, {k: v[-1] for k, v in parse_qs(u.query, keep_blank_values=True).items()}))

        def do_POST(self) -> None:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            self._send(*api.post(urlsplit(self.path).path, {k.lower(): v for k, v in self.headers.items()}, body))

        def log_message(self, *args) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
