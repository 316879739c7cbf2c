import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import ingest
from quarry.plans.index import index, pull
from quarry.plans.store import Store, checked_copy, publish_model
from quarry.sources import artifacts
from quarry.sources.files import read_captures, read_folder, read_manifest, read_vocabulary
from quarry.streaming.incremental import ingest_stream, landing, lapsed


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string, mtime long")


def test_chunks_join_to_the_text(spark):
    texts = ["".join(f"line {i}\n" for i in range(85)), "one", "a\n", "\n" * 41, "x\r\ny", "40\n" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = ingest.chunk(df).orderBy("i", "chunk_ix").collect()
    for i, t in enumerate(texts):
        own = [r.chunk_text for r in got if r.i == i]
        assert "".join(own) == t
        assert all(c.count("\n") == 40 for c in own[:-1]) and own[-1].count("\n") <= 40
    assert [r.chunk_text.count("\n") for r in got if r.i == 0] == [40, 40, 5]


def test_overlapping_chunks(spark):
    df = spark.createDataFrame([("".join(f"{i}\n" for i in range(10)),)], "text string")
    assert [r.chunk_text.split() for r in ingest.chunk(df, 4, stride=2).orderBy("chunk_ix").collect()] == [["0", "1", "2", "3"], ["2", "3", "4", "5"], ["4", "5", "6", "7"], ["6", "7", "8", "9"]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "..", "", "b c"]), max_size=5), st.booleans())
def test_canonical_path_is_stable(parts, absolute):
    p = ("/" if absolute else "") + "/".join(parts)
    c = ingest.canonical_path(p)
    assert c is None or ingest.canonical_path(c) == c


def test_scope_agrees_with_canonical_paths(spark):
    paths = ["docs/x", "./docs/x", "docs//x", "/docs/x", "docs/../x", "docsx", "docs", "./docs/./a/b/", "x", ".", ""]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for folder in ("docs", ".", "./docs/", "/", "/docs", "a/.."):
        got = {r.path for r in df.where(ingest.in_scope(F.col("path"), folder)).collect()}
        top = ingest.canonical_path(folder)
        want = set()
        for p in paths:
            c = ingest.canonical_path(p)
            if c is None or top is None:
                continue
            if top == "":
                ok = c != "" and not c.startswith("/")
            else:
                ok = c.startswith(top if top == "/" else top + "/") and c != top
            want |= {p} if ok else set()
        assert got == want, folder


def test_runs_retire_only_with_authority(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    first = files(spark, [("./a.md", "alpha\n", 1), ("./b.md", "beta\n", 1), ("./c.md", "alpha\n", 1), ("wiki:P", "page", 0), ("odd:1", "kept", 0)])
    r = index(s, first, {"file", "wiki"})
    assert (r.sources, r.chunks) == (5, 4)
    # Nothing seen, nothing claimed: nothing goes.
    assert index(s, first.limit(0), set()).sources == 5
    # An incremental run adds and never shrinks.
    assert index(s, files(spark, [("./d.md", "delta", 2)]), {"file", "wiki"}, incremental=True).sources == 6
    # A full run retires what it owns; shared content survives one of its paths.
    r = index(s, files(spark, [("./c.md", "alpha\n", 1)]), {"file"})
    assert {x.path for x in s.read("source").collect()} == {"./c.md", "wiki:P", "odd:1"}
    assert {x.chunk_text for x in s.read("chunk").collect()} == {"alpha\n", "page", "kept"}
    assert r.retired == 3


def test_unreadable_is_kept_and_empty_is_withdrawn(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    index(s, files(spark, [("./a", "text", 1), ("./b", "more", 1)]), {"file"})
    scan = spark.createDataFrame([("./a", None, 1, False), ("./b", "", 2, True)], "path string, text string, mtime long, readable boolean")
    index(s, scan, {"file"})
    assert [r.path for r in s.read("source").collect()] == ["./a"]


def test_merge_is_idempotent_and_commutative_on_keys(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    index(a, files(spark, [("./x", "local", 1), ("./y", "same", 1)]), {"file"})
    index(b, files(spark, [("./x", "peer", 9), ("./z", "same", 1)]), {"file"})
    keys = lambda s: {r.path for r in s.read("source").collect()}
    pull(a, b)
    once = sorted(map(tuple, a.read("source").collect()))
    pull(a, b)
    assert sorted(map(tuple, a.read("source").collect())) == once
    assert a.read("source").where("path = './x'").first().mtime == 1
    pull(b, a)
    assert keys(a) == keys(b) == {"./x", "./y", "./z"}


def test_pointer_moves_last_and_old_versions_go(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.read("chunk").count() == 0
    v1 = s.commit(source=files(spark, [("p", "h", 1)]).selectExpr("path", "text as content_hash", "mtime", "'' as ts"))
    snap = s.snapshot()["source"]
    v2 = s.commit(source=ingest.empty(spark, snap.schema))
    assert snap.count() == 1 and s.read("source").count() == 0 and v1 != v2
    s.commit()
    assert s.drop_old(1) and s.pointer()["version"]


def test_migration_adds_columns(spark):
    from quarry.schema import SOURCE

    old = spark.createDataFrame([("p", "h")], "path string, content_hash string")
    assert ingest.migrate(old, SOURCE).columns == ["path", "content_hash", "mtime", "ts"]


def test_folder_source(spark, tmp_path):
    for name, data in {"a.md": b"x\n", ".hidden": b"h", "sub/b.txt": b"y", ".git/c": b"no", "build/d": b"no", "bin.dat": b"a\0b"}.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / "tree/link").symlink_to(tmp_path / "tree/a.md")
    rows = {os.path.relpath(r.path, tmp_path / "tree"): r for r in read_folder(spark, str(tmp_path / "tree")).collect()}
    assert set(rows) == {"a.md", ".hidden", "sub/b.txt", "bin.dat"}
    assert rows["bin.dat"].is_binary and rows["bin.dat"].text is None and rows["a.md"].text == "x\n" and all(r.complete for r in rows.values())
    assert read_folder(spark, str(tmp_path / "nowhere")).count() == 0


def test_small_readers(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[PAD]\n##s\n")
    (tmp_path / "m.json").write_text('{"model_id": "m", "dim": 3}')
    (tmp_path / "2024-01.md").write_text("@note 1\nhello\n")
    assert read_vocabulary(spark, str(tmp_path / "v.txt")) == ["[PAD]", "##s"]
    assert read_manifest(spark, str(tmp_path / "m.json"))["dim"] == 3
    assert read_captures(spark, str(tmp_path)).first().text == "@note 1\nhello\n"


def test_published_files_are_checked(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"model")
    good = hashlib.sha256(b"model").hexdigest()
    assert checked_copy(spark, f"file://{tmp_path}/a.bin", f"file://{tmp_path}/b.bin", good)
    assert not checked_copy(spark, f"file://{tmp_path}/a.bin", f"file://{tmp_path}/c.bin", "0" * 64)
    assert not (tmp_path / "c.bin").exists()
    m = {"sha256": {"model": good}, "id": 1}
    assert publish_model(spark, {"model": f"file://{tmp_path}/a.bin"}, m, f"file://{tmp_path}/pub")
    assert not publish_model(spark, {"model": f"file://{tmp_path}/a.bin"}, m, f"file://{tmp_path}/pub")


def test_frames():
    data = b"k1 3 head er\nabc\nk2 4 \na\nb\n\n#quarry-eof"
    assert artifacts.frames(data) == ([("k1", "head er", b"abc"), ("k2", "", b"a\nb\n")], True)
    assert artifacts.frames(data[:-3])[1] is False
    assert artifacts.frames(b"k 99 h\nshort\n#quarry-eof") == ([], False)
    assert artifacts.captured(["/no/such/program"])[1] == "unavailable"
    assert artifacts.captured(["false"])[1] == "failed"


def test_only_whole_streams_have_authority(spark):
    whole, cut = b"k1 3 head\nabc\nk2 3 \na\0b\n#quarry-eof", b"k1 3 head\nabc\n"
    rows, rights = artifacts.framed(spark, {"forum": (whole, "ok"), "ckin": (cut, "ok"), "tchg": (whole, "failed")})
    assert rights == {"forum"} and rows.count() == 5
    assert {r.path: r.text for r in rows.collect()}["forum:k1"] == "head\n\nabc" and rows.where("path = 'forum:k2'").first().text is None
    pages = {"A": (b"text", "ok"), "B": (b"", "failed")}
    rows, rights = artifacts.exported(spark, pages, "ok")
    assert rights == set() and {r.path: r.text for r in rows.collect()} == {"wiki:A": "text", "wiki:B": None}
    assert artifacts.exported(spark, {"A": (b"text", "ok")}, "ok")[1] == {"wiki"} and artifacts.exported(spark, {}, "failed")[1] == set()


def test_unchanged_files_are_not_read(spark, tmp_path):
    from quarry.cli import parser, run

    at = tmp_path / "docs"
    at.mkdir()
    (at / "a.md").write_text("alpha\n")
    (at / "b.md").write_text("beta\n")
    args = parser().parse_args(["--store", f"file://{tmp_path}/store", "--captures", str(tmp_path / "none"), "index", str(at)])
    lines = []
    run(spark, args, lines.append)
    stamp = os.stat(at / "a.md")
    (at / "a.md").write_text("other\n")
    os.utime(at / "a.md", (stamp.st_atime, stamp.st_mtime))  # the same time, so it counts as unchanged
    (at / "b.md").write_text("gamma\n")
    os.utime(at / "b.md", (stamp.st_atime, stamp.st_mtime + 9))
    run(spark, args, lines.append)
    assert {r.chunk_text for r in Store(spark, f"file://{tmp_path}/store").read("chunk").collect()} == {"alpha\n", "gamma\n"} and "2 sources, 2 chunks, 0 retired" in lines[-1]


@pytest.mark.parametrize("budget", [1, 3, 7, 100])
def test_token_chunks(spark, budget):
    from quarry.operators import options

    texts = ["a b\nc\n\nd e f g\nh", "", "one two three four five six seven eight", "x\n" * 9]
    got = options.token_chunks(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), budget).orderBy("i", "chunk_ix").collect()
    want = []
    for i, t in enumerate(texts):
        out, used = [], 0
        for line in t.splitlines(keepends=True):
            n = len(line.split())
            if out and used + n <= budget:
                out[-1], used = out[-1] + line, used + n
            else:
                out.append(line)
                used = n
        want += [(i, ix, x) for ix, x in enumerate(out)]
    assert [tuple(r) for r in got] == want


def test_cards():
    m = "D x\nH A\\stitle\nW 9\nH noé ab\nZ\n"
    at, body = artifacts.counted_body(m)
    assert body == "H noé ab" and artifacts.line_card(m, at, "H") == "A title"
    reply = "D x\nW 4\nH no\nZ\n"
    at, _ = artifacts.counted_body(reply)
    assert artifacts.line_card(reply, at, "H") is None
    assert artifacts.counted_body("W 99\nshort") is None and artifacts.counted_body("no card") is None


def test_attachments_and_unversioned(spark):
    att = spark.createDataFrame([("f.txt", "Page", "u1", 2440587.5, True), ("g", "P", "u2", 2440587.5, True), ("h", "P", "u1", 2440587.5, False)], "filename string, target string, src string, mtime double, isLatest boolean")
    blob = spark.createDataFrame([("u1", bytearray(b"body")), ("u2", bytearray(b"a\0b"))], "uuid string, content binary")
    got = {r.path: r.text for r in artifacts.attachments(att, blob).collect()}
    assert got == {"attach:u1": "attachment f.txt on Page at 1970-01-01T00:00:00\n\nbody", "attach:u2": None}
    uv = spark.createDataFrame([("a.txt", bytearray(b"old"), 1), ("a.txt", bytearray(b"new"), 2), ("cache.db", bytearray(b"x"), 1), ("p0", bytearray(b"\x10\x01"), 1)], "name string, content binary, mtime long")
    got = {r.path: r.text for r in artifacts.unversioned(uv).collect()}
    assert got["uv:a.txt"] == "unversioned file a.txt\n\nnew" and set(got) == {"uv:a.txt", "uv:p0"} and got["uv:p0"] is not None


def test_technotes_and_wiki(spark):
    event = spark.createDataFrame([(1, "e", 2440587.5, "ann", None, 5)], "objid long, type string, mtime double, user string, euser string, tagid long")
    blob = spark.createDataFrame([(1, "u", "C My\\stitle\nW 4\nbody\n")], "rid long, uuid string, content string")
    tag = spark.createDataFrame([(5, "event-abcdef")], "tagid long, tagname string")
    assert artifacts.technotes(event, blob, tag).first().text == "tech note abcdef on 1970-01-01T00:00:00 by ann\n\nMy title\n\nbody"
    assert artifacts.wiki(spark.createDataFrame([("A b", "text")], "name string, content string")).first().path == "wiki:A b"


def test_stream_only_adds_and_replays(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    inbox = str(tmp_path / "inbox")
    os.makedirs(inbox)
    put = lambda rows: spark.createDataFrame(rows, "path string, text string, mtime long, rcvid long").coalesce(1).write.mode("append").parquet(inbox)
    put([("ckin:1", "first", 0, 1), ("ckin:1", "amended", 0, 2), ("ckin:2", "second", 0, 3)])
    run = lambda: ingest_stream(landing(spark, inbox), s, f"file://{tmp_path}/cp", "p").awaitTermination()
    run()
    assert {r.chunk_text for r in s.read("chunk").collect()} == {"amended", "second"} and s.pointer()["mark"] == ["p", 3]
    put([("ckin:3", "third", 0, 4), ("ckin:9", "late", 0, 2)])
    run()
    assert {r.path for r in s.read("source").collect()} == {"ckin:1", "ckin:2", "ckin:3"}


def test_marks(spark):
    df = spark.createDataFrame([(1,), (5,)], "rcvid long")
    assert ingest.new_since(df, None, "p")[1] is False
    assert ingest.new_since(df, ("q", 4), "p")[0].count() == 2
    assert [r[0] for r in ingest.new_since(df, ("p", 4), "p")[0].collect()] == [5]
    assert ingest.next_mark(df, ("p", 9), "p") == ("p", 9) and ingest.next_mark(df, ("q", 9), "p") == ("p", 5)
    assert ingest.parse_mark("proj 12\n") == ("proj", 12) and ingest.parse_mark("junk") is None


def test_lapsed_leases(spark):
    claims = spark.createDataFrame([("n1", "a", "2024-01-01"), ("n2", "", "2024-01-01"), ("n3", "b", ""), ("n4", "c", "2025-01-01")], "note_id string, who string, lease string")
    ticks = spark.createDataFrame([("2024-06-01",)], "now string")
    assert [r.note_id for r in lapsed(claims, ticks).collect()] == ["n1"]


@pytest.mark.parametrize("path", ["wiki:x", "foo:x", "./a:b", "a/b"])
def test_namespaces(spark, path):
    got = spark.createDataFrame([(path,)], "p string").select(ingest.namespace(F.col("p"))).first()[0]
    assert got == {"wiki:x": "wiki", "foo:x": "?"}.get(path, "")


# Buckets of the store


def _written(path, version):
    return sum(f.stat().st_size for f in (path / "store").glob(f"{version}/**/*.parquet"))


def test_a_batch_writes_what_it_brings_however_large_the_store_is(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", stemmed=False)
    names = lambda n, p: [(f"./{p}/{i}.md", f"text {p} {i} " + "word " * 20, i + 1) for i in range(n)]
    index(s, files(spark, names(200, "a")), {"file"})
    batch = lambda p: _written(tmp_path, index(s, files(spark, names(5, p)), set(), incremental=True).version)
    small = batch("b")
    touched = {f.split("/")[0] for f in s.pointer()["tables"]["source"]}
    assert len(touched) == 2  # the other buckets keep their folders
    index(s, files(spark, names(200, "a") + names(5, "b") + names(2000, "c")), {"file"})
    assert batch("d") < 1.3 * small
    assert s.read("source").count() == 2210 and s.read("chunk").count() == 2210


def test_deltas_are_put_together_and_give_the_same(spark, tmp_path, monkeypatch):
    from quarry.plans import store as stores

    monkeypatch.setattr(stores, "DELTAS", 3)
    monkeypatch.setattr(stores, "BUCKETS", 2)
    s, want = Store(spark, f"file://{tmp_path}/store", stemmed=False), {}
    for n in range(8):
        rows = [(f"./{i}.md", f"text {i} {n % 3}", n + 1) for i in range(n, 12, 2)]
        index(s, files(spark, rows), set(), incremental=n > 0)
        want |= {p: (t, m) for p, t, m in rows}
    got = s.read("source").join(s.read("chunk"), "content_hash").collect()
    assert {r.path: (r.chunk_text, r.mtime) for r in got} == want and len(got) == len(want)
    assert max(sum(f"bucket={b}" in f for f in s.pointer()["tables"]["source"]) for b in (0, 1)) <= 3
    stat = s.read("stat").first()
    live = {t for t, _ in want.values()}
    assert (stat.n, stat.total) == (len(live), 3 * len(live)) and s.read("chunk").count() == len(live)
    assert {r.term for r in s.read("posting").collect()} == {w for t in live for w in t.split()}


def test_a_content_that_comes_back_is_not_written_again(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", stemmed=False)
    put = lambda t, n: index(s, files(spark, [("./x", t, n)]), set(), incremental=n > 1)
    put("first words", 1)
    put("other words", 2)
    assert [r.chunk_text for r in s.read("chunk").collect()] == ["other words"]
    chunk = s.pointer()["tables"]["chunk"]
    put("first words", 3)
    assert [r.chunk_text for r in s.read("chunk").collect()] == ["first words"] and s.pointer()["tables"]["chunk"] == chunk
    assert s.read("stat").first()[:] == (1, 2)
    index(s, files(spark, [("./x", "first words", 4)]), {"file"})  # a full run drops what is dead
    assert s.pointer()["tables"]["dead"] and s.dead(s.pointer()).count() == 0 and s._appended("chunk", s.pointer()).count() == 1
