import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation, grep, memory, muse, notes, search
from quarry.operators.ingest import content_hash
from quarry.serve import Api
from quarry.plans.index import index
from quarry.plans.store import Store


def corpus(spark, texts, epochs=("none",)):
    rows = [(f"h{i:03d}", e, j, c, None) for i, cs in enumerate(texts) for j, c in enumerate(cs) for e in epochs]
    chunks = spark.createDataFrame(rows, "content_hash string, model_id string, chunk_ix int, chunk_text string, embedding array<float>")
    source = spark.createDataFrame([(f"./f{i}.md", f"h{i:03d}", i, "") for i in range(len(texts))], "path string, content_hash string, mtime long, ts string")
    return chunks, source


def test_literal_terms():
    assert search.literal_terms("how does framed_next parse KDF, the (counted) framing?") == ["framed_next", "kdf", "counted", "framing", "parse"]
    assert search.literal_terms("The the A-1 x 3.53.4.") == ["a-1", "3.53.4", "the"]
    assert len(search.literal_terms(" ".join(f"term{i}" for i in range(20)))) == 8
    assert search.literal_terms("") == [] and search.is_hard("ab_c") and not search.is_hard("word") and not search.is_hard("--")


def test_rare_term_beats_volume(spark):
    c, _ = corpus(spark, [*[["framing counted parse here"]] * 6, ["only framed_next stands here"], ["nothing"]])
    got = search.literal_leg(c, {"q": "how does framed_next parse the counted framing"}).orderBy("leg_rank").collect()
    assert got[0].content_hash == "h006"


def test_bm25_by_hand(spark):
    c, _ = corpus(spark, [["apple banana"], ["apple apple cherry pear"], ["banana"], ["fig"]])
    idx, stats = search.postings(c), search.doc_lengths(c)
    got = {(r.content_hash): r.leg_rank for r in search.keyword_leg(idx, stats, {"q": "apple"}).collect()}
    n, avg = 4, 2.0
    idf = max(math.log((n - 2 + 0.5) / (2 + 0.5)), 1e-6)
    s = lambda tf, dl: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert (s(2, 4) > s(1, 2)) == (got["h001"] < got["h000"])
    phrase = search.keyword_leg(idx, stats, {"q": "apple-cherry"}).collect()
    assert [r.content_hash for r in phrase] == ["h001"]
    assert search.keyword_leg(idx, stats, {"q": "none"}).count() == 0


def test_epochs_change_nothing(spark):
    texts = [["alpha beta gamma", "delta"], ["beta beta"], ["gamma delta alpha"]]
    runs = []
    for epochs in (("a",), ("a", "b"), ("a", "b", "c", "d", "e")):
        c, s = corpus(spark, texts, epochs)
        runs.append([tuple(r) for r in search.ask(c, s, {"q": "alpha delta beta"}, 5).select("rank", "citation", F.round("rrf", 9), "frag").orderBy("rank").collect()])
    assert runs[0] == runs[1] == runs[2] and runs[0]


def leg(spark, rows):
    return spark.createDataFrame(rows, "qid string, content_hash string, chunk_ix int, leg int, leg_rank int, cos double")


def test_two_first_ranks(spark):
    got = search.fuse(leg(spark, [("q", "h", 0, 1, 1, None), ("q", "h", 0, 4, 1, None), ("q", "g", 0, 2, 1, 0.5)]), 5).orderBy("rank").collect()
    assert abs(got[0].rrf - 2 / 61) < 1e-12 and got[0].legs == 5 and got[1].cos == 0.5


def test_full_pool_admits_no_more(spark):
    rows = [("q", f"k{i:02d}", 0, 1, i + 1, None) for i in range(40)] + [("q", "only-vector", 0, 2, 1, 0.9), ("q", "k39", 0, 2, 2, 0.8)]
    got = {r.content_hash: r.legs for r in search.fuse(leg(spark, rows), 40).collect()}
    assert "only-vector" not in got and got["k39"] == 3 and len(got) == 40


def test_floor_empties_whole_answers(spark):
    r = search.fuse(leg(spark, [("a", "h", 0, 2, 1, 0.2), ("a", "g", 0, 1, 1, None), ("b", "h", 0, 1, 1, None)]), 5)
    assert {x.qid for x in search.confident(r, 0.5).collect()} == {"b"}
    assert search.confident(r, 0.0).count() == 3 and search.suppressed(r, 0.5).first().n_suppressed == 2


def test_fragments_and_lines(spark):
    c, s = corpus(spark, [["first part " + "x" * 200, "middle needle", "last"], ["needle alone"]])
    out = {r.citation: r for r in search.ask(c, s, {"q": "needle"}, 5).collect()}
    assert out["h000#1"].frag == search.HEAD | search.TAIL and out["h001#0"].frag == 0 and out["h000#1"].chunk_count == 3
    lines = [r.line for r in search.hit_lines(search.ask(c, s, {"q": "needle"}, 5)).orderBy("rank").collect()]
    assert any("[...] middle needle [...]" in x for x in lines) and lines[0].startswith("[1] rrf=0.0")
    lone = search.fragment_flags(spark.createDataFrame([("nowhere", 0)], "content_hash string, chunk_ix int"), c).first()
    assert lone.chunk_count == 0 and lone.frag == search.TAIL


def test_grep_filters(spark):
    c, s = corpus(spark, [["Pumps on\nline two"], ["pumps off"], ["none"]])
    s = s.withColumn("ts", F.when(F.col("path") == "./f0.md", "2051").when(F.col("path") == "./f1.md", "2024").otherwise(""))
    run = lambda *a, **k: [r.content_hash for r in grep.grep(c, s, *a, **k).collect()]
    assert run("PUMPS", True, since="2050") == ["h000"] and run("PUMPS", since="2050") == [] and run("PUMPS", True, until="2050") == ["h001"]
    assert run("^line") == ["h000"] and run("pumps|none", newest=True) == ["h001", "h002"] and run("none", until="2050") == ["h002"] and run("none", since="1") == []
    assert run(".", source_like="%F1.MD") == ["h001"]


def test_corrections(spark):
    c, _ = corpus(spark, [["license apache token"], ["tokens"]])
    got = {r.term: r.suggestion for r in search.corrected(["licence", "token", "zzz"], search.postings(c), spark).collect()}
    assert got == {"licence": "license"}


# Recall in the middle of the band


def vectors(spark, n=60, seed=3, shuffle=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) + (2.0 if j == i % 3 else 0) for j in range(8)]
        m = math.sqrt(sum(x * x for x in v))
        rows.append((f"h{i // 4:03d}", "m", i % 4, f"text {i}", [x / m for x in v]))
    random.Random(shuffle).shuffle(rows)
    c = spark.createDataFrame(rows, "content_hash string, model_id string, chunk_ix int, chunk_text string, embedding array<float>")
    s = spark.createDataFrame([(f"p{i}", f"h{i:03d}", 1000 + i, "") for i in range(n // 4)], "path string, content_hash string, mtime long, ts string")
    return c, s


def test_muse_repeats_and_stays_in_the_band(spark):
    c, s = vectors(spark)
    a, b = muse.muse(c, s, 3, seed=5), muse.muse(vectors(spark, shuffle=9)[0], s, 3, seed=5)
    assert a.seed == b.seed and a.results == b.results and a.floor == b.floor
    assert all((r["content_hash"], r["chunk_ix"]) != a.seed and r["rank"] > a.skip for r in a.results) and len(a.results) == 3
    assert muse.muse(c, s, 3, seed=6).floor == a.floor
    assert all(r["excerpt"].startswith("text ") and r["source"].startswith("p") for r in a.results)


def muse_py(vecs, k, seed, same_source=False):
    """The picks over all candidates in one list, in the order of their cosines."""
    keys = sorted(vecs)
    rng = muse.Random(seed)
    seed_key = keys[rng.below(len(keys))]
    stride = -(-len(keys) // min(len(keys), muse.SAMPLE))
    floor = muse.upper_median(np.array([vecs[x] for x in keys[::stride]][: muse.SAMPLE], np.float32))
    skip, window = muse.band_size(len(keys), k)
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b))
    near = sorted((-dot(vecs[x], vecs[seed_key]), x) for x in keys if x != seed_key)[: skip + window]
    some = lambda strict: [x for c, x in near[skip:] if -c >= floor and not (strict and x[0] == seed_key[0])]
    band = some(not same_source)
    if len(band) < k:
        band = some(False)
    if len(band) < k and len(near) - skip > len(band):
        band = [x for _, x in near[skip:]]
    band = band or [x for _, x in near]
    out, used = [], set()
    for s in range(k):
        lo, hi = s * len(band) // k, (s + 1) * len(band) // k
        if hi <= lo:
            continue
        at = rng.below(hi - lo)
        turn = [band[lo + (at + t) % (hi - lo)] for t in range(hi - lo)]
        out.append(next((x for x in turn if x[0] not in used), turn[0]))
        used.add(out[-1][0])
    return out


@pytest.mark.parametrize("k,seed,same", [(3, 1, False), (5, 2, True), (8, 3, False), (32, 4, False)])
def test_muse_against_one_list(spark, k, seed, same):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(130, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vecs = {(f"h{i // 4:03d}", i % 4): x.tolist() for i, x in enumerate(v)}
    chunks = spark.createDataFrame([(h, "m", i, "text", x) for (h, i), x in vecs.items()], "content_hash string, model_id string, chunk_ix int, chunk_text string, embedding array<float>")
    source = chunks.selectExpr("content_hash as path", "content_hash", "0L as mtime", "'' as ts").distinct()
    got = muse.muse(chunks, source, k, seed=seed, same_source=same)
    assert [(r["content_hash"], r["chunk_ix"]) for r in got.results] == muse_py(vecs, k, seed, same)


def test_no_task_of_muse_holds_the_corpus(spark, monkeypatch):
    c, _ = vectors(spark)
    plans = []
    real = muse.materialize
    monkeypatch.setattr(muse, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    muse.band(muse.numbered(c, "m"), *muse.numbered(c, "m").select("content_hash", "chunk_ix").first(), 60, 3, -2.0).collect()
    assert plans and all("SinglePartition" not in p or "sum(_t_" in p for p in plans)


def test_muse_edges(spark):
    c, s = vectors(spark)
    one = c.limit(1)
    assert muse.muse(one, s).degraded & muse.TINY
    with pytest.raises(muse.NoCorpus):
        muse.muse(c, s, model_id="other")
    with pytest.raises(muse.NoCorpus):
        muse.muse(c, s, at=("nope", 0))
    flat = s.withColumn("mtime", F.lit(7).cast("long"))
    assert muse.muse(c, flat, old=True).degraded & muse.NO_BIAS
    old = muse.muse(c, s, old=True, seed=2)
    assert old.age_distinct == 15 and int(old.seed[0][1:]) < 5
    two = c.where("content_hash = 'h000' and chunk_ix < 2")
    got = muse.muse(two, s, 2)
    assert len(got.results) >= 1 and got.degraded & muse.SAME_SOURCE


def test_muse_parts():
    assert muse.band_size(1000, 5) == (15, 50) and muse.band_size(20, 5) == (6, 13) and muse.band_size(2, 5) == (0, 1)
    assert muse.strata(7, 3) == [(0, 2), (2, 4), (4, 7)]
    r = muse.Random(1)
    first = [r.below(1000) for _ in range(5)]
    r = muse.Random(1)
    assert [r.below(1000) for _ in range(5)] == first and muse.Random(2).below(1 << 40) != muse.Random(1).below(1 << 40)
    import numpy as np

    assert muse.upper_median(np.array([[1, 0], [0, 1], [1, 0]], np.float32)) == 0.0
    assert muse.upper_median(np.zeros((1, 2), np.float32)) == muse.NO_FLOOR


# Notes


def test_blocks():
    text = "@note 1\n@at T1\n@type Task\n@place Zone  7\nhello\nworld\n@note 2\n@state open\nx\n\nstray\n@who Ann\r\n\n@note 3\n"
    got = notes.parse_blocks(text, "f.md")
    assert [(n["note_id"], n["text"], n["type"], n["place"]) for n in got] == [("1", "hello world", "task", "zone-7"), ("2", "x", "", ""), ("3", "", "", "")]
    now = "2024-01-02T03:04:05.000006Z"
    block = notes.capture_block("do it", now, type="task", place="Barn")
    back = notes.parse_blocks(block, "f")[0]
    assert back["note_id"] == "20240102-030405-000006" and back["state"] == "open" and back["text"] == "do it"
    assert notes.parse_blocks(notes.capture_block("saw a foal", now, type="observation"), "f")[0]["state"] == ""
    with pytest.raises(notes.Refused):
        notes.capture_block("", now)


def test_projection_and_duplicates(spark):
    files = spark.createDataFrame([("a.md", "@note 1\none\n\n@note 2\ntwo\n"), ("b.md", "@note 1\nagain\n"), ("c.md", None)], "path string, text string")
    parsed = notes.project(files)
    assert {r.note_id: r.text for r in notes.one_each(parsed).collect()} == {"1": "again", "2": "two"}
    assert notes.duplicate_ids(parsed).first().paths == ["a.md", "b.md"]


def note_rows(spark, *rows):
    return spark.createDataFrame([{f: r.get(f, "") for f in notes.NOTE_FIELDS} for r in rows], notes.NOTE)


def test_queries(spark):
    now = "2024-01-10T00:00:00.000000Z"
    n = note_rows(spark, {"note_id": "1", "ts": "2024-01-01", "type": "task", "who": "ann", "claimed": "2024-01-01"}, {"note_id": "2", "ts": "2024-01-05", "type": "task", "who": "bob", "lease": "2024-02-01"}, {"note_id": "3", "ts": "2024-01-07", "type": "observation", "who": "cy"}, {"note_id": "4", "ts": "2024-01-03", "closes": "1"})
    ids = lambda **k: [r.note_id for r in notes.query(n, now, **k).collect()]
    assert ids() == ["3", "2", "4", "1"] and ids(last=True) == ["3"] and ids(stale=True) == ["1"] and ids(pending=True) == ["4"]
    assert ids(type="Task", since="2024-01-02") == ["2"] and ids(closes="1") == ["4"] and ids(unclaimed=True) == ["4"] and ids(grep="^$", most=1) == ["3"]
    assert {(r.note_id, r.depth) for r in notes.closing_chain(n, "4").collect()} == {("4", 0), ("1", 1)}


def test_claims():
    now, later = "2024-01-01T00:00:00.000000Z", "2024-01-01T00:05:00.000000Z"
    free = notes.Claim()
    assert notes.take(free, "ann", now, "2m") == {"who": "ann", "claimed": now, "lease": "2024-01-01T00:02:00.000000Z"}
    held = notes.Claim("ann", now, "2024-01-01T00:02:00.000000Z")
    for bad in (lambda: notes.take(held, "bob", now), lambda: notes.take(free, "a", now, "soon"), lambda: notes.challenge(held, "bob", now), lambda: notes.challenge(free, "bob", now), lambda: notes.heartbeat(free, now), lambda: notes.steal(held, "bob", now), lambda: notes.steal(held, "bob", later)):
        with pytest.raises(notes.Refused):
            bad()
    assert notes.take(held, "bob", now, force=True)["who"] == "bob" and notes.take(held, "", now) == {"who": "", "claimed": "", "lease": "", "challenge": "", "stolen_from": ""}
    asked = notes.challenge(held, "bob", "2024-01-01T00:03:00.000000Z")["challenge"]
    held.challenge = asked
    assert notes.steal(held, "bob", later)["stolen_from"] == "ann"
    with pytest.raises(notes.Refused):
        notes.steal(held, "bob", "2024-01-01T00:03:30.000000Z")
    held.challenge = "bob 2030-01-01T00:00:00.000000Z"
    with pytest.raises(notes.Refused):
        notes.steal(held, "bob", later)
    assert notes.heartbeat(held, later, "1h")["challenge"] == ""


def test_events_structure_notes(spark):
    n = note_rows(spark, {"note_id": "1", "state": "open"}, {"note_id": "2", "who": "ann"})
    events = notes.events_of(spark, "2", {"who": "", "closes": "1"}, 1, "t").unionByName(notes.events_of(spark, "2", {"place": "barn"}, 2, "t"))
    got = {r.note_id: r for r in notes.structured(n, events).collect()}
    assert got["1"].state == "closed" and got["2"].who == "" and got["2"].place == "barn" and got["2"].closes == "1"
    assert notes.unknown_types(note_rows(spark, {"note_id": "1", "type": "todo"}, {"note_id": "2", "type": "task"})).first().type == "todo"


# Evaluation


def test_diagnosis(spark):
    q = spark.createDataFrame([(f"q{i}",) for i in range(8)], "id string")
    gold = spark.createDataFrame([(f"q{i}", "g", i) for i in range(7)], "id string, content_hash string, chunk_ix int")
    traps = spark.createDataFrame([("q1", "t", 0)], "id string, content_hash string, chunk_ix int")
    run = spark.createDataFrame([("q0", "g", 0, 1), ("q1", "t", 0, 1), ("q1", "g", 1, 2), ("q2", "g", 2, 7), ("q3", "g", 99, 3)], "qid string, content_hash string, chunk_ix int, rank int")
    deg = spark.createDataFrame([("q4", "g", 4, 3)], "qid string, content_hash string, chunk_ix int, rank int")
    full = spark.createDataFrame([("q5", "g", 5, 50), ("q6", "g", 6, 4)], "qid string, content_hash string, chunk_ix int, leg_rank int")
    out = evaluation.outcomes(q, run, deg, full, gold, traps, 40)
    assert {r.id: r.diagnosis for r in out.collect()} == {"q0": "HIT@1", "q1": "STALE_OUTRANKS", "q2": "HIT@K", "q3": "NEIGHBOUR_CHUNK", "q4": "KEYWORD_NO_MATCH", "q5": "KEYWORD_TOO_DEEP", "q6": "FUSED_OUT", "q7": "NOT_INDEXED"}
    s = evaluation.scores(out).first()
    assert s.n == 8 and s.r1 == 1 / 8 and abs(s.mrr - (1 + 0.5 + 1 / 7) / 8) < 1e-12
    assert {r.effect: r.n for r in evaluation.against_control(out).collect()} == {"helped": 3, "hurt": 1, "same": 4}
    assert sum(r.n for r in evaluation.labels(out).collect()) == 8
    assert evaluation.selectivity(full).first().median_matches == 1


def test_labelled_file(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("# comment\nq1\tdev\tidentifier\tindexed\tfile\twhat \"is\" it\tneedle\t\nq2\ttest\tx\tindexed\tfile\tq\tabsent\tneedle\n")
    q = evaluation.load_queries(spark, str(tmp_path / "q.tsv"))
    assert q.count() == 2 and q.where("id = 'q1'").first().trap == ""
    c, _ = corpus(spark, [["a needle"], ["b"]])
    gold, traps = evaluation.resolve(c, q), evaluation.resolve(c, q, "trap")
    assert [tuple(r) for r in gold.collect()] == [("q1", "h000", 0)]
    assert {r.id: r.defect for r in evaluation.defects(q, gold, traps).collect()} == {"q2": "anchor resolves to no chunk"}


# Memories


def test_memories(spark):
    m = spark.createDataFrame([("a", "t", "x", "2024-01", False, "p1", "h1"), ("b", "t", "x", "2024-02", False, "p1", "h2"), ("c", "t", "y", "2024-03", True, "p2", "h")], "id string, text string, about string, valid_from string, retracted boolean, witness_path string, witness_hash string")
    e = spark.createDataFrame([("b", "a"), ("c", "b")], "successor string, predecessor string")
    assert [r.id for r in memory.current(m, e).collect()] == ["b"] and [r.id for r in memory.warn_about(m, e, "x").collect()] == ["b"]
    v = memory.validity(m, e)
    assert [r.id for r in memory.as_of(v, "2024-01-15").collect()] == ["a"]
    assert {r.id for r in memory.why(m, e, "c").collect()} == {"a", "b", "c"}
    s = spark.createDataFrame([("p1", "h1")], "path string, content_hash string")
    assert {r.id for r in memory.stale_witness(m, s).collect()} == {"b", "c"}


def test_calendar(spark):
    ev = spark.createDataFrame([("w", "2024-01-01 10:00:00", "2024-01-01 11:00:00", 7, None), ("o", "2024-01-09 00:00:00", "2024-01-10 00:00:00", None, None), ("u", "2024-01-01 00:00:00", "2024-01-01 01:00:00", 1, "2024-01-03 00:00:00")], "event_id string, begin string, end string, every_days int, until string")
    got = sorted((r.event_id, str(r.starts)) for r in memory.occurrences(ev, "2024-01-02", "2024-01-20").collect())
    assert got == [("o", "2024-01-09 00:00:00"), ("u", "2024-01-02 00:00:00"), ("u", "2024-01-03 00:00:00"), ("w", "2024-01-08 10:00:00"), ("w", "2024-01-15 10:00:00")]


# The service


def test_service(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    index(s, spark.createDataFrame([("./barn.md", "horses near the water trough\n", 1), ("./tax.md", "forms and receipts\n", 1)], "path string, text string, mtime long"), {"file"})
    s.commit(note=note_rows(spark, {"note_id": "1", "ts": "2024", "text": "x"}))
    api = Api(spark, s, str(tmp_path / "captures"), "http://x")
    ok, out = api.get("/api/ask", {"q": "horses at the trough", "k": "99"})
    assert ok == 200 and out["results"][0]["path"] == "./barn.md" and out["results"][0]["link"] == "http://x/file?name=barn.md&ci=tip"
    assert out["results"][0]["snippet"] == "[horses] near [the] water [trough]\n"
    h = out["results"][0]["content_hash"]
    assert api.get("/api/chunk", {"hash": h, "ix": "0"})[1]["chunk_text"].startswith("horses") and api.get("/api/chunk", {"hash": "no"})[0] == 404
    assert api.get("/api/health", {})[1]["chunks"] == 2 and api.get("/api/pending", {})[1]["notes"][0]["note_id"] == "1" and api.get("/api/ask", {})[0] == 400 and api.get("/x", {})[0] == 404
    assert api.post("/api/capture", {}, {"text": "x"})[0] == 403
    local = {"x-quarry-local": "1"}
    assert api.post("/api/capture", local, {"text": ""})[0] == 400 and api.post("/api/capture", local, {"text": "fix pump", "type": "task"})[0] == 200
    assert api.post("/api/structure", local, {"id": "1", "who": "ann"})[0] == 200
    assert api.post("/api/structure", local, {"id": "1", "who": "bob"})[0] == 409
    assert api.get("/api/notes", {"who": "ann"})[1]["notes"][0]["note_id"] == "1"
    assert api.post("/api/reindex", local, {})[0] == 501


def test_edits_outlive_index_runs_and_races_have_one_winner(spark, tmp_path, monkeypatch):
    from quarry.plans import index as runs
    from quarry.plans.store import Conflict

    s = Store(spark, f"file://{tmp_path}/store")
    files = spark.createDataFrame([("./barn.md", "horses\n", 1)], "path string, text string, mtime long")
    captures = spark.createDataFrame([("captures/2024-01.md", "@note 1\n@at 2024-01-01\nmend it\n\n@note 2\n@at 2024-01-02\nold one\n")], "path string, text string")
    index(s, files, {"file"}, captures=captures)
    api = Api(spark, s, str(tmp_path / "captures"))
    local = {"x-quarry-local": "1"}
    assert api.post("/api/structure", local, {"id": "1", "type": "task", "state": "open", "closes": "2"})[0] == 200
    assert api.post("/api/structure", local, {"id": "1", "who": "ann", "lease": "2h"})[0] == 200
    for _ in range(2):
        index(s, files, {"file"}, captures=captures)
        got = {r.note_id: r for r in s.notes().collect()}
        assert (got["1"].type, got["1"].state, got["1"].who, got["2"].state) == ("task", "open", "ann", "closed")
        assert api.get("/api/notes", {"type": "task", "who": "ann"})[1]["notes"][0]["text"] == "mend it"
    assert api.post("/api/structure", local, {"id": "1", "who": ""})[0] == 200

    # Bob claims between another claim's reading and its commit.
    real, once = s.commit, []

    def late(**kw):
        if not once:
            once.append(1)
            runs.edit_note(s, "1", lambda c: notes.take(c, "bob", "2024-02-01"), "2024-02-01")
        return real(**kw)

    monkeypatch.setattr(s, "commit", late)
    with pytest.raises(notes.Refused, match="bob"):
        runs.edit_note(s, "1", lambda c: notes.take(c, "cat", "2024-02-02"), "2024-02-02")
    assert {r.who for r in s.notes().where("note_id = '1'").collect()} == {"bob"}
    at = s.pointer()
    real(source=s.read("source"))
    with pytest.raises(Conflict):
        real(at=at, source=s.read("source"))
    chunk = s.pointer()["tables"]["chunk"]
    real(at=at, note=s.read("note"))  # what others changed is none of its tables
    assert s.pointer()["tables"]["chunk"] == chunk


def test_stored_index_answers_as_a_scan_does(spark, tmp_path, monkeypatch):
    from quarry.functions.words import porter_udf, porter_words
    from quarry.plans import index as runs

    s = Store(spark, f"file://{tmp_path}/store")
    texts = {"./a": "Running horses near the X-42 trough\n" * 50, "./b": "the horse runs\nABC_9 abc_9x\n", "./c": "receipts and forms\n", "./d": "horse receipts\n"}
    put = lambda names: spark.createDataFrame([(n, texts[n], 1) for n in names], "path string, text string, mtime long")
    index(s, put(["./a", "./c"]), {"file"})
    index(s, put(["./b", "./d"]), set(), incremental=True)
    asked = {"q1": "horses running", "q2": "abc_9 receipt", "q3": "X-42"}
    for names in (list(texts), ["./a", "./b"]):
        index(s, put(names), {"file"})
        chunks = s.read("chunk")
        terms = sorted({t for q in asked.values() for t in porter_words(q)})
        scan = search.ask(chunks, s.read("source"), asked, 5, index=search.postings(chunks, porter_udf(), terms), stats=search.doc_lengths(chunks, porter_udf()), tokens=porter_words)
        cols = ["qid", "rank", "citation", "source", "excerpt", "legs", "frag", "chunk_count"]
        got = runs.ask(s, asked, 5)
        rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
        assert rows(got) == rows(scan) and {r.qid for r in got.collect()} == set(asked)
    assert "PushedFilters: [In(content_hash" in got._jdf.queryExecution().toString()
    literal = search.literal_leg_stored(s.read("word"), s.read("chunk"), asked)
    plan = literal._jdf.queryExecution().toString()
    assert "chunk_text" not in plan.split("== Physical Plan ==")[1]
    assert search.literal_leg_stored(s.read("word"), s.read("chunk"), {}).count() == 0
    few = sorted(map(tuple, literal.collect()))
    monkeypatch.setattr(search, "TERMS_AT_ONCE", 0)
    assert few and sorted(map(tuple, search.literal_leg_stored(s.read("word"), s.read("chunk"), asked).collect())) == few


def test_command_line(spark, tmp_path):
    from quarry.cli import parser, run

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/barn.md").write_text("horses near the water trough\n")
    (tmp_path / "docs/tax.md").write_text("2024-01-02T00:00:00 forms\nand receipts\n")
    lines = []
    base = ["--store", f"file://{tmp_path}/store", "--captures", str(tmp_path / "captures")]
    do = lambda *a: run(spark, parser().parse_args([*base, *a]), lines.append)
    assert do("capture", "mend the gate", "--type", "task", "--place", "North Gate") == 0
    assert do("index", str(tmp_path / "docs")) == 0 and lines[-1].startswith("2 sources, 2 chunks")
    assert do("ask", "where are the horses") == 0 and "barn.md" in lines[-1]
    assert do("grep", "^and", "--since", "2024") == 0 and "tax.md" in lines[-1] and do("grep", "nothing") == 1
    assert do("notes", "--place", "north gate") == 0 and lines[-1].endswith("mend the gate")
    note = lines[-1].split("\t")[0]
    assert do("structure", note, "--who", "ann", "--lease", "2h") == 0 and "who=ann" in lines[-1]
    with pytest.raises(notes.Refused):
        do("structure", note, "--who", "bob")
    assert do("push", f"file://{tmp_path}/peer") == 0 and do("pull", f"file://{tmp_path}/peer") == 0
    (tmp_path / "docs/tax.md").unlink()
    assert do("index", str(tmp_path / "docs")) == 0 and lines[-1].startswith("1 sources, 1 chunks, 1 retired")
    with pytest.raises(muse.NoCorpus):
        do("muse")


def test_hashes_agree(spark):
    import hashlib

    assert spark.createDataFrame([("é",)], "t string").select(content_hash(F.col("t"))).first()[0] == hashlib.sha256("é".encode()).hexdigest()
