"""Nearest vectors, musing on texts, recurrence, leases, gram index, typos, anchors and digest trees against plain Python."""

import calendar
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation, ingest, memory, muse, nearest, search
from quarry.streaming import leases

CHUNK = "content_hash string, model_id string, chunk_ix int, chunk_text string, embedding array<float>"


def plan(df):
    return df._jdf.queryExecution().toString()


# Nearest vectors


@pytest.mark.parametrize("block", [3, 10_000])
def test_nearest_is_exact_with_ties_and_any_block(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "QUERIES", block)
    monkeypatch.setattr(nearest, "PRODUCTS", 64)
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 4)).astype(np.float32)  # many equal products
    v[100:180] = v[7]
    rows = [(f"h{i % 60:03d}", i // 60, v[i].tolist()) for i in map(int, rng.permutation(300))] + [("null", 0, None), ("short", 0, [1.0])]
    asked = [(i, v[i].tolist()) for i in range(0, 300, 37)] + [(999, None)]
    got = nearest.nearest(spark.createDataFrame(rows, "h string, ix int, e array<float>").repartition(7), spark.createDataFrame(asked, "qid long, vec array<float>"), ["h", "ix"], "e", 9)
    found = sorted((r.qid, r["rank"], r.h, r.ix, r.cos) for r in got.collect())
    want = []
    for q, w in asked[:-1]:
        each = sorted((-float(np.dot(np.float64(e), np.float64(w))), h, i) for h, i, e in rows[:300])[:9]
        want += [(q, n + 1, h, i, -c) for n, (c, h, i) in enumerate(each)]
    assert found == sorted(want)


# Musing on texts


@pytest.mark.parametrize("seed", [1, 2])
def test_context_picks_greedily_one_for_each_source(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(80, 6))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    words = "barn trough hay saddle rein gallop foal mare".split()
    text = [" ".join(rng.choice(words, 3)) for _ in range(80)]
    rows = [(f"h{i // 4:02d}", "m", i % 4, text[i], v[i].tolist()) for i in range(80)]
    chunks = spark.createDataFrame([*rows, ("other", "x", 0, "y", v[0].tolist())], CHUNK)
    source = spark.createDataFrame([(f"./{i // 2}.md", f"h{i:02d}", 1, "") for i in range(20)], "path string, content_hash string, mtime long, ts string")
    probes = [("a", "barn and hay", 3), ("a", "mare", 40), ("b", "", 77)]
    got = muse.context(chunks, source, spark.createDataFrame([(c, t, v[i].tolist()) for c, t, i in probes] + [("c", "no vector", None)], "ctx string, text string, vec array<float>"), "m", 4, per_probe=10)
    want = []
    for ctx in "ab":
        rel = {}
        for _, t, q in (p for p in probes if p[0] == ctx):
            cos = v.astype(float) @ v[q].astype(float)
            top = sorted(range(80), key=lambda i: (-cos[i], i))[:10]
            for i in {j for i in top for j in (i - 1, i, i + 1) if i // 4 == j // 4 and j >= 0}:
                asked = set(t.split())
                rel[i] = max(rel.get(i, -9), cos[i] - 0.3 * len(asked & set(text[i].split())) / max(1, len(asked)))
        chosen = []
        while len(chosen) < 4:
            free = [i for i in rel if i // 8 not in {j // 8 for j in chosen}]
            if not free:
                break
            score = lambda i: rel[i] - (0.5 * max(float(v[i].astype(float) @ v[j].astype(float)) for j in chosen) if chosen else 0)  # noqa: B023, E731
            chosen.append(min(free, key=lambda i: (-round(score(i), 9), i)))
            want.append((ctx, len(chosen), f"h{chosen[-1] // 4:02d}", chosen[-1] % 4, f"./{chosen[-1] // 8}.md"))
    assert sorted((r.ctx, r["rank"], r.content_hash, r.chunk_ix, r.source) for r in got.collect()) == want


def test_context_without_a_model_and_probes(spark):
    chunks = spark.createDataFrame([(f"h{i}", "none", 0, t, None) for i, t in enumerate(["the trough is dry", "the the the", "hay in the barn", "trough trough trough"])] + [("h0", "none", 1, "and so on", None)], CHUNK)
    source = spark.createDataFrame([(f"./{i}", f"h{i}", 1, "") for i in range(4)], "path string, content_hash string, mtime long, ts string")
    got = muse.context_by_words(chunks, source, search.postings(chunks), search.doc_lengths(chunks), {"q": "the trough", "none": "zebra"}, 3, rarest=1)
    assert [(r["rank"], r.content_hash, r.chunk_ix) for r in got.orderBy("rank").collect()] == [(1, "h3", 0), (2, "h0", 0)]
    assert muse.probes_of(" short text ") == ["short text"] and muse.probes_of("") == [] and len(muse.probes_of("x" * 500 + "\n\n" + "\n \n".join("abcdefghij"))) == 8


# Recurrence


def days_of(rule, first, until):
    """A rule's dates by looking at every day."""
    part = dict(p.split("=") for p in rule.split(";"))
    every, freq = int(part.get("INTERVAL", 1)), part["FREQ"]
    names = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
    out, d = [], first
    while d <= until:
        last = calendar.monthrange(d.year, d.month)[1]
        monday = lambda x: x - timedelta(days=x.weekday())
        n = {"DAILY": (d - first).days, "WEEKLY": (monday(d) - monday(first)).days // 7, "MONTHLY": (d.year - first.year) * 12 + d.month - first.month, "YEARLY": d.year - first.year}[freq]
        ok = n % every == 0
        if "BYMONTH" in part:
            ok &= d.month in map(int, part["BYMONTH"].split(","))
        elif freq == "YEARLY" and "BYDAY" not in part and "BYMONTHDAY" not in part:
            ok &= d.month == first.month
        if "BYMONTHDAY" in part:
            ok &= any(x in (d.day, d.day - last - 1) for x in map(int, part["BYMONTHDAY"].split(",")))
        if "BYDAY" in part:
            ok &= any(x[-2:] == names[d.weekday()] and (x[:-2] == "" or freq in ("DAILY", "WEEKLY") or int(x[:-2]) in ((d.day + 6) // 7, -((last - d.day) // 7 + 1))) for x in part["BYDAY"].split(","))
        if "BYDAY" not in part and "BYMONTHDAY" not in part:
            ok &= {"DAILY": True, "WEEKLY": d.weekday() == first.weekday()}.get(freq, d.day == first.day)
        if ok:
            out.append(d)
        d += timedelta(days=1)
    return out[: int(part["COUNT"])] if "COUNT" in part else out


def test_rules_against_every_day(spark):
    rng = random.Random(3)
    rules = []
    for _ in range(60):
        freq = rng.choice(["DAILY", "WEEKLY", "MONTHLY", "YEARLY"])
        r = [f"FREQ={freq}"] + [f"INTERVAL={rng.randrange(1, 5)}"] * rng.randrange(2) + [f"COUNT={rng.randrange(1, 30)}"] * rng.randrange(2)
        if rng.random() < 0.4:
            r.append("BYDAY=" + ",".join(rng.choice(["", "", "1", "2", "-1"] if freq in ("MONTHLY", "YEARLY") else [""]) + d for d in rng.sample(["MO", "TU", "WE", "TH", "FR", "SA", "SU"], 2)))
        if rng.random() < 0.3:
            r.append("BYMONTHDAY=" + ",".join(map(str, rng.sample([1, 13, 15, 29, 31, -1, -3], 2))))
        if rng.random() < 0.3:
            r.append("BYMONTH=" + ",".join(map(str, rng.sample(range(1, 13), 4))))
        rng.shuffle(r)
        rules.append(";".join(r))
    starts = [datetime(2023, 1, 1, 9, 30) + timedelta(days=rng.randrange(420)) for _ in rules]
    ev = spark.createDataFrame([(i, str(s), str(s + timedelta(hours=30)), r) for i, (s, r) in enumerate(zip(starts, rules, strict=True))], "event_id int, begin string, end string, rule string")
    low, high = datetime(2024, 2, 10), datetime(2024, 5, 20)
    got = sorted((r.event_id, str(r.starts)) for r in memory.occurrences(ev, str(low), str(high)).collect())
    want = sorted((i, f"{d.date()} 09:30:00") for i, (s, r) in enumerate(zip(starts, rules, strict=True)) for d in days_of(r, s, high) if d < high and d + timedelta(hours=30) > low)
    assert got == want and len(got) > 200


def test_exceptions_overrides_zones_and_odd_rules(spark):
    rows = [
        ("out", "2024-03-04 10:00:00", "2024-03-04 11:00:00", "RRULE:freq=weekly; count=4", ["2024-03-11 10:00:00"], None),
        ("zone", "2024-03-29 09:00:00", "2024-03-29 10:00:00", "FREQ=DAILY;UNTIL=20240402", None, "Europe/Berlin"),  # clocks change on the 31st
        ("odd", "2024-03-05 00:00:00", "2024-03-05 01:00:00", "FREQ=HOURLY", None, None),
        ("back", "2024-03-05 02:00:00", "2024-03-05 01:00:00", "", None, None),
        ("never", "soon", "later", "FREQ=DAILY", None, None),
        ("moved", "2024-01-01 08:00:00", "2024-01-01 09:00:00", "FREQ=MONTHLY", None, None),
    ]
    ev = spark.createDataFrame(rows, "event_id string, begin string, end string, rule string, exdates array<string>, zone string")
    over = spark.createDataFrame([("out", "2024-03-18 10:00:00", None, None, True), ("moved", "2024-05-01 08:00:00", "2024-03-20 08:00:00", "2024-03-20 09:00:00", False), ("moved", "2024-03-01 08:00:00", "2024-06-01 08:00:00", "2024-06-01 09:00:00", False)], "event_id string, recurrence_id string, begin string, end string, cancelled boolean")
    got = {}
    for r in memory.occurrences(ev, "2024-03-01", "2024-04-30", over).orderBy("starts").collect():
        got.setdefault(r.event_id, []).append(str(r.starts)[5:16])
    assert got == {"out": ["03-04 10:00", "03-25 10:00"], "zone": ["03-29 08:00", "03-30 08:00", "03-31 07:00", "04-01 07:00", "04-02 07:00"], "odd": ["03-05 00:00"], "moved": ["03-20 08:00", "04-01 08:00"]}
    assert memory.occurrences(ev.limit(0), "2024-03-01", "2024-04-30").count() == 0


# Leases


def test_each_lease_expires_once_on_replay(spark, tmp_path):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    first = [("n1", "ann", t(4), t(0), 1), ("n1", "ann", t(8), t(3), 2), ("n2", "bob", t(2), t(1), 3), ("n3", "cyd", t(9), t(2), 4), ("n3", "", None, t(3), 5)]
    second = [
        ("n1", "ann", t(8), t(3), 2),  # the same heartbeat again
        ("n1", "ann", t(5), t(2.5), 9),  # one that is late and older
        ("n2", "bob", t(12), t(7), 6),  # after the end: a claim anew
        ("n4", "dan", t(6), t(5), 7),
        ("n4", "eve", t(30), t(5.5), 8),  # stolen before the end
        ("n5", "fay", t(40), t(20), 10),
    ]
    schema = "note_id string, who string, lease timestamp, at timestamp, seq long"

    def run(batches, name):
        target, checkpoint, inbox = (str(tmp_path / f"{name}-{x}") for x in ("out", "state", "in"))
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(inbox)
            leases.run_once(spark, leases.expiries(spark.readStream.schema(schema).parquet(inbox)), target, checkpoint)
        return sorted((r.note_id, r.who, r.lease, r.claimed) for r in spark.read.schema(leases.EXPIRED).parquet(target).collect())

    want = [("n1", "ann", t(8), t(0)), ("n2", "bob", t(2), t(1)), ("n2", "bob", t(12), t(7))]
    assert run([first, second], "two") == want
    assert run([first + second], "one") == want
    assert run([first, second, second], "again") == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none").endswith(("none", "HDFSBackedStateStoreProvider"))


# The gram index, typos, anchors


def test_words_that_hold_a_term_are_found_by_grams(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcß-") for _ in range(rng.randrange(1, 9))) for _ in range(400)}
    terms = ["a", "ab", "abc", "ß-a", "aabb", "cabcab", "nowhere", "ßß"]
    grams = search.word_grams(spark.createDataFrame([(w,) for w in words], "word string"))
    got = {(r.term, r.word) for r in search.words_holding(grams, terms).collect()}
    assert got == {(t, w) for t in terms for w in words if t in w}


def test_thousands_of_typos_without_a_nested_loop(spark):
    rng = random.Random(4)
    vocabulary = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 14))) for _ in range(1500)})
    chunks = spark.createDataFrame([(f"h{i}", 0, " ".join(vocabulary[i::20] + vocabulary[:i])) for i in range(20)], "content_hash string, chunk_ix int, chunk_text string")

    def typo(w):
        for _ in range(rng.randrange(1, 3)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdefg") + w[i:], w[:i] + rng.choice("abcdefg") + w[i + 1 :]])
        return w

    terms = sorted({typo(rng.choice(vocabulary)) for _ in range(2000)} | {vocabulary[0], "", "x"})
    out = search.corrected(terms, search.postings(chunks), spark)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    got = {r.term: (r.suggestion, r.distance) for r in out.collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    df = {w: sum(w in set(vocabulary[i::20] + vocabulary[:i]) for i in range(20)) for w in vocabulary}
    for t in rng.sample(terms, 120):
        edits = 2 if len(t) >= 8 else 1 if len(t) >= 4 else 0
        near = [(d, -df[w], w) for w in vocabulary if abs(len(w) - len(t)) <= edits and (d := distance(t, w)) <= edits]
        assert got.get(t) == ((min(near)[2], min(near)[0]) if near and t not in df else None)


def test_anchors_of_any_shape_resolve_without_a_nested_loop(spark):
    rng = random.Random(6)
    words = "alpha beta gamma delta alphabet betas x".split()
    texts = [(" " if rng.random() < 0.3 else "") + rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(120)] + [""]
    chunks = spark.createDataFrame([(f"h{i}", "none", 0, t, None) for i, t in enumerate(texts)] + [("h0", "other", 0, texts[0], None)], CHUNK)
    anchors = ["alpha beta gamma", "pha be", "eta", "a", " x ", "betas\nx", "lphabet alpha g", "zebra", "alpha zebra beta", "", None, " ", "gamma delta"]
    asked = spark.createDataFrame(list(enumerate(anchors)), "id int, anchor string")
    out = evaluation.resolve(chunks, asked)
    got = {(r.id, r.content_hash) for r in out.collect()}
    assert got == {(i, f"h{n}") for i, a in enumerate(anchors) if a for n, t in enumerate(texts) if a in t} and len({i for i, _ in got}) == 8
    assert out.count() == len(got)
    assert "NestedLoop" not in plan(evaluation.resolve(chunks, asked.where("id < 8 and id <> 4")))


# Digest trees


def test_differences_by_trees(spark):
    rows = [(f"./{i}.md", f"h{i}") for i in range(500)]
    other = [(p, "new" if i % 50 == 0 else h) for i, (p, h) in enumerate(rows) if i % 77] + [("./x", "h"), ("./null", None)]
    df = lambda r: spark.createDataFrame(r, "path string, content_hash string")
    a, b = df(rows), df(other)
    one, two = ingest.digest_tree(a, 2), ingest.digest_tree(b.union(b.limit(0)).repartition(3), 2)
    got = {(r.path, r.change, r.mine, r.theirs) for r in ingest.corpus_difference(a, b, one, two, 2).collect()}
    there = dict(other)
    want = {(p, "removed" if p not in there else "changed", h, there.get(p)) for p, h in rows if there.get(p) != h} | {("./x", "added", None, "h")}
    assert got == want
    top = lambda t: t.where("level = 0").first()
    assert top(one).n == 500 and top(one).digest != top(two).digest and top(ingest.digest_tree(df(rows[::-1]), 2)).digest == top(one).digest
    assert ingest.corpus_difference(a, a, digits=2).count() == 0 and ingest.corpus_difference(a.limit(0), a.limit(0)).count() == 0
    assert ingest.corpus_difference(a.limit(0), a.where("path = './1.md'")).first().change == "added"


def test_only_candidate_words_are_read(spark, tmp_path):
    from quarry.plans.index import index
    from quarry.plans.store import Store

    s = Store(spark, f"file://{tmp_path}/store", stemmed=False)
    texts = [(f"./{i}", f"word{i} common abc_{i}\n", 1) for i in range(40)]
    index(s, spark.createDataFrame(texts, "path string, text string, mtime long"), {"file"})
    found = search.literal_leg_stored(s.read("word"), s.read("chunk"), {"q": "ABC_17 common"}, grams=s.read("gram"))
    assert [r.content_hash for r in found.where("leg_rank = 1").collect()] == [ingest_hash("word17 common abc_17\n")]
    held = s.read("word").where(F.col("word").isin("abc_17", "common"))
    assert "In(word" in plan(held) and {r.word for r in search.words_holding(s.read("gram"), ["abc_17", "common"]).collect()} == {"abc_17", "common"}


def ingest_hash(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


# Memories in fences


def test_blocks_in_fences_and_not_in_quotes(spark):
    one = "```memory\nid: mem-1\nclaim: the well is dry\n  since May\nabout: well, barn ,well\nvalid-from: 2024-01-01\nother: x\n```\n"
    text = "# notes\n" + one + "````\n" + one.replace("mem-1", "mem-2") + "````\n~~~ memory\nclaim: hay is wet\nactor: ann\n~~~\n```memory\nabout: nothing\n```\n   ```memory\nclaim: unclosed"
    assert [(m["id"][:5], m["claim"]) for m in memory.blocks_of(text)] == [("mem-1", "the well is dry since May"), (memory.blocks_of(text)[1]["id"][:5], "hay is wet"), (memory.blocks_of(text)[2]["id"][:5], "unclosed")]
    edited = text.replace("# notes", "# other").replace("hay is wet", "hay is dry")
    later = one.replace("dry", "full").replace("2024-01-01", "2024-02-01")
    rows = [("h1", text), ("h2", edited), ("h3", later), ("h4", None), ("h5", ""), ("h6", "no memory here")]
    got = {r.id: r for r in memory.contained(spark.createDataFrame(rows, "content_hash string, text string")).collect()}
    assert len(got) == 4 and got["mem-1"].claim == "the well is full since May" and got["mem-1"].about == ["well", "barn"] and got["mem-1"].content_hash == "h3"
    assert {r.claim for r in got.values()} == {"the well is full since May", "hay is wet", "hay is dry", "unclosed"}


def test_candidates_share_a_subject_and_words(spark):
    rows = [("a", "the well is dry", ["well"], False), ("b", "the well is full", ["well", "barn"], False), ("c", "the well is old", ["roof"], False), ("d", "hay", ["well"], False), ("e", "well dry dry", ["well"], True), ("f", "the dry well", ["barn"], False)]
    m = spark.createDataFrame(rows, "id string, text string, about array<string>, retracted boolean")
    e = spark.createDataFrame([("b", "a")], "successor string, predecessor string")
    claims = spark.createDataFrame([("q", "The well: dry again", ["well", "barn"]), ("b", "well", ["well"]), ("n", "zebra", ["well"]), ("z", None, None)], "qid string, text string, about array<string>")
    got = [(r.qid, r["rank"], r.id, r.shared) for r in memory.remember_candidates(m, e, claims).orderBy("qid", "rank").collect()]
    assert got == [("q", 1, "f", 3), ("q", 2, "b", 2)]
