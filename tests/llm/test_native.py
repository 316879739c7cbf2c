"""Quality rules, decontamination, sharding and mixing against plain Python on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import decontaminate, mixing, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_py(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base_py(t):
    t = t or ""
    w = words_py(t)
    lines = [x for x in t.split("\n") if words_py(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    covered = {j for i, x in enumerate(wins) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


EDGES = [None, "", " \n\t ", "one", "a b c d e f g h", "x " * 9, "x " * 400, "a\nb\na\n\n\na", "é ü ñ z \x0b\x0c\x1c", "a b c d e f g h i a b c d e f g h", "#*$%&|<>" * 5, "日本 語" * 30, "w" * 50_000, " ".join(f"w{i % 97}" for i in range(20_000))]


def test_base_counts_are_exact(spark):
    rng = random.Random(4)
    texts = EDGES + [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "\nb b\nb b"]) for _ in range(150)]
    got = quality.measure(docs(spark, texts), keep=["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [base_py(t) for t in texts]


def test_quality_keeps_prose_and_rejects_junk(spark):
    rng = random.Random(1)
    prose = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(120)).capitalize() + "." for _ in range(120)]
    symbols = [" ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in p.split()) for p in prose[:12]]
    repeats = [" ".join(p.split()[:3] * 40) for p in prose[:12]]
    shout = [" ".join(p.upper().split()[:20] * 6) for p in prose[:12]]
    texts = prose + symbols + repeats + shout + [None, "", "short text"]
    got = {r.doc_id: r for r in quality.judge(docs(spark, texts), keep=["doc_id"]).collect()}
    assert all(got[i].kept for i in range(120))
    assert not any(got[i].kept for i in range(120, len(texts)))
    assert all(got[i].posterior < 0.5 for i in range(120, 132)) and got[len(texts) - 1].base_failed


def test_quality_stage_keeps_columns_and_rows(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))
    df = docs(spark, [good, good, "bad"]).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(None).cast("string")).withColumn("_quality_kept", F.lit(1))
    out = quality.keep_good(df)
    assert out.columns == df.columns and out.count() == 2 and {r.kept for r in out.collect()} == {"mine"}
    assert quality.keep_good(df.limit(0)).count() == 0 and quality.judge(df.limit(0), keep=["doc_id"]).count() == 0


def test_em_matches_a_plain_version():
    patterns = [((1, 0, -1), 30), ((1, 1, 0), 500), ((0, -1, -1), 40), ((0, 0, 0), 7)]
    prior, acc = quality.fit(patterns)
    p, a = 0.5, [0.8] * 3
    rows = [v for v, n in patterns for _ in range(n)]
    for _ in range(100):
        post = [1 / (1 + math.exp(-(math.log(p / (1 - p)) + sum(x * math.log(y / (1 - y)) for x, y in zip(v, a))))) for v in rows]
        p = min(max(sum(post) / len(rows), 0.05), 0.95)
        a = [min(max((sum(q if v[j] > 0 else 1 - q for q, v in zip(post, rows) if v[j]) + 1.6) / (sum(v[j] != 0 for v in rows) + 2), 0.55), 0.995) for j in range(3)]
    assert abs(prior - p) < 1e-6 and all(abs(x - y) < 1e-6 for x, y in zip(acc, a))
    assert quality.fit([]) == (0.5, [])


# Decontamination

ITEM = "Yesterday, Alice walked 5 km in 20 minutes and then Bob walked 5 km home again, slowly."


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_reparameterised_questions(spark):
    texts = [
        "intro words here. " + ITEM + " trailing words there",
        ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("5", "9").replace("20", "31"),
        ITEM.replace("Alice", "Carol").replace("walked 5 km home", "walked 8 km home"),
        ITEM.lower(),
        "nothing of the kind is told in this text at all",
        None, "",
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs(spark, texts), bench(spark, [ITEM, "Short one.", None, "", "!!!"])).collect()}
    assert got[(0, 0)] == "verbatim" and got[(1, 0)] == "reparameterised" and (2, 0) not in got and all(k[1] == 0 for k in got)
    assert (4, 0) not in got and (5, 0) not in got


def test_windows_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"{c}{d}" for c in "abcdefg" for d in "xyz"]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    texts = []
    for _ in range(80):
        it = rng.choice(items).split()
        if rng.random() < 0.5:
            it[rng.randrange(len(it))] = "zz"
        texts.append(" ".join([rng.choice(vocab) for _ in range(rng.randrange(8))] + it + [rng.choice(vocab) for _ in range(3)]))
    texts += items[:5] + [None, ""]

    def wins(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = {(d, i) for d, t in enumerate(texts) for i, b in enumerate(items) if len(wins(t) & wins(b)) >= 0.8 * len(wins(b))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, texts), bench(spark, items)).collect()}
    assert got == want and want


def test_shuffled_join_finds_the_same(spark, monkeypatch):
    df, b = docs(spark, ["x " + ITEM, ITEM + " y", "clean words only in here now"]), bench(spark, [ITEM])
    first = sorted(map(tuple, decontaminate.leaks(df, b).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, decontaminate.leaks(df, b).collect())) == first and len(first) == 2


def test_leaked_documents_go(spark):
    df = docs(spark, [ITEM, "clean words stay in this table", ITEM + " more", None], ids=[1, 2, 1, None]).withColumn("item_id", F.lit("x")).withColumn("h", F.lit(0))
    out = decontaminate.drop_leaked(df, bench(spark, [ITEM]))
    assert out.columns == df.columns and [r.doc_id for r in out.orderBy("doc_id").collect()] == [None, 2]
    assert decontaminate.drop_leaked(df, bench(spark, []).limit(0)).count() == 4
    assert decontaminate.leaks(df.limit(0), bench(spark, [ITEM])).count() == 0


def kinds(spark, texts, items, **options):
    return {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs(spark, texts), bench(spark, items), **options).collect()}


def test_each_copy_is_judged_by_itself(spark):
    year = "in 2019 the number of people who lived near the river rose to 4000 as the old mill was opened again and the water was let in from the hills"
    sums = "the sum of 3 and 4 and then the sum of 7 and 9"
    other = year.replace("2019", "1987").replace("4000", "512")
    stray = " while long ago in 1999 the number of birds was far lower"
    got = kinds(spark, [year + stray, sums, year + " and so " + other, other + stray, sums.replace("3", "5").replace("4", "5"), other.replace("the old mill", "the very old mill") + stray, "we saw " + sums.replace("7", "8")], [year, sums])
    assert got == {(0, 0): "verbatim", (1, 1): "verbatim", (2, 0): "verbatim", (3, 0): "reparameterised", (4, 1): "reparameterised", (5, 0): "reparameterised", (6, 1): "reparameterised"}


def test_names_at_any_place_and_case(spark):
    maria = "Maria bought 12 pencils. Maria gave 5 pencils to Tom. How many pencils does Maria have left?"
    german = "Der Hund und die Katze liefen am Morgen durch den Garten, bis der Regen kam und alle Tiere ins Haus mussten."
    got = kinds(spark, [maria.replace("Maria", "Laura"), 'She read: "' + maria.replace("Maria", "Laura").replace("Tom", "Ben"), ITEM.lower(), german.lower(), german.upper(), maria.replace("Maria gave", "Laura gave")], [maria, ITEM, german])
    assert got == {(0, 0): "reparameterised", (1, 0): "reparameterised", (2, 1): "verbatim", (3, 2): "verbatim", (4, 2): "verbatim"}


def test_short_items_within_documents(spark):
    items = ["What is the capital of France?", "Name four primes.", "Is 7 prime?", "42", "Paris"]
    texts = ["Here is a question: What is the capital of France?", "then we said: name four primes. and went home at last", "they asked is 7 prime? and nobody in the room knew it", "is 9 prime? they wondered for a very long time", "there were 43 of them in a row behind the house", "so it was 42 of them in a row behind the house", "name four small primes and go home again tonight"]
    got = kinds(spark, texts, items, short=True)
    assert got == {(0, 0): "verbatim", (1, 1): "verbatim", (2, 2): "verbatim", (3, 2): "reparameterised", (5, 3): "verbatim"}
    left = decontaminate.drop_leaked(docs(spark, texts), bench(spark, items))
    assert sorted(r.doc_id for r in left.collect()) == [4, 6]


@pytest.mark.parametrize("seed", range(4))
def test_leaks_against_brute_force_with_slots(spark, seed):
    """Documents with no, one or several instances of items, exact, re-parameterised or inconsistent."""
    rng = random.Random(seed)
    filler = lambda n: " ".join(rng.choice("lorem ipsum dolor amet sit elit sed do eiusmod tempor magna aliqua".split()) for _ in range(n))
    shapes = ["alpha beta {0} gamma delta epsilon {1} zeta eta theta {0} iota", "one two three {0} four five six seven {1} eight nine", "plain words only without any slot at all here"]
    fill = lambda s, v: s.format(*v)
    values = [("11", "22"), ("7", "95"), ("", "")]
    items = [fill(s, v) for s, v in zip(shapes, values, strict=True)]
    texts, want = [], {}
    for doc in range(40):
        parts = [filler(rng.randrange(3, 20))]
        for _ in range(rng.randrange(4)):
            i, how = rng.randrange(3), rng.choice(["exact", "other", "torn"])
            if how == "exact" or i == 2:
                parts.append(items[i])
                kind = 0
            elif how == "other":
                parts.append(fill(shapes[i], rng.sample([str(x) for x in range(100, 999)], 2)))
                kind = 1
            elif i == 0:  # the two places of one slot differ, so it is a shared template
                parts.append("alpha beta 301 gamma delta epsilon 302 zeta eta theta 303 iota")
                kind = None
            else:
                continue
            if kind is not None:
                want[doc, i] = min(kind, want.get((doc, i), 1))
            parts.append(filler(rng.randrange(3, 20)))
        texts.append(" ".join(parts))
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs(spark, texts), bench(spark, items), short=True).collect()}
    assert got == {k: ("verbatim", "reparameterised")[v] for k, v in want.items()}


def test_recall_of_reparameterised_items(spark):
    """Of word problems planted with other names, numbers and units at least nine in ten are found, and no clean text is."""
    rng = random.Random(12)
    names = "Maria Laura Peter Jonas Aisha Wei Olga Pablo Nina Tom".split()
    things = "pencils apples marbles books stickers coins".split()
    shapes = [
        "{a} bought {x} {t}. {a} gave {y} {t} to {b}. How many {t} does {a} have left?",
        "A train leaves the station at {x} km per hour while {b} waits {y} minutes for {a} on the platform.",
        "If {a} can paint the fence in {x} hours and {b} needs {y} hours, how long do they take together?",
        "{a} and {b} share {x} {t} so that {a} gets {y} more {t} than {b}. How many does each of them get?",
    ]
    fill = lambda s, t: s.format(a=rng.choice(names[:5]), b=rng.choice(names[5:]), x=rng.randrange(100, 1000), y=rng.randrange(10, 100), t=t)
    picked = [(s, rng.choice(things)) for s in shapes for _ in range(5)]
    items = [fill(s, t) for s, t in picked]
    prose = lambda n: " ".join(rng.choice("the river ran past old stones while birds sang over quiet fields of green barley".split()) for _ in range(n)) + "."
    planted = [f"{prose(30)} {fill(s, t)} {prose(30)}" for s, t in picked]
    clean = [prose(80) for _ in range(60)]
    got = decontaminate.leaks(docs(spark, planted + clean), bench(spark, items), short=True).collect()
    hit = {(r.doc_id, r.item_id) for r in got}
    assert sum((i, i) in hit for i in range(len(items))) >= 0.9 * len(items)
    assert all(d < len(items) for d, _ in hit)


def test_texts_of_one_doc_id_do_not_add_up(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    halves = ["one two three four five six seven eight", "five six seven eight nine ten eleven twelve"]
    assert decontaminate.leaks(docs(spark, halves, ids=[3, 3]), bench(spark, [item]), short=True).count() == 0
    assert decontaminate.leaks(docs(spark, [*halves, item], ids=[3, 3, 3]), bench(spark, [item]), short=True).count() == 1


# Sharding


@pytest.mark.parametrize("seed", [0, 1])
def test_shards_are_balanced_contiguous_and_gapless(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", ""] + ["hot copy " * 3] * 300 + ["".join(rng.choice("abcé") for _ in range(rng.randrange(400))) for _ in range(600)]
    df = docs(spark, texts)
    rows = sharding.assign(df, 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    total = 0
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert r.size == len(b) + 1 and r.text_crc32 == zlib.crc32(b)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        total += r.size
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 0.02 * total / 8 + 2 * max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    small = defaultdict(set)
    for r in rows:
        if (texts[r.doc_id] or "") == "":
            small["e"].add(r.shard)
    assert len(small["e"]) == 1
    assert sorted(map(tuple, sharding.assign(df, 8).collect())) == sorted(map(tuple, rows))


def test_shards_against_a_plain_version(spark):
    """Documents in the order of hash, crc, size and id, cut at equal targets; small groups stay with their first."""
    rng = random.Random(9)
    texts = [rng.choice(["hot text"] * 3 + [None, "", "é" * rng.randrange(40), "w " * rng.randrange(60)]) for _ in range(700)]
    df = docs(spark, texts)
    rows = {r.doc_id: r for r in sharding.assign(df, 8).collect()}
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    size = {i: len((t or "").encode()) + 1 for i, t in enumerate(texts)}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in enumerate(texts)}
    order = sorted(size, key=lambda i: (hashes[i], crc[i], size[i], i))
    total, before, shard = sum(size.values()), 0, {}
    for i in order:
        shard[i] = min(7, before * 8 // total)
        before += size[i]
    groups = defaultdict(list)
    for i in order:
        groups[hashes[i], crc[i]].append(i)
    for g in groups.values():
        if sum(size[i] for i in g) * 8 <= sharding.SNAP * total:
            shard.update(dict.fromkeys(g, shard[g[0]]))
    slot = Counter()
    for i in order:
        r = rows[i]
        assert (r.size, r.text_crc32, r.shard, r.slot) == (size[i], crc[i], shard[i], slot[shard[i]])
        slot[shard[i]] += 1


def test_shard_edges(spark, tmp_path):
    assert sharding.assign(docs(spark, []).limit(0), 8).count() == 0
    few = sharding.assign(docs(spark, ["a", "b"]), 8).collect()
    assert len({(r.shard, r.slot) for r in few}) == 2
    same = docs(spark, ["x", "x", "x", None], ids=[5, 5, None, None]).withColumn("shard", F.lit("q")).withColumn("size", F.lit(1))
    assert sharding.assign(same, 2).count() == 4
    plain = docs(spark, ["x", "x", "yy", None], ids=[5, 5, None, None])
    sharding.write_shards(plain, 2, f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 4 and sorted((r.slot, r.shard) for r in back.collect()) == sorted((r.slot, r.shard) for r in sharding.assign(plain, 2).collect())


# Mixing


def targets_py(sizes):
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    left, out, live = Fraction(3, 2) * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while live and left > 0:
        share = {i: left * w[i] / sum(w[j] for j in live) for i in live}
        over = [i for i in live if share[i] > 2 * sizes[i]]
        if not over:
            for i in live:
                out[i] = share[i]
            break
        for i in over:
            out[i] = Fraction(2 * sizes[i])
            left -= out[i]
            live.remove(i)
    return [float(x) for x in out]


def test_targets(spark):
    rng = random.Random(6)
    cases = [[], [0], [5], [0, 0, 7], [10, 10, 10], [1, 1000, 1], [1000, 1, 1, 1], *([rng.choice([0, rng.randrange(1000), 10**12]) for _ in range(rng.randrange(2, 30))] for _ in range(5))]
    for sizes in cases:
        names = [chr(97 + i) if i < 25 else None if i == len(sizes) - 1 else f"z{i}" for i in range(len(sizes))]
        per = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        rows, total = mixing.targets(per)
        found = {r["_source"]: r.target for r in rows.collect()}
        got = [found[x] for x in names]
        assert total == sum(sizes) and got == pytest.approx(targets_py(sizes)) and sum(got) == pytest.approx(1.5 * total) and all(t <= 2 * n + 1e-9 for t, n in zip(got, sizes))


def test_mix_makes_no_rows_in_python(spark, monkeypatch):
    _, _, df = mixed(spark)

    def refuse(*_, **__):
        raise AssertionError("rows from Python")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    assert mixing.mix(df).count() and mixing.mixed_documents(df).count()


def mixed(spark):
    rng = random.Random(5)
    texts = [" ".join("w" for _ in range(rng.randrange(30))) for _ in range(900)] + [None, ""]
    sources = [rng.choice(["a", "b", "B", "é", "hot", "hot", "hot", None]) for _ in texts]
    return texts, sources, docs(spark, texts, sources)


def test_mix_meets_targets_and_repeats(spark):
    texts, sources, df = mixed(spark)
    rows = mixing.mix(df).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        n = len(words_py(texts[r.doc_id]))
        assert r.size == n and r.taken in (0, n, 2 * n) and r.source == sources[r.doc_id]
        size[r.source] += n
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    assert order[-1] is None and order[:2] == ["B", "a"]
    assert [target[s] for s in order] == pytest.approx(targets_py([size[s] for s in order]))
    assert all(abs(taken[s] - target[s]) <= 60 for s in order) and all(r.source_size == size[r.source] for r in rows)
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_mix_against_one_sorted_queue(spark):
    texts, sources, df = mixed(spark)
    rows = {r.doc_id: r for r in mixing.mix(df).collect()}
    rank = {i: int(hashlib.md5(f"{i}:7".encode()).hexdigest()[:15], 16) for i in range(len(texts))}
    line = []
    for s in set(sources):
        own = sorted((i for i in range(len(texts)) if sources[i] == s), key=lambda i: (rank[i], i))
        total = sum(rows[i].size for i in own)
        for round_ in range(2 if rows[own[0]].target > total else 1):
            c = round_ * total
            for n, i in enumerate(own):
                c += rows[i].size
                line.append((c / rows[i].target if rows[i].target else 0.0, s is not None, s or "", round_, n, i))
    line.sort()
    budget, ahead, took = 3 * sum(r.size for r in rows.values()), 0, Counter()
    for *_, i in line:
        took[i] += 2 * ahead + rows[i].size <= budget
        ahead += rows[i].size
    assert {i: took[i] * r.size for i, r in rows.items()} == {i: r.taken for i, r in rows.items()}


def test_mixed_rows_are_the_mix(spark):
    _, _, df = mixed(spark)
    df = df.withColumn("taken", F.lit("clash")).withColumn("_r", F.lit(1))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = {r.doc_id: r.copies for r in mixing.mix(df).collect() if r.copies}
    assert Counter(r.doc_id for r in out.collect()) == want
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    twice = docs(spark, ["a b c", "a b c", "d e"], ["s", "s", None], [1, 1, None])
    assert mixing.mix(twice).count() == 3


# Number tables and other languages


def test_number_tables_are_quick_and_no_leak(spark):
    import time

    rng = random.Random(2)
    numbers = lambda n: " ".join(str(rng.randrange(100)) for _ in range(n))
    first, large = [numbers(100) for _ in range(2)], [numbers(5000) for _ in range(4)]
    items = [numbers(60) for _ in range(20)] + ["3 1 4 8 5 9 2 6"]
    scores = "Box scores of the week: 12 77 45 98 31 60 22 were all recorded."
    begin = time.time()
    assert decontaminate.leaks(docs(spark, [*first, *large, scores, "so " + items[0]]), bench(spark, items), short=True).select("doc_id", "item_id", "kind").collect() == [(7, 0, "verbatim")]
    assert time.time() - begin < 60


def test_repeated_templates_need_their_places(spark):
    item = "add 3 plus 4 plus 5 plus 6 plus 7 plus 8 plus 9 to it"
    assert kinds(spark, ["we add 1 plus 2 plus 0 plus 9 plus 4", "they said " + item, "plus 1 plus 2 " * 2000], [item]) == {(1, 0): "verbatim"}


def test_nouns_in_capitals_are_no_parameters(spark):
    german = "Der Hund jagt die Katze durch den Garten und der Vater ruft."
    other = "Der Lehrer jagt die Maus durch den Wald und der Bruder ruft."
    train = "Ein Zug fährt mit 80 km/h ab, während Anna noch 15 Minuten am Bahnsteig steht und auf ihn wartet, bis er kommt."
    french = "Marie achète 12 pommes au marché et en donne 5 à Paul, combien de pommes lui reste-t-il donc à la fin ?"
    spanish = "Si Pedro tiene 14 libros y regala 6 libros a su hermana Elena, cuántos libros le quedan entonces en casa?"
    texts = [other, "Und dann: " + german, train.replace("80", "95").replace("Anna", "Paula").replace("15", "40"), french.replace("Marie", "Claire").replace("12", "31").replace("5 à Paul", "8 à Jean"), spanish.replace("Pedro", "Luis").replace("Elena", "Sara").replace("14", "90"), french.replace("pommes", "poires").replace("marché", "village").replace("donne", "vend")]
    assert kinds(spark, texts, [german, train, french, spanish]) == {(1, 0): "verbatim", (2, 1): "reparameterised", (3, 2): "reparameterised", (4, 3): "reparameterised"}
