"""Source divergence, conversation tries and licence scans against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence, licenses, prefix_trie

DOCS = "doc_id long, text string, lang string, source string"


# Source divergence


def audit_py(rows, min_docs, ranks=50):
    terms = lambda t: [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs, own, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in rows:
        lang, source, w = lang or "", source or "", terms(t)
        docs[lang].update(set(w))
        own[lang, source].update(w)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        whole = Counter()
        for s in sources:
            whole.update(own[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}  # noqa: B023

        p, q = {s: shares(own[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode(), t) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
                out += [(lang, s, part, item, -v, n + 1) for n, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 512])
def test_divergence_is_exact_in_any_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    monkeypatch.setattr(divergence, "PIECE", 16)
    rng = random.Random(block)
    vocab = ["".join(rng.choice("abCÉß日") for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["longer" * 9]
    rows = []
    for i in range(260):
        s = rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])
        text = rng.choice([None, ""]) if rng.random() < 0.05 else rng.choice([" ", "-", "1"]).join(rng.choice(vocab[: 10 + 7 * len(s or "")]) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), s))
    rows += [(900, "only one", "xx", "a"), (901, None, "xx", "b"), (902, "", "yy", "a"), *rows[:9]]
    df = spark.createDataFrame(rows, DOCS).repartition(5).select("*", F.lit(1).alias("Text"), F.lit("x").alias("term"), F.lit(0).alias("s.t"))
    got = sorted(map(tuple, divergence.audit(df, min_docs=8).collect()))
    assert got == audit_py(rows, 8) and {r[2] for r in got} == {"pair", "term"}


def test_divergence_without_terms_or_rows(spark):
    df = spark.createDataFrame([(1, None, "en", "a"), (2, "x y", "en", "b"), (3, "x", None, None)], DOCS)
    assert sorted(map(tuple, divergence.audit(df).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(df.limit(0)).count() == 0


def test_pieces_cut_no_term(monkeypatch):
    rng = random.Random(1)
    for n in (1, 2, 3, 7):
        monkeypatch.setattr(divergence, "PIECE", n)
        for _ in range(200):
            t = "".join(rng.choice("aÉ日 -B1") for _ in range(rng.randrange(30)))
            got = [w.decode() for p in divergence.pieces(t.encode()) for w in p]
            assert got == [w.replace("B", "b") for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]


# Conversation tries


def trie_py(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for s, m in nodes.items():
        if s:
            kids[s[:-1]] += 1
    for s, m in nodes.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(s), min(nodes[s[:-1]]) if s else -1, len(m), kids[s], leaves[s], saved[s], sha(c for c in m if len(seqs[c]) == len(s))) for s, m in nodes.items())


def trie_rows(df):
    conv = F.col("conv")
    out = prefix_trie.trie(df, F.crc32(conv.cast("string")) % 9, conv - conv % 5, 8)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect())


@pytest.mark.parametrize("block", [3, 4096])
def test_trie_against_all_prefixes(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for c in [*range(3, 60), 10**12]:
        hot = c % 3 == 0
        for t in range(rng.randrange(1, 12)):
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, None if rng.random() < 0.05 else ("user", "bot")[t % 2], "hi" if hot else rng.choice(["a", "é", "", None, "long " * 9])))
    rows += [(70, t, "user", "same") for t in range(90)] + [(75, t, "user", "same") for t in range(60)]  # deep, and one a prefix of the other
    rows += rows[:20] + [(None, 1, "user", "nobody's"), (71, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6).select("*", F.lit(1).alias("node"), F.lit("x").alias("Turn"))
    assert trie_rows(df) == trie_py(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie_rows(df) == [] and trie_rows(df.limit(0)) == []


# Licence scans


def places_py(text):
    words = licenses.words_py(text or "")
    return len(words), sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def test_base_places_are_exact(spark):
    rng = random.Random(7)
    texts = [None, "", " .,", "MIT License", "mit\n-license", "mitlicense mit licenses", "the Apache License, and the MIT license.", "Kit license", "MİT license", "General Public General Public License", "émit license", "x " * 30_000 + "GNU General\tPublic License"]
    texts += [rng.choice([" ", ", ", "_", "\x0b"]).join(rng.choice(["mit", "MIT", "license", "License", "apache", "general", "public", "gnu", "é", "1"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", F.lit(1).alias("words"), F.lit(2).alias("DOC_ID"))
    for r in licenses.scan(df).collect():
        n, want = places_py(texts[r.doc_id])
        assert (r.n_words, sorted((x.at, x.label) for x in r.base)) == (n, want), texts[r.doc_id]
        assert 0 <= r.score <= 1 and (r.score >= 0.5 or not want)


def test_templates_are_found_in_other_texts_and_not_elsewhere(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("the software is free for any use and a copy of this license may be modified or distributed with no warranty under the law by public".split()) for _ in range(n))
    texts, want = [], []
    for t in licenses.TEMPLATES:
        words = t.text.split()
        at = len(words) // 2
        edited = " ".join([*words[:at], "(see", "below)", *words[at:]])
        edited = edited if all(p in " ".join(licenses.words_py(edited)) for p in t.phrases) else t.text
        texts.append(f"{prose(40)}\n# {edited.upper() if rng.random() < 0.3 else edited}\n{prose(40)}")
        want.append(t.label)
    texts += [prose(300) for _ in range(30)] + [" ".join(sorted(t.text.split())) for t in licenses.TEMPLATES if len(t.text.split()) > 12]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, label in enumerate(want):
        assert label in {x.label for x in got[i].found}, (label, texts[i])
    assert not any(got[i].found for i in range(len(want), len(texts)))


def test_rows_of_one_id_and_many_copies(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    rows = [(1, notice), (1, "nothing"), (1, notice), (None, " ".join([notice] * 400))]
    got = sorted(((r.doc_id or 0), len(r.base), [x.label for x in r.found]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 400, ["apache-2.0"]), (1, 0, []), (1, 1, ["apache-2.0"]), (1, 1, ["apache-2.0"])]
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0
