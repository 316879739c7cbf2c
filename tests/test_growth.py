"""Shared steps whose work must not grow faster than the tables."""

import pytest

from quarry.operators import evaluation, options, search
from quarry.storage import distinct_by, materialize

CHUNK = "content_hash string, model_id string, chunk_ix int, chunk_text string, embedding array<float>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"h{i % 17:02d}{i}", "none", i % 3, f"The horse no. {i % 5} by ciónñas trough, the the W{i} {'apple pie ' * (i % 4)}", None) for i in range(60)]
    return materialize(spark.createDataFrame(rows, CHUNK), "test-chunks")


def test_one_row_of_a_key_without_shuffling_the_rest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), (None, 1, "z"), (None, 1, "z"), ("b", None, "w")], "k string, i int, text string")
    assert sorted(map(tuple, distinct_by(rows, ["k", "i"]).collect()), key=repr) == sorted([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z"), ("b", None, "w")], key=repr)
    assert "Exchange" not in plan(distinct_by(rows.where("i = 2"), ["k", "i"]))


def test_postings_shuffle_no_token(chunks):
    out = search.postings(chunks)
    assert "Exchange" not in plan(out)
    held = {(r.term, r.content_hash, r.chunk_ix): (r.positions, r.tf, r.dl) for r in out.collect()}
    words = {(c.content_hash, c.chunk_ix): search.plain_words_py(c.chunk_text) for c in chunks.collect()}
    want = {(t, *k): ([i for i, x in enumerate(w) if x == t], w.count(t), len(w)) for k, w in words.items() for t in w}
    assert held == want
    assert {k: v for k, v in want.items() if k[0] in ("the", "pie")} == {(r.term, r.content_hash, r.chunk_ix): (r.positions, r.tf, r.dl) for r in search.postings(chunks, only=["the", "pie", "zebra"]).collect()}
    terms = search.chunk_terms(chunks)
    assert "Exchange" not in plan(terms) and sorted(map(tuple, terms.collect())) == sorted(want)
    few = options.without_common(terms, 60, 0.1)
    assert {r.term for r in few.collect()} == {t for t, *_ in want if sum(k[0] == t for k in want) <= 6}


ASKED = {"a": "the W7 horse", "b": "ciónñas apple-pie pie", "c": "zebra", "d": "the the-the no.3", "e": ""}


def test_scores_of_many_queries_are_those_of_the_leg(spark, chunks):
    full = {(r.qid, r.content_hash, r.chunk_ix): r.leg_rank for r in evaluation.full_ranking(search.postings(chunks), search.doc_lengths(chunks), ASKED).collect()}
    scored = evaluation.scored(chunks, ASKED)
    assert "hashpartitioning" not in plan(scored) and "rangepartitioning" not in plan(scored)
    assert {(r.qid, r.content_hash, r.chunk_ix) for r in scored.collect()} == set(full)
    best = {(r.qid, r.content_hash, r.chunk_ix): r.leg_rank for r in evaluation.best(scored, 7).collect()}
    assert best == {k: v for k, v in full.items() if v <= 7}
    count = {q: sum(k[0] == q for k in full) for q in "abd"}
    assert {r.qid: r.matches for r in evaluation.matches(scored).collect()} == count
    gold = [k for k in full if k[0] in "ad" and full[k] % 9 == 5]
    out = {r.id: (r.bm25_rank, r.bm25_matches) for r in evaluation.placed(scored, spark.createDataFrame(gold, "id string, content_hash string, chunk_ix int")).collect()}
    assert out == {q: (min((full[k] for k in gold if k[0] == q), default=None), count[q]) for q in "abd"}
    assert evaluation.scored(chunks, {}).count() == 0


def test_words_are_led_to_by_the_rarest_run(spark):
    grams = search.word_grams(spark.createDataFrame([("abcdefx",), ("abcq",), ("zabcdef",), ("defabc",)], "word string"))
    terms = ["abcdef", "abc", "abcdezz", "xyz"]
    out = search.words_holding(grams, terms)
    assert "count(distinct" not in plan(out).lower() and {(r.term, r.word) for r in out.collect()} == {("abcdef", "abcdefx"), ("abcdef", "zabcdef"), *(("abc", w) for w in ("abcdefx", "abcq", "zabcdef", "defabc"))}
