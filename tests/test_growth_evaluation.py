"""An evaluation writes its chunks once and, beside them, less than these."""

import os
import random

import duckdb
import pytest

from quarry.operators import evaluation, search
from quarry.plans import queries
from quarry.storage import distinct_by, materialize, recording

CHUNK = "content_hash string, model_id string, chunk_ix int, chunk_text string, embedding array<float>"
SMALL = "/root/testdata/sf0.001"


def tables(paths):
    return {os.path.basename(p).rsplit("-", 1)[0] for p in paths}


def test_scores_are_made_again_and_not_written(spark):
    rows = [(f"h{i}", "none", 0, f"the no.{i % 4} horse{' the' * (i % 3)} no 4", None) for i in range(30)]
    chunks = materialize(spark.createDataFrame(rows, CHUNK), "test-chunks")
    with recording() as paths:
        scored = evaluation.scored(chunks, {"a": "the horse", "b": "no.3 no-4"})
        gold = spark.createDataFrame([("a", "h7", 0)], "id string, content_hash string, chunk_ix int")
        placed = evaluation.placed(scored, gold).where("id = 'a'").first()
        best = {(r.qid, r.content_hash): r.leg_rank for r in evaluation.best(scored, 30).collect()}
    assert tables(paths) == {"repeated-keys", "phrase-counts", "gold", "first-gold", "score-floors"}
    assert placed[1:] == (best["a", "h7"], 30)
    # A phrase of several words stands in a row: no 4 in all, no 3 in every fourth.
    assert [n for q, _ in best if q == "b" for n in [1]] == [1] * 30 and {h for (q, h), n in best.items() if q == "b" and n <= 7} == {f"h{i}" for i in range(3, 30, 4)}


def test_terms_of_many_queries_are_found_where_chunks_lie(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcABé7-") for _ in range(r.randrange(2, 9)))
    asked = {f"q{i}": " ".join(word() for _ in range(6)) for i in range(40)} | {"none": "", "short": "aé", "long": "x" * 70}
    texts = ["", "x" * 80, "aé", None] + [" ".join(r.choice(("", "(", "\n")) + r.choice((word(), *asked["q3"].split())) for _ in range(r.randrange(40))) for _ in range(200)] + ["a " * 200_000 + asked["q5"] + "x" * 70]
    rows = [(f"h{i:03d}", m, 0, t, None) for i, t in enumerate(texts) for m in ("none", "mini")[: 1 + (i % 9 == 7)]]
    chunks = materialize(spark.createDataFrame(rows, CHUNK), "test-chunks")
    with recording() as paths:
        out = search.literal_leg(chunks, asked, 50)
        got = sorted((x.qid, x.content_hash, x.leg_rank) for x in out.collect())
    assert tables(paths) == {"literal-held", "repeated-keys"}
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    low = {(h, m): fold(t) for h, m, _, t, _ in rows}
    terms = {q: search.literal_terms(t) for q, t in asked.items()}
    df = {t: sum(t in x for x in low.values()) for ts in terms.values() for t in ts}
    assert len(df) > search.TERMS_AT_ONCE
    want = []
    for q, ts in terms.items():
        score = {h: round(sum(1 / df[t] for t in ts if t in x and df[t] < len(rows)), 9) for (h, _), x in low.items()}
        want += [(q, h, n + 1) for n, h in enumerate(sorted((h for h in score if score[h] > 0), key=lambda h: (-score[h], h))[:50])]
    assert got == sorted(want)


def test_rows_whose_keys_have_one_hash_stay_apart(spark):
    rows = spark.createDataFrame([(None, 1), (1, None), (None, 1), (2, 2)], "a int, b int")
    assert sorted(map(tuple, distinct_by(rows, ["a", "b"]).collect()), key=repr) == [(1, None), (2, 2), (None, 1)]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_texts_that_many_tasks_read_are_not_dealt_out(spark, tmp_path, monkeypatch):
    plans, write = [], queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, *a, **b: plans.append(df._jdf.queryExecution().toString()) or write(df, *a, **b))
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    many, few = (queries.indexed(spark, d) for d in (str(tmp_path), SMALL))
    assert ["REPARTITION" in p for p in plans] == [False, True]
    key = ["content_hash", "chunk_ix", "chunk_text"]
    want = duckdb.sql(f"WITH documents AS (FROM '{SMALL}/documents.parquet'), {queries.CHUNK} SELECT {', '.join(key)} FROM chunk").fetchall()
    assert sorted(map(tuple, many.select(*key).collect())) == sorted(map(tuple, few.select(*key).collect())) == sorted(want)
