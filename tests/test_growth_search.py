"""The legs of a scan read the chunks' texts once."""

from quarry.operators import search
from quarry.storage import materialize

CHUNK = "content_hash string, model_id string, chunk_ix int, chunk_text string, embedding array<float>"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_what_a_leg_is_made_of_is_written_once(spark):
    rows = [(f"h{i:02d}", m, 0, f"The horse No_{i % 5} by W{i} {'apple pie ' * (i % 4)}", None) for i in range(40) for m in ("none", "mini")[: 1 + (i == 7)]]
    chunks = materialize(spark.createDataFrame(rows, CHUNK), "test-chunks")
    asked = {"a": "No_3 horse W7", "b": "apple zebra", "c": ""}
    literal = search.literal_leg(chunks, asked, 50)
    assert "chunk_text" not in plan(literal)
    low = {(h, m): t.lower() for h, m, _, t, _ in rows}
    df = {t: sum(t in x for x in low.values()) for q in asked.values() for t in search.literal_terms(q)}
    want = []
    for q, text in asked.items():
        score = {h: sum(1 / df[t] for t in search.literal_terms(text) if t in x and df[t] < len(rows)) for (h, _), x in low.items()}
        best = sorted((h for h in score if score[h] > 0), key=lambda h: (-score[h], h))
        want += [(q, h, n + 1) for n, h in enumerate(best)]
    assert sorted((r.qid, r.content_hash, r.leg_rank) for r in literal.collect()) == sorted(want)
    terms = ["horse", "w7", "apple"]
    keyword = search.keyword_leg(search.postings(chunks, only=terms), search.doc_lengths(chunks), {"a": "horse w7", "b": "apple"})
    assert "MapInArrow" not in plan(keyword)
    assert {r.content_hash for r in keyword.where("qid = 'b'").collect()} == {h for (h, _), x in low.items() if "apple" in x}
