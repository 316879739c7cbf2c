"""An index run's tables must not outgrow its texts."""

import glob

import pyarrow.parquet as pq

from quarry.operators import ingest
from quarry.plans.index import index
from quarry.plans.store import Store


def test_keyword_tables_are_segments_that_no_row_is_shuffled_for(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", stemmed=False)
    texts = {f"./{i}": f"the Words no{i} the shared a{i % 7}b" for i in range(60)}
    scanned = spark.createDataFrame([(p, t, 1) for p, t in texts.items()], "path string, text string, mtime long").repartition(4)
    index(s, scanned, {"file"})
    at = s.pointer()["tables"]
    for table, order in (("posting", "term"), ("word", "word")):
        files = [pq.ParquetFile(f).read().to_pylist() for f in glob.glob(f"{tmp_path}/store/{at[table][0]}/*.parquet")]
        files = [f for f in files if f]
        held = [{r["content_hash"] for r in f} for f in files]
        # A content stands in one segment, and so once in one dictionary.
        assert len(files) > 1 and sum(map(len, held)) == len(set().union(*held)) == 60
        assert all([r[order] for r in f] == sorted(r[order] for r in f) for f in files)
    assert sorted((r.term, r.tf, r.dl, r.positions) for r in s.read("posting").where("term in ('the', 'no7')").collect()) == [("no7", 1, 6, [2])] + [("the", 2, 6, [0, 3])] * 60
    assert s.read("stat").first()[:] == (60, 360)
    words = {w for t in texts.values() for w in t.lower().split()}
    assert {r.word for r in s.read("word").collect()} == words == {r.word for r in s.read("gram").collect()}
    assert not [f for f in glob.glob(f"{tmp_path}/**/index-posting*", recursive=True)]


def test_a_join_with_a_table_without_rows_is_none(spark):
    texts = spark.createDataFrame([("h", "one"), ("g", "two")], "content_hash string, text string")
    known = ingest.empty(spark, "content_hash string, model_id string")
    out = ingest.new_chunks(texts, known, deal=False)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 2
