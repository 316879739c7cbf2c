"""Capture files are parsed in batches."""

import pandas as pd

from quarry.operators import notes


def test_files_of_a_batch_come_as_one_frame(spark, monkeypatch):
    made = []
    real = pd.DataFrame
    monkeypatch.setattr(notes.pd, "DataFrame", lambda *a, **k: made.append(1) or real(*a, **k))
    seen = {}

    class Files:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            b = real({"path": [f"p{i}" for i in range(50)], "text": [f"@note n{i}\n@state open\nx\n\n@note m{i}\ny\n" for i in range(50)]})
            seen["rows"] = pd.concat(list(run([b])))
            return self

    notes.project(Files())
    assert len(made) == 1 and len(seen["rows"]) == 100 and list(seen["rows"]["seq"][:4]) == [0, 1, 0, 1]
