"""Embedding plug-in: an ONNX sentence model where one is at hand, nothing where not."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column

from quarry.functions.words import WordPiece

_sessions: dict[str, tuple] = {}


def mean_pooled(hidden: np.ndarray) -> np.ndarray:
    """Mean over tokens at length one; the zero vector stays."""
    v = hidden.mean(axis=0, dtype=np.float32)
    n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / np.float32(n if n > 0 else 1.0)


def _session(folder: str):
    if folder not in _sessions:
        import onnxruntime

        s = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"))
        with open(os.path.join(folder, "vocab.txt"), encoding="utf-8") as f:
            vocab = [line.rstrip("\r\n") for line in f]
        _sessions[folder] = (s, WordPiece(vocab), {i.name for i in s.get_inputs()})
    return _sessions[folder]


#: Texts of one call of the model.
BATCH = 32


def embed_batch(folder: str, texts: list[str]) -> list[list[float]]:
    """The vectors of a few texts in one call; shorter ones are padded and masked."""
    session, pieces, names = _session(folder)
    rows = [pieces.encode(t) for t in texts]
    ids = np.zeros((len(rows), max(map(len, rows))), dtype=np.int64)
    mask = np.zeros_like(ids)
    for i, r in enumerate(rows):
        ids[i, : len(r)], mask[i, : len(r)] = r, 1
    feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
    hidden = session.run(None, {k: v for k, v in feed.items() if k in names})[0]
    return [mean_pooled(h[: len(r)]).tolist() for h, r in zip(hidden, rows, strict=True)]


def embedder(folder: str | None) -> Callable[[Column], Column] | None:
    """A column function, or None if the folder has no model: chunks then stay without vectors."""
    if not folder or not all(os.path.exists(os.path.join(folder, f)) for f in ("model.onnx", "vocab.txt")):
        return None
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        # Texts of like length stand together, so that little is padded.
        todo = sorted((i for i, t in enumerate(texts) if isinstance(t, str) and t), key=lambda i: len(texts.iloc[i]))
        for i in range(0, len(todo), BATCH):
            some = todo[i : i + BATCH]
            for j, v in zip(some, embed_batch(folder, [texts.iloc[j] for j in some]), strict=True):
                out[j] = v
        return pd.Series(out, dtype=object)

    return run


def test_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """Hashed word counts at length one, for tests of the plumbing; they mean nothing."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        import zlib

        def one(t):
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                v[zlib.crc32(w.encode()) % dim] += 1
            n = np.linalg.norm(v)
            return (v / (n or 1)).astype(np.float32).tolist()

        return texts.map(one)

    return run
