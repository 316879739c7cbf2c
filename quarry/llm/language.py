"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of every labelled text, summed by
(language, bucket); the matrix of log probabilities, languages x ``BUCKETS``
doubles, is broadcast, and batches are scored sparsely in numpy: hash, gather,
add up by document.  Texts are folded to lower case and letters only count;
a run of anything else is one boundary.

Defined cases: a null text and a text without a letter get ``und`` and score
0; with no labelled text at all every text gets ``und``; ties go to the first
language by code point; repeated rows count and are scored each on their own;
rows with a null label are not learned from; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import column
from quarry.session import ship
from quarry.storage import materialize, small_batches

BUCKETS = 1 << 15
ORDERS = 3
#: Above this many languages the broadcast matrix (256 KB each) is refused, before anything of it is collected.
MAX_LANGUAGES = 1000
#: Characters hashed at once; bounds a worker's arrays to about 20 MB.
CHUNK = 1 << 17

UNKNOWN = "und"


def _folded(point: int) -> int:
    """The code point in lower case, the first if there are several; 0 for what is no letter."""
    c = chr(point)
    return ord(c.lower()[0]) if c.isalpha() else 0


_fold = np.array([0 if 0xD800 <= i < 0xE000 else _folded(i) for i in range(0x110000)], dtype=np.uint32)


def _points(text: str) -> np.ndarray:
    """Code points of ``text`` in lower case, each run of non-letters as one 0."""
    c = _fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
    return c[(c != 0) | np.concatenate(([True], c[:-1] != 0))]


def grams(points: np.ndarray, lead: int = 0) -> np.ndarray:
    """Buckets of the 1- to 3-grams of ``points`` that hold a letter and end after the first ``lead`` points."""
    h, out = np.zeros(len(points), np.int64), []
    for n in range(1, ORDERS + 1):
        h = h[: max(0, len(points) - n + 1)] * 0x01000193 + points[n - 1 :] + n
        mixed = (h ^ (h >> 15)) * 0x2545F491 & 0x7FFFFFFF
        bucket = (mixed >> 11) % BUCKETS
        inside = np.zeros(len(bucket), bool)
        for k in range(n):
            inside |= points[k : k + len(bucket)] != 0
        first = max(0, lead - n + 1)
        out.append(bucket[first:][inside[first:]])
    return np.concatenate(out)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The whole text's grams, ``CHUNK`` characters at a time; a boundary stands at both ends of the text."""
    kept = np.zeros(1, np.int64)
    for a in range(0, len(text) + 1, CHUNK):
        p = _points(text[a : a + CHUNK])
        if a + CHUNK > len(text):
            p = np.append(p, 0)
        p = p[(p != 0) | np.concatenate((kept[-1:] != 0, p[:-1] != 0))]
        yield grams(np.concatenate((kept, p)), len(kept) if a else 0)
        kept = np.concatenate((kept, p))[1 - ORDERS :]


def count(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows with a label, summed within partitions and then by key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang_ in zip(batch["text"], batch["lang"], strict=True):
                total = held.setdefault(lang_, np.zeros(BUCKETS, np.int64))
                for g in _pieces(t):
                    # Texts have far fewer grams than there are buckets.
                    if len(g) < BUCKETS // 8:
                        np.add.at(total, g, 1)
                    else:
                        total += np.bincount(g, minlength=BUCKETS)
        for lang_, total in held.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang_, "bucket": at.astype(np.int32), "n": total[at]})

    ship(labelled.sparkSession)
    return _learnable(labelled, text, lang).mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _learnable(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    return labelled.select(column(labelled, text).alias("text"), column(labelled, lang).alias("lang")).where("text is not null and lang is not null")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by code point, log priors and the log-probability matrix (buckets x languages).

    The driver gets at most languages x ``BUCKETS`` counts.
    """
    with small_batches(labelled.sparkSession):
        counted = materialize(count(labelled, text, lang), "language-counts")
    n = counted.agg(F.count_distinct("lang")).first()[0]
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; the matrix is bounded to {MAX_LANGUAGES}")
    counts = counted.toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(langs)))
    table[counts["bucket"].to_numpy(), np.searchsorted(langs, counts["lang"].to_numpy(dtype=object).astype(str)) if langs else []] = counts["n"]
    sums = table.sum(axis=0)
    # Every language is as likely before its text is read: sizes of sources say nothing about a text.
    prior = np.zeros(len(langs))
    return langs, prior, np.log(table + alpha) - np.log(sums + alpha * BUCKETS)


def predict(text: Column, model: tuple[list[str], np.ndarray, np.ndarray], spark) -> Column:
    """struct(lang_pred, score): the most probable language and its posterior probability."""
    from pyspark.sql.functions import pandas_udf

    ship(spark)
    langs, prior, matrix = model
    shared = spark.sparkContext.broadcast((langs, prior, np.ascontiguousarray(matrix)))

    def one(t, langs, prior, matrix) -> tuple[str, float]:
        if t is None or not langs:
            return UNKNOWN, 0.0
        score, seen = prior.copy(), 0
        for g in _pieces(t):
            seen += len(g)
            score += matrix[g].sum(axis=0)
        if not seen:
            return UNKNOWN, 0.0
        best = int(score.argmax())
        return langs[best], float(1 / np.exp(score - score[best]).sum())

    @pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, *shared.value) for t in texts], columns=["lang_pred", "score"])

    return run(text)
