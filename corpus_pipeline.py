"""The corpus pipeline: five stages from ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.  A stage's result is to be written before
the next stage begins: that one deletes the intermediate tables of its
predecessor.
"""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, mixing, quality, simhash, tokens
from quarry.llm.queries import vocabulary
from quarry.storage import delete, materialize, new_path, recording

#: Tables of the last stage, in this thread of control.
_left: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def _stage(f):
    """``f`` with the tables it writes recorded, and those of the stage before it deleted."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if f is not _first:
            delete(spark, list(_left.get()))
        with recording() as paths:
            out = f(spark, docs, sf_dir)
        _left.set(tuple(paths))
        return out

    return run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    table = tokens.write(docs, vocabulary("word_bpe_49k.json"), new_path(spark, "pipeline-tokens"))
    return table.select("doc_id", "n_tokens", "ids")


_first = quality_rules

STAGES = [
    ("quality_rules", _stage(quality_rules)),
    ("near_duplicates", _stage(near_duplicates)),
    ("decontamination", _stage(decontamination)),
    ("source_mix", _stage(source_mix)),
    ("token_ids", _stage(token_ids)),
]

#: SQL has neither the fit of the rules, nor the components, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
