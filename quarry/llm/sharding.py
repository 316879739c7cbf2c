"""Balanced contiguous shards from global prefix sums of byte sizes.

Documents are ordered by the hash of their text, then by id, so equal texts
stand together.  Range partitions of that order give their byte totals, the
totals' prefix sums give every document its global offset, and the offset cuts
the order at equal targets.  A group of equal texts that a cut would split
goes to the shard of its first document if it is smaller than ``SNAP`` of a
shard's target; a larger one is split, as balance asks.

Defined cases: a null text has size 1 and crc32 0, like the empty text; a null
doc_id comes first among equal texts; repeated rows are documents of their
own; an empty table gives an empty result; with more shards than documents
some shards stay empty; extra columns are ignored by :func:`assign` and kept
by :func:`write_shards`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.columns import column, key, numbered
from quarry.storage import materialize, ranged, running_total

LAW = "bytes"
SNAP = 0.005


def assign(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of each document."""
    body = F.coalesce(column(docs, text), F.lit(""))
    lean = docs.select(
        column(docs, doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("_h"),
    )
    order = ["_h", "text_crc32", "size", "doc_id"]
    table = ranged(materialize(lean, "shard-sizes"), order, "shard-order")
    placed = materialize(running_total(table, {"_before": F.col("size"), "_index": F.lit(1).cast("long")}, order), "shard-offsets")
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("decimal(38,0)")).first()[0]
    cut = F.least(F.lit(shards - 1), F.floor(F.col("_before").cast("decimal(38,0)") * shards / F.lit(max(total, 1))).cast("int"))
    cuts = placed.withColumn("shard", cut)
    # Groups that a cut splits: at most one for each cut.
    split = cuts.groupBy("_h", "text_crc32").agg(F.min("shard").alias("_first"), F.max("shard").alias("_last"), F.sum("size").alias("_bytes")).where((F.col("_first") < F.col("_last")) & (F.col("_bytes") * shards <= SNAP * float(total))).select(F.col("_h").alias("_gh"), F.col("text_crc32").alias("_gc"), "_first")
    snapped = cuts.join(F.broadcast(split), (F.col("_h") == F.col("_gh")) & (F.col("text_crc32") == F.col("_gc")), "left").withColumn("shard", F.coalesce("_first", "shard"))
    # One row for each shard.
    start = snapped.groupBy(F.col("shard").alias("_s")).agg(F.min("_index").alias("_start"))
    out = snapped.join(F.broadcast(start), F.col("shard") == F.col("_s"))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("_start")).alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the documents under ``path/shard=N`` in slot order and return their assignment.

    Rows that repeat a doc_id and a text get the slots of that pair in any order.
    """
    placed = assign(docs, shards, doc_id, text)
    rows, doc_id, text = numbered(docs), key(docs, doc_id), key(docs, text)
    nth = lambda d, c: F.row_number().over(Window.partitionBy(d, c).orderBy(F.lit(0)))
    left = rows.withColumn("_crc", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    left = left.withColumn("_k", nth(F.col(doc_id), F.col("_crc")))
    right = placed.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_c"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).withColumn("_n", nth(F.col("_id"), F.col("_c")))
    joined = left.join(right, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_crc") == F.col("_c")) & (F.col("_k") == F.col("_n")))
    out = joined.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").select("_shard", *rows.columns, "_slot")
    out.toDF("shard", *docs.columns, "slot").write.partitionBy("shard").parquet(path)
    return placed
