"""Exact nearest vectors of a batch of queries: blocks of rows meet blocks of queries as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.session import ship
from quarry.storage import materialize

#: Queries that one scan answers, and bytes that they may take up in each worker.
QUERIES, QUERY_BYTES = 10_000, 32 << 20
#: Products that a worker holds at a time.
PRODUCTS = 1 << 20


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Dot products in double precision, added from left to right, as :func:`quarry.functions.vector.dot` adds them.

    A library's matrix product adds in an order of its own, which hangs on the
    shape, so that equal vectors could get different cosines.
    """
    total, part = np.zeros((len(rows), len(queries))), np.empty((len(rows), len(queries)))
    for d in range(rows.shape[1]):
        np.multiply(rows[:, d, None], queries[None, :, d], out=part)
        total += part
    return total


def _top(qids: list, vectors: np.ndarray, most: int, n_keys: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``most`` best rows of a task for each query; rows come in the order of their keys, so of equal ones the first stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(qids), most), -np.inf)  # descending, ties in the order of their rows
        at = np.full((len(qids), most), -1, np.int64)
        held: list[tuple] = []  # keys of rows that are in ``best`` or were
        step = max(1, PRODUCTS // len(qids))
        for batch in batches:
            column = batch.column(n_keys)
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
            for first in range(0, len(values), step):
                scores = products(values[first : first + step], vectors)
                # Only what beats the worst one kept may come in.
                hit = scores > best[:, -1]
                places = np.flatnonzero(hit.any(axis=1))
                keys = batch.slice(first, step).select(list(range(n_keys))).take(pa.array(places)).to_pylist() if len(places) else []
                base = len(held)
                held += [tuple(k.values()) for k in keys]
                number = np.full(len(scores), -1, np.int64)
                number[places] = base + np.arange(len(places))
                for q in np.flatnonzero(hit.any(axis=0)):
                    i = np.flatnonzero(hit[:, q])
                    s, n = np.r_[best[q], scores[i, q]], np.r_[at[q], number[i]]
                    order = np.argsort(-s, kind="stable")[:most]
                    best[q], at[q] = s[order], n[order]
                if len(held) > 4 * best.size + 1000:
                    used, back = np.unique(at, return_inverse=True)
                    lost = int(used[0] == -1)
                    held = [held[j] for j in used[lost:]]
                    at = back.reshape(at.shape) - lost
        q, r = np.nonzero(at >= 0)
        for first in range(0, len(q), PRODUCTS):
            a, b = q[first : first + PRODUCTS], r[first : first + PRODUCTS]
            keys = [held[j] for j in at[a, b]]
            columns = [[qids[j] for j in a], *([k[c] for k in keys] for c in range(n_keys)), best[a, b]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return run


def nearest(rows: DataFrame, queries: DataFrame, key: list[str], vector: str, most: int) -> DataFrame:
    """(qid, *key, cos, rank): the ``most`` rows with the highest products with each of ``queries`` (qid, vec), ties by ``key``.

    Exact: every row meets every query of its length. A task keeps ``most`` rows
    for each query, so no more than that is dealt, and the queries come in
    blocks of bounded size with a scan for each. Null vectors, vectors of other
    lengths and products that are no number are no hits.
    """
    spark = rows.sparkSession
    ship(spark)
    asked = queries.where("vec is not null").select("qid", "vec", F.size("vec").alias("dim"))
    asked = materialize(asked, "nearest-queries")
    fields = [asked.schema["qid"], *(rows.schema[k] for k in key)]
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields] + [pa.field("cos", pa.float64())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", cos double"
    found = []
    for dim, n in sorted(asked.groupBy("dim").agg(F.count("*")).collect()):
        if dim == 0:
            continue
        blocks = -(-n // max(1, min(QUERIES, QUERY_BYTES // (8 * dim))))
        own = rows.where(F.size(vector) == dim).select(*key, F.col(vector).cast("array<double>").alias("_v")).sortWithinPartitions(*key)
        for b in range(blocks):
            some = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).select("qid", "vec").toArrow()
            if some.num_rows:
                vectors = some["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, dim).astype(np.float64)
                found.append(own.mapInArrow(_top(some["qid"].to_pylist(), vectors, most, len(key), schema), ddl))
    none = spark.createDataFrame([], ddl)
    best = Window.partitionBy("qid").orderBy(F.desc("cos"), *key)
    return reduce(DataFrame.unionByName, found, none).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
