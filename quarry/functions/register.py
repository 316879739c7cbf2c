"""SQL functions and table functions of the library."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarry.functions.words import porter_udf
from quarry.session import ship


class _Chunks:
    def eval(self, text: str, lines: int) -> Iterator[tuple[int, str]]:
        parts = _lines(text or "")
        for ix, at in enumerate(range(0, len(parts), lines)):
            yield ix, "".join(parts[at : at + lines])


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


#: Table function (text, lines) -> (chunk_ix, chunk_text).
chunk_text = udtf(_Chunks, returnType="chunk_ix int, chunk_text string")


def register(spark: SparkSession) -> None:
    """Make the functions available to ``spark.sql``.

    ``ere_match(pattern, text)`` and ``ere_imatch`` take a Java pattern made by
    :func:`quarry.functions.text.ere`; ``cosine(a, b)``, ``normalize_key(x, n)``,
    ``content_hash(text)`` and ``rrf(rank)`` are SQL expressions that stay in
    the JVM; ``porter_tokens(text)`` is an Arrow function and ``chunks`` a
    table function.
    """
    ship(spark)
    sql = spark.sql
    sql("CREATE OR REPLACE TEMPORARY FUNCTION ere_match(p STRING, t STRING) RETURNS BOOLEAN RETURN t RLIKE p")
    sql("CREATE OR REPLACE TEMPORARY FUNCTION ere_imatch(p STRING, t STRING) RETURNS BOOLEAN RETURN t RLIKE concat('(?i)', p)")
    sql("CREATE OR REPLACE TEMPORARY FUNCTION dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (t, x) -> t + x)")
    sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN dot(a, b) / nullif(sqrt(dot(a, a)) * sqrt(dot(b, b)), 0D)")
    sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_key(x STRING, n INT) RETURNS STRING RETURN regexp_replace(substring(regexp_replace(regexp_replace(translate(coalesce(x, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-'), '^-', ''), 1, n), '-+$', '')")
    sql("CREATE OR REPLACE TEMPORARY FUNCTION content_hash(t STRING) RETURNS STRING RETURN sha2(encode(t, 'UTF-8'), 256)")
    sql("CREATE OR REPLACE TEMPORARY FUNCTION rrf(r INT) RETURNS DOUBLE RETURN 1D / (60 + r)")
    spark.udf.register("porter_tokens", porter_udf())
    spark.udtf.register("chunks", chunk_text)
