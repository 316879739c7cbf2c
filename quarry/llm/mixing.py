"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by a seeded hash.  A document's
virtual finish time is the source's cumulative words up to and with it,
divided by the source's target, that is by its weight times the common budget.
Copies of all sources are then range-sorted by finish time and taken until the
total budget is reached, so at any cut the sources stand in their target
proportions.  A source whose target exceeds its size is queued twice, the
second round after the first.

Cumulative words come from per-partition totals, so a source that holds a
third of all rows is spread over many tasks.

Defined cases: a null text has size 0; a null source is a source of its own
and comes last; documents of size 0 are taken with nothing; a document counts
twice its size at most; repeated rows are documents of their own; an empty
table gives an empty result; extra columns are ignored by :func:`mix` and kept
by :func:`mixed_documents`.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import column, key, numbered
from quarry.llm.quality import words_of
from quarry.storage import broadcast_if_small, materialize, ranged, running_total

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
REPEATS = 2
#: Sources are broadcast up to this many rows (about 60 bytes each), else joined by a shuffle.
BROADCAST_SOURCES = 500_000


def targets(per: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, int]:
    """(_source, source_size, target) for the written ``per`` (source, source_size), and all words together.

    ``weights`` repeat along the sources by code point, null last.  Sources
    above ``repeats`` times their size stop there, and what they leave is shared
    again by weight.  In the order in which sources reach their limit as the
    unit grows, those before the first that stays within it are full; running
    totals of that order find it, so only one row reaches the driver.
    """
    by_name = [F.asc_nulls_last("source")]
    named = running_total(ranged(per, by_name, "mix-names"), {"_k": F.lit(1).cast("long")}, by_name).drop("_pid")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int"))
    weighed = named.withColumn("_w", weight.cast("long"))
    reach = [(F.col("source_size").cast("decimal(38,0)") * (lcm(*weights) / F.col("_w")).cast("int")).cast("decimal(38,0)").alias("_reach")]
    line = ["_reach", "_k"]
    filled = running_total(ranged(weighed.select("*", *reach), line, "mix-reach"), {"_given": F.col("source_size") * repeats, "_light": F.col("_w")}, line).drop("_pid")
    filled = materialize(filled, "mix-filled")
    total, heavy = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    d = share.denominator
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    left = F.lit(Decimal(share.numerator * total)) - whole("_given") * d
    within = left.cast("decimal(38,0)") * F.col("_w") <= whole("source_size") * (heavy - F.col("_light")) * (d * repeats)
    first = filled.where(within).agg(F.min(F.struct("_light", "_given"))).first()[0]
    full = F.col("source_size").cast("double") * repeats
    if first is None:
        target = full
    else:
        words, rest = share.numerator * total - d * first["_given"], d * (heavy - first["_light"])
        target = F.when(F.col("_light") < first["_light"], full).otherwise((F.col("_w") * F.lit(Decimal(words)).cast("decimal(38,0)")).cast("double") / float(rest))
    return filled.select(F.col("source").alias("_source"), "source_size", target.alias("target")), total


def _order_of(doc_id: Column, text: Column, seed: int) -> list[Column]:
    """A document's place among the shuffled documents of its source."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return [F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("_r"), doc_id.alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_x")]


def queue(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """Each queued copy, ``_round`` 0 or 1, of each document, with ``took`` for those within the budget."""
    body = column(docs, text)
    lean = docs.select(column(docs, source).alias("source"), *_order_of(column(docs, doc_id), body, seed), F.size(words_of(body)).cast("long").alias("size"))
    order = ["source", "_r", "doc_id", "_x"]
    table = ranged(materialize(lean, "mix-sizes"), order, "mix-order")
    per = materialize(table.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    sources, total = targets(per)
    sources = broadcast_if_small(sources, BROADCAST_SOURCES)
    budget = int(2 * SHARE * total)  # twice the words to take, so that halves are whole

    # (source, _n) is unique: _n counts a source's documents in its order.
    queued = running_total(table, {"_before": F.col("size"), "_n": F.lit(1).cast("long")}, order, within=["source"])
    queued = queued.drop("_pid").join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    again = F.when(F.col("target") > F.col("source_size"), F.sequence(F.lit(0), F.lit(REPEATS - 1))).otherwise(F.array(F.lit(0)))
    rounds = queued.withColumn("_round", F.explode(again))
    finish = (F.col("_before") + F.col("size") + F.col("_round") * F.col("source_size")) / F.col("target")
    entries = rounds.withColumn("_finish", F.when(F.col("target") > 0, finish).otherwise(F.lit(0.0)))
    line = ["_finish", "source", "_round", "_n"]
    merged = running_total(ranged(entries, line, "mix-line"), {"_ahead": F.col("size")}, line)
    # The document at the cut is taken if at least half of it is within the budget.
    return merged.withColumn("took", F.col("_ahead") * 2 + F.col("size") <= budget)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each document."""
    kept = ["doc_id", "source", "size", "source_size", "target"]
    each = queue(docs, doc_id, text, source, seed).groupBy("_n", *kept).agg(F.sum(F.col("took").cast("long")).alias("copies"))
    return each.select(*kept, "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    What is taken is a prefix of each source's shuffled order in each round, so
    one cutoff for each (source, round) decides and no text is shuffled.
    """
    rows = numbered(docs)
    doc_id, text, source = (key(docs, c) for c in (doc_id, text, source))
    took = queue(rows, doc_id, text, source, seed).where("took")
    ends = took.groupBy(F.col("source").alias("_src"), "_round").agg(F.max(F.struct("_r", "doc_id", "_x")).alias("_end"))
    ends = materialize(ends.groupBy("_src").agg(F.collect_list("_end").alias("_ends")), "mix-ends")  # a row for each source
    at = F.struct(*_order_of(F.col(doc_id), F.col(text), seed))
    out = rows.join(broadcast_if_small(ends, BROADCAST_SOURCES), F.col(source).eqNullSafe(F.col("_src")))
    copies = F.filter(F.col("_ends"), lambda e: at <= e)
    return out.withColumn("_copy", F.explode(copies)).select(*rows.columns).toDF(*docs.columns)
