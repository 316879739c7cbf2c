"""The trie of conversations' prefixes, rolled up by pointer jumping.

A node is a distinct sequence of turns (role, text) that some conversation
begins with.  It is known by a digest, and so is its parent: a turn's digest
salted with its place gives two 64-bit numbers, and a prefix is the sum of its
turns' numbers.  Sums come from per-partition totals, so a conversation of any
length is spread over many tasks.  Two prefixes with equal sums count as one
node, at odds of one in 2**128 for a pair.

What a node sums over its subtree is gathered in rounds.  After k rounds a node
holds the sums of its descendants fewer than 2**k steps below, and a pointer to
its ancestor 2**k steps above; a round adds each node's sums to that ancestor
and replaces the pointer by the ancestor's own.  So a trie of depth d takes
about log2(d) rounds, however its branches lie.  A round's sums are
pre-aggregated before they are dealt, and its tables are written, so a lost
executor costs no more than its tasks.

The digest of the conversations that end at a node needs their ids in order.
Ids are joined in blocks of ``BLOCK``, made by any task, and only a node of
several blocks passes its blocks one by one through a running digest.

Defined cases: turns are ordered by number, null first, and then by their
content's digest; repeated rows are turns of their own; null role and text are
empty; rows without conv_id belong to no conversation and are left out; an
empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import key, numbered
from quarry.session import ship
from quarry.storage import delete, materialize, ranged, recording, running_total

#: Ids that are joined into one text.
BLOCK = 4096


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, bytes), written: each conversation's turns with their places from 1."""
    own = lambda c: F.col(key(conversations, c))
    said = lambda c: F.coalesce(own(c).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(said(role)).cast("string"), F.lit(":"), said(role), said(text)), 256))
    lean = numbered(conversations).select(own(conv_id).cast("long").alias("conv"), own(turn).alias("turn"), digest.alias("digest"), F.octet_length(said(text)).cast("long").alias("bytes"))
    order = ["conv", "turn", "digest"]
    placed = running_total(ranged(lean.where("conv is not null"), order, "trie-order"), {"before": F.lit(1).cast("long")}, order, within=["conv"])
    return materialize(placed.select("conv", (F.col("before") + 1).alias("pos"), "digest", "bytes"), "trie-turns")


def rebuilt(turns: DataFrame, shared: Column, base: Column, most: int) -> DataFrame:
    """(conv, depth, digest, bytes, ends): each conversation made of the first ``shared`` turns of conversation ``base`` and its own later ones.

    ``shared`` and ``base`` are expressions of ``conv``, ``shared`` at most
    ``most``. A row of depth 0 stands for the conversation itself.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    heads = turns.where(F.col("pos") <= most)
    counts = heads.groupBy("conv").agg(F.count("*").alias("n_head")).withColumnRenamed("conv", "base")
    convs = sizes.withColumns({"h": shared.cast("long"), "base": base}).join(counts, "base", "left")
    convs = materialize(convs.select("conv", "base", "h", F.least("h", F.coalesce("n_head", F.lit(0).cast("long"))).alias("taken"), "n"), "trie-convs")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    ends = lambda depth: (length == depth).alias("ends")
    first = heads.withColumnRenamed("conv", "base").join(convs, "base").where(F.col("pos") <= F.col("h")).select("conv", F.col("pos").alias("depth"), "digest", "bytes", ends(F.col("pos")))
    at = F.col("taken") + F.col("pos") - F.col("h")
    later = turns.join(convs, "conv").where(F.col("pos") > F.col("h")).select("conv", at.alias("depth"), "digest", "bytes", ends(at))
    top = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), ends(F.lit(0)))
    return top.unionByName(first).unionByName(later)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, bytes, ends), written: the node of each prefix of each conversation."""
    number = lambda *x: F.when(F.col("digest").isNull(), 0).otherwise(F.xxhash64(*x)).cast("decimal(20,0)")
    order = ["conv", "depth"]
    placed = ranged(rows, order, "trie-prefixes")
    values = {"a": number("digest", "depth"), "b": number("depth", "digest", F.lit("second"))}
    summed = running_total(placed, values, order, within=["conv"])
    key = lambda depth, a, b: F.md5(F.concat_ws(":", *[x.cast("string") for x in (depth, a, b)]))
    node = key(F.col("depth"), F.col("a") + values["a"], F.col("b") + values["b"])
    parent = F.when(F.col("depth") > 0, key(F.col("depth") - 1, F.col("a"), F.col("b")))
    return materialize(summed.select("conv", "depth", node.alias("node"), parent.alias("parent"), "bytes", "ends"), "trie-members")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest) of blocks of ids that come by (node, block)."""
    node, running = None, hashlib.sha256()
    for batch in batches:
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if own != node:
                if node is not None:
                    yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": running.hexdigest()}])
                node, running = own, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.as_py().encode())
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": running.hexdigest()}])


def ending(members: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ids, in order, of the conversations that end at a node."""
    ship(members.sparkSession)
    order = ["node", "conv"]
    placed = running_total(ranged(members.where("ends").select(*order), order, "trie-ends"), {"i": F.lit(1).cast("long")}, order, within=["node"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = materialize(placed.groupBy("node", F.floor(F.col("i") / BLOCK).alias("block")).agg(ids.alias("ids")), "trie-blocks")
    many = blocks.where("block > 0").select("node").distinct()
    one = blocks.join(many, "node", "left_anti").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    several = blocks.join(many, "node", "left_semi").repartition("node").sortWithinPartitions("node", "block").select("node", "ids")
    return one.unionByName(several.mapInArrow(_digested, "node string, ends_sha256 string"))


def rollup(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(node, *values, n_children), written: the ``values`` of (node, parent, depth, ...) summed over each node's subtree.

    ``depth`` counts from 0 at each root. The intermediate tables of a round
    are deleted after the next one.
    """
    spark = nodes.sparkSession
    sums = list(values)
    with recording() as paths:
        now = materialize(nodes.select("node", F.col("parent").alias("up"), F.col("depth").cast("long").alias("depth"), *[v.alias(c) for c, v in values.items()], F.lit(0).cast("long").alias("n_children")), "trie-round")
    most = nodes.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= most:
        with recording() as written:
            below = now.where(F.col("depth") >= step)
            got = below.groupBy(F.col("up").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in sums], F.count("*").alias("_count"))
            add = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
            children = F.coalesce("_count", F.lit(0).cast("long")) if step == 1 else F.col("n_children")
            # Nodes less than twice the step deep have no ancestor further up, so the root, which most would point to, is never joined.
            deep = now.where(F.col("depth") >= 2 * step).select("node", F.col("up").alias("mid"))
            jump = deep.join(now.where(F.col("depth") >= step).select(F.col("node").alias("mid"), F.col("up").alias("_up")), "mid").select("node", "_up")
            out = now.join(got, "node", "left").join(jump, "node", "left")
            new = materialize(out.select("node", F.col("_up").alias("up"), "depth", *map(add, sums), children.alias("n_children")), "trie-round")
        delete(spark, paths)
        now, paths, step = new, written, step * 2
    return now.select("node", *sums, "n_children")


def trie(conversations: DataFrame, shared: Column, base: Column, most: int, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Of each node conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node and parent."""
    members = prefixes(rebuilt(turns_of(conversations, conv_id, turn, role, text), shared, base, most))
    of_node = [F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("bytes").alias("bytes"), F.sum(F.col("ends").cast("long")).alias("n_ends")]
    nodes = materialize(members.groupBy("node", "depth").agg(*of_node), "trie-nodes")
    # A node whose conversations all end there has no child.
    sums = rollup(nodes, {"n_leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    root = nodes.where("depth = 0").first()
    above = nodes.where("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    inner = nodes.where("depth > 1").join(above, "parent").select("node", "_above")
    out = nodes.join(sums, "node").join(ending(members), "node", "left").join(inner, "node", "left")
    up = F.when(F.col("depth") == 1, F.lit(root["conv_id"] if root else None).cast("long")).otherwise(F.col("_above"))
    return out.select("conv_id", "depth", up.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "node", "parent")
