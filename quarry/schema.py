"""Schemas of the canonical tables and the fixed values that belong to the data model."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType

CHUNK_LINES = 40
NO_MODEL = "none"

CHUNK = StructType([
    StructField("content_hash", StringType()),
    StructField("model_id", StringType()),
    StructField("chunk_ix", IntegerType()),
    StructField("chunk_text", StringType()),
    StructField("embedding", ArrayType(FloatType())),
])

SOURCE = StructType([
    StructField("path", StringType()),
    StructField("content_hash", StringType()),
    StructField("mtime", LongType()),
    StructField("ts", StringType()),
])

#: Which paths have a content, by content.
REF = StructType([
    StructField("content_hash", StringType()),
    StructField("path", StringType()),
])

#: Contents that no path has any more (``gone``), or has again; the highest ``seq`` of a content counts.
DEAD = StructType([
    StructField("content_hash", StringType()),
    StructField("gone", BooleanType()),
    StructField("seq", LongType()),
])

#: All strings; an absent field is '' and never null. ts and the like are ISO-8601 UTC, whose order as text is time's order.
NOTE_FIELDS = ["note_id", "ts", "type", "place", "who", "due", "state", "closes", "claimed", "lease", "challenge", "stolen_from", "text", "source_path"]
NOTE = StructType([StructField(f, StringType()) for f in NOTE_FIELDS])

#: Field events, appended only; ``seq`` rises with the commits.
NOTE_EVENT = StructType([
    StructField("note_id", StringType()),
    StructField("field", StringType()),
    StructField("value", StringType()),
    StructField("seq", LongType()),
    StructField("ts", StringType()),
])

#: The keyword index: a row for each stem and chunk.
POSTING = StructType([
    StructField("term", StringType()),
    StructField("content_hash", StringType()),
    StructField("chunk_ix", IntegerType()),
    StructField("dl", IntegerType()),
    StructField("positions", ArrayType(IntegerType())),
    StructField("tf", IntegerType()),
])

#: The literal index: a row for each blank-separated word, folded, and chunk.
WORD = StructType([
    StructField("word", StringType()),
    StructField("content_hash", StringType()),
    StructField("chunk_ix", IntegerType()),
])

#: Which words have a run of three characters; the words themselves may be gone.
GRAMS = StructType([
    StructField("gram", StringType()),
    StructField("word", StringType()),
])

#: Indexed chunks and their stems together, one row.
STAT = StructType([
    StructField("n", LongType()),
    StructField("total", LongType()),
])

SCANNED = StructType([
    StructField("path", StringType()),
    StructField("text", StringType()),
    StructField("mtime", LongType()),
    StructField("readable", BooleanType()),
    StructField("is_binary", BooleanType()),
    StructField("complete", BooleanType()),
])

# The registered namespaces of virtual paths, the skipped
# directories and the note types.
NAMESPACES = ["wiki", "ticket", "forum", "ckin", "note", "tchg", "attach", "uv"]
SKIP_DIRS = [".git", ".fslckout", "_FOSSIL_", "vendor", "build"]
NOTE_TYPES = ["task", "observation", "rule", "schedule", "alert", "question", "note"]
