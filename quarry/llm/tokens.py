"""Token ids in ORC files.

Documents are range-sorted by id and encoded in that order; each task writes
one ORC file of (doc_id, seq, n_tokens, ids) whose integer columns are
run-length encoded, with row indexes every ``ROW_INDEX`` rows and a Bloom
filter on doc_id.  Readers get stripes in parallel, and a filter on doc_id
skips stripes and row groups by their statistics and Bloom filters.

The vocabulary is applied word by word: the tokenizer that this is made for
drops white space and no token spans it, so the ids of a text are those of its
words in order.  A worker remembers words in two Arrow arrays of at most
``MEMO`` bytes, whatever the words are like, and encodes at most about ``RUN``
characters at once; a longer text is cut at white space.  A vocabulary file
with another normaliser or word pattern is applied to whole texts instead.

Defined cases: a null text is empty and has only the end id; null doc_ids come
first; rows that repeat a doc_id are encoded each, in the order of their texts'
hashes; an empty table gives an empty table of the same columns; extra columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.columns import key, numbered
from quarry.session import release_memory, ship
from quarry.storage import materialize, running_total, small_batches

END = 2
#: Bytes of remembered words and their ids in a worker.
MEMO = 20 << 20
#: Words of more bytes are not remembered.
LONG_WORD = 64
#: Characters of text that are encoded together.
RUN = 1 << 20
ROW_INDEX = 1000
SCHEMA = "doc_id long, seq long, n_tokens int, ids array<int>"
_loaded: dict[str, WordEncoder] = {}

# The normaliser and the word pattern under which texts may be encoded word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: The word pattern on lower-case Latin-1: letters, single digits, runs of signs.  An apostrophe may start a contraction,
#: so words that hold one are left to the tokenizer.
_MIXED = re.compile(r"[!-&(-@\[-`{-~a-zß-öø-ÿ]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordEncoder:
    """Ids of texts, with a memo of words that is bounded in bytes.

    A run of texts is cut into words, made distinct and looked up in Arrow, so
    Python sees only words that the memo lacks.  A new word of lower-case Latin
    letters, digits and signs goes part by part to the tokenizer's merges, as
    its normalisation leaves such a word whole and its pattern gives these
    parts; all others pass through the whole tokenizer.

    A memo that outgrows its bound keeps the words that were used most, up to
    half of it.
    """

    def __init__(self, path: str, memo: int = MEMO, run: int = RUN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.by_word = (spec["normalizer"], spec["pre_tokenizer"], model["type"], model.get("dropout")) == (NORMALIZER, SPLITTER, "BPE", None) and all(x["content"].startswith("<|") and not re.search(r"\s", x["content"]) for x in spec["added_tokens"])
        self.tokenizer, self.memo, self.run = Tokenizer.from_file(path), memo, run
        self.model, mapped = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # ASCII signs and letters stand for themselves in the vocabulary; other letters as the signs of their bytes.
        self.bytes = {ord(c): mapped.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))}
        self.code = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=False))]
        self.words, self.ids, self.used = pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, np.int64)
        del spec, model
        release_memory()

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    @staticmethod
    def prepared(text: str) -> str:
        """``text`` with ASCII white space as blanks; other white space stays for the tokenizer.

        The tokenizer folds case after it has looked for its special tokens and
        after composing marks, so a text without a special token's opening and
        without characters beyond Latin-1 may be folded before.
        """
        if "<|" not in text and (text.isascii() or _latin1(text)):
            text = text.lower()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")

    def _whole(self, new: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(new), 1000):
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(new[i : i + 1000], add_special_tokens=False)]
        return out

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of each of the distinct words ``new``."""
        parts: dict[str, bytes] = {}
        merge, code, letters = self.model.tokenize, self.code, self.bytes

        def part(p: str) -> bytes:
            found = parts.get(p)
            if found is None:
                parts[p] = found = b"".join([code[t.id] for t in merge(p if p.isascii() else p.translate(letters))])
            return found

        out: list[bytes | None] = []
        for w in new:
            if w.isascii() and w.isalpha() and w.islower():
                out.append(b"".join([code[t.id] for t in merge(w)]))
            elif _MIXED.fullmatch(w) and "<|" not in w:
                out.append(b"".join([part(p) for p in _PARTS.findall(w)]))
            else:
                out.append(None)
        other = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(other, self._whole([new[i] for i in other]), strict=True):
            out[i] = x
        return out

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(pa.array([self.prepared(t) for t in texts], pa.string()), " ")
        coded = words.values.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.words)
        missing = pc.is_null(at).to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy().copy()
        new = coded.dictionary.filter(pa.array(missing))
        place[missing] = len(self.words) + np.arange(len(new))
        every = pa.concat_arrays([self.ids, pa.array(self.learn(new.to_pylist()), pa.binary())])
        taken = every.take(pa.array(place)).take(coded.indices)
        self.used[place[~missing]] += 1
        self._remember(new, every)
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1).astype(np.int64) // 4
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4", int(ends[-1]))
        return ids, np.diff(ends[words.offsets.to_numpy()])

    def _remember(self, new: pa.Array, every: pa.Array) -> None:
        words = pa.concat_arrays([self.words, new])
        used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        own = pc.binary_length(words).to_numpy()
        size = own + pc.binary_length(every).to_numpy() + 16  # two offsets and the count
        keep = own <= LONG_WORD
        if size[keep].sum() > self.memo:
            best = np.argsort(-used * keep, kind="stable")
            best = best[keep[best]]
            best = best[np.cumsum(size[best]) <= self.memo // 2]
            keep = np.zeros(len(words), bool)
            keep[best] = True
            used //= 2
        if keep.all():
            self.words, self.ids, self.used = words, every, used
        else:
            mask = pa.array(keep)
            self.words, self.ids, self.used = words.filter(mask), every.filter(mask), used[keep]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in order, and how many each text has."""
        if not self.by_word:
            found = [x for t in texts for x in self._whole([t])]
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        if sum(map(len, texts)) <= self.run:
            return self._encode(texts) if texts else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        ids, counts, held, owners, n = [], np.zeros(len(texts), np.int64), [], [], 0
        for i, t in enumerate(texts):
            for piece in _cut(t, self.run):
                if held and n + len(piece) > self.run:
                    got, each = self._encode(held)
                    ids.append(got)
                    np.add.at(counts, owners, each)
                    held, owners, n = [], [], 0
                held.append(piece)
                owners.append(i)
                n += len(piece)
        got, each = self._encode(held)
        ids.append(got)
        np.add.at(counts, owners, each)
        return np.concatenate(ids), counts


def _cut(text: str, size: int) -> Iterator[str]:
    """Pieces of about ``size`` characters that end before a blank; without one a piece is longer."""
    start = 0
    while len(text) - start > size:
        end = max(text.rfind(c, start + 1, start + size + 1) for c in " \n\t\r")
        if end < 0:
            found = [x for c in " \n\t\r" if (x := text.find(c, start + size)) >= 0]
            if not found:
                break
            end = min(found)
        yield text[start:end]
        start = end
    yield text[start:]


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _runs(batches: Iterator[pa.RecordBatch], size: int = RUN) -> Iterator[pa.Table]:
    """Batches put together to about ``size`` bytes of text."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b["text"].nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def write(docs: DataFrame, vocabulary: str, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Encode ``docs`` with the vocabulary file and write them under ``path``; returns :func:`read` of it."""
    spark = docs.sparkSession
    ship(spark)
    plain = numbered(docs)
    body = F.coalesce(F.col(key(docs, text)), F.lit(""))
    rows = plain.select(F.col(key(docs, doc_id)).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("hash"), F.monotonically_increasing_id().alias("row"))
    # The hash and the row's number split what repeats a doc_id; rows that are equal in all else are equal in their ids.
    order = ["doc_id", "hash", "row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.at(vocabulary)
        for t in _runs(batches):
            if not len(t):
                continue
            data, n = encoder.encode(t["text"].to_pylist())
            data = np.insert(data, np.cumsum(n), end).astype(np.int32)
            n = (n + 1).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(data))
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), t["seq"].combine_chunks(), pa.array(n), ids], names=["doc_id", "seq", "n_tokens", "ids"])
        release_memory()

    out = ordered.select("doc_id", "seq", "text").mapInArrow(run, SCHEMA)
    with small_batches(spark):
        out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_INDEX)).option("orc.compress", "ZSTD").orc(path)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, seq (rises with the order; the file's number above bit 33), n_tokens and ids."""
    return spark.read.schema(SCHEMA).orc(path)


def digests(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files' ids.

    ``start`` counts the ids of all documents before it; it comes from the
    files' totals, so no task sees more than one file's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"]
            at, data = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["seq"], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "seq", "n_tokens", "ids_crc32"])

    ship(table.sparkSession)
    with small_batches(table.sparkSession):
        light = materialize(table.select("doc_id", "seq", "ids").mapInArrow(run, "doc_id long, seq long, n_tokens long, ids_crc32 long").withColumn("part", F.shiftright("seq", 33)), "token-digests")
    out = running_total(light, {"start": F.col("n_tokens")}, ["seq"], pid="part")
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")
