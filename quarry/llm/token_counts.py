"""Token counts by overlap resynchronisation.

A text of at most ``CHUNK`` characters is encoded at once.  A longer one is
encoded in overlapping chunks with the offset of every token, and neighbours
are spliced at a boundary that both encodings have within their overlap and
that is proven stable: no piece of the vocabulary holds the two characters
around it side by side, so no merge can span it in any context, and each side
is encoded as in the whole text.  Where the overlap has no such boundary it is
widened, in the end to the whole rest; where a chunk's offsets don't add up to
its length, as under a normalisation that changes lengths, the text is encoded
whole.  Counts are thus always those of the library for the whole text.

Defined cases: a null text is empty and has no tokens; repeated rows are
counted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.columns import column
from quarry.session import ship

CHUNK = 1 << 14
OVERLAP = 256
_loaded: dict[str, Counter] = {}


class Counter:
    """Counts the tokens of a sentencepiece model without begin and end."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.widened, self.whole = chunk, overlap, 0, 0
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)) for i in range(n)]
        # Characters of each id; of the bytes of a character only its first counts.
        self.chars = np.array([len(p) if ok else int(m.is_byte(i) and int(p[3:5], 16) & 0xC0 != 0x80) for i, (p, ok) in enumerate(zip(pieces, plain, strict=True))], dtype=np.int64)
        self.joined = {p[i : i + 2] for p, ok in zip(pieces, plain, strict=True) if ok for i in range(len(p) - 1)}

    @classmethod
    def at(cls, path: str) -> Counter:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.chunk]
        found = iter(self.model.encode(short, num_threads=1)) if short else iter(())
        return [len(next(found)) if len(t) <= self.chunk else self.spliced(t) for t in texts]

    def _ends(self, text: str) -> np.ndarray | None:
        """Offset past each token of ``text``, or None if they don't add up."""
        ids = np.array(self.model.encode(text), dtype=np.int64)
        ends = np.cumsum(self.chars[ids]) - 1  # the model puts one space before a text
        return ends if len(ends) and ends[-1] == len(text) else None

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", "▁") not in self.joined

    def spliced(self, text: str) -> int:
        total, start, cut = 0, 0, -1  # a first token may be only the space put before the text, which ends at 0
        ends = self._ends(text[: self.chunk])
        stop = self.chunk
        while ends is not None and stop < len(text):
            overlap = self.overlap
            while True:
                begin = max(start, stop - overlap)
                stop_next = min(len(text), begin + self.chunk + overlap)
                after = self._ends(text[begin:stop_next])
                if after is None:
                    break
                # Boundaries of both encodings, the last first; the ends of chunks are no boundaries of the text.
                common = np.intersect1d(ends + start, after + begin)
                at = next((int(x) for x in common[::-1] if max(begin, cut) < x < stop and self.stable(text, int(x))), None)
                if at is not None:
                    break
                self.widened += 1
                if begin == start:  # the overlap is the whole chunk: no cut in it, so go on with a longer one
                    break
                overlap *= 2
            if after is None:
                ends = None
                break
            if at is None:
                ends, stop = after, stop_next
                continue
            total += int(((ends + start > cut) & (ends + start <= at)).sum())
            start, cut, ends, stop = begin, at, after, stop_next
        if ends is None:
            self.whole += 1
            return len(self.model.encode(text))
        return total + int((ends + start > cut).sum())


def count(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and n_tokens (long) by the model file."""
    from pyspark.sql.functions import arrow_udf

    ship(docs.sparkSession)

    @arrow_udf("long")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter.at(model)
        for texts in columns:
            some = texts.fill_null("").to_pylist()
            yield pa.array([n for i in range(0, len(some), 500) for n in counter.counts(some[i : i + 500])], pa.int64())

    keep = docs.columns if keep is None else keep
    return docs.select(*[column(docs, c) for c in keep], run(column(docs, text)).alias("n_tokens"))
