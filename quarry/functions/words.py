"""Word splitting, Porter stems and WordPiece ids."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; a tokenizer that SQL engines share."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, "[^a-z0-9]+", -1), "")


def plain_words_py(text: str) -> list[str]:
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]


def unicode_words(text: str) -> list[str]:
    """Runs of letters, numbers and private-use characters, case-folded and without diacritics."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return [m.lower() for m in re.findall(r"(?:[^\W_]|[\ue000-\uf8ff])+", plain)]


# Porter's algorithm (An algorithm for suffix stripping, 1980)


def _shape(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i and out[i - 1] == "c") else "c"
    return out


def _m(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _vowel(w: str) -> bool:
    return "v" in _shape(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix tables of steps 2, 3 and 4.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _swap(w: str, table: list[tuple[str, str]], least: int) -> str:
    for end, new in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if _m(stem) > least else w
    return w


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """The Porter stem of a lower-case ASCII word; other words and short ones stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2, 0), _STEP3, 0)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _m(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _m(w) > 1 else w


def porter_words(text: str | None) -> list[str]:
    return [stem(w) for w in unicode_words(text or "")]


def porter_udf():
    """Arrow UDF text -> array<string> of stems in order."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(porter_words)

    return run


# WordPiece

BASIC_TOKENS, TOKEN_BYTES, SEQUENCE = 512, 127, 256


class WordPiece:
    """Greedy longest-match ids with [CLS] and [SEP], ``SEQUENCE`` at most.

    The plain mode folds and splits ASCII only and cuts words to
    ``TOKEN_BYTES``; the conformant one folds all of Unicode, strips accents,
    splits at Unicode punctuation and ideographs, and gives words of over 100
    characters the unknown id.
    """

    def __init__(self, vocab: list[str], conformant: bool = False):
        self.ids = {t: i for i, t in enumerate(vocab)}
        self.conformant = conformant
        self.cls, self.sep, self.unk = (self.ids[t] for t in ("[CLS]", "[SEP]", "[UNK]"))

    def basic(self, text: str) -> list[str]:
        if not self.conformant:
            punct = r"!-/:-@\[-`{-~"
            low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            found = re.findall(rf"[{punct}]|[^\t-\r {punct}]+", low)
            return [t.encode()[:TOKEN_BYTES].decode("utf-8", "ignore") for t in found[:BASIC_TOKENS]]
        out, word = [], ""
        for c in unicodedata.normalize("NFD", text.lower()):
            kind = unicodedata.category(c)
            if kind == "Mn" or c in "\0\ufffd" or (kind.startswith("C") and c not in "\t\n\r"):
                continue
            alone = kind.startswith("P") or c in "$+<=>^`|~" or _ideograph(ord(c))
            if alone or c.isspace():
                out += [word] if word else []
                out += [c] if alone else []
                word = ""
            else:
                word += c
        return (out + ([word] if word else []))[:BASIC_TOKENS]

    def pieces(self, word: str) -> list[int]:
        if self.conformant and len(word) > 100:
            return [self.unk]
        out, start = [], 0
        while start < len(word):
            end = next((e for e in range(len(word), start, -1) if ("##" * (start > 0) + word[start:e]) in self.ids), None)
            if end is None:
                return [self.unk]
            out.append(self.ids["##" * (start > 0) + word[start:end]])
            start = end
        return out

    def encode(self, text: str) -> list[int]:
        out = [self.cls]
        for w in self.basic(text or ""):
            out += self.pieces(w)
            if len(out) >= SEQUENCE - 1:
                break
        return out[: SEQUENCE - 1] + [self.sep]


def _ideograph(c: int) -> bool:
    return any(a <= c <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)))


def wordpiece_udf(vocab: list[str], conformant: bool = False):
    """Arrow UDF text -> array<int>; the vocabulary travels with the function."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(WordPiece(vocab, conformant).encode)

    return run


def snippet(text: str | None, terms: set[str], width: int = 24, marks: tuple[str, str, str] = ("[", "]", " ... ")) -> str:
    """The ``width``-word window with the most distinct stemmed ``terms`` (the first such), hits in marks."""
    text = text or ""
    at = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    hit = [stem("".join(unicode_words(text[a:b]))) for a, b in at]
    best, most = 0, -1
    for i in range(max(1, len(at) - width + 1)):
        n = len({h for h in hit[i : i + width] if h in terms})
        if n > most:
            best, most = i, n
    some = at[best : best + width]
    if not some:
        return text
    begin, end = (0 if best == 0 else some[0][0]), (len(text) if best + width >= len(at) else some[-1][1])
    out, last = "", begin
    for (a, b), h in zip(some, hit[best : best + width], strict=False):
        out += text[last:a] + (marks[0] + text[a:b] + marks[1] if h in terms else text[a:b])
        last = b
    out += text[last:end]
    return (marks[2] if begin else "") + out + (marks[2] if end < len(text) else "")


def snippet_udf(terms: set[str], width: int = 24):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, terms, width))

    return run
