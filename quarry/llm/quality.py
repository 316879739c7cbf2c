"""Quality rules by weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on each document.  Expectation
maximisation estimates, from the votes alone, how often each rule is right when
it votes; the posterior probability of good replaces the usual "every rule must
pass".

Only the table of distinct vote patterns, at most 3 to the number of rules,
reaches the driver, so the fit costs the same at any corpus size while its
counts cover every document.

Defined cases: a null text counts as empty; a text without words has zero
counts, fails the base rules and gets only abstentions; repeated rows are
scored each on their own; an empty table gives an empty result; extra columns
are ignored and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import column, key, numbered
from quarry.storage import let, materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in ``window``-word windows that the text holds twice or more.

    Windows are compared by their 64-bit hash.  Only texts with a repeated
    window sort theirs.
    """

    def covered(hashes: Column) -> Column:
        in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spans(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            # get() gives null beyond the ends; null or false drops the row.
            at = F.sort_array(F.transform(again, lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(window))), F.lit(window), lambda t, x: t + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(in_order, spans))

    def body(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) > window, let(windows, covered)).otherwise(F.lit(0))

    return let(words, body).cast("long")


def features(text: Column) -> dict[str, Column]:
    """Counts that the rules read, as expressions over a text and its words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return {
        "_w": let(words_of(text), counts),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
        "n_alnum": F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", "")).cast("long"),
    }


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_alnum"]


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns of ``docs`` and the long columns ``FEATURES``, each with ``prefix``."""
    keep = docs.columns if keep is None else keep
    f = features(column(docs, text))
    raw = docs.select(*[column(docs, c) for c in keep], *[v.alias(f"{prefix}_raw_{k}") for k, v in f.items()])
    r = lambda k: F.col(f"{prefix}_raw_{k}")
    w, lines = r("_w"), r("_lines")
    made = {"n_words": w["n_words"], "word_chars": w["word_chars"], "n_symbols": r("n_symbols"), "n_dup_lines": lines["dup"], "n_repeat_words": w["n_repeat_words"], "n_distinct": w["n_distinct"], "n_lines": lines["n"], "n_upper": r("n_upper"), "n_alnum": r("n_alnum")}
    return raw.select(*[column(raw, c) for c in keep], *[v.alias(prefix + k) for k, v in made.items()])


def rules(prefix: str = "") -> dict[str, Column]:
    """The voting rules over :func:`measure`'s columns; every one abstains without words.

    A rule that looks for a defect votes bad where it finds it and abstains
    elsewhere, since the absence of one defect says little; each defect is
    looked for in two or three ways, so that the votes can confirm each other.
    Rules that look for prose vote good where they find it.
    """
    c = lambda k: F.col(prefix + k).cast("double")
    n, chars, alnum = c("n_words"), c("word_chars"), c("n_alnum")
    bad = {
        "symbol_words": c("n_symbols") > 0.1 * n,
        "symbol_chars": c("n_symbols") > 0.015 * chars,
        "few_letters": alnum < 0.9 * chars,
        "repeats": c("n_repeat_words") > 0.2 * n,
        "dup_lines": (c("n_lines") >= 3) & (c("n_dup_lines") > 0.3 * c("n_lines")),
        "low_variety": (n >= 50) & (c("n_distinct") < 3 * F.sqrt(n)),
        "few_distinct": (n >= 20) & (c("n_distinct") < 0.3 * n) & (c("n_distinct") < 100),
        "shouting": c("n_upper") > 0.4 * alnum,
        "odd_words": (chars < 2.5 * n) | (chars > 12 * n),
    }
    prose = (alnum >= 0.93 * chars) & (c("n_symbols") <= 0.02 * n)
    good = {
        "cased_prose": prose & (c("n_upper") <= 0.15 * alnum),
        "varied_prose": prose & (n >= 20) & (c("n_distinct") >= 4 * F.sqrt(n)),
    }
    vote = lambda x, v: F.when((n > 0) & x, F.lit(v)).otherwise(F.lit(0))
    return {k: vote(x, -1) for k, x in bad.items()} | {k: vote(x, 1) for k, x in good.items()}


def fit(patterns: list[tuple[tuple[int, ...], int]], settled: float = 1e-9, start: float = 0.8, smooth: float = 2.0) -> tuple[float, list[float]]:
    """Accuracies by expectation maximisation over counted vote patterns.

    Returns the share of good documents and the probability of each rule that
    its vote is right, given that it votes.  Every rule starts at ``start``
    with ``smooth`` pseudo-votes of that accuracy.  Accuracies stay within 0.55
    and 0.995, so that a rule can't turn into its opposite or overrule all
    others; the share stays within 0.05 and 0.95.  Rounds end when no figure
    moves by more than ``settled``, or after 1000.
    """
    m = len(patterns[0][0]) if patterns else 0
    if not patterns or not sum(n for _, n in patterns):
        return 0.5, [start] * m
    votes = np.array([p for p, _ in patterns], dtype=np.float64).reshape(len(patterns), m)
    counts = np.array([n for _, n in patterns], dtype=np.float64)
    voted = counts @ np.abs(votes)
    prior, acc = 0.5, np.full(m, start)
    for _ in range(1000):
        base, w = weights(prior, acc)
        good = 1 / (1 + np.exp(-(base + votes @ w)))
        right = (counts * good) @ (votes > 0) + (counts * (1 - good)) @ (votes < 0)
        before = np.append(acc, prior)
        prior = float(np.clip(counts @ good / counts.sum(), 0.05, 0.95))
        acc = np.clip((right + start * smooth) / (voted + smooth), 0.55, 0.995)
        if np.abs(np.append(acc, prior) - before).max() <= settled:
            break
    return prior, acc.tolist()


def weights(prior: float, acc: Sequence[float]) -> tuple[float, np.ndarray]:
    """Log odds of good: at first, and what a good vote of each rule adds (a bad one subtracts)."""
    a = np.asarray(acc, dtype=np.float64)
    return math.log(prior / (1 - prior)), np.log(a / (1 - a))


def posterior_of(pattern: tuple[int, ...], prior: float, acc: Sequence[float]) -> float:
    base, w = weights(prior, acc)
    return float(1 / (1 + np.exp(-(base + w @ np.array(pattern, dtype=np.float64)))))


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """``keep`` columns with the counts, votes, ``base_failed``, ``posterior`` and ``kept``.

    Everything made here has ``prefix`` before its name.  The measured table is
    written once; the fit and the verdicts both read it.
    """
    keep = docs.columns if keep is None else keep
    measured = measure(docs, text, keep, prefix)
    votes = rules(prefix)
    table = materialize(measured.select("*", *[v.alias(f"{prefix}vote_{k}") for k, v in votes.items()]), "quality")
    names = [f"{prefix}vote_{k}" for k in votes]
    # At most 3 ** len(rules) rows.
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in table.groupBy(*names).agg(F.count(F.lit(1))).collect())
    base, w = weights(*fit(patterns)) if patterns else (0.0, [0.0] * len(names))
    odds = F.lit(base)
    for name, weight in zip(names, w, strict=True):
        odds = odds + F.col(name) * F.lit(float(weight))
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    out = table.withColumn(f"{prefix}base_failed", (n < 20) | (r * 100 > n * 30)).withColumn(f"{prefix}posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}posterior") >= threshold))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with the columns of ``docs`` and no others."""
    rows = numbered(docs)
    return judge(rows, key(docs, text), rows.columns, threshold, "_").where(F.col("_kept")).select(*rows.columns).toDF(*docs.columns)
