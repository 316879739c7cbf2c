"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question asked
again with other parameters keeps its template.  Five-word windows of the
documents are hash-joined with those of the benchmark, twice: as templates and
as plain lower-cased words.  A document that holds at least 80 % of an item's
plain windows has it ``verbatim``, whatever else stands there.  One that holds
80 % of its template windows is a candidate, and the values in the slots of
one copy at a time decide (see ``_checked``): all equal is ``verbatim``, every
value with one replacement is ``reparameterised``, anything else is a shared
template and no leak.  The best copy counts.

A template window votes if it holds ``WORDS`` words besides placeholders and
stands once in the item, so each place of a document meets at most one place of
an item, and number tables meet none.  An item of which fewer than half of the
windows vote has too little wording for a template and is sought word for word
only, as is one without placeholders.

A name is a capitalised word wherever it stands, unless it is one of
``OPENERS``.  As whole languages write their nouns so, a copy counts as
re-parameterised only if at most one name in ``WORDS_PER_NAME`` words of the
item is another one; what changes more words than that is another text.

Defined cases: a null text is empty and matches nothing; a text of fewer than
five words has itself as its only window, so an item that short is found in a
document that consists of it and, with ``short``, at any place of any document
(there as a template only if that votes); rows that repeat a doc_id count as
one document, which leaks if one of its texts does; items that share an item_id
are sought each for itself; an empty benchmark or document table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.columns import column, key, numbered
from quarry.llm.quality import SPACE
from quarry.storage import broadcast_if_small, let, materialize

WINDOW = 5
CONTAINMENT = 0.8
#: Benchmark windows are broadcast up to this many (item, window) pairs (about 60 bytes each), else joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Ids of flagged documents are broadcast up to this many (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 500_000

#: Words besides placeholders without which a template window says nothing.
WORDS = 2
#: A copy may have one other name in so many words of the item.
WORDS_PER_NAME = 6

NUMBER, UNIT, NAME = "\u0001", "\u0002", "\u0003"
#: Capitalised because they open a sentence; they are words, not names.
OPENERS = "The|An|This|That|These|Those|There|Here|It|Its|He|She|We|They|You|His|Her|My|Our|Your|Their|If|When|While|After|Before|Since|For|From|In|On|At|By|Of|To|With|As|And|But|Or|So|Then|What|Which|Who|Whose|Whom|Where|Why|How|Is|Are|Was|Were|Do|Does|Did|Can|Could|Will|Would|Should|Has|Have|Had|Each|Every|All|Some|Many|Both|Find|Let|Suppose|Given|No|Not"
UNITS = "mm|cm|m|km|mi|ft|in|yd|mg|g|kg|lb|lbs|oz|ml|l|s|sec|secs|min|mins|h|hr|hrs|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|kilometers?|kilometres?|grams?|kilograms?|pounds?|liters?|litres?|dollars?|cents?|euros?|percent|degrees?|km/h|mph|usd|eur|gbp|kb|mb|gb|tb"


def _template_text(text: Column) -> Column:
    """``text`` with placeholders, lower-cased and without punctuation.

    No step adds or removes white space, so the n-th word of the result belongs
    to the n-th word of the text; a word of punctuation only becomes empty.
    """
    named = F.regexp_replace(text, rf"(?=\p{{Lu}}\p{{M}}*\p{{Ll}})(?<![\p{{L}}\p{{M}}\p{{Nd}}])(?!(?:{OPENERS})(?![\p{{L}}\p{{M}}]))\p{{Lu}}[\p{{L}}\p{{M}}]+", NAME)
    numbered = F.regexp_replace(named, r"[+-]?\d+(?:[.,:/]\d+)*", NUMBER)
    with_units = F.regexp_replace(numbered, rf"(?i)(?<={NUMBER}|{NUMBER}\x20)[%°$€£]?(?:{UNITS}|[%°$€£])(?![\p{{L}}\p{{Nd}}])", UNIT)
    marked = F.when(text.rlike(r"\d"), with_units).otherwise(named)
    return F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{M}}{NUMBER}{UNIT}{NAME}\x20\x09-\x0D]+", "")


def template_words(text: Column) -> Column:
    return F.array_remove(F.split(_template_text(F.coalesce(text, F.lit(""))), SPACE, -1), "")


def plain_words(text: Column) -> Column:
    """The lower-cased words without punctuation, save for signs, separators and currencies of numbers."""
    kept = r"(?!(?<=\p{Nd}[.,:/])\p{Nd})(?!(?<=[+-])(?<![\p{L}\p{M}].)\p{Nd})"
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{M}}\p{{Nd}}%°$€£\x20\x09-\x0D]{kept}", "")
    return F.array_remove(F.split(text, SPACE, -1), "")


def windows(words: Column, window: int = WINDOW, lengths: tuple[int, ...] = (), plain: bool = False) -> Column:
    """The 64-bit hashes of all ``window``-word runs, in order; of the whole if it is shorter.

    Runs of ``lengths`` follow, if they hold a letter or, when ``plain``, a
    digit. Plain runs and templates never share a hash. Each word is hashed
    once, and a run is a hash of its words' hashes.
    """
    mark = [F.lit(1)] if plain else []
    sayable = r"[\p{L}\p{Nd}]" if plain else r"\p{L}"

    def body(x: Column) -> Column:
        w, h = x["w"], x["h"]

        def runs(n: int, at: Column) -> Column:
            return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)], *mark))

        def places(n: int) -> Column:
            return F.sequence(F.lit(0), F.size(h) - n)

        whole = F.array(F.xxhash64(h, *mark))
        none = F.slice(whole, 1, 0)
        out = F.when(F.size(h) >= window, runs(window, places(window))).when(F.size(h) > 0, whole).otherwise(none)
        for n in lengths:
            said = F.filter(places(n), lambda i: F.exists(F.slice(w, i + 1, n), lambda x: x.rlike(sayable)))
            out = F.concat(out, F.when(F.size(h) >= n, runs(n, said)).otherwise(none))
        return out

    return let(let(words, lambda w: F.struct(w.alias("w"), F.transform(w, lambda y: F.xxhash64(y)).alias("h"))), body)


def _slotted(text: Column, window: int, lengths: tuple[int, ...] = ()) -> Column:
    """Of each window its hash, its place and, word by word, the text's own word where a placeholder stands (else null), names marked."""
    text = F.coalesce(text, F.lit(""))
    pairs = F.filter(
        F.arrays_zip(F.split(_template_text(text), SPACE, -1).alias("t"), F.split(text, SPACE, -1).alias("v")),
        lambda x: x["t"] != "",
    )
    value = lambda x: F.regexp_replace(F.lower(x["v"]), r"^[^\p{L}\p{Nd}%°$€£+-]+|[^\p{L}\p{Nd}%°$€£]+$", "")
    slot = lambda x: F.when(x["t"].rlike(f"[{NUMBER}{UNIT}{NAME}]"), F.when(x["t"].contains(NAME), F.concat(F.lit(NAME), value(x))).otherwise(value(x)))

    def body(p: Column) -> Column:
        def made(n: int) -> Column:
            run = lambda i: F.slice(p, i, n)
            one = lambda i: F.struct(F.xxhash64(F.transform(run(i), lambda x: F.xxhash64(x["t"]))).alias("h"), i.alias("pos"), F.transform(run(i), slot).alias("slots"))
            return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - (n - 1), F.lit(1))), one)

        first = made(window)
        out = F.when(F.size(p) > 0, first).otherwise(F.slice(first, 1, 0))
        for n in lengths:
            out = F.when(F.size(p) > n, F.concat(out, made(n))).otherwise(out)
        return out

    return let(pairs, body)


def leaks(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, containment: float = CONTAINMENT, short: bool = False) -> DataFrame:
    """One row for each leaked (document, item): doc_id, item_id, matched, n_windows, containment, kind.

    The counts are of template windows, or of plain ones where only those
    reach ``containment``. ``short`` also seeks items below ``window`` words
    within longer documents.
    """
    d = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    b = bench.select(column(bench, item_id).alias("item_id"), F.coalesce(column(bench, item_text), F.lit("")).alias("text")).distinct()
    t, p = template_words(F.col("text")), plain_words(F.col("text"))
    has_slots = F.exists(t, lambda x: x.rlike(f"[{NUMBER}{UNIT}{NAME}]"))
    made = b.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text", F.array_distinct(windows(p, window, plain=True)).alias("p"), F.size(t).alias("n_words"), F.size(p).alias("n_plain"), has_slots.alias("has_slots"))
    items = materialize(made, "bench-items")
    votes = materialize(_votes(items.where("has_slots"), window), "bench-votes")
    few_of = lambda df, c: tuple(sorted(r[0] for r in df.where(F.col(c).between(1, window - 1)).select(c).distinct().collect())) if short else ()
    lengths, plain_lengths = few_of(votes, "n_words"), few_of(items, "n_plain")
    as_words = items.select("item", F.lit(True).alias("plain"), F.size("p").cast("long").alias("n_windows"), F.explode("p").alias("h"))
    per_item = votes.select("item", F.lit(False).alias("plain"), "n_windows", "h").unionByName(as_words)
    posting = materialize(per_item.groupBy("h").agg(F.collect_list(F.struct("item", "plain", "n_windows")).alias("items")), "bench-windows")
    few = (posting.agg(F.sum(F.size("items"))).first()[0] or 0) <= BROADCAST_WINDOWS
    # Texts that share a doc_id are told apart by their hash, so that none makes up for what another lacks.
    each = d.select("doc_id", F.xxhash64("text").alias("version"), F.explode(F.concat(windows(t, window, lengths), windows(p, window, plain_lengths, plain=True))).alias("h"))
    # A window that a text repeats is one hit, before the items that hold it are named.
    held = each.join(F.broadcast(posting.select("h")) if few else posting.select("h"), "h", "left_semi").distinct()
    hits = held.join(F.broadcast(posting) if few else posting, "h").select("doc_id", "version", "h", F.inline("items"))
    found = hits.groupBy("doc_id", "version", "item", "plain").agg(F.count("h").alias("matched"), F.max("n_windows").alias("n_windows"))
    enough = found.where(F.col("matched") >= containment * F.col("n_windows"))
    counts = lambda c: F.coalesce(F.max(F.when(~F.col("plain"), F.col(c))), F.max(c)).alias(c)
    candidates = materialize(enough.groupBy("doc_id", "item").agg(counts("matched"), counts("n_windows"), F.max("plain").alias("word_for_word")), "bench-candidates")
    out = candidates.where("word_for_word").withColumn("k", F.lit(0))
    open_ = candidates.where("not word_for_word")
    if not open_.isEmpty():
        out = out.unionByName(_checked(d, votes, open_, window, containment, lengths))
    ids = items.select("item", "item_id")
    best = out.join(F.broadcast(ids) if few else ids, "item").groupBy("doc_id", "item_id").agg(F.min_by(F.struct("matched", "n_windows", "k"), F.struct("k", -F.col("matched") / F.col("n_windows"), "item")).alias("b"))
    kind = F.when(F.col("b.k") == 0, "verbatim").otherwise("reparameterised")
    return best.select("doc_id", "item_id", "b.matched", "b.n_windows", (F.col("b.matched") / F.col("b.n_windows")).alias("containment"), kind.alias("kind"))


def _votes(items: DataFrame, window: int) -> DataFrame:
    """(item, h, place, asked, n_words, n_windows): the voting template windows of the items that have enough."""
    each = items.select("item", "n_words", F.explode(_slotted(F.col("text"), window)).alias("x")).select("item", "n_words", "x.h", "x.pos", "x.slots")
    worded = F.size(F.filter("slots", lambda s: s.isNull())) >= WORDS
    once = each.where(worded).groupBy("item", "n_words", "h").agg(F.count("*").alias("n"), F.min("pos").alias("place"), F.min("slots").alias("asked")).where("n = 1").drop("n")
    enough = once.groupBy("item").agg(F.count("*").alias("n_windows"), F.max("n_words").alias("_n")).where(F.col("n_windows") * 2 >= F.greatest(F.col("_n") - (window - 1), F.lit(1))).drop("_n")
    return once.join(enough, "item")


def _checked(d: DataFrame, votes: DataFrame, candidates: DataFrame, window: int, containment: float, lengths: tuple[int, ...]) -> DataFrame:
    """The candidates of which a copy holds equal or consistently replaced values, with ``k`` 0 or 1.

    A copy is a set of matches (place in the document, place in the item) of
    one text. Tried are: equal differences of the places; and differences
    within a band as long as the item, for copies with words added or left out,
    where each place of the item keeps the match nearest to the commonest
    difference (two bands, shifted by half, so that no copy is always cut).
    Each has to reach ``containment`` by itself.  As a place of the document
    meets one place of an item at most, matches grow with the document, and
    those of a band with the item.
    """
    c = candidates.select(F.col("doc_id").alias("_d"), "item")
    ids = broadcast_if_small(c.select("_d").distinct(), BROADCAST_IDS)
    texts = d.join(ids, d["doc_id"].eqNullSafe(ids["_d"]), "left_semi")
    # The text's hash tells apart texts that share a doc_id; equal texts are one.
    texts = texts.select("doc_id", F.xxhash64("text").alias("version"), "text").dropDuplicates(["doc_id", "version"])
    ours = texts.select("doc_id", "version", F.explode(_slotted(F.col("text"), window, lengths)).alias("x")).select("doc_id", "version", F.col("x.h").alias("_h"), F.col("x.pos").alias("at"), F.col("x.slots").alias("there"))
    theirs = c.join(votes, "item")
    pairs = ours.join(theirs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("h")))
    shift, band = F.col("at") - F.col("place"), F.greatest(F.col("n_words"), F.lit(2))
    copies = F.array(*[F.struct(F.lit(k).alias("way"), x.cast("long").alias("key")) for k, x in enumerate((shift, F.floor(shift / band), F.floor((shift + band / 2) / band)))])
    slots = F.filter(F.arrays_zip("asked", "there"), lambda x: x["asked"].isNotNull() & x["there"].isNotNull())
    rows = pairs.select("doc_id", "version", "item", "n_windows", "n_words", "place", shift.alias("shift"), slots.alias("slots"), F.explode(copies).alias("copy"))
    one = ["doc_id", "version", "item", "copy"]
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*one, "shift"))).withColumn("common", F.max(F.struct("n", "shift")).over(Window.partitionBy(*one))["shift"])
    nearest = F.row_number().over(Window.partitionBy(*one, "place").orderBy(F.abs(F.col("shift") - F.col("common")), "shift"))
    rows = rows.withColumn("nearest", nearest).where("nearest = 1")
    same = F.forall("slots", lambda x: x["asked"] == x["there"])
    per = rows.groupBy(*one).agg(F.max("n_windows").alias("n_windows"), F.max("n_words").alias("n_words"), F.count("*").alias("held"), F.sum(same.cast("long")).alias("equal"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("values"))
    bound = containment * F.col("n_windows")
    replaced = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda x: x["asked"])))
    names = F.size(F.filter("values", lambda x: x["asked"].startswith(NAME) & (x["asked"] != x["there"])))
    few_names = names * WORDS_PER_NAME <= F.greatest(F.col("n_words"), F.lit(WORDS_PER_NAME))
    other = replaced & F.exists("values", lambda x: x["asked"] != x["there"])
    k = F.when((F.col("equal") >= bound) & ~other, 0).when((F.col("held") >= bound) & replaced & few_names, 1).when(F.col("equal") >= bound, 0).otherwise(2)
    best = per.select(F.col("doc_id").alias("_d"), F.col("item").alias("_i"), k.alias("k")).groupBy("_d", "_i").agg(F.min("k").alias("k")).where("k < 2")
    out = candidates.join(best, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("item") == F.col("_i")))
    return out.drop("_d", "_i")


def drop_leaked(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with the columns of ``docs``."""
    rows, doc_id = numbered(docs), key(docs, doc_id)
    ids = materialize(leaks(rows, bench, doc_id, key(docs, text), short=True).select(F.col("doc_id").alias("_leaked")).distinct(), "bench-leaked")
    return rows.join(broadcast_if_small(ids, BROADCAST_IDS), F.col(doc_id).eqNullSafe(F.col("_leaked")), "left_anti").select(*rows.columns).toDF(*docs.columns)
