"""Licence scans by a positional index of rare words.

Each template, the wording of a licence or of its notice, is indexed by its
rarest words and their places, rarity being counted over all documents.  A
file's occurrences of those words are looked up in the index; each says where
in the file the template would begin.  Occurrences that agree on that place,
but for ``SLACK`` words put in or left out, are a candidate if they carry
``SHARE`` of the template's weight, and it stands if each of the template's
mandatory phrases is found where it should be.

Texts are read once, for the places of licence words and of phrases; the rest
works on that written table, a small part of the texts.  Phrases are compared
word by word beside their longest word, so no text is searched for them.

A word is a run of ASCII digits and letters and of characters beyond ASCII;
only A to Z are lower-cased.

Defined cases: a null or empty text has no words, no places and score 0; a very
long text is searched whole; rows that repeat, also under one doc_id, are
scanned each for itself; an empty table gives an empty result; a null doc_id
stays; other columns are ignored, whatever their names.  Equally rare words of
a template are taken in alphabetical order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import key, numbered
from quarry.storage import broadcast_if_small, let, materialize

#: Words of a template that the index holds, at most.
TOKENS = 12
#: A candidate's part of the template's weight.
SHARE = 0.6
#: Words by which the places of a copy may drift apart.
SLACK = 8
#: The score of a file that has a base phrase and no template.
BASE_SCORE = 0.5
#: Labels are broadcast up to this many files (about 100 bytes each), else joined by a shuffle.
BROADCAST_FILES = 200_000

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words that the index never holds: they stand in any English text.
COMMON = frozenset("a all an and any are as at be but by for from have in is it its may no not of on or other that the then these this to under was which with you your".split())


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("mit", "Released under the MIT License", ("the mit license",)),
    Template("mit", "Licensed under the MIT License", ("the mit license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted", "appear in all copies")),
    Template("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("used to endorse or promote products derived from this software",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "except in compliance with the license")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("terms of the gnu general public license", "either version 2 of the license")),
    Template("gpl-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("terms of the gnu general public license", "either version 3 of the license")),
    Template("gpl-2.0", "Licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "Licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("terms of the gnu lesser general public license",)),
    Template("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("terms of the gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0", "copy of the mpl was not distributed")),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse public license 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
    Template("zlib", "In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("permission is granted to anyone to use this software", "alter it and redistribute it freely")),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
)


def words_py(text: str) -> list[str]:
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w for w in re.split(SEPARATOR, text.translate(fold)) if w]


def words_of(text: Column) -> Column:
    """The words of ``text`` in their own case; none for null."""
    bare = F.rtrim(F.ltrim(F.coalesce(text, F.lit("")), F.lit(_SEPARATORS)), F.lit(_SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR, -1))


def _folded(word: Column) -> Column:
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measure(docs: DataFrame, phrases: list[list[str]], words: set[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, doc_id, n_words, hits (w, i) of ``words`` and spots (phrase, at), written; ``rid`` tells rows apart."""
    anchors = [max(p, key=len) for p in phrases]
    every = sorted(words | set(anchors))

    def body(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)))
        known = F.filter(places, lambda i: F.lower(F.get(w, i)).isin(every))
        # Lower case beyond ASCII may give letters of ASCII; such words are not meant.
        hits = F.filter(F.transform(known, lambda i: F.struct(_folded(F.get(w, i)).alias("w"), i.alias("i"))), lambda x: x["w"].isin(every))
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"), w.alias("w"))

    asked = F.array(*[F.struct(F.lit(n).alias("phrase"), F.lit(a).alias("anchor"), F.lit(p.index(a)).alias("offset"), F.array(*map(F.lit, p)).alias("words")) for n, (p, a) in enumerate(zip(phrases, anchors, strict=True))])

    def spots(m: Column) -> Column:
        at = F.filter(m["hits"], lambda x: x["w"].isin(sorted(set(anchors))))

        def stands(x: Column, p: Column) -> Column:
            start = x["i"] - p["offset"]
            return (p["anchor"] == x["w"]) & (start >= 0) & (F.transform(F.slice(m["w"], F.greatest(start, F.lit(0)) + 1, F.size(p["words"])), _folded) == p["words"])

        each = F.transform(at, lambda x: F.transform(F.filter(asked, lambda p: stands(x, p)), lambda p: F.struct(p["phrase"].alias("phrase"), (x["i"] - p["offset"]).alias("at"))))
        stored = F.filter(m["hits"], lambda x: x["w"].isin(sorted(words)))
        return F.struct(m["n_words"].alias("n_words"), stored.alias("hits"), F.flatten(each).alias("spots"))

    found = let(let(words_of(F.col(key(docs, text))), body), spots)
    # A generator, so that the columns of one row come from one evaluation.
    rows = numbered(docs).select(F.monotonically_increasing_id().alias("rid"), F.col(key(docs, doc_id)).alias("doc_id"), F.inline(F.array(found)))
    return materialize(rows, "license-words")


def index(table: DataFrame, templates: tuple[Template, ...], tokens: int = TOKENS) -> list[tuple[str, int, int, float]]:
    """(word, template, place, weight): each template by its ``tokens`` rarest words, weights of a template adding up to 1.

    Rarity is counted over all rows of ``table``; the driver gets a number for
    each word of the templates.
    """
    counted = table.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    df, n = dict(map(tuple, counted.collect())), table.count()
    out = []
    for k, t in enumerate(templates):
        words = words_py(t.text)
        idf = {w: log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in words if w not in COMMON}
        rare = set(sorted(idf, key=lambda w: (-idf[w], w))[:tokens])
        places = [(w, i) for i, w in enumerate(words) if w in rare]
        total = sum(idf[w] for w, _ in places)
        out += [(w, k, i, idf[w] / total) for w, i in places]
    return out


def copies(table: DataFrame, templates: tuple[Template, ...], phrases: list[list[str]], share: float = SHARE, slack: int = SLACK) -> DataFrame:
    """(rid, template, at, share) of the templates' copies in the files of :func:`measure`.

    Places that agree lie in a band of ``slack`` words; bands come twice,
    shifted by half, so that no copy is always cut.
    """
    spark = table.sparkSession
    posting = index(table, templates)
    indexed = sorted({w for w, *_ in posting})
    post = F.broadcast(spark.createDataFrame(posting, "w string, template int, place int, weight double"))
    hits = table.select("rid", F.explode(F.filter("hits", lambda x: x["w"].isin(indexed))).alias("x")).select("rid", "x.w", "x.i")
    shift = F.col("i") - F.col("place")
    ways = [F.struct(F.lit(k).alias("way"), F.floor((shift + d) / slack).alias("band")) for k, d in enumerate((0, slack // 2))]
    each = hits.join(post, "w").select("rid", "template", "place", "weight", shift.alias("shift"), F.explode(F.array(*ways)).alias("b"))
    copy = ["rid", "template", "b"]
    per_place = each.groupBy(*copy, "place").agg(F.max("weight").alias("weight"), F.min("shift").alias("lo"), F.max("shift").alias("hi"))
    found = per_place.groupBy(*copy).agg(F.sum("weight").alias("share"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("share") >= share - 1e-9)

    wanted = []
    for k, t in enumerate(templates):
        words = words_py(t.text)
        for p in map(words_py, t.phrases):
            place = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            wanted.append((k, phrases.index(p), place, len(t.phrases)))
    must = F.broadcast(spark.createDataFrame(wanted, "template int, phrase int, place int, n_phrases int"))
    spots = table.select("rid", F.explode("spots").alias("s")).select("rid", "s.phrase", "s.at")
    near = (F.col("at") - F.col("place")).between(F.col("lo") - slack, F.col("hi") + slack)
    held = found.join(must, "template").join(spots, ["rid", "phrase"]).where(near)
    whole = held.groupBy(*copy).agg(F.count_distinct("phrase").alias("n"), F.max("n_phrases").alias("n_phrases"), F.max("share").alias("share"), F.min("lo").alias("at"))
    return whole.where("n = n_phrases").select("rid", "template", F.greatest("at", F.lit(0)).alias("at"), F.least("share", F.lit(1.0)).alias("share"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Of each row doc_id, n_words, base (label, at), found (label, at, share) and score.

    ``base`` holds all places of the base phrases, ``found`` of each label the
    template's first best copy.
    """
    base = [words_py(p) for p in BASE]
    phrases = base + [p for p in dict.fromkeys(tuple(words_py(p)) for t in templates for p in t.phrases) if list(p) not in base]
    phrases = [list(p) for p in phrases]
    vocabulary = {w for t in templates for w in words_py(t.text)} - COMMON
    table = measure(docs, phrases, vocabulary, doc_id, text)
    label = reduce(lambda c, kt: c.when(F.col("template") == kt[0], kt[1].label), enumerate(templates), F.when(F.lit(False), ""))
    best = copies(table, templates, phrases).groupBy("rid", label.alias("label")).agg(F.min(F.struct((-F.col("share")).alias("less"), "at")).alias("b"))
    found = best.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("label", F.col("b.at").alias("at"), (-F.col("b.less")).alias("share")))).alias("found"))
    found = broadcast_if_small(materialize(found, "license-found"), BROADCAST_FILES)
    names = F.array(*map(F.lit, BASE.values()))
    places = F.transform(F.filter("spots", lambda s: s["phrase"] < len(BASE)), lambda s: F.struct(F.get(names, s["phrase"]).alias("label"), s["at"].cast("long").alias("at")))
    none = F.array().cast("array<struct<label:string,at:int,share:double>>")
    out = table.select("rid", "doc_id", "n_words", places.alias("base")).join(found, "rid", "left").withColumn("found", F.coalesce("found", none))
    top = F.array_max(F.transform("found", lambda x: x["share"]))
    score = F.greatest(F.coalesce(top, F.lit(0.0)), F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0))
    return out.select("doc_id", "n_words", "base", "found", score.alias("score"))
