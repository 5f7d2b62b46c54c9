"""License scan: a positional rare-token index over license templates, in DataFrame functions only.

A text's words are compared with templates in three steps. (1) Document frequencies of all words of key phrases are counted
over the whole corpus; each template is looked up by the ``min_votes`` words of its own key phrase with the highest IDF, so no
template's look-up depends on another's. A match has the whole phrase, so these words find every match, whatever else the text holds. (2) Every place of such a word votes for (template, place - position in the template): the postings of several words are intersected by
relative position. (3) At each place voted for by enough words each of the template's mandatory phrases must stand word
for word, and half of the template's words must stand in their positions.

Defined cases: a null text is empty: no words, no labels, score 0; repeated rows get equal results; ties between words
of equal IDF go to the smaller word; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words: every ASCII character but digits and letters.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    """``text``: the notice in lower-case words; ``phrases``: what must stand in it word for word, the key phrase first."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def places(self) -> list[tuple[int, list[str]]]:
        """Where each phrase stands in the notice, and its words."""
        words, found = self.words, []
        for phrase in self.phrases:
            own = phrase.split()
            found.append((next(i for i in range(len(words)) if words[i : i + len(own)] == own), own))
        return found


def _gnu(name: str, version: str) -> str:
    """The notice that files under a GNU license carry."""
    return (
        f"you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version"
        f" this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details"
    )


def _gnu_phrases(name: str, version: str) -> tuple[str, ...]:
    return (f"gnu {name} as published by the free software foundation", f"either version {version} of the license")


GPL, LGPL, AGPL = "general public license", "lesser general public license", "affero general public license"

# Short notices, then the standard ones in full.
TEMPLATES = (
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify and or distribute",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("mpl-2", "licensed under the mozilla public license 2 0", ("mozilla public license 2 0",)),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
        ("you may not use this file except in compliance with the license", "apache license version 2 0"),
    ),
    Template(
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness"
        " for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
        ("provided by the copyright holders and contributors as is", "for a particular purpose are disclaimed"),
    ),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work", ("has waived all copyright and related or neighboring rights",)),
    Template("gpl-2", _gnu(GPL, "2"), _gnu_phrases(GPL, "2")),
    Template("gpl-3", _gnu(GPL, "3"), _gnu_phrases(GPL, "3")),
    Template("lgpl-2.1", _gnu(LGPL, "2 1"), _gnu_phrases(LGPL, "2 1")),
    Template("lgpl-3", _gnu(LGPL, "3"), _gnu_phrases(LGPL, "3")),
    Template("agpl-3", _gnu(AGPL, "3"), _gnu_phrases(AGPL, "3")),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including"
        " without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("to deal in the software without restriction", "permission notice shall be included in all copies or substantial portions of the software"),
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("source code form is subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"
        " for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software released into the public domain", "commercial or non commercial and by any means"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted"
        " to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("in no event will the authors be held liable", "to alter it and redistribute it freely"),
    ),
)


def normal(text: Column) -> Column:
    """Lower-case (A-Z only) words joined by one space; null is empty."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, SEPARATORS, " "))


def _starts(core: Column, words: Column, phrase: str) -> Column:
    """Word numbers at which ``phrase`` stands, in order: one pass over the words of a text that holds it."""
    parts = phrase.split()
    wanted = F.array(*[F.lit(w) for w in parts])
    first = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    found = F.transform(F.filter(first, lambda i: F.slice(words, i + 1, F.lit(len(parts))) == wanted), lambda i: i.cast("long"))
    padded = F.concat(F.lit(" "), core, F.lit(" "))
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), found).otherwise(F.expr("cast(array() as array<bigint>)"))


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Documents with each word of the (small) vocabulary, and all documents."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = words.select(F.explode_outer(F.array_append(F.array_intersect("__words", known), F.lit(""))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a word
    return counts, counts.pop("", 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, min_votes: int = 2, min_share: float = 0.5) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches."""
    cores = docs.select(F.col(id_col).alias("__id"), normal(F.col(text_col)).alias("__core"))
    split = cores.select("__id", "__core", F.when(F.col("__core") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("__core", " ", -1)).alias("__words"))
    vocabulary = sorted({w for t in templates for w in t.places[0][1]})
    counts, total = document_frequencies(split, vocabulary)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}
    ranked = sorted(vocabulary, key=lambda w: (-idf[w], w))  # highest IDF first
    quoted = lambda w: "'" + w + "'"  # noqa: E731  words are ASCII letters and digits
    listing = lambda words: "array(" + ", ".join(map(quoted, words)) + ")"
    rank = {w: i for i, w in enumerate(ranked)}
    chosen: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        at, phrase = t.places[0]
        for w in sorted(set(phrase), key=rank.get)[:min_votes]:
            chosen.setdefault(w, []).extend((k, at + p) for p, x in enumerate(phrase) if x == w)
    votes = "map(" + ", ".join(f"{quoted(w)}, array(" + ", ".join(f"struct({k} as t, {p} as p)" for k, p in found) + ")" for w, found in chosen.items()) + ")"
    known = listing(chosen)
    listed = "array(" + ", ".join(
        f"struct({quoted(t.label)} as label, {listing(t.words)} as words, {t.places[0][0]} as at, array(" + ", ".join(f"struct({at} as at, {listing(phrase)} as words)" for at, phrase in t.places) + ") as phrases)"
        for t in templates
    ) + ")"
    # a phrase with fewer different words than min_votes can't get so many
    need = f"{min_votes}"
    # the words to look up that a text holds
    looked = split.withColumn("__keys", F.expr(f"array_intersect(__words, {known})"))
    voted = looked.withColumn(
        "__votes",
        F.expr(
            f"if(size(__keys) < {need}, cast(array() as array<struct<t:int,o:int>>), flatten(transform(filter(transform(__words, (w, i) -> struct(w as w, i as i)), x -> array_contains(__keys, x.w)),"
            f" x -> transform({votes}[x.w], v -> struct(v.t as t, x.i - v.p as o)))))"
        ),
    )
    # postings intersected by relative position: runs of equal (template, offset) in the sorted votes
    aligned = voted.withColumn("__sorted", F.expr("array_sort(__votes)")).withColumn(
        "__places",
        F.expr(f"filter(__sorted, (x, i) -> i + 1 >= {need} and __sorted[i - {min_votes - 1}] = x and (i + 1 = size(__sorted) or __sorted[i + 1] != x))"),
    )
    verified = aligned.withColumn(
        "__matches",
        F.expr(
            f"if(size(__places) = 0, cast(array() as array<struct<label:string,word:int,share:double>>), filter(transform(__places, x -> struct({listed}[x.t].label as label, x.o + {listed}[x.t].at as word,"
            f" if(forall({listed}[x.t].phrases, p -> x.o + p.at >= 0 and slice(__words, greatest(x.o + p.at, 0) + 1, size(p.words)) = p.words),"
            f" size(filter({listed}[x.t].words, (w, j) -> x.o + j >= 0 and x.o + j < size(__words) and __words[x.o + j] = w)) / cast(size({listed}[x.t].words) as double), 0D) as share)), x -> x.share >= {min_share}))"
        ),
    )
    base = verified.withColumns({f"__b{i}": _starts(F.col("__core"), F.col("__words"), phrase) for i, phrase in enumerate(BASE)})
    places = F.concat(*[F.col(f"__b{i}") for i in range(len(BASE))])
    base_labels = F.filter(F.array(*[F.when(F.size(f"__b{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values())]), lambda x: x.isNotNull())
    return base.withColumn("__base", places).withColumn("__labels", base_labels).select(
        F.col("__id").alias(id_col),
        F.size("__words").cast("long").alias("n_words"),
        F.size("__base").cast("long").alias("n_base"),
        F.array_min("__base").alias("first_word"),
        F.array_max("__base").alias("last_word"),
        F.array_join(F.array_sort("__labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__labels", F.expr("transform(__matches, x -> x.label)"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.expr("transform(__matches, x -> x.share)")), F.when(F.size("__labels") > 0, F.lit(min_share)).otherwise(F.lit(0.0))).alias("score"),
        F.col("__matches").alias("matches"),
    )
