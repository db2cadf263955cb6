"""License scans with a positional rare-token index (DataFrame operations only).

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A template is a run of words with
a mandatory key phrase in it. The corpus gives each template word its IDF; the index has the places of the words of
highest IDF of every key phrase: word -> (template, place). A file's own licence words of highest IDF are looked up:
of each template the rarest words that the file has, ``anchors`` of them. Each place of such a word gives the start that
the template would have, and the starts of the anchors are intersected: a start stays when all anchors stand at their
relative positions. It counts when the key phrase stands there word by word; its score is the IDF-weighted share of the
template's words found at their places. A key phrase whose anchors are not all in a file cannot stand there.

Words are cut twice, for the IDF and for the search: a corpus of tables of words would take more to write than to cut.

The three base phrases are templates that are their own key phrase. Defined results: a null or empty text has no
words, no places, empty labels and score 0; repeated rows are scanned alike; all places count, overlapping ones too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Own templates: label, words, key phrase.
TEMPLATES = (
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("all-rights-reserved", "copyright holder all rights reserved", "all rights reserved"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("apache-2-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("artistic-2", "licensed under the artistic license 2 0", "artistic license 2 0"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "you can do whatever you want with this stuff"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("bsd-3-name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives license", "attribution noncommercial noderivatives"),
    ("cc-by-sa-text", "creative commons attribution sharealike license", "attribution sharealike"),
    ("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("eupl", "licensed under the european union public licence", "european union public licence"),
    ("gfdl", "under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("gpl-later", "either version 3 of the license or at your option any later version", "or at your option any later version"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied", "without warranty of any kind express or implied"),
    ("ofl", "licensed under the sil open font license version 1 1", "sil open font license"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", "unauthorized copying of this file"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
    ("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_at: int
    key: tuple[str, ...]
    base: bool

    @staticmethod
    def of(label: str, words: str, key: str, base: bool = False) -> Template:
        w, k = tuple(words.split()), tuple(key.split())
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        return Template(label, w, at, k, base)


@dataclass(frozen=True)
class Settings:
    """``anchors``: index words of a template; ``least``: share of a template's IDF weight that must be in place."""

    templates: tuple[Template, ...] = field(default_factory=lambda: (*(Template.of(label, p, p, True) for p, label in BASE), *(Template.of(*t) for t in TEMPLATES)))
    anchors: int = 2
    least: float = 0.6


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def idf(documents: DataFrame, settings: Settings) -> dict[str, float]:
    """IDF of the template words over all documents: ln((documents + 1) / (documents with the word + 1))."""
    vocabulary = sorted({w for t in settings.templates for w in t.words})
    own = F.array_intersect(words_of(documents["text"]), F.array(*map(F.lit, vocabulary)))
    counted = documents.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counted.collect()}  # one row a vocabulary word, a fixed list
    import math

    total = found.get("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


def index(weights: dict[str, float], settings: Settings) -> list[list[tuple[str, int]]]:
    """Postings of each template: its anchors (word, place), the words of highest IDF of the key phrase, each at its first place there."""
    out = []
    for t in settings.templates:
        rare = sorted(set(t.key), key=lambda w: (-weights[w], w))[: settings.anchors]
        out.append([(w, t.key_at + t.key.index(w)) for w in rare])
    return out


def with_licenses(documents: DataFrame, settings: Settings = Settings(), name: str = "licenses") -> DataFrame:
    """``documents`` plus ``n_words`` and the array of matches: label, base, start (of the key phrase), score."""
    weights = idf(documents, settings)
    postings = index(weights, settings)
    anchors = sorted({w for own in postings for w, _ in own})
    table = F.array(*[
        F.struct(
            F.lit(number).alias("t"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.key_at).alias("key_at"), F.array(*map(F.lit, t.key)).alias("key"), F.array(*map(F.lit, t.words)).alias("words"),
            F.array(*[F.lit(weights[w]) for w in t.words]).alias("weights"), F.lit(sum(weights[w] for w in t.words)).alias("whole"),
            F.array(*[F.struct(F.lit(w).alias("word"), F.lit(place).alias("place")) for w, place in own]).alias("anchors"),
        ) for number, (t, own) in enumerate(zip(settings.templates, postings, strict=True))
    ])
    own = [c for c in documents.columns if c not in ("n_words", name)]
    base = documents.select(F.struct(F.lit(0).alias("__"), *[documents[c] for c in own]).alias("row"), words_of(documents["text"]).alias("w"))
    # the file's licence words with their positions
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(*anchors))
    at = F.when(F.arrays_overlap("w", F.array(*map(F.lit, anchors))), places).otherwise(F.array().cast("array<struct<x:string,i:int>>"))
    has = F.array_distinct(F.transform("at", lambda s: s["x"]))

    def starts_of(t: Column) -> Column:
        """Starts on which all anchors of a template agree."""
        each = F.transform(t["anchors"], lambda a: F.transform(F.filter("at", lambda s: s["x"] == a["word"]), lambda s: s["i"] - a["place"]))
        agreed = F.aggregate(F.slice(each, 2, settings.anchors), each[0], lambda x, y: F.array_intersect(x, y))
        return F.transform(F.array_distinct(agreed), lambda s: F.struct(t["t"].alias("t"), s.alias("start")))

    able = F.filter(table, lambda t: F.forall(t["anchors"], lambda a: F.array_contains(F.col("has"), a["word"])))
    starts = F.flatten(F.transform(able, starts_of))

    def match(c: Column) -> Column:
        t = table[c["t"]]
        key = c["start"] + t["key_at"]
        in_place = F.aggregate(
            F.transform(t["words"], lambda word, j: F.when(F.get(F.col("w"), F.when(c["start"] + j >= 0, c["start"] + j).otherwise(F.lit(1 << 30))) == word, t["weights"][j]).otherwise(0.0)),
            F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)),
        )
        score = F.when(t["base"] | (t["whole"] <= 0), 1.0).otherwise(F.round(F.least(F.lit(1.0), in_place / t["whole"]), 6))
        good = F.when(key < 0, False).otherwise(F.slice(F.col("w"), F.greatest(key, F.lit(0)) + 1, F.size(t["key"])) == t["key"])
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), key.alias("start"), score.alias("score"), good.alias("good"))

    found = F.filter(F.transform("starts", match), lambda m: m["good"] & (m["score"] >= settings.least))
    out = base.select("row", "w", at.alias("at")).select("row", "w", "at", has.alias("has")).select("row", "w", starts.alias("starts")).select("row", F.size("w").cast("long").alias("n_words"), found.alias(name))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "n_words", name)
