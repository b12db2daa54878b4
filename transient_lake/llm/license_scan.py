"""License scans: a positional rare-token index, DataFrame functions only.

Licence texts and notices (``TEMPLATES``) form a small positional index: each
of their words has postings (template, position).  A file is scanned so:

1. document frequencies of the licence words are counted over all files, which
   orders them by IDF (ties by the word);
2. a file that lacks a word of the mandatory key phrases of every template is
   done.  Of the others, the ``RARE`` licence words of highest IDF that the
   file holds are looked up in the index;
3. an occurrence at word p and a posting at word q of template t say that t
   begins at word p - q.  Postings are intersected by this relative position:
   a beginning needs ``VOTES`` of the file's rare words in their places (all of
   them where a template has fewer);
4. at a beginning that is left, every mandatory key phrase of the template must
   stand within ``SLACK`` words of its place.

A verified template gives its label; its share is the number of its words in
their very places over its length, and the score of a file is the best share
(0 without a verified template).  Beside the index every place of the base
phrases is counted, whose labels are always given.

The index and the order of its words are bounded by the templates (some
hundred words), whatever the corpus; nothing but their counts is shuffled, and
every step on a file runs inside its row, linear in its words.

Words are runs of 0-9, a-z (A-Z in lower case) and any character above U+007F.

Defined results: null and empty texts have no words, no labels (empty string)
and null places; very long texts are scanned whole; repeated rows and ids give
a row each; an empty table gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

RARE = 12
VOTES = 3
SLACK = 6

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose every place counts, with their labels.  Fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """A licence text or notice; every key phrase must stand near its place."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return split_words(self.text)

    @property
    def key_places(self) -> list[tuple[int, list[str]]]:
        """(place, words) of the key phrases."""
        own, out = self.words, []
        for key in self.keys:
            k = split_words(key)
            out.append((next(i for i in range(len(own)) if own[i:i + len(k)] == k), k))
        return out


def split_words(text: str) -> list[str]:
    return re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


#: Wording of public licences and of the usual notices.  Fixed values.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("under the mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the Software), to deal in the Software without restriction, including "
             "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
             "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
             "following conditions",
             ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
             "in compliance with the License. You may obtain a copy of the License at",
             ("apache license version 2 0", "except in compliance with the license")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
             ("gnu general public license version 3",)),
    Template("gpl-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software "
             "Foundation, either version 3 of the License, or (at your option) any later version",
             ("gnu general public license", "either version 3 of the license", "any later version")),
    Template("gpl-2.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software "
             "Foundation; either version 2 of the License, or (at your option) any later version",
             ("gnu general public license", "either version 2 of the license", "any later version")),
    Template("lgpl-2.1-or-later", "it under the terms of the GNU Lesser General Public License as published by the Free "
             "Software Foundation; either version 2.1 of the License, or (at your option) any later version",
             ("gnu lesser general public license", "either version 2 1 of the license")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license v 2 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution 4 0 international",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
             ("for any purpose with or without fee is hereby granted",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("unencumbered software released into the public domain",)),
)

#: A beginning is coded as template * _T + word + _BEFORE.
_T, _BEFORE = 1 << 40, 1 << 10


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def index_words(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def by_idf(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    """Licence words by falling IDF over all rows of ``docs``, ties by word
    (as many as the index has, whatever the corpus)."""
    own = index_words(templates)
    held = docs.select(F.explode(F.array_intersect(_strings(own), words(F.col(text)))).alias("w"))
    df = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(own, key=lambda w: (df.get(w, 0), w))


def _all_at(ws: Column, start: Column, phrase: list[str]) -> Column:
    """The phrase's words stand one after another from ``start`` on (null: outside)."""
    at = F.get(ws, start) == phrase[0]
    for j, w in enumerate(phrase[1:], 1):
        at &= F.get(ws, start + j) == w
    return at


def phrase_places(ws: Column, phrase: str) -> Column:
    """Word numbers at which a phrase stands."""
    own = split_words(phrase)
    present = F.array_contains(ws, own[-1])
    for w in own[:-1]:
        present &= F.array_contains(ws, w)
    some = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.coalesce(_all_at(ws, i, own), F.lit(False)))
    return F.when(present, some).otherwise(F.array().cast("array<int>"))


def _holds(held: Column, template: Template) -> Column:
    """All words of the template's key phrases are among the file's licence words."""
    need = sorted({w for _, k in template.key_places for w in k})
    return F.size(F.array_except(_strings(need), held)) == 0


def _verified(ws: Column, rare: Column, start: Column, template: Template, votes: int, slack: int) -> Column:
    """Share of the template's words in place, or null if it is not verified
    to begin at word ``start``."""
    own = template.words
    first = {w: i for i, w in reversed(list(enumerate(own)))}
    place = F.create_map(*[x for w, i in first.items() for x in (F.lit(w), F.lit(i))])
    known = F.filter(rare, lambda w: F.map_contains_key(place, w))
    voted = F.size(F.filter(known, lambda w: F.coalesce(F.get(ws, start + place[w]) == w, F.lit(False))))
    enough = (voted >= votes) | (voted == F.size(known))
    def near(at: int, key: list[str]) -> Column:
        around = F.sequence(start + (at - slack), start + (at + slack))
        return F.exists(around, lambda i: F.coalesce((i >= 0) & _all_at(ws, i, key), F.lit(False)))

    for at, key in template.key_places:
        enough &= near(at, key)
    in_place = F.size(F.filter(F.sequence(F.lit(0), F.lit(len(own) - 1)), lambda i: F.coalesce(
        (start + i >= 0) & (F.get(ws, start + i) == F.get(_strings(own), i)), F.lit(False))))
    return F.when(enough, in_place / F.lit(float(len(own))))


def beginnings(ws: Column, rare: Column, templates: tuple[Template, ...]) -> Column:
    """Distinct coded beginnings that the file's rare words point to."""
    postings: dict[str, list[int]] = {}
    for t, template in enumerate(templates):
        for q, w in enumerate(template.words):
            postings.setdefault(w, []).append(t * _T + _BEFORE - q)
    index = F.create_map(*[x for w, p in postings.items() for x in (F.lit(w), F.array(*[F.lit(v).cast("long") for v in p]))])
    rare_index = F.map_filter(index, lambda w, _: F.array_contains(rare, w))
    hits = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(rare, h["w"]))
    return let(rare_index, lambda m: F.array_distinct(F.flatten(F.transform(
        hits, lambda h: F.transform(m[h["w"]], lambda v: v + h["i"])))))


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES,
         base: tuple[tuple[str, str], ...] = BASE, order: list[str] | None = None, rare: int = RARE, votes: int = VOTES,
         slack: int = SLACK) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels,
    labels and score.  ``order``: licence words by falling IDF, counted over
    ``docs`` if not given."""
    order = order if order is not None else by_idf(docs, text, templates)
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def possible(held: Column) -> Column:
        some = _holds(held, templates[0])
        for t in templates[1:]:
            some |= _holds(held, t)
        return some

    def judged(ws: Column) -> Column:
        places = F.array(*[phrase_places(ws, p) for p, _ in base])
        none = F.array().cast("array<struct<label:string,share:double>>")

        def verified(rares: Column) -> Column:
            def check(code: Column) -> Column:
                start = (F.pmod(code, F.lit(_T)) - _BEFORE).cast("int")
                number = F.shiftright(code, 40).cast("int")
                label, share = F.lit(None).cast("string"), F.lit(None).cast("double")
                for i, t in enumerate(templates):  # only the branch of the template at hand is evaluated
                    label = F.when(number == i, F.lit(t.label)).otherwise(label)
                    share = F.when(number == i, _verified(ws, rares, start, t, votes, slack)).otherwise(share)
                return F.struct(label.alias("label"), share.alias("share"))

            return F.filter(F.transform(beginnings(ws, rares, templates), check), lambda x: x["share"].isNotNull())

        found = let(F.array_intersect(_strings(order), ws), lambda held: F.when(
            possible(held), let(F.slice(held, 1, rare), verified)).otherwise(none))
        return let(F.struct(places.alias("places"), found.alias("found")), lambda x: F.struct(
            F.size(ws).cast("long").alias("n_words"), F.flatten(x["places"]).alias("all"),
            F.array_compact(F.array(*[F.when(F.size(x["places"][i]) > 0, F.lit(label)) for i, (_, label) in enumerate(base)]))
            .alias("base"), F.transform(x["found"], lambda y: y["label"]).alias("own"),
            F.coalesce(F.array_max(F.transform(x["found"], lambda y: y["share"])), F.lit(0.0)).alias("score")))

    joined = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    s = F.col("_s")
    return (docs.drop(*new).withColumn("_s", let(words(F.col(text)), judged)).withColumns({
        "n_words": s["n_words"], "n_base": F.size(s["all"]).cast("long"),
        "first_word": F.array_min(s["all"]).cast("long"), "last_word": F.array_max(s["all"]).cast("long"),
        "base_labels": joined(s["base"]), "labels": joined(F.concat(s["base"], s["own"])), "score": s["score"]}).drop("_s"))
