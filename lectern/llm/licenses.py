"""License scans by a positional index of rare words.

Templates are the notices of licences. Each is indexed by its words of the highest inverse document frequency, counted over
the whole corpus, with their positions. A place that has enough of a template's weight has one of its rarest words at least,
as the others together weigh too little: these lead to it. A file's leading words are looked up in the index; one that stands
at place p of the file and at place q of a template puts the template's beginning at p - q, and the postings of the
template's other words are intersected there, by relative position. What share of the template's weight stands is its score.
A template whose score suffices is a licence of the file if its mandatory key phrases stand within it.

The fixed phrases are found by the same index: their rarest word leads to every place where all of their words may stand.
Everything is DataFrame expressions. A file is judged in its own row, in time linear in its words; what reaches the driver
is one count for each word of the templates.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ascii_lower, text_of

# Fixed values of the contract: what parts words, and the phrases with their labels.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# Notices of common licences, and the phrases without which a text isn't one.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ["apache license version 2"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", ["gnu general public license"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file", ["mozilla public license v 2"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["released into the public domain"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights under CC0 1.0 Universal", ["public domain"]),
]

#: Positions of a template that are indexed.
INDEXED = 12
#: Least share of a template's weight, and how many words beyond its ends a key phrase may stand.
LEAST, SLACK = 0.6, 8


def words_of(text: Column) -> Column:
    """Array of the words, A-Z lower-cased. Only the first and the last piece of the split can be empty."""
    parts = F.split(ascii_lower(text), GAPS, -1)
    begin = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    end = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, begin + 1, F.size(parts) - begin - end)


def plain_words(text: str) -> list[str]:
    """words_of() of an ASCII text of our own."""
    return re.findall("[0-9a-z]+", text.lower())


def inverse_frequencies(files: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """For each word of the vocabulary ln(1 + (N + 1) / (n + 1)), with the n of N rows (words) that have it."""
    own = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    counted = files.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    n = {r["word"]: r["n"] for r in counted}
    return {w: math.log(1 + (n.get("", 0) + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


def _index(words: list[str], idf: dict[str, float]) -> list[tuple[str, int, float]]:
    """(word, position, weight) of the rarest words of a template, rarest first."""
    rarest = sorted(enumerate(words), key=lambda x: (-idf[x[1]], x[1], x[0]))
    return [(w, at, idf[w]) for at, w in rarest[:INDEXED]]


def _leading(found: list[tuple[str, int, float]]) -> int:
    """How many of the rarest postings lead: the others weigh less than LEAST of all."""
    rest = total = sum(x[2] for x in found)
    for k, (_, _, weight) in enumerate(found):
        if rest < LEAST * total * (1 - 1e-9):
            return k
        rest -= weight
    return len(found)


def _template(label: str, text: str, keys: list[str], idf: dict[str, float]) -> Column:
    found = _index(plain_words(text), idf)
    postings = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(at).alias("at"), F.lit(weight).alias("weight")) for w, at, weight in found])
    return F.struct(
        F.lit(label).alias("label"), postings.alias("postings"), F.lit(sum(x[2] for x in found)).alias("total"), F.lit(_leading(found)).alias("leading"), F.lit(len(plain_words(text))).alias("size"),
        F.array(*[F.lit(f" {k} ") for k in keys]).alias("keys"),
    )


def _places(word: Column | str) -> Column:
    """Where a word of the index stands in the file."""
    return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"])


def _phrase_places(phrase: list[str], idf: dict[str, float]) -> Column:
    """All places where the words of the phrase stand one after the other, found by its rarest word."""
    word, at, _ = _index(phrase, idf)[0]

    def whole(begin: Column) -> Column:
        held = F.lit(True)
        for k, w in enumerate(phrase):
            held = held & (F.get("words", begin + k) == w)
        return F.coalesce(held, F.lit(False))

    return F.filter(F.transform(_places(F.lit(word)), lambda p: p - at), whole)


def _best(template: Column) -> Column:
    """Struct (label, score, held) of a template in the file: its best score, and whether a place of enough has the key phrases.

    A score below LEAST is 0; no place is tried where the leading words that the file lacks rule out LEAST.
    """
    leads = F.slice(template["postings"], F.lit(1), template["leading"])
    absent = F.filter(leads, lambda x: ~F.array_contains("lookups", x["word"]))
    hopeless = F.aggregate(absent, F.lit(0.0), lambda acc, x: acc + x["weight"]) > (1 - LEAST + 1e-9) * template["total"]
    begins = F.array_distinct(F.flatten(F.transform(leads, lambda x: F.transform(_places(x["word"]), lambda p: p - x["at"]))))
    begins = F.when(hopeless, F.array().cast("array<int>")).otherwise(begins)

    def scored(begin: Column) -> Column:
        stands = lambda x: F.when(F.get("words", begin + x["at"]) == x["word"], x["weight"]).otherwise(0.0)
        return F.struct((F.aggregate(template["postings"], F.lit(0.0), lambda acc, x: acc + stands(x)) / template["total"]).alias("score"), begin.alias("begin"))

    def verified(s: Column) -> Column:
        begin = F.greatest(s["begin"] - SLACK, F.lit(0))
        window = F.concat(F.lit(" "), F.array_join(F.slice("words", begin + 1, template["size"] + 2 * SLACK), " "), F.lit(" "))
        return F.forall(template["keys"], lambda k: F.contains(window, k))

    # bound once: a lambda's argument is worked out before its body
    judged = lambda found: F.struct(
        template["label"].alias("label"),
        F.least(F.coalesce(F.array_max(found)["score"], F.lit(0.0)), F.lit(1.0)).alias("score"),
        F.exists(found, verified).alias("held"),
    )
    return F.get(F.transform(F.array(F.filter(F.transform(begins, scored), lambda s: s["score"] >= LEAST)), judged), F.lit(0))


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: list[tuple[str, str, list[str]]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, base (array of label, places), found (array of label, score, held).

    base has every place of the fixed phrases, found the templates' best scores and whether they are licences of the file.
    A null or empty text has no words and no licences; an empty table gives no rows; repeated rows give repeated results.
    Other columns are not read. Ties of frequency go by the word, then by its position. A very long text is one row: it takes
    a few steps for each of its words, and some dozen for each place that a leading word leads to.
    """
    files = docs.select(F.col(id_col).alias("doc_id"), words_of(text_of(text_col)).alias("words"))
    idf = inverse_frequencies(files, sorted({w for text in [t for _, t, _ in templates] + [p for _, p in phrases] for w in plain_words(text)}))
    leading = {_index(plain_words(p), idf)[0][0] for _, p in phrases}
    for _, t, _ in templates:
        found = _index(plain_words(t), idf)
        leading |= {w for w, _, _ in found[: _leading(found)]}
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted(leading)), F.struct(w.alias("word"), i.alias("at")))), lambda h: h.isNotNull())
    asked = files.select("doc_id", "words", at.alias("hits")).withColumn("lookups", F.array_distinct(F.transform("hits", lambda h: h["word"])))
    base = F.array(*[F.struct(F.lit(label).alias("label"), _phrase_places(plain_words(p), idf).alias("places")) for label, p in phrases])
    found = F.transform(F.array(*[_template(*t, idf) for t in templates]), _best)
    nothing = F.array().cast("array<struct<label:string,score:double,held:boolean>>")
    return asked.select("doc_id", F.size("words").cast("long").alias("n_words"), base.alias("base"), F.when(F.size("lookups") > 0, found).otherwise(nothing).alias("found"))


def license_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row, as scan_licenses() finds them.

    n_base counts the places of the fixed phrases, first_word and last_word are the least and the largest of them, null
    where there is none. score, to six decimals, is 1 where a phrase stands, else the best share of a template's weight, 0 below LEAST.
    """
    found = scan_licenses(docs, **options)
    places = F.flatten(F.transform("base", lambda b: b["places"]))
    base_labels = F.transform(F.filter("base", lambda b: F.size(b["places"]) > 0), lambda b: b["label"])
    labels = F.transform(F.filter("found", lambda t: t["held"]), lambda t: t["label"])
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    told = found.select("doc_id", "n_words", places.alias("places"), base_labels.alias("base_labels"), labels.alias("labels"), F.array_max(F.transform("found", lambda t: t["score"])).alias("best"))
    return told.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base_labels")).alias("base_labels"), joined(F.concat("base_labels", "labels")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.round(F.coalesce("best", F.lit(0.0)), 6)).alias("score"),
    )
