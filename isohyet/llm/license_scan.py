"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import body, short_batches, store

# Wording of common notices and headers.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "ISC": ["Licensed under the ISC License."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Headers by licence identifier, which is the licence's name here.
HEADER = "SPDX-License-Identifier: {}"
#: Every template holds a term that begins so; a text without any shares too little with all of them to count.
CUES = ("licen", "permission", "permitted", "redistribut", "public", "mozilla", "spdx")
HAS_CUE = r"(?i)licen[cs]|permission|permitted|redistribut|public|mozilla|spdx"
NOT_TERM = r"[^\p{L}\p{N}]+"
TERM = regex.compile(r"[\p{L}\p{N}]+")
#: Ends of lines, paragraphs and sentences.
CUTS = [regex.compile(r"\n"), regex.compile(r"\n\s*\n"), regex.compile(r"(?<=[.!?;])\s+|\n")]
LEAST_COSINE = 0.7
#: Templates of at most so many terms name their licence by few words, which a passage must all hold.
SHORT = 20
#: Terms in at least this share of all documents weigh by their own frequency; there are at most as many of them as
#: documents have different terms on average, divided by this share.
COMMON = 0.01
#: A file speaks for its directory if so named, or if so much of its words is the notice.
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
FILE_SHARE = 0.5


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_TERM), "")


def _plain_terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def template_terms() -> list[tuple[str, list[str]]]:
    """(licence, terms) of every template and identifier header."""
    return [(licence, _plain_terms(x)) for licence, texts in TEMPLATES.items() for x in (*texts, HEADER.format(licence))]


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, float], float]:
    """Smoothed inverse document frequency of template terms and common terms over the whole corpus, and that of other terms.

    Rare terms outside the templates weigh as if no document had them, so they only lower a similarity.
    """
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in template_terms() for t in terms})
    known = F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "term string").withColumn("known", F.lit(True)))
    n = docs.count()
    held = docs.select(F.explode(F.array_distinct(_terms(body(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = held.filter(F.col("n") >= COMMON * n).select("term", "n").unionByName(held.join(known, "term").select("term", "n"))
    weight = lambda df: math.log((n + 1.0) / (df + 1.0)) + 1.0
    return dict.fromkeys(vocabulary, weight(0)) | {r["term"]: weight(r["n"]) for r in counted.collect()}, weight(0)


class Matcher:
    """Cosine of the passages of a text with the templates.

    A passage is a line, paragraph or sentence with a cue, or a run of terms as long as a template and laid on it
    so that a cue of the text meets the same cue of the template. All passages of the whole text are compared, in
    time linear in its length.
    """

    def __init__(self, weights: dict[str, float], other: float) -> None:
        self.weights, self.other, self.templates = weights, other, []
        all_terms = template_terms()
        for licence, terms in all_terms:
            foreign = {t for name, ts in all_terms if name != licence for t in ts}
            tf = Counter(terms)
            norm = math.sqrt(sum((c * weights[t]) ** 2 for t, c in tf.items()))
            vector = {t: c * weights[t] / norm for t, c in tf.items()}
            named = {t for t in tf if t.isdigit() or t not in foreign} if len(terms) <= SHORT else set()
            self.templates.append((licence, len(terms), vector, named))
        #: Cue term -> (template, its place there).
        self.places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, terms) in enumerate(all_terms):
            for i, t in enumerate(terms):
                if t.startswith(CUES):
                    self.places.setdefault(t, []).append((k, i))
        self.reach = max(len(terms) for _, terms in all_terms)

    def cosine(self, tf: Counter[str], vector: dict[str, float]) -> float:
        own = {t: c * self.weights.get(t, self.other) for t, c in tf.items()}
        norm = math.sqrt(sum(w * w for w in own.values()))
        return round(sum(w * own[t] for t, w in vector.items() if t in own) / norm, 9)

    def hopeful(self, terms: Collection[str], k: int) -> bool:
        """Whether a passage of these terms may reach LEAST_COSINE, by the Cauchy-Schwarz bound."""
        _, _, vector, named = self.templates[k]
        return all(t in terms for t in named) and sum(w * w for t, w in vector.items() if t in terms) >= LEAST_COSINE**2

    def _better(self, best: tuple | None, tf: Counter[str], k: int, size: int) -> tuple | None:
        licence, _, vector, _ = self.templates[k]
        if self.hopeful(tf, k):
            found = (-self.cosine(tf, vector), licence, -size)
            if -found[0] >= LEAST_COSINE and (best is None or found < best):
                return found
        return best

    def best(self, text: str) -> tuple[str, float, float] | None:
        """Licence, cosine and share of the text's terms in its best passage; ties go to the first licence by name, then the longest passage."""
        best, seen = None, set()
        for cut in CUTS:
            for passage in cut.split(text):
                terms = _plain_terms(passage)
                if any(t.startswith(CUES) for t in terms):
                    tf = Counter(terms)
                    for k in range(len(self.templates)):
                        best = self._better(best, tf, k, len(terms))
        terms = _plain_terms(text)
        for p, term in enumerate(terms):
            if term not in self.places:
                continue
            around = tuple(terms[max(0, p - self.reach) : p + self.reach])
            if (context := (hash(around), min(p, self.reach))) in seen:
                continue
            seen.add(context)
            near = set(around)
            for k, place in self.places[term]:
                start, length = max(0, p - place), self.templates[k][1]
                if self.hopeful(near, k):
                    window = terms[start : p - place + length]
                    best = self._better(best, Counter(window), k, len(window))
        return best and (best[1], -best[0], -best[2] / len(terms))


def notices(docs: DataFrame, text_col: str = "text") -> Column:
    """Licence, cosine and share of its words in the best passage of a row's whole text; null without a notice.

    Each text is read where it lies; only the weights, of bounded number, go to the tasks.
    """
    weights, other = inverse_frequencies(docs, text_col)
    short_batches(docs.sparkSession)

    @F.pandas_udf("licence string, cosine double, share double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(weights, other)
        for texts in batches:
            found = [matcher.best(t) if t else None for t in texts]
            yield pd.DataFrame([f or (None, None, None) for f in found], columns=["licence", "cosine", "share"])

    text = F.col(text_col)
    return scored(F.when(text.rlike(HAS_CUE), text))


def _parent(path: Column) -> Column:
    """The directory of a path, "" for the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: path, licence, cosine, origin (own, inherited or null), from_path and the columns of `carry`.

    A file's own notice counts first. Else the nearest directory above it that holds a licence file gives its
    licence: a file with a notice and such a name, or one that mostly is the notice; of several, the one with the
    largest cosine, then the smallest path. Texts of any length are read whole. Null text counts as empty; a null
    path is in no directory; rows that repeat are decided alike; without notices all licences are null; no rows give no rows.
    """
    extra = {f"__c_{k}": v for k, v in (carry or {}).items()}
    rows = files.select(F.col(path_col).alias("path"), notices(files, text_col).alias("__found"), *[v.alias(k) for k, v in extra.items()])
    rows = store(rows.select("path", "__found.*", *extra), "license_rows")
    name = F.element_at(F.split("path", "/"), -1)
    speaks = rows.filter(F.col("licence").isNotNull() & F.col("path").isNotNull() & (name.rlike(FILE_NAME) | (F.col("share") >= FILE_SHARE)))
    chosen = F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence"))
    spoken = speaks.groupBy(_parent(F.col("path")).alias("dir")).agg(chosen.alias("s"))
    spoken = store(spoken.select("dir", F.struct(F.col("s.licence").alias("licence"), (-F.col("s.c")).alias("cosine"), F.col("s.path").alias("path")).alias("s")), "license_dirs")
    # Directories are resolved once each: joined with all their ancestors, the deepest one found stays.
    dirs = rows.filter("path is not null").select(_parent(F.col("path")).alias("home")).distinct()
    parts = F.split("home", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    steps = dirs.select("home", F.posexplode(F.array_distinct(above)).alias("depth", "dir"))
    near = steps.join(spoken, "dir").groupBy("home").agg(F.max(F.struct("depth", "s")).alias("n")).select("home", F.col("n.s").alias("s"))
    near = store(near, "license_near")
    out = rows.withColumn("home", _parent(F.col("path"))).join(near, "home", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        "path", F.coalesce("licence", "s.licence").alias("licence"), F.coalesce("cosine", "s.cosine").alias("cosine"),
        F.when(own, "own").when(F.col("s").isNotNull(), "inherited").alias("origin"), F.when(own, F.col("path")).otherwise(F.col("s.path")).alias("from_path"),
        *[F.col(k).alias(k[4:]) for k in extra],
    )
