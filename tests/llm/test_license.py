"""Licence notices: wordings inside longer lines, headers, what is none, and a brute-force version."""

import random
from collections import Counter

import pytest
from corpus_cases import LONG

from isohyet.llm.license_scan import CUES, LEAST_COSINE, Matcher, inverse_frequencies, license_scan, template_terms

FOUND = {
    "Copyright (c) 2020 Jane Doe. Licensed under the MIT License.": "MIT",
    "This project is released under the MIT License. See the file for details.": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "// SPDX-License-Identifier: GPL-3.0-only\nint main;": "GPL-3.0",
    "some words that come first, then licensed under CC BY-NC 4.0 and then some more words that stand in the same long line": "CC-BY-NC-4.0",
    "x " * 20_000 + "SPDX-License-Identifier: MIT " + "y " * 20_000: "MIT", "spdx-license-identifier: LGPL-3.0": "LGPL-3.0",
    "head\n\nThis work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
}
NONE = [
    "the license of this program is discussed at great length elsewhere in the manual", "SPDX-License-Identifier: Zlib", "", None,
    "Licensed under the Frobnicate License.", "the public may license what it likes under version 3", "licence " * 3000, LONG,
]


@pytest.fixture(scope="module")
def weights(docs):
    return inverse_frequencies(docs)


def test_wordings(spark, docs):
    from pyspark.sql import functions as F

    texts = [*FOUND, *NONE]
    planted = spark.createDataFrame([(f"{i}/f", t) for i, t in enumerate(texts)], "path string, text string")
    corpus = docs.select(F.concat_ws("/", F.lit("docs"), "source", "doc_id").alias("path"), "text")
    got = {r["path"]: r["licence"] for r in license_scan(planted.unionByName(corpus)).filter("path not like 'docs%'").collect()}
    assert [got[f"{i}/f"] for i in range(len(texts))] == [*FOUND.values(), *[None] * len(NONE)]


def test_runs_against_all_windows(weights):
    """The best passage is at least as near as every run of a template's length that is laid on a cue."""
    matcher, rng = Matcher(*weights), random.Random(5)
    pool = [t for _, ts in template_terms() for t in ts] + ["alpha", "beta", "gamma"]
    for _ in range(60):
        _, base = rng.choice(template_terms())
        terms = [rng.choice(pool) if rng.random() < 0.1 else t for t in base]
        terms = rng.choices(pool, k=rng.randint(0, 9)) + terms + rng.choices(pool, k=rng.randint(0, 9))
        best = None
        for k, (licence, size, vector, named) in enumerate(matcher.templates):
            own = template_terms()[k][1]
            for start in range(-size + 1, len(terms)):
                window = terms[max(0, start) : start + size]
                laid = any(0 <= start + i < len(terms) and terms[start + i] == t and t.startswith(CUES) for i, t in enumerate(own))
                if laid and named <= set(window):
                    cosine = matcher.cosine(Counter(window), vector)
                    if cosine >= LEAST_COSINE and (best is None or (-cosine, licence) < best):
                        best = (-cosine, licence)
        whole = [(-matcher.cosine(Counter(terms), v), name) for name, _, v, named in matcher.templates if named <= set(terms)]
        best = min([x for x in [best, *whole] if x and -x[0] >= LEAST_COSINE], default=None)
        got = matcher.best(" ".join(terms))
        assert (got and (-got[1], got[0])) == best


def test_hard_rows(spark, tricky, nothing):
    got = license_scan(tricky.drop("path").withColumnRenamed("label", "path")).collect()
    assert len(got) == tricky.count() and all(r["licence"] is None for r in got) and license_scan(nothing).count() == 0


def test_ties_and_repeats(spark):
    mit, isc = "Licensed under the MIT License.", "Licensed under the ISC License."
    files = [("d/LICENSE", mit), ("d/LICENSE", mit), ("d/COPYING", isc), ("d/x", "code"), ("d/x", "code"), ("x", None), ("b", mit + "\n" + isc)]
    df = spark.createDataFrame([(7, p, t, "z", "z") for p, t in files], "doc_id long, path string, text string, key string, home string")
    got = license_scan(df).collect()
    by = {r["path"]: (r["licence"], r["origin"], r["from_path"]) for r in got}
    assert len(got) == 7 and by["d/x"] == ("ISC", "inherited", "d/COPYING") and by["b"][0] == "ISC"
