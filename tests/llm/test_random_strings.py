"""Secrets that only the Markov models find, beside identifiers that they must leave alone."""

import os
import random
import time

import pytest
from corpus_cases import SMALL, rows

from isohyet.llm import secrets

FOUND = [
    "x7Kq9ZpL2vWm4TrB", "Q9wZ3kTbV7yLp2XcR5d", "aZ3kTb9Lp2Xq", "qzxkvjwpyfbghmdtrclnsoeu", "QzXkvJwpYfbGhmDtrcLnsoEu",
]
LEFT = [
    "snake_case_identifier_number_12345", "/usr/local/lib/python3/dist_packages", "getUserAccountInformation", "CONSTANT_VALUE_NAME",
    "internationalization", "2024-01-01-2024-12-31", "file_version_20240131_final", "1234567890123456", "short1Aa",
]


@pytest.fixture(scope="module")
def beside(spark):
    """A function that scans given texts beside a thousand documents, from which the models learn."""
    docs = spark.read.parquet(os.path.join(os.path.dirname(SMALL), "sf0.01", "documents.parquet"))

    def scan(texts):
        extra = rows(spark, [(10**9 + i, t, "en", "a") for i, t in enumerate(texts)]).select("doc_id", "text")
        got = secrets.secret_scan(docs.select("doc_id", "text").unionByName(extra)).filter("doc_id >= 1000000000").collect()
        return {r["doc_id"] - 10**9: r for r in got}

    return scan


def test_random_strings_and_identifiers(beside):
    got = beside([f"see {v} here" for v in FOUND + LEFT])
    assert [[x["value"] for x in got[i]["random"]] for i in range(len(got))] == [[v] for v in FOUND] + [[] for _ in LEFT]


def test_what_a_fixed_pattern_leaves_of_a_run(beside):
    text = "id 0123456789abcdef01234567-Zq8KpX2vL9wTm4Rb7Yc1Nd, password=hunter22abc/ rest"
    got = beside([text])[0]
    tail = [(x["start"], x["end"], x["value"]) for x in got["random"]]
    at = text.index("-Zq8")
    assert tail == [(at, at + 23, "-Zq8KpX2vL9wTm4Rb7Yc1Nd")] and len(got["hex"]) == len(got["assign"]) == 1


def test_a_long_run_takes_linear_time(beside):
    rng = random.Random(1)
    text = "".join(rng.choice(secrets.ALPHABET[:64]) for _ in range(1_000_000))
    beside(["warm up"])
    start = time.time()
    got = beside([text])[0]
    assert got["random"] and time.time() - start < 30


def test_no_samples_tell_little(spark):
    """Without samples both models fall back: digits and one kind of letters stay ordinary, and nothing fails."""
    got = secrets.secret_scan(rows(spark, [(1, "123456789012345678", "en", "a"), (2, None, "en", "a")])).collect()
    assert all(not r["random"] for r in got) and len(got) == 2
