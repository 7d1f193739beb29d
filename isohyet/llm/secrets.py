"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only. The models are tables of character pairs, counted over the whole corpus from labelled
samples: what the fixed patterns match is random, runs in the shape of words and identifiers are ordinary. A run is
reported when its total log-likelihood ratio exceeds what ordinary samples of its length reach.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import body, store
from isohyet.llm.spans import add_matches, ranked, written

KINDS = ["assign", "access", "hex", "random"]
# Equivalent to the stated patterns with their length rules, with possessive repeats that cannot backtrack. A failed
# assignment still uses up its text, so its length is checked after matching.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
RUNS = r"[A-Za-z0-9+/_=-]{12,}+"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LEAST_VALUE = 6
#: Words and identifiers: pieces of lower-case letters, capitalised or not, capitals alone, or digits, with separators.
ORDINARY = r"^[+/_=.-]*+(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]+)[+/_=.-]*+)+$"
#: exp(-EVIDENCE) bounds how often the ordinary model itself makes a run look so random.
EVIDENCE = 7.0
#: Deviations above the mean of ordinary samples of a length (two classes of lengths per doubling) that a run must reach, where
#: so many samples are known.
DEVIATIONS, LEAST_SAMPLES = 4.5, 30
#: Rows of a model lean on what they back off to like so many samples.
BACKOFF = 10.0
#: Half of the random model's mass is uniform: the next secret may use another part of the alphabet.
UNIFORM_SHARE = 0.5
#: Shares of the ordinary model that do not come from counts: a kind of character mostly stays, and any letter may follow.
KIND_SHARE, STAY, LETTER_SHARE = 0.5, 0.8, 0.02
CODES = 128
SCORED = "array<struct<start:bigint,end:bigint,value:string,score:double,usual:boolean>>"


def _blanked(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """The text with valid matches of `pattern` as blanks of their length, so that places stay."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    held = lambda x: F.when(valid(x), F.repeat(F.lit(" "), F.length(x))).otherwise(x)
    whole = F.array_join(F.transform(parts, lambda part, i: F.concat(part, F.coalesce(F.get(F.transform(found, held), i), F.lit("")))), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    df = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        df = add_matches(df, "text", name, pattern)
    value = lambda x: F.regexp_extract(x, ASSIGN_VALUE, 1)
    long_enough = lambda x: F.length(value(x)) >= LEAST_VALUE
    df = df.withColumn("assign", F.filter("assign", lambda x: long_enough(x["value"])))
    # What is left of a run beside a fixed pattern is a run of its own.
    df = df.withColumn("text", _blanked(F.col("text"), ASSIGN, long_enough))
    for pattern in (ACCESS, HEX):
        df = df.withColumn("text", _blanked(F.col("text"), pattern, lambda x: F.lit(True)))
    df = add_matches(df, "text", "runs", RUNS)
    texts = lambda name: F.transform(name, lambda x: x["value"])
    secrets = F.concat(F.transform("assign", lambda x: value(x["value"])), texts("access"), texts("hex"))
    return df.withColumn("secrets", secrets).drop("text")


def _characters(value: Column) -> Column:
    """The characters of a value, split once: no step walks the value again."""
    return F.filter(F.split(value, ""), lambda c: c != "")


def pair_models(found: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of character pairs of random and of ordinary strings: at most the alphabet squared, twice."""
    ordinary = F.filter(F.transform("runs", lambda x: x["value"]), lambda x: x.rlike(ORDINARY))
    out = {}
    for name, samples in (("random", F.col("secrets")), ("ordinary", ordinary)):
        chars = found.select(F.explode(samples).alias("v")).select(_characters(F.col("v")).alias("c"))
        pairs = chars.select(F.explode(F.transform("c", lambda c, i: F.concat(c, F.coalesce(F.get("c", i + 1), F.lit(""))))).alias("pair"))
        rows = pairs.filter("length(pair) = 2").groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()
        out[name] = {r["pair"]: r["n"] for r in rows}
    return out


def _kind(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "_"


def _ordinary(counts: dict[str, int]) -> Callable[[str, str], float]:
    """P(b | a): the kind of b after the kind of a, then b among its kind, letters by the letter before in either case."""
    kinds, letters, first, marks = Counter(), Counter(), Counter(), Counter()
    for pair, n in counts.items():
        a, b = pair
        kinds[_kind(a), _kind(b)] += n
        marks[b] += n
        if b.isalpha():
            first[b.lower()] += n
            if a.isalpha():
                letters[a.lower(), b.lower()] += n
    rows = {a: sum(letters[a, b] for b in LETTERS) for a in LETTERS}
    every = sum(first.values())
    alone = {b: (first[b] + 1.0) / (every + len(LETTERS)) for b in LETTERS}
    members = {k: [c for c in ALPHABET if _kind(c) == k] for k in "aA0_"}
    totals = {k: (sum(kinds[k, x] for x in members), sum(marks[c] for c in members[k])) for k in members}

    def chance(a: str, b: str) -> float:
        ka, kb = _kind(a), _kind(b)
        guess = STAY if ka == kb else (1 - STAY) / (len(members) - 1)
        kind = KIND_SHARE * guess + (1 - KIND_SHARE) * (kinds[ka, kb] + BACKOFF * guess) / (totals[ka][0] + BACKOFF)
        if not b.isalpha():
            return kind * (marks[b] + BACKOFF) / (totals[kb][1] + BACKOFF * len(members[kb]))
        low = b.lower()
        if not a.isalpha():
            return kind * alone[low]
        known = (letters[a.lower(), low] + BACKOFF * alone[low]) / (rows[a.lower()] + BACKOFF)
        return kind * (LETTER_SHARE / len(LETTERS) + (1 - LETTER_SHARE) * known)

    return chance


def ratio_table(models: dict[str, dict[str, int]]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) by ASCII codes, row by row; 0 outside the alphabet."""
    even, chance, out = 1.0 / len(ALPHABET), _ordinary(models["ordinary"]), [0.0] * CODES**2
    for a in ALPHABET:
        seen = sum(models["random"].get(a + b, 0) for b in ALPHABET) + BACKOFF
        for b in ALPHABET:
            random = UNIFORM_SHARE * even + (1 - UNIFORM_SHARE) * (models["random"].get(a + b, 0) + BACKOFF * even) / seen
            out[ord(a) * CODES + ord(b)] = round(math.log(random / chance(a, b)), 4)
    return out


def _scored(found: DataFrame, ratios: list[float]) -> DataFrame:
    """Runs with their total log-likelihood ratio and whether they have an ordinary shape."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")

    def score(value: Column) -> Column:
        start = F.struct(F.lit(0).alias("code"), F.lit(0.0).alias("sum"))
        step = lambda s, c: F.struct(F.ascii(c).alias("code"), (s["sum"] + F.get(table, s["code"] * CODES + F.ascii(c))).alias("sum"))
        return F.aggregate(_characters(value), start, step)["sum"]

    runs = F.transform("runs", lambda x: F.struct(x["start"], x["end"], x["value"], score(x["value"]).alias("score"), x["value"].rlike(ORDINARY).alias("usual")))
    return found.withColumn("runs", runs.cast(SCORED))


def _length_class(length: Column) -> Column:
    return F.floor(2 * F.log2(length.cast("double"))).cast("int")


def thresholds(scored: DataFrame) -> dict[int, tuple[float, float]]:
    """Per class of lengths: mean score of ordinary samples a character, and deviation a square root of characters."""
    runs = scored.select(F.explode("runs").alias("r")).filter("r.usual").select(F.length("r.value").alias("n"), F.col("r.score").alias("s"))
    sums = runs.groupBy(_length_class(F.col("n")).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("s") / F.col("n")).alias("mean"), F.stddev_samp(F.col("s") / F.sqrt("n")).alias("spread"))
    return {r["k"]: (r["mean"], r["spread"]) for r in sums.filter(F.col("n") >= LEAST_SAMPLES).collect()}


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and the arrays assign, access, hex and random of (start, end, value).

    `random` holds runs of 12 or more characters, or what fixed patterns leave of them, whose log-likelihood ratio is at
    least EVIDENCE and DEVIATIONS above ordinary samples of their length. Models, and mean and deviation by class of
    lengths (some sixty rows at most), are counted over all rows. Cost is linear in the length of a run. Null text
    counts as empty; empty texts have no spans; rows that repeat are scanned alike; no rows give no rows.
    """
    found = store(_base(docs, id_col, text_col), "secret_runs")
    scored = store(_scored(found, ratio_table(pair_models(found))).drop("secrets"), "secret_scores")
    known = thresholds(scored)
    moments = F.from_json(F.lit(json.dumps([list(known.get(k, (0.0, 0.0))) for k in range(max(known, default=0) + 1)])), "array<array<double>>")

    def likely(x: Column) -> Column:
        n = F.length(x["value"])
        known_ = F.get(moments, _length_class(n))
        usual = F.coalesce(n * F.get(known_, F.lit(0)) + DEVIATIONS * F.sqrt(n) * F.get(known_, F.lit(1)), F.lit(0.0))
        return x["score"] >= F.greatest(F.lit(EVIDENCE), usual)

    random = F.transform(F.filter("runs", likely), lambda x: F.struct(x["start"], x["end"], x["value"]))
    return scored.select("doc_id", "assign", "access", "hex", random.alias("random"))


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts and digests of the spans of `secret_scan`."""
    parts = [ranked(k, i) for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(written(parts[:3], KINDS), 256).alias("base_sha256"), written(parts, KINDS).alias("spans"),
    )
