"""Spelling variants: words one edit apart, found by pivotal grams.

Bigrams are ordered by how few words hold them. A word's prefix holds its three rarest bigrams, and its pivots are the
two of them that share no character and are rarest together. One edit touches two neighbouring bigrams at most, so it
leaves one pivot whole: of two words one edit apart, the one whose prefix ends earlier in the order has a pivot in
the other's prefix, at a place that the edit can have shifted by one at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import body, short_batches, store
from isohyet.llm.probing import probed

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LEAST_CHARS, LEAST_TIMES, FACTOR = 6, 5, 5
#: Bigrams of length 2 and one edit: a prefix has 2 * 1 + 1 grams, 1 + 1 of them pivots.
GRAM, EDITS = 2, 1
#: Distinct words that a worker counts before it hands them on.
HELD = 400_000
#: (shift of a bigram, change of length) that one edit behind, at or before it can cause.
SHIFTS = ((0, 0), (0, 1), (1, 1), (0, -1), (-1, -1))
#: Lengths and places in a key; longer words share the last number, which costs candidates, not results.
CLIP = 1 << 12


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int | None = None, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word, n): occurrences of runs of letters, A-Z as a-z, of at least `least_chars` code points.

    With `drop_one_in`, a run whose CRC-32 of `<id>:<run>` it divides loses the code point at that CRC modulo its
    length before it counts. Null ids count as empty text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(RUN.findall(text)).items():
                    run = run.lower() if run.isascii() else run.translate(LOWER)
                    if drop_one_in:
                        code = zlib.crc32(run.encode(), start)
                        if code % drop_one_in == 0:
                            at = code % len(run)
                            run = run[:at] + run[at + 1 :]
                    if len(run) >= least_chars:
                        held[run] = held.get(run, 0) + n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held = {}
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    short_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), body(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def choose_pivots(grams: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """EDITS + 1 of the grams (place, rank, weight) that share no character, of least total weight.

    Dynamic programming by place: the best k grams up to here are those up to the gram before, or this gram after
    the best k - 1 that end before it starts.
    """
    grams = sorted(grams)
    best: list[list[tuple[int, list]]] = [[(0, [])] for _ in range(len(grams) + 1)]
    for i, gram in enumerate(grams, 1):
        free = max(j for j in range(i) if j == 0 or grams[j - 1][0] + GRAM <= gram[0])
        for k in range(1, EDITS + 2):
            options = [best[i - 1][k]] if len(best[i - 1]) > k else []
            if len(best[free]) > k - 1:
                total, chosen = best[free][k - 1]
                options.append((total + gram[2], [*chosen, gram]))
            if not options:
                break
            best[i].append(min(options))
    return best[-1][EDITS + 1][1]


def _grams(words: DataFrame, ranks: dict[str, tuple[int, int]]) -> DataFrame:
    """Per word: keys of its pivots' possible places, keys of its prefix, the prefix's last rank, its letters as bits."""

    def key(rank: int, place: int, length: int) -> int:
        return (rank << 24) + (min(place, CLIP - 1) << 12) + min(length, CLIP - 1)

    def one(word: str) -> tuple[set[int], set[int], int, int]:
        found = sorted((*ranks[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
        last = found[GRAM * EDITS][0]
        # Grams that tie with the last one belong to the prefix too, wherever an edit moves them.
        prefix = [(i, rank, weight) for rank, weight, i in found if rank <= last]
        probes = {key(rank, i + shift, len(word) + more) for i, rank, _ in choose_pivots(prefix) for shift, more in SHIFTS if i + shift >= 0}
        letters = 0
        for c in word:
            letters |= 1 << (ord(c) & 63)
        return probes, {key(rank, i, len(word)) for i, rank, _ in prefix}, last, letters - (letters >> 63 << 64)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [one(w) for w in batch.column(0).to_pylist()]
            keys = [pa.array([sorted(p[k]) for p in parts], pa.list_(pa.int64())) for k in (0, 1)]
            rest = [pa.array([p[2] for p in parts], pa.int32()), pa.array([p[3] for p in parts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys, *rest], names=["word", "n", "probes", "prefix", "last", "letters"])

    return words.mapInArrow(grams, "word string, n long, probes array<long>, prefix array<long>, last int, letters long")


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of words exactly one edit apart, both ways round: (word, n, other, other_n). `words` is stored: (word, n).

    Words have four or more code points of the letters of RUN, so their distinct bigrams, at most 90 squared, are the
    only table that is collected.
    """
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM))))
    counts = words.select(gram.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    ranks = {r["gram"]: (k, r["n"]) for k, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["gram"])))}
    grams = store(_grams(words, ranks), "spelling_grams")
    probes = grams.select(F.explode("probes").alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"), F.col("letters").alias("a_letters"))
    index = grams.select(F.explode("prefix").alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"), F.col("letters").alias("b_letters"))
    met = probed(probes, index, "spelling")
    alike = F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2 * EDITS
    met = met.filter((F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & alike & (F.levenshtein("a", "b", EDITS) == EDITS))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a_n", "b_n"), ("b_n", "a_n"))])
    pairs = store(pairs.distinct(), "spelling_pairs")
    there = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    return there.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """The end of each chain of (word, root), by doubling its steps; counts grow along a chain, so it is short and has no rings."""
    while True:
        further = forms.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = store(forms.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "spelling_roots")
        if not step.filter("moved").limit(1).count():
            return step.select("word", "root")
        forms = step.select("word", "root")


def spelling_variants(counts: DataFrame, least_times: int = LEAST_TIMES, factor: int = FACTOR) -> DataFrame:
    """One row per word of at least `least_times` occurrences: word, n, n_near, form, form_n, root.

    `counts` holds each word once (word, n). A word's form is the most frequent word one edit away (ties: the first in code-point
    order) if it is at least `factor` times as frequent, else null; its root ends the chain of forms. No words give
    no rows. A word has a bounded number of near words, so no group of links is large; hot bigrams are cut.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than its variants")
    words = store(counts.filter(F.col("n") >= least_times), "spelling_words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("__best"))
    best = store(best, "spelling_near")
    often = -F.col("__best.n")
    good = often >= F.lit(factor) * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("__best.form")).alias("form"), F.when(good, often).alias("form_n"))
    rows = store(rows, "spelling_forms")
    roots = _roots(rows.filter("form is not null").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
