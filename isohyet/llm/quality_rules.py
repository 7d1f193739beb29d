"""Quality rules with thresholds that adapt to language and source, DataFrame functions only.

Every measure of a text is a column expression. Mergeable quantile sketches per (language, source), merged again
per language, give the fences; the documents meet them in a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import body, hinted, match, store, words

LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
#: Measures held against fences, with the least spread that counts: a group of equal values must not fence off
#: its first ordinary exception.
SPREADS = {"symbol_share": 0.03, "capital_share": 0.08, "repeated_line_share": 0.15, "same_word_share": 0.08}
#: Fences stand so many spreads (third less first quartile) above the third quartile.
REACH = 3.0
#: A source's own fence counts as its documents against so many of its language's.
PRIOR_ROWS = 200.0
#: Sketches count values in buckets whose bounds grow by GROWTH (quantiles are right to 1%); values up to LEAST_VALUE share one.
GROWTH = 1.02
LEAST_VALUE = 1e-4


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares of SPREADS.

    n_repeat_words counts words inside windows of WINDOW words that occur twice or more. Windows are told apart by
    64-bit hashes; only texts with a repeat sort them, so the cost is linear for the rest and n log n for these.
    """
    w = F.col("__w")
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    window = lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WINDOW)])
    windows = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("__t", body(text_col)).withColumn("__w", words("__t")).withColumn("__h", hashes).withColumn("__win", windows)
    df = df.withColumn("__lines", lines)
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    ordered = F.when(repeats, F.sort_array(F.transform("__win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    same = lambda a, b: F.get("__s", a)["h"] == F.get("__s", b)["h"]
    twice = F.transform(
        F.col("__s"), lambda x, i: F.when(F.coalesce(same(i - 1, i), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["i"])
    )
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size("__p")), F.lit(0).cast("long"),
        lambda n, i: n + F.when(i == F.size("__p"), F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get("__p", i) - F.get("__p", i - 1))),
    )
    df = df.withColumns({
        "__s": ordered, "n_words": F.size("__w").cast("long"), "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_capitals": (F.length("__t") - F.length(F.regexp_replace("__t", r"[\p{Lu}!]+", ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__same": F.size("__h") - F.size(F.array_distinct("__h")),
    }).withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.array_compact(twice))))
    df = df.withColumn("n_repeat_words", F.when(F.size("__p") > 0, covered).otherwise(0).cast("long"))
    share = lambda part, whole: F.coalesce(F.col(part) / F.when(F.col(whole) > 0, F.col(whole)), F.lit(0.0))
    df = df.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "capital_share": share("n_capitals", "word_chars"),
        "repeated_line_share": share("n_dup_lines", "n_lines"),
        # Ordinary texts repeat words more the longer they are: the share is taken against the growth of its logarithm.
        "same_word_share": share("__same", "n_words") / F.greatest(F.lit(1.0), F.log2(F.greatest(F.col("n_words"), F.lit(1)) / 64.0)),
    })
    return df.drop("__t", "__w", "__h", "__win", "__s", "__p", "__lines", "__same", "n_capitals", "n_lines")


def quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows and the first and third quartile of a table of (keys, bucket, n): a group has some hundred buckets."""
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    placed = counts.withColumns({"__before": before, "__total": total})
    value = lambda b: F.when(b > 0, F.pow(F.lit(GROWTH), b) * (LEAST_VALUE * 2 / (1 + GROWTH))).otherwise(0.0)
    first = lambda q: F.min(F.when(F.col("__before") >= F.col("__total") * q, F.col("bucket")))
    return placed.groupBy(*keys).agg(F.max("__total").alias("rows"), value(first(0.25)).alias("low"), value(first(0.75)).alias("high"))


def fences(rows: DataFrame) -> DataFrame:
    """lang, source and a fence for each measure, from sketches per (lang, source) and their merger per lang.

    A sketch is a count per bucket, added up map-side: merging is adding, nothing is drawn at random, so neither
    partitions nor retried tasks change a fence.
    """
    place = lambda m: F.when(F.col(m) > LEAST_VALUE, F.ceil(F.log(F.col(m) / LEAST_VALUE) / math.log(GROWTH))).otherwise(0).cast("int")
    marks = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), place(m).alias("bucket")) for m in SPREADS])).alias("__m")
    own = rows.select("lang", "source", marks).groupBy("lang", "source", "__m.measure", "__m.bucket").agg(F.count(F.lit(1)).alias("n"))
    own = store(own, "sketches")
    whole = own.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    least = F.create_map(*[F.lit(x) for m, s in SPREADS.items() for x in (m, s)])[F.col("measure")]
    fence = (F.col("high") + REACH * F.greatest(F.col("high") - F.col("low"), least)).alias("fence")
    own = quartiles(own, ["lang", "source", "measure"]).select("lang", "source", "measure", "rows", fence)
    whole = quartiles(whole, ["lang", "measure"]).select("lang", "measure", fence.alias("all_fence"))
    both = match(own, whole, ["lang", "measure"])
    weight = F.col("rows") / (F.col("rows") + PRIOR_ROWS)
    mixed = weight * F.col("fence") + (1 - weight) * F.col("all_fence")
    return both.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, mixed)).alias(f"{m}_fence") for m in SPREADS])


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per input row: doc_id, the measures, their fences, base_failed, kept and the columns of `carry`.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED percent in repeated windows. Other texts
    are kept where no measure is above the fence of their language and source. Texts that fail the base rule stay
    out of the sketches. Null text has no words; null languages and sources are groups of their own; rows that
    repeat are decided alike; a group without sketched rows has no fence, and no rows give no rows.
    """
    extra = {f"__c_{k}": v for k, v in (carry or {}).items()}
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        *[v.alias(k) for k, v in extra.items()],
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = store(measured(rows).drop("text").withColumn("base_failed", failed), "measures")
    limits = store(fences(rows.filter("not base_failed")), "fences")
    above = F.lit(False)
    for m in SPREADS:
        above = above | F.coalesce(F.col(m) > F.col(f"{m}_fence"), F.lit(False))
    rows = match(rows, limits, ["lang", "source"], "left")
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~above)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *SPREADS, *[f"{m}_fence" for m in SPREADS], *[F.col(k).alias(k[4:]) for k in extra],
    )


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep."""
    digest = F.xxhash64(body(text_col))
    gone = quality_rules(docs, id_col, text_col, lang_col, source_col, carry={"__digest": digest, "__lang": F.col(lang_col), "__source": F.col(source_col)})
    keys = [id_col, "__digest", "__lang", "__source"]
    gone = hinted(store(gone.filter("not kept").select(F.col("doc_id").alias(id_col), *keys[1:]).distinct(), "quality_gone"), 64)
    rows = docs.withColumns({"__digest": digest, "__lang": F.col(lang_col), "__source": F.col(source_col)})
    return match(rows, gone, keys, "left_anti").drop(*keys[1:])
