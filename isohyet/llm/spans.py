"""Places of pattern matches in texts as column expressions (code points, end exclusive)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 256
EMPTY = "array<struct<start:bigint,end:bigint,value:string>>"


def add_matches(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Add `name`: array of (start, end, value) of the leftmost non-overlapping matches of `pattern` in column `text`.

    Matches and the pieces between them alternate, so starts are sums of lengths. Sums are taken in runs of RUN
    matches: the cost stays near linear in the number of matches. Patterns must be free of nested repeats that
    backtrack, and must not match the empty string.
    """
    m, p, n, r = (F.col(f"__{k}") for k in "mpnr")
    hit = F.col(text).rlike(pattern)
    df = df.withColumns({"__m": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), "__p": F.when(hit, F.split(F.col(text), pattern, -1))})
    df = df.withColumn("__n", F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(p, i))).cast("long")))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b)
    runs = F.when(F.size(n) > 0, F.sequence(F.lit(0), F.floor((F.size(n) - 1) / RUN).cast("int")))
    sums = F.aggregate(
        runs, F.array(F.lit(0).cast("long")), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + total(F.slice(n, b * RUN + 1, F.lit(RUN)))))
    )
    df = df.withColumn("__r", sums)
    start = lambda i: F.get(r, F.floor(i / RUN).cast("int")) + total(F.slice(n, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)) + F.length(F.get(p, i))
    found = F.transform(m, lambda x, i: F.struct(start(i).alias("start"), (start(i) + F.length(x)).alias("end"), x.alias("value")))
    return df.withColumn(name, F.coalesce(found, F.array().cast(EMPTY))).drop("__m", "__p", "__n", "__r")


def ranked(matches: str, rank: int) -> Column:
    """(start, rank, end) of each match, for sorting."""
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def written(parts: Sequence[Column], kinds: Sequence[str]) -> Column:
    """kind:start:end by start, then kind in the order given, comma-joined; `parts` come from `ranked`."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(F.sort_array(F.concat(*parts)), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def outside(matches: str, others: Sequence[str]) -> Column:
    """Matches that overlap none of the matches in the columns `others`."""
    free: Callable[[Column], Column] = lambda x: ~F.exists(F.concat(*others), lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"]))
    return F.filter(matches, free)
