"""Normalisation of overlapping day sequences without building them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions.blocks import KEYS, spread


def sequence_norm(panel: DataFrame, origins: DataFrame, columns: Sequence[str], length: int = 91, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and deviation of each measure over all `length`-day windows that end at an origin.

    A day counts once per window that covers it, so it is weighted by the number of origins in the
    `length` days from it on; variance has a floor of 1e-6.
    """
    marks = origins.select(*keys, "day_idx", F.lit(1).alias("_origin"))
    marked = panel.select(*keys, "day_idx", *columns).join(marks, [*keys, "day_idx"], "left")
    days = spread(marked, look_ahead=length - 1, keys=keys)
    days.add({"_n": F.sum("_origin").over(days.window.rowsBetween(0, length - 1))})
    covered = days.done().filter("_n > 0")
    sums = covered.agg(*[
        f(c).alias(f"{c}_{n}") for c in columns for n, f in (
            ("s", lambda c: F.sum(F.col(c) * F.col("_n"))), ("q", lambda c: F.sum(F.col(c) * F.col(c) * F.col("_n"))),
            ("n", lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("_n")))))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col(f"{c}_s") / F.col(f"{c}_n")).alias("mean"), (F.col(f"{c}_q") / F.col(f"{c}_n")).alias("sq"))
        for c in columns])
    return sums.select(F.explode(rows).alias("r")).select("r.*").select(
        "feature", "mean", F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(1e-6))).alias("std"))
