"""Equal keys of an index and its probes, with hot keys dealt over a grid of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import hinted, store

#: Rows of one key, on either side, that stay together.
SPLIT = 4096


def probed(probes: DataFrame, index: DataFrame, name: str, split: int = SPLIT) -> DataFrame:
    """Inner join of stored tables on `key` (long), every pair of rows once; filter the result, it is never stored.

    A key with more than `split` rows on a side is cut there by a hash of the row; the other side meets each cut, so
    a pair of cuts is a task of its own. Other columns must differ between the sides.
    """
    sides = probes.select("key", F.lit(1).alias("p"), F.lit(0).alias("i")).unionByName(index.select("key", F.lit(0).alias("p"), F.lit(1).alias("i")))
    sizes = sides.groupBy("key").agg(F.sum("p").alias("p"), F.sum("i").alias("i")).filter((F.col("p") > 0) & (F.col("i") > 0) & (F.greatest("p", "i") > split))
    cuts = hinted(store(sizes.select("key", F.ceil(F.col("p") / split).alias("__p"), F.ceil(F.col("i") / split).alias("__i")), f"{name}_hot"), 48)

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*[c for c in side.columns if c != "key"]), F.coalesce(f"__{own}", F.lit(1)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"__{other}", F.lit(1)) - 1))
        return side.join(cuts, "key", "left").select(*side.columns, mine.alias(f"cut_{own}"), every.alias(f"cut_{other}"))

    return dealt(probes, "p", "i").join(dealt(index, "i", "p"), ["key", "cut_p", "cut_i"]).drop("cut_p", "cut_i")
