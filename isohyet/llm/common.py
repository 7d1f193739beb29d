"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.session import materialize

SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage and survives lost executors."""
    return materialize(df, f"llm_{name}")


def body(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """Runs of anything but ASCII white space; null and blank texts have none."""
    return F.array_remove(F.split(body(text), SPACE), "")


def collapsed(text: Column | str) -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(body(text), SPACE, " ")


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the right side's keys are dropped.

    The right side may hold only keys and columns that the left side lacks.
    """
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for key in keys:
        on = on & left[key].eqNullSafe(other[f"__r_{key}"])
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def hinted(stored: DataFrame, row_bytes: int, most_bytes: int = 64 << 20) -> DataFrame:
    """A stored table, to be broadcast if its rows, counted now, take at most `most_bytes`; else left to a shuffle."""
    return F.broadcast(stored) if stored.count() * row_bytes <= most_bytes else stored


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
