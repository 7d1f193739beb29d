"""Null, infinity and range rules shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.fixed import LABEL_MAX, LABEL_MIN


def finite_or_null(col: Column) -> Column:
    """NaN and infinities count as missing everywhere in the package."""
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)


def clean_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cast the named columns to DOUBLE; unparsable, NaN and infinite values become NULL."""
    return df.withColumns({c: finite_or_null(F.col(c).try_cast("double")) for c in columns})


def coerce_types(df: DataFrame, numeric: Iterable[str], text: Iterable[str] = ("region_id", "date")) -> DataFrame:
    """Text keys to STRING, measures to DOUBLE with bad values as NULL."""
    present = set(df.columns)
    df = clean_numeric(df, [c for c in numeric if c in present])
    return df.withColumns({c: F.col(c).cast("string") for c in text if c in present})


def clip(col: Column, low: float = LABEL_MIN, high: float = LABEL_MAX) -> Column:
    """Clamp to [low, high]; NULL stays NULL (bare least/greatest would skip it)."""
    return F.when(col.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), col)))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL on a zero divisor."""
    return top / F.nullif(bottom, F.lit(0.0))


def r6(col: Column, digits: int = 6) -> Column:
    """Round for comparison; the tiny shift keeps exact decimal ties and -0.0 off the boundary."""
    return F.round(col + F.lit(1e-9), digits)
