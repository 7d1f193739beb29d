"""Synthetic calendar: dates are text `year-month-day` with years of any length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.fixed import MONTH_STARTS

DATE_PATTERN = r"^(-?\d+)-(\d{1,2})-(\d{1,2})$"


def _part(col: Column, group: int, default: int) -> Column:
    return F.coalesce(F.regexp_extract(col, DATE_PATTERN, group).try_cast("int"), F.lit(default))


def _within(col: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col))


def parse_synthetic_date(df: DataFrame, column: str = "date") -> DataFrame:
    """Add year, month, day; text that does not parse gives year 0, month 1, day 1."""
    text = F.col(column)
    return df.withColumns({
        "year": _part(text, 1, 0),
        "month": _within(_part(text, 2, 1), 1, 12),
        "day": _within(_part(text, 3, 1), 1, 31),
    })


def month_of(column: str = "date") -> Column:
    """Month of a synthetic date without adding the other parts."""
    return _within(_part(F.col(column), 2, 1), 1, 12)


def month_day_code() -> Column:
    return F.col("month") * 100 + F.col("day")


def day_of_year() -> Column:
    """Day of a 365-day year; Feb 29 shares its value with Mar 1."""
    return F.element_at(F.array(*[F.lit(v) for v in MONTH_STARTS[1:]]), F.col("month")) + F.col("day")


def date_ordinal(df: DataFrame) -> DataFrame:
    """Add doy, month-day code and an ordinal that is fit for distances, not for ordering."""
    return df.withColumns({
        "doy": day_of_year(),
        "md": month_day_code(),
        "ordinal": F.col("year").cast("long") * 366 + day_of_year(),
    })


def calendar_features(df: DataFrame) -> DataFrame:
    """Month, quarter, day, 30-day-month day of year, week and their circular encodings."""
    doy = (F.col("month") - 1) * 30 + F.col("day")
    doy_angle = doy * F.lit(2 * math.pi / 365)
    month_angle = F.col("month") * F.lit(2 * math.pi / 12)
    return df.withColumns({
        "quarter": F.floor((F.col("month") - 1) / 3).cast("int") + 1,
        "dayofmonth": F.col("day"),
        "dayofyear": doy,
        "weekofyear": _within(F.floor(doy / 7).cast("int"), 0, 51),
        "sin_doy": F.sin(doy_angle),
        "cos_doy": F.cos(doy_angle),
        "sin_mon": F.sin(month_angle),
        "cos_mon": F.cos(month_angle),
    })
