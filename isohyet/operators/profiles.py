"""Whole-table profiles: label distribution, missing values, scaling, prediction statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.dates import month_day_code, parse_synthetic_date
from isohyet.functions.numeric import finite_or_null
from isohyet.operators.priors import with_month
from isohyet.operators.quantiles import column_quantiles


def scan_aggregate(panel: DataFrame) -> DataFrame:
    """Row, label and region counts with sums, in one scan."""
    return panel.agg(
        F.count(F.lit(1)).alias("days"), F.count("score").alias("labels"), F.countDistinct("region_id").alias("regions"),
        F.sum("score").alias("score_sum"), F.sum("prec").alias("prec_sum"))


def label_profile(panel: DataFrame) -> DataFrame:
    """Label histogram in percent, monthly label mean and share of positive labels: (kind, key, rows, value)."""
    cube = with_month(panel).filter(F.col("score").isNotNull()).groupBy("score", "month").agg(F.count(F.lit(1)).alias("n"))
    # The cube above has at most (label values x 12) rows; everything below works on it.
    total = F.sum("n").over(Window.partitionBy())
    s, n = F.col("score"), F.col("n")
    hist = cube.groupBy("score").agg(F.sum("n").alias("n")).select(
        F.lit("score").alias("kind"), s.cast("int").cast("string").alias("key"), n.alias("rows"), (n * 100.0 / total).alias("value"))
    month = cube.groupBy("month").agg(F.sum("n").alias("rows"), F.sum(s * n).alias("_s"), F.sum(F.when(s > 0, n).otherwise(0)).alias("_p"))
    key = F.col("month").cast("string").alias("key")
    mean = month.select(F.lit("month_mean").alias("kind"), key, "rows", (F.col("_s") / F.col("rows")).alias("value"))
    rate = month.select(F.lit("month_positive_rate").alias("kind"), key, "rows", (F.col("_p") / F.col("rows")).alias("value"))
    return hist.unionByName(mean).unionByName(rate)


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing or non-finite cells per column: (feature, missing, rows, missing_rate), from one aggregate."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(finite_or_null(F.col(c).cast("double")).isNull()).alias(c) for c in columns])
    long = counts.unpivot(["rows"], list(columns), "feature", "missing")
    return long.select("feature", "missing", "rows", (F.col("missing") / F.nullif(F.col("rows"), F.lit(0))).alias("missing_rate"))


def top_missing(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    return missingness(df, columns).filter("missing > 0").orderBy(F.desc("missing"), "feature").limit(k)


def missing_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, columns, columns with gaps, missing cells and the highest rate."""
    return missingness(df, columns).agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.count_if(F.col("missing") > 0).alias("missing_columns"),
        F.sum("missing").alias("missing_cells"), F.max("missing_rate").alias("max_rate"))


def completeness_gate(df: DataFrame, expected: Sequence[str], fail: bool = True) -> DataFrame:
    """Report columns with missing values; raise when asked to, and always when a column is absent."""
    absent = [c for c in expected if c not in df.columns]
    if absent:
        raise ValueError(f"{len(absent)} expected columns are absent: {absent[:10]}")
    report = missingness(df, expected).filter("missing > 0")
    if fail:
        worst = report.orderBy(F.desc("missing"), "feature").limit(10).collect()
        if worst:
            raise ValueError(f"missing values in final rows: { {r.feature: r.missing for r in worst} }")
    return report


def train_zscore(df: DataFrame, columns: Sequence[str], mask: Column) -> DataFrame:
    """`<c>_z` columns scaled with mean and sample deviation of the rows where `mask` holds."""
    row = df.agg(*[f(F.when(mask, F.col(c))).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return df.withColumns({
        f"{c}_z": (F.col(c) - F.lit(row[f"{c}_m"]).cast("double")) / F.lit(row[f"{c}_s"] or 1.0) for c in columns})


def cyclic_context(df: DataFrame, train_mask: Column) -> DataFrame:
    """Year z-score from train rows and circular month, quarter and week."""
    out = train_zscore(df, ["year"], train_mask)
    angle = lambda c, period: F.col(c) * F.lit(2 * math.pi / period)
    return out.withColumns({
        f"{name}_{fn}": f(angle(c, period)) for name, c, period in (("month", "month", 12), ("quarter", "quarter", 4), ("week", "weekofyear", 52))
        for fn, f in (("sin", F.sin), ("cos", F.cos))})


def prev_year_asof(train: DataFrame, test: DataFrame) -> DataFrame:
    """For each region, month-day and test year the train day of the latest earlier year."""
    wanted = parse_synthetic_date(test).select("region_id", month_day_code().alias("md"), F.col("year").alias("test_year")).distinct()
    past = parse_synthetic_date(train).withColumn("md", month_day_code())
    return past.join(wanted, ["region_id", "md"]).filter(F.col("year") < F.col("test_year")).groupBy("region_id", "md", "test_year").agg(
        F.max("year").alias("year"), F.max_by("day_idx", "year").alias("day_idx"))


def prediction_stats(long: DataFrame, sample: bool = True, value: str = "pred") -> DataFrame:
    """Mean, deviation (sample or population), minimum and maximum per horizon and overall (horizon 0)."""
    spread_of = F.stddev_samp if sample else F.stddev_pop
    return long.groupingSets([[F.col("horizon")], []], F.col("horizon")).agg(
        F.avg(value).alias("mean"), spread_of(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
    ).withColumn("horizon", F.coalesce("horizon", F.lit(0)))


def distribution_summary(long: DataFrame, by: Sequence[str] = ("model",), value: str = "pred") -> DataFrame:
    """Mean, population deviation, range, share of zeros and the 95th and 99th percentile."""
    base = long.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg((F.col(value) <= 1e-12).cast("double")).alias("zero_fraction"))
    tops = column_quantiles(long.withColumn("value_", F.col(value)), ["value_"], [0.95, 0.99], keep=by)
    wide = tops.groupBy(*by).agg(
        F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))).alias("p95"), F.max(F.when(F.col("prob") == 0.99, F.col("quantile"))).alias("p99"))
    return base.join(wide, list(by))
