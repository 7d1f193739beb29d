"""Blind backtests: hide the last labels before an origin, rebuild features, score the next weeks.

All origins run in one job: the origin is an extra key next to the region.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.fixed import DEFAULT_ORIGINS, GAP_DAYS, HISTORY_DAYS, HORIZONS
from isohyet.functions.blocks import KEYS, spread
from isohyet.functions.dates import month_of
from isohyet.operators.samples import TARGETS, lead_targets
from isohyet.plans.feature_table import FeatureOptions, build_features, look_back_days

ORIGIN_KEYS = ("origin", "region_id")
PREDS = [f"pred_week{h}" for h in range(1, HORIZONS + 1)]


def origin_label(weeks: int) -> str:
    return f"tail_minus_{weeks}w"


def parse_origins(text: str) -> list[int]:
    """`5,13,26` or `-5,-13` -> week offsets; an offset must leave room for every target."""
    weeks = [abs(int(part)) for part in text.split(",") if part.strip()]
    if not weeks or min(weeks) < HORIZONS:
        raise ValueError(f"origins need offsets of at least {HORIZONS} weeks, got {text!r}")
    return weeks


def origin_targets(panel: DataFrame, origins: Sequence[int] = DEFAULT_ORIGINS) -> DataFrame:
    """Target frame: one row per (region, origin) with the origin day and the next five labels."""
    weekly = lead_targets(panel)
    offset = F.col("max_week_idx") - F.col("week_idx")
    label = F.concat(F.lit("tail_minus_"), offset.cast("string"), F.lit("w"))
    return weekly.filter(offset.isin([int(o) for o in origins])).select(
        "region_id", label.alias("origin"), F.col("date").alias("origin_date"), F.col("day_idx").alias("origin_day_idx"), *TARGETS)


def origin_band_join(panel: DataFrame, targets: DataFrame, youngest: int = 0, oldest: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Rows of a region next to each of its origins that lie `youngest` to `oldest` days before it.

    A region has few origins; they travel as one array per (region, block), and a row repeats only for those
    it belongs to.
    """
    side = targets.groupBy("region_id").agg(
        F.collect_list(F.struct("origin", "origin_date", "origin_day_idx")).alias("_origins"),
        F.min("origin_day_idx").alias("_first"), F.max("origin_day_idx").alias("_last"))
    joined = spread(panel, side=side, block_rows=block_rows).done()
    # Most days are near no origin: two comparisons drop them before any array is read.
    close = F.col("day_idx") <= F.col("_last") - youngest
    joined = joined.filter(close & (F.col("day_idx") >= F.col("_first") - oldest) if oldest is not None else close)

    def near(o: Column) -> Column:
        age = o["origin_day_idx"] - F.col("day_idx")
        return (age >= youngest) & (age <= oldest) if oldest is not None else age >= youngest

    joined = joined.withColumn("_origins", F.filter("_origins", near)).filter(F.size("_origins") > 0)
    return joined.select(*panel.columns, F.explode("_origins").alias("_o")).select(*panel.columns, "_o.*")


def history_window(panel: DataFrame, targets: DataFrame, tail: int = HISTORY_DAYS, blind: int = GAP_DAYS) -> DataFrame:
    """The last `tail` days up to each origin, the newest `blind` of them flagged."""
    if tail < blind:
        raise ValueError("tail must cover the blind days")
    return origin_band_join(panel, targets, 0, tail - 1).withColumn("is_blind", F.col("origin_day_idx") - F.col("day_idx") < blind)


def blind_mask(panel: DataFrame, targets: DataFrame, blind: int = GAP_DAYS) -> DataFrame:
    """(origin, region, day) rows whose label is hidden."""
    return origin_band_join(panel.select("region_id", "date", "day_idx", "score"), targets, 0, blind - 1)


def check_blind_start(targets: DataFrame, blind: int = GAP_DAYS) -> DataFrame:
    """Regions whose history before an origin is shorter than the blind window."""
    return targets.filter(F.col("origin_day_idx") - blind + 1 < 0).select("region_id", "origin", "origin_day_idx")


def blind_origin(panel: DataFrame, targets: DataFrame, blind: int = GAP_DAYS, tail: int = HISTORY_DAYS) -> DataFrame:
    """History per origin with hidden labels set to NULL; rows with `is_blind = false` may feed statistics."""
    rows = history_window(panel, targets, tail, blind)
    return rows.withColumn("score", F.when(~F.col("is_blind"), F.col("score")))


def pseudo_test_window(
    panel: DataFrame, targets: DataFrame, options: FeatureOptions | None = None, blind: int = GAP_DAYS, tail: int = HISTORY_DAYS,
) -> DataFrame:
    """Features of every origin row, built from masked history with statistics from before the blind days."""
    masked = blind_origin(panel, targets, blind, tail)
    features = build_features(
        masked.drop("is_blind", "origin_date"), masked.filter(~F.col("is_blind")), options or FeatureOptions(), keys=ORIGIN_KEYS, last_only=True)
    return features.filter(F.col("day_idx") == F.col("origin_day_idx"))


def context_check(panel: DataFrame, options: FeatureOptions) -> DataFrame:
    """Regions with less history than the profile looks back on, or with gaps in the daily index."""
    need = look_back_days(options)
    return panel.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("days"), F.min("day_idx").alias("first_idx"), F.max("day_idx").alias("last_idx"),
    ).select(
        "region_id", "days", F.lit(need).alias("need"), (F.col("days") < need).alias("too_short"),
        (F.col("last_idx") - F.col("first_idx") + 1 != F.col("days")).alias("has_gaps"),
    )


def join_predictions(preds: DataFrame, targets: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Predictions next to their targets, the origin month and, where given, the region's cluster."""
    rows = preds.join(targets, ["region_id", "origin"]).withColumn("origin_month", month_of("origin_date"))
    return rows.join(clusters, "region_id", "left") if clusters is not None else rows


def long_errors(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per (kept keys, horizon) with pred, target and abs_error."""
    pairs = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(p).alias("pred"), F.col(t).alias("target"))
        for h, (p, t) in enumerate(zip(PREDS, TARGETS), 1)])
    return rows.select(*keep, F.explode(pairs).alias("_x")).select(*keep, "_x.*").withColumn(
        "abs_error", F.abs(F.col("pred") - F.col("target")))


def mae_suite(rows: DataFrame, by: Sequence[str] = ("origin", "region_id", "origin_month")) -> DataFrame:
    """Long metric table (metric, key, value): overall, per horizon, per key and per target segment.

    Grouping sets give every breakdown from one pass; the per-key values equal the mean of row MAEs
    because each row has all five horizons.
    """
    long = long_errors(rows, by).withColumn(
        "segment", F.when(F.col("target") == 0, "zero_score").when(F.col("target") > 0, "nonzero_score"))
    long = long.withColumn("high", F.when(F.col("target") >= 3, "high_severity_ge3"))
    dims = ["horizon", *by, "segment", "high"]
    sets = [[]] + [[d] for d in dims]
    grouped = long.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims]).agg(
        F.avg("abs_error").alias("value"), F.grouping_id().alias("_gid"))
    full = (1 << len(dims)) - 1
    names = {"horizon": "mae_by_horizon", "segment": "target_segment_mae", "high": "target_segment_mae"}
    metric, key = F.when(F.col("_gid") == full, "overall_mae"), F.lit("all")
    for i, d in enumerate(dims):
        only = F.col("_gid") == full - (1 << (len(dims) - 1 - i))
        metric = metric.when(only, names.get(d, f"mae_by_{d}"))
        key = F.when(only, F.col(d).cast("string")).otherwise(key)
    return grouped.select(metric.alias("metric"), key.alias("key"), "value").filter(F.col("key").isNotNull())


def value_stats(rows: DataFrame) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of predictions and targets per horizon."""
    long = long_errors(rows, [])
    return long.groupBy("horizon").agg(*[
        f(c).alias(f"{c}_{n}") for c in ("pred", "target")
        for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


def diff_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 1e-6, atol: float = 1e-6) -> DataFrame:
    """Per column: changed rows and largest absolute difference of two keyed tables; NULL equals NULL."""
    a = left.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    b = right.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    both = a.join(b, list(keys), "full")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns])
    long = both.select("_in_a", "_in_b", F.explode(pairs).alias("_p")).select("_in_a", "_in_b", "_p.*")
    gap = F.abs(F.col("a") - F.col("b"))
    one_null = F.col("a").isNull() != F.col("b").isNull()
    missing = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    changed = missing | one_null | F.coalesce(gap > atol + rtol * F.abs(F.col("b")), F.lit(False))
    return long.groupBy("feature").agg(
        F.count_if(changed).alias("changed_rows"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_abs_diff"))


def leakage_sentinel(panel: DataFrame, targets: DataFrame, options: FeatureOptions | None = None, poison: float = 999.0) -> DataFrame:
    """Overwrite the labels that an origin must not see, run the production path and compare; no row may change.

    A day hidden from one origin is history for another, so every (origin, region) gets a history of its own, under
    a name made of both. Masking, statistics and features are those of `pseudo_test_window`.
    """
    options = options or FeatureOptions(region_priors=True)
    name = F.concat_ws("|", "origin", "region_id")
    own = origin_band_join(panel, targets, 0, HISTORY_DAYS - 1)
    rows = own.withColumn("region_id", name).drop("origin", "origin_date", "origin_day_idx")
    hidden = F.col("origin_day_idx") - F.col("day_idx") < GAP_DAYS
    bad = own.withColumn("score", F.when(hidden & F.col("score").isNotNull(), F.lit(poison)).otherwise(F.col("score")))
    bad = bad.withColumn("region_id", name).drop("origin", "origin_date", "origin_day_idx")
    named = targets.withColumn("region_id", name)
    clean, dirty = (pseudo_test_window(x, named, options) for x in (rows, bad))
    names = [c for c, t in clean.dtypes if t in ("double", "int", "bigint") and c not in ("day_idx", "origin_day_idx", "score")]
    return diff_by_key(clean, dirty, ORIGIN_KEYS, names)
