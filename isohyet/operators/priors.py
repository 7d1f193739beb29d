"""Statistics of a chosen slice, one row per region (or region-month), and their joins to the panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.fixed import CLIMATE_COLUMNS, MEASURES, PRIOR_STRENGTH, RECENT_DAYS
from isohyet.functions.blocks import KEYS, spread
from isohyet.functions.dates import month_of
from isohyet.functions.numeric import ratio

PRIOR_STATS = ["mean", "std", "median", "max", "min", "eq0_ratio", "ge1_ratio", "ge3_ratio", "eq5_ratio"]
RECENT_STATS = ["mean", "max", "eq0_ratio", "ge3_ratio"]


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def with_month(df: DataFrame) -> DataFrame:
    return df if "month" in df.columns else df.withColumn("month", month_of())


def climatology(stats_panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and sample deviation of the climate columns per region and month."""
    return with_month(stats_panel).groupBy(*keys, "month").agg(
        *[f(c).alias(f"{c}_clim_{n}") for c in CLIMATE_COLUMNS for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    )


def by_month(table: DataFrame, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fold a (key, month) table into one row per key holding a map with at most twelve entries."""
    values = [c for c in table.columns if c not in (*keys, "month")]
    return table.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("month", F.struct(*values)))).alias(name)
    )


def anomaly_columns(month_map: str = "_climate") -> dict[str, Column]:
    """Climatology of the row's month and the standardised distance to it, read from the folded map."""
    entry = F.try_element_at(F.col(month_map), F.col("month"))
    out: dict[str, Column] = {}
    for c in CLIMATE_COLUMNS:
        mean, std = entry[f"{c}_clim_mean"], entry[f"{c}_clim_std"]
        out |= {f"{c}_clim_mean": mean, f"{c}_clim_std": std, f"{c}_anom": ratio(F.col(c) - mean, std)}
    return out


def climate_anomalies(panel: DataFrame, stats_panel: DataFrame, keys: Sequence[str] = KEYS, block_rows: int | None = None) -> DataFrame:
    side = by_month(climatology(stats_panel, keys), "_climate", keys)
    blocked = spread(with_month(panel), keys=keys, side=side, block_rows=block_rows)
    blocked.temps.append("_climate")
    return blocked.add(anomaly_columns()).done()


def join_climatology(panel: DataFrame, table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Plain left join on (region, month) for tables built elsewhere."""
    return with_month(panel).join(table, [*keys, "month"], "left")


def region_priors(stats_panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Label mean, spread, median, extremes and severity shares; missing statistics become 0."""
    s = F.col("score")
    return stats_panel.filter(s.isNotNull()).groupBy(*keys).agg(
        F.avg(s).alias("region_score_mean"), F.stddev_samp(s).alias("region_score_std"),
        # Labels take few distinct values, so the exact median keeps a small value-to-count map.
        F.median(s).alias("region_score_median"), F.max(s).alias("region_score_max"), F.min(s).alias("region_score_min"),
        _share(s == 0).alias("region_score_eq0_ratio"), _share(s >= 1).alias("region_score_ge1_ratio"),
        _share(s >= 3).alias("region_score_ge3_ratio"), _share(s == 5).alias("region_score_eq5_ratio"),
    ).na.fill(0.0)


def recent_priors(stats_panel: DataFrame, days: Sequence[int] = tuple(RECENT_DAYS), index: str = "day_idx", keys: Sequence[str] = KEYS) -> DataFrame:
    """Label statistics of the last `days` positions; `index` names the position column."""
    labelled = stats_panel.filter(F.col("score").isNotNull())
    last = labelled.groupBy(*keys).agg(F.max(index).alias("_last"))
    blocked = spread(labelled, keys=keys, order=index, side=last)
    blocked.temps.append("_last")
    rows = blocked.add({f"_in{d}": F.col(index) > F.col("_last") - d for d in days}).done()
    s = F.col("score")
    aggs = []
    for d in days:
        inside = F.when(F.col(f"_in{d}"), s)
        name = f"region_score_{{}}_recent_{d}d".format
        aggs += [
            F.avg(inside).alias(name("mean")), F.max(inside).alias(name("max")),
            _share(F.when(F.col(f"_in{d}"), s == 0)).alias(name("eq0_ratio")),
            _share(F.when(F.col(f"_in{d}"), s >= 3)).alias(name("ge3_ratio")),
        ]
    return rows.groupBy(*keys).agg(*aggs).na.fill(0.0)


def smoothed_month_prior(stats_panel: DataFrame, strength: float = PRIOR_STRENGTH, keys: Sequence[str] = KEYS) -> DataFrame:
    """Region-month label mean pulled towards the month mean over all regions."""
    labelled = with_month(stats_panel.filter(F.col("score").isNotNull()))
    # Extra keys such as the origin keep their own month means.
    outer = [k for k in keys if k != "region_id"]
    monthly = labelled.groupBy(*keys, "month").agg(
        F.avg("score").alias("region_month_score_mean"), F.count("score").cast("double").alias("region_month_score_count"),
        F.sum("score").alias("_sum"),
    )
    overall = monthly.groupBy(*outer, "month").agg(
        (F.sum("_sum") / F.sum("region_month_score_count")).alias("_month_mean"))
    n = F.col("region_month_score_count")
    smooth = (F.col("region_month_score_mean") * n + F.col("_month_mean") * strength) / (n + strength)
    # At most twelve rows per origin: safe to broadcast.
    return monthly.join(F.broadcast(overall), [*outer, "month"]).select(
        *keys, "month", "region_month_score_mean", "region_month_score_count", smooth.alias("region_month_score_mean_smooth"))


PRIOR_COLUMNS = (
    [f"region_score_{s}" for s in PRIOR_STATS]
    + [f"region_score_{s}_recent_{d}d" for d in RECENT_DAYS for s in RECENT_STATS]
)
MONTH_PRIOR_COLUMNS = ["region_month_score_mean", "region_month_score_count", "region_month_score_mean_smooth"]


def prior_side(stats_panel: DataFrame, keys: Sequence[str] = KEYS, index: str = "day_idx") -> DataFrame:
    """All label priors folded to one row per region."""
    return join_sides([
        region_priors(stats_panel, keys), recent_priors(stats_panel, index=index, keys=keys),
        by_month(smoothed_month_prior(stats_panel, keys=keys), "_month_prior", keys),
    ], keys)


def join_sides(sides: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys), "full"), sides)


def prior_columns() -> dict[str, Column]:
    entry = F.try_element_at(F.col("_month_prior"), F.col("month"))
    return {c: entry[c] for c in MONTH_PRIOR_COLUMNS}


def add_region_priors(panel: DataFrame, stats_panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join of every prior to the daily rows."""
    blocked = spread(with_month(panel), keys=keys, side=prior_side(stats_panel, keys))
    blocked.temps.append("_month_prior")
    return blocked.add(prior_columns()).done()


def region_profile(panel: DataFrame) -> DataFrame:
    """Mean measures, label mean and zero share per region, missing as 0; input of the clusters."""
    return panel.groupBy("region_id").agg(
        *[F.avg(c).alias(c) for c in MEASURES], F.avg("score").alias("score_mean"),
        _share(F.col("score") == 0).alias("score_zero_ratio"),
    ).na.fill(0.0)
