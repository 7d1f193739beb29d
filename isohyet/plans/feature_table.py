"""The wide feature table: every family over one spread of the panel."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.fixed import FEATURE_GROUPS, GAP_DAYS, LONGEST_FIXED_WINDOW, PROFILES
from isohyet.functions.blocks import KEYS
from isohyet.functions.dates import calendar_features, parse_synthetic_date
from isohyet.operators import features as ft
from isohyet.operators import priors


@dataclass
class FeatureOptions:
    profile: str = "micro"
    gap: int = GAP_DAYS
    labels: bool = True
    climatology: bool = True
    region_priors: bool = False
    max_label_lag_weeks: int | None = None
    drop_groups: Sequence[str] = field(default_factory=tuple)
    streak_mode: str = "trailing"
    prior_index: str = "day_idx"
    single_precision: bool = False

    def windows(self) -> dict:
        profile = dict(PROFILES[self.profile])
        if self.max_label_lag_weeks:
            profile["label_lags"] = [k for k in profile["label_lags"] if k <= self.max_label_lag_weeks]
        return profile


def look_back_days(options: FeatureOptions) -> int:
    """Days of history a row needs before every feature of the profile is filled."""
    p = options.windows()
    reach = [LONGEST_FIXED_WINDOW, *p["lags"], *p["rolls"], *p["domain"], *p["long"], *p["spans"]]
    if options.labels:
        reach += [options.gap + 7 * k for k in p["label_lags"]] + [options.gap + w for w in p["label_windows"]]
    return max(reach)


def families(options: FeatureOptions) -> list[ft.Family]:
    p = options.windows()
    out = [
        ft.heat_family(), ft.instability_family(), ft.vapor_family(), ft.lag_family(p["columns"], p["lags"]),
        ft.rolling_family(p["columns"], p["rolls"]), ft.ewm_family(p["columns"], p["spans"]),
        ft.domain_family(p["domain"], p["columns"]), ft.long_family(p["long"]),
    ]
    if options.streak_mode == "trailing":
        out.insert(0, ft.streak_family())
    if options.labels:
        out.append(ft.label_family(p["label_lags"], p["label_windows"], options.gap))
    return _wanted(out, options.drop_groups)


def _wanted(found: list[ft.Family], groups: Sequence[str]) -> list[ft.Family]:
    """Families of which a column stays when `groups` are dropped, or whose frames such a family reads."""
    rules = [FEATURE_GROUPS[g] for g in groups if g in FEATURE_GROUPS and g != "region_id"]

    def stays(f: ft.Family) -> bool:
        shown = [c for c in (*f.rows, *[r.name for r in f.rolls], *f.lags, *f.ewm, *f.post) if c not in f.hidden]
        return not shown or any(not any(re.search(rule, c) for rule in rules) for c in shown)

    # Only arithmetic reads the frames of another family, and it has none of its own.
    reads = any(stays(f) and f.post and not (f.rolls or f.lags) for f in found)
    return [f for f in found if stays(f) or (reads and f.rolls and not f.post)] if rules else found


def feature_columns(df: DataFrame) -> list[str]:
    """Columns a model may read: no keys, dates, labels, targets or helper columns."""
    skip = {"region_id", "date", "score", "day_idx", "origin", "split", "year", "day", "week_idx", "max_week_idx"}
    return [c for c in df.columns if c not in skip and not c.startswith(("_", "target_"))]


def drop_groups(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Remove feature groups by their column-name rule; the key itself is never dropped."""
    unknown = sorted(set(groups) - set(FEATURE_GROUPS))
    if unknown:
        raise ValueError(f"unknown feature groups: {', '.join(unknown)}")
    rules = [FEATURE_GROUPS[g] for g in groups if g != "region_id"]
    return df.drop(*[c for c in df.columns if any(re.search(rule, c) for rule in rules)])


def build_features(
    panel: DataFrame, stats_panel: DataFrame, options: FeatureOptions | None = None, keys: Sequence[str] = KEYS,
    block_rows: int | None = None, last_only: bool = False, days_of: str | None = None,
) -> DataFrame:
    """All features of a profile for every daily row; statistics come from `stats_panel` only.

    `last_only` keeps each region's last row; the windows still see the whole history. `days_of` names a column: days without
    a value of it may be left out.
    """
    options = options or FeatureOptions()
    def dress(df: DataFrame) -> DataFrame:
        return calendar_features(parse_synthetic_date(df))

    few = last_only or days_of is not None
    base = panel if few else dress(panel)
    if options.streak_mode == "region_max":
        base = ft.dry_streak(base, mode="region_max", keys=keys, block_rows=block_rows)
    sides, tail = [], {}
    if options.climatology:
        sides.append(priors.by_month(priors.climatology(stats_panel, keys), "_climate", keys))
        tail |= priors.anomaly_columns()
    if options.region_priors:
        sides.append(priors.prior_side(stats_panel, keys, options.prior_index))
        tail |= priors.prior_columns()
    side, late = priors.join_sides(sides, keys) if sides else None, None
    if few:
        # Statistics and the calendar meet the rows that stay, so the others do not carry them through the windows.
        side, late = panel.groupBy(*keys).agg(F.max("day_idx").alias("_last_day")) if last_only else None, side
    if options.region_priors:
        tail |= {f"_keep_{c}": F.col(c) for c in priors.PRIOR_COLUMNS}
    out = ft.compose(base, families(options), keys=keys, side=side, block_rows=block_rows, tail=tail, days_of=days_of, late=late, dress=dress if few else None,
                     last_only=F.col("day_idx") == F.col("_last_day") if last_only else None)
    out = out.withColumnsRenamed({f"_keep_{c}": c for c in priors.PRIOR_COLUMNS if options.region_priors})
    out = drop_groups(out, options.drop_groups)
    if options.single_precision:
        out = out.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
    return out
