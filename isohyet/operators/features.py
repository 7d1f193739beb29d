"""Per-region feature families over the daily panel.

A `Family` states the row columns, trailing frames, lags, recursive means and closing arithmetic it
needs; `compose` runs any number of families over one spread of the panel, so that all of them share
a single shuffle and sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.fixed import (
    DRY_BELOW, GAP_DAYS, HEAT_COUNT_WINDOWS, HEAT_SUM_WINDOWS, HEAVY_FROM, HOT_FROM, INSTABILITY_WINDOWS, MEASURES,
    MOMENTUM_DAYS, RAIN_FROM, STREAK_WINDOWS, VAPOR_WINDOWS, VERY_HOT_FROM,
)
from isohyet.functions.blocks import BLOCK_ROWS, KEYS, OWN, Roll, ewm_look_back, one_block, spread
from isohyet.functions.numeric import flag, ratio


@dataclass
class Family:
    rows: dict[str, Column] = field(default_factory=dict)      # row-level columns that stay
    inputs: dict[str, Column] = field(default_factory=dict)    # row-level columns only windows read
    known: dict[str, str] = field(default_factory=dict)        # temp name -> source, forward filled
    streak: dict[str, str] = field(default_factory=dict)       # temp name -> 0/1 input column
    lags: dict[str, tuple[str, int]] = field(default_factory=dict)
    rolls: list[Roll] = field(default_factory=list)
    ewm: dict[str, tuple[str, int]] = field(default_factory=dict)
    post: dict[str, Column] = field(default_factory=dict)      # arithmetic over the columns above
    hidden: list[str] = field(default_factory=list)            # columns to drop at the end

    def look_back(self) -> int:
        return max(
            [k for _, k in self.lags.values()] + [r.hi + 1 for r in self.rolls]
            + [ewm_look_back(s for _, s in self.ewm.values())] + [0]
        )

    def carried(self) -> set[str]:
        return set(self.known.values()) | {s for s, _ in self.ewm.values()} | {f"_stop_{s}" for s in self.streak.values()}


def compose(
    panel: DataFrame, families: Sequence[Family], keys: Sequence[str] = KEYS, side: DataFrame | None = None,
    block_rows: int | None = None, tail: dict[str, Column] | None = None, last_only: Column | None = None, days_of: str | None = None,
    late: DataFrame | None = None, dress: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run all families over one spread of the panel.

    `tail` columns may read `side` columns; `last_only` keeps the rows where it holds. `days_of` names a column without which
    a day is not wanted: such days may be left out, and are before the wide rows go on. `late` is a side that only `tail`
    reads; it meets the rows that `last_only` or `days_of` keep. `dress` adds columns to these rows that no window reads.
    """
    if late is not None and last_only is None and not one_block(panel, "day_idx", block_rows or BLOCK_ROWS):
        # A long region keeps many rows, so its statistics are joined block by block.
        late, side = None, late if side is None else side.join(late, list(keys), "full")
    rows, inputs = {}, {}
    for f in families:
        rows.update(f.rows)
        inputs.update(f.inputs)
    df = panel.withColumns(rows) if rows else panel
    stops = {f"_stop_{s}": F.when(F.col(s) == 0, F.col("day_idx")) for f in families for s in f.streak.values()}
    df = df.withColumns(inputs) if inputs else df
    df = df.withColumns(stops) if stops else df
    blocked = spread(
        df, max((f.look_back() for f in families), default=0), keys=keys, side=side,
        carry=sorted(set().union(*[f.carried() for f in families])) if families else (),
        carry_start=bool(stops), block_rows=block_rows,
    )
    blocked.temps += [*inputs, *stops]
    blocked.add({n: blocked.last_known(s) for f in families for n, s in f.known.items()}, temp=True)
    blocked.add({
        n: F.col("day_idx") - F.coalesce(blocked.last_known(f"_stop_{s}"), blocked.start() - 1)
        for f in families for n, s in f.streak.items()
    }, temp=True)
    blocked.trailing(
        rolls=[r for f in families for r in f.rolls], ewm={n: v for f in families for n, v in f.ewm.items()},
        lags={n: v for f in families for n, v in f.lags.items()}, days_of=days_of,
        only=F.col(OWN) & last_only if last_only is not None else None, spent=[*inputs, *stops])
    if last_only is not None:
        blocked.df = blocked.df.filter(F.col(OWN) & last_only)
    if dress is not None:
        held, dressed = blocked.df.columns, dress(blocked.df)
        # Where they would be without windows: after the panel's own columns.
        blocked.df = dressed.select(*panel.columns, *[c for c in dressed.columns if c not in held], *[c for c in held if c not in panel.columns])
    if late is not None:
        blocked.df = blocked.df.join(late, list(keys), "left")
        blocked.temps += [c for c in late.columns if c not in keys]
    for f in families:
        blocked.add(f.post)
        blocked.temps += f.hidden
    if tail:
        blocked.add(tail)
    if side is not None:
        blocked.temps += [c for c in side.columns if c not in keys]
    return blocked.done()


# -- families ---------------------------------------------------------------------------------


def lag_family(columns: Sequence[str], days: Sequence[int]) -> Family:
    return Family(lags={f"{c}_lag{k}": (c, k) for c in columns for k in days})


def rolling_family(columns: Sequence[str], windows: Sequence[int], fns: Sequence[str] = ("mean", "std")) -> Family:
    return Family(rolls=[Roll(f"{c}_r{fn}{w}", c, fn, w) for c in columns for w in windows for fn in fns])


def ewm_family(columns: Sequence[str], spans: Sequence[int]) -> Family:
    return Family(ewm={f"{c}_ewm{s}": (c, s) for c in columns for s in spans})


def long_family(windows: Sequence[int]) -> Family:
    """Rain totals, dry and hot day counts, long mean temperature and their quotient."""
    return Family(
        inputs={"_dry": flag(F.col("prec") < DRY_BELOW), "_hot": flag(F.col("tmp_max") >= HOT_FROM)},
        rolls=[r for w in windows for r in (
            Roll(f"prec_sum{w}", "prec", "sum", w), Roll(f"dry_days{w}", "_dry", "sum", w),
            Roll(f"hot_days{w}", "_hot", "sum", w), Roll(f"tmp_mean_long{w}", "tmp", "mean", w),
        )],
        post={f"long_drought_idx{w}": ratio(F.col(f"tmp_mean_long{w}"), F.col(f"prec_sum{w}") + 0.1) for w in windows},
    )


def domain_family(windows: Sequence[int], available: Sequence[str]) -> Family:
    """Indices over rolling means; an index is left out when one of its inputs is."""
    recipes = {
        "drought_idx_r": (("tmp", "prec"), lambda a, b: ratio(a, b + 0.01)),
        "dryness_idx_r": (("tmp_range", "tmp_max"), lambda a, b: a * b),
        "heat_humidity_idx_r": (("tmp_max", "humidity"), lambda a, b: a - b),
        "dewpoint_spread_r": (("tmp", "dp_tmp"), lambda a, b: a - b),
        "wetbulb_spread_r": (("tmp", "wb_tmp"), lambda a, b: a - b),
    }
    return Family(post={
        f"{name}{w}": formula(F.col(f"{x}_rmean{w}"), F.col(f"{y}_rmean{w}"))
        for w in windows for name, ((x, y), formula) in recipes.items() if x in available and y in available
    })


def streak_family(windows: Sequence[int] = tuple(STREAK_WINDOWS)) -> Family:
    """Dry days in a row before today and the longest such run in the last w days."""
    return Family(
        inputs={"_dry": flag(F.col("prec") < DRY_BELOW)},
        streak={"_streak": "_dry"},
        lags={"_before": ("_streak", 1)},
        rolls=[Roll(f"_run{w}", "_streak", "max", w) for w in windows],
        post={
            "consecutive_dry_days": F.coalesce(F.col("_before"), F.lit(0)).cast("double"),
            **{f"cdd_rolling{w}": F.coalesce(F.col(f"_run{w}"), F.lit(0)).cast("double") for w in windows},
        },
        hidden=["_before", *[f"_run{w}" for w in windows]],
    )


def heat_family() -> Family:
    return Family(
        inputs={
            "_vhot": flag(F.col("tmp_max") >= VERY_HOT_FROM),
            "_excess": F.when(F.col("tmp_max").isNotNull(), F.greatest(F.col("tmp_max") - HOT_FROM, F.lit(0.0))),
        },
        rolls=[Roll(f"hot_days_above35_{w}d", "_vhot", "sum", w) for w in HEAT_COUNT_WINDOWS]
        + [Roll(f"heat_stress_sum_{w}d", "_excess", "sum", w) for w in HEAT_SUM_WINDOWS],
    )


def instability_family() -> Family:
    return Family(rolls=[Roll(f"{c}_std_{w}d", c, "std", w) for c in ("tmp_range", "wind") for w in INSTABILITY_WINDOWS])


def vapor_family() -> Family:
    means = {
        "surf_air_temp_diff": "surf_air_diff_mean", "dew_point_depression": "dew_depression_mean",
        "wet_bulb_depression": "wet_bulb_depression_mean",
    }
    return Family(
        rows={
            "surf_air_temp_diff": F.col("surf_tmp") - F.col("tmp"),
            "dew_point_depression": F.col("tmp") - F.col("dp_tmp"),
            "wet_bulb_depression": F.col("tmp") - F.col("wb_tmp"),
        },
        rolls=[Roll(f"{out}_{w}d", c, "mean", w) for c, out in means.items() for w in VAPOR_WINDOWS],
    )


def label_family(lags: Sequence[int], windows: Sequence[int], gap: int = GAP_DAYS) -> Family:
    """Label history as it is visible `gap` days later: lags, statistics and their differences."""
    now, stat = F.col("last_known_score"), "score_gap_mean{}d"
    post = {
        "score_velocity_1w": now - F.col("_known_7"),
        **{f"score_momentum_{d}d": now - F.col(f"_known_{d}") for d in MOMENTUM_DAYS},
    }
    for name, (near, far) in {"score_gap_trend_4w_26w": (28, 182), "score_gap_trend_13w_52w": (91, 365)}.items():
        if near in windows and far in windows:
            post[name] = F.col(stat.format(near)) - F.col(stat.format(far))
    return Family(
        known={"_known": "score"},
        lags={
            "last_known_score": ("_known", gap),
            **{f"_known_{d}": ("_known", gap + d) for d in (7, *MOMENTUM_DAYS)},
            **{f"score_gap_lag{k}w": ("_known", gap + 7 * k) for k in lags},
        },
        rolls=[Roll(f"score_gap_{fn}{w}d", "score", fn, gap + w - 1, gap) for w in windows for fn in ("mean", "std", "max")],
        post=post,
        hidden=[f"_known_{d}" for d in (7, *MOMENTUM_DAYS)],
    )


# -- operators over one family ------------------------------------------------------------------


def lags(panel: DataFrame, columns: Sequence[str], days: Sequence[int], **kw) -> DataFrame:
    return compose(panel, [lag_family(columns, days)], **kw)


def rolling(panel: DataFrame, columns: Sequence[str], windows: Sequence[int], fns: Sequence[str], **kw) -> DataFrame:
    return compose(panel, [rolling_family(columns, windows, fns)], **kw)


def ewm(panel: DataFrame, columns: Sequence[str], spans: Sequence[int], **kw) -> DataFrame:
    return compose(panel, [ewm_family(columns, spans)], **kw)


def daily_derived(df: DataFrame) -> DataFrame:
    """Flags and simple differences of one day; unknown inputs give 0 for flags, NULL for differences."""
    c = F.col
    return df.withColumns({
        "dry_day": flag(c("prec") < DRY_BELOW), "rain_day_ge_1": flag(c("prec") >= RAIN_FROM),
        "heavy_precip_ge_10": flag(c("prec") >= HEAVY_FROM),
        "dew_point_depression": c("tmp") - c("dp_tmp"), "wet_bulb_depression": c("tmp") - c("wb_tmp"),
        "surf_air_temp_diff": c("surf_tmp") - c("tmp"), "dryness_idx_daily": c("tmp_range") * c("tmp_max"),
        "heat_humidity_idx_daily": c("tmp_max") - c("humidity"),
    })


def rolling_flag_counts(panel: DataFrame, windows: Sequence[int], **kw) -> DataFrame:
    """Dry, rainy and hot days, days of history and the dry share in the last w days."""
    flags = {
        "_dry": flag(F.col("prec") < DRY_BELOW), "_rain": flag(F.col("prec") >= RAIN_FROM),
        "_hot": flag(F.col("tmp_max") >= HOT_FROM), "_vhot": flag(F.col("tmp_max") >= VERY_HOT_FROM),
        "_one": F.lit(1.0),
    }
    names = {"_dry": "dry_days", "_rain": "rain_days", "_hot": "hot_days", "_vhot": "hot_days_above35", "_one": "hist_days"}
    return compose(panel, [Family(
        inputs=flags,
        rolls=[Roll(f"{out}_{w}d", s, "sum", w) for s, out in names.items() for w in windows],
        post={f"dry_share_{w}d": ratio(F.col(f"dry_days_{w}d"), F.col(f"hist_days_{w}d")) for w in windows},
    )], **kw)


def dry_streak(panel: DataFrame, mode: str = "trailing", **kw) -> DataFrame:
    """Runs of dry days.  `trailing` looks back only; `region_max` repeats the region's longest run."""
    if mode == "trailing":
        return compose(panel, [streak_family()], **kw)
    keys = tuple(kw.get("keys", KEYS))
    runs = compose(panel, [Family(
        inputs={"_dry": flag(F.col("prec") < DRY_BELOW)}, streak={"_streak": "_dry"},
        post={"_run": F.col("_streak")},
    )], **kw)
    longest = runs.groupBy(*keys).agg(
        F.max("_run").cast("double").alias("consecutive_dry_days"), F.min("day_idx").alias("_first_day")
    )
    joined = spread(panel, keys=keys, side=longest, block_rows=kw.get("block_rows"))
    joined.temps.append("_first_day")
    before = F.when(F.col("day_idx") > F.col("_first_day"), F.col("consecutive_dry_days"))
    return joined.add({f"cdd_rolling{w}": before for w in STREAK_WINDOWS}).done()


def max_dry_streak(panel: DataFrame, window: int = 90, **kw) -> DataFrame:
    """Longest run of dry days that ended on one of the last `window` days before today."""
    out = compose(panel, [streak_family([window])], **kw)
    return out.withColumnsRenamed({"consecutive_dry_days": "dry_streak_before", f"cdd_rolling{window}": f"max_dry_streak_{window}d"})


def heat_stress(panel: DataFrame, **kw) -> DataFrame:
    return compose(panel, [heat_family()], **kw)


def instability(panel: DataFrame, **kw) -> DataFrame:
    return compose(panel, [instability_family()], **kw)


def vapor_proxies(panel: DataFrame, **kw) -> DataFrame:
    return compose(panel, [vapor_family()], **kw)


def domain_indices(panel: DataFrame, windows: Sequence[int], **kw) -> DataFrame:
    columns = ["prec", "humidity", "tmp", "dp_tmp", "wb_tmp", "tmp_max", "tmp_range"]
    return compose(panel, [rolling_family(columns, windows, ["mean"]), domain_family(windows, columns)], **kw)


def long_drought(panel: DataFrame, windows: Sequence[int], **kw) -> DataFrame:
    return compose(panel, [long_family(windows)], **kw)


def gapped_labels(panel: DataFrame, lag_weeks: Sequence[int], windows: Sequence[int], gap: int = GAP_DAYS, **kw) -> DataFrame:
    return compose(panel, [label_family(lag_weeks, windows, gap)], **kw)


def shifted_context(train: DataFrame, test: DataFrame, **kw) -> DataFrame:
    """Daily and 30/90/180-day columns of the drift comparison, with test days seeing train history."""
    return context_columns(train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")), allowMissingColumns=True), **kw)


def context_columns(both: DataFrame, **kw) -> DataFrame:
    """The columns of `shifted_context` for train and test in one table; its other columns stay."""
    both = daily_derived(both)
    inputs = {"_hot": flag(F.col("tmp_max") >= HOT_FROM), "_one": F.lit(1.0)}
    rolls = [r for w in (30, 90, 180) for r in (
        Roll(f"prec_sum_{w}d", "prec", "sum", w), Roll(f"dry_days_{w}d", "dry_day", "sum", w),
        Roll(f"hist_days_{w}d", "_one", "sum", w))]
    rolls += [Roll("rain_days_90d", "rain_day_ge_1", "sum", 90), Roll("hot_days_90d", "_hot", "sum", 90)]
    rolls += [Roll(f"{out}_90d", c, "mean", 90) for c, out in {
        "tmp": "tmp_mean", "humidity": "humidity_mean", "dew_point_depression": "dew_depression_mean",
        "wet_bulb_depression": "wet_bulb_depression_mean"}.items()]
    longest = streak_family([90])
    longest.post = {"max_dry_streak_90d": F.coalesce(F.col("_run90"), F.lit(0)).cast("double")}
    return compose(both, [
        Family(inputs=inputs, rolls=rolls, post={
            "dry_share_90d": ratio(F.col("dry_days_90d"), F.col("hist_days_90d")),
            "rolling_drought_idx_90d": ratio(F.col("tmp_mean_90d"), F.col("prec_sum_90d") + 0.1),
        }),
        longest,
    ], **kw)


def impute(panel: DataFrame, columns: Sequence[str] = tuple(MEASURES), mode: str = "ffill", medians: DataFrame | None = None,
           keys: Sequence[str] = KEYS, block_rows: int | None = None) -> DataFrame:
    """Fill gaps inside a region: last known value, then (mode `ffill_bfill`) the next, then the median, then 0.

    `medians` is a one-row table of column medians from the statistics slice.
    """
    known = spread(panel, keys=keys, carry=columns, block_rows=block_rows)
    known.add({f"_fill_{c}": known.last_known(c) for c in columns})
    filled = known.done()
    filled = filled.withColumns({c: F.col(f"_fill_{c}") for c in columns}).drop(*[f"_fill_{c}" for c in columns])
    if mode == "ffill_bfill":
        # After the forward fill only the days before a region's first value are empty.
        first = panel.groupBy(*keys).agg(
            *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("day_idx"))).alias(f"_first_{c}") for c in columns])
        joined = spread(filled, keys=keys, side=first, block_rows=block_rows)
        filled = joined.done().withColumns({c: F.coalesce(c, f"_first_{c}") for c in columns})
        filled = filled.drop(*[f"_first_{c}" for c in columns])
    elif mode != "ffill":
        raise ValueError(f"unknown mode {mode!r}")
    if medians is None:
        return filled.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})
    row = medians.select(*columns).first()
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(row[c]).cast("double"), F.lit(0.0)) for c in columns})
