"""Weekly supervised samples: labels with lead targets, filters, splits and weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.fixed import GAP_DAYS, HORIZONS, MEASURES
from isohyet.functions.blocks import BLOCK, BLOCK_ROWS, KEYS, OWN, Blocked, one_block, running_state, spread, with_position
from isohyet.functions.dates import month_day_code, parse_synthetic_date
from isohyet.functions.numeric import finite_or_null
from isohyet.operators.priors import with_month

TARGETS = [f"target_w{h}" for h in range(1, HORIZONS + 1)]


def labelled_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("score").isNotNull())


def row_index(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Labelled rows with their week position and the region's last week position."""
    return _with_last_week(with_position(labelled_rows(panel), "week_idx", keys), keys).done()


def _with_last_week(weekly: DataFrame, keys: Sequence[str], look_ahead: int = 0, block_rows: int | None = None) -> Blocked:
    """Weekly rows in blocks, with the last week position of their region."""
    if one_block(weekly, "week_idx", block_rows or BLOCK_ROWS):
        blocked = spread(weekly, look_ahead=look_ahead, keys=keys, order="week_idx", block_rows=block_rows)
        return blocked.add({"max_week_idx": F.max("week_idx").over(Window.partitionBy(*keys))})
    last = weekly.groupBy(*keys).agg(F.max("week_idx").alias("max_week_idx"))
    return spread(weekly, look_ahead=look_ahead, keys=keys, order="week_idx", side=last, block_rows=block_rows)


def lead_targets(panel: DataFrame, complete: bool = True, keys: Sequence[str] = KEYS, block_rows: int | None = None) -> DataFrame:
    """Labels of the next five weeks; incomplete rows go after the last week position is known."""
    weekly = with_position(labelled_rows(panel), "week_idx", keys, block_rows=block_rows)
    blocked = _with_last_week(weekly, keys, HORIZONS, block_rows)
    out = blocked.add({t: F.lead("score", h).over(blocked.window) for h, t in enumerate(TARGETS, 1)}).done()
    return out.dropna(subset=TARGETS) if complete else out


def labels_join_features(samples: DataFrame, features: DataFrame) -> DataFrame:
    """Features of the sample day, joined once for all horizons."""
    shared = [c for c in features.columns if c in samples.columns and c not in ("region_id", "date")]
    return samples.join(features.drop(*shared), ["region_id", "date"], "left")


def feature_ready(df: DataFrame, columns: Sequence[str]) -> Column:
    """True where every feature is present and finite."""
    ready = F.lit(True)
    for c in columns:
        ready = ready & finite_or_null(F.col(c).cast("double")).isNotNull()
    return ready


def feature_ready_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ready = feature_ready(df, columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ready).alias("kept"), F.count_if(~ready).alias("dropped"))


def tail_per_region(df: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last n daily rows per region (0 keeps all), by distance to the region's last position."""
    return _by_distance(df, lambda age: age < n, keys) if n > 0 else df


def before_tail(df: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The rows that `tail_per_region` leaves out."""
    return _by_distance(df, lambda age: age >= n, keys)


def _by_distance(df: DataFrame, wanted: Callable[[Column], Column], keys: Sequence[str]) -> DataFrame:
    last = df.groupBy(*keys).agg(F.max("day_idx").alias("_last"))
    blocked = spread(df, keys=keys, side=last)
    blocked.temps.append("_last")
    blocked.df = blocked.df.filter(wanted(F.col("_last") - F.col("day_idx")))
    return blocked.done()


def date_rank(df: DataFrame) -> DataFrame:
    """Zero-based rank of each distinct (year, month, day) over the whole table, plus the largest rank."""
    dates = df.select("year", "month", "day").distinct().withColumn("_all", F.lit(0))
    per_year = dates.groupBy("_all", "year").agg(F.count(F.lit(1)).alias("_n"))
    ends = running_state(per_year, ["_all"], "year", sums=["_n"]).withColumnRenamed("_n", "_end")
    starts = ends.join(per_year, ["_all", "year"]).select("_all", "year", (F.col("_end") - F.col("_n")).alias("_start"))
    inner = Window.partitionBy("_all", "year").orderBy("month", "day")
    ranked = dates.join(starts, ["_all", "year"]).select(
        "year", "month", "day", (F.col("_start") + F.row_number().over(inner) - 1).cast("int").alias("date_rank"))
    return df.join(ranked, ["year", "month", "day"])


def _largest(df: DataFrame, column: str) -> Column:
    """The largest value as a scalar subquery: part of the plan, no job of its own."""
    return df.agg(F.max(column)).scalar()


def recent_filter(samples: DataFrame, recent_days: int) -> DataFrame:
    """Samples whose date rank lies within the last recent_days/7 ranks."""
    ranked = date_rank(samples)
    if recent_days <= 0:
        return ranked
    return ranked.filter(F.col("date_rank") >= _largest(ranked, "date_rank") - max(1, int(recent_days / 7)))


def holdout_split(samples: DataFrame, horizon: int) -> DataFrame:
    """Last fifth of each region's weeks validates; training stops before its targets reach it."""
    start = F.floor(F.col("max_week_idx") * 0.8).cast("int")
    return samples.withColumns({"is_train": F.col("week_idx") + horizon < start, "is_val": F.col("week_idx") >= start})


def fold_offsets(folds: int) -> list[int]:
    return [int(v) for v in np.linspace(folds + HORIZONS - 1, HORIZONS, folds).round()]


def rolling_origin_split(samples: DataFrame, folds: int, horizon: int) -> DataFrame:
    """One copy per fold: the sample at max_week_idx - offset validates, purged earlier ones train."""
    fold = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(o).alias("offset")) for i, o in enumerate(fold_offsets(folds))]))
    at = F.col("max_week_idx") - F.col("offset")
    return samples.select("*", fold.alias("_f")).select("*", "_f.*").drop("_f").withColumns({
        "is_train": F.col("week_idx") + horizon < at, "is_val": F.col("week_idx") == at})


def expanding_date_split(samples: DataFrame, n: int) -> DataFrame:
    """Global date cuts with a growing training part: one copy per fold in which a row takes part."""
    ranked = date_rank(samples)
    last = _largest(ranked, "date_rank")
    ranked = ranked.withColumn("_last", last)
    size = F.floor((F.col("_last") + 1) / (n + 1)).cast("int")
    folds = F.array(*[
        F.struct(F.lit(i).alias("fold"), (size * (i + 1)).alias("cut"), F.least(size * (i + 2), F.col("_last")).alias("stop")) for i in range(n)])
    rows = ranked.select("*", F.explode(folds).alias("_f")).select("*", "_f.*").drop("_f", "_last")
    rank = F.col("date_rank")
    return rows.withColumns({
        "is_train": rank < F.col("cut"), "is_val": (rank >= F.col("cut")) & (rank < F.col("stop")),
    }).filter(F.col("is_train") | F.col("is_val"))


def sequence_split(samples: DataFrame, val_weeks: int, purge_weeks: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last `val_weeks` samples of a region validate, `purge_weeks` before them are unused."""
    ranked = with_position(samples, "sample_rank", keys, order="week_idx")
    last = ranked.groupBy(*keys).agg(F.max("sample_rank").alias("max_sample_rank"))
    joined = spread(ranked, keys=keys, order="sample_rank", side=last).done()
    start = F.greatest(F.lit(0), F.col("max_sample_rank") - max(0, val_weeks - 1))
    return joined.withColumns({
        "is_val": F.col("sample_rank") >= start, "is_train": F.col("sample_rank") + purge_weeks < start})


def require_both_sides(split: DataFrame) -> DataFrame:
    """Fail on an empty training or validation part."""
    row = split.agg(F.count_if("is_train").alias("t"), F.count_if("is_val").alias("v")).first()
    if not row.t or not row.v:
        raise ValueError("empty train or validation part: use more rows or fewer validation weeks")
    return split


def _normalised(df: DataFrame, raw: str) -> DataFrame:
    mean = df.agg(F.avg(raw)).scalar()
    return df.withColumn("weight", F.least(F.lit(20.0), F.greatest(F.lit(0.05), F.col(raw) / mean))).drop(raw)


def recency_weights(samples: DataFrame, half_life_days: float, mode: str = "region") -> DataFrame:
    """0.5^(age/half-life) over its mean, clipped to 0.05-20; age per region or by global date rank."""
    if mode == "region":
        aged = samples.withColumn("_age", (F.col("max_week_idx") - F.col("week_idx")) * 7.0)
    else:
        ranked = date_rank(samples)
        aged = ranked.withColumn("_age", (_largest(ranked, "date_rank") - F.col("date_rank")) * 7.0)
    return _normalised(aged.withColumn("_raw", F.pow(F.lit(0.5), F.col("_age") / half_life_days)).drop("_age"), "_raw")


def season_keys(test: DataFrame) -> DataFrame:
    return parse_synthetic_date(test).select("region_id", month_day_code().alias("md")).distinct()


def season_match(df: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of `df` (with year, month, day) whose region and month-day occur in the test window."""
    return df.withColumn("md", month_day_code()).join(season_keys(test), ["region_id", "md"], "left_semi")


def season_weights(weighted: DataFrame, test: DataFrame, multiplier: float) -> DataFrame:
    """Multiply the weight of season matches, renormalise and clip; unchanged when nothing matches."""
    marked = weighted.withColumn("md", month_day_code()).join(
        season_keys(test).withColumn("_match", F.lit(True)), ["region_id", "md"], "left")
    hit = F.coalesce(F.col("_match"), F.lit(False))
    marked = marked.withColumn("season_match", hit).withColumn("_raw", F.col("weight") * F.when(hit, multiplier).otherwise(1.0)).drop("_match")
    # Without a match the given weights stay as they are.
    some = marked.agg(F.max("season_match")).scalar()
    return _normalised(marked.withColumnRenamed("weight", "_given"), "_raw").withColumn("weight", F.when(some, F.col("weight")).otherwise(F.col("_given"))).drop("_given")


def final_row(df: DataFrame, mode: str = "last_row", keys: Sequence[str] = KEYS) -> DataFrame:
    """Last row of each region; `last_non_null` takes the last known value column by column."""
    if mode == "last_row":
        return tail_per_region(df, 1, keys)
    if mode != "last_non_null":
        raise ValueError(f"unknown mode {mode!r}")
    return df.groupBy(*keys).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("day_idx"))).alias(c) for c in df.columns if c not in keys])


def visible_label_priors(panel: DataFrame, fallback: float, gap: int = GAP_DAYS, keys: Sequence[str] = KEYS, block_rows: int | None = None) -> DataFrame:
    """Label statistics visible at every labelled day: only labels at least `gap` days older count.

    `fallback` (the global label median) stands in where nothing is visible.
    """
    s = F.col("score")
    rows = with_month(labelled_rows(panel)).select(*keys, "day_idx", "month", "score").withColumns({
        "_n": F.lit(1), "_sq": s * s, "_zero": (s == 0).cast("int"), "_high": (s >= 3).cast("int")})

    def frames(blocked, prefix: str, columns: Sequence[str]) -> dict[str, Column]:
        past = blocked.window.rangeBetween(Window.unboundedPreceding, -gap)
        return {f"{prefix}{c}": F.coalesce(F.sum(c).over(past), F.lit(0)) + F.coalesce(F.col(f"_before_{c}"), F.lit(0)) for c in columns}

    total = ["_n", "score", "_sq", "_zero", "_high"]
    blocked = spread(rows, gap + 729, keys=keys, carry_sum=total, carry_max=["score"], block_rows=block_rows)
    past = blocked.window.rangeBetween(Window.unboundedPreceding, -gap)
    blocked.add(frames(blocked, "v", total) | {"vmax": F.greatest(F.max("score").over(past), F.col("_peak_score"))})
    for d in (365, 730):
        recent = blocked.window.rangeBetween(-gap - d + 1, -gap)
        blocked.add({f"r{d}_mean": F.avg("score").over(recent), f"r{d}_zero": F.avg("_zero").over(recent), f"r{d}_high": F.avg("_high").over(recent)})
    first = blocked.done()

    monthly = spread(rows.select(*keys, "month", "day_idx", "_n", "score"), gap, keys=[*keys, "month"], carry_sum=["_n", "score"], block_rows=block_rows)
    monthly.add(frames(monthly, "m", ["_n", "score"]))
    by_month = monthly.done(keep=[*keys, "day_idx", "m_n", "mscore"])

    g = float(fallback)
    seen = F.col("v_n") > 0
    mean = F.col("vscore") / F.nullif(F.col("v_n"), F.lit(0))
    var = F.greatest(F.lit(0.0), F.col("v_sq") / F.nullif(F.col("v_n"), F.lit(0)) - mean * mean)

    def share(name: str) -> Column:
        return F.col(name) / F.nullif(F.col("v_n"), F.lit(0))

    zero, high = float(g == 0), float(g >= 3)
    return first.join(by_month, [*keys, "day_idx"]).select(
        *keys, "day_idx", "score",
        F.coalesce(mean, F.lit(g)).alias("visible_score_mean"), F.when(seen, F.sqrt(var)).otherwise(0.0).alias("visible_score_std"),
        F.coalesce(F.col("vmax"), F.lit(g)).alias("visible_score_max"),
        F.coalesce(share("v_zero"), F.lit(zero)).alias("visible_score_eq0_ratio"),
        F.coalesce(share("v_high"), F.lit(high)).alias("visible_score_ge3_ratio"),
        F.coalesce("r365_mean", F.lit(g)).alias("recent365_score_mean"), F.coalesce("r365_zero", F.lit(zero)).alias("recent365_score_eq0_ratio"),
        F.coalesce("r730_mean", F.lit(g)).alias("recent730_score_mean"), F.coalesce("r730_high", F.lit(high)).alias("recent730_score_ge3_ratio"),
        F.coalesce(F.col("mscore") / F.nullif(F.col("m_n"), F.lit(0)), F.lit(g)).alias("monthly_score_mean"),
    )


def sequence_samples(panel: DataFrame, fallback: float, length: int = 91, gap: int = GAP_DAYS, columns: Sequence[str] = tuple(MEASURES), keys: Sequence[str] = KEYS, block_rows: int | None = None) -> DataFrame:
    """Weekly origins with a `length`-day array of measures, the label visible `gap` days before and targets.

    The array is aligned by day: a day that the panel lacks is null, so a gap shifts nothing. Days are gathered in
    blocks of `length` days with the `length` - 1 days before them, so each day is copied at most twice and an origin
    meets one bounded array whatever the length of its region.
    """
    targets = lead_targets(panel, keys=keys, block_rows=block_rows).filter(F.col("day_idx") >= length - 1)
    known = spread(panel, gap, keys=keys, carry=["score"], block_rows=block_rows)
    known.add({"_known": known.last_known("score")}, temp=True)
    known.add({"previous_score": F.coalesce(F.lag("_known", gap).over(known.window), F.lit(float(fallback)))})
    origins = targets.join(known.done(keep=[*keys, "day_idx", "previous_score"]), [*keys, "day_idx"])
    days = spread(panel.select(*keys, "day_idx", *columns), length - 1, keys=keys, block_rows=length)
    gathered = days.df.groupBy(*keys, BLOCK).agg(F.sort_array(F.collect_list(F.struct("day_idx", *columns))).alias("_days"))
    first, last = F.col("_days")[0]["day_idx"], F.element_at("_days", -1)["day_idx"]
    dense = F.transform(F.sequence(first, last), lambda day: F.get(F.filter("_days", lambda x: x["day_idx"] == day), F.lit(0)))
    gathered = gathered.withColumns({"_from": first, "_days": F.when(last - first + 1 == F.size("_days"), F.col("_days")).otherwise(dense)})
    placed = origins.withColumn(BLOCK, F.floor(F.col("day_idx") / length).cast("long")).join(gathered, [*keys, BLOCK])
    start = (F.col("day_idx") - length + 1 - F.col("_from")).cast("int")
    none = F.get(F.slice("_days", 1, 0), F.lit(0))
    led = F.concat(F.array_repeat(none, -start), F.slice("_days", F.lit(1), start + length))
    return placed.withColumn("sequence", F.when(start >= 0, F.slice("_days", start + 1, length)).otherwise(led)).drop(BLOCK, OWN, "_days", "_from")


def label_median(panel: DataFrame) -> float:
    """Median over all labels (0 without labels); labels take few values, so the exact aggregate stays small."""
    row = labelled_rows(panel).agg(F.median("score")).first()
    return float(row[0]) if row[0] is not None else 0.0
