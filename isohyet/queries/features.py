"""Feature families over the derived panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.fixed import MEASURES
from isohyet.functions.numeric import r6
from isohyet.operators import features as ft
from isohyet.operators.quantiles import column_medians
from isohyet.queries.registry import KEYS, PANEL, SPLIT, over, panel, query, rounded, splits, sql_rounded, trailing


def _sql(columns: dict[str, str], source: str = "panel", ctes: str = PANEL, where: str = "") -> str:
    inner = ", ".join(f"{expr} as {name}" for name, expr in columns.items())
    return (
        f"with {ctes}, out as (select region_id, day_idx, {inner} from {source}) "
        f"select region_id, day_idx, {sql_rounded(list(columns))} from out {where}"
    )


LAGS = {f"{c}_lag{k}": f"lag({c}, {k}) over (partition by region_id order by day_idx)" for c in ("prec", "tmp") for k in (7, 28)}


@query("w02_lags", _sql(LAGS))
def w02(spark, sf):
    return rounded(ft.lags(panel(spark, sf), ["prec", "tmp"], [7, 28]), KEYS, list(LAGS))


ROLLS = {
    f"{c}_r{fn}{w}": f"{agg}({c}) {trailing(w)}"
    for c in ("prec", "tmp") for w in (7, 28) for fn, agg in (("mean", "avg"), ("std", "stddev_samp"))
}


@query("w03_rolling_mean_std", _sql(ROLLS))
def w03(spark, sf):
    return rounded(ft.rolling(panel(spark, sf), ["prec", "tmp"], [7, 28], ["mean", "std"]), KEYS, list(ROLLS))


LONG_ROLLS = {
    f"{c}_r{fn}{w}": f"{agg}({c}) {trailing(w)}"
    for c in ("prec",) for w in (90, 365, 730) for fn, agg in (("mean", "avg"), ("sum", "sum"), ("max", "max"))
}


@query("w03_rolling_long", _sql(LONG_ROLLS))
def w03_long(spark, sf):
    return rounded(ft.rolling(panel(spark, sf), ["prec"], [90, 365, 730], ["mean", "sum", "max"]), KEYS, list(LONG_ROLLS))


ALL_LONG = {
    f"{c}_r{fn}{w}": f"{agg}({c}) {trailing(w)}"
    for c in MEASURES for w in (90, 365, 730) for fn, agg in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"))
}


def _region_means(columns, ctes: str) -> str:
    """Every column as its region's mean and number of values: all columns and days, in few rows."""
    cells = ", ".join(f"round(avg({c}) + 1e-9, 5) as {c}, count({c}) as n_{c}" for c in columns)
    return f"{ctes} select region_id, {cells} from o group by 1"


def region_means(df, columns):
    # Sums over counts: a mean of its own would hold the count of every column a second time.
    mean = {c: F.sum(c) / F.nullif(F.count(c), F.lit(0)) for c in columns}
    return df.groupBy("region_id").agg(*[x for c in columns for x in (r6(mean[c], 5).alias(c), F.count(c).alias(f"n_{c}"))])


@query("w03_rolling_long_all", _region_means(ALL_LONG, f"with {PANEL}, o as (select region_id, {', '.join(f'{v} as {k}' for k, v in ALL_LONG.items())} from panel)"))
def w03_long_all(spark, sf):
    return region_means(ft.rolling(panel(spark, sf), MEASURES, [90, 365, 730], ["mean", "std", "max"]), ALL_LONG)


FLAGS = {
    "dry_days": "case when prec < 0.1 then 1.0 else 0.0 end", "rain_days": "case when prec >= 1 then 1.0 else 0.0 end",
    "hot_days": "case when tmp_max >= 30 then 1.0 else 0.0 end",
    "hot_days_above35": "case when tmp_max >= 35 then 1.0 else 0.0 end", "hist_days": "1.0",
}
COUNTS = {f"{n}_{w}d": f"cast(sum({e}) {trailing(w)} as double)" for w in (30, 90) for n, e in FLAGS.items()}
COUNTS |= {f"dry_share_{w}d": f"cast(sum({FLAGS['dry_days']}) {trailing(w)} as double) / nullif(sum(1.0) {trailing(w)}, 0)" for w in (30, 90)}


@query("w04_rolling_flag_counts", _sql(COUNTS))
def w04(spark, sf):
    return rounded(ft.rolling_flag_counts(panel(spark, sf), [30, 90]), KEYS, list(COUNTS))


def _ewm_sql(column: str, spans: tuple[int, ...]) -> str:
    """The recurrence written out day by day."""
    cols = ", ".join(f"y{s}" for s in spans)
    seed = ", ".join(f"x as y{s}" for s in spans)
    step = ", ".join(
        f"case when r.y{s} is null then f.x else r.y{s} * (1 - 2.0 / ({s} + 1)) + f.x * (2.0 / ({s} + 1)) end" for s in spans
    )
    outs = [f"{column}_ewm{s}" for s in spans]
    lagged = ", ".join(
        f"round(lag(y{s}) over (partition by region_id order by day_idx) + 1e-9, 6) as {o}" for s, o in zip(spans, outs)
    )
    return f"""with recursive {PANEL},
filled as materialized (select region_id, day_idx, last_value({column} ignore nulls) over (partition by region_id order by day_idx) x from panel),
r(region_id, day_idx, {cols}) as (
 select region_id, day_idx, {seed} from filled where day_idx = 0
 union all
 select f.region_id, f.day_idx, {step} from r join filled f on f.region_id = r.region_id and f.day_idx = r.day_idx + 1)
select region_id, day_idx, {lagged} from r"""


@query("w05_ewm", _ewm_sql("tmp", (3, 7, 14)))
def w05(spark, sf):
    return rounded(ft.ewm(panel(spark, sf), ["tmp"], [3, 7, 14]), KEYS, [f"tmp_ewm{s}" for s in (3, 7, 14)])


SPANS = (3, 7, 14)
ALL_EWM = [f"{c}_ewm{s}" for c in MEASURES for s in SPANS]


def _all_ewm_sql() -> str:
    """The recurrence of every measure, as `_ewm_sql` states it for one."""
    state = [(c, s, f"y{i}_{s}") for i, c in enumerate(MEASURES) for s in SPANS]
    step = ", ".join(f"case when r.{y} is null then f.x_{c} else r.{y} * (1 - 2.0 / ({s} + 1)) + f.x_{c} * (2.0 / ({s} + 1)) end" for c, s, y in state)
    ctes = f"""with recursive {PANEL},
filled as materialized (select region_id, day_idx, {", ".join(f"last_value({c} ignore nulls) over (partition by region_id order by day_idx) as x_{c}" for c in MEASURES)} from panel),
r(region_id, day_idx, {", ".join(y for *_, y in state)}) as (
 select region_id, day_idx, {", ".join(f"x_{c}" for c, *_ in state)} from filled where day_idx = 0
 union all
 select f.region_id, f.day_idx, {step} from r join filled f on f.region_id = r.region_id and f.day_idx = r.day_idx + 1),
o as (select region_id, {", ".join(f"lag({y}) over (partition by region_id order by day_idx) as {c}_ewm{s}" for c, s, y in state)} from r)"""
    return _region_means(ALL_EWM, ctes)


@query("w05_ewm_all", _all_ewm_sql())
def w05_all(spark, sf):
    return region_means(ft.ewm(panel(spark, sf), MEASURES, list(SPANS)), ALL_EWM)


STREAK = PANEL + """,
islands as (select region_id, day_idx, prec < 0.1 as dry,
 sum(case when prec < 0.1 then 0 else 1 end) over (partition by region_id order by day_idx) as island from panel),
runs as (select region_id, day_idx, cast(sum(case when dry then 1 else 0 end) over (partition by region_id, island order by day_idx) as double) as run from islands),
befores as (select region_id, day_idx, run, coalesce(lag(run) over (partition by region_id order by day_idx), 0) as before from runs)"""
TRAILING = {"consecutive_dry_days": "before"} | {f"cdd_rolling{w}": f"max(before) {over(f'{w - 1} preceding and current row')}" for w in (30, 60, 90)}
REGION_MAX = {"consecutive_dry_days": "max(run) over (partition by region_id)"} | {
    f"cdd_rolling{w}": "case when day_idx > 0 then max(run) over (partition by region_id) end" for w in (30, 60, 90)}


@query("w06_dry_streak", _sql(TRAILING, "befores", STREAK))
def w06(spark, sf):
    return rounded(ft.dry_streak(panel(spark, sf)), KEYS, list(TRAILING))


@query("w06_dry_streak_region_max", _sql(REGION_MAX, "befores", STREAK))
def w06_max(spark, sf):
    return rounded(ft.dry_streak(panel(spark, sf), mode="region_max"), KEYS, list(REGION_MAX))


RUN90 = {"dry_streak_before": "before", "max_dry_streak_90d": f"max(before) {over('89 preceding and current row')}"}


@query("w07_max_dry_streak", _sql(RUN90, "befores", STREAK))
def w07(spark, sf):
    return rounded(ft.max_dry_streak(panel(spark, sf), 90), KEYS, list(RUN90))


FORWARD = {c: f"coalesce(last_value({c} ignore nulls) over (partition by region_id order by day_idx), 0.0)" for c in ("tmp", "humidity", "wind")}
BOTH_WAYS = {
    c: f"coalesce(last_value({c} ignore nulls) over (partition by region_id order by day_idx), "
       f"first_value({c} ignore nulls) over (partition by region_id order by day_idx rows between current row and unbounded following), 0.0)"
    for c in ("tmp", "humidity", "wind")
}


@query("w08_impute_ffill", _sql(FORWARD))
def w08(spark, sf):
    return rounded(ft.impute(panel(spark, sf), list(FORWARD)), KEYS, list(FORWARD))


@query("w08_impute_ffill_bfill", _sql(BOTH_WAYS))
def w08_both(spark, sf):
    return rounded(ft.impute(panel(spark, sf), list(BOTH_WAYS), mode="ffill_bfill"), KEYS, list(BOTH_WAYS))


def _with_medians(expressions: dict[str, str]) -> str:
    """What both fills leave empty takes the column's median over the panel, regions without any value included."""
    gaps = ", ".join(f"case when region_id in ('R1', 'R3') then null else {c} end as {c}" for c in expressions)
    cells = ", ".join(f"round(coalesce(last_value({c} ignore nulls) over (partition by region_id order by day_idx), first_value({c} ignore nulls) over (partition by region_id order by day_idx rows between current row and unbounded following), m_{c}, 0) + 1e-9, 6) as {c}" for c in expressions)
    return f"with {PANEL}, gaps as (select region_id, day_idx, {gaps} from panel), m as (select {', '.join(f'median({c}) as m_{c}' for c in expressions)} from panel) select region_id, day_idx, {cells} from gaps, m"


@query("w08_impute_medians", _with_medians(dict.fromkeys(MEASURES)))
def w08_medians(spark, sf):
    """Two regions lose all their values, so every step of the imputation is needed."""
    rows = panel(spark, sf)
    gaps = rows.withColumns({c: F.when(~F.col("region_id").isin("R1", "R3"), F.col(c)) for c in MEASURES})
    return rounded(ft.impute(gaps, mode="ffill_bfill", medians=column_medians(rows, MEASURES)), KEYS, MEASURES)


KNOWN = PANEL + """, known as (select *, last_value(score ignore nulls) over (partition by region_id order by day_idx) as ks from panel)"""


def _ks(k: int) -> str:
    return f"lag(ks, {k}) over (partition by region_id order by day_idx)"


LABEL_LAGS = {"last_known_score": _ks(91)} | {f"score_gap_lag{k}w": _ks(91 + 7 * k) for k in (0, 4, 12, 52)}
LABEL_STATS = {
    f"score_gap_{fn}{w}d": f"{agg}(score) {trailing(w, 91)}"
    for w in (28, 91, 365) for fn, agg in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"))
}
DYNAMICS = {
    "score_velocity_1w": f"{_ks(91)} - {_ks(98)}", "score_momentum_14d": f"{_ks(91)} - {_ks(105)}",
    "score_momentum_28d": f"{_ks(91)} - {_ks(119)}",
    "score_gap_trend_4w_26w": f"avg(score) {trailing(28, 91)} - avg(score) {trailing(182, 91)}",
    "score_gap_trend_13w_52w": f"avg(score) {trailing(91, 91)} - avg(score) {trailing(365, 91)}",
}


@query("w09_gapped_label_lags", _sql(LABEL_LAGS, "known", KNOWN))
def w09(spark, sf):
    return rounded(ft.gapped_labels(panel(spark, sf), [0, 4, 12, 52], []), KEYS, list(LABEL_LAGS))


@query("w10_gapped_label_stats", _sql(LABEL_STATS))
def w10(spark, sf):
    return rounded(ft.gapped_labels(panel(spark, sf), [], [28, 91, 365]), KEYS, list(LABEL_STATS))


@query("w11_label_dynamics", _sql(DYNAMICS, "known", KNOWN))
def w11(spark, sf):
    return rounded(ft.gapped_labels(panel(spark, sf), [], [28, 91, 182, 365]), KEYS, list(DYNAMICS))


HEAT = {f"hot_days_above35_{w}d": f"cast(sum({FLAGS['hot_days_above35']}) {trailing(w)} as double)" for w in (30, 60, 90, 180)}
HEAT |= {f"heat_stress_sum_{w}d": f"sum(case when tmp_max is not null then greatest(tmp_max - 30, 0.0) end) {trailing(w)}" for w in (30, 60, 90)}


@query("w18_heat_stress", _sql(HEAT))
def w18(spark, sf):
    return rounded(ft.heat_stress(panel(spark, sf)), KEYS, list(HEAT))


UNSTABLE = {f"{c}_std_{w}d": f"stddev_samp({c}) {trailing(w)}" for c in ("tmp_range", "wind") for w in (14, 30, 60)}


@query("w19_instability", _sql(UNSTABLE))
def w19(spark, sf):
    return rounded(ft.instability(panel(spark, sf)), KEYS, list(UNSTABLE))


DAILY = {
    "dry_day": "case when prec < 0.1 then 1.0 else 0.0 end", "rain_day_ge_1": "case when prec >= 1 then 1.0 else 0.0 end",
    "heavy_precip_ge_10": "case when prec >= 10 then 1.0 else 0.0 end", "dew_point_depression": "tmp - dp_tmp",
    "wet_bulb_depression": "tmp - wb_tmp", "surf_air_temp_diff": "surf_tmp - tmp", "dryness_idx_daily": "tmp_range * tmp_max",
    "heat_humidity_idx_daily": "tmp_max - humidity",
}
DAILY = {k: f"cast({v} as double)" for k, v in DAILY.items()}


@query("p07_daily_derived", _sql(DAILY))
def p07(spark, sf):
    return rounded(ft.daily_derived(panel(spark, sf)), KEYS, list(DAILY))


VAPOR = {"surf_air_temp_diff": "surf_tmp - tmp", "dew_point_depression": "tmp - dp_tmp", "wet_bulb_depression": "tmp - wb_tmp"}
VAPOR |= {
    f"{out}_{w}d": f"avg({expr}) {trailing(w)}" for w in (14, 30) for out, expr in
    (("surf_air_diff_mean", "surf_tmp - tmp"), ("dew_depression_mean", "tmp - dp_tmp"), ("wet_bulb_depression_mean", "tmp - wb_tmp"))
}


@query("p08_vapor_proxies", _sql(VAPOR))
def p08(spark, sf):
    return rounded(ft.vapor_proxies(panel(spark, sf)), KEYS, list(VAPOR))


def _avg(c: str, w: int) -> str:
    return f"avg({c}) {trailing(w)}"


DOMAIN = {}
for _w in (14, 35):
    DOMAIN |= {
        f"drought_idx_r{_w}": f"{_avg('tmp', _w)} / nullif({_avg('prec', _w)} + 0.01, 0)",
        f"dryness_idx_r{_w}": f"{_avg('tmp_range', _w)} * {_avg('tmp_max', _w)}",
        f"heat_humidity_idx_r{_w}": f"{_avg('tmp_max', _w)} - {_avg('humidity', _w)}",
        f"dewpoint_spread_r{_w}": f"{_avg('tmp', _w)} - {_avg('dp_tmp', _w)}",
        f"wetbulb_spread_r{_w}": f"{_avg('tmp', _w)} - {_avg('wb_tmp', _w)}",
    }


@query("p09_domain_indices", _sql(DOMAIN))
def p09(spark, sf):
    return rounded(ft.domain_indices(panel(spark, sf), [14, 35]), KEYS, list(DOMAIN))


LONG = {}
for _w in (30, 91, 180):
    LONG |= {
        f"prec_sum{_w}": f"sum(prec) {trailing(_w)}", f"dry_days{_w}": f"cast(sum({FLAGS['dry_days']}) {trailing(_w)} as double)",
        f"hot_days{_w}": f"cast(sum({FLAGS['hot_days']}) {trailing(_w)} as double)", f"tmp_mean_long{_w}": f"avg(tmp) {trailing(_w)}",
        f"long_drought_idx{_w}": f"avg(tmp) {trailing(_w)} / nullif(sum(prec) {trailing(_w)} + 0.1, 0)",
    }


@query("p10_long_drought_idx", _sql(LONG))
def p10(spark, sf):
    return rounded(ft.long_drought(panel(spark, sf), [30, 91, 180]), KEYS, list(LONG))


CONTEXT = {"prec_sum_30d": f"sum(prec) {trailing(30)}", "prec_sum_180d": f"sum(prec) {trailing(180)}"}
CONTEXT |= {
    "dry_share_90d": COUNTS["dry_share_90d"], "rain_days_90d": COUNTS["rain_days_90d"], "hot_days_90d": COUNTS["hot_days_90d"],
    "humidity_mean_90d": f"avg(humidity) {trailing(90)}", "dew_depression_mean_90d": f"avg(tmp - dp_tmp) {trailing(90)}",
    "rolling_drought_idx_90d": f"avg(tmp) {trailing(90)} / nullif(sum(prec) {trailing(90)} + 0.1, 0)",
}


@query("w17_shifted_context", f"""with {STREAK}, out as (select region_id, day_idx,
 case when day_idx < (select max(day_idx) - 90 from panel) then 'train' else 'test' end as split,
 {", ".join(f"{e} as {n}" for n, e in CONTEXT.items())} from panel),
streaks as (select region_id, day_idx, max(before) {over('89 preceding and current row')} as max_dry_streak_90d from befores)
select region_id, day_idx, split, {sql_rounded(list(CONTEXT))}, round(max_dry_streak_90d + 1e-9, 6) as max_dry_streak_90d
from out join streaks using (region_id, day_idx)""")
def w17(spark, sf):
    train, test = splits(spark, sf)
    return rounded(ft.shifted_context(train, test), [*KEYS, "split"], [*CONTEXT, "max_dry_streak_90d"])
