"""Blind backtests, leakage checks, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.operators import backtest as bt
from isohyet.operators import profiles, samples
from isohyet.operators.clusters import region_clusters
from isohyet.plans.feature_table import FeatureOptions
from isohyet.queries.registry import KEYS, PANEL, cluster_sql, label_panel, panel, query, rounded, sql_rounded, stored
from isohyet.queries.samples import TARGETS, WEEKLY
from isohyet.session import new_path
from isohyet.sources import toys
from isohyet.sources.panel import metric_rows, read_metrics, write_metrics

TARGET = WEEKLY + """,
targets as (select region_id, concat('tail_minus_', cast(max_week_idx - week_idx as varchar), 'w') as origin, date as origin_date, day_idx as origin_day_idx,
 month as origin_month, target_w1, target_w2, target_w3, target_w4, target_w5 from sample where max_week_idx - week_idx in (5, 13, 26))"""
PREDS = TARGET + """,
vis as (select t.region_id, t.origin, p.score, row_number() over (partition by t.region_id, t.origin order by p.day_idx desc) rn
 from targets t join panel p on p.region_id = t.region_id and p.day_idx <= t.origin_day_idx - 91 where p.score is not null),
m as (select region_id, origin, max(case when rn = 1 then score end) lgb, avg(score) xgb, max(case when rn <= 5 then score end) cat from vis group by 1, 2),
preds as (select region_id, origin, 'lgb' as model, lgb as pred from m union all select region_id, origin, 'xgb', xgb from m union all select region_id, origin, 'cat', cat from m)"""
LONG = PREDS + """,
long as (select p.region_id, p.origin, t.origin_month, p.model, h.horizon, p.pred,
 case h.horizon when 1 then target_w1 when 2 then target_w2 when 3 then target_w3 when 4 then target_w4 else target_w5 end as target
 from preds p join targets t using (region_id, origin) cross join (values (1), (2), (3), (4), (5)) h(horizon)),
errors as (select *, abs(pred - target) as abs_error from long)"""
ORIGIN_KEYS = ["origin", "region_id"]


def fresh_targets(spark, sf):
    return bt.origin_targets(label_panel(spark, sf).select(*KEYS, "date", "score"))


def targets(spark, sf):
    return stored(spark, sf, "targets", lambda: fresh_targets(spark, sf))


def predictions(spark, sf):
    return stored(spark, sf, "predictions", lambda: toys.toy_predictions(label_panel(spark, sf), targets(spark, sf)))


@query("v00_origin_targets", f"with {TARGET} select region_id, origin, origin_date, origin_day_idx, {TARGETS} from targets")
def v00(spark, sf):
    return fresh_targets(spark, sf)


HIST = TARGET + """, hist as (select p.region_id, p.day_idx, t.origin, p.score, t.origin_day_idx - p.day_idx < 91 as is_blind
 from panel p join targets t on t.region_id = p.region_id and p.day_idx <= t.origin_day_idx and p.day_idx > t.origin_day_idx - 750)"""


@query("j08_origin_band_join", f"with {TARGET} select p.region_id, p.day_idx, t.origin from panel p join targets t on t.region_id = p.region_id and p.day_idx between t.origin_day_idx - 90 and t.origin_day_idx")
def j08(spark, sf):
    return bt.origin_band_join(label_panel(spark, sf).select(*KEYS), targets(spark, sf), 0, 90).select(*KEYS, "origin")


@query("f05_history_window", f"with {HIST} select region_id, day_idx, origin, cast(is_blind as integer) as is_blind from hist")
def f05(spark, sf):
    out = bt.history_window(panel(spark, sf).select(*KEYS), targets(spark, sf))
    return out.select(*KEYS, "origin", F.col("is_blind").cast("int").alias("is_blind"))


@query("v07_blind_mask", f"with {HIST} select region_id, day_idx, origin, score from hist where is_blind")
def v07(spark, sf):
    return bt.blind_mask(panel(spark, sf), targets(spark, sf)).select(*KEYS, "origin", "score")


@query("v08_blind_origin", f"with {HIST} select region_id, day_idx, origin, case when not is_blind then score end as score, cast(is_blind as integer) as is_blind from hist")
def v08(spark, sf):
    out = bt.blind_origin(panel(spark, sf).select(*KEYS, "score"), targets(spark, sf))
    return out.select(*KEYS, "origin", "score", F.col("is_blind").cast("int").alias("is_blind"))


OVER = "over (partition by origin, region_id order by day_idx)"


def _roll(expr: str, w: int, lo: int = 1) -> str:
    return f"{expr} over (partition by origin, region_id order by day_idx rows between {w + lo - 1} preceding and {lo} preceding)"


PSEUDO = {
    "tmp_rmean28": _roll("avg(tmp)", 28), "prec_sum91": _roll("sum(prec)", 91), "last_known_score": f"lag(ks, 91) {OVER}",
    "score_gap_lag12w": f"lag(ks, 175) {OVER}", "score_gap_mean365d": _roll("avg(score)", 365, 91), "score_gap_max91d": _roll("max(score)", 91, 91),
}


@query("v09_pseudo_test_window", f"""with {TARGET},
hist as (select p.* exclude (score), t.origin, t.origin_day_idx, case when t.origin_day_idx - p.day_idx >= 91 then p.score end as score
 from dated p join targets t on t.region_id = p.region_id and p.day_idx <= t.origin_day_idx and p.day_idx > t.origin_day_idx - 750),
k as (select *, last_value(score ignore nulls) {OVER} as ks from hist),
o as (select origin, region_id, day_idx, origin_day_idx, month, {", ".join(f"{v} as {n}" for n, v in PSEUDO.items())} from k),
c as (select origin, region_id, month, avg(prec) as prec_clim_mean from hist where origin_day_idx - day_idx >= 91 group by 1, 2, 3),
s as (select origin, region_id, avg(score) as region_score_mean from hist where score is not null group by 1, 2)
select origin, region_id, day_idx, {sql_rounded([*PSEUDO, "prec_clim_mean", "region_score_mean"], 5)}
from o left join c using (origin, region_id, month) left join s using (origin, region_id) where day_idx = origin_day_idx""")
def v09(spark, sf):
    out = bt.pseudo_test_window(panel(spark, sf), targets(spark, sf), FeatureOptions(region_priors=True))
    return rounded(out, [*ORIGIN_KEYS, "day_idx"], [*PSEUDO, "prec_clim_mean", "region_score_mean"], 5)


@query("v10_context_check", f"""with {TARGET}, g as (select region_id, count(*) n, min(day_idx) a, max(day_idx) b from panel group by 1)
select region_id, cast(n as bigint) as days, 819 as need, cast(n < 819 as integer) as too_short, cast(b - a + 1 <> n as integer) as has_gaps from g""")
def v10(spark, sf):
    out = bt.context_check(panel(spark, sf), FeatureOptions(profile="full"))
    return out.select("region_id", "days", "need", F.col("too_short").cast("int").alias("too_short"), F.col("has_gaps").cast("int").alias("has_gaps"))


GATE = ["tmp", "wind", "prec", "humidity"]


@query("v11_completeness_gate", f"""with {TARGET}, f as (select * from panel where day_idx = (select max(day_idx) from panel)), u as (
 {" union all ".join(f"select '{c}' as feature, count(*) - count({c}) as missing, count(*) as n from f" for c in GATE)})
select feature, cast(missing as bigint) as missing, cast(n as bigint) as rows, round(missing / n + 1e-9, 6) as missing_rate from u where missing > 0""")
def v11(spark, sf):
    final = samples.final_row(panel(spark, sf).select(*KEYS, *GATE))
    return rounded(profiles.completeness_gate(final, GATE, fail=False), ["feature", "missing", "rows"], ["missing_rate"])


@query("v12_leakage_sentinel", """select feature, cast(0 as bigint) as changed_rows, 0.0 as max_abs_diff from (values ('tmp_rmean28'), ('last_known_score'), ('score_gap_lag52w'),
 ('score_gap_max365d'), ('score_gap_std91d'), ('score_velocity_1w'), ('region_score_mean'), ('region_score_max'), ('region_score_mean_recent_365d'),
 ('region_month_score_mean_smooth'), ('tmp_anom'), ('prec_ewm14')) v(feature)""")
def v12(spark, sf):
    """Every feature family is on; the SQL states that none of these columns may change."""
    report = bt.leakage_sentinel(panel(spark, sf), targets(spark, sf))
    leaks = F.col("changed_rows") > 0
    shown = F.col("feature").isin("tmp_rmean28", "last_known_score", "score_gap_lag52w", "score_gap_max365d", "score_gap_std91d", "score_velocity_1w",
                                  "region_score_mean", "region_score_max", "region_score_mean_recent_365d", "region_month_score_mean_smooth", "tmp_anom", "prec_ewm14")
    return report.filter(leaks | shown)


@query("j09_diff_by_key", f"""with {TARGET}, a as (select region_id, day_idx, tmp, prec from panel), b as (select region_id, day_idx, case when day_idx % 10 = 0 then tmp + 1 else tmp end as tmp, prec from panel),
j as (select a.tmp ta, b.tmp tb, a.prec pa, b.prec pb from a join b using (region_id, day_idx))
select 'tmp' as feature, cast(sum(cast(coalesce(abs(ta - tb) > 1e-6 + 1e-6 * abs(tb), false) as integer)) as bigint) as changed_rows, round(max(abs(ta - tb)) + 1e-9, 6) as max_abs_diff from j
union all select 'prec', 0, 0.0""")
def j09(spark, sf):
    a = panel(spark, sf).select(*KEYS, "tmp", "prec")
    b = a.withColumn("tmp", F.when(F.col("day_idx") % 10 == 0, F.col("tmp") + 1).otherwise(F.col("tmp")))
    return rounded(bt.diff_by_key(a, b, KEYS, ["tmp", "prec"]), ["feature", "changed_rows"], ["max_abs_diff"])


def scored(spark, sf):
    return bt.join_predictions(predictions(spark, sf), targets(spark, sf))


def clusters(spark, sf):
    return stored(spark, sf, "clusters", lambda: region_clusters(panel(spark, sf)))


@query("m05_region_clusters", f"with {PANEL}, {cluster_sql()} select region_id, region_cluster from clusters")
def m05(spark, sf):
    return region_clusters(panel(spark, sf))


@query("j06_join_pred_target_cluster", f"""with {PREDS}, {cluster_sql()}
select p.region_id, p.origin, p.model, t.origin_month, region_cluster, round(p.pred + 1e-9, 6) as pred_week1, t.target_w1
from preds p join targets t using (region_id, origin) left join clusters using (region_id)""")
def j06(spark, sf):
    regions = clusters(spark, sf)  # from the whole panel, which labels are then read from
    out = bt.join_predictions(predictions(spark, sf), targets(spark, sf), regions)
    return rounded(out, ["region_id", "origin", "model", "origin_month", "region_cluster", "target_w1"], ["pred_week1"])


def _suite(source: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    parts = [f"select 'overall_mae' as metric, 'all' as key, avg(abs_error) as value from {source}"]
    for name, col in (("mae_by_horizon", "horizon"), ("mae_by_origin", "origin"), ("mae_by_region_id", "region_id"), ("mae_by_origin_month", "origin_month"), *extra):
        parts.append(f"select '{name}', cast({col} as varchar), avg(abs_error) from {source} group by {col}")
    for name, cond in (("zero_score", "target = 0"), ("nonzero_score", "target > 0"), ("high_severity_ge3", "target >= 3")):
        parts.append(f"select 'target_segment_mae', '{name}', avg(abs_error) from {source} where {cond}")
    return " union all ".join(parts)


# With the cluster of every region and with the model as further breakdowns.
SUITE = LONG + ", " + cluster_sql() + """,
l as (select e.*, region_cluster from errors e left join clusters using (region_id)),
s as (""" + _suite("l", (("mae_by_region_cluster", "region_cluster"), ("mae_by_model", "model"))) + ")"


def suite(spark, sf):
    regions = clusters(spark, sf)
    rows = bt.join_predictions(predictions(spark, sf), targets(spark, sf), regions)
    return bt.mae_suite(rows, ("origin", "region_id", "origin_month", "region_cluster", "model"))


@query("a10_mae_suite", f"with {SUITE} select metric, key, round(value + 1e-9, 6) as value from s where value is not null")
def a10(spark, sf):
    return rounded(suite(spark, sf), ["metric", "key"], ["value"])


@query("v13_evaluate_backtest", f"with {SUITE} select 'toys' as run_id, metric, key, round(value + 1e-9, 6) as value from s where value is not null")
def v13(spark, sf):
    return rounded(metric_rows(suite(spark, sf), "toys"), ["run_id", "metric", "key"], ["value"])


@query("s08_write_metrics", f"with {SUITE}, r(run_id) as (values ('run-1'), ('run-2')) select run_id, metric, key, round(value + 1e-9, 6) as value from s, r where value is not null")
def s08(spark, sf):
    """Two runs are written, one of them twice, and read back."""
    rows, path = suite(spark, sf), new_path(spark, "metrics")
    for run in ("run-1", "run-2", "run-1"):
        write_metrics(metric_rows(rows, run), path)
    return rounded(read_metrics(spark, path), ["run_id", "metric", "key"], ["value"])


STATS = [f"{c}_{s}" for c in ("pred", "target") for s in ("mean", "std", "min", "max")]


@query("a10_value_stats", f"""with {LONG}, o as (select horizon, {", ".join(f"{f}({c}) as {c}_{s}" for c in ("pred", "target") for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))} from errors group by 1)
select horizon, {sql_rounded(STATS)} from o""")
def a10_stats(spark, sf):
    return rounded(bt.value_stats(scored(spark, sf)), ["horizon"], STATS)


@query("u02_union_origins", f"with {TARGET} select origin, cast(count(*) as bigint) as rows, sum(target_w1) as target_sum from targets group by 1")
def u02(spark, sf):
    return fresh_targets(spark, sf).groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.sum("target_w1").alias("target_sum"))
