"""Blending and calibration over the toy predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.operators import blend, profiles
from isohyet.operators.backtest import long_errors
from isohyet.queries.backtest import LONG, PREDS, predictions, scored, targets
from isohyet.queries.registry import panel, query, rounded, sql_rounded
from isohyet.session import new_path
from isohyet.sources.predictions import align_to_template, check_predictions, read_predictions, write_predictions

MODELS = ["lgb", "xgb", "cat"]
ORIGINS = ["tail_minus_5w", "tail_minus_13w", "tail_minus_26w"]
KEYS = ["region_id", "origin", "horizon"]
ANCHOR = {"lgb": 0.35, "xgb": 0.35, "cat": 0.30}
CAPS = {"lgb": 0.6, "xgb": 1.0, "cat": 0.5}
WIDE = LONG + """,
wide as (select region_id, origin, horizon, any_value(target) as target, max(case when model = 'lgb' then pred end) as lgb,
 max(case when model = 'xgb' then pred end) as xgb, max(case when model = 'cat' then pred end) as cat from long group by 1, 2, 3)"""


def aligned(spark, sf):
    return blend.align_models(predictions(spark, sf), targets(spark, sf), MODELS)


def long(spark, sf):
    return long_errors(scored(spark, sf), ["region_id", "origin", "model"])


def _grid(units: int, caps: tuple[int, int, int] | None = None) -> str:
    a, b, c = caps or (units, units, units)
    return (f"grid as (select row_number() over (order by i, j) as g, i / {units}.0 as wl, j / {units}.0 as wx, ({units} - i - j) / {units}.0 as wc "
            f"from range(0, {units} + 1) t(i), range(0, {units} + 1) u(j) where i + j <= {units} and i <= {a} and j <= {b} and {units} - i - j <= {c})")


@query("j07_align_models", f"with {WIDE} select region_id, origin, horizon, target, round(lgb + 1e-9, 6) as lgb, round(xgb + 1e-9, 6) as xgb, round(cat + 1e-9, 6) as cat from wide")
def j07(spark, sf):
    return rounded(aligned(spark, sf), [*KEYS, "target"], MODELS)


@query("s04_read_predictions", f"with {PREDS} select model, origin, cast(count(*) as bigint) as rows, round(avg(pred) + 1e-9, 6) as pred_mean from preds group by all")
def s04(spark, sf):
    """One file per model and origin is written, then read back under its name and checked."""
    preds, paths = predictions(spark, sf), {}
    for m in MODELS:
        for o in ORIGINS:
            paths[f"{m}|{o}"] = new_path(spark, "predictions")
            write_predictions(preds.filter((F.col("model") == m) & (F.col("origin") == o)), paths[f"{m}|{o}"])
    read = check_predictions(read_predictions(spark, paths))
    long_ = blend.to_long(read, ["model", "region_id"]).filter("horizon = 1")
    named = long_.select(F.split("model", r"\|")[0].alias("model"), F.split("model", r"\|")[1].alias("origin"), "pred")
    return rounded(named.groupBy("model", "origin").agg(F.count(F.lit(1)).alias("rows"), F.avg("pred").alias("pred_mean")), ["model", "origin", "rows"], ["pred_mean"])


@query("j05_align_to_template", f"""with {PREDS}, t as (select distinct region_id from panel union all select 'R-new'), k as (select distinct model, origin from preds)
select k.model, k.origin, t.region_id, round(coalesce(p.pred, 0) + 1e-9, 6) as pred_week1 from t cross join k left join preds p on p.region_id = t.region_id and p.model = k.model and p.origin = k.origin""")
def j05(spark, sf):
    rows, preds, parts = panel(spark, sf), predictions(spark, sf), []
    template = rows.select("region_id").distinct().unionByName(spark.sql("select 'R-new' as region_id"))
    for m in MODELS:
        for o in ORIGINS:
            one = preds.filter((F.col("model") == m) & (F.col("origin") == o)).select("region_id", *blend.PREDS)
            parts.append(align_to_template(template, one).withColumns({"model": F.lit(m), "origin": F.lit(o)}))
    return rounded(reduce(DataFrame.unionByName, parts), ["model", "origin", "region_id"], ["pred_week1"])


@query("s07_write_predictions", f"""with {PREDS}, t as (select distinct region_id from panel)
select k.model, t.region_id, {", ".join(f"round(coalesce(least(5.0, greatest(0.0, p.pred)), 0) + 1e-9, 6) as pred_week{h}" for h in range(1, 6))}
from t cross join (select distinct model from preds) k left join (select * from preds where origin = 'tail_minus_13w') p on p.region_id = t.region_id and p.model = k.model""")
def s07(spark, sf):
    """Rows aligned to the template and clipped, written as CSV per model and read back."""
    from isohyet.functions.numeric import clip

    template, paths = panel(spark, sf).select("region_id").distinct(), {}
    for m in MODELS:
        one = predictions(spark, sf).filter((F.col("origin") == "tail_minus_13w") & (F.col("model") == m))
        paths[m] = new_path(spark, "predictions")
        write_predictions(align_to_template(template, one.select("region_id", *[clip(F.col(c)).alias(c) for c in blend.PREDS])), paths[m])
    return rounded(read_predictions(spark, paths), ["model", "region_id"], blend.PREDS)


@query("j11_cross_grid", f"with {WIDE}, {_grid(10)} select horizon, cast(g - 1 as integer) as grid_idx, cast(count(*) as bigint) as n, round(sum(abs(wl * lgb + wx * xgb + wc * cat - target)) + 1e-9, 5) as sum_abs from wide, grid group by 1, 2")
def j11(spark, sf):
    out = blend.error_table(aligned(spark, sf), MODELS, 0.1, ["horizon"])
    return rounded(out, ["horizon", "grid_idx", "n"], ["sum_abs"], 5)


W = "0.5 * lgb + 0.3 * xgb + 0.2 * cat"


@query("b01_convex_blend", f"""with {WIDE} select region_id, origin, horizon, case when region_id not in ('R1', 'R2') then round(least(5.0, greatest(0.0, {W})) + 1e-9, 6) end as pred from wide""")
def b01(spark, sf):
    """One region lacks a model and one has a model twice: both are NULL."""
    preds = predictions(spark, sf)
    preds = preds.filter("not (model = 'cat' and region_id = 'R1')").unionByName(preds.filter("model = 'xgb' and region_id = 'R2'"))
    return rounded(blend.convex_blend(preds, blend.parse_weights("lgb=0.5;xgb=0.3,0.3,0.3,0.3,0.3;cat=0.2", MODELS)), KEYS, ["pred"])


@query("b02_search_two", f"""with {WIDE}, s as (select horizon, g, avg(abs(lgb * (g / 20.0) + xgb * (1 - g / 20.0) - target)) as mae from wide, range(0, 21) t(g) group by 1, 2)
select horizon, arg_min(g, (round(mae, 9), g)) / 20.0 as w_lgb, round(min(mae) + 1e-9, 6) as mae from s group by 1""")
def b02(spark, sf):
    return rounded(blend.search_two(aligned(spark, sf), ["lgb", "xgb"], 0.05), ["horizon", "w_lgb"], ["mae"])


@query("b03_search_three", f"""with {WIDE}, {_grid(20)}, s as (select horizon, g, wl, wx, avg(abs(wl * lgb + wx * xgb + wc * cat - target)) as mae from wide, grid group by all)
select horizon, wl as w_lgb, wx as w_xgb, round(mae + 1e-9, 6) as mae from s qualify row_number() over (partition by horizon order by round(mae, 9), g) = 1""")
def b03(spark, sf):
    return rounded(blend.search_three(aligned(spark, sf), MODELS, 0.05), ["horizon", "w_lgb", "w_xgb"], ["mae"])


PULL = "0.05 * ((wl - 0.35) * (wl - 0.35) + (wx - 0.35) * (wx - 0.35) + (wc - 0.3) * (wc - 0.3))"
FIT = f"""{_grid(50, (30, 50, 25))}, s as (select horizon, g, wl, wx, wc, avg(abs(wl * lgb + wx * xgb + wc * cat - target)) as mae from wide, grid group by all),
o as (select *, mae + {PULL} as objective from s), fit as (select * from o qualify row_number() over (partition by horizon order by round(objective, 9), g) = 1)"""


@query("b04_constrained_fit", f"with {WIDE}, {FIT} select horizon, wl as w_lgb, wx as w_xgb, wc as w_cat, round(mae + 1e-9, 6) as mae, round(objective + 1e-9, 6) as objective from fit")
def b04(spark, sf):
    out = blend.constrained_fit(aligned(spark, sf), MODELS, ANCHOR, CAPS, step=0.02, lambda_reg=0.05)
    return rounded(out, ["horizon", "w_lgb", "w_xgb", "w_cat"], ["mae", "objective"])


ORIGINS = ["tail_minus_5w", "tail_minus_13w", "tail_minus_26w"]
DRAWS = [(d, o, t) for d in range(20) for o, t in zip(ORIGINS, ((d % 4), (d // 4) % 3, 1 + d % 2))]


@query("b05_bootstrap_fit", f"""with {WIDE}, {_grid(10)}, draws(draw, origin, times) as (values {", ".join(str(d) for d in DRAWS)}),
e as (select origin, horizon, g, wl, wx, wc, sum(abs(wl * lgb + wx * xgb + wc * cat - target)) as sa, count(*) as n from wide, grid group by all),
d as (select draw, horizon, g, wl, wx, wc, sum(sa * times) / sum(n * times) as mae from e join draws using (origin) group by all),
f as (select *, mae + {PULL} as objective from d), b as (select * from f qualify row_number() over (partition by draw, horizon order by round(objective, 9), g) = 1),
l as (select horizon, 'lgb' as model, wl as w from b union all select horizon, 'xgb', wx from b union all select horizon, 'cat', wc from b)
select horizon, model, round(avg(w) + 1e-9, 6) as mean, round(coalesce(stddev_samp(w), 0) + 1e-9, 6) as std, round(quantile_cont(w, 0.05) + 1e-9, 6) as p05, round(quantile_cont(w, 0.95) + 1e-9, 6) as p95 from l group by 1, 2""")
def b05(spark, sf):
    errors = blend.error_table(aligned(spark, sf), MODELS, 0.1)
    return rounded(blend.bootstrap_fit(errors, DRAWS, MODELS, ANCHOR), ["horizon", "model"], ["mean", "std", "p05", "p95"])


ROW_DRAWS = 12
SHARE = "cast(concat('0x', substr(md5(concat_ws('|', region_id, origin, cast(horizon as varchar), cast(draw as varchar), '42')), 1, 8)) as bigint) / 4294967296.0"


@query("b05_bootstrap_rows", f"""with {WIDE}, {_grid(10)}, drawn_ as (select wide.*, draw, {SHARE} as u from wide, range({ROW_DRAWS}) t(draw)),
times_ as (select *, {" + ".join(f"(u >= {p!r})::int" for p in blend.AT_MOST)} as times from drawn_),
e as (select draw, horizon, g, wl, wx, wc, sum(times * abs(wl * lgb + wx * xgb + wc * cat - target)) / sum(times) as mae from times_, grid where times > 0 group by all),
f as (select *, mae + {PULL} as objective from e), b as (select * from f qualify row_number() over (partition by draw, horizon order by round(objective, 9), g) = 1),
l as (select horizon, 'lgb' as model, wl as w from b union all select horizon, 'xgb', wx from b union all select horizon, 'cat', wc from b)
select horizon, model, round(avg(w) + 1e-9, 6) as mean, round(coalesce(stddev_samp(w), 0) + 1e-9, 6) as std, round(quantile_cont(w, 0.05) + 1e-9, 6) as p05, round(quantile_cont(w, 0.95) + 1e-9, 6) as p95 from l group by 1, 2""")
def b05_rows(spark, sf):
    return rounded(blend.bootstrap_rows(aligned(spark, sf), ROW_DRAWS, MODELS, ANCHOR), ["horizon", "model"], ["mean", "std", "p05", "p95"])


@query("b06_apply_weights", f"with {WIDE}, {FIT} select region_id, origin, horizon, round(least(5.0, greatest(0.0, lgb * wl + xgb * wx + cat * wc)) + 1e-9, 6) as pred from wide join fit using (horizon)")
def b06(spark, sf):
    rows = aligned(spark, sf)
    return rounded(blend.apply_weights(rows, blend.constrained_fit(rows, MODELS, ANCHOR, CAPS), MODELS), KEYS, ["pred"])


ALPHAS = {"early": (0.1, 0.2, 0.3, 0.4, 0.5), "beyond": (-0.2, 0.0, 0.5, 1.0, 1.4)}


@query("b07_horizon_blend", f"""with {WIDE}, a(spec, horizon, a) as (values {", ".join(f"('{n}', {h}, {x})" for n, xs in ALPHAS.items() for h, x in enumerate(xs, 1))})
select spec, region_id, origin, horizon, round(least(5.0, greatest(0.0, lgb * (1 - a) + xgb * a)) + 1e-9, 6) as pred from wide join a using (horizon)""")
def b07(spark, sf):
    return rounded(blend.horizon_blend(predictions(spark, sf), "lgb", "xgb", ALPHAS), ["spec", *KEYS], ["pred"])


@query("b08_affine_variants", f"""with {LONG}, v(spec, s, b) as (values ('shrink', 0.9, 0.1), ('lift', 1.1, 0.25))
select spec, region_id, origin, model, horizon, round(least(5.0, greatest(0.0, pred * s + b)) + 1e-9, 6) as pred from long, v""")
def b08(spark, sf):
    return rounded(blend.affine_variants(predictions(spark, sf), {"shrink": (0.9, 0.1), "lift": (1.1, 0.25)}), ["spec", "model", *KEYS], ["pred"])


@query("b09_fit_affine", f"""with {LONG}, g as (select i * 19 + j as g, 0.75 + i * 0.025 as s, -0.30 + j * 0.025 as b from range(0, 15) t(i), range(0, 19) u(j)),
e as (select model, horizon, g, s, b, avg(abs(least(5.0, greatest(0.0, pred * s + b)) - target)) as tuned_mae, avg(abs(pred - target)) as baseline_mae from long, g group by all),
o as (select *, tuned_mae + 0.02 * ((s - 1) * (s - 1) + b * b) as objective from e)
select model, horizon, round(s + 1e-9, 6) as scale, round(b + 1e-9, 6) as bias, round(baseline_mae + 1e-9, 6) as baseline_mae, round(tuned_mae + 1e-9, 6) as tuned_mae from o
qualify row_number() over (partition by model, horizon order by round(objective, 9), g) = 1""")
def b09(spark, sf):
    out = blend.fit_affine(long(spark, sf), (0.75, 1.10, 0.025), (-0.30, 0.15, 0.025), by=("model", "horizon"))
    return rounded(out, ["model", "horizon"], ["scale", "bias", "baseline_mae", "tuned_mae"])


MAES = LONG + ", maes as (select origin, model, avg(abs_error) as mae from errors group by 1, 2)"


def maes(spark, sf):
    return blend.origin_maes(long(spark, sf))


@query("b10_inverse_mae_weights", f"with {MAES}, r as (select *, case when mae > 0 then 1 / mae else 1.0 end as raw from maes) select origin, model, round(raw / sum(raw) over (partition by origin) + 1e-9, 6) as weight from r")
def b10(spark, sf):
    return rounded(blend.inverse_mae_weights(maes(spark, sf), ["origin"]), ["origin", "model"], ["weight"])


PROXY = f"""{MAES}, {_grid(20)}, by_origin as (select origin, max(case when model = 'lgb' then mae end) l, max(case when model = 'xgb' then mae end) x, max(case when model = 'cat' then mae end) c from maes group by 1),
p as (select g, wl, wx, wc, wl * l + wx * x + wc * c as proxy, wl * l + wx * x + wc * c - least(l, x, c) as regret from by_origin, grid)"""
PULL2 = PULL.replace("0.05 *", "0.02 *", 1)


@query("b11_minimax_weights", f"""with {PROXY}, t as (select g, wl, wx, wc, max(proxy) as worst, avg(proxy) as mean, stddev_pop(proxy) as std from p group by all),
o as (select *, worst + 0.25 * mean + 0.10 * std + {PULL2} as objective from t)
select wl as w_lgb, wx as w_xgb, wc as w_cat, {sql_rounded(["worst", "mean", "std", "objective"])} from o order by round(objective, 9), g limit 1""")
def b11(spark, sf):
    return rounded(blend.minimax_weights(maes(spark, sf), MODELS, ANCHOR), ["w_lgb", "w_xgb", "w_cat"], ["worst", "mean", "std", "objective"])


@query("b12_minimax_regret_weights", f"""with {PROXY}, t as (select g, wl, wx, wc, max(regret) as max_regret, avg(regret) as mean_regret, max(proxy) as worst from p group by all),
o as (select *, max_regret + 0.5 * mean_regret + 0.1 * worst + {PULL2} as objective from t)
select wl as w_lgb, wx as w_xgb, wc as w_cat, {sql_rounded(["max_regret", "mean_regret", "worst", "objective"])} from o order by round(objective, 9), g limit 1""")
def b12(spark, sf):
    return rounded(blend.minimax_regret_weights(maes(spark, sf), MODELS, ANCHOR), ["w_lgb", "w_xgb", "w_cat"], ["max_regret", "mean_regret", "worst", "objective"])


@query("b13_risk_softmax_weights", f"""with recursive {MAES}, s as (select origin, list(model order by model) as ms, list(exp(-(mae - lo) / 0.05) order by model) as e
 from (select *, min(mae) over (partition by origin) as lo from maes) group by 1),
r(origin, ms, w, i) as (select origin, ms, list_transform(e, lambda x: x / list_sum(e)), 0 from s
 union all select origin, ms, case when len(list_filter(w, lambda x: x > 0.45)) > 0 and len(list_filter(w, lambda x: x <= 0.45)) > 0
  then list_transform(w, lambda x: case when x > 0.45 then 0.45 else x / list_sum(list_filter(w, lambda y: y <= 0.45)) * (1 - 0.45 * len(list_filter(w, lambda y: y > 0.45))) end) else w end, i + 1 from r where i < 20)
select origin, unnest(ms) as model, round(unnest(list_transform(w, lambda x: x / list_sum(w))) + 1e-9, 6) as weight from r where i = 20""")
def b13(spark, sf):
    return rounded(blend.risk_softmax_weights(maes(spark, sf), 0.05, 0.45, score="mae"), ["origin", "model"], ["weight"])


@query("b14_origin_proxy", f"""with {MAES}, p as (select origin, sum(mae * case model when 'lgb' then 0.35 when 'xgb' then 0.35 else 0.3 end) as proxy from maes group by 1)
select round(avg(proxy) + 1e-9, 6) as mean, round(stddev_pop(proxy) + 1e-9, 6) as std, round(max(proxy) + 1e-9, 6) as worst from p""")
def b14(spark, sf):
    return rounded(blend.proxy_summary(blend.origin_proxy(maes(spark, sf), ANCHOR)), [], ["mean", "std", "worst"])


@query("b15_mean_abs_delta", f"""with {WIDE} select round(avg(abs(lgb - xgb)) filter (where region_id <> 'R1') + 1e-9, 6) as mean_abs_delta,
 round(max(abs(lgb - xgb)) filter (where region_id <> 'R1') + 1e-9, 6) as max_abs_delta, cast(count(*) filter (where region_id = 'R1') as bigint) as unmatched_keys from wide""")
def b15(spark, sf):
    rows = blend.to_long(predictions(spark, sf), ["region_id", "origin", "model"])
    out = blend.mean_abs_delta(rows.filter("model = 'lgb' and region_id <> 'R1'"), rows.filter("model = 'xgb'"))
    return rounded(out, ["unmatched_keys"], ["mean_abs_delta", "max_abs_delta"])


@query("a13_residual_correlation", f"""with {LONG}, r as (select region_id, origin, horizon, model, pred - target as r from long)
select a.horizon, a.model as model_a, b.model as model_b, round(case when stddev_pop(a.r) > 0 and stddev_pop(b.r) > 0 then corr(a.r, b.r) else 0 end + 1e-9, 6) as corr
from r a join r b using (region_id, origin, horizon) group by 1, 2, 3""")
def a13(spark, sf):
    return rounded(blend.residual_correlation(aligned(spark, sf), MODELS), ["horizon", "model_a", "model_b"], ["corr"])


STATS = ["mean", "std", "min", "max"]


@query("a08_prediction_stats", f"""with {LONG}, s as (select coalesce(horizon, 0) as horizon, avg(pred) as mean, stddev_samp(pred) as std, min(pred) as min, max(pred) as max from long group by grouping sets ((horizon), ()))
select horizon, {sql_rounded(STATS)} from s""")
def a08(spark, sf):
    return rounded(profiles.prediction_stats(long(spark, sf)), ["horizon"], STATS)


SUMMARY = ["mean", "std", "min", "max", "zero_fraction", "p95", "p99"]


@query("a09_distribution_summary", f"""with {LONG}, s as (select model, avg(pred) as mean, stddev_pop(pred) as std, min(pred) as min, max(pred) as max, avg(cast(pred <= 1e-12 as integer)) as zero_fraction,
 quantile_cont(pred, 0.95) as p95, quantile_cont(pred, 0.99) as p99 from long group by 1) select model, {sql_rounded(SUMMARY)} from s""")
def a09(spark, sf):
    return rounded(profiles.distribution_summary(long(spark, sf)), ["model"], SUMMARY)
