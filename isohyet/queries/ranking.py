"""Candidate checks and rankings; manifests and histories derive from part, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.operators import ranking
from isohyet.queries.backtest import LONG, PREDS
from isohyet.queries.blending import MODELS, MAES, maes, predictions
from isohyet.queries.registry import label_panel, query, rounded, sql_rounded
from isohyet.sources.derived import read_table

REPORT = ["pred_min", "pred_max", "pred_mean", "pred_std_mean"]


@query("r01_validate_predictions", f"""with {PREDS}, k as (select model, region_id, origin, pred from preds where not (model = 'cat' and region_id = 'R1')
 union all select model, region_id, origin, pred from preds where model = 'xgb' and region_id = 'R2' union all select model, 'R-extra', origin, pred from preds where model = 'lgb' and region_id = 'R3'),
n as (select count(distinct region_id) as n from panel), t as (select distinct region_id, true as known from panel),
c as (select origin, model, region_id, count(*) as copies from k group by all),
d as (select origin, model, count(known) as matched, count(*) - count(known) as extra, sum(copies - 1) as dup from c left join t using (region_id) group by all),
g as (select origin, model, count(*) as rows, count(*) - count(pred) as nulls, min(pred) as pred_min, max(pred) as pred_max, avg(pred) as pred_mean, stddev_samp(pred) as pred_std_mean from k group by all)
select concat(model, '|', origin) as model, cast(rows as bigint) as rows, cast(n - matched as bigint) as missing_keys, cast(extra as bigint) as extra_keys, cast(dup as bigint) as duplicate_rows, cast(nulls * 5 as bigint) as nulls,
 cast(n = matched and extra = 0 and dup = 0 and nulls = 0 as integer) as is_valid, {sql_rounded(REPORT)} from g join d using (origin, model), n""")
def r01(spark, sf):
    """Every model and origin; one lacks a key, one repeats a key, one has a foreign key."""
    preds = predictions(spark, sf)
    again, extra = preds.filter("model = 'xgb' and region_id = 'R2'"), preds.filter("model = 'lgb' and region_id = 'R3'").withColumn("region_id", F.lit("R-extra"))
    preds = preds.filter("not (model = 'cat' and region_id = 'R1')").unionByName(again).unionByName(extra)
    preds = preds.withColumn("model", F.concat_ws("|", "model", "origin"))
    out = ranking.validate_predictions(preds, label_panel(spark, sf)).withColumn("is_valid", F.col("is_valid").cast("int"))
    return rounded(out, ["model", "rows", "missing_keys", "extra_keys", "duplicate_rows", "nulls", "is_valid"], REPORT)


PAIRS = [(a, b) for a in MODELS for b in MODELS if a < b]
DIST = LONG + """,
pairs as (select a.model as candidate, b.model as reference, a.horizon, abs(a.pred - b.pred) as gap from long a join long b using (region_id, origin, horizon) where a.model < b.model),
dist as (select candidate, reference, coalesce(horizon, 0) as horizon, avg(gap) as mae_distance, max(gap) as max_distance from pairs group by grouping sets ((candidate, reference, horizon), (candidate, reference)))"""


@query("j12_candidates_x_references", f"with {DIST} select candidate, reference, cast(count(*) as bigint) as rows, round(sum(gap) + 1e-9, 5) as gap_sum from pairs group by 1, 2")
def j12(spark, sf):
    rows = ranking.candidates_x_references(predictions(spark, sf), PAIRS, ["region_id", "origin"])
    return rounded(rows.groupBy("candidate", "reference").agg(F.count(F.lit(1)).alias("rows"), F.sum("gap").alias("gap_sum")), ["candidate", "reference", "rows"], ["gap_sum"], 5)


@query("r02_prediction_distances", f"with {DIST} select candidate, reference, horizon, {sql_rounded(['mae_distance', 'max_distance'])} from dist")
def r02(spark, sf):
    out = ranking.prediction_distances(predictions(spark, sf), PAIRS, ["region_id", "origin"])
    return rounded(out, ["candidate", "reference", "horizon"], ["mae_distance", "max_distance"])


SCORES = "scores(reference, public_score) as (values ('lgb', 0.81), ('xgb', 0.95), ('cat', 1.10))"


@query("r03_nearest_reference", f"""with {DIST}, {SCORES}, d as (select * from dist join scores using (reference) where horizon = 0)
select candidate, arg_min(reference, (round(mae_distance, 12), reference)) as nearest, round(min(mae_distance) + 1e-9, 6) as nearest_distance,
 arg_min(reference, (round(mae_distance, 12), reference)) filter (where public_score >= 0.9) as nearest_bad, round(min(mae_distance) filter (where public_score >= 0.9) + 1e-9, 6) as nearest_bad_distance,
 cast(count(*) filter (where public_score >= 0.9) as bigint) as bad_compared, cast(count(*) as bigint) as compared,
 case when min(mae_distance) filter (where public_score >= 0.9) < 0.05 then 'near_bad_failure_family' else 'not_near_local_bad_failure_family' end as risk_flag from d group by 1""")
def r03(spark, sf):
    distances = ranking.prediction_distances(predictions(spark, sf), PAIRS, ["region_id", "origin"])
    scores = spark.createDataFrame([("lgb", 0.81), ("xgb", 0.95), ("cat", 1.10)], "model string, public_score double")
    out = ranking.nearest_reference(distances, scores)
    return rounded(out, ["candidate", "nearest", "nearest_bad", "bad_compared", "compared", "risk_flag"], ["nearest_distance", "nearest_bad_distance"])


RISK = ["loo_mean_mae", "loo_std_mae", "loo_worst_mae", "mean_regret", "worst_regret", "risk_adjusted_score"]
NAMES = {"lgb": "raw", "xgb": "stack_mean", "cat": "affine_max"}


@query("r04_risk_adjusted_rank", f"""with {MAES}, n(model, name, old_rank) as (values ('lgb', 'raw', 2), ('xgb', 'stack_mean', 1), ('cat', 'affine_max', 3)),
named as (select origin, name as model, old_rank, mae from maes join n using (model)), b as (select named.*, mae - r.raw as regret from named join (select origin, mae as raw from named where model = 'raw') r using (origin)),
a as (select model, old_rank, avg(mae) as loo_mean_mae, stddev_pop(mae) as loo_std_mae, max(mae) as loo_worst_mae, avg(regret) as mean_regret, max(regret) as worst_regret,
 count(*) filter (where regret < 0) as wins, count(*) filter (where abs(regret) <= 1e-12) as ties, count(*) as origins from b group by 1, 2),
s as (select *, loo_mean_mae + 0.2 * loo_std_mae + 0.05 * loo_worst_mae + 0.5 * greatest(0, worst_regret) + 0.25 * greatest(0, mean_regret) + greatest(0, 4 - wins - ties) * 0.0015
 + case when model like '%calendar%' then 0.003 when model like '%affine%' then 0.0015 when model like '%stack%' then 0.0008 else 0 end as risk_adjusted_score from a),
k as (select *, row_number() over (order by round(risk_adjusted_score, 12), old_rank) as risk_rank from s)
select model, cast(wins as bigint) as wins, cast(ties as bigint) as ties, cast(origins as bigint) as origins, cast(risk_rank as integer) as risk_rank, case when risk_rank <= 2 then 'approved_for_submission_order' else 'defer_after_top2_risk_adjusted' end as status, {sql_rounded(RISK)} from k""")
def r04(spark, sf):
    named = maes(spark, sf).replace(NAMES, subset=["model"])
    manifest = spark.createDataFrame([("raw", 2), ("stack_mean", 1), ("affine_max", 3)], "model string, old_rank int")
    return rounded(ranking.risk_adjusted_rank(named, manifest, "raw", approved=2), ["model", "wins", "ties", "origins", "risk_rank", "status"], RISK)


CANDIDATES = """
manifest as (select p_partkey as rank, p_name as name, concat('out/part_', cast(p_partkey as varchar), '_', cast(p_size % 101 as varchar), '.csv') as path,
 case p_size % 5 when 0 then 'approved_for_submission_order' when 1 then 'blocked_public' when 2 then 'defer_later' when 3 then null else 'draft' end as status,
 case when p_size % 7 = 0 then 'do_not_submit' else 'open' end as slot_policy from part),
history as (select concat('part_', cast(l_partkey as varchar), '_', cast(l_suppkey % 101 as varchar), '.csv') as file_name, cast(strftime(l_shipdate, '%Y-%m-%d') as varchar) as submitted_at, l_discount as public_score from lineitem)"""


def manifest(spark, sf):
    c = F.col
    status = (F.when(c("p_size") % 5 == 0, "approved_for_submission_order").when(c("p_size") % 5 == 1, "blocked_public")
              .when(c("p_size") % 5 == 2, "defer_later").when(c("p_size") % 5 == 4, "draft"))
    return read_table(spark, sf, "part").select(
        c("p_partkey").alias("rank"), c("p_name").alias("name"), F.concat(F.lit("out/part_"), c("p_partkey").cast("string"), F.lit("_"), (c("p_size") % 101).cast("string"), F.lit(".csv")).alias("path"),
        status.alias("status"), F.when(c("p_size") % 7 == 0, "do_not_submit").otherwise("open").alias("slot_policy"))


def history(spark, sf):
    c = F.col
    return read_table(spark, sf, "lineitem").select(
        F.concat(F.lit("part_"), c("l_partkey").cast("string"), F.lit("_"), (c("l_suppkey") % 101).cast("string"), F.lit(".csv")).alias("file_name"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("submitted_at"), c("l_discount").alias("public_score"))


@query("r05_guard_manifest", f"""with {CANDIDATES}, seen as (select distinct file_name from history),
r as (select m.*, coalesce(status, '') as st, s.file_name is not null as live from manifest m left join seen s on concat('out/', s.file_name) = m.path)
select rank, path, cast(live as integer) as live_seen, case when st = 'approved_for_submission_order' then case when live then 'already_submitted_skip' else 'ready_for_next_quota' end
 when st like 'blocked\\_%' escape '\\' or slot_policy = 'do_not_submit' then case when live then 'blocked_but_already_submitted_public_bad_skip_forever' else 'blocked_do_not_submit' end
 when st like 'defer\\_%' escape '\\' then 'deferred_do_not_submit_now' else 'manual_review' end as decision from r""")
def r05(spark, sf):
    return ranking.guard_manifest(manifest(spark, sf), history(spark, sf)).select("rank", "path", F.col("live_seen").cast("int").alias("live_seen"), "decision")


SLATE = """
cand as (select p_partkey as id, concat('c', cast(p_partkey as varchar)) as name, concat(case when p_size % 11 = 0 then 'restored_unverified_' else '' end, 'part_', cast(p_partkey as varchar), '_', cast(p_size % 101 as varchar), '.csv') as file_name,
 concat('h', cast(p_partkey % 1500 as varchar)) as sha, case when p_size % 3 > 0 then p_retailprice / 1000 end as blind_mae, case when p_size % 4 > 0 then p_retailprice / 1500 end as rolling_mae,
 p_size as priority, p_size % 2 = 0 as reportable from part)"""


def slate_candidates(spark, sf):
    c, key = F.col, F.col("p_partkey").cast("string")
    return read_table(spark, sf, "part").select(
        c("p_partkey").alias("id"), F.concat(F.lit("c"), key).alias("name"),
        F.concat(F.when(c("p_size") % 11 == 0, "restored_unverified_").otherwise(""), F.lit("part_"), key, F.lit("_"), (c("p_size") % 101).cast("string"), F.lit(".csv")).alias("file_name"),
        F.concat(F.lit("h"), (c("p_partkey") % 1500).cast("string")).alias("sha"),
        F.when(c("p_size") % 3 > 0, c("p_retailprice") / 1000).alias("blind_mae"), F.when(c("p_size") % 4 > 0, c("p_retailprice") / 1500).alias("rolling_mae"),
        c("p_size").alias("priority"), (c("p_size") % 2 == 0).alias("reportable"))


@query("r06_choose_slate", f"""with {CANDIDATES}, {SLATE}, used as (select count(*) as n from history where submitted_at like '1998-03-04%'),
u as (select *, row_number() over (order by coalesce(blind_mae, 999), coalesce(rolling_mae, 999), priority, name) as o from cand
 where file_name not like '%restored\\_unverified\\_%' escape '\\' and file_name not in (select file_name from history) and sha not in (select concat('h', cast(s_suppkey as varchar)) from supplier)),
f as (select *, case when o = (select min(o) from u where reportable) then 0 when not reportable then 1 else 2 end as grp from u),
s as (select *, row_number() over (order by grp, o) as slot from f)
select id, name, cast(slot as integer) as slot from s, used where slot <= greatest(0, 40 - n)""")
def r06(spark, sf):
    used = read_table(spark, sf, "supplier").select(F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("sha"))
    return ranking.choose_slate(slate_candidates(spark, sf), history(spark, sf), used, 40, "1998-03-04", "restored_unverified_").select("id", "name", "slot")


@query("l03_rank_candidates", f"""with {SLATE} select id, cast(row_number() over (order by coalesce(blind_mae, 999), coalesce(rolling_mae, 999), priority, name) as integer) as rank from cand""")
def l03(spark, sf):
    return ranking.rank_candidates(slate_candidates(spark, sf), ["blind_mae", "rolling_mae"], ["priority", "name"]).select("id", "rank")


SUBMITTED = """
submitted as (select concat('out/', cast(o_orderkey as varchar)) as path, strftime(o_orderdate, '%Y%m') as ledger,
 case when o_orderkey % 10 > 0 then 0.79 + o_totalprice / 50000000 end as public_mae, case when o_orderkey % 6 > 0 then (o_orderkey % 97) / 500.0 end as delta_to_anchor from orders),
best as (select min(public_mae) as b from submitted),
scored as (select s.*, public_mae - b as public_gap, public_mae - b <= 0.0005 + 1e-12 as within_close, public_mae - b <= 0.0020 + 1e-12 as within_tolerance,
 0.55 * ((public_mae - b) / 0.0020) + 0.45 * (delta_to_anchor / 0.18) as robust_score, coalesce(nullif(delta_to_anchor, 0), 9) as d from submitted s, best where public_mae is not null)"""


def submitted(spark, sf):
    c = F.col
    return read_table(spark, sf, "orders").select(
        F.concat(F.lit("out/"), c("o_orderkey").cast("string")).alias("path"), F.date_format("o_orderdate", "yyyyMM").alias("ledger"),
        F.when(c("o_orderkey") % 10 > 0, 0.79 + c("o_totalprice") / 50000000).alias("public_mae"),
        F.when(c("o_orderkey") % 6 > 0, (c("o_orderkey") % 97) / 500.0).alias("delta_to_anchor"))


@query("r07_robust_score", f"""with {SUBMITTED} select path, cast(within_close as integer) as within_close, cast(within_tolerance as integer) as within_tolerance,
 cast(row_number() over (order by public_mae, d, path) as integer) as public_rank, case when robust_score is not null then cast(row_number() over (order by robust_score nulls last, path) as integer) end as robust_rank,
 round(public_gap + 1e-9, 6) as public_gap, round(robust_score + 1e-9, 6) as robust_score from scored""")
def r07(spark, sf):
    out = ranking.robust_score(submitted(spark, sf)).withColumns({c: F.col(c).cast("int") for c in ("within_close", "within_tolerance")})
    return rounded(out, ["path", "within_close", "within_tolerance", "public_rank", "robust_rank"], ["public_gap", "robust_score"])


@query("r08_select_pair", f"""with {SUBMITTED}, b as (select path from scored order by public_mae, d, path limit 1), n as (select max(ledger) as l from scored)
select (select path from b) as public_best,
 (select path from scored, n where ledger = l and within_close order by d, public_mae, path limit 1) as near_best_hedge,
 (select path from scored, n where ledger = l and within_close and path <> (select path from b) order by public_mae, d, path limit 1) as alternate,
 (select path from scored where within_tolerance order by d, public_mae, path limit 1) as fallback""")
def r08(spark, sf):
    return ranking.select_pair(ranking.score_gaps(submitted(spark, sf)))
