"""Weekly samples, splits, weights and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.fixed import MEASURES
from isohyet.functions.blocks import with_day_index, with_position
from isohyet.functions.dates import parse_synthetic_date
from isohyet.functions.numeric import r6
from isohyet.operators import features as ft
from isohyet.operators import samples, sequences
from isohyet.queries.registry import KEYS, PANEL, SPLIT, panel, query, rounded, splits, sql_rounded

WEEKLY = PANEL + """,
weekly as (select *, cast(row_number() over (partition by region_id order by day_idx) - 1 as integer) as week_idx,
 cast(count(*) over (partition by region_id) - 1 as integer) as max_week_idx, """ + ", ".join(
    f"lead(score, {h}) over (partition by region_id order by day_idx) as target_w{h}" for h in range(1, 6)) + """
 from dated where score is not null),
sample as (select * from weekly where target_w5 is not null)"""
TARGETS = ", ".join(samples.TARGETS)


def weekly(spark, sf):
    return parse_synthetic_date(samples.lead_targets(panel(spark, sf).select(*KEYS, "date", "score")))


@query("w01_row_index", f"with {WEEKLY} select region_id, day_idx, week_idx, max_week_idx from weekly")
def w01(spark, sf):
    return samples.row_index(panel(spark, sf).select(*KEYS, "score")).select(*KEYS, "week_idx", "max_week_idx")


@query("w01_day_index", f"with {PANEL} select region_id, date, cast(row_number() over (partition by region_id order by year, month, day) - 1 as integer) as day_idx from dated")
def w01_day(spark, sf):
    return with_day_index(parse_synthetic_date(panel(spark, sf).select("region_id", "date"))).select("region_id", "date", "day_idx")


@query("w12_lead_targets", f"with {WEEKLY} select region_id, day_idx, week_idx, max_week_idx, {TARGETS} from sample")
def w12(spark, sf):
    return weekly(spark, sf).select(*KEYS, "week_idx", "max_week_idx", *samples.TARGETS)


@query("w14_date_rank", f"with {PANEL} select region_id, day_idx, cast(dense_rank() over (order by year, month, day) - 1 as integer) as date_rank from dated")
def w14(spark, sf):
    return samples.date_rank(parse_synthetic_date(panel(spark, sf).select(*KEYS, "date"))).select(*KEYS, "date_rank")


RANKED = WEEKLY + ", ranked as (select *, dense_rank() over (order by year, month, day) - 1 as date_rank from sample)"


@query("f02_recent_filter", f"with {RANKED} select region_id, day_idx, cast(date_rank as integer) as date_rank from ranked where date_rank >= (select max(date_rank) from ranked) - 521")
def f02(spark, sf):
    return samples.recent_filter(weekly(spark, sf), 3650).select(*KEYS, "date_rank")


JOIN_COLS = {"tmp_rmean28": "avg(tmp) over (partition by region_id order by day_idx rows between 28 preceding and 1 preceding)",
             "prec_rmean28": "avg(prec) over (partition by region_id order by day_idx rows between 28 preceding and 1 preceding)"}


@query("j01_labels_join_features", f"""with {WEEKLY}, feat as (select region_id, date, {", ".join(f"{v} as {k}" for k, v in JOIN_COLS.items())} from panel)
select region_id, day_idx, {TARGETS}, {sql_rounded(list(JOIN_COLS))} from sample left join feat using (region_id, date)""")
def j01(spark, sf):
    features = ft.rolling(panel(spark, sf).select(*KEYS, "date", "tmp", "prec"), ["tmp", "prec"], [28], ["mean"])
    return rounded(samples.labels_join_features(weekly(spark, sf), features), [*KEYS, *samples.TARGETS], list(JOIN_COLS))


@query("v01_holdout_split", f"""with {WEEKLY} select region_id, day_idx, cast(week_idx + 3 < floor(max_week_idx * 0.8) as integer) as is_train,
 cast(week_idx >= floor(max_week_idx * 0.8) as integer) as is_val from sample""")
def v01(spark, sf):
    out = samples.holdout_split(weekly(spark, sf), horizon=3)
    return out.select(*KEYS, F.col("is_train").cast("int").alias("is_train"), F.col("is_val").cast("int").alias("is_val"))


@query("v02_rolling_origin_split", f"""with {WEEKLY} select region_id, day_idx, fold, cast(week_idx + 2 < max_week_idx - o as integer) as is_train,
 cast(week_idx = max_week_idx - o as integer) as is_val from sample cross join (values (0, 7), (1, 6), (2, 5)) f(fold, o)""")
def v02(spark, sf):
    out = samples.rolling_origin_split(weekly(spark, sf), folds=3, horizon=2)
    return out.select(*KEYS, "fold", F.col("is_train").cast("int").alias("is_train"), F.col("is_val").cast("int").alias("is_val"))


@query("v03_expanding_date_split", f"""with {RANKED}, c as (select max(date_rank) + 1 n from ranked),
f as (select fold, (n // 4) * (fold + 1) cut, least((n // 4) * (fold + 2), n - 1) stop from c, (values (0), (1), (2)) v(fold))
select region_id, day_idx, fold, cast(date_rank < cut as integer) as is_train, cast(date_rank >= cut and date_rank < stop as integer) as is_val
from ranked cross join f where date_rank < stop""")
def v03(spark, sf):
    out = samples.expanding_date_split(weekly(spark, sf), 3)
    return out.select(*KEYS, "fold", F.col("is_train").cast("int").alias("is_train"), F.col("is_val").cast("int").alias("is_val"))


@query("v04_sequence_split", f"""with {WEEKLY}, r as (select *, row_number() over (partition by region_id order by week_idx) - 1 as rk,
 count(*) over (partition by region_id) - 1 as mx from sample where day_idx >= 90), s as (select *, greatest(0, mx - 11) as st from r)
select region_id, day_idx, cast(rk + 5 < st as integer) as is_train, cast(rk >= st as integer) as is_val from s""")
def v04(spark, sf):
    out = samples.require_both_sides(samples.sequence_split(weekly(spark, sf).filter("day_idx >= 90"), val_weeks=12, purge_weeks=5))
    return out.select(*KEYS, F.col("is_train").cast("int").alias("is_train"), F.col("is_val").cast("int").alias("is_val"))


REGION_AGE = "pow(0.5, (max_week_idx - week_idx) * 7.0 / 365)"


@query("v05_recency_weights", f"""with {WEEKLY}, w as (select region_id, day_idx, {REGION_AGE} as raw from sample)
select region_id, day_idx, round(least(20.0, greatest(0.05, raw / (select avg(raw) from w))) + 1e-9, 6) as weight from w""")
def v05(spark, sf):
    return rounded(samples.recency_weights(weekly(spark, sf), 365), KEYS, ["weight"])


@query("v05_recency_weights_global", f"""with {RANKED}, w as (select region_id, day_idx, pow(0.5, ((select max(date_rank) from ranked) - date_rank) * 7.0 / 36500) as raw from ranked)
select region_id, day_idx, round(least(20.0, greatest(0.05, raw / (select avg(raw) from w))) + 1e-9, 6) as weight from w""")
def v05_global(spark, sf):
    return rounded(samples.recency_weights(weekly(spark, sf), 36500, mode="global"), KEYS, ["weight"])


@query("v06_season_weights", f"""with {WEEKLY}, k as (select distinct region_id, month * 100 + day as md from dated where day_idx >= (select max(day_idx) - 90 from panel)),
w as (select *, {REGION_AGE} as raw from sample), n as (select *, least(20.0, greatest(0.05, raw / (select avg(raw) from w))) as w1 from w),
m as (select n.*, k.md is not null as hit, w1 * case when k.md is not null then 2.5 else 1 end as w2 from n left join k on k.region_id = n.region_id and k.md = n.month * 100 + n.day)
select region_id, day_idx, cast(hit as integer) as season_match, round(least(20.0, greatest(0.05, w2 / (select avg(w2) from m))) + 1e-9, 6) as weight from m""")
def v06(spark, sf):
    _, test = splits(spark, sf)
    out = samples.season_weights(samples.recency_weights(weekly(spark, sf), 365), test, 2.5)
    return rounded(out.withColumn("season_match", F.col("season_match").cast("int")), [*KEYS, "season_match"], ["weight"])


PRIOR_COLS = ["visible_score_mean", "visible_score_std", "visible_score_max", "visible_score_eq0_ratio", "visible_score_ge3_ratio",
              "recent365_score_mean", "recent365_score_eq0_ratio", "recent730_score_mean", "recent730_score_ge3_ratio", "monthly_score_mean"]


@query("w15_visible_label_priors", f"""with {WEEKLY}, g as (select median(score) as v from weekly),
o as (select t.region_id, t.day_idx, g.v, count(l.score) as n, avg(l.score) as m, stddev_pop(l.score) as sd, max(l.score) as mx,
  avg(cast(l.score = 0 as integer)) as e0, avg(cast(l.score >= 3 as integer)) as g3,
  avg(l.score) filter (where l.day_idx > t.day_idx - 91 - 365) as m365, avg(cast(l.score = 0 as integer)) filter (where l.day_idx > t.day_idx - 91 - 365) as z365,
  avg(l.score) filter (where l.day_idx > t.day_idx - 91 - 730) as m730, avg(cast(l.score >= 3 as integer)) filter (where l.day_idx > t.day_idx - 91 - 730) as h730,
  avg(l.score) filter (where l.month = t.month) as mm
 from weekly t cross join g left join weekly l on l.region_id = t.region_id and l.day_idx <= t.day_idx - 91 group by 1, 2, 3),
f as (select region_id, day_idx, coalesce(m, v) as visible_score_mean, coalesce(sd, 0) as visible_score_std, coalesce(mx, v) as visible_score_max,
  coalesce(e0, cast(v = 0 as integer)) as visible_score_eq0_ratio, coalesce(g3, cast(v >= 3 as integer)) as visible_score_ge3_ratio,
  coalesce(m365, v) as recent365_score_mean, coalesce(z365, cast(v = 0 as integer)) as recent365_score_eq0_ratio,
  coalesce(m730, v) as recent730_score_mean, coalesce(h730, cast(v >= 3 as integer)) as recent730_score_ge3_ratio, coalesce(mm, v) as monthly_score_mean from o)
select region_id, day_idx, {sql_rounded(PRIOR_COLS)} from f""")
def w15(spark, sf):
    rows = panel(spark, sf).select(*KEYS, "date", "score")
    return rounded(samples.visible_label_priors(rows, samples.label_median(rows)), KEYS, PRIOR_COLS)


CHECKED = [f"{kind}_{c}" for c in MEASURES for kind in ("weighted", "first", "last")]


@query("w16_sequence_samples", f"""with {WEEKLY}, g as (select median(score) as v from weekly),
known as (select region_id, day_idx, last_value(score ignore nulls) over (partition by region_id order by day_idx) as ks from panel),
lagged as (select region_id, day_idx, lag(ks, 91) over (partition by region_id order by day_idx) as prev from known),
o as (select s.region_id, s.day_idx, {TARGETS}, coalesce(l.prev, g.v) as previous_score from sample s join lagged l using (region_id, day_idx) cross join g where s.day_idx >= 90),
d as (select o.region_id, o.day_idx, count(*) as days, {", ".join(f"sum(coalesce(p.{c}, 0) * (p.day_idx - o.day_idx + 91)) as weighted_{c}, max(case when p.day_idx = o.day_idx - 90 then p.{c} end) as first_{c}, max(case when p.day_idx = o.day_idx then p.{c} end) as last_{c}" for c in MEASURES)}
 from o join panel p on p.region_id = o.region_id and p.day_idx between o.day_idx - 90 and o.day_idx group by 1, 2)
select region_id, day_idx, {TARGETS}, previous_score, cast(days as integer) as days, {sql_rounded(CHECKED, 4)} from o join d using (region_id, day_idx)""")
def w16(spark, sf):
    """The arrays are checked through their length, and for every measure the ends and a position-weighted sum."""
    rows = panel(spark, sf).select(*KEYS, "date", "score", *MEASURES)
    seq = samples.sequence_samples(rows, samples.label_median(rows))
    sums = F.aggregate(
        F.transform("sequence", lambda s, i: F.array(*[F.coalesce(s[c], F.lit(0.0)) * (i + 1) for c in MEASURES])), F.array(*[F.lit(0.0)] * len(MEASURES)),
        lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    flat = seq.select(*KEYS, *samples.TARGETS, "previous_score", F.size("sequence").alias("days"), sums.alias("_w"), F.element_at("sequence", 1).alias("_a"), F.element_at("sequence", -1).alias("_z"))
    flat = flat.withColumns({n: x for i, c in enumerate(MEASURES) for n, x in ((f"weighted_{c}", F.col("_w")[i]), (f"first_{c}", F.col("_a")[c]), (f"last_{c}", F.col("_z")[c]))})
    return rounded(flat, [*KEYS, *samples.TARGETS, "previous_score", "days"], CHECKED, 4)


@query("a11_sequence_norm", f"""with {WEEKLY}, s as (select region_id, day_idx from sample where day_idx >= 90 and week_idx + 40 < max_week_idx),
c as (select {", ".join(f"avg({c}) as m_{c}, avg({c} * {c}) as q_{c}" for c in MEASURES)} from panel p join s on s.region_id = p.region_id and p.day_idx between s.day_idx - 90 and s.day_idx),
m as ({" union all ".join(f"select '{c}' as feature, m_{c} as mean, q_{c} as sq from c" for c in MEASURES)})
select feature, round(mean + 1e-9, 5) as mean, round(sqrt(greatest(sq - mean * mean, 1e-6)) + 1e-9, 5) as std from m""")
def a11(spark, sf):
    rows = panel(spark, sf).select(*KEYS, "score", *MEASURES)
    train = samples.lead_targets(rows).filter("day_idx >= 90 and week_idx + 40 < max_week_idx")
    return rounded(sequences.sequence_norm(rows, train, MEASURES), ["feature"], ["mean", "std"], 5)
