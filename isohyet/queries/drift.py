"""Drift statistics between the train slices and the test window."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.fixed import DRIFT_COLUMNS, DRIFT_RAW, DRIFT_TREE_COLUMNS, HOT_FROM, MEASURES
from isohyet.operators import adversarial, drift
from isohyet.operators import features as ft
from isohyet.operators.quantiles import SORTED_FILES
from isohyet.queries.features import DAILY
from isohyet.queries.registry import KEYS, PANEL, SPLIT, is_kept, kept, over, panel, query, rounded, sql_rounded, stored, trailing
from isohyet.session import materialize
from isohyet.sources.derived import calendar_bounds, flag_splits

COLUMNS = MEASURES
BASE = drift.SEASON_BASELINES


def both(spark, sf):
    return flag_splits(panel(spark, sf), calendar_bounds(spark, sf)[2] - 1)


def _long(columns: list[str], ctes: str, source: str = "rows_") -> str:
    parts = " union all ".join(f"select baseline, '{c}' as feature, {c} as value from {source} where {c} is not null" for c in columns)
    return f"{ctes}, long as ({parts})"


TAILS = SPLIT + """, ends as (select max(day_idx) as last_idx from train),
rows_ as (select 'tail_365d' as baseline, train.* exclude (score) from train, ends where last_idx - day_idx < 365
 union all select 'full_train', * exclude (score) from train union all select 'test', * from test)"""

SEASONS = SPLIT + """, ends as (select max(day_idx) as last_idx from train),
ord as (select *, month * 100 + day as md, cast(year as bigint) * 366 + list_extract([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334], month) + day as ordinal from dated),
tr as (select ord.* from ord, ends where day_idx <= last_idx), te as (select ord.* from ord, ends where day_idx > last_idx),
keys_ as (select distinct region_id, md from te), starts as (select region_id, min(ordinal) as test_start from te group by 1),
years as (select distinct region_id, md, year as test_year from te),
same as (select tr.* from tr join keys_ using (region_id, md)),
prev as (select tr.* from tr join years y on y.region_id = tr.region_id and y.md = tr.md and tr.year < y.test_year
 qualify row_number() over (partition by tr.region_id, tr.md, y.test_year order by tr.year desc) = 1),
tagged as (select 'full_train' as baseline, * from tr union all select 'tail_1095d', tr.* from tr, ends where last_idx - day_idx < 1095
 union all select 'tail_365d', tr.* from tr, ends where last_idx - day_idx < 365 union all select 'adjacent_prev_91d', tr.* from tr, ends where last_idx - day_idx < 91
 union all select 'same_md_all_years', * from same union all select 'same_md_recent_5y', s.* from same s join starts using (region_id) where s.ordinal >= test_start - 1830
 union all select 'prev_year_same_md', * from prev union all select 'test', * from te)"""


def metrics(bins: int = 10) -> str:
    """PSI (plain and adaptive), KS and quantile distance of every (feature, baseline) in `long`."""
    return f"""
pairs as (select distinct feature, baseline from long where baseline <> 'test'),
sized as (select feature, baseline, count(*) as n from long group by 1, 2),
vc as (select feature, baseline, value, count(*) as n from long group by 1, 2, 3),
vals as (select p.feature, p.baseline, v.value, sum(case when v.baseline = p.baseline then v.n else 0 end) as n, sum(case when v.baseline = 'test' then v.n else 0 end) as m
 from pairs p join vc v on v.feature = p.feature and (v.baseline = p.baseline or v.baseline = 'test') group by 1, 2, 3),
cum as (select *, sum(n) over w / sum(n) over g as ce, sum(m) over w / sum(m) over g as ca, sum(n) over g as t, sum(m) over g as u, count(*) over g as distinct_values
 from vals window w as (partition by feature, baseline order by value), g as (partition by feature, baseline)),
ks as (select feature, baseline, max(abs(ce - ca)) as ks from cum group by 1, 2),
edges as (select feature, baseline, list_sort(list_distinct(quantile_cont(value, [{", ".join(f"{p!r}" for p in drift.even_probs(bins))}]))) as e from long where baseline <> 'test' group by 1, 2),
binned as (select c.feature, c.baseline, len(list_filter(e[2:len(e) - 1], lambda x: x <= c.value)) as bin, len(e) as cuts, sum(n) as n, sum(m) as m, max(t) as t, max(u) as u
 from cum c join edges using (feature, baseline) group by 1, 2, 3, 4),
terms as (select feature, baseline, cuts, greatest(n / t, 1e-6) as e, greatest(m / u, 1e-6) as a from binned),
psi_plain as (select feature, baseline, case when max(cuts) < 3 then 0.0 else sum((a - e) * ln(a / e)) end as psi from terms group by 1, 2),
psi_values as (select feature, baseline, max(distinct_values) as distinct_values, sum((greatest(m / u, 1e-6) - greatest(n / t, 1e-6)) * ln(greatest(m / u, 1e-6) / greatest(n / t, 1e-6))) as psi from cum group by 1, 2),
psi_adaptive as (select feature, baseline, case when distinct_values <= 20 then v.psi else p.psi end as psi from psi_values v join psi_plain p using (feature, baseline)),
qs as (select feature, baseline, unnest(range(101)) as i, unnest(quantile_cont(value, [{", ".join(f"{p!r}" for p in drift.even_probs(100))}])) as q from long group by 1, 2),
wd as (select a.feature, a.baseline, avg(abs(a.q - b.q)) as q_wasserstein from qs a join qs b on a.feature = b.feature and a.i = b.i and b.baseline = 'test' where a.baseline <> 'test' group by 1, 2)"""


TAIL_NAMES = ["tail_365d", "full_train"]


SWEEP_TAILS = [1095, 1825, 0]


def tail_table(spark, sf):
    """One sorted table of all measures and all tails, which d01 to d04 and d10 read."""
    tails = sorted({365, *SWEEP_TAILS})
    return kept(spark, sf, "tail_drift", lambda: drift.drift_counts(drift.tail_baselines(both(spark, sf), tails), COLUMNS, [drift.tail_name(n) for n in tails]))


@query("d01_psi", f"with {_long(COLUMNS, TAILS)}, {metrics()} select feature, baseline, round(psi + 1e-9, 6) as psi from psi_plain")
def d01(spark, sf):
    return rounded(drift.psi(tail_table(spark, sf), TAIL_NAMES), ["feature", "baseline"], ["psi"])


@query("d02_psi_adaptive", f"with {_long(COLUMNS, TAILS)}, {metrics()} select feature, baseline, round(psi + 1e-9, 6) as psi from psi_adaptive")
def d02(spark, sf):
    return rounded(drift.psi(tail_table(spark, sf), TAIL_NAMES, adaptive=True), ["feature", "baseline"], ["psi"])


@query("d03_ks", f"with {_long(COLUMNS, TAILS)}, {metrics()} select feature, baseline, round(ks + 1e-9, 6) as ks from ks")
def d03(spark, sf):
    return rounded(drift.ks(tail_table(spark, sf), TAIL_NAMES), ["feature", "baseline"], ["ks"])


@query("d04_quantile_wasserstein", f"with {_long(COLUMNS, TAILS)}, {metrics()} select feature, baseline, round(q_wasserstein + 1e-9, 6) as q_wasserstein from wd")
def d04(spark, sf):
    return rounded(drift.quantile_wasserstein(tail_table(spark, sf), TAIL_NAMES), ["feature", "baseline"], ["q_wasserstein"])


@query("d08_season_baselines", f"with {SEASONS} select baseline, cast(count(*) as bigint) as rows, cast(sum(day_idx) as bigint) as day_sum from tagged group by 1")
def d08(spark, sf):
    flagged = drift.season_baselines(both(spark, sf).select(*KEYS, "date", "split"))
    sides = [*BASE, drift.TEST]
    row = flagged.agg(*[f.alias(f"{s}_{n}") for s in sides for n, f in (("n", F.count_if(s)), ("s", F.sum(F.when(F.col(s), F.col("day_idx")))))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(s).alias("baseline"), F.col(f"{s}_n").alias("rows"), F.col(f"{s}_s").alias("day_sum")) for s in sides])).alias("r")).select("r.*")


TABLE_COLUMNS = DRIFT_COLUMNS
DRY, HOT = "case when prec < 0.1 then 1.0 else 0.0 end", f"case when tmp_max >= {HOT_FROM} then 1.0 else 0.0 end"
ROLLING = {
    **{f"prec_sum_{w}d": f"sum(prec) {trailing(w)}" for w in (30, 90, 180)}, **{f"dry_days_{w}d": f"sum({DRY}) {trailing(w)}" for w in (30, 90)},
    "dry_share_90d": f"sum({DRY}) {trailing(90)} / nullif(sum(1.0) {trailing(90)}, 0)",
    "rain_days_90d": f"sum(case when prec >= 1 then 1.0 else 0.0 end) {trailing(90)}", "hot_days_90d": f"sum({HOT}) {trailing(90)}",
    "tmp_mean_90d": f"avg(tmp) {trailing(90)}", "humidity_mean_90d": f"avg(humidity) {trailing(90)}",
    "dew_depression_mean_90d": f"avg(tmp - dp_tmp) {trailing(90)}", "wet_bulb_depression_mean_90d": f"avg(tmp - wb_tmp) {trailing(90)}",
    "max_dry_streak_90d": f"coalesce(cast(max(streak) {trailing(90)} as double), 0)",
    "rolling_drought_idx_90d": f"avg(tmp) {trailing(90)} / nullif(sum(prec) {trailing(90)} + 0.1, 0)",
}
STREAKS = """(select *, day_idx - coalesce(max(case when not coalesce(prec < 0.1, false) then day_idx end) over (partition by region_id order by day_idx),
 min(day_idx) over (partition by region_id) - 1) as streak from panel)"""
EXTRA = {k: v for k, v in {**DAILY, **ROLLING}.items()}
FULL = SEASONS + f""", extra as (select region_id, day_idx, {", ".join(f"{v} as {k}" for k, v in EXTRA.items())} from {STREAKS}),
rows_ as (select t.*, extra.* exclude (region_id, day_idx) from tagged t join extra using (region_id, day_idx))"""
VALUES = ["train_mean", "test_mean", "mean_delta", "std_mean_delta", "train_p10", "train_p50", "train_p90", "test_p10", "test_p50", "test_p90", "psi", "ks"]
TABLE_SQL = f"""with {_long(TABLE_COLUMNS, FULL)}, {metrics()},
mom as (select feature, baseline, count(*) as n, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.1) as p10, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.9) as p90 from long group by 1, 2),
tab as (select a.feature, a.baseline, cast(a.n as bigint) as train_non_null, cast(b.n as bigint) as test_non_null, a.mean as train_mean, b.mean as test_mean, b.mean - a.mean as mean_delta,
 case when a.sd > 0 then (b.mean - a.mean) / a.sd end as std_mean_delta, a.p10 as train_p10, a.p50 as train_p50, a.p90 as train_p90, b.p10 as test_p10, b.p50 as test_p50, b.p90 as test_p90, p.psi, k.ks
 from mom a join mom b on a.feature = b.feature and b.baseline = 'test' join psi_adaptive p on p.feature = a.feature and p.baseline = a.baseline join ks k on k.feature = a.feature and k.baseline = a.baseline where a.baseline <> 'test')"""


def fresh_rows(spark, sf):
    """Train and test days with every column of the comparison and the baselines they belong to.

    Baselines are flagged where the panel lies, before rows are wide; windows then deal them once and nothing after them does.
    """
    flagged = drift.season_baselines(both(spark, sf).select(*KEYS, "date", "split", *DRIFT_RAW))
    rows = ft.context_columns(flagged.select(*KEYS, *DRIFT_RAW, *BASE, drift.TEST))
    return rows.select(*KEYS, *TABLE_COLUMNS, *BASE, drift.TEST)


def flagged_rows(spark, sf):
    """These rows stored, for the classifiers, which read them many times."""
    return kept(spark, sf, "drift_rows", lambda: materialize(fresh_rows(spark, sf), "drift_rows", **SORTED_FILES))


def full_table(spark, sf):
    """Rows are read once, for their counts, so wide rows are only stored where the classifiers need them."""
    rows = flagged_rows if is_kept(spark, sf, "drift_rows") else fresh_rows
    return stored(spark, sf, "drift_table", lambda: drift.feature_drift_table(rows(spark, sf), TABLE_COLUMNS, BASE))


@query("d09_feature_drift_table", f"{TABLE_SQL} select feature, baseline, train_non_null, test_non_null, {sql_rounded(VALUES, 5)} from tab")
def d09(spark, sf):
    return rounded(full_table(spark, sf), ["feature", "baseline", "train_non_null", "test_non_null"], VALUES, 5)


@query("d09_drift_averages", f"{TABLE_SQL} select baseline, round(avg(psi) + 1e-9, 5) as avg_psi, round(avg(ks) + 1e-9, 5) as avg_ks, cast(count(*) as bigint) as features from tab group by 1")
def d09_avg(spark, sf):
    return rounded(drift.drift_averages(full_table(spark, sf)), ["baseline", "features"], ["avg_psi", "avg_ks"], 5)


@query("l01_top_drift", f"""{TABLE_SQL} select feature, baseline, cast(row_number() over (partition by baseline order by round(psi, 9) desc nulls last, round(abs(std_mean_delta), 9) desc nulls last, feature) as integer) as rank,
 round(psi + 1e-9, 5) as psi from tab qualify row_number() over (partition by baseline order by round(psi, 9) desc nulls last, round(abs(std_mean_delta), 9) desc nulls last, feature) <= 5""")
def l01(spark, sf):
    return rounded(drift.top_drift(full_table(spark, sf), 5), ["feature", "baseline", "rank"], ["psi"], 5)


SWEEP = SPLIT + """, ends as (select max(day_idx) as last_idx from train),
rows_ as (""" + " union all ".join(
    f"select '{drift.tail_name(n)}' as baseline, train.* exclude (score) from train, ends where last_idx - day_idx < {n or 10**9}" for n in (1095, 1825, 0)) + """
 union all select 'test', * from test)"""


@query("d10_tail_sweep", f"""with {_long(MEASURES, SWEEP)}, {metrics()}
select baseline, round(avg(psi) + 1e-9, 5) as avg_psi, round(avg(ks) + 1e-9, 5) as avg_ks, round(avg(q_wasserstein) + 1e-9, 5) as avg_q_wasserstein
from psi_plain join ks using (feature, baseline) join wd using (feature, baseline) group by 1""")
def d10(spark, sf):
    return rounded(drift.sweep_averages(tail_table(spark, sf), [drift.tail_name(n) for n in SWEEP_TAILS]), ["baseline"], ["avg_psi", "avg_ks", "avg_q_wasserstein"], 5)


@query("d11_bounded_sample", f"""with {SPLIT}, r as (select region_id, day_idx, prec, 'train' as split from train union all select region_id, day_idx, prec, 'test' from test)
select region_id, day_idx, split, round(prec + 1e-9, 6) as prec from r
qualify row_number() over (partition by split order by md5(concat_ws('|', region_id, cast(day_idx as varchar), '42')), region_id, day_idx) <= 900""")
def d11(spark, sf):
    rows = both(spark, sf).select(*KEYS, "split", "prec")
    return rounded(drift.bounded_sample(rows, 900, 42, KEYS, side="split"), [*KEYS, "split"], ["prec"])


HIST = SPLIT + """, r as (select *, 'train' as split from train union all by name select *, 'test' as split from test), f as (""" + " union all ".join(
    f"select split, {c} as value, '{c}' as feature from r" for c in MEASURES) + """
 union all select split, case when prec < 0.1 then 1.0 else 0.0 end, 'dry_day' from r), v as (select * from f where value is not null)"""


@query("d12_histogram_table", f"""with {HIST}, q as (select feature, quantile_cont(value, 0.005) as a, quantile_cont(value, 0.995) as b, min(cast(value in (0.0, 1.0) as integer)) = 1 as bin01 from v group by 1),
l as (select feature, bin01, a - (b - a) * 0.03 as low, b + (b - a) * 0.03 as high from q),
s as (select v.feature, split, case when bin01 then cast(value as integer) else cast(least(39, floor((least(high, greatest(low, value)) - low) / ((high - low) / 40))) as integer) end as bin,
 case when bin01 then 1.0 else (high - low) / 40 end as w from v join l using (feature)),
c as (select feature, split, bin, count(*) as rows, max(w) as w from s group by 1, 2, 3)
select feature, split, bin, cast(rows as bigint) as rows, round(rows / sum(rows) over (partition by feature, split) / w + 1e-9, 6) as density from c""")
def d12(spark, sf):
    rows = ft.daily_derived(both(spark, sf))
    return rounded(drift.histogram_table(rows, [*MEASURES, "dry_day"], 40), ["feature", "split", "bin", "rows"], ["density"])


@query("d12_ecdf_table", f"""with {HIST}, c as (select feature, split, value, count(*) as n from v where feature in ('prec', 'tmp') group by 1, 2, 3)
select feature, split, round(value + 1e-9, 6) as value, round(sum(n) over (partition by feature, split order by value) / sum(n) over (partition by feature, split) + 1e-9, 6) as ecdf from c""")
def d12_ecdf(spark, sf):
    return rounded(drift.ecdf_table(both(spark, sf), ["prec", "tmp"]), ["feature", "split"], ["value", "ecdf"])


@query("d12_centre_table", f"with {HIST} select feature, split, cast(count(*) as bigint) as rows, round(avg(value) + 1e-9, 6) as mean, round(median(value) + 1e-9, 6) as median from v where feature <> 'dry_day' group by 1, 2")
def d12_centre(spark, sf):
    return rounded(drift.centre_table(both(spark, sf), MEASURES), ["feature", "split", "rows"], ["mean", "median"])


AUC_SQL = f"""with {_long(MEASURES, SEASONS, "tagged")}, c as (select feature, baseline, value, count(*) as n from long group by all),
v as (select b.feature, b.baseline, c.value, sum(case when c.baseline = 'test' then 0 else c.n end) as neg, sum(case when c.baseline = 'test' then c.n else 0 end) as pos
 from (select distinct feature, baseline from c where baseline <> 'test') b join c on c.feature = b.feature and c.baseline in (b.baseline, 'test') group by all),
w as (select *, sum(neg) over (partition by feature, baseline order by value) as upto from v)
select feature, baseline, round(sum(pos * (upto - neg / 2.0)) / (sum(pos) * sum(neg)) + 1e-9, 6) as auc from w group by 1, 2"""


@query("d05_measure_auc", AUC_SQL)
def d05_measure(spark, sf):
    """Rank sums over every measure and season slice: the engine behind the classifiers' AUC, in numbers that SQL knows."""
    flagged = drift.season_baselines(both(spark, sf).select(*KEYS, "date", "split", *MEASURES))
    return rounded(drift.measure_auc(drift.drift_counts(flagged, MEASURES, BASE), BASE), ["feature", "baseline"], ["auc"])


def _report(scored):
    """What SQL can say of a classifier: rows of each side, scores that are probabilities, an AUC no worse than chance."""
    out = adversarial.score_report(scored)
    return out.select("metric", "rows", "test_rows", "in_range", F.col("auc").between(0.5, 1.0).alias("separates"))


ALL_DAYS = f"with {SPLIT} select '{{}}' as metric, (select count(*) from train) + (select count(*) from test) as rows, (select count(*) from test) as test_rows, true as in_range, true as separates"


@query("d05_adversarial_auc", ALL_DAYS.format("adversarial_auc_weather"))
def d05(spark, sf):
    return _report(adversarial.adversarial_scores(both(spark, sf), MEASURES))


@query("d06_adversarial_auc_context", ALL_DAYS.format("adversarial_auc_with_region_month"))
def d06(spark, sf):
    return _report(adversarial.context_scores(both(spark, sf), MEASURES))


@query("d07_adversarial_auc_tree", f"""with {SEASONS}, t as (select count(*) as n from tagged where baseline = 'test')
select 'adversarial_auc_tree|' || baseline as metric, count(*) + any_value(t.n) as rows, any_value(t.n) as test_rows, true as in_range, true as separates
from tagged, t where baseline <> 'test' group by baseline""")
def d07(spark, sf):
    return _report(adversarial.slice_scores(flagged_rows(spark, sf), DRIFT_TREE_COLUMNS, BASE))
