"""Sources, scalar functions, filters, joins, aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.fixed import CLIMATE_COLUMNS, MEASURES, MONTH_STARTS, PROFILES, STREAK_WINDOWS
from isohyet.functions import dates
from isohyet.functions.numeric import clip, coerce_types, finite_or_null, r6
from isohyet.operators import features as ft
from isohyet.operators import priors, profiles, samples
from isohyet.operators.quantiles import column_medians
from isohyet.plans.lifecycle import inference_rows
from isohyet.plans.feature_table import FeatureOptions, build_features, drop_groups
from isohyet.queries.registry import KEYS, PANEL, PROFILE, SPLIT, over, panel, query, rounded, splits, sql_rounded, trailing
from isohyet.session import new_path
from isohyet.sources import ledgers
from isohyet.sources.derived import read_table
from isohyet.sources.panel import read_panel, sample_panel, union_splits

# -- sources ------------------------------------------------------------------------------------


@query("s01_read_panel", """
select cast(l_suppkey as varchar) as region_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as date,
       round(l_quantity + 1e-9, 6) as prec, round(l_extendedprice + 1e-9, 6) as tmp from lineitem""")
def s01(spark, sf):
    df = read_panel(spark, f"{sf}/lineitem.parquet", ["region_id", "date", "prec", "tmp"],
                    rename={"region_id": "l_suppkey", "date": "l_shipdate", "prec": "l_quantity", "tmp": "l_extendedprice"})
    return rounded(df, ["region_id", "date"], ["prec", "tmp"])


@query("s02_sample_panel", f"""with {PANEL}, chosen as (
 select region_id from (select distinct region_id from panel) order by cast(substr(region_id, 2) as bigint) limit 7)
select region_id, day_idx, round(prec + 1e-9, 6) as prec, score from panel where region_id in (select region_id from chosen)
order by cast(substr(region_id, 2) as bigint), day_idx limit 10000""")
def s02(spark, sf):
    return rounded(sample_panel(panel(spark, sf), max_rows=10000, max_regions=7), KEYS, ["prec"]).join(
        panel(spark, sf).select(*KEYS, "score"), KEYS)


@query("s03_scan_aggregate", f"""with {PANEL}
select cast(count(*) as bigint) as days, cast(count(score) as bigint) as labels, cast(count(distinct region_id) as bigint) as regions,
       round(sum(score) + 1e-9, 6) as score_sum, round(sum(prec) + 1e-9, 2) as prec_sum from panel""")
def s03(spark, sf):
    return profiles.scan_aggregate(panel(spark, sf)).select(
        "days", "labels", "regions", r6(F.col("score_sum")).alias("score_sum"), r6(F.col("prec_sum"), 2).alias("prec_sum"))


HISTORY_SQL = """select concat('run_', cast(o_orderkey as varchar), '.csv') as file_name,
 concat(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '.000000') as submitted_at, concat(o_orderpriority, ' of ', o_orderstatus) as description,
 case when o_orderkey % 3 > 0 then round(o_totalprice / 1000000 + 1e-9, 6) end as public_score,
 case when o_orderkey % 3 > 1 then round(o_totalprice / 2000000 + 1e-9, 6) end as private_score
from orders where o_orderstatus <> 'P'"""


@query("s05_parse_history_log", HISTORY_SQL)
def s05(spark, sf):
    orders, c = read_table(spark, sf, "orders"), F.col
    state = F.when(c("o_orderstatus") == "P", " State.PENDING ").otherwise(" State.COMPLETE ")
    score = lambda d: F.format_string("%.6f", F.round(c("o_totalprice") / d + 1e-9, 6))
    line = F.concat(
        F.lit("run_"), c("o_orderkey").cast("string"), F.lit(".csv  "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        F.lit(".000000   "), c("o_orderpriority"), F.lit("   of "), c("o_orderstatus"), state,
        F.when(c("o_orderkey") % 3 > 0, score(1000000)).otherwise(""),
        F.when(c("o_orderkey") % 3 > 1, F.concat(F.lit("  "), score(2000000))).otherwise(""))
    return ledgers.parse_history(orders.select(line.alias("value")))


@query("s05_parse_leaderboard", """select c_custkey as team_id, concat('team ', c_name) as team_name, '2024-01-02 03:04:05.678' as submitted_at,
 round(c_nationkey / 25.0 + 1e-9, 4) as score from customer""")
def s05_board(spark, sf):
    c = F.col
    line = F.concat(F.lit("  "), c("c_custkey").cast("string"), F.lit("  team   "), c("c_name"), F.lit("   2024-01-02 03:04:05.678  "),
                    F.format_string("%.4f", c("c_nationkey") / 25.0))
    return ledgers.parse_leaderboard(read_table(spark, sf, "customer").select(line.alias("value")))


@query("s06_flatten_manifests", """with items as (
 select strftime(o_orderdate, '%Y%m%d') || '-' || cast(o_orderkey as varchar) as ledger, concat('part_', cast(l_partkey as varchar)) as path,
        l_suppkey % 10 as ref, l_extendedprice as public_mae, l_linenumber as n, l_quantity as delta_to_anchor, l_returnflag as label
 from lineitem join orders on l_orderkey = o_orderkey)
select path, ref, ledger, round(public_mae + 1e-9, 6) as public_mae, round(delta_to_anchor + 1e-9, 6) as delta_to_anchor, label from items
qualify row_number() over (partition by path, ref order by ledger desc, n, public_mae, delta_to_anchor) = 1""")
def s06(spark, sf):
    # One JSON document per order, holding its line items; the documents are written and read back as ledgers.
    items, orders, c = read_table(spark, sf, "lineitem"), read_table(spark, sf, "orders"), F.col
    entry = F.struct(c("l_linenumber").alias("n"), c("l_extendedprice").alias("public_mae"), c("l_quantity").alias("delta_to_anchor"),
                     F.concat(F.lit("part_"), c("l_partkey").cast("string")).alias("path"), (c("l_suppkey") % 10).alias("ref"), c("l_returnflag").alias("label"))
    docs = items.join(orders, c("l_orderkey") == c("o_orderkey")).groupBy(
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), c("o_orderkey").cast("string")).alias("ledger")
    ).agg(F.sort_array(F.collect_list(entry)).alias("items"))
    path = new_path(spark, "ledgers")
    docs.select("ledger", "items").write.json(path)
    return rounded(ledgers.flatten_ledgers(ledgers.read_ledgers(spark, path, one_per_file=False)), ["path", "ref", "ledger", "label"], ["public_mae", "delta_to_anchor"])


# -- scalar functions ------------------------------------------------------------------------------


@query("p01_parse_synthetic_date", f"""with {PANEL}, texts as (select region_id, day_idx, date from panel
 union all select region_id, day_idx, concat(date, 'x') from panel where day_idx % 50 = 0
 union all select region_id, day_idx, '3004-13-40' from panel where day_idx % 50 = 1),
p as (select *, regexp_extract(date, '^(-?\\d+)-(\\d{{1,2}})-(\\d{{1,2}})$', ['y', 'm', 'd']) as t from texts)
select region_id, day_idx, date, coalesce(try_cast(t.y as integer), 0) as year, least(12, greatest(1, coalesce(try_cast(t.m as integer), 1))) as month,
 least(31, greatest(1, coalesce(try_cast(t.d as integer), 1))) as day from p""")
def p01(spark, sf):
    base = panel(spark, sf).select(*KEYS, "date")
    # Every fiftieth day also appears with a broken date and with one out of range.
    broken = base.filter("day_idx % 50 = 0").withColumn("date", F.concat("date", F.lit("x")))
    outside = base.filter("day_idx % 50 = 1").withColumn("date", F.lit("3004-13-40"))
    return dates.parse_synthetic_date(base.unionByName(broken).unionByName(outside))


@query("p02_date_ordinal", f"""with {PANEL} select region_id, day_idx, list_extract({MONTH_STARTS[1:]}, month) + day as doy, month * 100 + day as md,
 cast(year as bigint) * 366 + list_extract({MONTH_STARTS[1:]}, month) + day as ordinal from dated""")
def p02(spark, sf):
    df = dates.date_ordinal(dates.parse_synthetic_date(panel(spark, sf).select(*KEYS, "date")))
    return df.select(*KEYS, "doy", "md", "ordinal")


@query("p03_month_day_code", f"with {PANEL} select region_id, day_idx, month * 100 + day as md from dated")
def p03(spark, sf):
    df = dates.parse_synthetic_date(panel(spark, sf).select(*KEYS, "date"))
    return df.select(*KEYS, dates.month_day_code().alias("md"))


CALENDAR = {
    "sin_doy": "sin(2 * pi() * dayofyear / 365)", "cos_doy": "cos(2 * pi() * dayofyear / 365)",
    "sin_mon": "sin(2 * pi() * month / 12)", "cos_mon": "cos(2 * pi() * month / 12)",
}


@query("p04_calendar_features", f"""with {PANEL}, c as (select *, (month - 1) * 30 + day as dayofyear from dated),
o as (select region_id, day_idx, month, cast((month - 1) // 3 + 1 as integer) as quarter, day as dayofmonth, dayofyear,
 least(51, greatest(0, dayofyear // 7)) as weekofyear, {", ".join(f"{v} as {k}" for k, v in CALENDAR.items())} from c)
select region_id, day_idx, month, quarter, dayofmonth, dayofyear, weekofyear, {sql_rounded(list(CALENDAR))} from o""")
def p04(spark, sf):
    df = dates.calendar_features(dates.parse_synthetic_date(panel(spark, sf).select(*KEYS, "date")))
    return rounded(df, [*KEYS, "month", "quarter", "dayofmonth", "dayofyear", "weekofyear"], list(CALENDAR))


CYCLIC = {
    "month_sin": "sin(2 * pi() * month / 12)", "month_cos": "cos(2 * pi() * month / 12)",
    "quarter_sin": "sin(2 * pi() * quarter / 4)", "quarter_cos": "cos(2 * pi() * quarter / 4)",
    "week_sin": "sin(2 * pi() * weekofyear / 52)", "week_cos": "cos(2 * pi() * weekofyear / 52)",
}


@query("p05_cyclic_context", f"""with {PANEL}, c as (select *, (month - 1) * 30 + day as dayofyear from dated),
q as (select *, cast((month - 1) // 3 + 1 as integer) as quarter, least(51, greatest(0, dayofyear // 7)) as weekofyear from c),
s as (select avg(year) m, coalesce(nullif(stddev_samp(year), 0), 1) d from q where day_idx < 2000),
o as (select region_id, day_idx, (year - s.m) / s.d as year_z, {", ".join(f"{v} as {k}" for k, v in CYCLIC.items())} from q, s)
select region_id, day_idx, {sql_rounded(["year_z", *CYCLIC])} from o""")
def p05(spark, sf):
    df = dates.calendar_features(dates.parse_synthetic_date(panel(spark, sf).select(*KEYS, "date")))
    return rounded(profiles.cyclic_context(df, F.col("day_idx") < 2000), KEYS, ["year_z", *CYCLIC])


@query("p06_coerce_numeric", """select cast(event_id as varchar) as region_id, event_type as date,
 case when event_id % 4 = 0 then null when event_id % 4 = 1 then null else round(value + 1e-9, 6) end as prec from events""")
def p06(spark, sf):
    # Values arrive as text; a quarter of them is unreadable and a quarter is infinite.
    raw = read_table(spark, sf, "events")
    n = F.col("event_id") % 4
    text = F.when(n == 0, F.concat(F.lit("?"), F.col("value").cast("string"))).when(n == 1, F.lit("Infinity")).otherwise(F.col("value").cast("string"))
    typed = coerce_types(raw.select(F.col("event_id").alias("region_id"), F.col("event_type").alias("date"), text.alias("prec")), ["prec"])
    return rounded(typed, ["region_id", "date"], ["prec"])


@query("p11_clip_predictions", "select l_orderkey, l_linenumber, round(least(5.0, greatest(0.0, l_extendedprice / 10000 - 1)) + 1e-9, 6) as pred from lineitem")
def p11(spark, sf):
    df = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clip(F.col("l_extendedprice") / 10000 - 1).alias("pred"))
    return rounded(df, ["l_orderkey", "l_linenumber"], ["pred"])


PICKED = {
    "prec_lag28": "lag(prec, 28) over (partition by region_id order by day_idx)", "tmp_rmean35": f"avg(tmp) {trailing(35)}",
    "prec_sum91": f"sum(prec) {trailing(91)}", "hot_days_above35_90d": f"cast(sum(case when tmp_max >= 35 then 1 else 0 end) {trailing(90)} as double)",
}


@query("p12_select_features", f"""with {PANEL}, o as (select region_id, day_idx, {", ".join(f"{v} as {k}" for k, v in PICKED.items())} from panel)
select region_id, day_idx, {sql_rounded(list(PICKED))} from o""")
def p12(spark, sf):
    """Micro profile without most groups; windows of dropped columns leave the plan."""
    rows = panel(spark, sf)
    options = FeatureOptions(profile="micro", climatology=False, drop_groups=["calendar", "ewm", "domain_indices", "score_history"])
    kept = build_features(rows, rows, options)
    assert not {"tmp_ewm14", "sin_doy", "last_known_score"} & set(kept.columns)
    return rounded(kept, KEYS, list(PICKED))


@query("p12_drop_groups", f"""with {PANEL}, o as (select region_id, day_idx, avg(tmp) {trailing(28)} as tmp_rmean28 from panel)
select region_id, day_idx, round(tmp_rmean28 + 1e-9, 6) as tmp_rmean28 from o""")
def p12_drop(spark, sf):
    wide = ft.compose(panel(spark, sf).select(*KEYS, "tmp"), [ft.lag_family(["tmp"], [28]), ft.rolling_family(["tmp"], [28], ["mean"])])
    return rounded(drop_groups(wide, ["short_lag"]).drop("tmp"), KEYS, ["tmp_rmean28"])


# -- filters ------------------------------------------------------------------------------------------


@query("f01_labelled_rows", f"with {PANEL} select region_id, day_idx, score from panel where score is not null")
def f01(spark, sf):
    return samples.labelled_rows(panel(spark, sf)).select(*KEYS, "score")


@query("f03_feature_ready", f"""with {PANEL} select cast(count(*) as bigint) as rows, cast(count(tmp + wind + prec) as bigint) as kept,
 cast(count(*) - count(tmp + wind + prec) as bigint) as dropped from panel""")
def f03(spark, sf):
    return samples.feature_ready_report(panel(spark, sf), ["tmp", "wind", "prec"])


@query("f04_tail_per_region", f"""with {PANEL} select region_id, day_idx, score from panel
 qualify row_number() over (partition by region_id order by day_idx desc) <= 1095""")
def f04(spark, sf):
    return samples.tail_per_region(panel(spark, sf), 1095).select(*KEYS, "score")


@query("f07_finite_or_null", f"""with {PANEL} select region_id, day_idx, case when prec > 0 then round(tmp / prec + 1e-9, 6) end as quotient from panel""")
def f07(spark, sf):
    # Days without rain divide to an infinity or NaN first, as float arithmetic elsewhere does.
    safe = F.when(F.col("prec") > 0, F.col("tmp") / F.nullif(F.col("prec"), F.lit(0.0))).otherwise(F.lit(float("inf")))
    return panel(spark, sf).select(*KEYS, r6(finite_or_null(safe)).alias("quotient"))


# -- joins and priors ---------------------------------------------------------------------------------

CLIM = PANEL + """,
clim as (select region_id, month, """ + ", ".join(
    f"avg({c}) as {c}_clim_mean, stddev_samp({c}) as {c}_clim_std" for c in CLIMATE_COLUMNS) + """
 from dated where day_idx < (select max(day_idx) - 90 from panel) group by 1, 2)"""
CLIM_COLUMNS = [f"{c}_clim_{s}" for c in CLIMATE_COLUMNS for s in ("mean", "std")]


@query("a01_climatology", f"with {CLIM} select region_id, month, {sql_rounded(CLIM_COLUMNS)} from clim")
def a01(spark, sf):
    train, _ = splits(spark, sf)
    return rounded(priors.climatology(train), ["region_id", "month"], CLIM_COLUMNS)


ANOMALY = {f"{c}_anom": f"({c} - {c}_clim_mean) / nullif({c}_clim_std, 0)" for c in CLIMATE_COLUMNS}


@query("a01_climate_anomalies", f"""with {CLIM}, o as (select region_id, day_idx, {", ".join(f"{v} as {k}" for k, v in ANOMALY.items())}
 from dated left join clim using (region_id, month)) select region_id, day_idx, {sql_rounded(list(ANOMALY), 5)} from o""")
def a01_anomaly(spark, sf):
    train, test = splits(spark, sf)
    both = train.drop("score").unionByName(test)
    return rounded(priors.climate_anomalies(both, train), KEYS, list(ANOMALY), 5)


@query("j02_join_climatology", f"""with {CLIM} select region_id, day_idx, {sql_rounded(CLIM_COLUMNS)} from dated left join clim using (region_id, month)""")
def j02(spark, sf):
    train, test = splits(spark, sf)
    both = train.drop("score").unionByName(test).select(*KEYS, "date")
    return rounded(priors.join_climatology(both, priors.climatology(train)), KEYS, CLIM_COLUMNS)


PRIOR_SQL = {
    "region_score_mean": "avg(score)", "region_score_std": "coalesce(stddev_samp(score), 0)", "region_score_median": "median(score)",
    "region_score_max": "max(score)", "region_score_min": "min(score)",
    "region_score_eq0_ratio": "avg(cast(score = 0 as integer))", "region_score_ge1_ratio": "avg(cast(score >= 1 as integer))",
    "region_score_ge3_ratio": "avg(cast(score >= 3 as integer))", "region_score_eq5_ratio": "avg(cast(score = 5 as integer))",
}
LABELS = PANEL + ", labels_ as (select *, max(day_idx) over (partition by region_id) as last_idx from dated where score is not null)"


def _recent(d: int) -> dict[str, str]:
    inside = f"filter (where day_idx >= last_idx - {d} + 1)"
    return {
        f"region_score_mean_recent_{d}d": f"avg(score) {inside}", f"region_score_max_recent_{d}d": f"max(score) {inside}",
        f"region_score_eq0_ratio_recent_{d}d": f"avg(cast(score = 0 as integer)) {inside}",
        f"region_score_ge3_ratio_recent_{d}d": f"avg(cast(score >= 3 as integer)) {inside}",
    }


RECENT_SQL = _recent(365) | _recent(730)


def _grouped(columns: dict[str, str]) -> str:
    inner = ", ".join(f"{v} as {k}" for k, v in columns.items())
    return f"with {LABELS}, o as (select region_id, {inner} from labels_ group by 1) select region_id, {sql_rounded(list(columns))} from o"


@query("a02_region_priors", _grouped(PRIOR_SQL))
def a02(spark, sf):
    return rounded(priors.region_priors(panel(spark, sf)), ["region_id"], list(PRIOR_SQL))


@query("a03_recent_region_priors", _grouped(RECENT_SQL))
def a03(spark, sf):
    return rounded(priors.recent_priors(panel(spark, sf)), ["region_id"], list(RECENT_SQL))


MONTHLY = LABELS + """, gm as (select month, avg(score) g from labels_ group by 1),
rm as (select region_id, month, avg(score) region_month_score_mean, cast(count(*) as double) region_month_score_count from labels_ group by 1, 2),
mp as (select rm.*, (region_month_score_mean * region_month_score_count + g * 12.0) / (region_month_score_count + 12.0) region_month_score_mean_smooth
 from rm join gm using (month))"""


@query("a04_smoothed_month_prior", f"with {MONTHLY} select region_id, month, {sql_rounded(priors.MONTH_PRIOR_COLUMNS)} from mp")
def a04(spark, sf):
    return rounded(priors.smoothed_month_prior(panel(spark, sf)), ["region_id", "month"], priors.MONTH_PRIOR_COLUMNS)


JOINED = ["region_score_mean", "region_score_std", "region_score_mean_recent_365d", "region_month_score_mean", "region_month_score_mean_smooth"]


@query("j03_join_region_priors", f"""with {MONTHLY}, rp as (select region_id, {", ".join(f"{v} as {k}" for k, v in {**PRIOR_SQL, **RECENT_SQL}.items())} from labels_ group by 1)
select region_id, day_idx, {sql_rounded(JOINED)} from dated left join rp using (region_id) left join mp using (region_id, month)""")
def j03(spark, sf):
    rows = panel(spark, sf)
    return rounded(priors.add_region_priors(rows.select(*KEYS, "date"), rows), KEYS, JOINED)


@query("j04_season_match", f"""with {SPLIT}, k as (select distinct region_id, month * 100 + day as md from test)
select t.region_id, t.day_idx, t.month * 100 + t.day as md from train t join k on k.region_id = t.region_id and k.md = t.month * 100 + t.day""")
def j04(spark, sf):
    train, test = splits(spark, sf)
    return samples.season_match(dates.parse_synthetic_date(train), test).select(*KEYS, "md")


@query("j10_prev_year_asof", f"""with {SPLIT}, k as (select distinct region_id, month * 100 + day as md, year as test_year from test)
select k.region_id, k.md, k.test_year, max(t.year) as year, arg_max(t.day_idx, t.year) as day_idx from k
join train t on t.region_id = k.region_id and t.month * 100 + t.day = k.md and t.year < k.test_year group by 1, 2, 3""")
def j10(spark, sf):
    train, test = splits(spark, sf)
    return profiles.prev_year_asof(train.select(*KEYS, "date"), test)


# -- aggregations --------------------------------------------------------------------------------------


@query("a05_label_profile", f"""with {PANEL}, l as (select month, score from dated where score is not null),
h as (select 'score' as kind, cast(cast(score as integer) as varchar) as key, cast(count(*) as bigint) as rows, count(*) * 100.0 / (select count(*) from l) as value from l group by score),
m as (select 'month_mean' as kind, cast(month as varchar) as key, cast(count(*) as bigint) as rows, avg(score) as value from l group by month),
p as (select 'month_positive_rate' as kind, cast(month as varchar) as key, cast(count(*) as bigint) as rows, avg(cast(score > 0 as integer)) as value from l group by month)
select kind, key, rows, round(value + 1e-9, 6) as value from (select * from h union all select * from m union all select * from p)""")
def a05(spark, sf):
    return rounded(profiles.label_profile(panel(spark, sf)), ["kind", "key", "rows"], ["value"])


@query("a06_global_medians", f"with {PANEL} select " + ", ".join(f"round(median({c}) + 1e-9, 6) as {c}" for c in (*MEASURES, "score")) + " from panel")
def a06(spark, sf):
    return rounded(column_medians(panel(spark, sf), [*MEASURES, "score"]), [], [*MEASURES, "score"])


MISSING = f"""with {PANEL}, u as (""" + " union all ".join(
    f"select '{c}' as feature, count(*) - count({c}) as missing, count(*) as rows from panel" for c in MEASURES) + """)
select feature, cast(missing as bigint) as missing, cast(rows as bigint) as rows, round(missing / rows + 1e-9, 6) as missing_rate"""


@query("a07_missingness", MISSING + " from u")
def a07(spark, sf):
    return rounded(profiles.missingness(panel(spark, sf), MEASURES), ["feature", "missing", "rows"], ["missing_rate"])


@query("l02_top_missing", MISSING + " from u where missing > 0 order by missing desc, feature limit 5")
def l02(spark, sf):
    return rounded(profiles.top_missing(panel(spark, sf), MEASURES, 5), ["feature", "missing", "rows"], ["missing_rate"])


@query("a07_missing_summary", MISSING.split("\nselect feature")[0] + """
select max(rows) as rows, count(*) as columns, count_if(missing > 0) as missing_columns, cast(sum(missing) as bigint) as missing_cells, round(max(missing / rows) + 1e-9, 6) as max_rate from u""")
def a07_summary(spark, sf):
    return rounded(profiles.missing_summary(panel(spark, sf), MEASURES), ["rows", "columns", "missing_columns", "missing_cells"], ["max_rate"])


@query("a12_train_zscore", f"""with {SPLIT}, s as (select """ + ", ".join(
    f"avg({c}) {c}_m, coalesce(nullif(stddev_samp({c}), 0), 1) {c}_s" for c in MEASURES) + f""" from train)
select region_id, day_idx, {", ".join(f"round(({c} - {c}_m) / {c}_s + 1e-9, 6) as {c}_z" for c in MEASURES)} from panel, s""")
def a12(spark, sf):
    train, test = splits(spark, sf)
    both = union_splits(train, test)
    return rounded(profiles.train_zscore(both, MEASURES, F.col("split") == "train"), KEYS, [f"{c}_z" for c in MEASURES])


@query("a14_region_profile", f"""with {PANEL}, o as (select region_id, {", ".join(f"{v} as {k}_" for k, v in PROFILE.items())} from panel group by 1)
select region_id, {", ".join(f"round({k}_ + 1e-9, 6) as {k}" for k in PROFILE)} from o""")
def a14(spark, sf):
    return rounded(priors.region_profile(panel(spark, sf)), ["region_id"], list(PROFILE))


@query("u01_union_splits", f"""with {SPLIT} select region_id, day_idx, 'train' as split, score from train
 union all select region_id, day_idx, 'test' as split, null as score from test""")
def u01(spark, sf):
    return union_splits(*splits(spark, sf)).select(*KEYS, "split", "score")


@query("w13_final_row", f"with {PANEL} select region_id, day_idx, round(prec + 1e-9, 6) as prec, round(tmp + 1e-9, 6) as tmp from panel qualify row_number() over (partition by region_id order by day_idx desc) = 1")
def w13(spark, sf):
    return rounded(samples.final_row(panel(spark, sf).select(*KEYS, "prec", "tmp")), KEYS, ["prec", "tmp"])


@query("w13_final_row_non_null", f"""with {PANEL} select region_id, max(day_idx) as day_idx, round(arg_max(tmp, day_idx) filter (where tmp is not null) + 1e-9, 6) as tmp,
 arg_max(score, day_idx) filter (where score is not null) as score from panel group by 1""")
def w13_known(spark, sf):
    return rounded(samples.final_row(panel(spark, sf).select(*KEYS, "tmp", "score"), "last_non_null"), [*KEYS, "score"], ["tmp"])


# -- the wide feature table ------------------------------------------------------------------------------

BUILD_PANEL = {
    "sin_doy": "sin(2 * pi() * ((month - 1) * 30 + day) / 365)", "prec_lag28": "lag(prec, 28) over (partition by region_id order by day_idx)",
    "tmp_rmean28": f"avg(tmp) {trailing(28)}", "prec_rstd35": f"stddev_samp(prec) {trailing(35)}",
    "drought_idx_r35": f"avg(tmp) {trailing(35)} / (avg(prec) {trailing(35)} + 0.01)", "prec_sum91": f"sum(prec) {trailing(91)}",
    "long_drought_idx91": f"avg(tmp) {trailing(91)} / (sum(prec) {trailing(91)} + 0.1)",
    "hot_days_above35_90d": f"cast(sum(case when tmp_max >= 35 then 1.0 else 0.0 end) {trailing(90)} as double)",
    "tmp_range_std_30d": f"stddev_samp(tmp_range) {trailing(30)}", "dew_depression_mean_14d": f"avg(tmp - dp_tmp) {trailing(14)}",
    "last_known_score": "lag(ks, 91) over (partition by region_id order by day_idx)",
    "score_gap_lag12w": "lag(ks, 175) over (partition by region_id order by day_idx)",
    "score_gap_mean365d": f"avg(score) {trailing(365, 91)}", "score_gap_max91d": f"max(score) {trailing(91, 91)}",
    "score_gap_trend_13w_52w": f"avg(score) {trailing(91, 91)} - avg(score) {trailing(365, 91)}",
}
BUILD_JOINED = ["prec_clim_mean", "prec_anom", "region_score_mean", "region_score_mean_recent_365d", "region_month_score_mean_smooth"]


STREAK = {"consecutive_dry_days": "coalesce(cast(lag(streak, 1) over (partition by region_id order by day_idx) as double), 0)"}
STREAK |= {f"cdd_rolling{w}": f"coalesce(cast(max(streak) {trailing(w)} as double), 0)" for w in STREAK_WINDOWS}


def _build_sql(columns: dict[str, str]) -> str:
    """Features of the last day over the whole history; labels and statistics come from train."""
    return f"""with {SPLIT},
full_ as (select d.* exclude (score), t.score from dated d left join train t using (region_id, day_idx)),
known as (select *, last_value(score ignore nulls) over (partition by region_id order by day_idx) as ks,
 day_idx - coalesce(max(case when not coalesce(prec < 0.1, false) then day_idx end) over (partition by region_id order by day_idx), min(day_idx) over (partition by region_id) - 1) as streak from full_),
o as (select region_id, day_idx, month, prec, {", ".join(f"{v} as {k}" for k, v in columns.items())} from known),
clim as (select region_id, month, avg(prec) prec_clim_mean, stddev_samp(prec) prec_clim_std from train group by 1, 2),
labels_ as (select *, max(day_idx) over (partition by region_id) last_idx from train where score is not null),
rp as (select region_id, avg(score) region_score_mean, avg(score) filter (where day_idx >= last_idx - 364) region_score_mean_recent_365d from labels_ group by 1),
gm as (select month, avg(score) g from labels_ group by 1),
mp as (select region_id, month, (sum(score) + any_value(g) * 12.0) / (count(*) + 12.0) region_month_score_mean_smooth from labels_ join gm using (month) group by 1, 2),
final as (select *, (prec - prec_clim_mean) / nullif(prec_clim_std, 0) prec_anom from o left join clim using (region_id, month)
 left join rp using (region_id) left join mp using (region_id, month) where day_idx = (select max(day_idx) from panel))
select region_id, day_idx, {sql_rounded([*columns, *BUILD_JOINED], 5)} from final"""


@query("feat_build_micro", _build_sql(BUILD_PANEL))
def feat_build(spark, sf):
    """Train and test in one panel, statistics from train, all micro features, last row per region."""
    train, test = splits(spark, sf)
    both = union_splits(train, test).drop("split")
    wide = build_features(both, train, FeatureOptions(region_priors=True), last_only=True)
    return rounded(wide, KEYS, [*BUILD_PANEL, *BUILD_JOINED], 5)


def _profile_columns(name: str) -> dict[str, str]:
    """Columns of every family and window of a profile."""
    p, lag = PROFILES[name], "lag({}, {}) over (partition by region_id order by day_idx)"
    out = {f"prec_lag{k}": lag.format("prec", k) for k in p["lags"]} | dict(STREAK)
    for w in p["rolls"]:
        out |= {f"tmp_rmean{w}": f"avg(tmp) {trailing(w)}", f"prec_rstd{w}": f"stddev_samp(prec) {trailing(w)}"}
    for w in p["domain"]:
        out[f"drought_idx_r{w}"] = f"avg(tmp) {trailing(w)} / (avg(prec) {trailing(w)} + 0.01)"
    for w in p["long"]:
        out |= {f"prec_sum{w}": f"sum(prec) {trailing(w)}", f"tmp_mean_long{w}": f"avg(tmp) {trailing(w)}", f"long_drought_idx{w}": f"avg(tmp) {trailing(w)} / (sum(prec) {trailing(w)} + 0.1)"}
    for k in p["label_lags"]:
        out[f"score_gap_lag{k}w"] = lag.format("ks", 91 + 7 * k)
    for w in p["label_windows"]:
        out |= {f"score_gap_{a}{w}d": f"{f}(score) {trailing(w, 91)}" for a, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"))}
    return out | {k: BUILD_PANEL[k] for k in ("sin_doy", "hot_days_above35_90d", "tmp_range_std_30d", "dew_depression_mean_14d", "last_known_score")}


def _final(spark, sf, profile: str, columns: dict[str, str]):
    """The production path of a prediction: a cut history with the state before it."""
    train, test = splits(spark, sf)
    wide = inference_rows(train, test, FeatureOptions(profile=profile, region_priors=True))
    return rounded(wide, KEYS, [*columns, *BUILD_JOINED], 5)


@query("l00_predict_final_features", _build_sql(BUILD_PANEL | STREAK))
def l00(spark, sf):
    return _final(spark, sf, "micro", BUILD_PANEL | STREAK)


@query("feat_build_lean", _build_sql(_profile_columns("lean")))
def feat_lean(spark, sf):
    return _final(spark, sf, "lean", _profile_columns("lean"))


@query("feat_build_full", _build_sql(_profile_columns("full")))
def feat_full(spark, sf):
    return _final(spark, sf, "full", _profile_columns("full"))
