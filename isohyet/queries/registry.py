"""Registration, shared inputs and the SQL text of the shared inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.fixed import MEASURES
from isohyet.functions.numeric import r6
from isohyet.session import materialize, tune
from isohyet.sources.derived import calendar_bounds, split_panel, stored_panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[r6(F.col(v), digits).alias(v) for v in values])


def sql_rounded(values: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f"round({v} + 1e-9, {digits}) as {v}" for v in values)


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return stored_panel(spark, folder)


def label_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Region, date, day and label of every panel row, for queries that read nothing else."""
    return stored_panel(spark, folder, labels_only=True)


def splits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = stored_panel(spark, folder)
    return split_panel(rows, calendar_bounds(spark, folder)[2] - 1)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An input that many queries share, written once per application next to the stored panel."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        _STORED[key] = materialize(build(), name)
    return _STORED[key]


_KEPT: dict[tuple[str, str, str], object] = {}


def kept(spark: SparkSession, folder: str, name: str, build: Callable[[], object]):
    """What several queries share and needs no copy: a table whose parts are stored already, or fitted models."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def is_kept(spark: SparkSession, folder: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, folder, name) in _KEPT


# The panel as SQL; `panel` has the columns of `derive_panel`.
PANEL = """
bounds as (select min(cast(l_shipdate as date)) lo, max(cast(l_shipdate as date)) hi from lineitem),
cells as (
 select l_suppkey k, cast(l_shipdate as date) d, sum(l_quantity) q, avg(l_quantity) qa, avg(l_extendedprice) pa,
        max(l_extendedprice) px, min(l_extendedprice) pn, avg(l_discount) di, avg(l_tax) tx, avg(l_linenumber) la,
        max(l_linenumber) lx, min(l_linenumber) ln
 from lineitem group by 1, 2),
days as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) d, lo from bounds),
base as (
 select g.k, g.d, cast(date_diff('day', g.lo, g.d) as integer) day_idx, coalesce(c.q, 0.0) q,
        c.qa, c.pa, c.px, c.pn, c.di, c.tx, c.la, c.lx, c.ln
 from (select n.k, days.d, days.lo from (select distinct k from cells) n cross join days) g
 left join cells c on g.k = c.k and g.d = c.d),
sc as (
 select *, sum(q) over (partition by k order by day_idx rows between 27 preceding and current row) s28,
        sum(q) over (partition by k) / count(*) over (partition by k) qall
 from base),
panel as materialized (
 select concat('R', cast(k as varchar)) region_id,
        concat(cast(year(d) + 2000 * (k % 29) as varchar), '-', strftime(d, '%m'), '-', strftime(d, '%d')) as date,
        day_idx, cast(cast(q / 10.0 as float) as double) prec, cast(cast(90 + 100 * di as float) as double) surf_pre,
        cast(cast(qa / 5 as float) as double) humidity, cast(cast(pa / 2500 as float) as double) tmp,
        cast(cast(pa / 2500 - 100 * tx as float) as double) dp_tmp, cast(cast(pa / 2500 - 50 * tx as float) as double) wb_tmp,
        cast(cast(px / 2500 as float) as double) tmp_max, cast(cast(pn / 2500 as float) as double) tmp_min,
        cast(cast((px - pn) / 2500 as float) as double) tmp_range, cast(cast(pa / 2500 + 10 * di as float) as double) surf_tmp,
        cast(cast(la as float) as double) wind, cast(lx as double) wind_max, cast(ln as double) wind_min,
        cast(lx - ln as double) wind_range,
        case when day_idx % 7 = 6 and qall > 0
             then cast(least(5.0, greatest(0.0, floor(8 * (1.25 - s28 / (28 * qall))))) as double) end as score
 from sc),
dated as (
 select *, cast(regexp_extract(date, '^(-?[0-9]+)-', 1) as integer) as year,
        cast(regexp_extract(date, '^-?[0-9]+-([0-9]+)-', 1) as integer) as month,
        cast(regexp_extract(date, '-([0-9]+)$', 1) as integer) as day
 from panel)"""

SPLIT = PANEL + """,
train as (select * from dated where day_idx < (select max(day_idx) - 90 from panel)),
test as (select * exclude (score) from dated where day_idx >= (select max(day_idx) - 90 from panel))"""

KEYS = ["region_id", "day_idx"]


def over(frame: str, keys: str = "region_id") -> str:
    return f"over (partition by {keys} order by day_idx rows between {frame})"


def trailing(w: int, lo: int = 1) -> str:
    return over(f"{w + lo - 1} preceding and {lo} preceding")


# The 16 inputs of the region profile.
PROFILE = {c: f"coalesce(avg({c}), 0)" for c in MEASURES} | {
    "score_mean": "coalesce(avg(score), 0)", "score_zero_ratio": "coalesce(avg(case when score is not null then cast(score = 0 as integer) end), 0)"}


def cluster_sql(k: int = 5, rounds: int = 10) -> str:
    """Tables after `panel` that end in `clusters` (region_id, region_cluster): farthest seeds, then rounds of means."""
    width = range(1, len(PROFILE) + 1)

    def away(other: str) -> str:
        return "round(" + " + ".join(f"(z[{i}] - {other}[{i}]) * (z[{i}] - {other}[{i}])" for i in width) + ", 9)"

    inputs = ", ".join(f"{v} as {c}" for c, v in PROFILE.items())
    scaled = ", ".join(f"coalesce(round(({c} - avg({c}) over ()) / case when round(stddev_samp({c}) over (), 9) > 0 then stddev_samp({c}) over () end, 9), 0)" for c in PROFILE)
    parts = [
        f"means as (select region_id, {inputs} from panel group by 1)", f"places as materialized (select region_id, [{scaled}] as z from means)",
        "seed0 as materialized (select z as s from places order by round(" + " + ".join(f"z[{i}] * z[{i}]" for i in width) + ", 9) desc, region_id limit 1)",
    ]
    for n in range(1, k):
        least = "least(" + ", ".join(away(f"seed{i}.s") for i in range(n)) + ")"
        parts.append(f"seed{n} as materialized (select z as s from places, {', '.join(f'seed{i}' for i in range(n))} where {least} > 0 order by {least} desc, region_id limit 1)")
    parts.append("centre0 as materialized (" + " union all ".join(f"select {i} as nth, s from seed{i}" for i in range(k)) + ")")
    for n in range(rounds + 1):
        parts.append(f"owner{n} as materialized (select region_id, any_value(z) as z, min({{'away': {away('s')}, 'nth': nth}}).nth as nth from places, centre{n} group by 1)")
        if n < rounds:
            mean = ", ".join(f"round(avg(z[{i}]), 9)" for i in width)
            parts.append(f"centre{n + 1} as materialized (select c.nth, case when count(o.region_id) = 0 then any_value(c.s) else [{mean}] end as s from centre{n} c left join owner{n} o on o.nth = c.nth group by 1)")
    parts.append(f"clusters as (select region_id, nth as region_cluster from owner{rounds})")
    return ", ".join(parts)
