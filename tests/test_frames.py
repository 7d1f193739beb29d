"""Frames of a block against plain loops; work by region starts where the stored panel lies."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isohyet.fixed import MEASURES
from isohyet.functions.blocks import spread
from isohyet.functions.frames import Roll, trailing_columns
from isohyet.operators import features as ft
from isohyet.plans.feature_table import FeatureOptions, build_features
from isohyet.sources.derived import derive_panel


def column(rows, far=0.0):
    rng = np.random.default_rng(7)
    return [None if rng.random() < 0.4 else float(far + rng.normal()) for _ in range(rows)]


@pytest.mark.parametrize("fn", ["sum", "mean", "max", "std", "count"])
@pytest.mark.parametrize("hi, lo", [(1, 1), (7, 1), (90, 1), (118, 91), (500, 3)])
def test_frames_equal_loops(fn, hi, lo):
    x = column(200)
    got = trailing_columns(pa.table({"day_idx": range(200), "x": x}), "day_idx", [Roll("y", "x", fn, hi, lo)], {}, {}, []).column("y").to_pylist()
    for t, y in enumerate(got):
        seen = [v for v in x[max(0, t - hi) : max(0, t - lo + 1)] if v is not None]
        want = {"sum": sum, "mean": np.mean, "max": max, "count": len, "std": lambda v: np.std(v, ddof=1)}[fn](seen) if len(seen) > (fn == "std") or fn == "count" else None
        assert (y is None) == (want is None) and (want is None or y == pytest.approx(want, abs=1e-12))


def test_small_deviations_after_a_large_value():
    x = [1e12] + [1.0 + 1e-6 * (i % 2) for i in range(300)]
    got = trailing_columns(pa.table({"day_idx": range(301), "x": x}), "day_idx", [Roll("y", "x", "std", 90)], {}, {}, []).column("y").to_pylist()
    assert got[200] == pytest.approx(np.std(x[110:200], ddof=1), rel=1e-6)


def test_recursive_means_lags_and_unsorted_rows():
    x, days = column(60), np.random.default_rng(3).permutation(60)
    table = pa.table({"day_idx": days, "x": [x[d] for d in days]})
    out = trailing_columns(table, "day_idx", [], {"e": ("x", 3)}, {"l": ("x", 5), "far": ("x", 70)}, []).to_pydict()
    mean, want = None, []
    last = None
    for v in x:
        want.append(mean)
        last = v if v is not None else last
        mean = last if mean is None else mean * 0.5 + last * 0.5
    assert out["day_idx"] == list(range(60)) and out["l"] == [None] * 5 + x[:-5] and out["far"] == [None] * 60
    assert [e is None for e in out["e"]] == [w is None for w in want]
    assert all(w is None or e == pytest.approx(w, abs=1e-12) for e, w in zip(out["e"], want, strict=True))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_by_region_need_no_shuffle_and_no_sort(panel):
    for df in (ft.ewm(panel, MEASURES, [3]), ft.dry_streak(panel), spread(panel, carry=["tmp"]).done()):
        assert "Exchange" not in plan(df) and "Sort" not in plan(df)


def test_panel_keeps_items_without_region_or_day(spark, tmp_path):
    rows = pd.DataFrame({
        "l_suppkey": [1, 1, 1, None, None, 2], "l_shipdate": pd.to_datetime(["2020-01-03", "2020-01-03", None, "2020-01-02", None, None]),
        "l_quantity": [7.0, 3.0, 4.0, 5.0, 6.0, 8.0], "l_extendedprice": [2500.0, 5000.0, 1.0, 1.0, 1.0, 1.0], "l_discount": 0.1, "l_tax": 0.0,
        "l_linenumber": [1, 2, 3, 4, 5, 6]}).astype({"l_suppkey": "Int64"})
    extra = pd.DataFrame({"l_suppkey": [3, 3], "l_shipdate": pd.to_datetime(["2020-01-01", "2020-01-09"]), "l_quantity": 1.0, "l_extendedprice": 1.0, "l_discount": 0.0, "l_tax": 0.0, "l_linenumber": 1})
    pd.concat([rows, extra.astype({"l_suppkey": "Int64"})]).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    got = derive_panel(spark, str(tmp_path))
    counts = {r.region_id: r for r in got.groupBy("region_id").agg(F.count("*").alias("n"), F.sum("prec").alias("p"), F.count("tmp").alias("t"), F.count("score").alias("s")).collect()}
    assert {k: (r.n, round(r.p, 6), r.t) for k, r in counts.items()} == {"R1": (9, 1.0, 1), None: (9, 0.0, 0), "R2": (9, 0.0, 0), "R3": (9, 0.2, 2)}
    assert [r.s for r in counts.values()] == [1, 1, 1, 1]
    day = got.filter("region_id = 'R1' and day_idx = 2").first()
    assert (day.prec, day.tmp, day.wind_max) == (1.0, 1.5, 2.0)


def test_bounded_sample_sorts_few_rows(spark):
    from isohyet.operators.drift import bounded_sample

    rows = spark.range(20_000).selectExpr("cast(id % 4000 as string) as region_id", "id % 7 as day_idx", "case when id % 5 > 0 then id % 2 end as split")
    got = bounded_sample(rows, 50, 42, ["region_id", "day_idx"], side="split").toPandas()
    assert got.groupby("split", dropna=False).size().tolist() == [50, 50, 50] and list(got.columns) == rows.columns
    import hashlib

    every = rows.toPandas()
    every["draw"] = [hashlib.md5(f"{r}|{d}|42".encode()).hexdigest() for r, d in zip(every.region_id, every.day_idx, strict=True)]
    for value, side in every.groupby("split", dropna=False):
        want = side.sort_values(["draw", "region_id", "day_idx"]).head(50)
        have = got[got.split.isna()] if pd.isna(value) else got[got.split == value]
        assert sorted(zip(have.region_id, have.day_idx)) == sorted(zip(want.region_id, want.day_idx))
    assert bounded_sample(rows, 30_000, 42, ["region_id", "day_idx"]).count() == 20_000
    df = bounded_sample(rows, 50, 42, ["region_id", "day_idx"])
    df.collect()
    joins = [line for line in plan(df).splitlines() if "BroadcastNestedLoopJoin" in line or "BroadcastHashJoin" in line]
    assert joins


@pytest.mark.parametrize("asked", [[199], [60, 61, 140], [0], []])
def test_asked_rows_equal_those_of_the_whole_block(asked):
    """Frames of the asked rows, from the rows they reach, are those of the whole block to the last digit."""
    x = column(200, 1e6)
    table = pa.table({"day_idx": range(200), "x": x, "z": column(200), "_asked": [i in asked for i in range(200)]})
    rolls = [Roll(f"{fn}{hi}_{lo}", "x", fn, hi, lo) for fn in ("sum", "mean", "max", "std", "count") for hi, lo in ((1, 1), (28, 1), (118, 91))]
    args = "day_idx", rolls, {"e": ("z", 14)}, {"l": ("x", 49), "far": ("z", 300)}, []
    whole, some = trailing_columns(table, *args), trailing_columns(table, *args, "_asked")
    assert some.column_names == whole.column_names and some.schema == whole.schema
    assert some.to_pylist() == whole.take(pa.array(asked, pa.int64())).to_pylist()


def test_statistics_meet_last_rows_only(panel):
    """Neither statistics nor other days go through the windows of a table of last rows."""
    last = build_features(panel, panel, FeatureOptions(region_priors=True), last_only=True)
    windows = next(line for line in plan(last).split("\n") if "FlatMapGroupsInArrow" in line)
    assert "_climate" not in windows and "_month_prior" not in windows and "region_score_mean" not in windows


def windows_of(df):
    return next(line for line in plan(df).split("\n") if "FlatMapGroupsInArrow" in line)


def test_statistics_and_calendar_meet_labelled_days_only(panel):
    """Where only days with a label stay, the others carry neither through the windows; columns keep their order."""
    options = FeatureOptions(region_priors=True)
    some, whole = build_features(panel, panel, options, days_of="score"), build_features(panel, panel, options)
    for name in ("_climate", "_month_prior", "sin_doy"):
        assert name not in windows_of(some), name
    assert [c for c in some.columns if c not in whole.columns] == [] and some.columns == whole.columns


def test_dropped_groups_leave_the_windows(panel):
    """Only families of which a column stays are computed, and the frames that their arithmetic reads."""
    dropped = FeatureOptions(climatology=False, drop_groups=["calendar", "ewm", "domain_indices", "score_history"])
    few = build_features(panel, panel, dropped)
    for name in ("_ewm14", "score_gap", "dew_depression"):
        assert name not in windows_of(few), name
    whole = build_features(panel, panel, FeatureOptions(climatology=False))
    kept = [c for c in whole.columns if c in few.columns]
    assert few.columns == kept and {"prec_lag28", "tmp_rmean35", "prec_sum91"} <= set(kept)
    indices = build_features(panel, panel, FeatureOptions(climatology=False, drop_groups=["rolling"]))
    assert "drought_idx_r35" in indices.columns and "tmp_rmean35" not in indices.columns
