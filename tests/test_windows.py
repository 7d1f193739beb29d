"""Block windows against pandas, for block sizes that force many blocks and wide halos."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordering import in_order
from isohyet.functions.blocks import running_state, with_day_index, with_position
from isohyet.functions.dates import parse_synthetic_date
from isohyet.operators import features as ft
from isohyet.operators import samples
from isohyet.operators.quantiles import column_quantiles

SIZES = [None, 64, 500]


def close(left, right, atol=1e-8):
    np.testing.assert_allclose(left.to_numpy(float), right.to_numpy(float), atol=atol, equal_nan=True)


@pytest.mark.parametrize("size", SIZES)
def test_rolling_and_ewm(size, panel, frame):
    out = in_order(ft.compose(panel, [
        ft.rolling_family(["prec", "tmp"], [3, 7, 90], ["mean", "std", "sum", "max"]), ft.ewm_family(["tmp"], [3, 14]), ft.lag_family(["tmp"], [7]),
    ], block_rows=size))
    region = frame.region_id
    for c in ("prec", "tmp"):
        shifted = frame.groupby("region_id")[c].shift(1)
        for w in (3, 7, 90):
            for fn in ("mean", "std", "sum", "max"):
                want = getattr(shifted.groupby(region).rolling(w, min_periods=1), fn)().reset_index(level=0, drop=True)
                close(out[f"{c}_r{fn}{w}"], want, 1e-6)
    filled = frame.groupby("region_id").tmp.ffill().groupby(region).shift(1)
    for s in (3, 14):
        close(out[f"tmp_ewm{s}"], filled.groupby(region).ewm(span=s, adjust=False).mean().reset_index(level=0, drop=True))
    close(out.tmp_lag7, frame.groupby("region_id").tmp.shift(7))


@pytest.mark.parametrize("size", SIZES)
def test_labels_and_streaks(size, panel, frame):
    out = in_order(ft.compose(panel, [ft.label_family([0, 4], [91, 365]), ft.streak_family()], block_rows=size))
    region = frame.region_id
    known = frame.groupby("region_id").score.ffill().groupby(region)
    close(out.score_gap_lag4w, known.shift(119))
    close(out.score_momentum_14d, known.shift(91) - known.shift(105))
    gapped = frame.groupby("region_id").score.shift(91).groupby(region)
    for fn in ("mean", "std", "max"):
        close(out[f"score_gap_{fn}365d"], getattr(gapped.rolling(365, min_periods=1), fn)().reset_index(level=0, drop=True))
    dry = (frame.prec < 0.1).astype(float)
    island = (dry == 0).groupby(region).cumsum()
    before = dry.groupby([region, island]).cumsum().groupby(region).shift(1).fillna(0)
    close(out.consecutive_dry_days, before)
    close(out.cdd_rolling60, before.groupby(region).rolling(60, min_periods=1).max().reset_index(level=0, drop=True))


@pytest.mark.parametrize("size", [64, 300])
def test_targets_priors_sequences_do_not_depend_on_blocks(size, panel):
    rows = panel.select("region_id", "date", "day_idx", "score", "prec")
    for fn in (
        lambda b: samples.lead_targets(rows, block_rows=b).drop("date"),
        lambda b: samples.visible_label_priors(rows, 2.0, block_rows=b),
        lambda b: samples.sequence_samples(rows, 2.0, columns=["prec"], block_rows=b).select(
            "region_id", "day_idx", "previous_score", F.size("sequence").alias("n"), F.element_at("sequence", 1)["prec"].alias("first")),
        lambda b: ft.impute(rows, ["prec", "score"], mode="ffill_bfill", block_rows=b).drop("date"),
    ):
        a, b = in_order(fn(None)), in_order(fn(size))
        pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-9, check_dtype=False)


def test_hot_region_is_split(spark):
    """A region with most of the rows spans many window partitions and keeps exact results."""
    rows = spark.range(6000).select(F.lit("hot").alias("region_id"), F.col("id").cast("int").alias("day_idx"), (F.col("id") % 13).cast("double").alias("prec"), F.lit(1.0).alias("tmp"))
    rows = rows.unionByName(spark.range(50).select(F.lit("cold").alias("region_id"), F.col("id").cast("int").alias("day_idx"), F.lit(2.0).alias("prec"), F.lit(1.0).alias("tmp")))
    out = in_order(ft.rolling(rows, ["prec"], [30], ["mean"], block_rows=256))
    pdf = in_order(rows)
    want = pdf.groupby("region_id").prec.shift(1).groupby(pdf.region_id).rolling(30, min_periods=1).mean().reset_index(level=0, drop=True)
    close(out.prec_rmean30, want)


def test_sliding_std_of_equal_values_is_zero(spark):
    rows = spark.range(2000).select(F.lit("a").alias("region_id"), F.col("id").cast("int").alias("day_idx"), F.when(F.col("id") < 100, 37.3).otherwise(5.1).alias("x"))
    out = in_order(ft.rolling(rows, ["x"], [28], ["std"], block_rows=512))
    assert (out.x_rstd28[150:] == 0).all()


def test_day_index_crosses_the_five_digit_year(spark):
    dates = ["9999-12-30", "9999-12-31", "10000-01-01", "10000-01-02", "10001-03-01"]
    df = spark.createDataFrame([("R1", d) for d in dates], "region_id string, date string")
    got = with_day_index(parse_synthetic_date(df)).toPandas().set_index("date").day_idx
    assert [got[d] for d in dates] == [0, 1, 2, 3, 4]


def test_bad_dates(spark):
    df = spark.createDataFrame([("x",), ("23101-11-20",), ("3004-13-40",), (None,)], "date string")
    rows = {r.date: (r.year, r.month, r.day) for r in parse_synthetic_date(df).collect()}
    assert rows == {"x": (0, 1, 1), "23101-11-20": (23101, 11, 20), "3004-13-40": (3004, 12, 31), None: (0, 1, 1)}


def test_running_state_over_several_groups(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("p"), F.col("id").alias("v"))
    got = running_state(df, ["k"], "p", sums=["v"], fanout=64).orderBy("p").toPandas().v
    assert (got == np.cumsum(np.arange(1000))).all()


def test_position_with_gaps(spark):
    df = spark.createDataFrame([("a", i) for i in (3, 700, 701, 90000)] + [("b", 5)], "region_id string, day_idx int")
    got = with_position(df, "at", block_rows=100).orderBy("region_id", "day_idx").toPandas()["at"]
    assert list(got) == [0, 1, 2, 3, 0]


def test_exact_quantiles(panel, frame):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = column_quantiles(panel, ["prec", "tmp"], probs).toPandas()
    for c in ("prec", "tmp"):
        want = np.quantile(frame[c].dropna(), probs)
        np.testing.assert_allclose(got[got.feature == c].sort_values("prob")["quantile"], want, rtol=1e-9)
    many = [i / 100 for i in range(101)]
    got = column_quantiles(panel, ["tmp"], many).toPandas()
    np.testing.assert_allclose(got.sort_values("prob")["quantile"], np.quantile(frame.tmp.dropna(), many), rtol=1e-9)


@pytest.mark.parametrize("width", [64, 65, 128, 182, 365, 728])
def test_wide_std_after_large_values(spark, width):
    """Moments merge without a difference of totals: 1.0 and 1.2 after plus and minus a million, with gaps, over block borders."""
    day = F.col("id")
    value = F.when(day < 300, F.when(day % 2 == 0, 1e6).otherwise(-1e6)).when(day % 11 == 0, None).otherwise(F.when(day % 3 == 0, 1.2).otherwise(1.0))
    rows = spark.range(2500).select(F.lit("a").alias("region_id"), day.cast("int").alias("day_idx"), value.alias("x"))
    out = in_order(ft.rolling(rows, ["x"], [width], ["std"], block_rows=512))
    want = in_order(rows).x.shift(1).rolling(width, min_periods=2)
    want = want.apply(lambda v: np.std(v[~np.isnan(v)], ddof=1) if (~np.isnan(v)).sum() > 1 else np.nan, raw=True)
    np.testing.assert_allclose(out[f"x_rstd{width}"], want, rtol=1e-9)
