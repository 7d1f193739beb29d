"""Leakage, drift and edge-case properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordering import in_order
from isohyet.fixed import MEASURES
from isohyet.functions.numeric import clean_numeric, clip
from isohyet.operators import backtest as bt
from isohyet.operators import drift, priors, profiles, samples
from isohyet.plans.feature_table import FeatureOptions, build_features, drop_groups, feature_columns, look_back_days
from isohyet.sources.derived import derive_panel, derive_splits
from isohyet.sources.panel import union_splits


@pytest.mark.parametrize("sf,rows,labels,total", [("0.01", 62475, 8925, 15743.0), ("0.1", 62475, 8925, 13587.0)])
def test_nation_panel_has_the_published_sums(spark, sf, rows, labels, total):
    row = derive_panel(spark, f"/root/testdata/sf{sf}", region="nation").agg(F.count("*"), F.count("score"), F.sum("score")).first()
    assert tuple(row) == (rows, labels, total)


def test_no_feature_reads_the_future(panel):
    """Changing every row after a cut leaves all features up to the cut unchanged."""
    cut, stats = 1200, panel.filter("day_idx < 900")
    options = FeatureOptions(region_priors=True)
    later = F.col("day_idx") > cut
    changed = panel.withColumns({c: F.when(later, F.col(c) + 50).otherwise(F.col(c)) for c in ("prec", "tmp", "tmp_max", "humidity", "wind", "score")})
    a, b = (build_features(p, stats, options).filter(f"day_idx between {cut - 50} and {cut}") for p in (panel, changed))
    names = [c for c in feature_columns(a) if dict(a.dtypes)[c] in ("double", "int")]
    report = bt.diff_by_key(a, b, ["region_id", "day_idx"], names).filter("changed_rows > 0").collect()
    assert not report


@pytest.fixture(scope="module")
def few_targets(panel):
    return bt.origin_targets(panel.select("region_id", "date", "day_idx", "score"), [5])


def test_sentinel_is_silent_on_the_production_path(panel, few_targets):
    report = bt.leakage_sentinel(panel, few_targets, FeatureOptions(region_priors=True))
    assert report.count() > 50 and not report.filter("changed_rows > 0").count()


def test_sentinel_reports_a_broken_mask(panel, few_targets, monkeypatch):
    """With the mask taken out of the production path, hidden labels reach features and statistics."""
    monkeypatch.setattr(bt, "blind_origin", lambda rows, targets, blind, tail: bt.history_window(rows, targets, tail, blind).withColumn("is_blind", F.lit(False)))
    changed = {r.feature for r in bt.leakage_sentinel(panel, few_targets, FeatureOptions(region_priors=True)).filter("changed_rows > 0").collect()}
    assert "region_score_max" in changed


@pytest.mark.parametrize("block_rows", [64, 1000, 8192])
def test_small_deviations_near_large_values(spark, block_rows):
    """A tiny spread after a huge one, and on a high level, equals pandas whatever the block."""
    import pandas as pd

    from isohyet.operators import features as ft

    rng = np.random.default_rng(2)
    values = np.concatenate([np.tile([1e6, -1e6], 50), rng.choice([1.0, 1.2], 300), 1e6 + rng.normal(0, 1e-3, 100)])
    df = spark.createDataFrame(pd.DataFrame({"region_id": "R1", "day_idx": range(len(values)), "x": values}))
    got = ft.rolling(df, ["x"], [5, 28], ["mean", "std"], block_rows=block_rows).toPandas().sort_values("day_idx")
    for w in (5, 28):
        frames = [values[max(0, t - w) : t] for t in range(len(values))]
        for name, fn in ((f"x_rstd{w}", lambda f: f.std(ddof=1) if len(f) > 1 else np.nan), (f"x_rmean{w}", lambda f: f.mean() if len(f) else np.nan)):
            want = np.array([fn(f) for f in frames])
            rel = 1e-9 if "std" not in name else 1e-6
            assert np.allclose(got[name].astype(float), want, rtol=rel, atol=1e-9, equal_nan=True), name


def test_drift_of_a_side_with_itself(panel):
    rows = panel.withColumn("split", F.lit("train")).unionByName(panel.withColumn("split", F.lit("test")))
    flagged = drift.tail_baselines(rows, [0])
    table = drift.drift_counts(flagged, ["prec", "tmp", "wind_max"], ["full_train"])
    for fn, col in ((drift.psi, "psi"), (drift.ks, "ks"), (drift.quantile_wasserstein, "q_wasserstein")):
        assert all(abs(r[col]) < 1e-12 for r in fn(table, ["full_train"]).collect())


def test_drift_bounds_and_numpy(spark, folder):
    train, test = derive_splits(spark, folder)
    flagged = drift.tail_baselines(union_splits(train, test), [0])
    table = drift.drift_counts(flagged, ["tmp", "prec"], ["full_train"])
    a, b = (df.select("tmp").dropna().toPandas().tmp.to_numpy() for df in (train, test))
    ks = {r.feature: r.ks for r in drift.ks(table, ["full_train"]).collect()}
    grid = np.sort(np.concatenate([a, b]))
    want = np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)))
    assert abs(ks["tmp"] - want) < 1e-12 and all(0 <= v <= 1 for v in ks.values())
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    e, t = (np.clip(np.histogram(x, edges)[0] / len(x), 1e-6, None) for x in (a, b))
    psi = {r.feature: r.psi for r in drift.psi(table, ["full_train"]).collect()}
    assert abs(psi["tmp"] - np.sum((t - e) * np.log(t / e))) < 1e-9


def test_edge_panel(spark):
    """One-row region, all-null column, constant column, infinities and NaN."""
    rows = [("R1", "9999-12-31", 0, 5.0, None, 1.0, 3.0)] + [
        ("R2", f"3000-01-{d + 1:02d}", d, float("inf") if d == 3 else float("nan") if d == 4 else float(d), None, 1.0, 2.0 if d % 7 == 6 else None) for d in range(20)]
    df = clean_numeric(spark.createDataFrame(rows, "region_id string, date string, day_idx int, prec double, tmp double, wind double, score double"), ["prec", "tmp", "wind"])
    from isohyet.operators import features as ft

    out = in_order(ft.rolling(df, ["prec", "tmp", "wind"], [10], ["mean", "std"]))
    assert out.tmp_rmean10.isna().all() and np.isfinite(out.prec_rmean10.dropna()).all()
    assert (out.wind_rstd10.dropna() == 0).all() and out.wind_rstd10.isna().sum() == 3
    single = priors.region_priors(df).filter("region_id = 'R1'").first()
    assert single.region_score_std == 0.0 and single.region_score_median == 3.0
    report = {r.feature: r.missing for r in profiles.missingness(df, ["prec", "tmp"]).collect()}
    assert report == {"prec": 2, "tmp": 21}


def test_completeness_gate_raises(panel):
    final = samples.final_row(panel.select("region_id", "day_idx", "prec", "tmp"))
    with pytest.raises(ValueError, match="missing values"):
        profiles.completeness_gate(final, ["tmp"])
    with pytest.raises(ValueError, match="absent"):
        profiles.completeness_gate(final, ["nope"], fail=False)


def test_clip_keeps_null(spark):
    assert spark.range(1).select(clip(F.lit(None).cast("double")).alias("x")).first().x is None


def test_groups_and_look_back(panel):
    assert look_back_days(FeatureOptions(profile="full")) == 91 + 728
    wide = build_features(panel, panel, FeatureOptions(region_priors=True))
    groups = ["calendar", "short_lag", "rolling", "ewm", "long_drought_proxy", "domain_indices", "climatology", "score_history", "region_stats"]
    assert set(feature_columns(drop_groups(wide, groups))) == set(MEASURES)
    with pytest.raises(ValueError):
        drop_groups(wide, ["nothing"])


def test_origin_text():
    assert bt.parse_origins("5,-13") == [5, 13]
    with pytest.raises(ValueError):
        bt.parse_origins("4")
