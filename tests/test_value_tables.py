"""Counts by value: one narrow shuffle, and tables by region that stay where they lie."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohyet.operators import drift
from isohyet.operators import quantiles as qt
from isohyet.queries.drift import both


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    n = 3000
    x = np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n).round(2))
    return pd.DataFrame({"k": rng.choice(["a", "b"], n), "x": np.where(rng.random(n) < 0.1, -0.0, x), "y": rng.normal(size=n), "s": rng.integers(0, 3, n)})


@pytest.mark.parametrize("held", [64, 200_000])
def test_counts_up_to_every_value(spark, values, held, monkeypatch):
    """Equal values of many small tables, of both signs of zero and of many ranges meet in one row."""
    monkeypatch.setattr(qt, "COUNTED_ROWS", held)
    rows = spark.createDataFrame(values).repartition(5).withColumn("y", F.when(F.col("s") > 0, F.col("y")))
    got = qt.value_table(rows, ["x", "y"], ["k"], {"all": F.lit(True), "one": F.col("s") == 1}).toPandas()
    long = values.assign(y=values.y.where(values.s > 0)).melt(["k", "s"], ["x", "y"], "feature", "value").dropna()
    long["value"] += 0.0
    long["one"] = (long.s == 1).astype(int)
    want = long.groupby(["k", "feature", "value"]).agg(all=("s", "size"), one=("one", "sum")).reset_index()
    for c in ("all", "one"):
        want[f"c_{c}"] = want.groupby(["k", "feature"])[c].cumsum()
        want[f"t_{c}"] = want.groupby(["k", "feature"])[c].transform("sum")
    got = got.sort_values(["k", "feature", "value"]).reset_index(drop=True)[list(want.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_a_frequent_value_is_few_rows_of_the_shuffle(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(qt, "materialize", lambda df, name, **o: seen.append(df) or df)
    qt.value_table(spark.range(0, 100_000, 1, 2).select(F.lit(1.0).alias("x")), ["x"], [], {"n": F.lit(True)})
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange rangepartitioning", plan)) == 1 and "hashpartitioning" not in plan


def test_season_flags_do_not_shuffle_the_panel(spark, folder):
    rows = drift.season_baselines(both(spark, folder).select("region_id", "day_idx", "date", "split", "prec"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    assert len(re.findall(r"\+- Sort \[[^\n]*md#", plan)) <= 2  # only the narrow sides of the previous year, never the panel


def test_rows_are_read_once_for_their_counts(spark):
    """Cutting ranges by a sample computed every row a second time."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 4000, 1, 4).select((F.col("id") % 50).cast("double").alias("x")).mapInArrow(watched, "x double")
    got = qt.value_table(rows, ["x"], [], {"n": F.lit(True)})
    assert got.count() == 50 and seen.value == 4000


def test_statistics_sum_values_where_they_lie(spark, values):
    """No row per value and baseline; figures are those of numpy over ranges of many batches, an empty side gives none."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows = spark.createDataFrame(values).select("x", "y", (F.col("s") == 0).alias("a"), F.lit(False).alias("none"), (F.col("s") == 2).alias("test"))
        table = drift.drift_counts(rows, ["x", "y"], ["a", "none"])
        for found in (drift.ks(table, ["a"]), drift.psi(table, ["a"]), drift.measure_auc(table, ["a"])):
            assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r.feature, r.baseline): r for r in drift.moments(table, ["a", "none"]).join(drift.ks(table, ["a", "none"]), ["feature", "baseline"]).join(
            drift.measure_auc(table, ["a", "none"]), ["feature", "baseline"]).join(drift.psi(table, ["a", "none"], adaptive=True), ["feature", "baseline"]).collect()}
        for c in ("x", "y"):
            a, b = (values[c][values.s == s].to_numpy() for s in (0, 2))
            grid = np.unique(np.concatenate([a, b]))
            gap = np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()
            auc = np.mean([(v > a).mean() + (v == a).mean() / 2 for v in b])
            r = got[c, "a"]
            assert (r.train_mean, r.test_mean, r.ks, r.auc) == pytest.approx((a.mean(), b.mean(), gap, auc))
            assert r.std_mean_delta == pytest.approx((b.mean() - a.mean()) / a.std(ddof=1)) and r.train_non_null == len(a) and r.psi > 0
            empty = got[c, "none"]
            assert (empty.ks, empty.auc, empty.psi, empty.train_mean, empty.test_mean) == (None, None, None, None, pytest.approx(b.mean()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_wide_rows_are_not_stored_for_the_drift_table(spark, folder, monkeypatch):
    """They were written and read back, though counts need them once."""
    from isohyet.queries import drift as queries
    from isohyet.queries import registry

    seen = []
    monkeypatch.setattr(registry, "_KEPT", {})
    monkeypatch.setattr(registry, "_STORED", {})
    monkeypatch.setattr(queries.drift, "feature_drift_table", lambda rows, *args: seen.append(rows) or spark.range(1))
    queries.full_table(spark, folder)
    assert "FlatMapGroupsInArrow" in seen[0]._jdf.queryExecution().executedPlan().toString()
