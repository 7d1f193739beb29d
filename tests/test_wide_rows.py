"""Wide rows leave the windows only where they are wanted, and slices share their tables."""

import math

import pytest
from pyspark.sql import functions as F

from isohyet.fixed import MEASURES
from isohyet.operators import adversarial, drift, samples
from isohyet.operators import features as ft
from isohyet.plans.feature_table import FeatureOptions, build_features


def rows_of(spark, days=300, regions=3):
    """A panel with gaps, a label every seventh day and one date that a region holds twice, once without label."""
    out = []
    for r in range(regions):
        for d in range(days):
            values = [None if (d + i + r) % 5 == 0 else float((d * (i + 3) + 7 * r) % 23) for i in range(len(MEASURES))]
            out.append((f"R{r}", f"{2001 + d // 360}-{d % 360 // 30 + 1:02d}-{min(28, d % 30 + 1):02d}", d, *values, float((d // 7 + r) % 6) if d % 7 == 6 else None))
    out[8] = (*out[8][:1], out[6][1], *out[8][2:])
    return spark.createDataFrame(out, "region_id string, date string, day_idx int, " + ", ".join(f"{c} double" for c in MEASURES) + ", score double")


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for v, w in zip(x, y, strict=True):
            assert v == w or (isinstance(v, float) and isinstance(w, float) and math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("block_rows", [None, 64])
def test_days_of_leaves_out_only_days_that_no_label_joins(spark, block_rows):
    panel = rows_of(spark)
    weekly = samples.lead_targets(panel.select("region_id", "date", "day_idx", "score"))
    options = FeatureOptions()
    few = build_features(panel, panel, options, block_rows=block_rows, days_of="score")
    whole = build_features(panel, panel, options, block_rows=block_rows)
    assert few.count() < whole.count() / 3
    joined = [samples.labels_join_features(weekly, t).orderBy("region_id", "day_idx", *MEASURES).collect() for t in (whole, few)]
    _same(*joined)


def test_baselines_flagged_before_windows_are_those_flagged_after(spark):
    panel = rows_of(spark).drop("score")
    both = panel.withColumn("split", F.when(F.col("day_idx") < 260, "train").otherwise("test"))
    wanted = ["region_id", "day_idx", "prec", "prec_sum_90d", "max_dry_streak_90d", "dryness_idx_daily", *drift.SEASON_BASELINES, drift.TEST]
    train, test = (both.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    after = drift.season_baselines(ft.shifted_context(train, test)).select(wanted).orderBy("region_id", "day_idx", "prec").collect()
    before = ft.context_columns(drift.season_baselines(both)).select(wanted).orderBy("region_id", "day_idx", "prec").collect()
    _same(after, before)


def test_slices_share_one_table_of_values(spark, monkeypatch):
    flagged = rows_of(spark).select("region_id", "day_idx", "prec", "tmp", (F.col("day_idx") >= 260).alias("test")).withColumns({
        "split": F.when(F.col("test"), "test").otherwise("train"), "a": ~F.col("test"), "b": ~F.col("test") & (F.col("day_idx") >= 100)})
    alone = {b: adversarial.tree_scores(flagged.filter(F.col(b) | F.col("test")), ["prec", "tmp"], rounds=2, name=f"adversarial_auc_tree|{b}") for b in "ab"}
    tables, counted = [], adversarial.value_table
    monkeypatch.setattr(adversarial, "value_table", lambda *args: tables.append(1) or counted(*args))
    together = adversarial.slice_scores(flagged, ["prec", "tmp"], ["a", "b"], rounds=2)
    assert len(tables) == 1
    for b, scores in alone.items():
        keys = ["region_id", "day_idx", "label", "score"]
        mine = together.filter(F.col("metric") == f"adversarial_auc_tree|{b}").select(keys).orderBy(keys).collect()
        _same(scores.select(keys).orderBy(keys).collect(), mine)


def test_trees_learn_from_every_row(spark, monkeypatch):
    """Sides of more than 20,000 rows were drawn from; the fit takes all rows of both, in equal weight."""
    rows = spark.range(52_000).select(
        F.lit("R1").alias("region_id"), F.col("id").cast("int").alias("day_idx"), (F.col("id") % 97).cast("double").alias("prec"),
        F.when(F.col("id") < 27_000, "train").otherwise("test").alias("split"))
    seen = []

    class Watched(adversarial.Pipeline):
        def fit(self, df):
            seen.append(df.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).orderBy("label").collect())
            return super().fit(df)

    monkeypatch.setattr(adversarial, "Pipeline", Watched)
    scores = adversarial.tree_scores(rows, ["prec"], rounds=1)
    assert [[r.n for r in sides] for sides in seen] == [[27_000, 25_000]]
    assert seen[0][0].w == pytest.approx(seen[0][1].w) and scores.count() == 52_000
