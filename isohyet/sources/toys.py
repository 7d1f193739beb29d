"""Time-safe toy predictions over the derived panel: last, mean and recent maximum of the visible labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.fixed import GAP_DAYS, HORIZONS
from isohyet.operators.backtest import origin_band_join

MODELS = ("lgb", "xgb", "cat")


def toy_predictions(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """Prediction frame (region_id, origin, model, pred_week1..5) from labels at least 91 days before the origin."""
    age = F.col("origin_day_idx") - F.col("day_idx")
    labels = panel.select("region_id", "day_idx", "score").filter(F.col("score").isNotNull())
    visible = origin_band_join(labels, targets, GAP_DAYS)
    # Labels are weekly, so the five newest visible ones lie in the first 35 visible days.
    per_origin = visible.groupBy("region_id", "origin").agg(
        F.max_by("score", "day_idx").alias("lgb"), F.avg("score").alias("xgb"),
        F.max(F.when(age < GAP_DAYS + 35, F.col("score"))).alias("cat"))
    long = per_origin.unpivot(["region_id", "origin"], list(MODELS), "model", "pred")
    return long.select("region_id", "origin", "model", *[F.col("pred").alias(f"pred_week{h}") for h in range(1, HORIZONS + 1)])
