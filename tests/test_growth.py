"""Steps that larger tables share: what they read, where rows are joined, what leaves a task."""

import pandas as pd
import pytest

from isohyet.operators import backtest as bt
from isohyet.operators import samples
from isohyet.queries.registry import label_panel
from isohyet.sources import derived

KEYS = ["region_id", "day_idx"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_stored_without_measures(spark, folder, monkeypatch):
    monkeypatch.setattr(derived, "_STORED", {})
    narrow = derived.stored_panel(spark, folder, labels_only=True)
    assert narrow.columns == derived.LABEL_COLUMNS
    whole = derived.stored_panel(spark, folder)
    assert "tmp" in whole.columns and not narrow.exceptAll(whole.select(narrow.columns)).count() and narrow.count() == whole.count()
    assert plan(derived.stored_panel(spark, folder, labels_only=True)).count("isohyet_panel") == 1


def test_weekly_rows_are_numbered_where_they_lie(spark, folder):
    rows = label_panel(spark, folder)
    for weekly in (samples.lead_targets(rows), samples.row_index(rows)):
        assert "Join" not in plan(weekly) and "Exchange" not in plan(weekly)


def test_weekly_rows_without_key_or_day_and_repeated_days(spark, folder):
    """One window or blocks with joins: the same rows."""
    schema = label_panel(spark, folder).select("region_id", "day_idx", "score").schema
    rows = [(r, d, float((d or 3) % 6)) for r in ("a", "b", None) for d in (*range(0, 90, 7), None, 14)]
    one = spark.createDataFrame(rows, "region_id string, day_idx int, score double")
    marked = one.withMetadata("day_idx", schema["day_idx"].metadata)
    assert "Join" in plan(samples.lead_targets(one)) and "Join" not in plan(samples.lead_targets(marked))
    for fn in (samples.lead_targets, samples.row_index):
        a, b = (fn(x).select("region_id", "day_idx", "week_idx", "max_week_idx").toPandas().sort_values(["region_id", "week_idx"]) for x in (one, marked))
        assert len(a) and a.values.tolist() == b.values.tolist()


@pytest.mark.parametrize("youngest, oldest", [(0, 90), (91, None), (5, 5)])
def test_days_near_origins(spark, youngest, oldest):
    days = pd.DataFrame([(r, d) for r in ("a", "b") for d in range(300)], columns=KEYS)
    origins = pd.DataFrame([("a", "x", "d", 100), ("a", "y", "d", 250), ("b", "x", "d", 20), ("c", "x", "d", 9)], columns=["region_id", "origin", "origin_date", "origin_day_idx"])
    got = bt.origin_band_join(spark.createDataFrame(days), spark.createDataFrame(origins), youngest, oldest)
    both = days.merge(origins, on="region_id")
    age = both.origin_day_idx - both.day_idx
    want = both[(age >= youngest) & (age <= (oldest if oldest is not None else 10**6))]
    keys = ["region_id", "day_idx", "origin"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, want[keys].values.tolist()))
