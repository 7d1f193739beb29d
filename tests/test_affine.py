"""The affine search: errors are summed per task and grid point."""

import numpy as np
import pytest

from isohyet.operators import blend


@pytest.mark.parametrize("held", [7, 4096])
def test_affine_search_equals_loops_and_copies_no_row(spark, held, monkeypatch):
    monkeypatch.setattr(blend, "ROWS_AT_ONCE", held)
    rng = np.random.default_rng(5)
    rows = [("m" if i % 3 else None, i % 2 + 1, float(p), float(t)) for i, (p, t) in enumerate(zip(rng.uniform(-1, 6, 200), rng.integers(0, 6, 200)))]
    long = spark.createDataFrame([*rows, ("m", 1, None, 1.0), ("m", 1, 1.0, None)], "model string, horizon int, pred double, target double").repartition(3)
    axes = (0.75, 1.10, 0.05), (-0.30, 0.15, 0.05)
    fitted = blend.fit_affine(long, *axes, by=("model", "horizon"))
    assert "Generate" not in fitted._jdf.queryExecution().executedPlan().toString()
    got = {(r.model, r.horizon): r for r in fitted.collect()}
    assert len(got) == 4
    for key, r in got.items():
        pred, target = np.array([x[2:] for x in rows if x[:2] == key]).T
        tried = [(round(np.abs(np.clip(pred * s + b, 0, 5) - target).mean() + 0.02 * ((s - 1) ** 2 + b**2), 9), i, s, b)
                 for i, (s, b) in enumerate((round(0.75 + 0.05 * i, 10), round(-0.3 + 0.05 * j, 10)) for i in range(8) for j in range(10))]
        assert (r.scale, r.bias) == min(tried)[2:] and r.baseline_mae == pytest.approx(np.abs(pred - target).mean())
