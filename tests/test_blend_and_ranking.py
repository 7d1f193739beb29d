"""Blending against brute force on small frames; file readers and writers."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohyet.operators import blend, ranking
from isohyet.sources import ledgers, predictions
from isohyet.sources.panel import metric_rows, read_panel, sample_panel, write_metrics, write_panel

MODELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def aligned(spark):
    rng = np.random.default_rng(3)
    rows = [(f"R{i}", f"o{i % 3}", h, float(rng.integers(0, 6)), *[float(x) for x in rng.uniform(0, 5, 3)]) for i in range(30) for h in (1, 2, 3, 4, 5)]
    return spark.createDataFrame(rows, "region_id string, origin string, horizon int, target double, a double, b double, c double")


def brute(pdf, step, anchor, lam, caps=(1, 1, 1)):
    units, best = round(1 / step), None
    for i, j in itertools.product(range(units + 1), repeat=2):
        w = np.array([i, j, units - i - j]) / units
        if w[2] < 0 or (w > np.array(caps) + 1e-12).any():
            continue
        mae = np.abs(pdf[MODELS].to_numpy() @ w - pdf.target).mean()
        score = mae + lam * ((w - anchor) ** 2).sum()
        if best is None or score < best[0] - 1e-12:
            best = (score, w, mae)
    return best


def test_constrained_fit_equals_brute_force(aligned):
    anchor = {"a": 0.35, "b": 0.35, "c": 0.3}
    got = blend.constrained_fit(aligned, MODELS, anchor, {"a": 0.5}, step=0.1).toPandas().set_index("horizon")
    pdf = aligned.toPandas()
    for h in range(1, 6):
        _, w, mae = brute(pdf[pdf.horizon == h], 0.1, np.array([0.35, 0.35, 0.3]), 0.05, (0.5, 1, 1))
        assert np.allclose(got.loc[h, ["w_a", "w_b", "w_c"]], w) and abs(got.loc[h, "mae"] - mae) < 1e-9
    assert np.allclose(got[["w_a", "w_b", "w_c"]].sum(axis=1), 1)


def test_bootstrap_equals_refit(aligned, spark):
    draws = [(0, "o0", 2), (0, "o1", 1), (1, "o2", 3)]
    errors = blend.error_table(aligned, MODELS, 0.25)
    got = blend.bootstrap_fit(errors, draws, MODELS, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}).toPandas()
    pdf, fits = aligned.toPandas(), []
    for d in (0, 1):
        part = pd.concat([pdf[pdf.origin == o] for dd, o, t in draws if dd == d for _ in range(t)])
        fits.append(brute(part[part.horizon == 2], 0.25, np.full(3, 1 / 3), 0.05)[1])
    mean = np.mean(fits, axis=0)
    assert np.allclose(got[got.horizon == 2].sort_values("model")["mean"], mean)


def test_segments_fit_on_their_own(aligned):
    segmented = aligned.withColumn("segment", F.col("origin"))
    got = blend.search_three(segmented, MODELS, 0.25, ["segment"]).filter("segment = 'o1' and horizon = 3").first()
    pdf = aligned.toPandas()
    _, w, _ = brute(pdf[(pdf.origin == "o1") & (pdf.horizon == 3)], 0.25, np.zeros(3), 0.0)
    assert np.allclose([got.w_a, got.w_b, got.w_c], w)


def test_softmax_caps(spark):
    scores = spark.createDataFrame([("o", m, s) for m, s in zip("abcd", (0.30, 0.31, 0.5, 0.9))], "origin string, model string, mae double")
    got = blend.risk_softmax_weights(scores, 0.05, 0.4, score="mae").toPandas().set_index("model").weight
    assert abs(got.sum() - 1) < 1e-9 and got["a"] >= got["b"] > got["c"] > got["d"]


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        blend.check_weights({"a": [0.5] * 5, "b": [0.4] * 5})
    with pytest.raises(ValueError):
        blend.weight_grid(3, 0.3)
    points = [tuple(x) for x in spark.range(1).select(blend.value_grid((-0.1, 0.1, 0.1), (0.0, 1.0, 0.5)).alias("g")).first().g]
    assert points == [(a, b) for a in (-0.1, 0.0, 0.1) for b in (0.0, 0.5, 1.0)]
    capped = spark.range(1).select(blend.weight_grid(3, 0.5, [0.5, 1.0, 1.0]).alias("g")).first().g
    assert [tuple(x) for x in capped] == [(0, 0, 1), (0, 0.5, 0.5), (0, 1, 0), (0.5, 0, 0.5), (0.5, 0.5, 0)]
    assert blend.parse_weights("0.5, 0.3, 0.2", MODELS)["b"] == [0.3] * 5 and blend.parse_weights("a=1,0,0,0,0;b=0,1,1,1,1;c=0", MODELS)["a"][0] == 1
    for text in ("a=0.5;b=0.5", "0.5,0.5", "a=1,2;b=0;c=0"):
        with pytest.raises(ValueError):
            blend.parse_weights(text, MODELS)


def test_incomplete_predictions_show(spark):
    """A missing model is no blend, a repeated key hides no gap, and unmatched keys are counted."""
    row = lambda region, model, value: (region, "o", model, *[value] * 5)
    schema = "region_id string, origin string, model string, " + ", ".join(f"pred_week{h} double" for h in range(1, 6))
    preds = spark.createDataFrame([row("R1", "a", 4.0), row("R2", "a", 1.0), row("R2", "b", 3.0), row("R3", "a", 1.0), row("R3", "a", 1.0), row("R3", "b", 1.0)], schema)
    got = {r.region_id: r.pred for r in blend.convex_blend(preds, {"a": [0.5] * 5, "b": [0.5] * 5}).filter("horizon = 1").collect()}
    assert got == {"R1": None, "R2": 2.0, "R3": None}
    twice = spark.createDataFrame([("R1", "m", *[1.0] * 5)] * 2, "region_id string, model string, " + schema.split(", ", 3)[3])
    report = ranking.validate_predictions(twice, spark.createDataFrame([("R1",), ("R2",)], "region_id string")).first()
    assert (report.missing_keys, report.duplicate_rows, report.is_valid) == (1, 1, False)
    with pytest.raises(ValueError):
        predictions.check_predictions(twice)
    with pytest.raises(ValueError):
        predictions.align_to_template(twice.select("region_id"), twice)
    long = blend.to_long(preds, ["region_id", "origin", "model"])
    delta = blend.mean_abs_delta(long.filter("model = 'a' and region_id < 'R3'"), long.filter("model = 'b' and region_id < 'R3'")).first()
    assert delta.unmatched_keys == 5 and delta.mean_abs_delta == 2.0


def test_prediction_files(spark, tmp_path):
    for name, shift in (("one", 0.0), ("two", 1.0)):
        pd.DataFrame({"region_id": ["R1", "R2"], **{c: [shift, shift + 1] for c in predictions.PREDS}}).to_csv(tmp_path / f"{name}.csv", index=False)
    df = predictions.read_predictions(spark, {n: str(tmp_path / f"{n}.csv") for n in ("one", "two")})
    report = ranking.validate_predictions(df, spark.createDataFrame([("R1",), ("R2",), ("R3",)], "region_id string")).toPandas()
    assert set(report.missing_keys) == {1} and not report.is_valid.any()
    with pytest.raises(ValueError):
        predictions.align_to_template(spark.createDataFrame([("R9",)], "region_id string"), df, fill=None)
    predictions.write_predictions(df.filter("model = 'one'"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_panel_files(spark, panel, tmp_path):
    small = sample_panel(panel, max_regions=2)
    write_panel(small, str(tmp_path / "panel"))
    back = read_panel(spark, str(tmp_path / "panel"), ["region_id", "date", "prec", "score"])
    assert back.count() == small.count() and back.columns == ["region_id", "date", "prec", "score"]
    text = small.select("region_id", "date", *[F.col(c).cast("string").alias(c) for c in small.columns if c not in ("region_id", "date", "day_idx")])
    text.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    assert read_panel(spark, str(tmp_path / "csv"), fmt="csv").count() == small.count()
    metrics = spark.createDataFrame([("mae", "all", 0.5)], "metric string, key string, value double")
    for run in ("r1", "r2", "r1"):
        write_metrics(metric_rows(metrics, run), str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2


def test_ledger_files(spark, tmp_path):
    for day, score in (("20240101", 0.9), ("20240102", 0.8)):
        doc = {"ledger": day, "items": [{"path": "x.csv", "ref": 7, "public_mae": score}, {"submission": "y.csv", "path": "z.csv", "ref": 8, "public_mae": score}]}
        (tmp_path / f"{day}.json").write_text(json.dumps(doc, indent=1))
    rows = {r.path: (r.ledger, r.public_mae) for r in ledgers.flatten_ledgers(ledgers.read_ledgers(spark, str(tmp_path))).collect()}
    assert rows == {"x.csv": ("20240102", 0.8), "y.csv": ("20240102", 0.8)}


def test_history_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "a.csv  2024-01-01 10:00:00.123  first   try  Status.COMPLETE  0.81 0.83\nb.csv 2024-01-02 10:00:00.1 second Status.COMPLETE\n"
        "c.csv 2024-01-02 10:00:00.1 waiting Status.PENDING\nnoise\n")
    got = {r.file_name: (r.description, r.public_score, r.private_score) for r in ledgers.parse_history(ledgers.read_lines(spark, str(tmp_path / "log.txt"))).collect()}
    assert got == {"a.csv": ("first try", 0.81, 0.83), "b.csv": ("second", None, None)}


def test_global_position_equals_sort(spark):
    """Half the leading keys are missing and one is far away; ranks are those of a sort, and ranges stay even."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.integers(0, 50, 4000).astype(float), "id": range(4000)})
    pdf.loc[::2, "x"], pdf.loc[1, "x"] = None, 1e30
    rows = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    order = [F.col("x").asc_nulls_last(), F.col("id").asc()]
    got = ranking.global_position(rows, order, "rank").toPandas().sort_values("rank")
    assert list(got.id) == list(pdf.sort_values(["x", "id"], na_position="last").id) and list(got["rank"]) == list(range(1, 4001))
    sizes = [r["count"] for r in rows.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * 4000 / len(sizes)


@pytest.mark.parametrize("models, step, caps", [(2, 0.05, None), (3, 0.1, [0.6, 1.0, 0.5]), (4, 0.25, None), (5, 0.25, [0.5, 1.0, 1.0, 0.75, 1.0])])
def test_breakpoints_equal_the_whole_grid(spark, models, step, caps):
    """Every point of the grid: ties at zero, equal models, models that are absent."""
    import random
    from itertools import product

    rng, parts, names = random.Random(models), round(1 / step), [f"m{i}" for i in range(models)]
    rows = [("h", float(rng.randrange(6)), *[round(rng.uniform(0, 5), rng.choice([0, 1, 6])) for _ in names]) for _ in range(60)]
    rows += [("h", 2.0, *[2.0] * models), ("h", 1.0, *[3.0] * models), ("h", None, *[1.0] * models), ("h", 1.0, None, *[1.0] * (models - 1))]
    df = spark.createDataFrame(rows, "k string, target double, " + ", ".join(f"{n} double" for n in names))
    got = {r["grid_idx"]: r for r in blend.error_table(df, names, step, ["k"], caps).collect()}
    points = [p for p in product(range(parts + 1), repeat=models) if sum(p) == parts]
    kept = [i for i, p in enumerate(points) if all(x / parts <= c + 1e-12 for x, c in zip(p, caps or [1.0] * models))]
    assert sorted(got) == kept
    whole = [r for r in rows if None not in r]
    for i in kept:
        want = sum(abs(sum(x / parts * v for x, v in zip(points[i], r[2:])) - r[1]) for r in whole)
        assert got[i]["sum_abs"] == pytest.approx(want, abs=1e-9) and got[i]["n"] == len(whole)
        assert [got[i][f"w_{n}"] for n in names] == [x / parts for x in points[i]]
