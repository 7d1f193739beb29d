"""Blending and calibration of model predictions.

Long frames carry (region_id, origin, horizon, model, pred); aligned frames have one column per model
and the target.  A search over weights sums rows per edge of the grid and breakpoint (`error_table`); other
searches explode their grid and aggregate partially, so the exploded rows never leave their task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from isohyet.fixed import HORIZONS, LABEL_MAX, LABEL_MIN
from isohyet.functions.numeric import clip

KEYS = ("region_id", "origin")
PREDS = [f"pred_week{h}" for h in range(1, HORIZONS + 1)]
TIE_DIGITS = 9
#: Rows that a task holds next to the whole grid.
ROWS_AT_ONCE = 4096


def to_long(wide: DataFrame, keep: Sequence[str], columns: Sequence[str] = tuple(PREDS), value: str = "pred") -> DataFrame:
    """(keep..., horizon, value) from one column per horizon."""
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).cast("double").alias(value)) for h, c in enumerate(columns, 1)])
    return wide.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")


def to_wide(long: DataFrame, keep: Sequence[str], value: str = "pred") -> DataFrame:
    return long.groupBy(*keep).agg(*[F.max(F.when(F.col("horizon") == h, F.col(value))).alias(f"pred_week{h}") for h in range(1, HORIZONS + 1)])


def align_models(preds: DataFrame, targets: DataFrame, models: Sequence[str], keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Target keys with one prediction column per model; absent and repeated predictions are NULL and raise when `strict`."""
    t = to_long(targets, [*KEYS, *keep], [f"target_w{h}" for h in range(1, HORIZONS + 1)], "target")
    one = {m: F.col("model") == m for m in models}
    p = to_long(preds, [*KEYS, "model"]).groupBy(*KEYS, "horizon").agg(
        *[F.when(F.count_if(own) == 1, F.max(F.when(own, F.col("pred")))).alias(m) for m, own in one.items()])
    out = t.join(p, [*KEYS, "horizon"], "left")
    if strict:
        gaps = out.filter(" or ".join(f"`{m}` is null" for m in models)).limit(1).count()
        if gaps:
            raise ValueError("some target keys have no prediction of a model, or more than one")
    return out


def weight_grid(models: int, step: float, caps: Sequence[float] | None = None) -> Column:
    """All ways to share one among `models` in parts of `step`, as an array of arrays in lexicographic order.

    A generator expression: the first model may take nothing up to everything, the next one up to what is left,
    and so on; the last one takes the rest. Shares above a model's cap are filtered out.
    """
    parts = round(1.0 / step)
    if abs(parts * step - 1.0) > 1e-9:
        raise ValueError("step must divide 1 evenly")

    def choices(taken: list[Column]) -> Column:
        left = F.lit(parts)
        for share in taken:
            left = left - share
        if len(taken) == models - 1:
            return F.array(F.array(*taken, left))
        return F.flatten(F.transform(F.sequence(F.lit(0), left), lambda share: choices([*taken, share])))

    shares = F.transform(choices([]), lambda point: F.transform(point, lambda x: x / F.lit(parts)))
    limits = [(k, cap) for k, cap in enumerate(caps or []) if cap < 1.0]

    def within(point: Column) -> Column:
        ok = F.lit(True)
        for k, cap in limits:
            ok = ok & (point[k] <= cap + 1e-12)
        return ok

    return F.filter(shares, within) if limits else shares


def value_grid(*axes: tuple[float, float, float]) -> Column:
    """Every combination of evenly spaced values, first axis outermost; an axis is (first, last, step)."""
    def values(axis: tuple[float, float, float]) -> Column:
        first, last, step = axis
        return F.transform(F.sequence(F.lit(0), F.lit(round((last - first) / step))), lambda i: F.round(F.lit(first) + i * F.lit(step), 10))

    def points(head: list[Column]) -> Column:
        if len(head) == len(axes) - 1:
            return F.transform(values(axes[-1]), lambda x: F.array(*head, x))
        return F.flatten(F.transform(values(axes[len(head)]), lambda x: points([*head, x])))

    return points([])


def _spread(rows: DataFrame, keep: Sequence[str], grid: Column, names: Sequence[str]) -> DataFrame:
    """One row per grid point, with its number and coordinates."""
    points = rows.select(*keep, F.posexplode(grid).alias("grid_idx", "_g"))
    return points.select(*keep, "grid_idx", *[F.col("_g")[i].alias(n) for i, n in enumerate(names)])


def _edges(models: int, parts: int, limits: Sequence[float]) -> list[dict[str, int]]:
    """Shares of all models but the last two, with what they leave and the number of their first grid point."""
    out, at = [], 0
    for head in product(range(parts + 1), repeat=models - 2):
        left = parts - sum(head)
        if left >= 0:
            if all(x / parts <= cap + 1e-12 for x, cap in zip(head, limits)):
                out.append({"at": at, "left": left, **{f"h{i}": x for i, x in enumerate(head)}})
            at += left + 1
    return out


def error_table(
    aligned: DataFrame, models: Sequence[str], step: float, by: Sequence[str] = ("origin", "horizon"), caps: Sequence[float] | None = None,
    times: Column | None = None,
) -> DataFrame:
    """Absolute error sums of every grid point: (by..., grid_idx, w_<model>..., sum_abs, n), a row counted `times`.

    Points are numbered in lexicographic order of the shares. Along an edge of the grid, where the last two models
    share what the others leave, a row's error is |a + b*t| with one breakpoint. Rows are summed per edge and
    breakpoint, and prefix sums over an edge's few breakpoints give all its points: rows are repeated per edge, not
    per point. Rows without a target or a model are left out.
    """
    parts = round(1.0 / step)
    if abs(parts * step - 1.0) > 1e-9:
        raise ValueError("step must divide 1 evenly")
    limits = list(caps) if caps else [1.0] * len(models)
    *head, near, last = models
    edges, names = _edges(len(models), parts, limits), ["at", "left", *[f"h{i}" for i in range(len(head))]]
    listed = F.from_json(F.lit(json.dumps(edges)), f"array<struct<{','.join(f'{n}:int' for n in names)}>>")
    known = " and ".join(f"`{c}` is not null" for c in [*models, "target"])
    rows = aligned.filter(known).select(*by, *models, "target", (times if times is not None else F.lit(1)).cast("double").alias("_m"), F.explode(listed).alias("_e"))
    start = sum((F.col(f"_e.h{i}") * F.col(m) for i, m in enumerate(head)), F.col("_e.left") * F.col(last)) / parts - F.col("target")
    rows = rows.select(*by, "_m", "_e.*", start.alias("_a"), ((F.col(near) - F.col(last)) / parts).alias("_b"))
    sign = F.when((F.col("_b") < 0) | ((F.col("_b") == 0) & (F.col("_a") < 0)), -1.0).otherwise(1.0)
    turn = F.when(F.col("_b") == 0, 0).otherwise(F.least(F.col("left") + 1.0, F.greatest(F.lit(0.0), F.ceil(-F.col("_a") / F.col("_b")))))
    bins = rows.select(*by, *names, turn.cast("int").alias("_at"), (sign * F.col("_a") * F.col("_m")).alias("_a"), (sign * F.col("_b") * F.col("_m")).alias("_b"), "_m")
    bins = bins.groupBy(*by, *names, "_at").agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"), F.sum("_m").alias("m"))
    # An edge has at most parts + 2 breakpoints.
    per = bins.groupBy(*by, *names).agg(
        F.collect_list(F.struct("_at", "a", "b")).alias("_bins"), F.sum("a").alias("_ta"), F.sum("b").alias("_tb"), F.sum("m").cast("long").alias("n"))
    points = per.select("*", F.explode(F.sequence(F.lit(0), F.col("left"))).alias("_t"))
    after = F.filter("_bins", lambda x: x["_at"] <= F.col("_t"))
    positive = F.aggregate(after, F.lit(0.0), lambda total, x: total + x["a"] + x["b"] * F.col("_t"))
    shares = [*[F.col(f"h{i}") for i in range(len(head))], F.col("_t"), F.col("left") - F.col("_t")]
    out = points.select(
        *by, (F.col("at") + F.col("_t")).alias("grid_idx"), *[(x / F.lit(parts)).alias(f"w_{m}") for m, x in zip(models, shares, strict=True)],
        F.greatest(F.lit(0.0), 2 * positive - (F.col("_ta") + F.col("_tb") * F.col("_t"))).alias("sum_abs"), "n")
    for m, cap in zip(models, limits, strict=True):
        if cap < 1.0:
            out = out.filter(F.col(f"w_{m}") <= cap + 1e-12)
    return out


def _best(scored: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Grid point with the lowest objective per group; equal objectives keep the earlier point."""
    key = F.struct(F.round("objective", TIE_DIGITS), F.col("grid_idx"))
    return scored.groupBy(*by).agg(F.min_by(F.struct(*values), key).alias("_b")).select(*by, "_b.*")


def fit_weights(
    errors: DataFrame, models: Sequence[str], anchor: dict[str, float] | None = None, lambda_reg: float = 0.0,
    by: Sequence[str] = ("horizon",),
) -> DataFrame:
    """Best weights per group by MAE + lambda * squared distance to the anchor."""
    weights = [f"w_{m}" for m in models]
    totals = errors.groupBy(*by, "grid_idx", *weights).agg((F.sum("sum_abs") / F.sum("n")).alias("mae"))
    pull = sum(((F.col(f"w_{m}") - (anchor or {}).get(m, 0.0)) ** 2 for m in models), F.lit(0.0)) if anchor else F.lit(0.0)
    return _best(totals.withColumn("objective", F.col("mae") + lambda_reg * pull), by, [*weights, "mae", "objective"])


def search_two(aligned: DataFrame, models: Sequence[str], step: float, segment: Sequence[str] = ()) -> DataFrame:
    by = [*segment, "horizon"]
    return fit_weights(error_table(aligned, models, step, by), models, by=by)


def search_three(aligned: DataFrame, models: Sequence[str], step: float, segment: Sequence[str] = ()) -> DataFrame:
    by = [*segment, "horizon"]
    return fit_weights(error_table(aligned, models, step, by), models, by=by)


def constrained_fit(
    aligned: DataFrame, models: Sequence[str], anchor: dict[str, float], caps: dict[str, float] | None = None,
    step: float = 0.02, lambda_reg: float = 0.05, segment: Sequence[str] = (),
) -> DataFrame:
    limits = [(caps or {}).get(m, 1.0) for m in models]
    parts = round(1.0 / step)
    if min(limits) < 0 or sum(min(parts, int(c * parts + 1e-9)) for c in limits) < parts:
        raise ValueError("no weights satisfy the caps")
    by = [*segment, "horizon"]
    return fit_weights(error_table(aligned, models, step, by, limits), models, anchor, lambda_reg, by)


def residual_correlation(aligned: DataFrame, models: Sequence[str], segment: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of model residuals per horizon; a constant residual gives 0."""
    pairs = [(a, b) for a in models for b in models]
    rows = aligned.select(*segment, "horizon", *[(F.col(m) - F.col("target")).alias(m) for m in models])
    spreads = [F.stddev_pop(m).alias(f"_s_{m}") for m in models]
    covs = [F.covar_pop(a, b).alias(f"_c_{a}_{b}") for a, b in pairs]
    wide = rows.groupBy(*segment, "horizon").agg(*spreads, *covs)

    def corr(a: str, b: str) -> Column:
        scale = F.col(f"_s_{a}") * F.col(f"_s_{b}")
        return F.when(scale > 1e-12, F.col(f"_c_{a}_{b}") / F.nullif(scale, F.lit(0.0))).otherwise(0.0)

    cells = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), corr(a, b).alias("corr")) for a, b in pairs])
    return wide.select(*segment, "horizon", F.explode(cells).alias("_p")).select(*segment, "horizon", "_p.*")


def bootstrap_fit(
    errors: DataFrame, draws: Sequence[tuple[int, str, int]], models: Sequence[str], anchor: dict[str, float],
    lambda_reg: float = 0.05, segment: Sequence[str] = (),
) -> DataFrame:
    """Refit per draw by re-weighting the error table, then summarise the weights.

    `draws` lists (draw, origin, multiplicity); it is given by the caller, and Spark broadcasts it if it is small.
    """
    table = errors.sparkSession.createDataFrame(list(draws), "draw int, origin string, times int")
    drawn = errors.join(table, "origin").withColumns({"sum_abs": F.col("sum_abs") * F.col("times"), "n": F.col("n") * F.col("times")})
    return _draw_summary(fit_weights(drawn, models, anchor, lambda_reg, [*segment, "draw", "horizon"]), models, segment)


#: Chances that a row is drawn at most 0, 1, 2 ... times when as many rows are drawn as there are (Poisson of mean one).
AT_MOST = [round(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)), 12) for k in range(10)]


def row_times(draw: Column, keys: Sequence[str], seed: int) -> Column:
    """How often a draw takes a row: a number from a digest of the row's key, so reruns and other engines agree."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], draw.cast("string"), F.lit(str(seed))))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
    return sum((F.when(share >= p, 1).otherwise(0) for p in AT_MOST), F.lit(0))


def bootstrap_rows(
    aligned: DataFrame, draws: int, models: Sequence[str], anchor: dict[str, float], step: float = 0.1, lambda_reg: float = 0.05,
    keys: Sequence[str] = (*KEYS, "horizon"), seed: int = 42, segment: Sequence[str] = (),
) -> DataFrame:
    """Bootstrap over rows, where there are no origins to draw: multiplicities weight the rows, which are never copied."""
    numbered = aligned.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    numbered = numbered.withColumn("_times", row_times(F.col("draw"), keys, seed)).filter("_times > 0")
    by = [*segment, "draw", "horizon"]
    fits = fit_weights(error_table(numbered, models, step, by, times=F.col("_times")), models, anchor, lambda_reg, by)
    return _draw_summary(fits, models, segment)


def _draw_summary(fits: DataFrame, models: Sequence[str], segment: Sequence[str]) -> DataFrame:
    """Mean, spread and 5 and 95% quantiles of each model's weight over the draws."""
    weights = [f"w_{m}" for m in models]
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(w).alias("weight")) for m, w in zip(models, weights)])
    long = fits.select(*segment, "horizon", F.explode(cells).alias("_w")).select(*segment, "horizon", "_w.*")
    # A group holds one weight per draw.
    return long.groupBy(*segment, "horizon", "model").agg(
        F.avg("weight").alias("mean"), F.coalesce(F.stddev_samp("weight"), F.lit(0.0)).alias("std"),
        F.percentile("weight", F.lit(0.05)).alias("p05"), F.percentile("weight", F.lit(0.95)).alias("p95"))


def check_weights(weights: dict[str, Sequence[float]]) -> None:
    for h in range(HORIZONS):
        total = sum(w[h] for w in weights.values())
        if abs(total - 1.0) > 1e-8:
            raise ValueError(f"weights of horizon {h + 1} sum to {total:.6f}")


def convex_blend(preds: DataFrame, weights: dict[str, Sequence[float]]) -> DataFrame:
    """Weighted sum of models per horizon with weights that sum to one, clipped: (region_id, origin, horizon, pred).

    A key that lacks a model, or has one twice, gets NULL: part of a blend is no blend.
    """
    check_weights(weights)
    maps = F.create_map(*[x for m, ws in weights.items() for x in (F.lit(m), F.array(*[F.lit(float(w)) for w in ws]))])
    long = to_long(preds, [*KEYS, "model"]).filter(F.col("model").isin(list(weights)))
    weighted = F.element_at(F.try_element_at(maps, F.col("model")), F.col("horizon")) * F.col("pred")
    complete = F.lit(True)
    for m in weights:
        complete = complete & (F.count_if((F.col("model") == m) & F.col("pred").isNotNull()) == 1)
    return long.groupBy(*KEYS, "horizon").agg(F.when(complete & (F.count(F.lit(1)) == len(weights)), clip(F.sum(weighted))).alias("pred"))


def parse_weights(text: str, models: Sequence[str]) -> dict[str, list[float]]:
    """Weights written as one value or five per model, in model order or by name: `0.5,0.3,0.2` or `a=0.4;b=0.1,0.2,0.3,0.4,0.5`."""
    named = "=" in text
    items = [part.strip() for part in text.split(";" if named or ";" in text else ",") if part.strip()]
    pairs = [tuple(x.strip() for x in item.split("=", 1)) for item in items] if named else list(zip(models, items))
    if sorted(m for m, _ in pairs) != sorted(models):
        raise ValueError(f"weights must name each of {', '.join(models)} once")
    out = {m: [float(x) for x in values.split(",")] for m, values in pairs}
    if any(len(v) not in (1, HORIZONS) for v in out.values()):
        raise ValueError(f"a model takes one weight or {HORIZONS}")
    return {m: v * HORIZONS if len(v) == 1 else v for m, v in out.items()}


def apply_weights(aligned: DataFrame, fitted: DataFrame, models: Sequence[str], by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Blend with fitted weights (one row per group, e.g. horizon): (region_id, origin, horizon, pred)."""
    # Fitted weights without a segment are one row per horizon.
    side = F.broadcast(fitted) if list(by) == ["horizon"] else fitted
    joined = aligned.join(side.select(*by, *[f"w_{m}" for m in models]), list(by))
    return joined.select(*KEYS, "horizon", clip(sum((F.col(m) * F.col(f"w_{m}") for m in models), F.lit(0.0))).alias("pred"))


def horizon_blend(preds: DataFrame, base: str, other: str, specs: dict[str, Sequence[float]]) -> DataFrame:
    """base*(1-a) + other*a per horizon for every named set of alphas, clipped; alphas may leave [0, 1]."""
    long = to_long(preds, [*KEYS, "model"]).filter(F.col("model").isin(base, other)).groupBy(*KEYS, "horizon").agg(
        F.max(F.when(F.col("model") == base, F.col("pred"))).alias("_base"), F.max(F.when(F.col("model") == other, F.col("pred"))).alias("_other"))
    sets = F.explode(F.array(*[F.struct(F.lit(n).alias("spec"), F.array(*[F.lit(float(a)) for a in alphas]).alias("alphas")) for n, alphas in specs.items()]))
    rows = long.select("*", sets.alias("_s")).withColumn("_a", F.element_at("_s.alphas", F.col("horizon")))
    return rows.select(F.col("_s.spec").alias("spec"), *KEYS, "horizon", clip(F.col("_base") * (1 - F.col("_a")) + F.col("_other") * F.col("_a")).alias("pred"))


def affine_variants(preds: DataFrame, specs: dict[str, tuple[float, float]]) -> DataFrame:
    """scale*x + bias for every named pair, clipped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("spec"), F.lit(float(s)).alias("scale"), F.lit(float(b)).alias("bias")) for n, (s, b) in specs.items()]))
    rows = to_long(preds, [*KEYS, "model"]).select("*", pairs.alias("_s"))
    return rows.select("_s.spec", *KEYS, "model", "horizon", clip(F.col("pred") * F.col("_s.scale") + F.col("_s.bias")).alias("pred"))


def fit_affine(long: DataFrame, scales: tuple[float, float, float], biases: tuple[float, float, float], lambda_reg: float = 0.02, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Best clipped (scale, bias) per group: MAE + lambda*((scale-1)^2 + bias^2), with MAE before and after.

    `long` has pred and target; rows without either are left out. Scales and biases are (first, last, step).
    """
    usable = long.filter(F.col("pred").isNotNull() & F.col("target").isNotNull())
    rows = usable.select(*by, F.col("pred").cast("double").alias("pred"), F.col("target").cast("double").alias("target"))
    # The grid is a few hundred pairs; every task sums its rows' errors at each of them.
    grid = np.array(long.sparkSession.range(1).select(value_grid(scales, biases).alias("g")).first().g)
    schema = StructType([*rows.schema.fields[:len(by)], StructField("grid_idx", LongType()), *[StructField(n, DoubleType()) for n in ("scale", "bias", "_tuned", "_plain")], StructField("_n", LongType())])
    sums = rows.mapInArrow(lambda batches: _affine_sums(batches, list(by), grid), schema)
    totals = sums.groupBy(*by, "grid_idx", "scale", "bias").agg(
        (F.sum("_tuned") / F.sum("_n")).alias("tuned_mae"), (F.sum("_plain") / F.sum("_n")).alias("baseline_mae"))
    scored = totals.withColumn("objective", F.col("tuned_mae") + lambda_reg * ((F.col("scale") - 1) ** 2 + F.col("bias") ** 2))
    return _best(scored, by, ["scale", "bias", "baseline_mae", "tuned_mae"])


def _affine_sums(batches: Iterator[pa.RecordBatch], by: list[str], grid: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per batch, group and grid point: sums of the errors after and before, and the rows."""
    scale, bias = grid[:, 0], grid[:, 1]
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in by]
        _, firsts, owner = np.unique(np.stack([*codes, np.zeros(batch.num_rows, dtype=np.int32)]), axis=1, return_index=True, return_inverse=True)
        order = np.argsort(owner.ravel(), kind="stable")
        pred, target = (batch.column(c).to_numpy()[order] for c in ("pred", "target"))
        counts = np.bincount(owner.ravel())
        tuned, plain, end = np.zeros((len(firsts), len(grid))), np.add.reduceat(np.abs(pred - target), np.cumsum(counts) - counts), 0
        for g, n in enumerate(counts):
            for at in range(end, end + n, ROWS_AT_ONCE):
                rows = slice(at, min(end + n, at + ROWS_AT_ONCE))
                moved = pred[rows, None] * scale + bias
                # As in Spark, NaN is above every number.
                np.fmin(np.maximum(moved, LABEL_MIN, out=moved), LABEL_MAX, out=moved)
                tuned[g] += np.abs(moved - target[rows, None]).sum(axis=0)
            end += n
        at = pa.array(np.repeat(firsts, len(grid)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(at) for c in by] + [pa.array(np.tile(x, len(firsts))) for x in (np.arange(len(grid)), scale, bias)]
            + [pa.array(x) for x in (tuned.ravel(), np.repeat(plain, len(grid)), np.repeat(counts, len(grid)))],
            names=[*by, "grid_idx", "scale", "bias", "_tuned", "_plain", "_n"])


def origin_maes(long: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    """MAE per (segment, origin, model) from a long scored frame."""
    return long.groupBy(*segment, "origin", "model").agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"))


def inverse_mae_weights(maes: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    """1/MAE normalised per segment; a missing or non-positive MAE counts as 1."""
    raw = maes.withColumn("_raw", F.when(F.col("mae") > 0, 1.0 / F.nullif(F.col("mae"), F.lit(0.0))).otherwise(1.0))
    totals = raw.groupBy(*segment).agg(F.sum("_raw").alias("_total")) if segment else raw.agg(F.sum("_raw").alias("_total"))
    joined = raw.join(totals, list(segment)) if segment else raw.withColumn("_total", F.lit(totals.first()[0]))
    return joined.select(*maes.columns, (F.col("_raw") / F.col("_total")).alias("weight"))


def _proxy_rows(maes: DataFrame, models: Sequence[str], grid: Column, segment: Sequence[str]) -> DataFrame:
    wide = maes.groupBy(*segment, "origin").agg(*[F.max(F.when(F.col("model") == m, F.col("mae"))).alias(m) for m in models])
    weights = [f"w_{m}" for m in models]
    rows = _spread(wide, [*segment, "origin", *models], grid, weights)
    proxy = sum((F.col(m) * F.col(w) for m, w in zip(models, weights)), F.lit(0.0))
    return rows.withColumns({"proxy": proxy, "regret": proxy - F.least(*[F.col(m) for m in models])})


def _anchored(models: Sequence[str], anchor: dict[str, float]) -> Column:
    return sum(((F.col(f"w_{m}") - anchor[m]) ** 2 for m in models), F.lit(0.0))


def minimax_weights(maes: DataFrame, models: Sequence[str], anchor: dict[str, float], caps: dict[str, float] | None = None, step: float = 0.05, lambda_anchor: float = 0.02, segment: Sequence[str] = ()) -> DataFrame:
    """Weights with the lowest worst + .25*mean + .10*std(pop) of per-origin MAEs + anchor penalty."""
    grid, weights = weight_grid(len(models), step, [(caps or {}).get(m, 1.0) for m in models]), [f"w_{m}" for m in models]
    totals = _proxy_rows(maes, models, grid, segment).groupBy(*segment, "grid_idx", *weights).agg(
        F.max("proxy").alias("worst"), F.avg("proxy").alias("mean"), F.stddev_pop("proxy").alias("std"))
    objective = F.col("worst") + 0.25 * F.col("mean") + 0.10 * F.col("std") + lambda_anchor * _anchored(models, anchor)
    return _best(totals.withColumn("objective", objective), segment, [*weights, "worst", "mean", "std", "objective"])


def minimax_regret_weights(maes: DataFrame, models: Sequence[str], anchor: dict[str, float], caps: dict[str, float] | None = None, step: float = 0.05, lambda_anchor: float = 0.02, segment: Sequence[str] = ()) -> DataFrame:
    """Weights with the lowest max regret + .5*mean regret + .1*worst + anchor penalty."""
    grid, weights = weight_grid(len(models), step, [(caps or {}).get(m, 1.0) for m in models]), [f"w_{m}" for m in models]
    totals = _proxy_rows(maes, models, grid, segment).groupBy(*segment, "grid_idx", *weights).agg(
        F.max("regret").alias("max_regret"), F.avg("regret").alias("mean_regret"), F.max("proxy").alias("worst"))
    objective = F.col("max_regret") + 0.5 * F.col("mean_regret") + 0.1 * F.col("worst") + lambda_anchor * _anchored(models, anchor)
    return _best(totals.withColumn("objective", objective), segment, [*weights, "max_regret", "mean_regret", "worst", "objective"])


def risk_softmax_weights(scores: DataFrame, temperature: float, cap: float, segment: Sequence[str] = ("origin",), name: str = "model", score: str = "score", rounds: int = 20) -> DataFrame:
    """Softmax of -score/T per segment, then rounds of capping with the excess spread over the rest.

    A segment holds one entry per candidate model, so the arrays are short.
    """
    groups = scores.groupBy(*segment).agg(F.sort_array(F.collect_list(F.struct(name, score))).alias("_c")).withColumn(
        "_low", F.array_min(F.transform("_c", lambda x: x[score])))
    raw = groups.withColumn("_w", F.transform("_c", lambda x: F.exp((F.col("_low") - x[score]) / temperature)))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def share(values: Column) -> Column:
        return F.transform(values, lambda x: x / total(values))

    out = raw.withColumn("_w", share(F.col("_w")))
    limit = F.lit(float(cap))

    def capped(values: Column) -> Column:
        over, free = F.filter(values, lambda x: x > limit), F.filter(values, lambda x: x <= limit)
        rest = 1.0 - F.size(over) * limit
        moved = F.transform(values, lambda x: F.when(x > limit, limit).otherwise(x / F.nullif(total(free), F.lit(0.0)) * rest))
        return F.when((F.size(over) > 0) & (F.size(free) > 0), moved).otherwise(values)

    out = out.withColumn("_w", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("_w"), lambda w, _: capped(w)))
    zipped = out.withColumn("weight", share(F.col("_w"))).select(*segment, F.explode(F.arrays_zip("_c", "weight")).alias("_z"))
    return zipped.select(*segment, F.col(f"_z._c.{name}").alias(name), F.col("_z.weight").alias("weight"))


def origin_proxy(maes: DataFrame, weights: dict[str, float], segment: Sequence[str] = ()) -> DataFrame:
    """Weighted MAE per origin: the convex combination of component MAEs."""
    lookup = F.create_map(*[x for m, w in weights.items() for x in (F.lit(m), F.lit(float(w)))])
    rows = maes.filter(F.col("model").isin(list(weights)))
    return rows.groupBy(*segment, "origin").agg(F.sum(F.col("mae") * F.try_element_at(lookup, F.col("model"))).alias("proxy"))


def proxy_summary(proxy: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    return proxy.groupBy(*segment).agg(F.avg("proxy").alias("mean"), F.stddev_pop("proxy").alias("std"), F.max("proxy").alias("worst"))


def mean_abs_delta(left: DataFrame, right: DataFrame, keys: Sequence[str] = (*KEYS, "horizon")) -> DataFrame:
    """Mean and largest absolute difference of two long prediction frames, and the keys that only one of them has."""
    a = left.select(*keys, F.col("pred").alias("_l"), F.lit(True).alias("_in_l"))
    both = a.join(right.select(*keys, F.col("pred").alias("_r"), F.lit(True).alias("_in_r")), list(keys), "full")
    gap = F.abs(F.col("_l") - F.col("_r"))
    alone = F.col("_in_l").isNull() | F.col("_in_r").isNull()
    return both.agg(F.avg(gap).alias("mean_abs_delta"), F.max(gap).alias("max_abs_delta"), F.count_if(alone).alias("unmatched_keys"))
