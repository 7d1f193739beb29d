"""Checks, distances and rankings of candidate prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.blocks import running_state
from isohyet.operators.blend import PREDS, to_long
from isohyet.session import materialize

# Range tolerance, distance thresholds and penalties of the rankings.
RANGE_SLACK = 1e-9
BAD_FROM = 0.90
NEAR_WITHIN = 0.05
PUBLIC_TOLERANCE = 0.0020
CLOSE_TOLERANCE = 0.0005
ANCHOR_DELTA_SCALE = 0.18
COMPLEXITY = [("calendar", 0.0030), ("affine", 0.0015), ("stack", 0.0008)]
UNKNOWN_METRIC = 999.0


def validate_predictions(preds: DataFrame, template: DataFrame) -> DataFrame:
    """One report row per model: rows, missing, extra and repeated keys, nulls, range, mean and mean deviation.

    Keys are counted once each: a repeated row cannot stand in for a missing key.
    """
    keys = template.select("region_id").distinct()
    size = keys.count()
    per_key = preds.groupBy("model", "region_id").agg(F.count(F.lit(1)).alias("_copies"))
    marked = per_key.join(keys.withColumn("_known", F.lit(True)), "region_id", "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    counted = marked.groupBy("model").agg(
        F.count_if(known).alias("_matched"), F.count_if(~known).alias("extra_keys"), F.sum(F.col("_copies") - 1).alias("duplicate_rows"))
    nulls = sum((F.col(c).isNull().cast("int") for c in PREDS), F.lit(0))
    report = preds.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("nulls"),
        F.least(*[F.min(c) for c in PREDS]).alias("pred_min"), F.greatest(*[F.max(c) for c in PREDS]).alias("pred_max"),
        (sum((F.avg(c) for c in PREDS), F.lit(0.0)) / len(PREDS)).alias("pred_mean"),
        (sum((F.stddev_samp(c) for c in PREDS), F.lit(0.0)) / len(PREDS)).alias("pred_std_mean"))
    missing = F.lit(size) - F.col("_matched")
    in_range = (F.col("pred_min") >= -RANGE_SLACK) & (F.col("pred_max") <= 5.0 + RANGE_SLACK)
    whole = (missing == 0) & (F.col("extra_keys") == 0) & (F.col("duplicate_rows") == 0) & (F.col("nulls") == 0)
    return report.join(counted, "model").select(
        "model", "rows", missing.alias("missing_keys"), "extra_keys", "duplicate_rows", "nulls", "pred_min", "pred_max", "pred_mean", "pred_std_mean",
        F.coalesce(whole & in_range, F.lit(False)).alias("is_valid"))


def candidates_x_references(preds: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """Rows (candidate, reference, keys, horizon, gap) for the listed model pairs.

    Every model's predictions meet on (key, horizon) as a short map; pairs are read from that map.
    """
    long = to_long(preds, [*keys, "model"])
    names = sorted({m for pair in pairs for m in pair})
    by_key = long.groupBy(*keys, "horizon").agg(*[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"_p{i}") for i, m in enumerate(names)])
    at = {m: F.col(f"_p{i}") for i, m in enumerate(names)}
    cells = F.array(*[F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("reference"), F.abs(at[a] - at[b]).alias("gap")) for a, b in pairs])
    return by_key.select(*keys, "horizon", F.explode(cells).alias("_x")).select("_x.candidate", "_x.reference", *keys, "horizon", "_x.gap").filter("gap is not null")


def prediction_distances(preds: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """Mean and largest distance per pair, per horizon and overall (horizon 0)."""
    rows = candidates_x_references(preds, pairs, keys)
    pair = [F.col("candidate"), F.col("reference")]
    return rows.groupingSets([[*pair, F.col("horizon")], pair], *pair, F.col("horizon")).agg(
        F.avg("gap").alias("mae_distance"), F.max("gap").alias("max_distance")).withColumn("horizon", F.coalesce("horizon", F.lit(0)))


def nearest_reference(distances: DataFrame, scores: DataFrame, bad_from: float = BAD_FROM, near: float = NEAR_WITHIN) -> DataFrame:
    """Nearest reference of each candidate, nearest bad one (score >= bad_from) and the risk flag."""
    overall = distances.filter("horizon = 0").join(scores.select(F.col("model").alias("reference"), "public_score"), "reference")
    bad = F.col("public_score") >= bad_from
    order = F.struct(F.round("mae_distance", 12), F.col("reference"))
    out = overall.groupBy("candidate").agg(
        F.min_by("reference", order).alias("nearest"), F.min("mae_distance").alias("nearest_distance"),
        F.min_by("reference", F.when(bad, order)).alias("nearest_bad"), F.min(F.when(bad, F.col("mae_distance"))).alias("nearest_bad_distance"),
        F.count_if(bad).alias("bad_compared"), F.count(F.lit(1)).alias("compared"))
    flag = F.when(F.col("nearest_bad_distance") < near, "near_bad_failure_family").otherwise("not_near_local_bad_failure_family")
    return out.withColumn("risk_flag", flag)


def global_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based rank over the whole table by all sort keys.

    Spark cuts the rows into ranges by a sample of the keys, so equal or missing leading values are told apart by
    the keys after them; the ranges are stored, and counts per range give the offsets.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_slot", F.spark_partition_id()), "ranges").withColumn("_all", F.lit(0))
    counts = placed.groupBy("_all", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    ends = running_state(counts, ["_all"], "_slot", sums=["_n"]).withColumnRenamed("_n", "_end")
    # One row per range, as many as shuffle partitions.
    starts = ends.join(counts, ["_all", "_slot"]).select("_slot", (F.col("_end") - F.col("_n")).alias("_start"))
    inner = Window.partitionBy("_slot").orderBy(*order)
    return placed.join(F.broadcast(starts), "_slot").withColumn(name, (F.col("_start") + F.row_number().over(inner)).cast("int")).drop("_slot", "_all", "_start")


def rank_candidates(candidates: DataFrame, metrics: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Rank by several metrics in order; a missing metric sorts last."""
    return global_position(candidates, [*[F.col(m).asc_nulls_last() for m in metrics], *[F.col(t).asc() for t in ties]], "rank")


def risk_adjusted_rank(maes: DataFrame, manifest: DataFrame, raw: str, approved: int = 3) -> DataFrame:
    """Risk score of each candidate from its per-origin MAEs against the raw model; the best are approved."""
    base = maes.filter(F.col("model") == raw).select("origin", F.col("mae").alias("_raw"))
    regret = F.col("mae") - F.col("_raw")
    per = maes.join(base, "origin").groupBy("model").agg(
        F.avg("mae").alias("loo_mean_mae"), F.stddev_pop("mae").alias("loo_std_mae"), F.max("mae").alias("loo_worst_mae"),
        F.avg(regret).alias("mean_regret"), F.max(regret).alias("worst_regret"), F.count_if(regret < 0).alias("wins"),
        F.count_if(F.abs(regret) <= 1e-12).alias("ties"), F.count(F.lit(1)).alias("origins"))
    extra = F.lit(0.0)
    for word, cost in reversed(COMPLEXITY):
        extra = F.when(F.col("model").contains(word), cost).otherwise(extra)
    # A tie with the raw model counts as a win here; a margin below 1e-12 can be both.
    good = F.col("wins") + F.col("ties")
    score = (
        F.col("loo_mean_mae") + 0.20 * F.col("loo_std_mae") + 0.05 * F.col("loo_worst_mae")
        + 0.50 * F.greatest(F.lit(0.0), F.col("worst_regret")) + 0.25 * F.greatest(F.lit(0.0), F.col("mean_regret"))
        + F.greatest(F.lit(0), 4 - good) * 0.0015 + extra)
    # Ranking reads its input several times; a candidate table is small, so it is stored first.
    scored = materialize(per.withColumn("risk_adjusted_score", score).join(manifest, "model"), "risk_scores")
    ranked = global_position(scored, [F.round("risk_adjusted_score", 12).asc_nulls_last(), F.col("old_rank").asc()], "risk_rank")
    status = F.when(F.col("risk_rank") <= approved, "approved_for_submission_order").otherwise(f"defer_after_top{approved}_risk_adjusted")
    return ranked.withColumn("status", status)


def guard_manifest(manifest: DataFrame, history: DataFrame) -> DataFrame:
    """Decision per candidate from its status and whether its file was already seen."""
    seen_files = history.groupBy("file_name").agg(F.max_by("public_score", "submitted_at").alias("live_public_score"), F.lit(True).alias("_seen"))
    rows = manifest.withColumn("file_name", F.regexp_extract("path", r"([^/]+)$", 1)).join(seen_files, "file_name", "left")
    seen = F.coalesce(F.col("_seen"), F.lit(False))
    status = F.coalesce(F.col("status"), F.lit(""))
    approved, deferred = status == "approved_for_submission_order", status.startswith("defer_")
    blocked = status.startswith("blocked_") | F.coalesce(F.col("slot_policy") == "do_not_submit", F.lit(False))
    decision = (
        F.when(approved & ~seen, "ready_for_next_quota").when(approved, "already_submitted_skip")
        .when(blocked & seen, "blocked_but_already_submitted_public_bad_skip_forever").when(blocked, "blocked_do_not_submit")
        .when(deferred, "deferred_do_not_submit_now").otherwise("manual_review"))
    return rows.withColumns({"live_seen": seen, "decision": decision}).drop("_seen")


def choose_slate(candidates: DataFrame, history: DataFrame, used_hashes: DataFrame, slots: int, today: str, blocked_names: str | None = None) -> DataFrame:
    """Fill the day's slots: the best reportable candidate, then public-only ones, then other reportables.

    Seen names, used hashes and names that match `blocked_names` drop out first; submissions already made today take slots.
    """
    used = history.filter(F.col("submitted_at").startswith(today)).count()
    remaining = max(0, slots - used)
    usable = candidates.filter(~F.col("file_name").rlike(blocked_names)) if blocked_names else candidates
    usable = usable.join(history.select("file_name").distinct(), "file_name", "left_anti")
    usable = usable.join(used_hashes.select("sha").distinct(), "sha", "left_anti")
    keyed = usable.withColumns({
        "_blind": F.coalesce(F.col("blind_mae"), F.lit(UNKNOWN_METRIC)), "_rolling": F.coalesce(F.col("rolling_mae"), F.lit(UNKNOWN_METRIC))})
    order = F.struct("_blind", "_rolling", "priority", "name")
    first = keyed.filter("reportable").agg(F.min_by("name", order)).first()[0]
    group = F.when(F.col("name") == F.lit(first), 0).when(~F.col("reportable"), 1).otherwise(2)
    chosen = keyed.withColumn("_group", group).orderBy("_group", "_blind", "_rolling", "priority", "name").limit(remaining)
    # At most `slots` rows are left to number.
    slot = Window.partitionBy(F.lit(0)).orderBy("_group", "_blind", "_rolling", "priority", "name")
    return chosen.withColumn("slot", F.row_number().over(slot)).drop("_group", "_blind", "_rolling")


def _known_delta() -> Column:
    """Distance to the anchor for tie-breaks; an absent or zero one counts as far away."""
    return F.coalesce(F.nullif(F.col("delta_to_anchor"), F.lit(0.0)), F.lit(9.0))


def score_gaps(submitted: DataFrame) -> DataFrame:
    """Gap to the best public score, tolerance flags and robust score."""
    scored = submitted.filter(F.col("public_mae").isNotNull())
    best = scored.agg(F.min("public_mae")).first()[0]
    gap = F.col("public_mae") - F.lit(best)
    return scored.withColumns({
        "public_gap": gap, "within_close": gap <= CLOSE_TOLERANCE + 1e-12, "within_tolerance": gap <= PUBLIC_TOLERANCE + 1e-12,
        "robust_score": 0.55 * (gap / PUBLIC_TOLERANCE) + 0.45 * (F.col("delta_to_anchor") / ANCHOR_DELTA_SCALE),
    })


def robust_score(submitted: DataFrame) -> DataFrame:
    """`score_gaps` with the public ranking and the robust one; without a robust score there is no robust rank."""
    out = global_position(score_gaps(submitted), [F.col("public_mae").asc(), _known_delta().asc(), F.col("path").asc()], "public_rank")
    out = global_position(out, [F.col("robust_score").asc_nulls_last(), F.col("path").asc()], "robust_rank")
    return out.withColumn("robust_rank", F.when(F.col("robust_score").isNotNull(), F.col("robust_rank")))


def select_pair(scored: DataFrame) -> DataFrame:
    """Public best, near-best hedge, alternate and fallback, each an argmin over its pool: one row."""
    delta = _known_delta()
    by_public, by_delta = F.struct(F.col("public_mae"), delta, F.col("path")), F.struct(delta, F.col("public_mae"), F.col("path"))
    best = scored.agg(F.min_by("path", by_public)).first()[0]
    newest = scored.agg(F.max("ledger")).first()[0]
    same_day = (F.col("ledger") == F.lit(newest)) & F.col("within_close")
    return scored.agg(
        F.lit(best).alias("public_best"),
        F.min_by("path", F.when(same_day, by_delta)).alias("near_best_hedge"),
        F.min_by("path", F.when(same_day & (F.col("path") != F.lit(best)), by_public)).alias("alternate"),
        F.min_by("path", F.when(F.col("within_tolerance"), by_delta)).alias("fallback"))
