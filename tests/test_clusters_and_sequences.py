"""Clusters are reproducible and nearest to their centres; sequences are aligned by day."""

import numpy as np
from pyspark.sql import functions as F

from isohyet.fixed import MEASURES
from isohyet.operators import clusters, samples


def small_panel(spark, levels):
    """One region per level, 14 days, every measure at the level."""
    rows = [(f"R{i}", day, float(level), 1.0 if day % 7 == 6 else None) for i, level in enumerate(levels) for day in range(14)]
    days = spark.createDataFrame(rows, "region_id string, day_idx int, level double, score double")
    return days.select("region_id", "day_idx", "score", *[F.col("level").alias(c) for c in MEASURES])


def test_clusters_separate_groups_whatever_the_partitioning(spark):
    panel = small_panel(spark, [0, 0.1, 50, 50.1, 100, 100.1])
    first = {r.region_id: r.region_cluster for r in clusters.region_clusters(panel, 3).collect()}
    again = {r.region_id: r.region_cluster for r in clusters.region_clusters(panel.repartition(7), 3).collect()}
    assert first == again
    assert len({first["R0"], first["R2"], first["R4"]}) == 3
    assert all(first[f"R{i}"] == first[f"R{i + 1}"] for i in (0, 2, 4))


def test_equal_regions_are_one_cluster_and_none_give_none(spark):
    panel = small_panel(spark, [3, 3, 3])
    assert {r.region_cluster for r in clusters.region_clusters(panel, 5).collect()} == {0}
    assert clusters.region_clusters(panel.limit(0), 5).count() == 0


def test_every_region_is_nearest_to_the_mean_of_its_cluster(panel):
    from isohyet.operators.priors import region_profile

    profile = region_profile(panel)
    rows = clusters.standardised(profile, [c for c in profile.columns if c != "region_id"])
    own = rows.join(clusters.region_clusters(panel, 5, rounds=60), "region_id").toPandas()
    z, at = np.array(own["z"].tolist()), own["region_cluster"].to_numpy()
    assert np.allclose(z.mean(0), 0, atol=1e-6)
    centres = np.stack([z[at == c].mean(0) for c in sorted(set(at))])
    away = ((z[:, None, :] - centres[None]) ** 2).sum(2)
    assert (away[np.arange(len(z)), at] <= away.min(1) + 1e-6).all()


def test_a_missing_day_is_null_and_shifts_nothing(spark):
    # 40 weeks; day 120 is missing, and the second region starts on day 35.
    rows = [(r, day, float(day), 1.0 if day % 7 == 6 else None) for r, lo in (("A", 0), ("B", 35)) for day in range(lo, 280) if day != 120]
    panel = spark.createDataFrame(rows, "region_id string, day_idx int, prec double, score double").withColumn("date", F.lit("2001-01-01"))
    out = samples.sequence_samples(panel, 0.0, columns=["prec"]).collect()
    assert any(r.region_id == "B" and r.day_idx < 35 + 90 for r in out)
    for r in out:
        low = 0 if r.region_id == "A" else 35
        days = range(r.day_idx - 90, r.day_idx + 1)
        want = [float(d) if d != 120 and d >= low else None for d in days]
        assert [x["prec"] if x is not None else None for x in r.sequence] == want, (r.region_id, r.day_idx)
