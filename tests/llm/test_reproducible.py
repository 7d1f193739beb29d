"""Fences do not depend on partitions; bounded fits keep their bound; windows come from whole texts."""

import numpy as np
import pytest

from isohyet.llm import language_id, quality_gam, quality_rules


def test_fences_are_equal_in_any_partitioning(docs):
    one = quality_rules.quality_rules(docs.coalesce(1)).toPandas()
    other = quality_rules.quality_rules(docs.repartition(13)).toPandas()
    key = lambda t: t.sort_values(list(t.columns)).reset_index(drop=True)
    assert key(one).equals(key(other))


@pytest.mark.parametrize("n", [3, 40, 2000])
def test_quartiles_are_right_to_one_percent(spark, n):
    values = np.random.default_rng(n).uniform(0.001, 0.9, n)
    names = list(quality_rules.SPREADS)
    rows = spark.createDataFrame([("x", "s", *[float(v)] * len(names)) for v in values], f"lang string, source string, {', '.join(f'{m} double' for m in names)}")
    got = quality_rules.fences(rows).first()
    low, high = (np.sort(values)[int(np.ceil(q * n)) - 1] for q in (0.25, 0.75))
    for m, least in quality_rules.SPREADS.items():
        want = high + quality_rules.REACH * max(high - low, least)
        assert abs(got[f"{m}_fence"] - want) < 0.08 * want


def test_symbols_that_are_no_letters_have_no_language(spark, docs):
    rows = spark.createDataFrame([(1, "²½① 123", None), (2, "été ici", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict_languages(rows, docs).collect()}
    assert got[1] == "und" and got[2] != "und"


def test_windows_teach_from_the_whole_text():
    text = "a" * 5000 + " " + "b" * 5000
    seen = [language_id.teaching_windows(text + "c" * k, 2) for k in range(60)]
    assert all(len(w) == 2 for w in seen)
    starts = {bytes(w[0][:1]) for pair in seen for w in [pair]} | {bytes(w[-1][:1]) for w in seen}
    assert {b"a", b"b"} <= starts
    middle = language_id.windows_of(text)[len(language_id.windows_of(text)) // 3]
    assert any((row == middle).all() for pair in seen for row in pair)


def test_a_language_with_most_rows_is_bounded(spark):
    rows = spark.createDataFrame([(i, f"abc def {i}" if i % 50 else f"xyz uvw {i}", "a" if i % 50 else "b") for i in range(3000)], "doc_id long, text string, lang string")
    got = language_id.predict_languages(rows, rows, fit_rows=100).join(rows, "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9


def test_a_bounded_fit_takes_the_smallest_hashes(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_gam.quality_scores(docs, labels, fit_rows=50).toPandas()
    again = quality_gam.quality_scores(docs.repartition(5), labels.repartition(3), fit_rows=50).toPandas()
    assert got.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()
    assert got.score.between(0, 1).all()
