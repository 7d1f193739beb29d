import corpus_brute as brute
from corpus_cases import SMALL

import corpus_pipeline
from isohyet.llm.common import store


def test_stages_against_brute_force(spark, docs, texts):
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    kept = store(stages["quality rules"](spark, docs, SMALL), "t1")
    ids = {r["doc_id"] for r in kept.collect()}
    base = {i for i, t in texts.items() if (q := brute.quality(t))[0] >= 20 and 100 * q[4] <= 30 * q[0]}
    assert ids <= base and kept.columns == columns

    exact = store(stages["exact dedup"](spark, kept, SMALL), "t2")
    first = {}
    for i in sorted(ids):
        first.setdefault(brute.BLANK.sub(" ", texts[i]), i)
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(first.values()) and exact.columns == columns

    near = store(stages["minhash near dedup"](spark, exact, SMALL), "t3")
    _, groups = brute.near({i: texts[i] for i in first.values()}, 5)
    left = sorted(i for i, c in groups.items() if i == c)
    assert sorted(r["doc_id"] for r in near.collect()) == left and near.columns == columns

    mixed = store(stages["mixing sources"](spark, near, SMALL), "t4")
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(counts) <= set(left) and set(counts.values()) <= {1, 2} and mixed.columns == columns
    words = {i: len(brute.words(texts[i])) for i in left}
    assert abs(sum(n * words[i] for i, n in counts.items()) / (1.5 * sum(words.values())) - 1) < 0.1

    packed = store(stages["best-fit packing"](spark, mixed, SMALL), "t5")
    firsts = packed.filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in firsts} == counts


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count()
