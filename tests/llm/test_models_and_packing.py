import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_brute import words
from corpus_cases import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from isohyet.llm import language_id, mixing, packing, quality_gam
from isohyet.llm.queries import QUERIES, vocabulary


def plain_best_fit(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(free) if r >= x]
        if fit:
            free[min(fit, key=lambda i: free[i])] -= x
        else:
            free.append(capacity - x)
    return sorted(free)


@given(st.lists(st.integers(1, 20), max_size=80))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    counts = Counter(lengths)
    fill, seen = defaultdict(list), Counter()
    for length, rank, first, offset, per in packing.best_fit_decreasing(counts, 20):
        ends = [r[1] for r in packing.best_fit_decreasing(counts, 20) if r[0] == length and r[1] > rank]
        for k in range(min(ends, default=counts[length]) - rank):
            fill[first + k // per].append((offset + k % per * length, length))
            seen[length] += 1
    assert seen == counts
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 20
    assert sorted(20 - sum(x for _, x in p) for p in fill.values()) == plain_best_fit(lengths, 20)


def check_packing(df, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    got = df.collect()
    want = Counter()
    for i, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        assert [sum(x for _, x in sorted(pieces)[:k]) for k in range(len(pieces))] == [o for o, _ in sorted(pieces)] and sum(x for _, x in pieces) <= 2048
    assert len(sequences) == len(plain_best_fit([r["length"] for r in got], 2048))


def test_packing(docs, texts):
    check_packing(packing.pack(docs, vocabulary()), texts.items())


def test_packing_tricky(spark, tricky, nothing):
    check_packing(packing.pack(tricky, vocabulary()), [(r["doc_id"], r["text"]) for r in tricky.collect()])
    odd = ["a | b|c ||", "İstanbul ΟΔΟΣ ſ ﬁ", "x\x1cy\x1dz", "a\x85b\xa0c d　e", "é ́x", "<|endoftext|> <|startoftext|>x", "I'M we'LL", "１２ 12", "😀😀"]
    check_packing(packing.pack(rows(spark, [(i, t, "en", "a") for i, t in enumerate(odd)]), vocabulary()), list(enumerate(odd)))
    assert packing.pack(nothing, vocabulary()).count() == 0


def plain_targets(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    whole, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        share = {s: (whole - sum(fixed.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if share[s] > 2 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in above}


@pytest.mark.parametrize("which", ["docs", "tricky"])
def test_mix(which, request):
    df = request.getfixturevalue(which)
    sizes = Counter()
    for r in df.collect():
        sizes[r["source"]] += len(words(r["text"]))
    want = plain_targets(dict(sizes))
    got = mixing.mix(df).collect()
    assert len(got) == df.count() and all(0 <= r["copies"] <= 2 for r in got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: str((r["doc_id"], r["source"], r["size"], r["copies"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_tree_keeps_shares(spark):
    """Many chunks and levels: words end within one document of the target, and no size is preferred."""
    df = rows(spark, [(i, "w " * (1 + i % 37), "en", "s" if i % 3 else "t") for i in range(1500)])
    got = mixing.mix(df, fan_in=8).groupBy("source").agg({"target": "max", "copies": "sum"}).collect()
    assert len(got) == 2
    mixed = mixing.mix(df, fan_in=8).toPandas()
    for _, part in mixed.groupby("source"):
        assert abs((part["copies"] * part["size"]).sum() - part["target"].iloc[0]) <= 37
        small, large = part[part["size"] < 12], part[part["size"] > 25]
        assert abs(small["copies"].mean() - large["copies"].mean()) < 0.06


def test_take_mix(tricky, nothing):
    left = mixing.take_mix(tricky)
    assert left.columns == tricky.columns
    assert mixing.take_mix(nothing).count() == mixing.mix(nothing).count() == 0


def test_quality_gam(docs, spark, folder, tricky, nothing):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_gam.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    rank, good = got["score"].rank(), got["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98
    taught = labels.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert quality_gam.quality_scores(tricky, labels).count() == tricky.count()
    assert {round(r["score"], 6) for r in quality_gam.quality_scores(tricky, taught).collect()} == {0.5}
    assert quality_gam.quality_scores(nothing, labels).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit_gam(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_language(spark, docs, tricky, nothing):
    got = language_id.predict_languages(docs, docs.filter("doc_id % 3 <> 0")).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["doc_id"] % 3 == 0]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    by = {r["doc_id"]: r for r in language_id.predict_languages(tricky, docs).collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 6, 12)) and by[8]["lang_pred"] == "en"
    assert language_id.predict_languages(nothing, docs).count() == 0
    assert {r["lang_pred"] for r in language_id.predict_languages(tricky, nothing).collect()} == {"und"}


def test_pair_tables_are_exact():
    net = language_id.fit_net(["abc def ghi"] * 20 + ["xyz uvw rst"] * 20, ["a"] * 20 + ["b"] * 20)
    rows_ = language_id.windows_of("abc xyz def")
    want = []
    for f in net.filters:
        span = rows_.shape[1] - len(f) + 1
        want.append(sum(f[k][rows_[:, k : k + span]] for k in range(len(f))).max(axis=1))
    assert np.allclose(net.maxima(rows_), np.maximum(np.concatenate(want, axis=1) + net.bias, 0), atol=1e-5)


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 11)} <= {q[: q.index("_") + 1] for q in QUERIES} and "pipeline" in entry.queries()
