import random
from collections import Counter

import pytest
from corpus_brute import components as plain_components
from corpus_brute import near
from corpus_cases import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from isohyet.llm import near_dedup, shingles
from isohyet.llm.components import components
from isohyet.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from isohyet.llm.near_dedup import drop_near_duplicates, near_duplicates


def test_exact_tricky(tricky):
    got = exact_duplicates(tricky).collect()
    assert len(got) == tricky.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert (by[2]["keep_id"], by[2]["group_size"], by[2]["kept"]) == (1, 2, False)
    assert by[3]["keep_id"] == by[4]["keep_id"] == by[6]["keep_id"] == 3 and by[3]["group_size"] == 4
    assert by[5]["keep_id"] == 5 and by[7]["group_size"] == 2 and by[7]["kept"]
    alone = [r for r in got if r["doc_id"] is None]
    assert sorted((r["keep_id"] is None, r["kept"]) for r in alone) == [(False, False), (True, True)]


def test_exact_rows(tricky, nothing):
    left = drop_exact_duplicates(tricky)
    assert left.columns == tricky.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 3, 5, 7, 7, 8, 9, 10, 11, 12, 13]
    assert exact_duplicates(nothing).count() == drop_exact_duplicates(nothing).count() == 0


def test_near_tricky(tricky, nothing):
    got = near_duplicates(tricky, words=2).collect()
    assert len(got) == tricky.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and by[9]["component_id"] == 8 and not by[9]["kept"]
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (3, 4, 5, 6))
    assert by[7]["kept"] and all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    left = drop_near_duplicates(tricky, words=2)
    assert left.columns == tricky.columns and left.count() == tricky.count() - 2
    assert near_duplicates(nothing).count() == drop_near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_equals_brute(docs, texts, size):
    sets, groups = near(texts, size)
    got = near_duplicates(docs, words=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), groups[i]) for i in texts}


def family(seed, n, edits, size=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(size), edits):
            text[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_near_borderline_families_in_blocks(spark, monkeypatch):
    """Copies that meet the smallest id below the threshold but link among themselves are found by blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = dict(enumerate(family(1, 60, 3) + family(2, 40, 2) + [" ".join(["a", "b", "c"])] * 30))
    sets, groups = near(texts, 2)
    got = near_duplicates(rows(spark, [(i, t, "en", "a") for i, t in texts.items()]), words=2)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == groups
    assert len(set(groups.values())) > 3


def test_signature_estimates_similarity():
    rng = random.Random(3)
    a = [f"a{rng.randrange(10**9)}" for _ in range(900)]
    b = a[:600] + [f"b{rng.randrange(10**9)}" for _ in range(300)]
    x, y = (shingles.shingle_set(" ".join(t), 1) for t in (a, b))
    same = (shingles.signature(x, 1024) == shingles.signature(y, 1024)).mean()
    assert abs(same - 0.5) < 0.06 and shingles.shared(x, y) == 600


@given(st.lists(st.sampled_from(["a", "B", "b", "ä", " ", "\n", "\x0b", "\x1c", "ab"]), max_size=40), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_shingle_counts(parts, size):
    from corpus_brute import shingles as plain

    assert len(shingles.shingle_set("".join(parts), size)) == len(plain("".join(parts), size))


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    rng.shuffle(links)
    want = plain_components({x for p in links for x in p}, links)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {k for k, v in want.items() if Counter(want.values())[v] == 1}


def test_near_decides_by_id_and_text(spark):
    """An id with several texts: only its near copy goes, the unique text stays; of near copies under one id one stays."""
    base = [f"w{i}" for i in range(60)]
    copy, other = " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(30))
    base = " ".join(base)
    mixed = rows(spark, [(1, base, "en", "a"), (2, copy, "en", "a"), (2, other, "en", "a"), (2, other, "de", "b"), (None, base, "en", "a")])
    left = drop_near_duplicates(mixed)
    assert left.columns == mixed.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(0, base), (1, base), (2, other), (2, other)])
    assert drop_near_duplicates(rows(spark, [(4, base, "en", "a"), (4, copy, "en", "a")])).count() == 1
