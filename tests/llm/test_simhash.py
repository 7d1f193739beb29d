import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from corpus_brute import components, words
from corpus_cases import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from isohyet.llm import simhash


def plain_print(text):
    ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    size = min(3, len(ws))
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + size]).encode(), 42) for i in range(len(ws) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.lists(st.sampled_from(["a", "B", "b", "Ä", "ä", " ", "\n", "\x0b", "\x1c", "\x85", "ab", "İ"]), max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(parts):
    assert simhash.fingerprint("".join(parts).encode()) == plain_print("".join(parts))


def test_long_texts_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(2000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text.encode()) == plain_print(text)


def plain(found):
    prints = [plain_print(r["text"]) for r in found]
    names = sorted(set(prints))
    groups = components(names, [(a, b) for a, b in combinations(names, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for r, p in zip(found, prints, strict=True):
        if r["doc_id"] is not None:
            least[groups[p]] = min(least.get(groups[p], r["doc_id"]), r["doc_id"])
    return sorted((str(r["doc_id"]), f"{p:016x}", least.get(groups[p])) for r, p in zip(found, prints, strict=True))


@pytest.mark.parametrize("which", ["docs", "tricky"])
def test_equals_brute_force(which, request, nothing):
    df = request.getfixturevalue(which)
    got = simhash.simhash_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == plain(df.collect())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert simhash.simhash_duplicates(nothing).count() == 0


@pytest.mark.parametrize("spread, most, split", [(64, 2, 16), (64, 3, 4096), (20, 2, 16), (9, 1, 16)])
def test_all_links_are_found(spark, spread, most, split, monkeypatch):
    """Families around random centres; only `spread` bits vary, so that some values are hot and bits are correlated."""
    from isohyet.llm import probing

    monkeypatch.setattr(simhash, "probed", lambda p, i, name: probing.probed(p, i, name, split=split))
    rng = random.Random(spread)
    prints = {0, 2**64 - 1}
    for _ in range(60):
        centre = sum(1 << b for b in range(spread) if rng.random() < 0.3)
        for _ in range(12):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(spread), rng.randrange(4))))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.linked_fingerprints(fps, most).collect()}
    want = {(max(a, b), min(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= most}
    assert got == want and want


def test_units_are_shared_at_least_cost():
    rng = np.random.default_rng(2)
    costs = np.concatenate([np.zeros((50, 3, 1)), np.cumsum(rng.uniform(0, 5, (50, 3, 3)), axis=2)], axis=2)
    units, total = simhash.share_units(costs)
    for row, mine, cost in zip(costs, units, total, strict=True):
        options = [(a, b, 3 - a - b) for a in range(4) for b in range(4 - a)]
        best = min(sum(row[i, u] for i, u in enumerate(o)) for o in options)
        assert mine.sum() == 3 and cost == pytest.approx(best) and sum(row[i, u] for i, u in enumerate(mine)) == pytest.approx(best)


def test_correlated_bits_meet():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 41] = 1 - bits[:, 3]
    groups = simhash.bit_groups(bits.T @ bits, len(bits), 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({3, 40, 41} <= set(g) for g in groups)


def test_repeated_rows_and_ids(spark):
    df = rows(spark, [(5, "one two three four", "en", "a"), (5, "quite another text of words", "en", "a"), (9, "one two three four", "en", "a"), (9, "one two three four", "en", "a")])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in simhash.simhash_duplicates(df).collect())
    assert got == [(5, 5, True), (5, 5, True), (9, 5, False), (9, 5, False)]
