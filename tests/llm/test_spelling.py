import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from corpus_cases import rows

from isohyet.llm import spelling


def plain_counts(texts, drop_one_in=None):
    out = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            code = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if drop_one_in and code % drop_one_in == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, least=5):
    n = {w: k for w, k in counts.items() if k >= least}
    links = defaultdict(list)
    for a, b in combinations(n, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    form = {}
    for w in n:
        best = min(links[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(links[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def variants(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.spelling_variants(df).collect()}


def edited(rng, word):
    letters, at = "abcdeéß", rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed, monkeypatch):
    """Few letters: equal grams in a word, ties of counts, chains of forms, and keys hot enough to be cut."""
    monkeypatch.setattr(spelling, "probed", lambda p, i, name: __import__("isohyet.llm.probing", fromlist=["probed"]).probed(p, i, name, split=8))
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(6, 10))) for _ in range(120)}
    for _ in range(300):
        words.add(edited(rng, rng.choice(sorted(words))))
    words |= {"a" * k for k in (6, 7, 8, 9)} | {"ab" * k for k in (3, 4)} | {"aaaaaab", "baaaaaa"}
    counts = {w: rng.choice([4, 5, 6, 25, 30, 125, 200, 700, 5000]) for w in words if len(w) >= 6}
    got = variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    want = plain(counts)
    assert got == want and any(v[2] for v in want.values())


def test_pivots_share_no_character():
    rng = random.Random(4)
    for _ in range(300):
        grams = [(i, rng.randrange(9), rng.randrange(5)) for i in sorted(rng.sample(range(12), rng.randrange(3, 7)))]
        pairs = [p for p in combinations(grams, 2) if p[1][0] - p[0][0] >= 2]
        got = spelling.choose_pivots(grams)
        assert tuple(got) in pairs and sum(g[2] for g in got) == min(sum(g[2] for g in p) for p in pairs)


def test_counts(spark, tricky, nothing):
    texts = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    for drop in (None, 3, 199):
        got = {r["word"]: r["n"] for r in spelling.word_counts(tricky, drop_one_in=drop).collect()}
        assert got == plain_counts(texts, drop)
    assert spelling.word_counts(nothing).count() == spelling.spelling_variants(spelling.word_counts(nothing)).count() == 0


def test_counts_flush(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 2)
    df = rows(spark, [(i, "Strasse STRASSE straße Ünïcode ünïcode letters letters letterS ×abcdef÷", "de", "a") for i in range(5)])
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == plain_counts([(r["doc_id"], r["text"]) for r in df.collect()])


def test_documents(docs, texts):
    got = variants(spelling.word_counts(docs, drop_one_in=199))
    assert got == plain(plain_counts(texts.items(), 199))
