import hashlib
import re
from collections import Counter, defaultdict

import pytest
from corpus_cases import rows
from pyspark.sql import functions as F

from isohyet.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def low(text):
    return text and re.sub("[A-Z]", lambda m: m[0].lower(), text)


def climb(nodes, fanout):
    """Root of a list of nodes and, for each, its siblings level by level as (before, after)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // fanout * fanout : a // fanout * fanout + fanout]
            steps[i].append(("".join(run[: a % fanout]), "".join(run[a % fanout + 1 :])))
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], steps


def plain(found, fanout, tampered):
    groups = defaultdict(list)
    for r in found:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in names}
    root, above = climb([trees[s][0] for s in names], fanout)
    out = Counter()
    for s, upper in zip(names, above, strict=True):
        for (_, _, leaf, r), steps in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            node = leaf_of(r, low(r["text"])) if tampered(r["doc_id"]) else leaf
            for before, after in steps + upper:
                node = digest(before + node + after)
            out[r["doc_id"], leaf, trees[s][0], root, digest("".join(a + b for a, b in steps + upper)), node, node == root] += 1
    return out


def manifest(df, fanout):
    text = F.when(F.col("doc_id") % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle.merkle_manifest(df, text, fanout=fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in got.collect())


def fifth(i):
    return i is not None and i % 5 == 0


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_ragged_sources(spark, fanout):
    """Sources of one to 150 leaves: at a fan-out of 2 a partition holds 8 leaves, groups and columns are uneven."""
    sizes = {None: 3, "a": 1, "B": 9, "b": 8, "é": 150, "z": 17, "zz": 65, "{": 2, "m": 1}
    texts = [(i * 7 % 1000, f"Text {i} of {s}", "en", s) for k, (s, n) in enumerate(sizes.items()) for i in range(k * 200, k * 200 + n)]
    df = rows(spark, texts)
    assert manifest(df, fanout) == plain(df.collect(), fanout, fifth)


def test_tricky(tricky, nothing, spark):
    found = tricky.collect()
    got = manifest(tricky, 16)
    assert got == plain(found, 16, fifth)
    bad = {k[0] for k in got if not k[-1]}
    assert bad == {10}
    assert manifest(nothing, 16) == Counter()
    many = rows(spark, [(4, "Same row", "en", "a")] * 70 + [(5, "Same row", "en", "a")] * 70)
    assert manifest(many, 2) == plain(many.collect(), 2, fifth)


def test_ranges_do_not_matter(spark, docs):
    once = manifest(docs, 2)
    assert once == manifest(docs.repartition(5), 2) and sum(not k[-1] for k in once) > 0
