"""Near duplicates by circulant MinHash, banding and exact verification.

Two permutations give the whole signature: the first scatters a shingle over a table, the second is that table,
and its cyclic shifts are the coordinates. Documents that agree in a band are candidates; a link needs the
Jaccard similarity of the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm import shingles as S
from isohyet.llm.common import body, hinted, match, short_batches, store
from isohyet.llm.components import components
from isohyet.llm.merkle import numbered

ROWS = 5
#: A pair of similarity 0.8 shares no band of 5 coordinates with probability (1 - 0.8^5)^40 = 1.3e-7.
BANDS = 40
BLOCK = 256


def _profiles(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set key (k1, k2) and band keys of each row (doc_id, text)."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, found = [], [], []
            for text in batch.column(1).to_pylist():
                one = S.shingle_set(text, words)
                sizes.append(len(one))
                keys.append(S.set_key(one) if len(one) else (0, 0))
                found.append(S.band_keys(S.signature(one, rows * bands), rows).view(np.int64) if len(one) else None)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.mapInArrow(profile, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id and full set of rows (rep, k1, k2, text) whose text has that set key."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            for rep, k1, k2, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                one = S.shingle_set(text, words)
                if len(one) and S.set_key(one) == (k1, k2):
                    ids.append(rep)
                    sets.append(one.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "members"])

    return docs.select("rep", "k1", "k2", "text").mapInArrow(full, "id long, members array<long>")


def _block_links(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between rows of different label; of two blocks, only those between the blocks."""
    sets = [np.asarray(m) for m in block["members"]]
    sizes = np.array([len(m) for m in sets])
    labels, ids, part = block["label"].to_numpy(), block["id"].to_numpy(), block["part"].to_numpy()
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    place = np.cumsum(common) - 1
    keep = common[token]
    owner, token = owner[keep], place[token[keep]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(common.sum()), 4096):
        lo, hi = np.searchsorted(token, [at, at + 4096])
        has = np.zeros((len(sets), 4096), dtype=np.float32)
        has[owner[lo:hi], token[lo:hi] - at] = 1
        both += has @ has.T
    # Counts stay below 2^24, so sums of ones in single precision are exact up to sets of 16 million shingles.
    joint = both.astype(np.int64)
    linked = 100 * joint >= percent * (sizes[:, None] + sizes[None, :] - joint)
    linked &= labels[:, None] != labels[None, :]
    if len(set(part)) > 1:
        linked &= part[:, None] != part[None, :]
    x, y = np.nonzero(np.triu(linked, 1))
    return pd.DataFrame({"a": ids[x], "b": ids[y]})


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A text's set is its distinct shingles of `words` words, A-Z as a-z; fewer words are one shingle; empty and null
    texts have an empty set and are linked with nothing. Sets link at `percent` of their union or more.

    Rows of equal sets are one class, and its smallest id stands for it. Candidates of a band meet its smallest
    id first: a star, never all pairs. Where a star then holds several components, its members are compared in
    blocks of about BLOCK rows, each pair of blocks a task of its own that returns links only; this finds the links
    that do not touch the smallest id. No partner is left out.

    Ids are taken as documents: a null id is linked with nothing and kept, rows that repeat id and text are decided
    alike, and an id with several texts has a row and a component for each. No rows give no rows.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = store(_profiles(docs, words, rows, bands), "profiles")
    live = base.filter("n_shingles > 0 and doc_id is not null")
    classes = store(live.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    heads = live.withColumn("rep", F.col("doc_id")).join(classes, ["rep", "k1", "k2"]).select("rep", F.explode("bands").alias("key"))
    shared = store(heads.groupBy("key").agg(F.min("rep").alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "c"), "bands")
    stars = store(heads.join(shared, "key").filter("rep <> c").select("c", F.col("rep").alias("id")).distinct(), "stars")

    met = stars.select(F.col("id").alias("rep")).union(stars.select("c")).distinct()
    met = store(classes.join(met, "rep"), "met")
    # Few documents are candidates: while their ids are few, whole texts need no shuffle.
    sets = store(_sets(docs.withColumnRenamed("doc_id", "rep").join(hinted(met, 24), "rep"), words), "sets")
    pairs = stars.join(sets, "id").withColumnRenamed("members", "mine")
    pairs = pairs.join(sets.select(F.col("id").alias("c"), F.col("members").alias("other")), "c")
    joint = F.size(F.array_intersect("mine", "other"))
    linked = joint * F.lit(100) >= F.lit(percent) * (F.size("mine") + F.size("other") - joint)
    first = store(pairs.filter(linked).select(F.col("id").alias("a"), F.col("c").alias("b")), "star_links")
    labels = store(components(first), "labels")

    # Stars that still hold several components.
    every = stars.union(stars.select("c", F.col("c").alias("id")).distinct())
    label = F.coalesce("component", "id")
    every = store(every.join(labels, "id", "left").select("c", "id", label.alias("label")), "star_labels")
    open_ = every.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    open_ = store(open_.filter("lo <> hi and n > 2").select("c", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "open_stars")
    part = F.pmod(F.xxhash64("id", "c"), F.col("parts")).cast("int")
    blocks = every.join(open_, "c").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("c", "id", "label", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    compare = blocks.join(sets, "id").groupBy("c", "i", "j")
    more = store(compare.applyInPandas(lambda block: _block_links(block, percent), "a long, b long"), "block_links")

    known = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    final = store(components(known.unionByName(more)), "components")
    classes = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    classes = store(classes.select("k1", "k2", F.coalesce("component", "rep").alias("component_id")), "class_components")
    alone = base.filter("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    out = live.join(classes, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, of which each group's smallest id stays.

    Where some id stands for several rows, each pair of id and text is numbered, by id and then by digest, and the numbers
    are compared instead: a text goes only if it is a near copy itself, and of near copies under one id one stays. Rows that
    repeat id and text are decided alike; rows without id stay.
    """
    id_ = F.col(id_col).cast("long")
    many = docs.select(id_.alias("__id")).filter("__id is not null").groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    if not many.limit(1).count():
        return _without(docs, id_, near_duplicates(docs, id_col, text_col, words, percent))
    keys = ["__id", "__digest"]
    marked = docs.withColumns({"__id": id_, "__digest": F.sha2(body(text_col), 256)})
    pairs = marked.filter("__id is not null").select(*keys).distinct().withColumn("__all", F.lit(0))
    pairs = numbered(pairs, ["__all", *keys], "__all", "near_ids").select(*keys, F.col("position").alias("__place"))
    marked = match(marked, store(pairs, "near_places"), keys, "left")
    return _without(marked, F.col("__place"), near_duplicates(marked, "__place", text_col, words, percent)).drop(*keys, "__place")


def _without(docs: DataFrame, key: Column, decided: DataFrame) -> DataFrame:
    gone = decided.filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(hinted(store(gone, "near_gone"), 8), key == F.col("__gone"), "left_anti")
