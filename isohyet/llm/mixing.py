"""Mixing sources to target weights by pivotal dependent rounding.

Every document has a fractional number of copies. Rounding pairs two fractional documents and moves mass between
them at random until one becomes a whole number; the other meets the next. Documents of a source are paired in
order of size inside small chunks, and the one document that a chunk leaves fractional goes on to the next level of
a reduction tree. Nothing is gathered: the root of a source has one document a size class at most, and it compares
a fixed number of draws to come near the target in words, not only in copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import hinted, match, store, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents of one chunk, and residuals of one node of the tree.
FAN_IN = 256
#: Draws that the last node of a source compares.
DRAWS = 64
#: Sizes of one chunk differ by a thirtieth at most.
STEPS = 30

RESULT = "doc_id long, source string, size long, p double, copies long, bin int, part long"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Per source: source_size, target.

    Sources in code point order, null last, take the weights in turn and share `share` times all words. A target
    stops at `most` times its source's size; the excess is shared again by weight until none is above. Each round
    is one aggregate, so any number of sources will do. Sources without words have target 0.
    """
    spark = sizes.sparkSession
    totals = store(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    ordered = totals.orderBy(F.col("source").asc_nulls_last()).select("source").rdd.zipWithIndex()
    ranks = store(spark.createDataFrame(ordered.map(lambda r: (r[0][0], r[1])), "source string, place long"), "source_places")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = match(totals, ranks, ["source"]).select("source", "source_size", weight.alias("weight"))
    table = store(table.withColumn("cap", F.col("source_size") * F.lit(float(most))), "source_weights")

    whole = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        open_ = F.col("weight") * F.lit(level) < F.col("cap")
        row = table.agg(
            F.sum(F.when(open_, F.col("weight"))).alias("weight"), F.sum(F.when(~open_, F.col("cap"))).alias("cap"),
            F.sum((~open_).cast("int")).alias("n"),
        ).first()
        if not row["weight"] or row["n"] == capped:
            break
        capped, level = row["n"], (share * whole - (row["cap"] or 0.0)) / row["weight"]
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"))


def _chance(seed: int, level: int, doc: int | None, size: int, n: int) -> float:
    """A number in [0, 1) that depends on its arguments alone."""
    return (zlib.crc32(f"{seed}:{level}:{doc}:{size}:{n}".encode()) + 0.5) / 4294967296.0


def _round_chunk(chunk: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    """Pair the rows in order; all but the last one met get whole copies, that one keeps what is left as p."""
    chunk = chunk.sort_values(["bin", "size", "doc_id"], kind="stable", na_position="last").reset_index(drop=True)
    base, frac = np.floor(chunk["p"].to_numpy()), chunk["p"].to_numpy() % 1.0
    docs, sizes = chunk["doc_id"].tolist(), chunk["size"].tolist()
    copies: list[float | None] = base.tolist()
    carry, a = None, 0.0
    for i, b in enumerate(frac.tolist()):
        if b < 1e-12 or b > 1 - 1e-12:
            copies[i] += round(b)
            continue
        if carry is None:
            carry, a = i, b
            continue
        u = _chance(seed, level, docs[i] if docs[i] == docs[i] else None, sizes[i], i)
        total = a + b
        if total < 1:  # one of the two gets nothing, the other the sum
            if u * total < a:
                a = total
            else:
                carry, a = i, total
        else:  # one of the two is taken, the other keeps the rest
            if u * (2 - total) < 1 - b:
                copies[carry] += 1
                carry, a = i, total - 1
            else:
                copies[i] += 1
                a = total - 1
            a = 0.0 if a < 1e-12 else a
            if a == 0.0:
                carry = None
    p = np.full(len(chunk), np.nan)
    if carry is not None:
        if a > 1 - 1e-12:
            copies[carry] += 1
        else:
            p[carry], copies[carry] = base[carry] + a, None
    chunk["p"], chunk["copies"] = p, pd.array(copies, dtype="Int64")
    return chunk


def _round_root(chunk: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Round the residuals of a source: of DRAWS draws, each with its last fraction up or down, the nearest to the need."""
    need, best, least = float(chunk["need"].iloc[0]), None, np.inf
    for draw in range(DRAWS):
        got = _round_chunk(chunk, seed, -1 - draw)
        whole, left = got["copies"].astype("float64"), got["p"].notna()
        for ends in (np.floor, np.ceil):
            copies = whole.where(~left, ends(got["p"]))
            off = abs(float((copies * got["size"]).sum()) - need)
            if off < least - 1e-9:
                best, least = got.assign(copies=copies.astype("int64")), off
    return best.drop(columns="need").assign(p=np.nan)


def _one_argument(reduce: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Spark tells by the number of parameters whether a function also wants the group's key."""
    return lambda chunk: reduce(chunk)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per input row: doc_id, source, size (words), source_size, target, copies (0 to `most`).

    Null text has size 0 and null sources are one source. The draw depends on the rows and the seed alone, not on
    partitions, so reruns agree; rows that repeat an id are rows of their own. No rows give no rows.
    """
    sizes = store(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(text_col)).cast("long").alias("size")),
        "sizes",
    )
    targets = store(source_targets(sizes, weights, share, most), "targets")
    chance = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("p")
    bins = F.floor(F.log(F.col("size") + 1.0) * STEPS).cast("int").alias("bin")
    rates = targets.select("source", chance)
    groups = sizes.select("source", bins).groupBy("source", "bin").agg(F.count(F.lit(1)).alias("__n"))
    groups = match(groups, rates, ["source"]).withColumn("__parts", F.ceil(F.col("__n") / fan_in)).drop("__n")
    groups = store(groups, "groups")
    part = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("__parts")).alias("part")
    open_ = match(sizes.select("doc_id", "source", "size", bins), groups, ["source", "bin"])
    open_ = open_.select("doc_id", "source", "size", "p", F.lit(None).cast("long").alias("copies"), "bin", part)
    parts = groups.agg(F.max("__parts")).first()[0] or 1

    done, level = [], 0
    while parts:
        # A node of the tree: a chunk of one size class, then `fan_in` chunks of the level below.
        reduce = _one_argument(partial(_round_chunk, seed=seed, level=level))
        rounded = store(open_.groupBy("source", "bin", "part").applyInPandas(reduce, RESULT), f"rounded_{level}")
        done.append(rounded.filter("copies is not null"))
        open_ = rounded.filter("copies is null").withColumn("part", F.floor(F.col("part") / fan_in))
        parts, level = (0 if parts <= 1 else -(-parts // fan_in)), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # The root of a source has one document a size class at most; it makes up for what the levels below were off.
    taken = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("__taken"))
    need = match(targets.select("source", "target"), taken, ["source"], "left")
    need = need.select("source", (F.col("target") - F.coalesce("__taken", F.lit(0))).alias("need"))
    root = match(open_, need, ["source"]).groupBy("source").applyInPandas(_one_argument(partial(_round_root, seed=seed)), RESULT)
    out = out.unionByName(store(root, "root")).select("doc_id", "source", "size", "copies")
    return match(out, targets, ["source"])


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it.

    Rows that repeat an id, source and size share the rounded mean of their copies.
    """
    keys = ["__id", "__source", "__size"]
    drawn = mix(docs, id_col, text_col, source_col, seed).select(*[F.col(c).alias(k) for c, k in zip(["doc_id", "source", "size"], keys, strict=True)], "copies")
    drawn = drawn.groupBy(*keys).agg(F.round(F.avg("copies")).cast("int").alias("__copies")).filter("__copies > 0")
    drawn = hinted(store(drawn, "drawn"), 64)
    rows = docs.withColumns({"__id": F.col(id_col).cast("long"), "__source": F.col(source_col).cast("string"), "__size": F.size(words(text_col)).cast("long")})
    rows = match(rows, drawn, keys)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[f"`{c}`" for c in docs.columns])
