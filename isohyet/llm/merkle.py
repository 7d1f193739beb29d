"""Merkle manifest of a dataset by butterfly exchange.

Rows are leaves, ordered by id within their source. A partition is an aligned block of fanout^3 leaves and owns one
subtree. In each round the partitions that stand at the same place in up to `fanout` neighbouring groups swap the
roots of their groups, and each of them hashes the ancestor for itself; so after the rounds every partition knows
all proofs above its subtree and the root, and nothing is handed down. Sources are joined by the same rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import hinted, match, store

FANOUT = 16
#: Levels of the tree inside one partition.
INNER = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SPAN_BYTES = 96


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of each field as `-` if null, else UTF-8 byte count, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in fields.values())]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, keys: list[str], group: str, name: str) -> DataFrame:
    """Rows with `position` in their `group` (from 0) in the order of `keys`, nulls first, and the group's `total`.

    `group` is the first of `keys`. Spark cuts the order into ranges by a sample and each task numbers its own; a table of
    one row per range and group carries the offsets. A hot group is many ranges; rows that repeat are told apart by the
    number of their row, so that ranges can cut them too.
    """
    rows = store(rows.withColumn("__row", F.monotonically_increasing_id()), f"{name}_rows")
    order = [*keys, "__row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__row")
    ranged = store(ranged.withColumn("__at", F.monotonically_increasing_id()), f"{name}_sorted").withColumn("__range", F.shiftright("__at", 33))
    spans = store(ranged.groupBy("__range", group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")), f"{name}_spans")
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    # A group has at most one span in each range.
    spans = spans.select(
        "__range", group, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("total"))
    spans = hinted(store(spans, f"{name}_offsets"), SPAN_BYTES)
    return match(ranged, spans, ["__range", group]).withColumn("position", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(leaves: list[str], total: int, fanout: int) -> list[list[str]]:
    """Levels of a partition's subtree, leaves first; a source that fits into one partition ends at a single node."""
    levels, left = [leaves], total
    while left > 1 and len(levels) <= INNER:
        last = levels[-1]
        levels.append([_hash("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
        left = -(-left // fanout)
    return levels


def subtree_roots(leaves: DataFrame, fanout: int) -> DataFrame:
    """One row per partition (tree, block): its subtree's root and how many partitions its tree has."""

    def root(block: pd.DataFrame) -> pd.DataFrame:
        total = int(block["total"].iloc[0])
        top = _tree(list(block.sort_values("position")["leaf"]), total, fanout)[-1][0]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "block": [block["block"].iloc[0]], "width": [-(-total // fanout**INNER)], "digest": [top]})

    return leaves.select("tree", "block", "position", "total", "leaf").groupBy("tree", "block").applyInPandas(root, "tree long, block long, width long, digest string")


def swap_roots(state: DataFrame, run: list[Column], member: Column, index: Column, size: Column, columns: Column, alone: Column | None = None) -> DataFrame:
    """One round: partitions of one column of a run swap the digests of their groups and hash the ancestor.

    `run` names the groups that become one node, `member` the group's number in it. A group has `size` partitions, this
    one is number `index`, and the run's widest group has `columns` of them. A narrower group lets its partitions answer
    for the columns it lacks, in turn. Messages number at most fanout times the run's partitions, and a column meets
    at most `fanout` of them. Where `alone` holds, the tree already has its root and nothing is hashed.
    """
    names = [f"__k{i}" for i in range(len(run))]
    own = F.struct("tree", "block", *[c for c in state.columns if c not in ("tree", "block", "digest")])
    sent = state.select(
        *[k.alias(n) for k, n in zip(run, names, strict=True)], member.alias("__member"), index.alias("__index"), F.col("digest"), own.alias("__own"),
        (alone if alone is not None else F.lit(False)).alias("__alone"), F.explode(F.sequence(index, columns - 1, size)).alias("__column"))
    reads = F.when(F.col("__column") == F.col("__index"), F.col("__own"))
    met = sent.groupBy(*names, "__column").agg(
        F.array_sort(F.collect_list(F.struct(F.col("__member").alias("member"), "digest", reads.alias("own")))).alias("__all"), F.max("__alone").alias("__alone"))
    text = lambda part: F.array_join(F.transform(part, lambda m: m["digest"]), "")
    met = met.withColumn("__up", F.when(F.col("__alone"), F.get("__all", F.lit(0))["digest"]).otherwise(F.sha2(text(F.col("__all")), 256)))
    met = met.select("__all", "__alone", "__up", F.explode("__all").alias("__me")).filter("__me.own is not null")
    side = lambda keep: text(F.filter("__all", keep))
    step = F.struct(
        side(lambda m: m["member"] < F.col("__me.member")).alias("before"), side(lambda m: m["member"] > F.col("__me.member")).alias("after"))
    out = met.select("__me.own.*", F.col("__up").alias("digest"), F.col("__alone"), step.alias("__step"))
    return out.withColumn("proof", F.when(F.col("__alone"), F.col("proof")).otherwise(F.concat("proof", F.array("__step")))).drop("__alone", "__step")


def rounds(width: int, fanout: int) -> int:
    """Levels over `width` nodes."""
    n = 0
    while width > 1:
        width, n = -(-width // fanout), n + 1
    return n


def _forest(widths: DataFrame, levels: int, fanout: int) -> DataFrame:
    """Per tree and level of the tree over sources: the group's size, this tree's place in it, and the run's columns.

    It depends on counts of partitions alone. Each level is a window over the at most `fanout` groups of a run.
    """
    out = widths.select("tree", F.lit(0).cast("long").alias("__place"), F.array().cast("array<struct<place:bigint,size:bigint,columns:bigint>>").alias("forest"))
    groups = widths.select(F.col("tree").alias("__group"), F.col("width").alias("__size"))
    for level in range(levels):
        run = Window.partitionBy(F.floor(F.col("__group") / fanout))
        before = run.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
        shape = groups.select(
            "__group", "__size", F.max("__size").over(run).alias("__columns"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
        out = out.withColumn("__group", F.floor(F.col("tree") / fanout**level)).join(shape, "__group")
        here = F.struct(F.col("__place").alias("place"), F.col("__size").alias("size"), F.col("__columns").alias("columns"))
        out = out.select("tree", (F.col("__place") + F.col("__before")).alias("__place"), F.concat("forest", F.array(here)).alias("forest"))
        groups = groups.groupBy(F.floor(F.col("__group") / fanout).alias("__group")).agg(F.sum("__size").alias("__size"))
    return out.drop("__place")


def upper_proofs(roots: DataFrame, fanout: int) -> DataFrame:
    """Per partition (tree, block): subroot, root and the proof above its subtree, an array of (before, after)."""
    shape = roots.filter("block = 0").select("tree", "width")
    most = shape.agg(F.max("width").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if not most["n"]:
        return roots.select("tree", "block", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("proof"))
    state = roots.withColumn("proof", F.array().cast("array<struct<before:string,after:string>>"))
    for level in range(rounds(most["w"], fanout)):
        stride = fanout**level
        group = F.floor(F.col("block") / stride)
        nodes = F.ceil(F.col("width") / stride)
        last = (group == nodes - 1) & (F.pmod(group, F.lit(fanout)) != 0)
        size = F.when(group == nodes - 1, F.col("width") - group * stride).otherwise(F.lit(stride))
        columns = F.when(last | (group != nodes - 1), F.lit(stride)).otherwise(size)
        run = [F.col("tree"), F.floor(group / fanout)]
        state = swap_roots(state, run, F.pmod(group, F.lit(fanout)), F.pmod(F.col("block"), F.lit(stride)), size, columns, nodes == 1)
    state = store(state.withColumn("subroot", F.col("digest")), "merkle_sources")
    levels = rounds(most["n"], fanout)
    state = state.join(_forest(shape, levels, fanout), "tree")
    for level in range(levels):
        here = F.get("forest", F.lit(level))
        group = F.floor(F.col("tree") / fanout**level)
        state = swap_roots(state, [F.floor(group / fanout)], F.pmod(group, F.lit(fanout)), here["place"] + F.col("block"), here["size"], here["columns"])
    return store(state.select("tree", "block", "subroot", F.col("digest").alias("root"), "proof"), "merkle_proofs")


def _fold(fanout: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def fold(leaves: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("position")
        top = upper.iloc[0]
        levels = _tree(list(leaves["leaf"]), int(leaves["total"].iloc[0]), fanout)
        joined = [["".join(level[i : i + fanout]) for i in range(0, len(level), fanout)] for level in levels[:-1]]
        above = [(s["before"], s["after"]) for s in top["proof"]]
        above_text = "".join(a + b for a, b in above)
        proofs, folded = [], []
        for i, (leaf, other) in enumerate(zip(leaves["leaf"], leaves["tampered"], strict=True)):
            node, sides, at = other if other is not None else leaf, [], i
            for runs in joined:
                run, place = runs[at // fanout], at % fanout * 64
                before, after = run[:place], run[place + 64 :]
                sides += [before, after]
                node, at = _hash(before + node + after), at // fanout
            for before, after in above:
                node = _hash(before + node + after)
            proofs.append(_hash("".join(sides) + above_text))
            folded.append(node)
        return pd.DataFrame({
            "doc_id": leaves["doc_id"].astype("Int64"), "leaf": leaves["leaf"], "subroot": top["subroot"], "root": top["root"],
            "proof_sha256": proofs, "folded_root": folded})

    return fold


def merkle_manifest(docs: DataFrame, tampered_text: Column, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `docs` has the columns of FIELDS. `tampered_text` gives the text as it is to be verified, an expression over `docs`;
    leaf, subroot, root and proof are of the untouched row, folded_root is recomputed from the tampered leaf and the
    original siblings.

    A null field counts as `-`, an empty text as `0:`; null ids come first in their source, rows without source are a source of
    their own. Rows that repeat are leaves of their own, ties stand in the order of their digests. Long texts are
    hashed whole where they lie; only digests move. Columns outside FIELDS are ignored. No rows give no rows.
    """
    fields = {c: F.col(c) for c in FIELDS}
    leaf, other = leaf_digest(fields), leaf_digest(fields | {"text": tampered_text})
    changed = ~tampered_text.eqNullSafe(F.col("text"))
    rows = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), F.when(changed, other).alias("tampered"))
    rows = numbered(rows, ["source", "doc_id", "leaf"], "source", "merkle")
    sources = store(rows.filter("position = 0").select("source"), "merkle_names").withColumn("__all", F.lit(0))
    sources = numbered(sources, ["__all", "source"], "__all", "merkle_names").select("source", F.col("position").alias("tree"))
    rows = match(rows, hinted(store(sources, "merkle_trees"), SPAN_BYTES), ["source"])
    rows = rows.select("tree", F.floor(F.col("position") / fanout**INNER).alias("block"), "position", "total", "doc_id", "leaf", "tampered")
    upper = upper_proofs(store(subtree_roots(rows, fanout), "merkle_roots"), fanout)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    folded = rows.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInPandas(_fold(fanout), schema)
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
