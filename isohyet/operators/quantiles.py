"""Exact quantiles and cumulative counts of many columns without gathering a column in one task.

Tasks collapse their values to (group, value, sides, count), which is shuffled once into sorted ranges.  Running counts
then use ranges of values: running sums carried along a sorted range, and offsets over the few ranges.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from isohyet.session import materialize, written
from isohyet.functions.numeric import clean_numeric, finite_or_null



def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., feature, value) without missing values."""
    long = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), list(columns), "feature", "value")
    return long.withColumn("value", finite_or_null(F.col("value"))).filter(F.col("value").isNotNull())


#: Rows that a task gathers before it counts them by value.
COUNTED_ROWS = 200_000
#: Runs of equal counts and running counts that grow by little take almost no room in files of this kind.
SORTED_FILES = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def value_table(df: DataFrame, columns: Sequence[str], keep: Sequence[str], sides: dict[str, Column]) -> DataFrame:
    """One row per (keep..., feature, value): rows of each side with it (`n`), up to it (`c_n`) and in all (`t_n`).

    A feature is one of `columns`, without its missing values; a side is a condition. Tasks count their rows by value and
    set of sides, so a frequent value leaves a task as few narrow rows. These are shuffled once, sorted, into ranges of
    (group, value) that Spark cuts by a sample, so an outlier cannot put the rest of its group in one task; they are stored
    before, as the sample would otherwise compute every row once more. A task adds
    counts of equal values and carries running counts along its range, which is stored; offsets of ranges come from a
    stored table of one row per group and range, which joins without another shuffle while it is small.
    """
    keep, names, value = list(keep), list(sides), "value"
    groups = [*keep, "feature"]
    member = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(sides.values())), F.lit(0)).cast("long")
    # Numbered, as a column may be kept and counted.
    inputs = [f"_v{i}" for i in range(len(columns))]
    rows = df.select(*keep, member.alias("_sides"), *[F.col(c).cast("double").alias(v) for c, v in zip(columns, inputs, strict=True)])
    fields = [*rows.schema.fields[:len(keep)], StructField("feature", StringType()), StructField(value, DoubleType()), StructField("_sides", LongType()), StructField("_n", LongType())]
    features = dict(zip(inputs, columns, strict=True))
    counted = written(rows.mapInArrow(lambda batches: _counted(batches, keep, features), StructType(fields)), "value_counts", **SORTED_FILES)
    ranged = counted.repartitionByRange(*groups, value).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*groups, value)
    schema = StructType([*[ranged.schema[c] for c in (*groups, "_range", value)], *[StructField(n, LongType()) for n in (*names, *[f"c_{n}" for n in names])]])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _carried(_merged(batches, [*groups, "_range", value], names), groups, names)

    placed = materialize(ranged.mapInArrow(along, schema), "value_ranges", **SORTED_FILES)
    totals = placed.groupBy(*groups, "_range").agg(*[F.sum(n).alias(n) for n in names])
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select(
        *groups, "_range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b_{n}") for n in names], *[F.sum(n).over(whole).alias(f"t_{n}") for n in names],
    ), "value_offsets")
    return placed.join(offsets, [*groups, "_range"]).select(
        *groups, value, *names, *[f"t_{n}" for n in names], *[(F.col(f"_b_{n}") + F.col(f"c_{n}")).alias(f"c_{n}") for n in names])


def _counted(batches: Iterator[pa.RecordBatch], keep: list[str], features: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Rows per distinct (keep..., feature, value, _sides) among every COUNTED_ROWS rows, in order, which packs well."""
    held, rows = [], 0

    def counts() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [_codes(table.column(k).combine_chunks()) for k in [*keep, "_sides"]]
        for column, feature in features.items():
            values = table.column(column).to_numpy()
            known = np.flatnonzero(~np.isnan(values))
            if not len(known):
                continue
            # Adding zero makes one value of both signs of zero.
            order = [k[known] for k in keys[:-1]] + [values[known] + 0.0, keys[-1][known]]
            at = np.lexsort(order[::-1])
            order = [k[at] for k in order]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in order])
            starts = np.flatnonzero(fresh)
            first = table.select([*keep, "_sides"]).take(pa.array(known[at][starts])).combine_chunks()
            yield from pa.table(
                [first.column(k) for k in keep] + [pa.repeat(pa.scalar(feature), len(starts)), pa.array(order[-2][starts]), first.column("_sides"),
                 pa.array(np.diff(starts, append=len(at)), pa.int64())], names=[*keep, "feature", "value", "_sides", "_n"]).to_batches()

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= COUNTED_ROWS:
            yield from counts()
            held, rows = [], 0
    if rows:
        yield from counts()


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where entries of `column` are."""
    if pa.types.is_floating(column.type) or pa.types.is_integer(column.type):
        if not column.null_count:
            return column.to_numpy()
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _changes(columns: Sequence[pa.Array]) -> np.ndarray:
    """True where a row differs from the row before in one of `columns`; the first row does."""
    fresh = np.zeros(len(columns[0]), dtype=bool)
    fresh[:1] = True
    for k in columns:
        here, ahead = k.slice(1), k.slice(0, len(k) - 1)
        differs = pc.fill_null(pc.not_equal(here, ahead), pa.scalar(False))
        fresh[1:] |= np.asarray(pc.or_(differs, pc.xor(pc.is_null(here), pc.is_null(ahead))))
    return fresh


def _merged(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of sorted rows (keys..., _sides, _n) added up per side, one row per distinct `keys`."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sides, n = batch.column("_sides").to_numpy(), batch.column("_n").to_numpy()
        part = pa.table([batch.column(k) for k in keys] + [pa.array(np.where(sides >> i & 1, n, 0), pa.int64()) for i in range(len(names))], names=[*keys, *names])
        # The last value may go on in the next batch.
        part = pa.concat_tables([held, part]).combine_chunks() if held is not None else part
        columns = [part.column(c).combine_chunks() for c in part.column_names]
        starts = np.flatnonzero(_changes(columns[:len(keys)]))
        added = [pa.array(np.add.reduceat(c.to_numpy(), starts), pa.int64()) for c in columns[len(keys):]]
        runs = pa.table([c.take(pa.array(starts)) for c in columns[:len(keys)]] + added, names=part.column_names)
        held = runs.slice(runs.num_rows - 1)
        yield from runs.slice(0, runs.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _carried(batches: Iterator[pa.RecordBatch], groups: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Add running sums of `names` along sorted rows, starting anew with every group."""
    last, carry = None, [0] * len(names)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(g) for g in groups]
        fresh = _changes(keys) if keys else np.zeros(batch.num_rows, dtype=bool)
        fresh[0] = last != [k[0].as_py() for k in keys]
        segment, starts, sums = np.cumsum(fresh), np.flatnonzero(fresh), []
        for i, name in enumerate(names):
            values = batch.column(name).to_numpy(zero_copy_only=False)
            total = np.cumsum(values)
            base = np.concatenate([[-carry[i]], total[starts] - values[starts]])
            sums.append(total - base[segment])
            carry[i] = int(sums[i][-1])
        last = [k[batch.num_rows - 1].as_py() for k in keys]
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(s, pa.int64()) for s in sums]], names=[*batch.schema.names, *[f"c_{n}" for n in names]])


def _may_hit(probs: Sequence[float]) -> Column:
    """True wherever a position (t-1)*p falls strictly between the row's first rank - 1 and its end."""
    last, start, end = F.col("_all") - 1, F.col("_from") - 1, F.col("_to")
    n = len(probs) - 1
    if n > 20 and all(abs(p - i / n) < 1e-12 for i, p in enumerate(probs)):
        share = F.lit(float(n)) / F.nullif(last, F.lit(0))
        first = F.ceil(F.greatest(F.lit(0.0), start * share - 1e-6))
        return (last == 0) | (first <= F.least(F.lit(float(n)), end * share + 1e-6))
    hit = F.lit(False)
    for p in probs:
        hit = hit | ((last * F.lit(float(p)) > start) & (last * F.lit(float(p)) < end))
    return hit


def quantiles(table: DataFrame, groups: Sequence[str], names: Sequence[str], probs: Sequence[float], value: str = "value") -> DataFrame:
    """Linearly interpolated quantiles per group and count column: (groups, side, idx, prob, quantile).

    A quantile needs at most two order statistics; every distinct value keeps only the wanted ranks
    that fall on it, so the rows after the filter number two per quantile.
    """
    if list(groups) == ["feature"] and value == "value":
        found = _feature_hits(table, list(names), [float(p) for p in probs]).groupBy("feature", "side", "idx", "prob", "part").agg(
            F.max("low").alias("_low"), F.max("high").alias("_high"))
        return found.select("feature", "side", "idx", "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("part")).alias("quantile"))
    sides = F.array(*[
        F.struct(F.lit(n).alias("side"), F.col(n).alias("n"), F.col(f"c_{n}").alias("c"), F.col(f"t_{n}").alias("t"))
        for n in names
    ])
    flat = table.select(*groups, value, F.explode(sides).alias("s")).filter("s.n > 0").select(
        *groups, value, "s.side", (F.col("s.c") - F.col("s.n")).alias("_from"), F.col("s.c").alias("_to"), F.col("s.t").alias("_all"))
    asked = F.from_json(F.lit(json.dumps([float(p) for p in probs])), "array<double>")

    def rank(p: Column, i: Column) -> Column:
        h = (F.col("_all") - 1) * p
        return F.struct(i.alias("idx"), p.alias("prob"), F.floor(h).alias("lo"), F.ceil(h).alias("hi"), (h - F.floor(h)).alias("part"))

    wanted = F.transform(asked, rank)
    inside = F.filter(wanted, lambda w: ((w["lo"] >= F.col("_from")) & (w["lo"] < F.col("_to")))
                      | ((w["hi"] >= F.col("_from")) & (w["hi"] < F.col("_to"))))
    # Few rows carry a wanted rank; a plain comparison drops the others before any array is built.
    hits = flat.filter(_may_hit(probs)).select(*groups, "side", value, "_from", "_to", F.explode(inside).alias("w"))

    def on(rank: str) -> Column:
        return F.max(F.when((F.col(f"w.{rank}") >= F.col("_from")) & (F.col(f"w.{rank}") < F.col("_to")), F.col(value)))

    found = hits.groupBy(*groups, "side", F.col("w.idx").alias("idx"), F.col("w.prob").alias("prob"), F.col("w.part").alias("part")).agg(
        on("lo").alias("_low"), on("hi").alias("_high"))
    return found.select(*groups, "side", "idx", "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("part")).alias("quantile"))


def by_feature(table: DataFrame, sides: Sequence[str], fold: Callable[..., dict[str, list]], schema: str) -> DataFrame:
    """Rows of `fold(value, n, c, t)` for every stretch of one feature in a batch of a value table, after the feature's name.

    `value` holds distinct values in order; `n` and `c` are (sides, values) counts of each value and up to it, `t` the totals.
    A batch gives a few rows, so what is left to Spark is small.
    """
    sides = list(sides)
    narrow = table.select("feature", "value", *[f"{kind}{s}" for kind in ("", "c_", "t_") for s in sides])
    out = StructType.fromDDL(f"feature string, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = [batch.column(i + 1).to_numpy() for i in range(3 * len(sides) + 1)]
            starts = np.flatnonzero(_changes([batch.column(0)]))
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                value, place = numbers[0][a:b], slice(a, b)
                if (value[1:] < value[:-1]).any():
                    place = a + np.argsort(value, kind="stable")
                    value = numbers[0][place]
                n, c, t = (np.stack([x[place] for x in numbers[1 + k * len(sides):1 + (k + 1) * len(sides)]]) for k in range(3))
                rows = fold(batch.column(0)[int(a)].as_py(), value, n, c, t[:, 0])
                size = len(next(iter(rows.values())))
                if size:
                    rows = {"feature": [batch.column(0)[int(a)].as_py()] * size, **rows}
                    yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], to_arrow_type(f.dataType)) for f in out.fields], names=out.names)

    return narrow.mapInArrow(run, out)


def _feature_hits(table: DataFrame, names: list[str], probs: list[float]) -> DataFrame:
    """The order statistics of a feature's quantiles, each from the batch in which it lies."""
    p = np.array(probs)

    def fold(feature: str | None, value: np.ndarray, n: np.ndarray, c: np.ndarray, t: np.ndarray) -> dict[str, list]:
        rows: dict[str, list] = {k: [] for k in ("side", "idx", "prob", "part", "low", "high")}
        for s, name in enumerate(names):
            if not t[s]:
                continue
            h = (t[s] - 1) * p
            first, last = c[s][0] - n[s][0], c[s][-1]
            found = []
            for rank in (np.floor(h), np.ceil(h)):
                inside = (rank >= first) & (rank < last)
                # The first value up to which there are more rows than the rank.
                found.append((inside, value[np.minimum(np.searchsorted(c[s], rank, side="right"), len(value) - 1)]))
            for i in np.flatnonzero(found[0][0] | found[1][0]):
                for k, v in zip(rows, (name, int(i), probs[i], float(h[i] - np.floor(h[i])), *[float(v[i]) if ok[i] else None for ok, v in found]), strict=True):
                    rows[k].append(v)
        return rows

    return by_feature(table, names, fold, "side string, idx int, prob double, part double, low double, high double")


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of each column: (keep..., feature, prob, quantile)."""
    groups = [*keep, "feature"]
    table = value_table(clean_numeric(df, columns), columns, keep, {"n": F.lit(True)})
    return quantiles(table, groups, ["n"], probs).drop("side", "idx")


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of every column."""
    return column_quantiles(df, columns, [0.5]).groupBy().pivot("feature", list(columns)).agg(F.first("quantile"))
