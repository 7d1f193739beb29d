"""Time blocks: how per-key window work is split so that no key becomes one task.

A window partitioned by region alone puts the whole history of a region into one task.  Here each
key is cut into blocks of consecutive `day_idx`; rows that a later (or earlier) block looks at are
copied into it, windows run inside (key, block), and only a block's own rows are kept.  Frames without
a bound (forward fill, running counts) get the state before the block from a small per-block table.
A region shorter than one block costs nothing extra: one shuffle, no copies that survive.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from isohyet.functions.frames import Roll, dates_with, trailing_columns

BLOCK_ROWS = 8192
FANOUT = 4096
KEYS = ("region_id",)
RADIX = 4
#: Metadata of a position column: the largest position, where a reader knows it.
LAST = "last_position"

BLOCK, OWN = "_block", "_own"


def _floor_div(col: Column, size: int) -> Column:
    return F.floor(col / F.lit(size)).cast("long")


def running_state(
    df: DataFrame, keys: Sequence[str], pos: str, sums: Sequence[str] = (), maxes: Sequence[str] = (),
    keep: Sequence[str] = (), fanout: int = FANOUT,
) -> DataFrame:
    """Inclusive running sums and maxima along `pos`, in two levels so that a long key is many tasks."""
    group = "_group"
    df = df.select(*keys, pos, *keep, *sums, *maxes, _floor_div(F.col(pos), fanout).alias(group))
    totals = df.groupBy(*keys, group).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes]
    )
    before = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, group,
        *[F.sum(c).over(before).alias(f"_b_{c}") for c in sums],
        *[F.max(c).over(before).alias(f"_b_{c}") for c in maxes],
    )
    inside = Window.partitionBy(*keys, group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(totals, [*keys, group]).select(
        *keys, pos, *keep,
        *[(F.coalesce(F.col(f"_b_{c}"), F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(c) for c in sums],
        *[F.greatest(F.col(f"_b_{c}"), F.max(c).over(inside)).alias(c) for c in maxes],
    )


class Blocked:
    """A panel spread over time blocks; add window columns, then call `done`."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: str, carried: Iterable[str], extra: Iterable[str], single: bool = False):
        self.df, self.keys, self.order = df, tuple(keys), order
        self.carried, self.temps = set(carried), list(extra)
        # A key that fits one block needs no block in its partitions, so tables stored by key are read as they lie.
        self.parts = self.keys if single else (*self.keys, BLOCK)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(self.order)

    def add(self, columns: dict[str, Column], temp: bool = False) -> "Blocked":
        if columns:
            self.df = self.df.select("*", *[v.alias(k) for k, v in columns.items()])
            if temp:
                self.temps += columns
        return self

    def done(self, keep: Sequence[str] | None = None) -> DataFrame:
        df = self.df.filter(F.col(OWN)).drop(BLOCK, OWN, *self.temps)
        return df.select(*keep) if keep else df

    # -- unbounded look-back ------------------------------------------------------------------
    def last_known(self, source: str, inclusive: bool = True) -> Column:
        """Latest non-null value so far (or strictly before), across block borders when carried."""
        seen = F.last(source, ignorenulls=True).over(
            self.window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        )
        return F.coalesce(seen, F.col(f"_carry_{source}")) if source in self.carried else seen

    def start(self) -> Column:
        """First position of the key (needs `carry_start`)."""
        local = F.min(self.order).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        return F.coalesce(-F.col("_carry_start"), local)

    # -- bounded look-back --------------------------------------------------------------------
    def lag(self, source: str, k: int) -> Column:
        return F.lag(source, k).over(self.window) if k else F.col(source)

    def rolls(self, wanted: Sequence[Roll]) -> "Blocked":
        return self.trailing(rolls=wanted)

    def trailing(
        self, rolls: Sequence[Roll] = (), ewm: dict[str, tuple[str, int]] | None = None,
        lags: dict[str, tuple[str, int]] | None = None, days_of: str | None = None, only: Column | None = None, spent: Iterable[str] = (),
    ) -> "Blocked":
        """Add trailing frames, recursive means and lags; frames without a value give NULL.

        Spark deals and sorts the rows; a block is at most BLOCK_ROWS rows and its halo, and `frames` computes all that is
        asked of it in numpy: sums, maxima and moments of 1, 2, 4, ... rows, each from the one before, and frames from them.
        A recursive mean y(t) = b*y(t-1) + a*x(t-1), a = 2/(span+1), is seeded by the first value; gaps repeat the last
        known value (`ewm`: output name -> (source, span)). `days_of` names a column; rows leave the task only if their date is
        one with a value of it, or the block's first or last date, of which a neighbour may hold more. Rows where `only`
        does not hold are seen by the frames of others and stay in the task, as do the columns `spent`, which nothing reads
        after the frames.
        """
        rolls, ewm, lags, order = list(rolls), dict(ewm or {}), dict(lags or {}), self.order
        if only is not None and (rolls or ewm or lags):
            self.add({"_asked": only}, temp=True)
        if not (rolls or ewm or lags):
            return self
        types = {f.name: f.dataType for f in self.df.schema.fields}
        added = {r.name: {"count": LongType(), "max": types[r.source]}.get(r.fn, DoubleType()) for r in rolls}
        added |= {n: DoubleType() for n in ewm} | {n: types[s] for n, (s, _) in lags.items()}
        spent = {*spent, "_asked", *[c for c in types if c.startswith("_carry_")]}
        schema = StructType([StructField(f.name, f.dataType, True, f.metadata) for f in self.df.schema.fields if f.name not in spent] + [StructField(n, t) for n, t in added.items()])
        left = schema.names
        carried = sorted(s for s, _ in ewm.values() if s in self.carried and f"_carry_{s}" in types)

        asked = "_asked" if only is not None else None

        def frames_of(table: pa.Table) -> pa.Table:
            out = trailing_columns(table, order, rolls, ewm, lags, carried, asked)
            return (out.filter(dates_with(out, days_of)) if days_of else out).select(left)

        self.df = self.df.groupBy(*self.parts).applyInArrow(frames_of, schema)
        return self


def widenings(span: int) -> int:
    """Fourfold steps after which the remaining weight of a recursive mean is below 1e-15."""
    decay, m = 1.0 - 2.0 / (span + 1.0), 0
    while decay ** (RADIX**m) >= 1e-15:
        m += 1
    return m


def ewm_look_back(spans: Iterable[int]) -> int:
    return max((RADIX ** widenings(s) + 1 for s in spans), default=0)


def one_block(df: DataFrame, order: str, size: int) -> bool:
    """Whether the table says that its positions end before the first block does. Results do not depend on it."""
    last = next((f.metadata.get(LAST) for f in df.schema.fields if f.name == order), None)
    return last is not None and last < size


def single_block(
    df: DataFrame, keys: Sequence[str], order: str, carry_start: bool, carry_sum: Sequence[str], carry_max: Sequence[str],
    side: DataFrame | None,
) -> Blocked:
    """Keys of one block each: no halo, and nothing lies before the block, so no last value is carried."""
    types = {f.name: f.dataType for f in df.schema.fields}
    total = df.limit(0).agg(*[F.sum(c).alias(c) for c in carry_sum]).schema if carry_sum else []
    empty = {f"_before_{f.name}": f.dataType for f in total}
    empty |= {f"_peak_{c}": types[c] for c in carry_max} | ({"_carry_start": LongType()} if carry_start else {})
    framed = df.withColumns({BLOCK: F.lit(0).cast("long"), OWN: F.lit(True)} | {n: F.lit(None).cast(t) for n, t in empty.items()})
    if side is not None:
        framed = framed.join(side, list(keys), "left")
    return Blocked(framed, keys, order, (), list(empty), single=True)


def spread(
    df: DataFrame, look_back: int = 0, look_ahead: int = 0, *, keys: Sequence[str] = KEYS, order: str = "day_idx",
    carry: Sequence[str] = (), carry_start: bool = False, carry_sum: Sequence[str] = (), carry_max: Sequence[str] = (),
    side: DataFrame | None = None, block_rows: int | None = None,
) -> Blocked:
    """Cut `df` into blocks of `order` with the given halo.

    `carry` names columns whose last non-null value before the block is needed; `carry_start` also
    brings the first `order` value of the key (negated, as `_carry_start`).  `carry_sum` and `carry_max`
    bring totals and maxima over everything before the block, as `_before_<c>` and `_peak_<c>`.
    `side` holds one row per key; it is repeated per block and joined on (key, block), so that a long
    key does not meet in one task.
    """
    size = block_rows or BLOCK_ROWS
    pos = F.col(order)
    if one_block(df, order, size):
        return single_block(df, keys, order, carry_start, carry_sum, carry_max, side)
    own = _floor_div(pos, size)
    if look_back or look_ahead:
        first = F.greatest(F.lit(0).cast("long"), _floor_div(pos - look_ahead, size))
        framed = df.select("*", F.explode(F.sequence(first, _floor_div(pos + look_back, size))).alias(BLOCK))
        framed = framed.withColumn(OWN, F.col(BLOCK) == own)
    else:
        framed = df.select("*", own.alias(BLOCK), F.lit(True).alias(OWN))

    lasts, sums = [f"_carry_{c}" for c in carry], [f"_before_{c}" for c in carry_sum]
    peaks = [f"_peak_{c}" for c in carry_max] + (["_carry_start"] if carry_start else [])
    extra = lasts + sums + peaks
    context = None
    if extra:
        # A row counts for every block whose first (halo) row comes after it; `_sees` is the first such block.
        # Each row also names its own block, so that every block with rows gets a context row.
        read = sorted({*carry, *carry_sum, *carry_max} - {order})
        sees = _floor_div(pos + look_back, size) + 1
        marks = F.explode(F.array(F.struct(sees.alias(BLOCK), F.lit(True).alias("_sees")), F.struct(own.alias(BLOCK), F.lit(False).alias("_sees"))))
        rows = df.select(*keys, order, *read, marks.alias("_m")).select(*keys, order, *read, "_m.*")

        def seen(value: Column) -> Column:
            return F.when(F.col("_sees"), value)

        totals = rows.groupBy(*keys, BLOCK).agg(
            *[F.max(F.when(F.col("_sees") & F.col(c).isNotNull(), F.struct(pos.alias("at"), F.col(c).alias("value")))).alias(f"_carry_{c}")
              for c in carry],
            *[F.sum(seen(F.col(c))).alias(f"_before_{c}") for c in carry_sum],
            *[F.max(seen(F.col(c))).alias(f"_peak_{c}") for c in carry_max],
            *([F.max(seen(-pos)).alias("_carry_start")] if carry_start else []),
        )
        context = running_state(totals, keys, BLOCK, sums=sums, maxes=lasts + peaks).select(
            *keys, BLOCK, *[F.col(f"{c}.value").alias(c) for c in lasts], *sums, *peaks)
    if side is not None:
        blocks = context if context is not None else df.select(*keys, own.alias(BLOCK)).distinct()
        context = blocks.join(side, list(keys), "left")
    if context is not None:
        framed = framed.join(context, [*keys, BLOCK], "left")
    return Blocked(framed, keys, order, carry, extra)


def with_position(
    df: DataFrame, name: str, keys: Sequence[str] = KEYS, order: str = "day_idx", block_rows: int | None = None
) -> DataFrame:
    """Zero-based position of a row in its key along `order`, whose values need not be dense."""
    size = block_rows or BLOCK_ROWS
    if one_block(df, order, size):
        # Rows are numbered where they lie. Like the joins below, this counts rows without a place first and leaves them out.
        last = next(f.metadata[LAST] for f in df.schema.fields if f.name == order)
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
        numbered = df.dropna(subset=list(keys)).withColumn(name, number).withMetadata(name, {LAST: last})
        return numbered.filter(F.col(order).isNotNull())
    df = df.withColumn(BLOCK, _floor_div(F.col(order), size))
    counts = df.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_rows"))
    ends = running_state(counts, keys, BLOCK, sums=["_rows"]).withColumnRenamed("_rows", "_end")
    offsets = ends.join(counts, [*keys, BLOCK]).select(*keys, BLOCK, (F.col("_end") - F.col("_rows")).alias("_start"))
    inner = Window.partitionBy(*keys, BLOCK).orderBy(order)
    return (
        df.join(offsets, [*keys, BLOCK])
        .withColumn(name, (F.col("_start") + F.row_number().over(inner) - 1).cast("int"))
        .drop(BLOCK, "_start")
    )


def with_day_index(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "day_idx") -> DataFrame:
    """Position of a row in its key by (year, month, day), counted year by year.

    A year holds at most 366 days per key, so the inner numbering is small for every key; the offsets
    come from running totals over the per-year counts.
    """
    df = df.withColumn("_year", F.col("year").cast("long"))
    counts = df.groupBy(*keys, "_year").agg(F.count(F.lit(1)).alias("_rows"))
    ends = running_state(counts, keys, "_year", sums=["_rows"]).withColumnRenamed("_rows", "_end")
    offsets = ends.join(counts, [*keys, "_year"]).select(*keys, "_year", (F.col("_end") - F.col("_rows")).alias("_start"))
    inner = Window.partitionBy(*keys, "_year").orderBy("month", "day")
    return (
        df.join(offsets, [*keys, "_year"])
        .withColumn(name, (F.col("_start") + F.row_number().over(inner) - 1).cast("int"))
        .drop("_year", "_start")
    )
