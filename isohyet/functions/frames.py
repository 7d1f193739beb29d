"""Trailing frames of one sorted block in numpy: what a task computes after Spark has dealt and sorted the rows.

Tables over 1, 2, 4, ... rows are built from the one before by a shift, and every frame is put together from them, so the
cost per row grows with the logarithm of the window and nothing is subtracted. Arrays are (columns, rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Up to so many asked rows of a block are reduced one by one.
FEW_ROWS = 4


@dataclass
class Roll:
    """One trailing frame: rows t-hi .. t-lo of `source`, reduced by `fn`."""

    name: str
    source: str
    fn: str
    hi: int
    lo: int = 1

    @property
    def width(self) -> int:
        return self.hi - self.lo + 1


def back(table: np.ndarray, k: int, fill: float = 0.0) -> np.ndarray:
    """Values `k` rows earlier; rows before the block give `fill`."""
    if not k:
        return table
    out = np.full_like(table, fill)
    if k < table.shape[-1]:
        out[..., k:] = table[..., :-k]
    return out


def pieces(hi: int, lo: int) -> Iterator[tuple[int, int]]:
    """(size as a power of two, offset) of disjoint pieces of a frame, the largest next to today."""
    at = lo
    for level in reversed(range((hi - lo + 1).bit_length())):
        if (hi - lo + 1) >> level & 1:
            yield level, at
            at += 1 << level


def levels(width: int) -> int:
    return max(1, int(width).bit_length())


def sum_frames(x: np.ndarray, widest: int) -> list[np.ndarray]:
    """Sums over the last 1, 2, 4, ... rows."""
    out = [x]
    for k in range(1, levels(widest)):
        wide, step = out[-1].copy(), 1 << (k - 1)
        wide[..., step:] += out[-1][..., :-step]
        out.append(wide)
    return out


def max_frames(x: np.ndarray, widest: int) -> list[np.ndarray]:
    out = [x]
    for k in range(1, levels(widest)):
        wide, step = out[-1].copy(), 1 << (k - 1)
        np.maximum(wide[..., step:], out[-1][..., :-step], out=wide[..., step:])
        out.append(wide)
    return out


Moments = tuple[np.ndarray, np.ndarray, np.ndarray]


def merged(a: Moments, b: Moments) -> Moments:
    """(count, mean, squares about the mean) of two disjoint sets by the parallel-variance formula."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1.0)
    delta = b[1] - a[1]
    off = delta * share
    # Where `a` is empty its mean is 0 and the share 1, so the other's mean is taken whole.
    delta *= off
    delta *= a[0]
    delta += a[2]
    delta += b[2]
    off += a[1]
    return n, off, delta


def moment_frames(x: np.ndarray, ok: np.ndarray, widest: int) -> list[Moments]:
    out = [(ok.astype(np.float64), x, np.zeros_like(x))]
    for k in range(1, levels(widest)):
        step = 1 << (k - 1)
        near = tuple(m[..., step:] for m in out[-1])
        far = tuple(m[..., :-step] for m in out[-1])
        # Rows with nothing that far back keep what they have.
        out.append(tuple(np.concatenate([m[..., :step], w], axis=-1) for m, w in zip(out[-1], merged(near, far), strict=True)))
    return out


def recursive_means(x: np.ndarray, ok: np.ndarray, before: np.ndarray, span: int, limit: float = 1e-15) -> np.ndarray:
    """y(t) = b*y(t-1) + a*x(t) with a = 2/(span+1), seeded by the first value; `x` is filled forward, `before` tells of earlier values.

    A weighted sum with weights a*b^k, doubled until the weight left out is below `limit`.
    """
    a = 2.0 / (span + 1.0)
    decay = 1.0 - a
    earlier = np.concatenate([before[:, None], ok[:, :-1]], axis=1)
    y, k = np.where(ok, np.where(earlier, x * a, x), 0.0), 1
    while decay**k >= limit and k < y.shape[-1]:
        y[:, k:] += y[:, :-k] * decay**k
        k *= 2
    return y


def trailing_columns(
    table: pa.Table, order: str, rolls: Sequence[Roll], ewm: dict[str, tuple[str, int]], lags: dict[str, tuple[str, int]], carried: Sequence[str],
    only: str | None = None,
) -> pa.Table:
    """The table of one block, sorted by `order`, with all frames, recursive means and lags added.

    `only` names a column; rows come back where it is true, and only what their frames reach is computed.
    """
    table = table.combine_chunks()
    place = pc.fill_null(table.column(order).cast(pa.int64()), -(2**62)).to_numpy()
    if (place[1:] < place[:-1]).any():
        table = table.take(pa.array(np.argsort(place, kind="stable")))
    if only:
        asked = np.flatnonzero(pc.fill_null(table.column(only), False).to_numpy())
        if not len(asked):
            return trailing_columns(table.slice(0, 1), order, rolls, ewm, lags, carried).slice(0, 0)
        # Recursive means reach back to the first row, but few columns have them.
        means = trailing_columns(table, order, [], ewm, {}, carried) if ewm else table
        reach = max([r.hi for r in rolls] + [k for _, k in lags.values()], default=0)
        start = max(0, int(asked[0]) - reach)
        near, asked_near = table.slice(start, int(asked[-1]) + 1 - start), asked - start
        if len(asked) <= FEW_ROWS:
            out = _frames_of_rows(near, rolls, lags, asked_near)
        else:
            out = trailing_columns(near, order, rolls, {}, lags, carried).take(pa.array(asked_near))
        given = {n: means.column(n).take(pa.array(asked)) for n in ewm}
        plain = table.column_names
        names = [*plain, *[r.name for r in rolls], *ewm, *lags]
        return pa.table([given[n] if n in given else out.column(n) for n in names], names=names)
    rows = table.num_rows
    sources = sorted({r.source for r in rolls} | {s for s, _ in ewm.values()})
    at = {s: i for i, s in enumerate(sources)}
    x, ok = np.zeros((len(sources), rows)), np.zeros((len(sources), rows), dtype=bool)
    for s, i in at.items():
        column = table.column(s)
        ok[i] = pc.is_valid(column).to_numpy()
        x[i] = pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy()
    results: dict[str, pa.Array] = {}

    # Frames by kind and bounds, all sources of one kind at once.
    counted = np.concatenate([np.zeros((len(sources), 1), dtype=np.int64), np.cumsum(ok, axis=1)], axis=1)
    ends = np.arange(rows)
    wanted: dict[str, dict[tuple[int, int], list[Roll]]] = {}
    for r in rolls:
        wanted.setdefault("sum" if r.fn in ("sum", "mean") else r.fn, {}).setdefault((r.hi, r.lo), []).append(r)
    counts: dict[tuple[int, int], np.ndarray] = {}
    for hi, lo in {b for frames in wanted.values() for b in frames}:
        counts[hi, lo] = counted[:, np.maximum(ends - lo + 1, 0)] - counted[:, np.maximum(ends - hi, 0)]
    for kind, frames in wanted.items():
        used = sorted({at[r.source] for rs in frames.values() for r in rs})
        spot = {i: j for j, i in enumerate(used)}
        widest = max(hi - lo + 1 for hi, lo in frames)
        if kind == "sum":
            tables = sum_frames(x[used], widest)
        elif kind == "max":
            tables = max_frames(np.where(ok[used], x[used], -np.inf), widest)
        elif kind == "std":
            tables = moment_frames(x[used], ok[used], widest)
        for (hi, lo), rs in frames.items():
            pick = sorted({spot[at[r.source]] for r in rs})
            line = {j: k for k, j in enumerate(pick)}
            if kind == "sum":
                total = sum(back(tables[level][pick], k) for level, k in pieces(hi, lo))
            elif kind == "max":
                level = (hi - lo + 1).bit_length() - 1
                total = np.maximum(back(tables[level][pick], lo, -np.inf), back(tables[level][pick], hi - (1 << level) + 1, -np.inf))
            elif kind == "std":
                whole = None
                for level, k in pieces(hi, lo):
                    part = tuple(back(m[pick], k) for m in tables[level])
                    whole = part if whole is None else merged(whole, part)
                total = np.sqrt(whole[2] / np.maximum(whole[0] - 1, 1.0))
            for r in rs:
                n, j = counts[hi, lo][at[r.source]], line[spot[at[r.source]]]
                if kind == "count":
                    results[r.name] = pa.array(n)
                elif r.fn == "mean":
                    results[r.name] = pa.array(total[j] / np.maximum(n, 1), mask=n == 0)
                elif kind == "max":
                    results[r.name] = pa.array(np.where(n == 0, 0.0, total[j]), mask=n == 0).cast(table.column(r.source).type)
                else:
                    results[r.name] = pa.array(total[j], mask=n < (2 if kind == "std" else 1))

    if ewm:
        used = sorted({at[s] for s, _ in ewm.values()})
        names = [sources[i] for i in used]
        before = np.zeros(len(used), dtype=bool)
        last = np.maximum.accumulate(np.where(ok[used], ends, -1), axis=1)
        filled = np.where(last >= 0, np.take_along_axis(x[used], np.maximum(last, 0), axis=1), 0.0)
        for j, s in enumerate(names):
            if s in carried:
                # One value per block: what the last row before it knew.
                value = table.column(f"_carry_{s}")
                if rows and value[0].is_valid:
                    before[j], filled[j] = True, np.where(last[j] >= 0, filled[j], value[0].as_py())
        known = (last >= 0) | before[:, None]
        for span in sorted({v for _, v in ewm.values()}):
            y = back(recursive_means(filled, known, before, span), 1)
            some = np.concatenate([before[:, None], known[:, :-1]], axis=1)
            for name, (s, v) in ewm.items():
                if v == span:
                    j = names.index(s)
                    results[name] = pa.array(y[j], mask=~some[j])

    for name, (s, k) in lags.items():
        column = table.column(s).combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.nulls(0, column.type)
        results[name] = pa.concat_arrays([pa.nulls(min(k, rows), column.type), column.slice(0, max(rows - k, 0))])
    return _with_columns(table, {name: results[name] for name in [*[r.name for r in rolls], *ewm, *lags]})


def _with_columns(table: pa.Table, added: dict[str, pa.Array]) -> pa.Table:
    return pa.table([*table.columns, *added.values()], names=[*table.column_names, *added])


def _frames_of_rows(table: pa.Table, rolls: Sequence[Roll], lags: dict[str, tuple[str, int]], rows: np.ndarray) -> pa.Table:
    """The frames of a few rows, put together from the same pieces in the same order, but of these rows only."""
    sources = sorted({r.source for r in rolls})
    at = {s: i for i, s in enumerate(sources)}
    # Rows before the block are empty.
    pad = max((r.hi for r in rolls), default=0)
    x, ok = np.zeros((len(sources), pad + table.num_rows)), np.zeros((len(sources), pad + table.num_rows), dtype=bool)
    for s, i in at.items():
        column = table.column(s)
        ok[i, pad:], x[i, pad:] = pc.is_valid(column).to_numpy(), pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy()

    def built(fns: tuple[str, ...], tables: tuple[np.ndarray, ...], join: Callable) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
        """Tables over the pieces (level, last row) of all frames of these kinds."""
        ends: dict[int, set[int]] = {}
        for hi, lo in {(r.hi, r.lo) for r in rolls if r.fn in fns}:
            for level, k in pieces(hi, lo):
                ends.setdefault(level, set()).update(int(t) - k for t in rows)
        out = {}
        for level, last in ends.items():
            last = sorted(last)
            held = tuple(m[:, np.add.outer(np.array(last) + pad, np.arange(1 - (1 << level), 1))] for m in tables)
            for _ in range(level):
                held = join(tuple(m[..., 1::2] for m in held), tuple(m[..., 0::2] for m in held))
            out |= {(level, e): tuple(m[:, j, 0] for m in held) for j, e in enumerate(last)}
        return out

    sums = built(("sum", "mean"), (x,), lambda near, far: (near[0] + far[0],))
    moments = built(("std",), (ok.astype(np.float64), x, np.zeros_like(x)), merged)
    top = np.where(ok, x, -np.inf) if any(r.fn == "max" for r in rolls) else x
    reduced: dict[tuple[int, int, str], np.ndarray] = {}
    for hi, lo, fn in {(r.hi, r.lo, kind) for r in rolls for kind in ("count", "sum" if r.fn == "mean" else r.fn)}:
        out = np.zeros((len(sources), len(rows)))
        for j, t in enumerate(rows):
            frame = slice(pad + int(t) - hi, pad + int(t) - lo + 1)
            if fn == "count":
                out[:, j] = ok[:, frame].sum(axis=1)
            elif fn == "max":
                out[:, j] = top[:, frame].max(axis=1)
            elif fn == "sum":
                out[:, j] = sum(sums[level, int(t) - k][0] for level, k in pieces(hi, lo))
            else:
                whole = reduce(merged, (moments[level, int(t) - k] for level, k in pieces(hi, lo)))
                out[:, j] = np.sqrt(whole[2] / np.maximum(whole[0] - 1, 1.0))
        reduced[hi, lo, fn] = out

    results: dict[str, pa.Array] = {}
    for r in rolls:
        i = at[r.source]
        n = reduced[r.hi, r.lo, "count"][i]
        if r.fn == "count":
            results[r.name] = pa.array(n.astype(np.int64))
        elif r.fn == "max":
            results[r.name] = pa.array(np.where(n == 0, 0.0, reduced[r.hi, r.lo, "max"][i]), mask=n == 0).cast(table.column(r.source).type)
        elif r.fn == "mean":
            results[r.name] = pa.array(reduced[r.hi, r.lo, "sum"][i] / np.maximum(n, 1), mask=n == 0)
        else:
            results[r.name] = pa.array(reduced[r.hi, r.lo, r.fn][i], mask=n < (2 if r.fn == "std" else 1))
    for name, (s, k) in lags.items():
        results[name] = table.column(s).take(pa.array([int(t) - k if t >= k else None for t in rows], pa.int64()))
    return _with_columns(table.take(pa.array(rows)), results)


def dates_with(table: pa.Table, column: str) -> pa.Array:
    """True for rows of a sorted block on dates where some row has a value of `column`, and on its first and last date."""
    date, rows = table.column("date").combine_chunks(), table.num_rows
    at = np.flatnonzero(pc.is_valid(table.column(column)).to_numpy())
    at = np.union1d(at, [0, rows - 1]) if rows else at
    return pc.is_in(date, value_set=date.take(pa.array(at, pa.int64())))
