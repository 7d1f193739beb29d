"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins; cyclic boosting adds a shallow tree over one feature at a time, whose steps end up
in that feature's lookup table; then trees over pairs of bins fit what is left. A score is a sum of table entries.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import body, short_batches, store

FEATURES = [
    "log_words", "word_length", "distinct_share", "doubled_share", "symbol_share", "capital_share", "shout_share", "digit_share",
    "line_length", "repeated_lines", "comma_share", "stop_share", "long_share",
]
#: Bound on the labelled rows that a fit takes to the driver; scoring has none.
FIT_ROWS = 60_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.15
LEAST_LEAF = 8
RIDGE = 1.0

_CLASSES = {"symbol": b"#*$%&|<>{}[]\\^~_=/@", "shout": b"!?", "digit": b"0123456789", "comma": b",;:.", "capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_DROP = {k: (None, v) for k, v in _CLASSES.items()}


def text_features(text: str) -> list[float]:
    """Numbers that describe a whole text; labels, language, source and id are no part of them."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    solid = sum(map(len, words))
    share = {k: (len(raw) - len(raw.translate(*v))) / solid for k, v in _DROP.items()}
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [
        np.log1p(n), solid / n, len(set(words)) / n, sum(map(str.__eq__, words, itertools.islice(words, 1, None))) / n, share["symbol"], share["capital"],
        share["shout"], share["digit"], np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), share["comma"],
        sum(len(w) <= 3 for w in words) / n, sum(len(w) >= 12 for w in words) / n,
    ]


@dataclass
class Gam:
    """Lookup tables: `single[f]` over the bins of feature f, `double[k]` over those of pair k."""

    start: float
    edges: list[np.ndarray]
    single: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    double: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, (edges, table) in enumerate(zip(self.edges, self.single, strict=True)):
            out += table[np.searchsorted(edges, x[:, f], side="right")]
        for (a, b), table in zip(self.pairs, self.double, strict=True):
            out += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered bins: at most `depth` levels of splits, each the one with the largest gain."""
    g, h, c = np.cumsum(grad), np.cumsum(hess), np.cumsum(count)
    value = g[-1] / (h[-1] + RIDGE)
    if depth and len(grad) > 1:
        left = g[:-1] ** 2 / (h[:-1] + RIDGE) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + RIDGE)
        left[(c[:-1] < LEAST_LEAF) | (c[-1] - c[:-1] < LEAST_LEAF)] = -np.inf
        at = int(np.argmax(left)) + 1
        if left[at - 1] > g[-1] ** 2 / (h[-1] + RIDGE) + 1e-9:
            return np.concatenate([_tree(grad[:at], hess[:at], count[:at], depth - 1), _tree(grad[at:], hess[at:], count[at:], depth - 1)])
    return np.full(len(grad), value)


def _grid_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """A cut of each feature: four leaves over a grid of bins, and their gain."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    quarters = []
    for x in (g, h):
        a = x[:-1, :-1]
        b, c = x[:-1, -1:] - a, x[-1:, :-1] - a
        quarters.append((a, b, c, x[-1, -1] - a - b - c))
    if not quarters[0][0].size:
        return np.zeros_like(grad), 0.0
    gain = sum(q**2 / (w + RIDGE) for q, w in zip(*quarters, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [q[i, j] / (w[i, j] + RIDGE) for q, w in zip(*quarters, strict=True)]
    out = np.empty_like(grad)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain[i, j])


def fit_gam(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the log loss. Without rows, or with one label only, every score is the prior."""
    n, width = x.shape
    mean = (y.sum() + 1.0) / (n + 2.0)
    model = Gam(float(np.log(mean / (1 - mean))), [], [], [], [], [])
    for f in range(width):
        model.edges.append(_edges(x[:, f], BINS) if n else np.zeros(0))
        model.pair_edges.append(_edges(x[:, f], PAIR_BINS) if n else np.zeros(0))
        model.single.append(np.zeros(len(model.edges[f]) + 1))
    if n == 0 or y.min() == y.max():
        return model
    place = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    raw = np.full(n, model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            grad, hess = slopes()
            size = len(model.single[f])
            step = RATE * _tree(*[np.bincount(place[f], w, size) for w in (grad, hess, np.ones(n))])
            model.single[f] += step
            raw += step[place[f]]

    def grids(a: int, b: int) -> list[np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        return [np.bincount(coarse[a] * shape[1] + coarse[b], w, shape[0] * shape[1]).reshape(shape) for w in slopes()]

    ranked = sorted(((_grid_tree(*grids(a, b))[1], a, b) for a, b in itertools.combinations(range(width), 2)), reverse=True)
    model.pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    model.double = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            step = RATE * _grid_tree(*grids(a, b))[0]
            model.double[k] += step
            raw += step[coarse[a], coarse[b]]
    return model


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array of features of each row; null text counts as empty."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text")).mapInArrow(describe, "doc_id long, x array<double>")


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """One row per input row: doc_id, score. `labels` holds the rows to learn from: an id and a label of 0 or 1.

    The fit takes at most `fit_rows` labelled rows, those with the smallest hash of their id; every row is scored.
    Null and empty texts are scored by their features, which are all 0. Ids without a document, null ids and null
    labels teach nothing; an id with several labels teaches each. Rows that repeat are scored alike; no rows give
    no rows.
    """
    rows = store(described(docs, id_col, text_col), "features")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("y in (0, 1)")
    # A bound on the hash, from the number of labelled rows, leaves little more than the fit takes before rows are ranked.
    labelled, digest = rows.join(known, "doc_id"), F.xxhash64("doc_id")
    share = min(1.0, (1.1 * fit_rows + 1000) / max(1, labelled.count()))
    taught = labelled.filter(digest < int((share - 0.5) * 2.0**64)) if share < 1 else labelled
    taught = taught.orderBy(digest, "doc_id", "y").limit(fit_rows).toPandas()
    x = np.array(taught["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    model = docs.sparkSession.sparkContext.broadcast(fit_gam(x, taught["y"].to_numpy(dtype=float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(values), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(score, "doc_id long, score double")
