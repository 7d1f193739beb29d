"""Language identification with a byte convolutional network.

Filters of several widths run over fixed-length windows of bytes, their maxima over each window meet a softmax
layer, and a text's windows vote with their log-probabilities. A filter over bytes is a sum of lookups; pairs of
neighbouring bytes share one lookup, so a width of four costs two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import hinted, match, short_batches, store

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bound on the labelled rows of each language that a fit takes to the driver; predictions have none.
FIT_ROWS = 1000
#: Windows of a labelled text that teach, drawn from all of it.
FIT_PARTS = 2
EPOCHS = 12
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    """filters[w]: (width, 256, FILTERS); output: (filters of all widths, languages)."""

    langs: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    output: np.ndarray
    offset: np.ndarray

    def __post_init__(self) -> None:
        self.pairs: list[list[np.ndarray]] = []

    def prepare(self) -> None:
        """Tables over pairs of bytes: the exact sums of two single lookups."""
        self.pairs = [
            [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32) if k + 1 < len(f) else f[k].astype(np.float32) for k in range(0, len(f), 2)]
            for f in self.filters
        ]

    def maxima(self, windows: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each row of bytes."""
        wide = windows.astype(np.int32)
        double = wide[:, :-1] * 256 + wide[:, 1:]
        out = []
        for f, tables in zip(self.filters, self.pairs, strict=True):
            span = windows.shape[1] - len(f) + 1
            total = None
            for k, table in enumerate(tables):
                at = double if len(table) == 65536 else wide
                part = table[at[:, 2 * k : 2 * k + span]]
                total = part if total is None else np.add(total, part, out=total)
            out.append(total.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.maxima(windows) @ self.output + self.offset
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(text: str) -> np.ndarray:
    """The whole text in windows of WINDOW bytes, white space and digits as one blank each, the last one padded."""
    raw = np.frombuffer(_clean(text), dtype=np.uint8)
    out = np.full(max(1, -(-len(raw) // WINDOW)) * WINDOW, 32, dtype=np.uint8)
    out[: len(raw)] = raw
    return out.reshape(-1, WINDOW)


_BLANKS = bytes(32 if b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if b < 91 else b for b in range(256))


def _clean(text: str) -> bytes:
    """Lower-case ASCII letters and all bytes above 127 as they are, any run of other bytes as one blank."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_BLANKS).split())


def teaching_windows(text: str, most: int = FIT_PARTS) -> np.ndarray:
    """At most `most` windows of the whole text, drawn by its checksum."""
    own = windows_of(text)
    if len(own) <= most:
        return own
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    return own[np.sort(rng.choice(len(own), most, replace=False))]


def fit_net(texts: list[str], langs: list[str], seed: int = 0) -> ByteNet:
    """Train on the windows that labelled texts teach by."""
    pairs = [(w.tobytes(), lang) for text, lang in zip(texts, langs, strict=True) for w in teaching_windows(text)]
    return train_net([w for w, _ in pairs], [lang for _, lang in pairs], seed)


def train_net(windows: list[bytes], langs: list[str], seed: int = 0) -> ByteNet:
    """Train on windows of WINDOW bytes by stochastic gradient descent with momentum-free Adagrad steps."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    pieces = [np.frombuffer(w, dtype=np.uint8) for w in windows]
    target = [names.index(lang) for lang in langs]
    total = FILTERS * len(WIDTHS)
    net = ByteNet(
        names, [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS], np.zeros(total), rng.normal(0, 0.1, (total, max(1, len(names)))), np.zeros(max(1, len(names)))
    )
    if len(names) < 2:
        net.prepare()
        return net
    x, y = np.stack(pieces), np.array(target)
    weight = len(y) / (len(names) * np.bincount(y, minlength=len(names)))
    squares = [np.full(p.shape, 1e-3) for p in (*net.filters, net.bias, net.output, net.offset)]

    def move(values: np.ndarray, slope: np.ndarray, square: np.ndarray, rate: float) -> None:
        square += slope**2
        values -= rate * slope / np.sqrt(square)

    for epoch in range(EPOCHS):
        rate = 0.1 / (1 + 0.3 * epoch)
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            rows = x[order[at : at + 64]]
            goal = y[order[at : at + 64]]
            tops, values = [], []
            for f in net.filters:
                span = WINDOW - len(f) + 1
                response = sum(f[k][rows[:, k : k + span]] for k in range(len(f)))
                tops.append(response.argmax(axis=1))
                values.append(response.max(axis=1))
            pre = np.concatenate(values, axis=1) + net.bias
            hidden = np.maximum(pre, 0)
            z = hidden @ net.output + net.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            delta = z / z.sum(axis=1, keepdims=True)
            delta[np.arange(len(goal)), goal] -= 1
            delta *= weight[goal][:, None] / len(goal)
            back = (delta @ net.output.T) * (pre > 0)
            for w, (f, top) in enumerate(zip(net.filters, tops, strict=True)):
                slope = np.zeros_like(f)
                part = back[:, w * FILTERS : (w + 1) * FILTERS]
                for k in range(len(f)):
                    byte = np.take_along_axis(rows, top + k, axis=1)
                    np.add.at(slope[k], (byte, np.arange(FILTERS)[None, :]), part)
                move(f, slope, squares[w], rate)
            move(net.bias, back.sum(axis=0), squares[-3], rate)
            move(net.output, hidden.T @ delta, squares[-2], rate)
            move(net.offset, delta.sum(axis=0), squares[-1], rate)
    net.prepare()
    return net


def classify(net: ByteNet, texts: list[str | None], most: int = 2048) -> tuple[list[str], list[float]]:
    """Language and probability of each text; windows go through the network `most` at a time."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    sums = np.zeros((len(texts), len(net.langs)))
    counts = np.zeros(len(texts))
    waiting: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if held:
            rows, owner = np.concatenate(waiting), np.concatenate(owners)
            for at in range(0, len(rows), 128):
                np.add.at(sums, owner[at : at + 128], net.log_probabilities(rows[at : at + 128]))
            np.add.at(counts, owner, 1)
        waiting.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        if not net.langs or text is None or not _LETTER.search(text):
            continue
        own = windows_of(text)
        for at in range(0, len(own), most):
            waiting.append(own[at : at + most])
            owners.append(np.full(len(waiting[-1]), i))
            held += len(waiting[-1])
            if held >= most:
                flush()
    flush()
    for i in np.flatnonzero(counts):
        mean = sums[i] / counts[i]
        p = np.exp(mean - mean.max())
        k = int(p.argmax())
        names[i], scores[i] = net.langs[k], float(p[k] / p.sum())
    return names, scores


def predict_languages(
    docs: DataFrame, taught: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score. `taught` holds the rows to learn from.

    The fit takes at most `fit_rows` rows of each language, those with the smallest hash of their id, with text and
    a language, and from each FIT_PARTS windows drawn over its whole text; every whole text is predicted. Null texts and texts without a letter are `und` with score 0, as is
    everything where nothing is taught. Rows that repeat are predicted alike; no rows give no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = taught.select(F.xxhash64(F.col(id_col), F.lit(1)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # A bound on the hash, from the number of a language's rows, leaves little more than the fit takes before rows are ranked.
    share = F.least(F.lit(1.0), (1.1 * fit_rows + 100) / F.count(F.lit(1)))
    shares = hinted(store(rows.groupBy("lang").agg(share.alias("share")), "language_shares"), 64)
    few = match(rows, shares, ["lang"]).filter(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [[w.tobytes() for w in teaching_windows(t)] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drawn, pa.list_(pa.binary()))], names=["lang", "h", "windows"])

    drawn = few.select("lang", "h", "text").mapInArrow(draw, "lang string, h long, windows array<binary>")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "windows"))
    sample = drawn.withColumn("rank", rank).filter(F.col("rank") <= fit_rows)
    pairs = [(bytes(w), r["lang"]) for r in sample.orderBy("lang", "rank").collect() for w in r["windows"]]
    trained = train_net([w for w, _ in pairs], [x for _, x in pairs])
    net = spark.sparkContext.broadcast(trained)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = classify(net.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
