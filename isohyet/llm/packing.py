"""Best-fit decreasing packing of token sequences.

The order of best-fit decreasing depends on lengths alone, and a length is at most the capacity. So pieces are
counted by length (a table of at most `capacity` rows), the placement is worked out once per (length, remaining
capacity) with a segment tree over remaining capacities, and every piece finds its place from its rank among the
pieces of its length. The plan stays the same size however many pieces there are, and it is the global result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import body, short_batches, store

CAPACITY = 2048
END_ID = 0
#: Ranks of one length are counted in so many slices, so that a frequent length is no single window.
SLICES = 1024
#: Words whose ids one Python worker remembers; the store starts anew when full.
REMEMBERED = 600_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


#: Python splits at these, the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def divided(text: str) -> list[str]:
    """Words of a text. Where Python and the tokenizer agree for certain, also in lower case, as the tokenizer has them."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return BLANK.split(text)
    return BLANK.split(text) if any(c in text for c in SEPARATORS) else text.lower().split()


class WordIds:
    """Token ids of white-space-separated words as little-endian bytes.

    The tokenizer never joins what white space divides, so the ids of a text are those of its words, and each
    distinct word is tokenised once per worker. Unknown words go to the tokenizer together, with a separator
    whose id no other word gives; words that hold the separator go alone.
    """

    SEPARATOR = "|"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        (self.mark,) = self.ids(self.SEPARATOR)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, missing: set[str]) -> None:
        alone = [w for w in missing if self.SEPARATOR in w or "<|" in w]
        plain = list(missing.difference(alone))
        for word in alone:
            self.known[word] = np.array(self.ids(word), "<u4").tobytes()
        for at in range(0, len(plain), 4096):
            block = plain[at : at + 4096]
            ids = np.array(self.ids(f" {self.SEPARATOR} ".join(block)), "<u4")
            ends = [*np.flatnonzero(ids == self.mark), len(ids)]
            if len(ends) != len(block):
                raise ValueError("separator met inside a word")
            start = 0
            for word, end in zip(block, ends, strict=True):
                self.known[word] = ids[start:end].tobytes()
                start = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [divided(t) for t in texts]
        missing = set().union(*split).difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = set().union(*split)
        if missing:
            self.learn(missing)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process and vocabulary."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def cut(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` tokens of each text followed by the end id: doc_id, piece, start, length, ids_crc32."""
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 64):
                out = []
                for doc, coded in zip(ids[at : at + 64], coder.encode(texts[at : at + 64]), strict=True):
                    coded += end
                    for k, start in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[start : start + 4 * capacity]
                        out.append((doc, k, start // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text")).mapInArrow(pieces, PIECES)


class OpenBins:
    """Numbers of open bins by remaining capacity, in a segment tree of which each node tells whether it has any."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, count: int) -> None:
        self.bins.setdefault(room, []).append((first, count))
        self._mark(room, True)

    def take(self, room: int) -> list[tuple[int, int]]:
        self._mark(room, False)
        return self.bins.pop(room)

    def _mark(self, room: int, value: bool) -> None:
        node = room + self.size
        self.some[node] = value
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least `length` that an open bin has, in logarithmic time."""
        node = length + self.size
        if self.some[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, offset, pieces per bin), by length and first rank.

    The pieces of a run fill equal bins one after the other: a bin takes as many as fit, because after one piece
    it is still the tightest. Bins of equal remaining capacity are alike, so each run costs one tree search.
    """
    tree, runs, bins = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank, back = counts[length], 0, []
        while left:
            room = tree.tightest(length)
            groups = tree.take(room) if room is not None else [(bins, -(-left // (capacity // length)))]
            if room is None:
                bins += groups[0][1]
                room = capacity
            per = room // length
            for first, count in groups:
                full, rest = min(count, left // per), 0
                if full:
                    runs.append((length, rank, first, capacity - room, per))
                    back.append((room - per * length, first, full))
                    rank, left = rank + full * per, left - full * per
                if full < count and left:
                    rest = left
                    runs.append((length, rank, first + full, capacity - room, per))
                    back.append((room - rest * length, first + full, 1))
                    rank, left, full = rank + rest, 0, full + 1
                if full < count:
                    back.append((room, first + full, count - full))
        for room, first, count in back:
            if room:
                tree.put(room, first, count)
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY, slices: int = SLICES) -> DataFrame:
    """Add sequence_id and offset to stored pieces."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(best_fit_decreasing(counts, capacity))
    # Position of a piece: where its length starts in a line of all pieces, plus its rank in the length.
    starts, total = {}, 0
    for length in sorted(counts):
        starts[length] = total
        total += counts[length]
    table = np.array(runs or [(0, 0, 0, 0, 1)], dtype=np.int64)
    plan = spark.sparkContext.broadcast((np.array([starts.get(r[0], 0) + r[1] for r in table]), table, starts))

    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    before = sliced.groupBy("length", "__slice").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(
        "length", "__slice", (F.sum("n").over(Window.partitionBy("length").orderBy("__slice")) - F.col("n")).alias("__before")
    )
    inside = F.row_number().over(Window.partitionBy("length", "__slice").orderBy("doc_id", "piece"))
    ranked = sliced.withColumn("__inside", inside).join(before, ["length", "__slice"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__inside") - 1)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, table, starts = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            base = np.array([starts[x] for x in length.tolist()], dtype=np.int64)
            run = table[np.searchsorted(positions, base + rank, side="right") - 1]
            step = rank - run[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(run[:, 2] + step // run[:, 4]), pa.array(run[:, 3] + step % run[:, 4] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "__rank").mapInArrow(locate, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pack all texts into sequences of at most `capacity` tokens: one row per piece with its sequence and offset.

    Null and empty texts are the end id alone. Only texts longer than a sequence are cut. Rows that repeat an id
    are packed each; equal lengths are interchangeable and ordered by id and piece. No rows give no rows.
    """
    return place(store(cut(docs, vocabulary, id_col, text_col, capacity), "pieces"), capacity)
