"""Near duplicates by SimHash fingerprints, searched by the general pigeonhole principle.

The 64 bits are grouped into parts of correlated bits. If two fingerprints differ in at most `most` bits and each part
is given some of `most + 1` units, then in some part with u > 0 units they differ in at most u - 1 bits. Every
fingerprint gives its units to the parts by dynamic programming on the candidates that it must expect there, and
probes a part's index with all values within u - 1 bits of its own; a part without units is not probed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import body, hinted, match, short_batches, store
from isohyet.llm.components import components
from isohyet.llm.probing import probed

BITS, WORDS, SEED = 64, 3, 42
MOST = 2
#: Numbers of parts to choose from; more parts are probed less often and hold more candidates.
PARTS = (2, 3, 4)
#: Bits of a part whose joint distribution is counted; such pieces are taken as independent.
PIECE = 8
#: Cost of one probe, in candidates.
PROBE = 1.0
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """Majority of the bits of the hashes of all word shingles; no words give zero. `lower` and `split` know ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    size, joined = min(WORDS, len(words)), b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=len(words) - size + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a long. Null texts count as empty."""

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).cast("binary").alias("text")).mapInArrow(all_, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(fps: DataFrame, table) -> np.ndarray:
    """Sum over all fingerprints of `table` (an array of counts per batch), added up in Spark; one number per cell is collected."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = table(batch.column(0).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.ravel()[cells], pa.int64())], names=["cell", "n"])

    out = np.zeros(table(np.zeros(0, dtype=np.int64)).shape, dtype=np.int64)
    for row in fps.select("fp").mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out.flat[row["cell"]] = row["n"]
    return out


def bit_groups(both: np.ndarray, count: int, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of (nearly) equal size: each starts with the most correlated pair left and takes the bit most
    correlated with it. `both` counts how often two bits are set together, its diagonal each bit alone."""
    share = both / max(count, 1)
    alone = np.diag(share)
    spread = np.sqrt(np.maximum(np.outer(alone * (1 - alone), alone * (1 - alone)), 1e-18))
    related = np.round(np.abs(share - np.outer(alone, alone)) / spread, 9)
    np.fill_diagonal(related, 0.0)
    left, out = list(range(BITS)), []
    for part in range(parts):
        size = BITS // parts + (part < BITS % parts)
        if size >= len(left):
            out.append(left)
            break
        group = list(max(combinations(left, 2), key=lambda p: (related[p], -p[0], -p[1])))
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: (related[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        out.append(group)
    return out


def _distances(piece: np.ndarray, most: int) -> np.ndarray:
    """Probability of each distance 0..most to a draw, for every value of one piece; `piece` holds the values' shares."""
    codes = np.arange(len(piece))
    away = np.bitwise_count(codes[:, None] ^ codes[None, :])
    return np.stack([(away == d) @ piece for d in range(most + 1)], axis=1)


@dataclass
class Layout:
    """Groups of bits, and for each the shares and distances of its pieces' values."""

    groups: list[list[int]]
    pieces: list[list[tuple[np.ndarray, np.ndarray]]]
    count: int
    most: int

    def values(self, bits: np.ndarray) -> list[np.ndarray]:
        return [bits[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) for g in self.groups]

    def costs(self, values: list[np.ndarray] | None) -> np.ndarray:
        """Expected cost of each part by units: probes and the candidates they meet, per fingerprint or for two draws."""
        rows = len(values[0]) if values else 1
        out = np.zeros((rows, len(self.groups), self.most + 2))
        for i, (group, pieces) in enumerate(zip(self.groups, self.pieces, strict=True)):
            chance = np.zeros((rows, self.most + 1))
            chance[:, 0] = 1.0
            for k, (share, distances) in enumerate(pieces):
                here = distances[(values[i] >> (PIECE * k)) & (len(share) - 1)] if values else (share @ distances)[None, :]
                chance = np.stack([sum(chance[:, e] * here[:, d - e] for e in range(d + 1)) for d in range(self.most + 1)], axis=1)
            probes = np.cumsum([comb(len(group), d) for d in range(self.most + 1)])
            out[:, i, 1:] = PROBE * probes + self.count * np.cumsum(chance, axis=1)
        return out


def share_units(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units per part (rows, parts) of least total cost with as many units as the last column, and that cost."""
    rows, parts, levels = costs.shape
    least = np.full((rows, levels), np.inf)
    least[:, 0] = 0.0
    picks = []
    for i in range(parts):
        options = np.full((rows, levels, levels), np.inf)
        for total in range(levels):
            for mine in range(total + 1):
                options[:, total, mine] = least[:, total - mine] + costs[:, i, mine]
        picks.append(options.argmin(axis=2))
        least = options.min(axis=2)
    units, left = np.zeros((rows, parts), dtype=np.int64), np.full(rows, levels - 1)
    for i in reversed(range(parts)):
        units[:, i] = picks[i][np.arange(rows), left]
        left = left - units[:, i]
    return units, least[:, -1]


def plan(fps: DataFrame, most: int = MOST) -> Layout:
    """Of the numbers of parts in PARTS, the layout that costs two draws least. `fps` are distinct; the tables collected
    have at most 64 squared and 25 times 256 cells."""
    both = _summed(fps, lambda x: (lambda b: b.T @ b)(_bits(x).astype(np.int64)))
    count = int(fps.count())
    grouped = [bit_groups(both, count, parts) for parts in PARTS]
    places = [(i, g[k : k + PIECE]) for i, groups in enumerate(grouped) for g in groups for k in range(0, len(g), PIECE)]

    def histogram(x: np.ndarray) -> np.ndarray:
        bits = _bits(x).astype(np.int64)
        return np.stack([np.bincount(bits[:, p] @ (1 << np.arange(len(p))), minlength=1 << PIECE) for _, p in places])

    counts, layouts, at = _summed(fps, histogram), [], 0
    for groups in grouped:
        pieces = []
        for g in groups:
            sizes = [min(PIECE, len(g) - k) for k in range(0, len(g), PIECE)]
            shares = [counts[at + k, : 1 << s] / max(count, 1) for k, s in enumerate(sizes)]
            pieces.append([(share, _distances(share, most)) for share in shares])
            at += len(sizes)
        layouts.append(Layout(groups, pieces, count, most))
    return min(layouts, key=lambda layout: share_units(layout.costs(None))[1][0])


def _keys(fps: DataFrame, layout: Layout) -> DataFrame:
    """Per fingerprint: the keys under which it is found, one a part, and the keys that it probes."""
    masks = [[[sum(1 << b for b in c) for d in range(units) for c in combinations(range(len(g)), d)] for units in range(layout.most + 2)] for g in layout.groups]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = layout.values(_bits(batch.column(0).to_numpy(zero_copy_only=False)))
            units, _ = share_units(layout.costs(values))
            named = [(np.int64(i) << 40) + v for i, v in enumerate(values)]
            own = [list(k) for k in zip(*[n.tolist() for n in named], strict=True)]
            probes = [[k ^ m for i, k in enumerate(ks) for m in masks[i][u[i]]] for ks, u in zip(own, units.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.list_(pa.int64())) for x in (own, probes)]], names=["fp", "own", "probes"])

    return fps.mapInArrow(keys, "fp long, own array<long>, probes array<long>")


def linked_fingerprints(fps: DataFrame, most: int = MOST) -> DataFrame:
    """All pairs (a, b), a > b, of the distinct fingerprints in the stored table `fps` (fp) that differ in 1 to `most` bits.

    A fingerprint's probes alone find all its partners, so it reports the smaller ones only. A pair that meets under
    several keys is reported as often. Fingerprints have at most 2,080 neighbours in two bits: links need no cap.
    """
    keys = store(_keys(fps.select("fp"), plan(fps, most)), "simhash_keys")
    probes = keys.select(F.col("fp").alias("a"), F.explode("probes").alias("key"))
    index = keys.select(F.col("fp").alias("b"), F.explode("own").alias("key"))
    met = probed(probes, index, "simhash")
    return met.filter((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)).select("a", "b")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id, kept.

    A-Z count as a-z; shingles have three words, fewer words are one shingle, null, empty and blank texts have the
    fingerprint zero and are linked like any other. Rows of one fingerprint are one class; classes are searched, never
    their rows. component_id is the smallest id reachable; a null id is never it unless its whole component has none,
    and is kept only then. Rows that repeat are decided alike, an id with several texts has a row for each, long
    texts are hashed whole in chunks. No rows give no rows.
    """
    rows = store(fingerprints(docs, id_col, text_col), "simhash_rows")
    classes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash_classes")
    links = store(linked_fingerprints(classes, most), "simhash_links")
    labels = components(links).withColumnsRenamed({"id": "fp"})
    named = store(classes.join(labels, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("label")), "simhash_labels")
    least = store(named.groupBy("label").agg(F.min("rep").alias("component_id")), "simhash_least")
    found = store(named.join(hinted(least, 24), "label").select("fp", "component_id"), "simhash_components")
    return match(rows, hinted(found, 24), ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
