"""Items bought near each other in sequences, summed item by item without a shuffle of all pairs.

A sequence is cut in stretches, each stored with the positions before and after
it.  Items are dealt to parts; a purchase goes to its item's part once, with its
neighbours packed side by side at as few bytes each as they need, and pairs are
made only there.  Parts are taken in a few passes, one after the other, and what
one has shuffled goes before the next begins: on disk lies one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Pairs of a part, and pairs that a task packs or sums at a time, about.
PART_PAIRS = 2_000_000
#: Parts of a pass at least, and passes at most.
PASS_PARTS = 64
PASSES = 8
#: Stands for an item that is NULL.
_NONE = -(1 << 63)
_MESSAGE = "to int, arts binary, scales binary, back binary, ahead binary, least long, width int, others binary"


def ranged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def packed(x: np.ndarray) -> tuple[int, int, bytes]:
    """The least of some integers, the bytes that their distances from it need, and these, the lowest of all first."""
    least = int(x.min()) if len(x) else 0
    far = x.view(np.uint64) - np.uint64(least & (2**64 - 1))
    width = max(1, (int(far.max()).bit_length() + 7) // 8) if len(x) else 1
    return least, width, far.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(least: int, width: int, data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    far = np.zeros((planes.shape[1], 8), np.uint8)
    far[:, :width] = planes.T
    return (far.view(np.uint64).ravel() + np.uint64(least & (2**64 - 1))).view(np.int64)


def part_of(items: np.ndarray, parts: int) -> np.ndarray:
    mixed = items.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def summed(art: np.ndarray, other: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``x`` by (art, other), in their order."""
    if not len(art):
        return art, other, x
    a, b = int(art.min()), int(other.min())
    wide = int(other.max()) - b + 1
    if (int(art.max()) - a + 1) * wide < 1 << 62:
        order = np.argsort((art - a) * wide + (other - b))
    else:
        order = np.lexsort((other, art))
    art, other, x = art[order], other[order], x[order]
    first = np.flatnonzero(np.concatenate([[True], (art[1:] != art[:-1]) | (other[1:] != other[:-1])]))
    return art[first], other[first], np.add.reduceat(x, first)


class Sums:
    """Sums by (art, other) of rows that come bit by bit; runs of like size are merged, so each row is in few merges."""

    def __init__(self):
        self.runs: list = []
        self.rows: list = []
        self.waiting = 0

    def add(self, art: np.ndarray, other: np.ndarray, x: np.ndarray) -> None:
        self.rows.append((art, other, x))
        self.waiting += len(art)
        if self.waiting >= PART_PAIRS:
            self._settle()

    def _settle(self) -> None:
        if self.rows:
            self.runs.append(summed(*map(np.concatenate, zip(*self.rows, strict=True))))
            self.rows, self.waiting = [], 0
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) >= len(self.runs[-2][0]):
            self._merge()

    def _merge(self) -> None:
        b, a = self.runs.pop(), self.runs.pop()
        self.runs.append(summed(*map(np.concatenate, zip(a, b, strict=True))))

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        self._settle()
        while len(self.runs) > 1:
            self._merge()
        return self.runs[0] if self.runs else None


def best(art: np.ndarray, other: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of each art with the highest ``x`` rounded to eight places, then the least other; rows are in order of both."""
    r = np.round(x, 8)
    first = np.flatnonzero(np.concatenate([[True], art[1:] != art[:-1]]))
    size = np.diff(np.append(first, len(art)))
    most, least = np.maximum.reduceat(r, first), np.full(len(first), -np.inf)
    open_ = size > k
    for share in (0.7, 0.45, 0.25, 0.1, 0.03, 0.01):  # a bound that k rows reach leaves only those below it out
        bound = np.where(open_, most * share, least)
        reached = np.add.reduceat(r >= np.repeat(bound, size), first, dtype=np.int64) >= k
        least, open_ = np.where(open_ & reached, bound, least), open_ & ~reached
    kept = np.flatnonzero(r >= np.repeat(least, size))
    kept = kept[np.lexsort((other[kept], -r[kept], art[kept]))]
    own = art[kept]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    kept = kept[place < k]
    return art[kept], other[kept], x[kept]


def _stretches(sequences: DataFrame, key: str, order: list[str], item: str, reach: int) -> DataFrame:
    """(n, before, many, items): each sequence's length and its stretches of ``reach`` positions, ``many`` of them, with those next to it, ``before`` of them before it."""
    whole = Window.partitionBy(key)
    seq = sequences.where(F.col(key).isNotNull()).withColumn("_pos", F.row_number().over(whole.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    seq = seq.where("_n > 1").withColumn("_stretch", F.floor(F.col("_pos") / reach))
    item = F.coalesce(F.col(item).cast("long"), F.lit(_NONE))
    own = seq.groupBy(key, "_stretch").agg(F.first("_n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_pos", item.alias("_item")))), lambda x: x["_item"]).alias("_own"))
    near, none = whole.orderBy("_stretch"), F.array().cast("array<long>")
    own = own.withColumn("_left", F.coalesce(F.lag("_own").over(near), none)).withColumn("_right", F.coalesce(F.lead("_own").over(near), none))
    return own.select("n", F.size("_left").alias("before"), F.size("_own").alias("many"), F.concat("_left", "_own", "_right").alias("items"))


def _messages(reach: int, parts: int, passes: int, number: int) -> Callable:
    """Stretches in, for each part of pass ``number`` its purchases with their neighbours out."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, before, many = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "before", "many"))
            lists = batch.column("items")
            at, values = lists.offsets.to_numpy().astype(np.int64), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), np.int64)
            own, row = ranged(at[:-1] + before, many), np.repeat(np.arange(len(n)), many)
            part = part_of(values[own], parts)
            mine = np.flatnonzero(part % passes == number)
            mine = mine[np.argsort(part[mine], kind="stable")]
            own, row, part = own[mine], row[mine], part[mine] // passes
            low, high = np.maximum(at[row], own - reach), np.minimum(at[row + 1], own + reach + 1)
            scale = 1 / np.log(1.0 + n[row])
            chunk = np.cumsum(high - low) // PART_PAIRS
            cut = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (chunk[1:] != chunk[:-1])])) if len(own) else []
            for a, b in zip(cut, np.append(cut[1:], len(own)), strict=True) if len(own) else ():
                arts = values[own[a:b]]
                least, width, others = packed(values[ranged(low[a:b], (high - low)[a:b])])
                back, ahead = ((x[a:b]).astype(np.int32).tobytes() for x in (own - low, high - own - 1))
                row_ = [int(part[a]), arts.tobytes(), scale[a:b].tobytes(), back, ahead, least, width, others]
                names = ["to", "arts", "scales", "back", "ahead", "least", "width", "others"]
                kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int32(), pa.binary()]
                yield pa.record_batch([pa.array([x], kind) for x, kind in zip(row_, kinds, strict=True)], names)

    return made


def _lists(weights: np.ndarray, reach: int, k: int) -> Callable:
    """Messages of a part in, for each of its items the best others out."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for m in batch.to_pylist():
                back, ahead = np.frombuffer(m["back"], np.int32).astype(np.int64), np.frombuffer(m["ahead"], np.int32)
                size = back + 1 + ahead
                gap = ranged(-back, size)
                others = unpacked(m["least"], m["width"], m["others"])
                x = weights[gap + reach] * np.repeat(np.frombuffer(m["scales"]), size)
                real = gap != 0
                sums.add(np.repeat(np.frombuffer(m["arts"], np.int64), size)[real], others[real], x[real])
        if found := sums.all():
            art, other, x = best(*found, k)
            first = np.flatnonzero(np.concatenate([[True], art[1:] != art[:-1]]))
            offsets = pa.array(np.append(first, len(art)), pa.int32())
            yield pa.record_batch([pa.array(art[first]), pa.ListArray.from_arrays(offsets, pa.array(other)), pa.ListArray.from_arrays(offsets, pa.array(x))], ["art", "others", "sims"])

    return made


def nearest(sequences: DataFrame, key: str, order: list[str], item: str, weights: np.ndarray, k: int) -> DataFrame:
    """(art, others, sims): for each item the ``k`` others of the largest sums, rounded to eight places for the order, ties by the least.

    Two positions of a sequence at most ``reach`` apart, where ``weights`` has
    2 * reach + 1 numbers, add weights[reach + distance] / ln(1 + length) for
    the first as art and the second as other.  Items are integers.
    """
    reach, spark = len(weights) // 2, sequences.sparkSession
    kind = sequences.schema[item].dataType
    seq = written(_stretches(sequences, key, order, item, reach))
    pairs = seq.agg(F.sum(F.col("many").cast("long") * F.least(F.size("items") - 1, F.lit(2 * reach)))).first()[0] or 0
    parts = max(1, -(-pairs // PART_PAIRS))
    passes = max(1, min(PASSES, parts // PASS_PARTS))
    found = []
    for number in range(passes):
        own = max(1, -(-(parts - number) // passes))
        messages = seq.mapInArrow(_messages(reach, parts, passes, number), _MESSAGE)
        lists = messages.repartitionById(own, "to").mapInArrow(_lists(weights, reach, k), "art long, others array<long>, sims array<double>")
        found.append(written(lists))
    dropped(seq)
    out = spark.read.schema(found[0].schema).parquet(*[t._scratch for t in found])
    back = lambda x: F.nullif(x, F.lit(_NONE)).cast(kind)
    return out.select(back(F.col("art")).alias("art"), F.transform("others", back).alias("others"), "sims")
