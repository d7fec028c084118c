"""List-wise ranking: trees boosted on LambdaRank gradients.

Candidates are packed into blocks of whole lists, their features cut into bins.
For each level of a tree one Spark job adds up gradients and curvatures by node,
feature and bin; the sums, of a size that doesn't depend on the rows, come to the
driver, which chooses the splits.  Gradients are made where the rows are: of each
list's first ``depth`` places against all its rows, weighted by how much swapping
two of them would change the list's NDCG.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Rows of a block, and of the longest list that is ranked as one.
BLOCK_ROWS = 32_768
LIST_ROWS = 8_192
#: Bins of a feature; bin 0 holds NULL and what is not finite.
BINS = 64
#: Trees after which the scores so far are written with the rows.
REFRESH = 8


@dataclass
class Tree:
    """Nodes in breadth-first order: feature (-1 for a leaf), bin and threshold to go left at or below, left child, value."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def grown(self, node: int, feature: int, bin_: int, threshold: float, values: list[float]) -> Tree:
        """This tree with two leaves below ``node``."""
        out = Tree(np.append(self.feature, [-1, -1]), np.append(self.bin, [0, 0]), np.append(self.threshold, [0.0, 0.0]), np.append(self.left, [-1, -1]), np.append(self.value, values))
        out.feature[node], out.bin[node], out.threshold[node], out.left[node] = feature, bin_, threshold, len(self.feature)
        return out

    def leaf(self, columns: np.ndarray, at_or_below: np.ndarray) -> np.ndarray:
        """Node of each row of a feature matrix; ``at_or_below`` are the limits to compare with, by node."""
        node = np.zeros(len(columns), np.int64)
        while True:
            f = self.feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return node
            own = node[inner]
            goes_right = columns[inner, f[inner]] > at_or_below[own]  # NaN goes left
            node[inner] = self.left[own] + goes_right


@dataclass
class Ranker:
    features: list[str]
    trees: list[Tree] = field(default_factory=list)
    gain: np.ndarray = None

    def score(self) -> Column:
        """The score of a row, from its raw features."""
        trees = self.trees

        @F.pandas_udf("double")
        def total(frame: pd.DataFrame) -> pd.Series:
            x = frame.to_numpy(np.float64)
            x = np.where(np.isfinite(x), x, np.nan)
            return pd.Series(sum((t.value[t.leaf(x, t.threshold)] for t in trees), np.zeros(len(x))))

        return total(F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)]))

    def importances(self) -> dict[str, float]:
        """Each feature's share of the gain of all splits."""
        return dict(zip(self.features, (self.gain / max(self.gain.sum(), 1e-300)).tolist(), strict=True))


def gradients(score: np.ndarray, label: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """LambdaRank gradient and curvature of each row; rows of a list stand together, ``sizes`` long.

    Ranks follow the score, of equal scores the first row first.  A pair counts
    if its labels differ and one of the two is among the first ``depth``.
    """
    n, first = len(score), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    lists = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((np.arange(n), -score, lists))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n) - first[lists]
    discount = np.where(rank < depth, 1 / np.log2(rank + 2.0), 0.0)
    worth = np.exp2(label) - 1
    best = np.lexsort((-label, lists))
    place = np.arange(n) - first[lists]
    ideal = np.bincount(lists, np.where(place < depth, worth[best] / np.log2(place + 2.0), 0.0), len(sizes))

    g, h = np.zeros(n), np.zeros(n)
    for k in range(min(depth, int(sizes.max(initial=0)))):
        some = np.flatnonzero((sizes > k) & (ideal > 0))
        top = order[first[some] + k]  # the row at place k of each list
        mate = np.full(len(sizes), -1)
        mate[some] = top
        i = mate[lists]
        rows = np.flatnonzero((i >= 0) & (rank > k))  # each pair once, from its better place
        i, j = i[rows], rows
        rows = label[i] != label[j]
        i, j = i[rows], j[rows]
        up = np.where(label[i] > label[j], i, j)
        down = np.where(label[i] > label[j], j, i)
        weight = np.abs(worth[i] - worth[j]) * np.abs(discount[i] - discount[j]) / ideal[lists[i]]
        wrong = 1 / (1 + np.exp(np.clip(score[up] - score[down], -500, 500)))
        g += np.bincount(up, wrong * weight, n) - np.bincount(down, wrong * weight, n)
        curve = wrong * (1 - wrong) * weight
        h += np.bincount(up, curve, n) + np.bincount(down, curve, n)
    return g, h


def _rows(df: DataFrame, group: list[str], label: str, features: list[str]) -> DataFrame:
    """(_group, _label, f0, f1, ...): what training reads, written once."""
    numbers = [F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")).alias(f"f{i}") for i, f in enumerate(features)]
    return written(df.select(F.to_json(F.struct(*group)).alias("_group"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("_label"), *numbers))


def _edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Limits between the bins of each feature: distinct approximate quantiles, at most BINS - 2."""
    shares = F.array(*[F.lit(i / (BINS - 1)) for i in range(1, BINS - 1)])
    row = rows.agg(*[F.percentile_approx(f"f{i}", shares, 10_000).alias(f"f{i}") for i in range(width)]).first()
    return [np.unique(np.array(row[f"f{i}"] or [], np.float64)) for i in range(width)]


def _blocks(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(n, bins, label, sizes, base): rows of whole lists, packed; lists beyond LIST_ROWS are dealt to several."""
    names = [f"f{i}" for i in range(len(edges))]
    long_ = rows.groupBy("_group").count().where(F.col("count") > LIST_ROWS).select("_group", F.ceil(F.col("count") / LIST_ROWS).alias("_parts"))
    mixed = F.xxhash64("_label", *names, F.monotonically_increasing_id())
    dealt = rows.withColumn("_mix", mixed).join(long_, "_group", "left")
    dealt = dealt.withColumn("_list", F.concat_ws("|", F.coalesce(F.pmod("_mix", "_parts"), F.lit(0)), "_group"))
    parts = max(1, -(-rows.count() // BLOCK_ROWS))

    def packed(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        x = pdf[names].to_numpy(np.float64)
        bins = np.stack([np.where(~np.isfinite(x[:, i]), 0, np.searchsorted(e, x[:, i], "left") + 1) for i, e in enumerate(edges)], 1).astype(np.uint8)
        starts = np.flatnonzero(pdf["_list"].to_numpy() != pdf["_list"].shift().to_numpy())
        sizes = np.diff(np.append(starts, len(pdf)))
        return pd.DataFrame({"n": [len(pdf)], "bins": [bins.tobytes()], "label": [pdf["_label"].to_numpy(np.float64).tobytes()], "sizes": [sizes.astype(np.int64).tobytes()], "base": [bytes(8 * len(pdf))]})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, begun = [], 0, []
        for pdf in batches:
            if begun:
                pdf = pd.concat([*begun, pdf], ignore_index=True)
            open_ = pdf["_list"].to_numpy() == pdf["_list"].iloc[-1]  # may go on in the next batch
            begun, pdf = [pdf[open_]], pdf[~open_]
            held.append(pdf)
            size += len(pdf)
            if size >= BLOCK_ROWS:
                yield packed(held)
                held, size = [], 0
        if size or begun:
            yield packed([*held, *begun])

    dealt = dealt.select("_list", "_mix", "_label", *names).repartition(parts, "_list").sortWithinPartitions("_list", "_mix")
    return written(dealt.drop("_mix").mapInPandas(gather, "n long, bins binary, label binary, sizes binary, base binary"))


def _unpacked(row, width: int):
    bins = np.frombuffer(row.bins, np.uint8).reshape(-1, width)
    return bins, np.frombuffer(row.label), np.frombuffer(row.sizes, np.int64), np.frombuffer(row.base)


def _scores(bins: np.ndarray, base: np.ndarray, trees: list[Tree]) -> np.ndarray:
    return base + sum((t.value[t.leaf(bins, t.bin)] for t in trees), np.zeros(len(base)))


def _histograms(blocks: DataFrame, width: int, trees: list[Tree], growing: Tree, level: list[int], depth: int) -> np.ndarray:
    """(node of the level, feature, bin, [gradient, curvature, rows]) summed over all blocks."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(level), width, BINS, 3))
        for pdf in batches:
            for row in pdf.itertuples():
                bins, label, sizes, base = _unpacked(row, width)
                g, h = gradients(_scores(bins, base, trees), label, sizes, depth)
                place = np.full(len(growing.feature), -1)
                place[level] = np.arange(len(level))
                at = place[growing.leaf(bins, growing.bin)]
                own = np.flatnonzero(at >= 0)
                for f in range(width):
                    cell = at[own] * BINS + bins[own, f]
                    for k, v in enumerate((g[own], h[own], None)):
                        total[:, f, :, k] += np.bincount(cell, v, len(level) * BINS).reshape(len(level), BINS)
        cells = np.flatnonzero(total[..., 2].ravel())
        yield pd.DataFrame(np.column_stack([cells, total.reshape(-1, 3)[cells]]), columns=["cell", "g", "h", "n"]).astype({"cell": np.int64})

    sums = blocks.mapInPandas(summed, "cell long, g double, h double, n double").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n"))
    out = np.zeros((len(level) * width * BINS, 3))
    for cell, *values in sums.collect():  # at most nodes x features x bins
        out[cell] = values
    return out.reshape(len(level), width, BINS, 3)


def best_split(cells: np.ndarray, least: int, smooth: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of a node, from its (feature, bin, [gradient, curvature, rows])."""
    left = cells.cumsum(1)
    whole = left[:, -1:, :]
    right = whole - left
    value = lambda s: s[..., 0] ** 2 / (s[..., 1] + smooth)
    gain = value(left) + value(right) - value(whole)
    gain[(left[..., 2] < least) | (right[..., 2] < least)] = -np.inf
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def fit_ranker(
    df: DataFrame, group: list[str], label: str, features: list[str], trees: int = 20, levels: int = 4, rate: float = 0.1, depth: int = 12, least: int = 20, smooth: float = 0.1
) -> Ranker:
    """Boosted trees that order the rows of each ``group`` by ``label``.

    NULL, NaN and infinite features go left at every split, a NULL label counts as 0, rows
    with a NULL in the group columns make up a group like any other.  A list of
    more than LIST_ROWS rows is dealt to several at random, each of which is
    ranked for itself.  A table without rows, or whose lists have one label
    each, gives a ranker without trees.
    """
    width, model = len(features), Ranker(list(features), [], np.zeros(len(features)))
    rows = _rows(df, group, label, features)
    edges = _edges(rows, width)
    blocks, recent = _blocks(rows, edges), []
    dropped(rows)
    for number in range(trees):
        tree = Tree(np.array([-1]), np.array([0]), np.array([0.0]), np.array([-1]), np.array([0.0]))
        level = [0]
        for _ in range(levels):
            sums = _histograms(blocks, width, recent, tree, level, depth)
            below: list[int] = []
            for cells, node in zip(sums, level, strict=True):
                gain, f, b = best_split(cells, least, smooth)
                if gain > 1e-9:
                    model.gain[f] += gain
                    threshold = -np.inf if b == 0 else edges[f][b - 1]
                    left = cells[f, : b + 1].sum(0)
                    values = [rate * g / (h + smooth) for g, h, _ in (left, cells[f].sum(0) - left)]
                    below += [len(tree.feature), len(tree.feature) + 1]
                    tree = tree.grown(node, f, b, threshold, values)
            level = below
            if not level:
                break
        if tree.feature[0] < 0:
            break
        model.trees.append(tree)
        recent = [*recent, tree]
        if len(recent) == REFRESH and number + 1 < trees:
            blocks, recent = _refreshed(blocks, width, recent), []
    dropped(blocks)
    return model


def _refreshed(blocks: DataFrame, width: int, trees: list[Tree]) -> DataFrame:
    """The blocks with the scores of ``trees`` in their base."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                bins, _, _, base = _unpacked(row, width)
                yield pd.DataFrame({"n": [row.n], "bins": [row.bins], "label": [row.label], "sizes": [row.sizes], "base": [_scores(bins, base, trees).tobytes()]})

    out = written(blocks.mapInPandas(added, "n long, bins binary, label binary, sizes binary, base binary"))
    dropped(blocks)
    return out
