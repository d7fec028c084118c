"""Nearest neighbours by an index of inverted lists.

Centroids are fitted on a bounded sample; every vector of the table lies in the
list of its nearest centroid, in chunks of bounded size.  A query looks into the
lists of its nearest centroids only, so what it reads is a share of the table;
the similarities found there are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranking import top_per
from .vectors import PLACES, _unit

#: Rows that centroids are fitted on, at most, and centroids, at most.
SAMPLE, LISTS = 50_000, 1_024
#: Vectors of a chunk of a list, and queries of a block.
CHUNK, BLOCK = 8_192, 1_024
#: Queries on which the number of lists to look into is measured, at most.
TRIED = 200


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors, by spherical k-means; lists that run empty start again at the vector worst served."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        sim = sample @ centers.T
        own = sim.argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        worst = np.argsort(sim[np.arange(len(sample)), own])
        empty = np.flatnonzero(np.bincount(own, minlength=len(centers)) == 0)
        sums[empty] = sample[worst[: len(empty)]]
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centers = np.where(length > 0, sums / np.maximum(length, 1e-300), centers)
    return centers


def _likeness(unit: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Cosines of vectors and centroids; one list for all where there are no centroids."""
    return unit @ centers.T if len(centers) else np.zeros((len(unit), 1))


@dataclass
class Index:
    """``blocks`` (_list, _chunk, ids, matrix) of all vectors with a direction, ``rows`` of them; and the centroids."""

    blocks: DataFrame
    centroids: np.ndarray
    id_col: str
    kind: str

    def search(self, queries: DataFrame, vector: str, k: int, probes: int) -> DataFrame:
        """(id, other, sim, rank): of the vectors in each query's ``probes`` nearest lists the k most similar, itself left out; equal ones by id."""
        centers, id_col, kind = self.centroids, self.id_col, self.kind

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                unit = _unit(pdf["_v"])
                some = ~np.isnan(unit).any(1)
                ids, unit = pdf["_id"].to_numpy()[some], unit[some]
                if len(ids):
                    lists = np.argsort(-_likeness(unit, centers), axis=1, kind="stable")[:, :probes]
                    n = lists.shape[1]
                    yield pd.DataFrame({"_list": lists.ravel(), "_id": np.repeat(ids, n), "_v": [v.tobytes() for v in np.repeat(unit, n, 0)]})

        asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
        asked = written(asked.mapInPandas(near, f"_list long, _id {kind}, _v binary"))
        sizes = asked.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))  # at most LISTS rows
        asked = asked.join(F.broadcast(sizes), "_list").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
        asked = asked.groupBy("_list", "_block").agg(F.collect_list(F.struct("_id", "_v")).alias("_q")).select("_list", F.col("_q._id").alias("asked"), F.col("_q._v").alias("_vs"))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    left, right = np.asarray(row.asked), np.asarray(row.ids)
                    sim = np.round(np.stack([np.frombuffer(v) for v in row.unit]) @ np.frombuffer(row.matrix).reshape(len(right), -1).T, PLACES)
                    sim[left[:, None] == right[None, :]] = np.nan
                    for i in range(len(left)):
                        order = np.lexsort((right, -sim[i]))[:k]  # NaN comes last
                        order = order[~np.isnan(sim[i][order])]
                        if len(order):
                            yield pd.DataFrame({"id": left[i], "other": right[order], "sim": sim[i][order]})

        met = asked.withColumnRenamed("_vs", "unit").join(self.blocks, "_list").select("asked", "unit", "ids", "matrix")
        found = met.mapInPandas(best, f"id {kind}, other {kind}, sim double")
        return top_per(found, ["id"], [F.col("sim").desc(), F.col("other")], k).withColumnRenamed("id", id_col)


    def probes_for(self, queries: DataFrame, vector: str, k: int, target: float = 0.95, sample: int = TRIED) -> int:
        """How many lists to look into for a recall of ``target``: of at most ``sample`` queries, chosen by a hash of their id, all lists are searched, and where their neighbours were found is counted."""
        total = queries.count()
        some = queries.where(F.pmod(F.xxhash64(self.id_col), F.lit(1_000_000)) < int(min(1.0, 2 * sample / max(1, total)) * 1_000_000)).limit(sample).select(self.id_col, vector)
        some = written(some)
        best = self.search(some, vector, k, max(1, len(self.centroids)))
        where = self.blocks.select("_list", F.explode("ids").alias("other"))
        pairs = best.join(where, "other").join(some, self.id_col).select(vector, "_list").toPandas()  # at most sample x k rows
        if not len(pairs) or not len(self.centroids):
            return 1
        order = np.argsort(-_likeness(_unit(pairs[vector]), self.centroids), axis=1, kind="stable")
        place = np.sort((order == pairs["_list"].to_numpy()[:, None]).argmax(1))
        return int(place[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)]) + 1


def build(rows: DataFrame, id_col: str, vector: str, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """Index all ``rows``; ids are unique integers and vectors of one length.

    Centroids (by default the root of the number of rows, at most LISTS) are
    fitted on at most ``sample`` rows, chosen by a hash of their id.  NULL and
    all-zero vectors have no direction and are found by nothing.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    known = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    total = known.count()
    lists = min(lists or max(1, round(total**0.5)), LISTS)
    share = min(1.0, sample / max(1, total))
    picked = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample).toPandas()  # at most ``sample`` rows
    unit = _unit(picked["_v"]) if len(picked) else np.zeros((0, 1))
    unit = unit[~np.isnan(unit).any(1)]
    centers = fit_centroids(unit, lists) if len(unit) else np.zeros((0, 0))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = _unit(pdf["_v"])
            some = ~np.isnan(own).any(1)
            own = own[some]
            if len(own):
                yield pd.DataFrame({"_list": _likeness(own, centers).argmax(1), "_id": pdf["_id"].to_numpy()[some], "_v": [v.tobytes() for v in own]})

    placed = written(known.mapInPandas(listed, f"_list long, _id {kind}, _v binary"))
    sizes = placed.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_chunks"))  # at most LISTS rows
    placed = placed.join(F.broadcast(sizes), "_list").withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks")))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_list": pdf["_list"].iloc[:1], "_chunk": pdf["_chunk"].iloc[:1], "ids": [pdf["_id"].tolist()], "matrix": [b"".join(pdf["_v"])]})

    return Index(written(placed.groupBy("_list", "_chunk").applyInPandas(packed, f"_list long, _chunk long, ids array<{kind}>, matrix binary")), centers, id_col, kind)


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> float:
    """The share of the exact neighbours that were found."""
    both = exact.select(id_col, "other").join(found.select(id_col, "other"), [id_col, "other"], "left_semi")
    return both.count() / max(1, exact.count())
