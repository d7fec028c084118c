"""Exact nearest neighbours by cosine, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_per

#: Vectors of one block of queries and of one slice of the vectors searched.
BLOCK, SLICE = 1024, 8192
#: Decimals of a similarity; equal ones are ranked by id.
PLACES = 5


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """(id, other, sim, rank): the k rows most similar to each query, itself (the same id) left out.

    Every block of queries meets every slice of rows once in one task of
    bounded size, which keeps its best k; those are ranked per query.  NULL and
    all-zero vectors have no direction and match nothing.  Ids must be
    unique and vectors of one length.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    blocks = max(1, -(-queries.count() // BLOCK))
    slices = max(1, -(-rows.count() // SLICE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"), place(blocks).alias("_block"), every(slices).alias("_slice"))
    r = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"), every(blocks).alias("_block"), place(slices).alias("_slice"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["_id"][:0], "other": b["_id"][:0], "sim": np.zeros(0)})
        sim = np.round(_unit(a["_v"]) @ _unit(b["_v"]).T, PLACES)
        left, right = a["_id"].to_numpy(), b["_id"].to_numpy()
        sim[left[:, None] == right[None, :]] = np.nan
        out = []
        for i in range(len(left)):
            order = np.lexsort((right, -sim[i]))[:k]  # NaN comes last
            order = order[~np.isnan(sim[i][order])]
            out.append(pd.DataFrame({"id": left[i], "other": right[order], "sim": sim[i][order]}))
        return pd.concat(out, ignore_index=True)

    found = q.groupBy("_block", "_slice").cogroup(r.groupBy("_block", "_slice")).applyInPandas(best, f"id {kind}, other {kind}, sim double")
    return top_per(found, ["id"], [F.col("sim").desc(), F.col("other")], k).withColumnRenamed("id", id_col)
