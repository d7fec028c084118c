"""Array functions for recommendation lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(x: Column) -> Column:
    return F.coalesce(x, F.array())


def layered_fill(layers: list[tuple[Column, int | None]], k: int = 12) -> Column:
    """The first k of several lists in turn, without repeats; a cap holds for what a layer adds."""
    out = F.array_distinct(layers[0][0])
    for layer, cap in layers[1:]:
        new = F.array_except(layer, out)
        out = F.concat(out, F.slice(new, 1, cap) if cap is not None else new)
    return F.slice(out, 1, k)


def interleave(first: Column, second: Column, fallback: Column, head: int = 6, k: int = 12) -> Column:
    return layered_fill([(F.slice(first, 1, head), None), (second, None), (fallback, None)], k)


def average_precision(predicted: Column, actual: Column, k: int = 12) -> Column:
    """Sum of hits so far over rank at each first hit, over min(|actual|, k); NULL without actual items."""
    top = F.slice(predicted, 1, k)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.array_contains(actual, x) & (F.array_position(top, x) == acc["i"] + 1)
        hits = acc["hits"] + hit.cast("int")
        return F.struct((acc["i"] + 1).alias("i"), hits.alias("hits"), (acc["sum"] + F.when(hit, hits / (acc["i"] + 1)).otherwise(0.0)).alias("sum"))

    return F.when(F.size(actual) > 0, F.aggregate(top, start, step, lambda acc: acc["sum"]) / F.least(F.size(actual), F.lit(k)))


def padded_ids(ids: Column, width: int = 10) -> Column:
    return F.array_join(F.transform(ids, lambda x: F.lpad(x.cast("string"), width, "0")), " ")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
