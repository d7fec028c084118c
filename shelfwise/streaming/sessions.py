"""Sessions of a stream with state and timers of their own.

Keys are dealt to groups.  Per group the operator keeps the sessions still open
as one table, and one timer for the moment the first of them is over.  Rows
merge into the sessions they fall near to, in any order within the watermark;
when the watermark passes the timer, all sessions that are over by then are
given once and their state goes.  So a batch asks the state store a few times a
group, not a few times a session.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import scratch
from .windows import reader

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a table that share a group, about.
GROUP_ROWS = 4_000
_SPAN = ["first", "last", "n", "value"]
Span = tuple[int, int, int, float]


def joined(table: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Spans (key, first, last, n, value), in microseconds, made one where less than ``gap`` lies between two of a key."""
    if not len(table):
        return table
    code, first, last = pd.factorize(table["key"])[0], table["first"].to_numpy(), table["last"].to_numpy()
    order = np.lexsort((first, code))
    code, first, last = code[order], first[order], last[order]
    reached = pd.Series(last).groupby(code).cummax().to_numpy()
    at = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (first[1:] - reached[:-1] >= gap)]))
    total = lambda c: np.add.reduceat(table[c].to_numpy()[order], at)
    return pd.DataFrame({"key": table["key"].to_numpy()[order][at], "first": first[at], "last": np.maximum.reduceat(last, at), "n": total("n"), "value": total("value")})


def rows_as_spans(key: pd.Series | int, times: pd.Series, values: pd.Series) -> pd.DataFrame:
    t = times.to_numpy(np.int64)
    return pd.DataFrame({"key": key if np.isscalar(key) else key.to_numpy(), "first": t, "last": t, "n": np.ones(len(t), np.int64), "value": values.fillna(0.0).to_numpy(np.float64)})


def _tuples(table: pd.DataFrame) -> list[Span]:
    return [(int(a), int(b), int(n), float(x)) for a, b, n, x in table[_SPAN].itertuples(index=False)]


def spans(times: pd.Series, values: pd.Series, gap: int) -> list[Span]:
    """(first, last, rows, sum) of each run of times, in microseconds, less than ``gap`` apart."""
    return _tuples(joined(rows_as_spans(0, times, values), gap))


def merged(open_: list[Span], new: list[Span], gap: int) -> list[Span]:
    """Sessions of both lists, joined where less than ``gap`` lies between."""
    return _tuples(joined(pd.DataFrame([*open_, *new], columns=_SPAN).assign(key=0), gap))


class Sessions(StatefulProcessor):
    """Rows (group, key, t, v, end) in, (key, first, last, n, value) of finished sessions out; times in microseconds."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "spans binary")

    def _over(self, table: pd.DataFrame) -> np.ndarray:
        """The milliseconds at which sessions are over."""
        return -(-(table["last"].to_numpy() + self.gap) // 1000)

    def _held(self) -> pd.DataFrame | None:
        if not self.open.exists():
            return None
        with pa.ipc.open_stream(bytes(self.open.get()[0])) as stored:
            return stored.read_pandas()

    def _keep(self, before: pd.DataFrame | None, held: pd.DataFrame, fired: int | None = None) -> None:
        """Store what is open, and move the timer to where the first of it is over."""
        was = None if before is None else int(self._over(before).min())
        now = int(self._over(held).min()) if len(held) else None
        if len(held):
            table = pa.Table.from_pandas(held, preserve_index=False)
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), table.schema) as out:
                out.write_table(table)
            self.open.update((sink.getvalue().to_pybytes(),))
        else:
            self.open.clear()
        if was != now:
            if was is not None and was != fired:
                self.handle.deleteTimer(was)
            if now is not None:
                self.handle.registerTimer(now)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [pdf[~pdf["end"].astype(bool)] for pdf in rows]
        new = [rows_as_spans(pdf[self.key], pdf["t"], pdf["v"]) for pdf in new if len(pdf)]
        if new:
            before = self._held()
            self._keep(before, joined(pd.concat([*([] if before is None else [before]), *new], ignore_index=True), self.gap))
        yield self._given(None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        moment, before = expiredTimerInfo.getExpiryTimeInMs(), self._held()
        done = None
        if before is not None:
            over = self._over(before) <= max(moment, timerValues.getCurrentWatermarkInMs())
            done = before[over]
            if len(done):
                self._keep(before, before[~over], moment)
        yield self._given(done)

    def _given(self, done: pd.DataFrame | None) -> pd.DataFrame:
        if done is None:
            done = pd.DataFrame({"key": pd.Series(dtype=object), "first": pd.Series(dtype="int64"), "last": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "value": pd.Series(dtype="float64")})
        return done.rename(columns={"key": self.key})

    def close(self) -> None:
        pass


@contextmanager
def _with_timers(spark: SparkSession):
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def finished(stream: DataFrame, key: str, time: str, value: str, gap: int, late: str, end: str | None = None, groups: int = 256) -> DataFrame:
    """(key, first, last, n, value) of the sessions of a stream, each once it is over by the watermark.

    ``gap`` is in microseconds; rows behind the watermark (the latest time seen
    less ``late``) are left out.  ``end`` names a boolean column of rows that
    only move time on.  A NULL value adds nothing, a row without a time is left
    out, and a NULL key has sessions like any other.  The state of a group of
    keys is read and written at once, so ``groups`` should grow with the stream.
    """
    rows = stream.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late).where(F.col("_ts").isNotNull())
    marks = F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)
    rows = rows.select(F.to_json(F.struct(key)).alias("key"), F.unix_micros("_ts").alias("t"), F.col(value).cast("double").alias("v"), marks.alias("end"), "_ts")
    # pandas gets no names that begin with _, and as text the key is never NULL, which pandas would make other keys of its batch inexact for
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    out = rows.groupBy("group").transformWithStateInPandas(Sessions("key", gap), "key string, first long, last long, n long, value double", "Append", "EventTime")
    kind = f"`{key}` {stream.schema[key].dataType.simpleString()}"
    return out.select(F.from_json("key", kind)[key].alias(key), "first", "last", "n", "value")


def in_order(events: DataFrame, time: str, slices: int) -> tuple[str, float]:
    """Write ``events`` as files by time, ``slices`` equal stretches one after the other, then one row that is past them all.

    Gives the folder and a slice's seconds.  The column ``_end`` marks the last row.
    """
    path = scratch(events.sparkSession)
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    first, last = first or 0, last or 0
    width = -(-(last - first + 1) // slices)
    for k in range(slices):
        mine = events.where((F.least(F.floor((seconds - first) / width), F.lit(slices - 1)) == k) | (seconds.isNull() & (F.lit(k) == 0)))
        mine.withColumn("_end", F.lit(False)).write.mode("append").parquet(path)
    beyond = F.timestamp_micros(F.lit(last + 4 * (last - first) + 400 * 86_400_000_000))
    columns = [(beyond if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
    events.sparkSession.range(1).select(*columns, F.lit(True).alias("_end")).coalesce(1).write.mode("append").parquet(path)
    return path, width / 1e6


def run(stream: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Run a stream of ``finished`` until its input is used up: all rows it gave, and what each batch reported."""
    spark, work = stream.sparkSession, scratch(stream.sparkSession)
    with _with_timers(spark):
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{work}/state").format("parquet").option("path", f"{work}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out"), [p for p in query.recentProgress]


def replayed(spark: SparkSession, path: str, key: str, time: str, value: str, gap: int, slices: int = 4, files: int | None = None) -> tuple[DataFrame, list[dict]]:
    """All sessions of a Parquet table, from a stream over its rows by time; rows may come in any order within a slice, of which a batch takes some ``files``, or about all."""
    events = spark.read.parquet(path)
    folder, seconds = in_order(events, time, slices)
    files = files or max(8, -(-len(spark.read.parquet(folder).inputFiles()) // slices))
    groups = max(256, events.count() // GROUP_ROWS)
    return run(finished(reader(spark, folder, files), key, time, value, gap, f"{int(seconds) + 1} seconds", "_end", groups))
