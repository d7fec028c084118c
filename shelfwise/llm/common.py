"""What the operators share: intermediate tables, batches of bounded size, words and their hashes."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"
#: Text that one numpy batch holds at a time.
BATCH_BYTES = 1 << 20
#: Text of a block, the unit in which per-document work meets corpus-wide tables.
BLOCK_BYTES = 8 << 20

_own_root: list[str] = []
#: While a table is written: what was shuffled to make it isn't needed after, and Python gets rows in small batches.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="shelfwise-"))
    return _own_root[0]


_scopes = threading.local()


def _where(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def passing_tables(spark: SparkSession):
    """Tables that shared_table writes inside go at the end; those written with ``keep`` stay, or go with a block around this one."""
    stack, own = _scopes.__dict__.setdefault("stack", []), []
    stack.append(own)
    try:
        yield
    finally:
        stack.remove(own)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where, store = _where(spark, path)
    store.delete(where, True)


def forget(table: DataFrame) -> None:
    """Delete a table of shared_table before Spark ends; any other frame is left alone."""
    path = getattr(table, "_written_to", None)
    if path:
        _delete(table.sparkSession, path)


def shared_table(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, and lets
    later steps read only the columns they need.  The files go when Spark ends,
    or with the passing_tables block in which they were written unless to be
    kept.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/shelfwise-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    where, store = _where(spark, path)
    store.deleteOnExit(where)
    stack = getattr(_scopes, "stack", [])[: -1 if keep else None]
    if stack:
        stack[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: Rows of a range partition of positions, about.
PART_ROWS = 250_000


def positions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``_at``, each row's place from 0 on among those of its key, and ``_n``, how many they are.

    Rows are dealt by ranges of key and order, so a key with any share of the
    rows spans many tasks; each partition's totals (a row per partition and key)
    become the places where its keys begin.  NULL comes first.  The order should
    end in a column that tells rows apart, or equal ones can't be dealt to
    several tasks.
    """
    parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = shared_table(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_rows"))
    totals = totals.select("_part", key, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))
    return dealt.join(totals, ["_part", key]).withColumn("_at", F.col("_before") + place - 1).drop("_part", "_before")


def words(text: Column) -> Column:
    """The words of a text as an array; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def text_bytes(text: str = "text") -> Column:
    """The UTF-8 bytes of a text; none for NULL."""
    return text_or_empty(text).cast("binary")


#: Stands for a NULL id while Python holds the rows, as pandas would make the others inexact.
NO_ID = -(1 << 63)


def guarded_id(df: DataFrame, id_col: str) -> Column:
    """The id as column ``_id``, without NULL if it is an integer."""
    if df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id")
    return F.col(id_col).alias("_id")


def guarded_type(df: DataFrame, id_col: str) -> str:
    kind = df.schema[id_col].dataType
    return "bigint" if kind.typeName() in ("byte", "short", "integer", "long") else kind.simpleString()


def restored_id(df: DataFrame, id_col: str) -> Column:
    """What guarded_id took, under its own name and type."""
    kind = df.schema[id_col].dataType
    column = F.when(F.col("_id") != NO_ID, F.col("_id")) if guarded_type(df, id_col) == "bigint" else F.col("_id")
    return column.cast(kind).alias(id_col)


_CODEC = "zstd"


def squeezed(data: bytes, level: int = 1) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec(_CODEC, compression_level=level).compress(data, asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    return pa.Codec(_CODEC).decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)


def packed_blocks(rows: DataFrame, numbers: dict[str, str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A table of blocks: (block, n, text_bytes, _text, *numbers), one row for some documents read one after the other.

    ``rows`` has the texts as binary column _text and columns of numbers, given
    with their numpy types; all are packed and compressed.  A block holds at
    most about ``block_bytes`` of text, a longer text is one by itself.
    Documents stay where they are read, so nothing is shuffled and equal rows
    are dealt like any others.
    """

    def packed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        texts = [bytes(x) for p in parts for x in p["_text"]]
        out = {"n": [len(texts)], "text_bytes": [sum(map(len, texts))], "_text": [squeezed(byte_lengths(texts).tobytes() + b"".join(texts), 3)]}
        for c, kind in numbers.items():
            out[c] = [squeezed(np.concatenate([p[c].to_numpy(kind) for p in parts]).tobytes())]
        return pd.DataFrame(out)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            a = 0
            for i, n in enumerate(byte_lengths(pdf["_text"]).tolist()):
                if size and size + n + 16 > block_bytes:
                    yield packed([*held, pdf[a:i]])
                    held, size, a = [], 0, i
                size += n + 16
            held.append(pdf[a:])
        if size:
            yield packed(held)

    made = rows.select("_text", *numbers).mapInPandas(gather, "n long, text_bytes long, _text binary" + "".join(f", {c} binary" for c in numbers))
    return shared_table(made.withColumn("block", F.monotonically_increasing_id()))


def block_texts(row) -> list[bytes]:
    """The texts of one row of packed_blocks."""
    raw, n = unsqueezed(row["_text"]), int(row["n"])
    ends = np.cumsum(np.frombuffer(raw, np.int64, n)) + 8 * n
    return [raw[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def block_numbers(row, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(unsqueezed(row[column]), kind)


class Exchange:
    """How blocks and shards meet in two steps, each task with about the square root of the blocks.

    A block sends to ``side`` coarse shards; those of a group of blocks are
    combined, and only then go to the shards below each coarse one.  Answers
    come back the same way.  So there are about blocks ** 1.5 messages, each a
    packed range of keys, and no task holds more than those of one group and
    one coarse shard, or of one shard and all groups.
    """

    def __init__(self, blocks: int, shards: int):
        self.shards = max(1, shards)
        self.side = max(1, round(max(1, blocks) ** 0.5))

    def group(self, block: int) -> int:
        return int(mixed(np.array([block], np.uint64), 41)[0] % np.uint64(self.side))

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.shards)).astype(np.int64)

    def coarse(self, shard: np.ndarray) -> np.ndarray:
        return shard % self.side


def parts_by(place: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(p, rows) of each p in 0..count-1 that ``place`` holds; rows keep their order."""
    order = np.argsort(place, kind="stable")
    edge = np.searchsorted(place[order], np.arange(count + 1))
    for p in np.flatnonzero(np.diff(edge)):
        yield int(p), order[edge[p] : edge[p + 1]]


def block_of(blocks: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")


def runs(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive rows whose sizes stay under ``most`` together; a larger row stands alone."""
    a, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > a and held + size > most:
            yield a, i
            a, held = i, 0
        held += size
    if a < len(sizes):
        yield a, len(sizes)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def byte_lengths(texts) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (public domain splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end, which lies behind it.

    A span is read in pieces of eight bytes.  Each is mixed with its number, so
    what a piece adds isn't linear in its bytes, and the sum of all is mixed with
    the length: spans that differ are told apart like random 64-bit numbers,
    however long or regular they are.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    pieces = (length + 7) >> 3
    first = np.cumsum(pieces) - pieces
    number = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data), "<u8", padded, strides=(1,))
    piece = eights[np.repeat(start, pieces) + 8 * number] & _LOW_BYTES[np.minimum(np.repeat(length, pieces) - 8 * number, 8)]
    mixed_in = mixed(piece ^ mixed(number.astype(np.uint64), 11), 12)
    return mixed(np.add.reduceat(mixed_in, first) + length.astype(np.uint64))


class Words:
    """The words of a batch of texts: where they are, of which text, and 64-bit hashes."""

    def __init__(self, texts: list[bytes], hashed: bool = True):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = byte_lengths(texts) + 1
        self.data, self.texts = data, len(texts)
        blank = _BLANK[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(data) and not blank[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.text = np.searchsorted(self.begin, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(self.count)))
        if hashed:
            self.hash = hash_spans(data, self.start, self.end)

    def windows(self, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each run of ``width`` words of one text."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(self.hash, seed) * _powers(_STEP, n), out=total[1:])
        hashes = mixed((total[width:] - total[:-width]) * _powers(_BACK, n - width + 1), seed)
        first = np.flatnonzero(self.text[: n - width + 1] == self.text[width - 1 :])
        return first, hashes[first]


def pack_rising(values: np.ndarray) -> bytes:
    """int64 values in few bytes if they mostly rise slowly."""
    steps = np.diff(values, prepend=np.int64(0))
    return squeezed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_rising(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueezed(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())
