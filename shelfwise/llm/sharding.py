"""Sharding by global prefix sums of byte sizes.

Rows are put in one global order, dealt to partitions by range, and summed per
partition; the running total over partitions (a table with one row each) turns
a row's place in its partition into its place in the whole.  Equal targets cut
that order into contiguous shards of nearly equal bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, text_or_empty

SHARDS = 16
#: Rows of a file of write_shards.
FILE_ROWS = 1_000_000


def assign_shards(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's shard and place: (id, size, text_crc32, shard, slot, *carry).

    A row's size is the UTF-8 bytes of its text plus 1 (NULL text: 1).  The
    order is by id (NULL first), then text checksum, size and input position,
    so ties, repeated rows and NULL ids are spread like any others.  A row goes
    to the shard in which the middle of its bytes falls: shards are contiguous
    in that order and differ by less than the largest row.  An empty table gives
    no rows; columns other than id, text and ``carry`` are not read.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col),
        (F.octet_length(text_or_empty(text)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        *carry,
    ).withColumn("_at", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("_at")]
    dealt = shared_table(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))

    totals = dealt.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(  # one row per partition
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        dealt.withColumn("_end", F.sum("size").over(upto))
        .withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(starts), "_part")
        .withColumn("_middle", F.col("_bytes_before") + F.col("_end") - F.col("size") / 2)
        .withColumn("shard", F.least(F.floor(F.col("_middle") * shards / F.col("_total")), F.lit(shards - 1)).cast("int"))
        .withColumn("_place", F.col("_rows_before") + F.col("_row") - 1)
    )
    placed = shared_table(placed.select(id_col, "size", "text_crc32", "shard", "_place", *carry))
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        id_col, "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot"), *carry
    )


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> None:
    """Write all columns of ``df`` as one folder per shard, in slot order within files of at most FILE_ROWS rows.

    Beside them stand size, text_crc32 and slot, and the folders' shard; columns
    of ``df`` with one of these names, or one that begins with ``_``, are written
    as ``row_`` and their name, with more ``row_`` where that is taken too.
    """
    renamed, taken = {}, {c.lower() for c in df.columns} | {"size", "text_crc32", "shard", "slot"}
    for c in df.columns:
        if c not in (id_col, text) and (c.lower() in ("size", "text_crc32", "shard", "slot") or c.startswith("_")):
            new = f"row_{c}"
            while new.lower() in taken:
                new = f"row_{new}"
            renamed[c] = new
            taken.add(new.lower())
    df = df.withColumnsRenamed(renamed)
    carry = tuple(c for c in df.columns if c != id_col)
    placed = assign_shards(df, shards, id_col, text, carry)
    file = F.floor(F.col("slot") / FILE_ROWS)
    placed.repartition("shard", file).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard").parquet(path)


def op9(spark, sf_dir: str) -> DataFrame:
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: CRC-32 by a table of bytes; documents in their order, cut where the middle of their bytes falls.
OP9_SQL = f"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crcs),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, row_number() OVER () AS rid,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM documents),
sized AS (
  SELECT doc_id, size, rid, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
  FROM d, t),
placed AS (
  SELECT *, sum(size) OVER inorder AS upto, sum(size) OVER () AS total, row_number() OVER inorder AS place
  FROM sized WINDOW inorder AS (ORDER BY doc_id NULLS FIRST, text_crc32, size, rid ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, CAST(least(floor((upto - size / 2) * {SHARDS} / total), {SHARDS - 1}) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""
