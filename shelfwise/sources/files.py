"""File sources and sinks with declared schemas."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import scratch


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = ",", dates: dict[str, str] | None = None, rows: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A CSV file with header under a declared schema (no inference pass).

    ``columns`` prunes, so saved index columns and unused fields are never
    parsed; ``dates`` gives the pattern of text columns that hold dates;
    ``rows`` keeps the first rows in the order of ``order``.
    """
    out = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    if columns:
        out = out.select(*columns)
    for name, pattern in (dates or {}).items():
        out = out.withColumn(name, F.to_date(name, pattern))
    if rows is not None:
        out = (out.orderBy(*order) if order else out).limit(rows)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with header, one per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, one folder per value of ``by``, which later reads prune by."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Give a frame a name that SQL can use."""
    df.createOrReplaceTempView(name)
    return df


def write_mapping(df: DataFrame, column: str, path: str) -> DataFrame:
    """Number the distinct values of a column from 0 and save the mapping as a table."""
    mapping = dense_codes(df, column)
    write_parquet(mapping, path)
    return mapping


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): codes from 0 by value, numbered per range partition and offset by what lies before.

    The ranges are those of quantiles of the values, so a value's partition
    follows from the value and a task that runs again gives the same codes.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    parts = values.repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id())
    path = f"{scratch(df.sparkSession)}/codes"
    parts.write.parquet(path)
    parts = df.sparkSession.read.parquet(path)
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("_part").count().select("_part", before.alias("_before"))  # a row per partition
    number = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return parts.withColumn("_n", number).join(F.broadcast(offsets), "_part").select(column, (F.col("_before") + F.col("_n")).cast("long").alias("code"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
