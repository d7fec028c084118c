"""The shop's roles played by the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Shop:
    """Lazy views of one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def sales(self) -> DataFrame:
        """item, dept, store, date, quantity, price: one row per line."""
        line = self.table("lineitem").select("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("item"), F.col("p_type").alias("dept"))
        supplier = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("store"))
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("item", "dept", "store", "date", "quantity", "price")

    @property
    def daily(self) -> DataFrame:
        """item, store, date, quantity: one row per key and day with sales."""
        return self.sales.groupBy("item", "store", "date").agg(F.sum("quantity").alias("quantity"))

    @property
    def weekly(self) -> DataFrame:
        """item, store, week (its Monday), quantity."""
        return self.sales.groupBy("item", "store", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(F.sum("quantity").alias("quantity"))

    @property
    def online(self) -> DataFrame:
        """date, user, value of purchases in the event table."""
        return self.table("events").where("event_type = 'purchase'").select(F.to_date("ts").alias("date"), F.col("user_id").alias("user"), "value")

    @property
    def purchases(self) -> DataFrame:
        """cust, art, day, price, receipt, channel: one row per purchase."""
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("channel"))
        line = self.table("lineitem").select(F.col("l_orderkey").alias("receipt"), F.col("l_partkey").alias("art"), F.col("l_extendedprice").alias("price"))
        return line.join(orders, F.col("receipt") == F.col("o_orderkey")).select("cust", "art", "day", "price", "receipt", "channel")

    @property
    def articles(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("art"), F.col("p_brand").alias("product"), F.col("p_type").alias("dept"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("list_price"))

    @property
    def customers(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
