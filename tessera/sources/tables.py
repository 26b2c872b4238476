"""Parquet tables, tables of other databases, and the append-only order log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDER_LOG = "seq bigint, total double, items array<struct<sku:string,qty:int>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def external(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of the caller's database, by JDBC; filters and columns are pushed down to it."""
    return spark.read.jdbc(url, name, properties=options)


def append_orders(orders: DataFrame, path: str) -> None:
    """Append accepted orders (seq, total, items) to the log."""
    orders.select("seq", "total", "items").write.mode("append").parquet(path)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORDER_LOG).parquet(path).orderBy("seq")
