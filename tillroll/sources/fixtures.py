"""Retail tables derived from the star-schema Parquet tables of a data folder.

The mapping injects, by arithmetic on keys, the faults that real exports have:
cancelled invoices, missing customers and descriptions, charges listed as
products, returns, typing errors, free lines and duplicated lines.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.cleaning import clean_transactions
from tillroll.schemas import UNIT_PRICE


# Columns used of each source table. Declared, so opening a table starts no job.
_COLUMNS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "part": "p_partkey BIGINT, p_name STRING",
    "nation": "n_nationkey INT, n_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def _every(key: Column, n: int, rest: int = 0) -> Column:
    return key % n == rest


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    buyers = (
        _table(spark, folder, "orders")
        .join(_table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    lines = (
        _table(spark, folder, "lineitem")
        # The lines are the largest input; never let a size estimate broadcast them.
        .hint("merge")
        .join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    line = order + F.col("l_linenumber")
    copies = F.when(_every(order, 37), 2).otherwise(1)
    return lines.select(
        F.concat(F.when(_every(order, 50), "C").otherwise(""), order.cast("string")).alias("Invoice"),
        part.cast("string").alias("StockCode"),
        F.when(_every(part, 97), F.lit(None).cast("string"))
        .when(_every(part, 101), "Postage")
        .when(_every(part, 103), "MANUAL")
        .otherwise(F.col("p_name")).alias("Description"),
        F.when(_every(line, 41), -F.col("l_quantity"))
        .when(_every(line, 997), 10000)
        .otherwise(F.col("l_quantity")).cast("bigint").alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        F.when(_every(part + F.col("l_linenumber"), 211), 0)
        .otherwise(F.col("l_extendedprice").cast(UNIT_PRICE)).cast(UNIT_PRICE).alias("Price"),
        F.when(_every(order, 4, 1), None).otherwise(F.col("o_custkey").cast("double")).alias("Customer ID"),
        F.when(F.col("n_nationkey") == 0, "United Kingdom")
        .when(F.col("n_nationkey") == 24, "Unspecified")
        .otherwise(F.col("n_name")).alias("Country"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return clean_transactions(raw_transactions(spark, folder))


def timed_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events, which carry a time of day (order dates do not)."""
    return (
        _table(spark, folder, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").cast("string").alias("Invoice"),
            F.col("user_id").alias("CustomerID"),
            F.col("ts").alias("InvoiceDate"),
            F.col("value").cast("decimal(28,2)").alias("TotalPrice"),
        )
    )
