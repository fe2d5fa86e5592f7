"""Reading and writing transaction and customer tables as CSV or Parquet."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import schemas
from tillroll.functions.dates import month_label
from tillroll.sources.csv_records import read_csv
from tillroll.sources.staging import remove, replace


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "csv":
        # A quote inside a field is doubled, a field may hold line breaks, and a value that its
        # type cannot hold ends the read instead of becoming NULL and vanishing in the cleaning.
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def _write(df: DataFrame, path: str, fmt: str, partition_by: str | None = None) -> None:
    """Writes beside the old table and takes its place only when complete; a write that fails leaves it."""
    fresh = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"')
    if partition_by:
        writer = writer.partitionBy(partition_by)
    try:
        writer.save(fresh)
    except Exception:
        remove(df.sparkSession, fresh)
        raise
    replace(df.sparkSession, fresh, path)


def load_raw(spark: SparkSession, parts: list[str], fmt: str = "csv") -> DataFrame:
    """The yearly parts of the raw export, stacked."""
    loaded = [_read(spark, path, schemas.RAW_TRANSACTIONS, fmt) for path in parts]
    return reduce(DataFrame.unionByName, loaded)


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.TRANSACTIONS, fmt).select(schemas.TRANSACTIONS.fieldNames())


def read_customers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.CUSTOMERS, fmt)


def _by_month(df: DataFrame) -> DataFrame:
    """Rebalanced by month, which keeps file sizes even when one month holds most of the rows."""
    columns = df.select([f.name for f in schemas.TRANSACTIONS])
    return columns.withColumn("month", month_label(F.col("InvoiceDate"))).hint("rebalance", "month")


def write_transactions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replaces the table at path. Parquet is laid out by month."""
    if fmt == "csv":
        _write(df.select([f.name for f in schemas.TRANSACTIONS]), path, fmt)
        return
    _write(_by_month(df), path, fmt, partition_by="month")


def write_months(df: DataFrame, path: str) -> None:
    """Writes the months that df has rows of anew into the Parquet table at path; other months stay
    as they are. The old files of a month go when its new ones are complete."""
    writer = _by_month(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("month").parquet(path)


def write_customers(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Columns an earlier step has not produced yet are written as NULL."""
    present = set(df.columns)
    columns = [
        (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.CUSTOMERS
    ]
    _write(df.select(columns), path, fmt)
