"""SQL over the transaction and customer tables."""

from pyspark.sql import DataFrame, SparkSession


def register_views(transactions: DataFrame, rfm: DataFrame) -> None:
    """For interactive use: names `transactions` and `rfm` for the whole session, the latest tables win."""
    transactions.createOrReplaceTempView("transactions")
    rfm.createOrReplaceTempView("rfm")


def run_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The result of a statement that names its tables as given here; they are its own, so statements
    with different tables under one name do not disturb each other. Names not given are the session's."""
    if not tables:
        return spark.sql(sql)
    names = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in tables)
    return spark.sql(f"WITH {names} ({sql.replace('{', '{{').replace('}', '}}')})", **tables)
