"""From raw invoice lines to clean transactions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.schemas import MONEY

# Descriptions that are charges, not products.
NON_PRODUCTS = ["POSTAGE", "MANUAL", "DOTCOM POSTAGE", "CRUK COMMISSION"]
# First quantity treated as a typing error, cancelled-invoice mark,
# label of an unknown country.
QUANTITY_CAP = 10000
CANCELLED_PREFIX = "C"
UNKNOWN_COUNTRY = "Unspecified"


def drop_duplicate_lines(df: DataFrame) -> DataFrame:
    """Whole rows are compared, so this comes before every filter. Copies collapse
    within each task before the shuffle, whatever their number."""
    return df.dropDuplicates()


def rename_customer_key(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("Customer ID", "CustomerID")


def drop_missing_keys(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["CustomerID", "Description"])


def cast_customer_key(df: DataFrame) -> DataFrame:
    return df.withColumn("CustomerID", F.col("CustomerID").cast("bigint"))


def keep_positive_quantity(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Quantity") > 0)


def keep_positive_price(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Price") > 0)


def keep_plausible_quantity(df: DataFrame, cap: int = QUANTITY_CAP) -> DataFrame:
    return df.filter(F.col("Quantity") < cap)


def parse_invoice_date(df: DataFrame) -> DataFrame:
    return df.withColumn("InvoiceDate", F.col("InvoiceDate").cast("timestamp_ntz"))


def add_line_total(df: DataFrame) -> DataFrame:
    return df.withColumn("TotalPrice", (F.col("Quantity") * F.col("Price")).cast(MONEY))


def drop_cancellations(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("Invoice").startswith(CANCELLED_PREFIX))


def clean_transactions(raw: DataFrame) -> DataFrame:
    return (
        raw.transform(drop_duplicate_lines)
        .transform(rename_customer_key)
        .transform(drop_missing_keys)
        .transform(cast_customer_key)
        .transform(keep_positive_quantity)
        .transform(keep_positive_price)
        .transform(keep_plausible_quantity)
        .transform(parse_invoice_date)
        .transform(add_line_total)
        .transform(drop_cancellations)
    )


def products_only(df: DataFrame) -> DataFrame:
    """Charges are recognised whatever their letter case."""
    return df.filter(~F.upper("Description").isin(NON_PRODUCTS))


def products_only_exact_case(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("Description").isin(NON_PRODUCTS))


def known_country(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Country") != UNKNOWN_COUNTRY)
