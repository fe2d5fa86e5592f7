"""Declared schemas of the tables that cross a file boundary."""

from pyspark.sql import types as T

#: Totals keep the decimals of unit prices, so three pins at a tenth of a cent do not vanish.
MONEY = T.DecimalType(28, 6)
#: Unit prices keep up to six decimals, so a price below a cent does not turn into zero.
UNIT_PRICE = T.DecimalType(18, 6)

RAW_TRANSACTIONS = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.LongType()),
    T.StructField("InvoiceDate", T.TimestampNTZType()),
    T.StructField("Price", UNIT_PRICE),
    T.StructField("Customer ID", T.DoubleType()),
    T.StructField("Country", T.StringType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.LongType()),
    T.StructField("InvoiceDate", T.TimestampNTZType()),
    T.StructField("Price", UNIT_PRICE),
    T.StructField("CustomerID", T.LongType()),
    T.StructField("Country", T.StringType()),
    T.StructField("TotalPrice", MONEY),
])

CUSTOMERS = T.StructType([
    T.StructField("CustomerID", T.LongType()),
    T.StructField("recency", T.LongType()),
    T.StructField("frequency", T.LongType()),
    T.StructField("monetary", MONEY),
    T.StructField("R-Score", T.IntegerType()),
    T.StructField("F-Score", T.IntegerType()),
    T.StructField("M-Score", T.IntegerType()),
    T.StructField("RFM_Score", T.IntegerType()),
    T.StructField("Segment", T.StringType()),
    T.StructField("Cluster", T.IntegerType()),
    T.StructField("Cluster_Name", T.StringType()),
    T.StructField("Churn_Risk", T.DoubleType()),
])
