"""Revenue and order aggregates, rankings and limits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions.dates import WEEKDAYS, hour_of_day, month_start, weekday_name
from tillroll.functions.ratios import percent
from tillroll.operators.cleaning import known_country, products_only

# The home market, and the segments counted as at risk.
HOME_COUNTRY = "United Kingdom"
AT_RISK_SEGMENTS = ["At Risk", "Lost"]


def monthly_revenue(transactions: DataFrame) -> DataFrame:
    return (
        transactions.groupBy(month_start(F.col("InvoiceDate")).alias("Month"))
        .agg(F.sum("TotalPrice").alias("revenue"))
        .orderBy("Month")
    )


def peak_month(transactions: DataFrame) -> DataFrame:
    """The earliest month wins a tie."""
    return monthly_revenue(transactions).orderBy(F.desc("revenue"), "Month").limit(1)


def orders_by_hour(transactions: DataFrame) -> DataFrame:
    return (
        transactions.groupBy(hour_of_day(F.col("InvoiceDate")).alias("Hour"))
        .agg(F.countDistinct("Invoice").alias("orders"))
        .orderBy("Hour")
    )


def _per_weekday(transactions: DataFrame, measure: Column) -> DataFrame:
    """One row per weekday, Monday first; NULL for a day without sales."""
    days = transactions.sparkSession.createDataFrame(list(enumerate(WEEKDAYS, 1)), "day_number int, DayOfWeek string")
    found = transactions.groupBy(weekday_name(F.col("InvoiceDate")).alias("DayOfWeek")).agg(measure)
    return days.join(F.broadcast(found), "DayOfWeek", "left").orderBy("day_number")


def orders_by_weekday(transactions: DataFrame) -> DataFrame:
    return _per_weekday(transactions, F.countDistinct("Invoice").alias("orders"))


def revenue_by_weekday(transactions: DataFrame) -> DataFrame:
    return _per_weekday(transactions, F.sum("TotalPrice").alias("revenue"))


def revenue_by_hour(transactions: DataFrame, peaks: int = 3) -> DataFrame:
    """Marks the `peaks` best hours; at most 24 rows reach the window."""
    hours = transactions.groupBy(hour_of_day(F.col("InvoiceDate")).alias("Hour")).agg(
        F.sum("TotalPrice").alias("revenue"))
    place = F.row_number().over(Window.orderBy(F.desc("revenue"), "Hour"))
    return hours.withColumn("is_peak", place <= peaks).orderBy("Hour")


def top_products(transactions: DataFrame, n: int = 10) -> DataFrame:
    return (
        products_only(transactions).groupBy("Description")
        .agg(F.sum("TotalPrice").alias("revenue"))
        .orderBy(F.desc("revenue"), "Description")
        .limit(n)
    )


def headline_figures(transactions: DataFrame) -> DataFrame:
    """Several distinct counts multiply the rows they read, so lines are first
    reduced to one row per invoice."""
    baskets = transactions.groupBy("CustomerID", "Invoice", "Country").agg(F.sum("TotalPrice").alias("spend"))
    return baskets.agg(
        F.countDistinct("CustomerID").alias("customers"),
        F.sum("spend").alias("total_revenue"),
        F.countDistinct("Invoice").alias("total_orders"),
        F.countDistinct("Country").alias("countries"),
    )


def at_risk_share(rfm: DataFrame) -> DataFrame:
    hits = F.count_if(F.col("Segment").isin(AT_RISK_SEGMENTS))
    return rfm.agg(percent(hits, F.count(F.lit(1)), 1).alias("at_risk_or_lost_pct"))


def segment_distribution(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("Segment").agg(F.count(F.lit(1)).alias("customers")).orderBy(F.desc("customers"), "Segment")


def cluster_distribution(rfm: DataFrame) -> DataFrame:
    return (
        rfm.dropna(subset=["Cluster_Name"]).groupBy("Cluster_Name")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy(F.desc("customers"), "Cluster_Name")
    )


def revenue_by_country(transactions: DataFrame, n: int = 10) -> DataFrame:
    return (
        known_country(transactions).groupBy("Country")
        .agg(F.sum("TotalPrice").alias("revenue"))
        .orderBy(F.desc("revenue"), "Country")
        .limit(n)
    )


def home_and_international(transactions: DataFrame, home: str = HOME_COUNTRY) -> DataFrame:
    """Revenue and share of the home market and of all others."""
    market = F.when(F.col("Country") == home, "home").otherwise("international")
    return (
        known_country(transactions).groupBy(market.alias("market"))
        .agg(F.sum("TotalPrice").alias("revenue"))
        .withColumn("share_pct", percent(F.col("revenue"), F.sum("revenue").over(Window.partitionBy()), 1))
        .orderBy("market")
    )
