"""Retention of customers by the month of their first purchase."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions.dates import month_start
from tillroll.functions.ratios import percent

# Fixed value: days taken as one period.
PERIOD_DAYS = 30


def customer_months(transactions: DataFrame) -> DataFrame:
    """Months in which each customer bought, with the first of them. The window sees
    at most one row per calendar month of a customer."""
    active = transactions.select("CustomerID", month_start(F.col("InvoiceDate")).alias("TransactionMonth")).distinct()
    own = Window.partitionBy("CustomerID")
    return active.withColumn("CohortMonth", F.min("TransactionMonth").over(own))


def cohort_period(month: Column, cohort: Column, calendar: bool = False) -> Column:
    """Days between month starts over 30, rounded down, so a February cohort has its
    March in period 0. `calendar=True` counts calendar months instead."""
    if calendar:
        return F.months_between(month, cohort).cast("int")
    return F.floor(F.date_diff(month, cohort) / PERIOD_DAYS).cast("int")


def with_cohort_period(active: DataFrame, calendar: bool = False) -> DataFrame:
    return active.withColumn("CohortPeriod", cohort_period(F.col("TransactionMonth"), F.col("CohortMonth"), calendar))


def cohort_counts(transactions: DataFrame, calendar: bool = False) -> DataFrame:
    """Distinct customers per cohort and period. Two months of one period count a
    customer once; that step reuses the partitioning by customer."""
    members = with_cohort_period(customer_months(transactions), calendar)
    return (
        members.select("CustomerID", "CohortMonth", "CohortPeriod").distinct()
        .groupBy("CohortMonth", "CohortPeriod")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


def cohort_sizes(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("CohortPeriod") == 0).select("CohortMonth", F.col("customers").alias("cohort_size"))


def retention(counts: DataFrame) -> DataFrame:
    """Share of each cohort seen in each period; the window holds one cohort's periods."""
    size = F.max(F.when(F.col("CohortPeriod") == 0, F.col("customers"))).over(Window.partitionBy("CohortMonth"))
    return counts.withColumn("cohort_size", size).withColumn(
        "retention_pct", percent(F.col("customers"), F.col("cohort_size")))


def cohort_matrix(long: DataFrame, value: str, periods: list[int]) -> DataFrame:
    """Cohorts down, the given periods across."""
    wide = long.groupBy("CohortMonth").pivot("CohortPeriod", periods).agg(F.max(value))
    return wide.withColumnsRenamed({str(p): f"period_{p}" for p in periods}).orderBy("CohortMonth")


def first_periods(long: DataFrame, shown: int = 12) -> DataFrame:
    """The first `shown` periods that occur (not the periods below `shown`). The
    ranking runs over the distinct periods only."""
    if not 3 <= shown <= 12:
        raise ValueError("shown must be between 3 and 12")
    periods = long.select("CohortPeriod").distinct().orderBy("CohortPeriod").limit(shown)
    return long.join(F.broadcast(periods), "CohortPeriod", "left_semi")


def average_retention(long: DataFrame, periods: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Mean over the cohorts that have the period, 0 where none has."""
    return long.agg(*[
        F.coalesce(F.avg(F.when(F.col("CohortPeriod") == p, F.col("retention_pct"))), F.lit(0.0))
        .alias(f"avg_period_{p}_pct")
        for p in periods
    ])
