"""Data-quality counts, summary statistics and histograms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.ratios import percent
from tillroll.operators.cleaning import CANCELLED_PREFIX
from tillroll.operators.ranking import exact_quantiles

RFM_METRICS = ["recency", "frequency", "monetary"]


def missing_values(df: DataFrame) -> DataFrame:
    """One row per column with its type, null count and share; one pass over the data."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    entries = F.array(*[
        F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"), F.col(f"n{i}").alias("missing"))
        for i, (name, kind) in enumerate(df.dtypes)
    ])
    return (
        counts.select("rows", F.inline(entries))
        .select("column", "type", "rows", "missing", percent(F.col("missing"), F.col("rows"), 2).alias("missing_pct"))
    )


def cancellation_rate(raw: DataFrame) -> DataFrame:
    cancelled = F.count_if(F.col("Invoice").startswith(CANCELLED_PREFIX))
    return raw.agg(
        cancelled.alias("cancelled_rows"),
        percent(cancelled, F.count(F.lit(1)), 1).alias("cancelled_pct"),
    )


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def cleaning_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    counts = raw.agg(F.count(F.lit(1)).alias("raw_rows")).withColumn("clean_rows", _row_count(cleaned))
    removed = F.col("raw_rows") - F.col("clean_rows")
    return counts.withColumn("removed_rows", removed).withColumn(
        "removed_pct", percent(removed, F.col("raw_rows"), 1))


def dataset_summary(transactions: DataFrame) -> DataFrame:
    """Lines shrink to one row per customer, invoice and product before anything is counted,
    and each column is counted by itself, so no line is multiplied."""
    parts = transactions.groupBy("CustomerID", "Invoice", "Description").agg(
        F.min("InvoiceDate").alias("first_date"), F.max("InvoiceDate").alias("last_date"),
        F.sum("TotalPrice").alias("spend"))

    def different(column: str) -> Column:
        return parts.groupBy(column).agg(F.count(F.lit(1))).agg(F.count(column)).scalar()

    return (
        parts.agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
                  F.sum("spend").alias("total_revenue"))
        .select(different("CustomerID").alias("customers"), different("Invoice").alias("invoices"),
                different("Description").alias("products"), "first_date", "last_date", "total_revenue")
    )


def long_metrics(rfm: DataFrame, metrics: list[str], *keep: str) -> DataFrame:
    """(customer, metric, value) rows."""
    pairs = ", ".join(f"'{m}', cast({m} AS decimal(28,6))" for m in metrics)
    return rfm.select("CustomerID", *keep, F.expr(f"stack({len(metrics)}, {pairs})").alias("metric", "value"))


def describe_rfm(rfm: DataFrame, digits: int = 2) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of the three
    metrics. Quartiles are exact; `rfm` is read more than once."""
    values = long_metrics(rfm, RFM_METRICS)
    basic = values.groupBy("metric").agg(
        F.count("value").cast("double").alias("count"),
        F.avg(F.col("value").cast("double")).alias("mean"),
        F.stddev_samp(F.col("value").cast("double")).alias("std"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
    )
    quartiles = exact_quantiles(values, ["metric"], "value", "CustomerID", [25, 50, 75])
    at = lambda p: F.max(F.when(F.col("percent") == p, F.col("quantile")))
    wide = basic.join(quartiles.groupBy("metric").agg(at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75")), "metric")
    # Statistic names in report order.
    names = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    columns = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    rows = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(n).alias("statistic"), F.col(c).alias("value"))
        for i, (n, c) in enumerate(zip(names, columns))
    ])
    return (
        wide.select("metric", F.inline(rows))
        .groupBy("place", "statistic").pivot("metric", RFM_METRICS).agg(F.round(F.max("value"), digits))
        .orderBy("place").drop("place")
    )


def percentile_caps(rfm: DataFrame, metrics: list[str], percentile: int = 99) -> dict[str, float]:
    """The exact percentile of each metric: one number per metric."""
    found = exact_quantiles(long_metrics(rfm, metrics), ["metric"], "value", "CustomerID", [percentile])
    return {r["metric"]: r["quantile"] for r in found.collect()}


def capped(metric: str, caps: dict[str, float]) -> Column:
    """The metric as DOUBLE, cut off at its cap if it has one."""
    value = F.col(metric).cast("double")
    return F.least(value, F.lit(caps[metric])) if metric in caps else value


def histogram(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins over each group's own range; the maximum falls into the last
    bin, empty bins are listed, and a range of zero width is widened by 0.5 each way."""
    df = df.dropna(subset=by + [value]).select(*by, F.col(value).cast("double").alias("value"))
    span = df.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    flat = F.col("low") == F.col("high")
    span = span.select(
        *by,
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    place = F.floor((F.col("value") - F.col("low")) * bins / (F.col("high") - F.col("low")))
    counted = (
        df.join(span, by)
        .groupBy(*by, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    width = (F.col("high") - F.col("low")) / bins
    edges = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        *by, "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_from"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("bin_to"),
    )
    return edges.join(counted, [*by, "bin"], "left").fillna(0, subset=["customers"])


def rfm_histograms(rfm: DataFrame, bins: int = 40) -> DataFrame:
    """Histograms of the three metrics, cut off at their 99th percentiles."""
    caps = percentile_caps(rfm, RFM_METRICS)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), capped(m, caps).alias("value")) for m in RFM_METRICS])
    return histogram(rfm.select(F.inline(pairs)), ["metric"], "value", bins)


def churn_risk_histograms(rfm: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(rfm, ["Cluster_Name"], "Churn_Risk", bins)


def coverage_check(transactions: DataFrame, rfm: DataFrame) -> DataFrame:
    """Customers in the data against rows of the customer table."""
    return transactions.agg(F.countDistinct("CustomerID").alias("customers_in_data")).withColumn(
        "customers_in_rfm", _row_count(rfm))


