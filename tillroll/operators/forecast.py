"""Linear trend, seasonal index and forecast of monthly revenue.

Everything here runs on the monthly table: one row per month of the data, so its
windows are small whatever the number of transactions.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: half-width of a 95% band in standard deviations.
BAND = 1.96


def with_trend(monthly: DataFrame) -> DataFrame:
    """Least squares over the position 0..n-1 of the months present. The sums are
    exact decimals, so the result does not depend on row order."""
    every = Window.partitionBy()
    placed = monthly.withColumn("t", (F.row_number().over(Window.orderBy("Month")) - 1).cast("bigint"))
    total = lambda c: F.sum(c).over(every)
    summed = placed.select(
        "Month", "revenue", "t",
        F.count(F.lit(1)).over(every).alias("n"),
        total(F.col("t")).alias("sum_t"),
        total(F.col("t") * F.col("t")).alias("sum_tt"),
        total(F.col("revenue")).cast("decimal(30,6)").alias("sum_y"),
        total(F.col("t").cast("decimal(8,0)") * F.col("revenue").cast("decimal(28,6)")).cast("decimal(32,6)").alias("sum_ty"),
    )
    n = F.col("n").cast("decimal(6,0)")
    rise = n * F.col("sum_ty") - F.col("sum_t").cast("decimal(8,0)") * F.col("sum_y")
    run = F.col("n") * F.col("sum_tt") - F.col("sum_t") * F.col("sum_t")
    slope = F.try_divide(rise.cast("double"), run.cast("double"))
    fitted = summed.withColumn("slope", slope).withColumn(
        "intercept", (F.col("sum_y").cast("double") - F.col("slope") * F.col("sum_t")) / F.col("n"))
    return fitted.select(
        "Month", F.col("revenue").cast("double").alias("revenue"), "t", "n", "slope", "intercept",
        (F.col("intercept") + F.col("slope") * F.col("t")).alias("trend"),
    )


def _calendar_months(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("calendar_month"))


def seasonal_index(trended: DataFrame) -> DataFrame:
    """Mean deviation from the trend per calendar month; 0 for a month never seen."""
    seen = trended.groupBy(F.month("Month").alias("calendar_month")).agg(
        F.avg(F.col("revenue") - F.col("trend")).alias("seasonal"))
    return _calendar_months(trended).join(seen, "calendar_month", "left").fillna(0.0, subset=["seasonal"])


def with_fitted(trended: DataFrame) -> DataFrame:
    season = F.avg(F.col("revenue") - F.col("trend")).over(Window.partitionBy(F.month("Month")))
    return trended.withColumn("seasonal", season).withColumn("fitted", F.col("trend") + F.col("seasonal"))


def residual_std(fitted: DataFrame) -> DataFrame:
    return fitted.agg(F.stddev_pop(F.col("revenue") - F.col("fitted")).alias("residual_std"))


def fitted_model(monthly: DataFrame) -> DataFrame:
    """The whole model as one row: line, residual deviation, and season by month."""
    fitted = with_fitted(with_trend(monthly))
    season = F.collect_set(F.struct(F.month("Month"), F.col("seasonal")))
    return fitted.agg(
        F.max("Month").alias("last_month"), F.max("n").alias("n"),
        F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
        F.stddev_pop(F.col("revenue") - F.col("fitted")).alias("residual_std"),
        F.map_from_entries(season).alias("season"),
    )


def forecast(monthly: DataFrame, periods_ahead: int = 6) -> DataFrame:
    ahead = fitted_model(monthly).select("*", F.explode(F.sequence(F.lit(1), F.lit(periods_ahead))).alias("step"))
    ahead = ahead.withColumn("Month", F.add_months("last_month", F.col("step")))
    season = F.coalesce(F.try_element_at("season", F.month("Month")), F.lit(0.0))
    trend = F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step") - 1)
    return (
        ahead.select("Month", (trend + season).alias("forecast"), "residual_std")
        .select(
            "Month", "forecast",
            (F.col("forecast") - BAND * F.col("residual_std")).alias("lower"),
            (F.col("forecast") + BAND * F.col("residual_std")).alias("upper"),
        )
        .orderBy("Month")
    )


def trend_figures(monthly: DataFrame) -> DataFrame:
    """Monthly slope, the next month's forecast and the residual deviation."""
    coming = F.month(F.add_months("last_month", 1))
    season = F.coalesce(F.try_element_at("season", coming), F.lit(0.0))
    return fitted_model(monthly).select(
        F.col("slope").alias("monthly_trend"),
        (F.col("intercept") + F.col("slope") * F.col("n") + season).alias("next_month_forecast"),
        "residual_std",
    )
