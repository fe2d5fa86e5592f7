"""Customer lifetime value from spend history and churn probability."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import elapsed_days
from tillroll.operators.ranking import exact_quantiles
from tillroll.operators.rfm import customer_history

# Mean days per month, least activity span, bounds of the churn
# probability, and the longest expected life in months.
DAYS_PER_MONTH = 30.44
LEAST_MONTHS = 1.0
LEAST_PROBABILITY, GREATEST_PROBABILITY = 0.01, 0.99
LONGEST_LIFE = 60.0
# Fixed value: whisker length of a box plot in interquartile ranges.
WHISKER = 1.5


def spend_history(transactions: DataFrame) -> DataFrame:
    return customer_history(transactions).select(
        "CustomerID", F.col("monetary").alias("total_spend"), "first_purchase", "last_purchase",
        F.col("frequency").alias("num_orders"))


def with_months_active(history: DataFrame) -> DataFrame:
    months = elapsed_days(F.col("last_purchase"), F.col("first_purchase")) / F.lit(DAYS_PER_MONTH)
    return history.withColumn("months_active", F.greatest(months, F.lit(LEAST_MONTHS)))


def with_monthly_spend(history: DataFrame) -> DataFrame:
    return history.withColumn("avg_monthly_spend", F.col("total_spend").cast("double") / F.col("months_active"))


def scored_customers_only(history: DataFrame, rfm: DataFrame) -> DataFrame:
    return history.join(rfm, "CustomerID", "left_semi")


def expected_months(annual_probability: Column) -> Column:
    """Mean months until churn, from a yearly probability kept off 0 and 1."""
    p = F.least(F.greatest(annual_probability, F.lit(LEAST_PROBABILITY)), F.lit(GREATEST_PROBABILITY))
    monthly = 1.0 - F.pow(1.0 - p, F.lit(1.0 / 12.0))
    return F.least(1.0 / monthly, F.lit(LONGEST_LIFE))


def compute_clv(transactions: DataFrame, scored: DataFrame) -> DataFrame:
    """`scored` is the customer table with churn_prob, Segment and Cluster_Name; the
    join keeps only its customers."""
    history = with_monthly_spend(with_months_active(spend_history(transactions)))
    known = scored.select("CustomerID", "churn_prob", "Segment", "Cluster_Name")
    life = expected_months(F.col("churn_prob"))
    return history.join(known, "CustomerID").select(
        "CustomerID", F.col("total_spend").cast("double").alias("total_spend"), "months_active", "avg_monthly_spend",
        F.col("churn_prob").alias("churn_prob_annual"), life.alias("expected_months"),
        (F.col("avg_monthly_spend") * life).alias("predicted_clv"), "Segment", "Cluster_Name",
    )


def mean_clv_by_segment(clv: DataFrame) -> DataFrame:
    return (
        clv.groupBy("Segment").agg(F.avg("predicted_clv").alias("mean_clv"))
        .orderBy(F.desc("mean_clv"), "Segment")
    )


def clv_box_by_segment(clv: DataFrame) -> DataFrame:
    """Quartiles, whisker ends (the outermost values within 1.5 interquartile ranges)
    and the number of customers beyond them. `clv` is read more than once."""
    quartiles = exact_quantiles(clv, ["Segment"], "predicted_clv", "CustomerID", [25, 50, 75])
    at = lambda p: F.max(F.when(F.col("percent") == p, F.col("quantile")))
    boxes = quartiles.groupBy("Segment").agg(at(25).alias("q1"), at(50).alias("median"), at(75).alias("q3"))
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    value = F.col("predicted_clv")
    inside = value.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        clv.join(F.broadcast(boxes), "Segment")
        .groupBy("Segment", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def clv_summary(clv: DataFrame) -> DataFrame:
    marks = exact_quantiles(clv, [], "predicted_clv", "CustomerID", [50, 90])
    middle = {r["percent"]: r["quantile"] for r in marks.collect()}
    return clv.agg(
        F.avg("predicted_clv").alias("mean_clv"),
        F.lit(middle.get(50)).cast("double").alias("median_clv"),
        F.lit(middle.get(90)).cast("double").alias("p90_clv"),
        F.sum("predicted_clv").alias("total_clv"),
    )


def churn_value_quadrants(clv: DataFrame) -> DataFrame:
    """Each customer against the two medians; strictly above counts as high."""
    def median(column: str) -> Column:
        found = exact_quantiles(clv, [], column, "CustomerID", [50]).first()
        return F.lit(found["quantile"] if found else None).cast("double")

    risk = F.when(F.col("churn_prob_annual") > median("churn_prob_annual"), "High risk").otherwise("Low risk")
    value = F.when(F.col("predicted_clv") > median("predicted_clv"), "High value").otherwise("Low value")
    return clv.withColumn("quadrant", F.concat_ws(" / ", risk, value))


def top_by_clv(clv: DataFrame, n: int = 20) -> DataFrame:
    return clv.orderBy(F.desc("predicted_clv"), "CustomerID").limit(n)
