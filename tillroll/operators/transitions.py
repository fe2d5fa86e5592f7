"""Segments month by month, and how customers move between them.

A customer's standing changes only in months with a purchase. The staged table
holds one row per such month with the running totals and the month of the next
change. The monthly cut-offs are counted from these changes (a standing enters a
value cell in one month and leaves it in another), so the row-per-month table is
unfolded once, inside tasks, to compare it with the cut-offs of its month.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions.dates import elapsed_days, month_end, month_start
from tillroll.functions.scoring import SEGMENTS
from tillroll.operators.month_ranks import (
    entries_and_exits, rows_at_monthly_ranks, standing_by_month, standing_in,
)
from tillroll.operators.rfm import (
    QUINTILES, apply_cuts, ranked_amounts, recency_edges, with_amounts, with_total_and_segment,
)
from tillroll.schemas import MONEY
from tillroll.sources.staging import stage

# Limits of the power iteration and its closeness test.
MAX_STEPS, ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE = 1000, 1e-8, 1e-5


def monthly_activity(transactions: DataFrame) -> DataFrame:
    """Per customer and active month: spend, last purchase, invoices first seen.

    Lines are first reduced to one row per invoice and month, so a busy customer
    or a very long invoice is spread over tasks and shrinks before it is moved.
    """
    per_invoice = transactions.groupBy(
        "CustomerID", "Invoice", month_start(F.col("InvoiceDate")).alias("Month")
    ).agg(F.sum("TotalPrice").alias("spend"), F.max("InvoiceDate").alias("last_purchase"))
    first_month = F.min("Month").over(Window.partitionBy("CustomerID", "Invoice"))
    return (
        per_invoice.withColumn("is_new", F.when(F.col("Month") == first_month, 1).otherwise(0))
        .groupBy("CustomerID", "Month")
        .agg(
            F.sum("is_new").alias("new_invoices"),
            F.sum("spend").alias("spend"),
            F.max("last_purchase").alias("last_purchase"),
        )
    )


def standing_changes(transactions: DataFrame) -> DataFrame:
    """Running totals after each active month, and the next active month."""
    so_far = Window.partitionBy("CustomerID").orderBy("Month")
    return monthly_activity(transactions).select(
        "CustomerID",
        F.col("Month").alias("from_month"),
        F.lead("Month").over(so_far).alias("until_month"),
        F.sum("new_invoices").over(so_far).alias("frequency"),
        F.sum("spend").over(so_far).cast(MONEY).alias("monetary"),
        F.max("last_purchase").over(so_far).alias("last_purchase"),
    )


def unfold_months(changes: DataFrame) -> DataFrame:
    """One row per customer and month of the data from the first purchase on."""
    last = changes.agg(F.max("from_month")).scalar()
    months = changes.select(F.col("from_month").alias("Month")).distinct()
    stop = F.coalesce(F.add_months("until_month", -1), last)
    every = F.explode(F.sequence(F.col("from_month"), stop, F.expr("INTERVAL 1 MONTH")))
    return (
        changes.withColumn("Month", every)
        .join(F.broadcast(months), "Month", "left_semi")
        .withColumn("recency", elapsed_days(month_end(F.col("Month")), F.col("last_purchase")))
        .drop("from_month", "until_month", "last_purchase")
    )


def _monthly_recencies(changes: DataFrame, months: DataFrame) -> DataFrame:
    """(Month, recency, size): standing customers by the day of their last purchase.

    A month ends with its last microsecond, so the whole days to a purchase are those
    to the start of its day.
    """
    days = standing_by_month(entries_and_exits(changes.withColumn("day", F.to_date("last_purchase")), "day"), "day")
    recency = elapsed_days(month_end(F.col("Month")), F.col("day").cast("timestamp_ntz"))
    return (
        days.join(F.broadcast(months), F.trunc("day", "month") <= F.col("Month"))
        .select("Month", recency.alias("recency"), standing_in(F.col("Month")).alias("size"))
        .filter(F.col("size") > 0)
    )


def _monthly_rank_cuts(changes: DataFrame) -> DataFrame:
    """Per month the last (amount, customer) of each of the first four fifths of both metrics."""
    amounts = ranked_amounts(changes, "from_month", "until_month")
    found = rows_at_monthly_ranks(
        amounts, "metric", "amount", "CustomerID",
        lambda n: [(n - 1) * k // QUINTILES + 1 for k in range(1, QUINTILES)])
    cut = F.struct("amount", "CustomerID")
    return found.groupBy("Month").agg(*[
        F.max(F.when((F.col("metric") == m) & (F.col("k") == k - 1), cut)).alias(f"{m}{k}")
        for m in ("f", "m") for k in range(1, QUINTILES)])


def monthly_cuts(changes: DataFrame) -> DataFrame:
    """All twelve cut-offs, one row per month of the data."""
    months = changes.select(F.col("from_month").alias("Month")).distinct()
    edges = recency_edges(_monthly_recencies(changes, months), ["Month"])
    return edges.join(_monthly_rank_cuts(changes), "Month")


def monthly_segments(transactions: DataFrame) -> DataFrame:
    """Segment of every customer in every month of the data, scored on all
    purchases up to the end of that month."""
    changes = stage(standing_changes(transactions), "standing-changes")
    cuts = monthly_cuts(changes)
    # Customers are placed before their months are unfolded, so `next_segments` finds
    # each customer's months side by side without moving the long table. They are put in order
    # before that too, so that sorting the long table only finds it sorted.
    placed = with_amounts(changes).repartition("CustomerID").sortWithinPartitions("CustomerID", "from_month")
    by_customer = unfold_months(placed)
    scored = with_total_and_segment(apply_cuts(by_customer, cuts, ["Month"]))
    return scored.select("CustomerID", "Month", "Segment")


def next_segments(segments: DataFrame) -> DataFrame:
    """Pairs of segments in months exactly one month apart."""
    order = Window.partitionBy("CustomerID").orderBy("Month")
    return (
        segments.select(
            "CustomerID", "Month", "Segment",
            F.lead("Segment").over(order).alias("Next_Segment"),
            F.lead("Month").over(order).alias("Next_Month"),
        )
        .filter(F.col("Next_Month") == F.add_months("Month", 1))
    )


def transition_counts(pairs: DataFrame) -> DataFrame:
    """4 x 4 counts in fixed order, 0 where no customer moved."""
    spark = pairs.sparkSession
    frame = spark.createDataFrame(list(enumerate(SEGMENTS)), "place int, Segment string")
    wide = pairs.groupBy("Segment").pivot("Next_Segment", SEGMENTS).count()
    return (
        frame.join(F.broadcast(wide), "Segment", "left")
        .orderBy("place")
        .select("Segment", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s) for s in SEGMENTS])
    )


def transition_matrix(counts: DataFrame) -> DataFrame:
    """Each row as percentages; a segment nobody left gives NULLs."""
    total = sum((F.col(f"`{s}`") for s in SEGMENTS), F.lit(0))
    return counts.select(
        "Segment",
        *[F.try_divide(F.col(f"`{s}`") * F.lit(100.0), total.cast("double")).alias(s) for s in SEGMENTS],
    )


def _close(old: list[float], new: list[float]) -> bool:
    return all(abs(a - b) <= ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * abs(b) for a, b in zip(old, new))


def steady_state(matrix: DataFrame) -> DataFrame:
    """Long-run share per segment: the 16 aggregated cells are iterated from an even
    start, and the vector before the last, negligible step is returned."""
    spark = matrix.sparkSession
    rows = {r["Segment"]: r for r in matrix.collect()}
    cells = [[rows[a][b] for b in SEGMENTS] for a in SEGMENTS]
    shares = [1.0 / len(SEGMENTS)] * len(SEGMENTS)
    if any(c is None for row in cells for c in row):
        shares = [None] * len(SEGMENTS)
    else:
        for _ in range(MAX_STEPS):
            moved = [
                sum(shares[a] * cells[a][b] / 100.0 for a in range(len(SEGMENTS)))
                for b in range(len(SEGMENTS))
            ]
            if _close(shares, moved):
                break
            shares = moved
    data = [(i, s, None if p is None else p * 100.0) for i, (s, p) in enumerate(zip(SEGMENTS, shares))]
    return spark.createDataFrame(data, "place int, Segment string, steady_pct double").orderBy("place").drop("place")
