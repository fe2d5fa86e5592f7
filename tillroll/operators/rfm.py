"""Recency, frequency and monetary scores, and the segments they give."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillroll.functions.dates import elapsed_days
from tillroll.functions.scoring import segment_name
from tillroll.operators.ranking import rows_at_ranks
from tillroll.schemas import MONEY
from tillroll.sources.staging import stage

QUINTILES = 5
_CUTS = range(1, QUINTILES)
_WHOLE = "_whole_table"
# What is ranked, as integers (money in millionths): cheaper to sort and compare
# than wide decimals, and just as exact.
_RANKED = {"f": "CAST(frequency AS BIGINT)", "m": "CAST(monetary * 1000000 AS BIGINT)"}


def customer_history(transactions: DataFrame) -> DataFrame:
    """One row per customer. Spark first groups by (customer, invoice), which
    spreads a customer with very many lines over all tasks."""
    return transactions.groupBy("CustomerID").agg(
        F.min("InvoiceDate").alias("first_purchase"),
        F.max("InvoiceDate").alias("last_purchase"),
        F.countDistinct("Invoice").alias("frequency"),
        F.sum("TotalPrice").cast(MONEY).alias("monetary"),
    )


def rfm_base(transactions: DataFrame) -> DataFrame:
    """Recency is counted from one day after the last invoice of all.

    The history is staged: whatever reads the result scans one row per customer and
    never touches the transactions again.
    """
    history = stage(customer_history(transactions), "customer-history")
    latest = history.agg(F.max("last_purchase")).first()[0]
    reference = F.lit(latest).cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY")
    return history.select(
        "CustomerID",
        elapsed_days(reference, F.col("last_purchase")).alias("recency"),
        "frequency",
        "monetary",
    )


def _cut_ranks(n: Column) -> Column:
    """Rank of the last row of each of the first four fifths, where the edges lie at
    1 + (n - 1) k / 5 (not at n k / 5, as `ntile` has it)."""
    return F.array(*[F.floor((n - 1) * k / F.lit(QUINTILES)).cast("bigint") + 1 for k in _CUTS])


def recency_edges(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Upper edges of the recency fifths, times 5 so that they stay integers.

    Recency has few distinct values (days of the period), so the edges come from its
    histogram, given as `sizes` (keys, recency, size). An edge between sorted places
    `at` and `at + 1` is interpolated.
    """
    group = Window.partitionBy(*keys)
    histogram = (
        sizes.withColumn("through", F.sum("size").over(group.orderBy("recency")))
        .withColumn("n", F.sum("size").over(group))
    )

    def value_at(place: Column) -> Column:
        holds = (place <= F.col("through")) & (place > F.col("through") - F.col("size"))
        return F.max(F.when(holds, F.col("recency")))

    edges = []
    for k in _CUTS:
        steps = (F.col("n") - 1) * k
        rest = F.pmod(steps, F.lit(QUINTILES))
        at = ((steps - rest) / QUINTILES).cast("bigint") + 1
        low, high = value_at(at), value_at(F.least(at + 1, F.col("n")))
        edges.append((QUINTILES * low + F.max(rest) * (high - low)).alias(f"r{k}"))
    return histogram.groupBy(*keys).agg(*edges)


def ranked_amounts(customers: DataFrame, *keep: str) -> DataFrame:
    """(keep, CustomerID, metric, amount) rows; amounts are integers."""
    return customers.select(
        *keep, "CustomerID",
        F.expr(f"stack(2, 'f', {_RANKED['f']}, 'm', {_RANKED['m']})").alias("metric", "amount"),
    )


def rank_cuts(customers: DataFrame, by: list[str]) -> DataFrame:
    """Last (value, customer) of each of the first four fifths of frequency and of
    monetary, when customers are ranked one by one (ties by customer id)."""
    keys = by or [_WHOLE]
    metrics = ranked_amounts(customers, *keys)
    found = rows_at_ranks(metrics, keys + ["metric"], "amount", "CustomerID", _cut_ranks)
    cut = F.struct("amount", "CustomerID")
    return found.groupBy(*keys).agg(*[
        F.max(F.when((F.col("metric") == m) & (F.col("k") == k - 1), cut)).alias(f"{m}{k}")
        for m in ("f", "m") for k in _CUTS
    ])


def score_cuts(customers: DataFrame, by: list[str]) -> DataFrame:
    """All twelve cut-offs, one row per group."""
    keys = by or [_WHOLE]
    sizes = customers.groupBy(*keys, "recency").agg(F.count(F.lit(1)).alias("size"))
    return recency_edges(sizes, keys).join(rank_cuts(customers, by), keys)


def _passed(conditions: list[Column]) -> Column:
    return sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0))


def _as_literals(cuts: DataFrame) -> dict[str, Column]:
    """The cut-offs of a whole table are one row, so they become literals."""
    row = cuts.first()
    columns = {}
    for field in cuts.drop(_WHOLE).schema.fields:
        value = row[field.name] if row else None
        if isinstance(field.dataType, T.StructType) and value is not None:
            parts = [F.lit(value[p.name]).cast(p.dataType).alias(p.name) for p in field.dataType.fields]
            columns[field.name] = F.struct(*parts)
        else:
            columns[field.name] = F.lit(value).cast(field.dataType)
    return columns


def with_amounts(customers: DataFrame) -> DataFrame:
    """`customers` with the integers that are compared with the cut-offs, so that a table that is
    unfolded later computes them once for each row it has before."""
    return customers.withColumns({_amount(m): F.expr(e) for m, e in _RANKED.items()})


def _amount(metric: str) -> str:
    return f"_{metric}_amount"


def apply_cuts(customers: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Adds the three scores by comparing each customer with the cut-offs of its
    group: no sort and no shuffle of the customer table."""
    amounts = [_amount(m) for m in _RANKED]
    ready = customers if set(amounts) <= set(customers.columns) else with_amounts(customers)
    beside = ready.join(F.broadcast(cuts), by) if by else ready.withColumns(_as_literals(cuts))
    tie = F.col("CustomerID")

    def above(metric: str) -> list[Column]:
        own, passed = F.col(_amount(metric)), []
        for k in _CUTS:
            cut, last = F.col(f"{metric}{k}.amount"), F.col(f"{metric}{k}.CustomerID")
            later = F.coalesce(tie > last, tie.isNotNull() & last.isNull())
            passed.append((own > cut) | ((own == cut) & later))
        return passed

    late = [QUINTILES * F.col("recency") > F.col(f"r{k}") for k in _CUTS]
    return beside.select(
        *[c for c in customers.columns if c not in amounts],
        (QUINTILES - _passed(late)).cast("int").alias("R-Score"),
        (1 + _passed(above("f"))).cast("int").alias("F-Score"),
        (1 + _passed(above("m"))).cast("int").alias("M-Score"),
    )


def with_scores(customers: DataFrame) -> DataFrame:
    """Scores over the whole table. `customers` is read more than once, so it should
    rest on a staged table, as `rfm_base` does; the result is a scan of it."""
    whole = customers.withColumn(_WHOLE, F.lit(1))
    return apply_cuts(customers, score_cuts(whole, []), [])


def with_total_and_segment(scored: DataFrame) -> DataFrame:
    total = F.col("`R-Score`") + F.col("`F-Score`") + F.col("`M-Score`")
    return scored.withColumn("RFM_Score", total).withColumn("Segment", segment_name(F.col("RFM_Score")))


def compute_rfm(transactions: DataFrame) -> DataFrame:
    return with_total_and_segment(with_scores(rfm_base(transactions)))
