"""Product recommendations per customer cluster, and their offline evaluation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions.ratios import ratio
from tillroll.functions.scoring import risk_level
from tillroll.operators.cleaning import products_only
from tillroll.operators.revenue import top_products
from tillroll.operators.running import join_heavy, running_totals
from tillroll.schemas import MONEY
from tillroll.sources.staging import stage

# Bounds and default of the list length, and the evaluation depth.
FEWEST, MOST, USUAL = 1, 20, 5
EVALUATION_DEPTH = 10


def recommend_popular(transactions: DataFrame, n: int = USUAL) -> DataFrame:
    return top_products(transactions, n)


def cluster_product_revenue(transactions: DataFrame, rfm: DataFrame) -> DataFrame:
    """Revenue and lines per cluster and product. Lines are summed per customer and
    product before the join, so a customer with very many lines arrives as at most
    one row per product."""
    bought = products_only(transactions).groupBy("CustomerID", "Description").agg(
        F.sum("TotalPrice").alias("revenue"), F.count(F.lit(1)).alias("lines"))
    members = rfm.select("CustomerID", "Cluster_Name").dropna()
    return bought.join(members, "CustomerID").groupBy("Cluster_Name", "Description").agg(
        F.sum("revenue").cast(MONEY).alias("revenue"), F.sum("lines").alias("lines"))


def ranked_products(revenue: DataFrame, deepest: int) -> DataFrame:
    """The first `deepest` products of each cluster. Spark drops lower ranks inside
    each task before the shuffle."""
    order = Window.partitionBy("Cluster_Name").orderBy(F.desc("revenue"), "Description")
    return revenue.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= deepest)


def cluster_top_products(transactions: DataFrame, rfm: DataFrame, n: int = USUAL) -> DataFrame:
    return ranked_products(cluster_product_revenue(transactions, rfm), n).drop("lines")


def recommend_for_all(transactions: DataFrame, rfm: DataFrame, n: int = USUAL) -> DataFrame:
    """A list of `n` products for every customer; one list per cluster is broadcast,
    at most 20 names each. A single customer is a filter on CustomerID."""
    if not FEWEST <= n <= MOST:
        raise ValueError(f"n must be between {FEWEST} and {MOST}")
    lists = (
        cluster_top_products(transactions, rfm, n).groupBy("Cluster_Name")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "Description"))).alias("ranked"))
        .select("Cluster_Name", F.col("ranked.Description").alias("recommendations"))
    )
    return (
        rfm.select("CustomerID", "Cluster_Name")
        .join(F.broadcast(lists), "Cluster_Name", "left")
        .select("CustomerID", "Cluster_Name",
                F.coalesce("recommendations", F.array().cast("array<string>")).alias("recommendations"))
    )


def sample_per_cluster(transactions: DataFrame, rfm: DataFrame, n: int = USUAL) -> DataFrame:
    """The lowest customer id of each cluster with its recommendations."""
    firsts = rfm.dropna(subset=["Cluster_Name"]).groupBy("Cluster_Name").agg(F.min("CustomerID").alias("CustomerID"))
    return firsts.join(cluster_top_products(transactions, rfm, n), "Cluster_Name").select(
        "Cluster_Name", "CustomerID", "rank", "Description", "revenue")


def last_purchases(transactions: DataFrame) -> DataFrame:
    """Last purchase time of customers who bought at two or more times."""
    return (
        transactions.groupBy("CustomerID")
        .agg(F.min("InvoiceDate").alias("first_time"), F.max("InvoiceDate").alias("InvoiceDate"))
        .filter(F.col("first_time") < F.col("InvoiceDate"))
        .drop("first_time")
    )


def held_out_lines(transactions: DataFrame) -> DataFrame:
    """Lines of each such customer's last time. Joining on customer and time spreads
    the lines of a busy customer."""
    return transactions.join(last_purchases(transactions), ["CustomerID", "InvoiceDate"], "left_semi")


def training_lines(transactions: DataFrame) -> DataFrame:
    """All other lines."""
    return transactions.join(last_purchases(transactions), ["CustomerID", "InvoiceDate"], "left_anti")


def products_ahead(lowered: DataFrame, revenue: DataFrame) -> DataFrame:
    """`lowered` with `ahead`: products of its cluster that sell more than its new revenue (of equal ones,
    those earlier in the alphabet).

    Lists and lowered products are sorted together by ranges, so neither a cluster nor a popular
    product meets in one task.
    """
    listed = revenue.select("Cluster_Name", "Description", F.col("revenue").alias("standing"), F.lit(1).alias("listed"))
    asked = lowered.withColumns({"standing": F.col("new_revenue"), "listed": F.lit(0)})
    rows = asked.unionByName(listed, allowMissingColumns=True)
    order = [F.desc("standing"), F.asc("Description"), F.asc("listed"), F.asc("CustomerID")]
    ahead = running_totals(rows, ["Cluster_Name"], order, {"ahead": "listed"}, "products-in-order")
    return ahead.filter("listed = 0").drop("standing", "listed")


def holdout_hits(transactions: DataFrame, rfm: DataFrame, k: int = EVALUATION_DEPTH) -> DataFrame:
    """Per evaluated customer: products held out, and how many of them the list made
    without the hold-out still contains.

    Leaving out a customer's last lines only lowers (or removes) the products in them.
    A held-out product is listed if fewer than `k` products stand above its new revenue:
    those of the old list, less the customer's held-out ones that stood there, plus those
    of them that still do.
    """
    held = (
        products_only(held_out_lines(transactions)).groupBy("CustomerID", "Description")
        .agg(F.sum("TotalPrice").alias("own_revenue"), F.count(F.lit(1)).alias("own_lines"))
        .join(rfm.select("CustomerID", "Cluster_Name").dropna(), "CustomerID")
    )
    held = stage(held, "held-out-products")
    revenue = stage(cluster_product_revenue(transactions, rfm), "cluster-products")
    lowered = stage(join_heavy(held, revenue, ["Cluster_Name", "Description"]).select(
        "CustomerID", "Cluster_Name", "Description", "revenue",
        (F.col("revenue") - F.col("own_revenue")).alias("new_revenue"),
        (F.col("lines") > F.col("own_lines")).alias("remains")), "lowered-products")

    # One number per cluster.
    sizes = {r[0]: r[1] for r in revenue.groupBy("Cluster_Name").count().collect()}
    listed = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("Cluster_Name")) if sizes else F.lit(0)
    customers = lowered.groupBy("CustomerID", "Cluster_Name").agg(
        F.count(F.lit(1)).alias("held_out"), F.count_if(~F.col("remains")).alias("removed"))
    evaluated = customers.filter(listed > F.col("removed"))

    old = F.struct(F.col("revenue").alias("standing"), F.lit(1).alias("place"), F.lit(-1).alias("weight"), F.lit(None).cast("bigint").alias("ahead"))
    new = F.struct(F.col("new_revenue").alias("standing"), F.lit(0).alias("place"), F.when(
        F.col("remains"), 1).otherwise(0).alias("weight"), F.when(F.col("remains"), F.col("ahead")).alias("ahead"))
    own = Window.partitionBy("CustomerID").orderBy(F.desc("standing"), "Description", "place").rowsBetween(
        Window.unboundedPreceding, -1)
    hits = (
        products_ahead(lowered, revenue).select("CustomerID", "Description", F.inline(F.array(old, new)))
        .withColumn("above", F.col("ahead") + F.coalesce(F.sum("weight").over(own), F.lit(0)))
        .groupBy("CustomerID").agg(F.count_if(F.col("above") < k).alias("hits"))
    )
    return evaluated.select("CustomerID", "held_out").join(hits, "CustomerID")


def evaluate_recommendations(
    transactions: DataFrame, rfm: DataFrame, k: int = EVALUATION_DEPTH,
    sample_size: int | None = None, seed: int = 42,
) -> DataFrame:
    """Mean precision and recall at `k` and the number of customers evaluated; all of
    them unless `sample_size` asks for a fixed shuffled sample."""
    per_customer = holdout_hits(transactions, rfm, k)
    if sample_size is not None:
        draw = F.md5(F.concat_ws("|", F.col("CustomerID").cast("string"), F.lit(str(seed))))
        per_customer = per_customer.orderBy(draw, "CustomerID").limit(sample_size)
    return per_customer.agg(
        F.round(F.coalesce(F.avg(ratio(F.col("hits"), F.lit(k))), F.lit(0.0)), 4).alias(f"precision_at_{k}"),
        F.round(F.coalesce(F.avg(ratio(F.col("hits"), F.col("held_out"))), F.lit(0.0)), 4).alias(f"recall_at_{k}"),
        F.count(F.lit(1)).alias("n_evaluated"),
    )


def customer_profiles(scored: DataFrame) -> DataFrame:
    """One display row per customer; `scored` carries churn_prob. A lookup is a
    filter on customer_id, empty for an unknown one."""
    p = F.col("churn_prob")
    return scored.select(
        F.col("CustomerID").alias("customer_id"),
        F.round(F.col("recency").cast("double"), 1).alias("recency_days"),
        "frequency",
        F.round(F.col("monetary").cast("double"), 2).alias("monetary"),
        F.col("`R-Score`").alias("r_score"), F.col("`F-Score`").alias("f_score"), F.col("`M-Score`").alias("m_score"),
        F.col("Segment").alias("segment"), F.col("Cluster_Name").alias("cluster_name"),
        F.round(p, 4).alias("churn_probability"), risk_level(p).alias("risk_level"),
    )
