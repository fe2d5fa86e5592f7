"""The named SQL reports over the tables `transactions` and `rfm`.

Each report first reduces lines to one row per invoice and customer (or per
customer), and only then joins the customer table or counts distinct ids.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillroll.sources.views import run_query


@dataclass(frozen=True)
class Report:
    """A report: the name of its registered query, its statement, and what it tells."""

    query: str
    sql: str
    insight: str


# The dictionary keys are fixed values: the names users look reports up by.
REPORTS = {
    "Monthly Revenue Trend": Report(
        query="report_monthly_revenue",
        sql="""
WITH baskets AS (
  SELECT date_format(InvoiceDate, 'yyyy-MM') AS month, Invoice, CustomerID, SUM(TotalPrice) AS spend
  FROM transactions
  WHERE CustomerID IS NOT NULL
  GROUP BY ALL
)
SELECT month,
       ROUND(CAST(SUM(spend) AS DOUBLE), 2) AS revenue,
       COUNT(DISTINCT Invoice) AS num_orders,
       COUNT(DISTINCT CustomerID) AS active_customers
FROM baskets
GROUP BY month
ORDER BY month""",
        insight="Compare order and active-customer counts with revenue to tell larger baskets from more buyers.",
    ),
    "Top 10 Customers by Total Spend": Report(
        query="report_top_customers",
        sql="""
WITH spenders AS (
  SELECT CustomerID, SUM(TotalPrice) AS spend, COUNT(DISTINCT Invoice) AS num_orders
  FROM transactions
  WHERE CustomerID IS NOT NULL
  GROUP BY CustomerID
)
SELECT s.CustomerID, r.Segment, r.Cluster_Name AS cluster,
       ROUND(CAST(s.spend AS DOUBLE), 2) AS total_spend,
       s.num_orders,
       ROUND(CAST(s.spend AS DOUBLE) / s.num_orders, 2) AS avg_order_value
FROM spenders s JOIN rfm r USING (CustomerID)
ORDER BY s.spend DESC, s.CustomerID
LIMIT 10""",
        insight="Shows how far revenue depends on a few accounts, and in which segment they sit.",
    ),
    "Revenue and Orders by RFM Segment": Report(
        query="report_segments",
        sql="""
WITH baskets AS (
  SELECT CustomerID, Invoice, SUM(TotalPrice) AS spend
  FROM transactions
  WHERE CustomerID IS NOT NULL
  GROUP BY ALL
)
SELECT r.Segment,
       COUNT(DISTINCT b.CustomerID) AS customers,
       ROUND(CAST(SUM(b.spend) AS DOUBLE), 2) AS total_revenue,
       COUNT(DISTINCT b.Invoice) AS total_orders,
       ROUND(CAST(SUM(b.spend) AS DOUBLE) / COUNT(DISTINCT b.CustomerID), 2) AS revenue_per_customer
FROM baskets b JOIN rfm r USING (CustomerID)
GROUP BY r.Segment
ORDER BY total_revenue DESC, r.Segment""",
        insight="Revenue per customer ranks the segments by what winning back or keeping one customer is worth.",
    ),
    "Average Order Value by K-Means Cluster": Report(
        query="report_clusters",
        sql="""
WITH baskets AS (
  SELECT CustomerID, Invoice, SUM(TotalPrice) AS spend, COUNT(*) AS line_count
  FROM transactions
  WHERE CustomerID IS NOT NULL
  GROUP BY ALL
)
SELECT r.Cluster_Name AS cluster,
       COUNT(DISTINCT b.CustomerID) AS customers,
       COUNT(DISTINCT b.Invoice) AS orders,
       ROUND(CAST(SUM(b.spend) AS DOUBLE), 2) AS total_revenue,
       ROUND(CAST(SUM(b.spend) AS DOUBLE) / SUM(b.line_count), 2) AS avg_line_value,
       ROUND(CAST(SUM(b.spend) AS DOUBLE) / COUNT(DISTINCT b.Invoice), 2) AS avg_order_value
FROM baskets b JOIN rfm r USING (CustomerID)
GROUP BY r.Cluster_Name
ORDER BY avg_order_value DESC, cluster""",
        insight="Clusters with large orders call for account care, those with small ones for volume campaigns.",
    ),
    "Top 15 Products by Revenue": Report(
        query="report_top_products",
        sql="""
WITH sold AS (
  SELECT Description, Invoice, SUM(TotalPrice) AS spend, SUM(Quantity) AS units,
         SUM(Price) AS price_total, COUNT(*) AS line_count
  FROM transactions
  WHERE CustomerID IS NOT NULL
    AND Description NOT IN ('POSTAGE', 'MANUAL', 'DOTCOM POSTAGE', 'CRUK COMMISSION')
  GROUP BY ALL
)
SELECT Description AS product,
       ROUND(CAST(SUM(spend) AS DOUBLE), 2) AS total_revenue,
       SUM(units) AS units_sold,
       COUNT(DISTINCT Invoice) AS num_orders,
       ROUND(CAST(SUM(price_total) AS DOUBLE) / SUM(line_count), 2) AS avg_unit_price
FROM sold
GROUP BY Description
ORDER BY SUM(spend) DESC, Description
LIMIT 15""",
        insight="The products to watch first for stock and promotion.",
    ),
    "Customer Retention Rate": Report(
        query="report_retention",
        sql="""
WITH buyers AS (
  SELECT CustomerID, COUNT(DISTINCT Invoice) AS orders
  FROM transactions
  WHERE CustomerID IS NOT NULL
  GROUP BY CustomerID
), tally AS (
  SELECT COUNT(*) AS total_customers,
         COUNT_IF(orders >= 2) AS returning_customers,
         COUNT_IF(orders = 1) AS one_time_buyers
  FROM buyers
)
SELECT total_customers, returning_customers,
       ROUND(try_divide(100.0D * returning_customers, total_customers), 1) AS retention_pct,
       one_time_buyers,
       ROUND(try_divide(100.0D * one_time_buyers, total_customers), 1) AS one_time_pct
FROM tally""",
        insight="The share of buyers who never came back is the room a second-purchase offer has.",
    ),
    "Revenue by Country (Top 10)": Report(
        query="report_countries",
        sql="""
WITH baskets AS (
  SELECT Country, CustomerID, Invoice, SUM(TotalPrice) AS spend
  FROM transactions
  WHERE CustomerID IS NOT NULL AND Country <> 'Unspecified'
  GROUP BY ALL
), countries AS (
  SELECT Country,
         COUNT(DISTINCT CustomerID) AS customers,
         COUNT(DISTINCT Invoice) AS orders,
         SUM(spend) AS spend
  FROM baskets
  GROUP BY Country
)
SELECT Country, customers, orders,
       ROUND(CAST(spend AS DOUBLE), 2) AS revenue,
       ROUND(100.0D * CAST(spend AS DOUBLE) / CAST(SUM(spend) OVER () AS DOUBLE), 1) AS revenue_share_pct
FROM countries
ORDER BY spend DESC, Country
LIMIT 10""",
        insight="Shares refer to all known countries, so the ten shown need not add up to 100.",
    ),
}


def run_report(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """Runs a named report over the given `transactions` and `rfm`, or over the session's views of these names."""
    return run_query(spark, REPORTS[name].sql, **tables)
