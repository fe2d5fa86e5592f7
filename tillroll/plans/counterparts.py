"""SQL statements that state, independently of the operators, what each registered
query must return. They run on the same Parquet tables in any engine with the
usual analytic functions; ranks, quantiles and monthly totals are written out by
definition rather than by the operators' way of computing them."""

# Labels as the results must spell them.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SEGMENTS = ["Champions", "Loyal", "At Risk", "Lost"]
RISK_ACTIONS = {
    "High": "Trigger immediate re-engagement campaign with discount offer",
    "Medium": "Send personalised email with new product recommendations",
    "Low": "Customer is healthy — maintain regular comms",
}

_RAW = """
base AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
         o_custkey, o_orderdate, n_nationkey, n_name, p_name
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey),
copies AS (
  SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_orderkey % 37 = 0),
raw AS (
  SELECT CASE WHEN l_orderkey % 50 = 0 THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS Invoice,
         CAST(l_partkey AS VARCHAR) AS StockCode,
         CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 101 = 0 THEN 'Postage'
              WHEN l_partkey % 103 = 0 THEN 'MANUAL' ELSE p_name END AS Description,
         CAST(CASE WHEN (l_orderkey + l_linenumber) % 41 = 0 THEN -l_quantity
                   WHEN (l_orderkey + l_linenumber) % 997 = 0 THEN 10000
                   ELSE l_quantity END AS BIGINT) AS Quantity,
         o_orderdate AS InvoiceDate,
         CASE WHEN (l_partkey + l_linenumber) % 211 = 0 THEN CAST(0 AS DECIMAL(18,2))
              ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS Price,
         CASE WHEN l_orderkey % 4 = 1 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS "Customer ID",
         CASE n_nationkey WHEN 0 THEN 'United Kingdom' WHEN 24 THEN 'Unspecified' ELSE n_name END AS Country
  FROM copies)"""

_TX = """,
tx AS (
  SELECT Invoice, StockCode, Description, Quantity, InvoiceDate, Price,
         CAST("Customer ID" AS BIGINT) AS CustomerID, Country,
         CAST(Quantity * Price AS DECIMAL(28,2)) AS TotalPrice
  FROM (SELECT DISTINCT * FROM raw)
  WHERE "Customer ID" IS NOT NULL AND Description IS NOT NULL
    AND Quantity > 0 AND Quantity < 10000 AND Price > 0 AND NOT starts_with(Invoice, 'C'))"""

_HISTORY = """,
history AS (
  SELECT CustomerID, MIN(InvoiceDate) AS first_purchase, MAX(InvoiceDate) AS last_purchase,
         COUNT(DISTINCT Invoice) AS frequency, SUM(TotalPrice) AS monetary
  FROM tx GROUP BY CustomerID),
rfm_base AS (
  SELECT CustomerID,
         date_sub('day', last_purchase, (SELECT MAX(InvoiceDate) + INTERVAL 1 DAY FROM tx)) AS recency,
         frequency, monetary
  FROM history)"""


def _quintiles(source: str, group: str) -> str:
    """Scores by definition: interpolated edges for recency, ranks for the others."""
    part = f"PARTITION BY {group}" if group else ""
    by = f"GROUP BY {group}" if group else ""
    carry = f"{group}," if group else ""
    join = f"JOIN edges USING ({group})" if group else "CROSS JOIN edges"
    at = lambda k: f"v[((n-1)*{k})//5 + 1]"
    after = lambda k: f"coalesce(v[((n-1)*{k})//5 + 2], {at(k)})"
    edges = ", ".join(f"5*{at(k)} + (((n-1)*{k})%5) * ({after(k)} - {at(k)}) AS e{k}" for k in range(1, 5))
    late = " + ".join(f"CASE WHEN 5*recency > e{k} THEN 1 ELSE 0 END" for k in range(1, 5))
    fifth = lambda r: f"CASE WHEN n = 1 THEN 1 ELSE greatest(1, (5*({r}-1)+n-2)//(n-1)) END"
    return f"""
edges AS (
  SELECT {carry} {edges}
  FROM (SELECT {carry} list(recency ORDER BY recency) AS v, COUNT(*) AS n FROM {source} {by})),
placed AS (
  SELECT *, COUNT(*) OVER ({part}) AS n,
         ROW_NUMBER() OVER ({part} ORDER BY frequency, CustomerID) AS rank_f,
         ROW_NUMBER() OVER ({part} ORDER BY monetary, CustomerID) AS rank_m
  FROM {source}),
scored AS (
  SELECT placed.*, 5 - ({late}) AS r_score, {fifth('rank_f')} AS f_score, {fifth('rank_m')} AS m_score
  FROM placed {join}),
totalled AS (
  SELECT *, r_score + f_score + m_score AS total,
         CASE WHEN r_score + f_score + m_score >= 12 THEN 'Champions'
              WHEN r_score + f_score + m_score >= 9 THEN 'Loyal'
              WHEN r_score + f_score + m_score >= 6 THEN 'At Risk' ELSE 'Lost' END AS Segment
  FROM scored)"""


_RFM = _HISTORY + "," + _quintiles("rfm_base", "") + """,
rfm AS (
  SELECT CustomerID, recency, frequency, monetary, r_score, f_score, m_score, total, Segment,
         CASE Segment WHEN 'Champions' THEN 0 WHEN 'Lost' THEN 2 ELSE 1 END AS Cluster,
         CASE Segment WHEN 'Champions' THEN 'High Value' WHEN 'Lost' THEN 'Churned'
                      ELSE 'Active Regular' END AS Cluster_Name,
         (11 - f_score - m_score) / 10.0::DOUBLE AS churn_prob,
         CASE WHEN recency > 180 THEN 1 ELSE 0 END AS Churned
  FROM totalled)"""

_PURCHASES = """
purchases AS (
  SELECT CAST(event_id AS VARCHAR) AS Invoice, user_id AS CustomerID, ts AS InvoiceDate,
         CAST(value AS DECIMAL(28,2)) AS TotalPrice
  FROM events WHERE event_type = 'purchase')"""

_STAMP = "strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate"
_RAW_COLUMNS = ('Invoice, StockCode, Description, Quantity, ' + _STAMP +
                ', CAST(Price AS DOUBLE) AS Price, "Customer ID", Country')
_RENAMED_COLUMNS = _RAW_COLUMNS.replace('"Customer ID"', '"Customer ID" AS CustomerID')
_TX_COLUMNS = ("Invoice, StockCode, Description, Quantity, " + _STAMP +
               ", CAST(Price AS DOUBLE) AS Price, CustomerID, Country, CAST(TotalPrice AS DOUBLE) AS TotalPrice")
_CUSTOMER_COLUMNS = ("CustomerID, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, "
                     'r_score AS "R-Score", f_score AS "F-Score", m_score AS "M-Score", total AS "RFM_Score", Segment')
_FILE_COLUMNS = _CUSTOMER_COLUMNS + ", Cluster, Cluster_Name"
# Descriptions that are charges.
_PRODUCTS = "upper(Description) NOT IN ('POSTAGE','MANUAL','DOTCOM POSTAGE','CRUK COMMISSION')"
_PRODUCTS_EXACT = "Description NOT IN ('POSTAGE','MANUAL','DOTCOM POSTAGE','CRUK COMMISSION')"
_WEEKDAY_LIST = ", ".join(f"({i}, '{d}')" for i, d in enumerate(WEEKDAYS, 1))
_SEGMENT_LIST = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEGMENTS))


def _raw(body: str) -> str:
    return f"WITH {_RAW}\n{body}"


def _tx(body: str, parts: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE' if recursive else ''} {_RAW}{_TX}{parts}\n{body}"


def _rfm(body: str, parts: str = "") -> str:
    return f"WITH {_RAW}{_TX}{_RFM}{parts}\n{body}"


def _bought(body: str) -> str:
    return f"WITH {_PURCHASES}\n{body}"


def _half_up(value: str, digits: int = 2) -> str:
    """Decimal rounding of a ratio, so that exact halves go up."""
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


COUNTERPARTS: dict[str, str] = {}

# ---- sources and sinks --------------------------------------------------------

COUNTERPARTS["source_load_parts"] = _raw(f"SELECT {_RAW_COLUMNS} FROM raw")
COUNTERPARTS["source_read_transactions"] = _tx(f"SELECT {_TX_COLUMNS} FROM tx")
_RISK = "(recency - (SELECT MIN(recency) FROM rfm)) / CAST((SELECT MAX(recency) - MIN(recency) FROM rfm) AS DOUBLE)"
_FILE_COLUMNS += f', ROUND({_RISK}, 6) AS "Churn_Risk"'
COUNTERPARTS["source_read_customers"] = _rfm(f"SELECT {_FILE_COLUMNS} FROM rfm")
COUNTERPARTS["sink_write_transactions"] = _tx(f"SELECT {_TX_COLUMNS} FROM tx")
COUNTERPARTS["sink_write_customers"] = _rfm(f"SELECT {_FILE_COLUMNS} FROM rfm")
COUNTERPARTS["sql_views"] = _rfm(
    "SELECT 'transactions' AS view_name, COUNT(*) AS row_count FROM tx UNION ALL SELECT 'rfm', COUNT(*) FROM rfm")
COUNTERPARTS["sql_run_query"] = _rfm("""
SELECT Segment, Country, CAST(SUM(Quantity) AS BIGINT) AS units, CAST(SUM(TotalPrice) AS DOUBLE) AS spend
FROM tx JOIN rfm USING (CustomerID) GROUP BY Segment, Country""")

# ---- cleaning -----------------------------------------------------------------

for _name, _columns, _where in [
    ("rename_customer", _RENAMED_COLUMNS, "TRUE"),
    ("drop_missing_keys", _RENAMED_COLUMNS, '"Customer ID" IS NOT NULL AND Description IS NOT NULL'),
    ("cast_customer", _RENAMED_COLUMNS.replace('"Customer ID" AS', 'CAST("Customer ID" AS BIGINT) AS'), "TRUE"),
    ("positive_quantity", _RAW_COLUMNS, "Quantity > 0"),
    ("positive_price", _RAW_COLUMNS, "Price > 0"),
    ("quantity_cap", _RAW_COLUMNS, "Quantity < 10000"),
    ("parse_date", _RAW_COLUMNS, "TRUE"),
    ("line_total", _RAW_COLUMNS + ", CAST(Quantity * Price AS DOUBLE) AS TotalPrice", "TRUE"),
    ("drop_cancellations", _RAW_COLUMNS, "NOT starts_with(Invoice, 'C')"),
]:
    COUNTERPARTS[f"cleaning_{_name}"] = _raw(f"SELECT {_columns} FROM raw WHERE {_where}")
COUNTERPARTS["cleaning_drop_duplicates"] = _raw(f"SELECT DISTINCT {_RAW_COLUMNS} FROM raw")
COUNTERPARTS["cleaning_all_steps"] = _tx(f"SELECT {_TX_COLUMNS} FROM tx")
COUNTERPARTS["cleaning_products_only"] = _tx(f"SELECT {_TX_COLUMNS} FROM tx WHERE {_PRODUCTS}")
COUNTERPARTS["cleaning_products_exact_case"] = _tx(f"SELECT {_TX_COLUMNS} FROM tx WHERE {_PRODUCTS_EXACT}")
COUNTERPARTS["cleaning_known_country"] = _tx(f"SELECT {_TX_COLUMNS} FROM tx WHERE Country <> 'Unspecified'")

# ---- dates --------------------------------------------------------------------

for _name, _value in [
    ("month_start", "strftime(InvoiceDate, '%Y-%m-01')"),
    ("month_label", "strftime(InvoiceDate, '%Y-%m')"),
    ("weekday_name", "dayname(InvoiceDate)"),
]:
    COUNTERPARTS[f"date_{_name}"] = _tx(f"SELECT Invoice, StockCode, CustomerID, {_value} AS {_name} FROM tx")
COUNTERPARTS["date_hour_of_day"] = _bought(
    "SELECT Invoice, CustomerID, hour(InvoiceDate) AS hour_of_day FROM purchases")

# ---- profiling ----------------------------------------------------------------

# The raw columns and their types as the query names them.
_RAW_TYPES = [
    ("Invoice", "string"), ("StockCode", "string"), ("Description", "string"), ("Quantity", "bigint"),
    ("InvoiceDate", "timestamp_ntz"), ("Price", "decimal(18,6)"), ("Customer ID", "double"), ("Country", "string"),
]
COUNTERPARTS["profile_missing_values"] = _raw("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{t}' AS "type", COUNT(*) AS "rows", COUNT(*) - COUNT("{c}") AS missing,
    {_half_up(f'100.0 * (COUNT(*) - COUNT("{c}")) / COUNT(*)')} AS missing_pct FROM raw"""
    for c, t in _RAW_TYPES))
COUNTERPARTS["profile_cancellation_rate"] = _raw(f"""
SELECT COUNT(*) FILTER (starts_with(Invoice, 'C')) AS cancelled_rows,
       {_half_up("100.0 * COUNT(*) FILTER (starts_with(Invoice, 'C')) / COUNT(*)", 1)} AS cancelled_pct
FROM raw""")
COUNTERPARTS["profile_cleaning_report"] = _tx(f"""
SELECT r AS raw_rows, c AS clean_rows, r - c AS removed_rows, {_half_up('100.0 * (r - c) / r', 1)} AS removed_pct
FROM (SELECT (SELECT COUNT(*) FROM raw) AS r, (SELECT COUNT(*) FROM tx) AS c)""")
COUNTERPARTS["profile_dataset_summary"] = _tx("""
SELECT COUNT(DISTINCT CustomerID) AS customers, COUNT(DISTINCT Invoice) AS invoices,
       COUNT(DISTINCT Description) AS products,
       strftime(MIN(InvoiceDate), '%Y-%m-%d %H:%M:%S') AS first_date,
       strftime(MAX(InvoiceDate), '%Y-%m-%d %H:%M:%S') AS last_date,
       CAST(SUM(TotalPrice) AS DOUBLE) AS total_revenue
FROM tx""")

_METRICS = ["recency", "frequency", "monetary"]


def _statistic(name: str, template: str) -> str:
    values = ", ".join(f"ROUND({template.format(x=f'CAST({m} AS DOUBLE)')}, 2) AS {m}" for m in _METRICS)
    return f"SELECT '{name}' AS statistic, {values} FROM rfm"


COUNTERPARTS["profile_describe_rfm"] = _rfm("\nUNION ALL\n".join(
    _statistic(n, t) for n, t in [
        ("count", "CAST(COUNT({x}) AS DOUBLE)"), ("mean", "AVG({x})"), ("std", "stddev_samp({x})"),
        ("min", "MIN({x})"), ("25%", "quantile_cont({x}, 0.25)"), ("50%", "quantile_cont({x}, 0.5)"),
        ("75%", "quantile_cont({x}, 0.75)"), ("max", "MAX({x})"),
    ]))


def _histogram(source: str, by: str, bins: int, digits: int) -> str:
    """`source` has columns {by} and value."""
    return f"""
, span AS (
  SELECT {by}, CASE WHEN MIN(value) = MAX(value) THEN MIN(value) - 0.5 ELSE MIN(value) END AS low,
         CASE WHEN MIN(value) = MAX(value) THEN MAX(value) + 0.5 ELSE MAX(value) END AS high
  FROM {source} GROUP BY {by}),
counted AS (
  SELECT {by}, CAST(least(floor((value - low) * {bins} / (high - low)), {bins - 1}) AS BIGINT) AS bin, COUNT(*) AS customers
  FROM {source} JOIN span USING ({by}) GROUP BY ALL)
SELECT {by}, bin, {_half_up(f'low + bin * ((high - low) / {bins})', digits)} AS bin_from,
       {_half_up(f'low + (bin + 1) * ((high - low) / {bins})', digits)} AS bin_to, coalesce(customers, 0) AS customers
FROM (SELECT span.*, unnest(range({bins})) AS bin FROM span) LEFT JOIN counted USING ({by}, bin)"""


_CLIPPED = "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, least(CAST({m} AS DOUBLE), (SELECT quantile_cont(CAST({m} AS DOUBLE), 0.99) FROM rfm)) AS value FROM rfm"
    for m in _METRICS)
COUNTERPARTS["profile_rfm_histograms"] = _rfm(_histogram("clipped", "metric", 40, 4), f", clipped AS ({_CLIPPED})")
COUNTERPARTS["profile_churn_risk_histograms"] = _rfm(
    _histogram("risks", "Cluster_Name", 30, 6), f", risks AS (SELECT Cluster_Name, {_RISK} AS value FROM rfm)")
COUNTERPARTS["profile_coverage_check"] = _rfm("""
SELECT (SELECT COUNT(DISTINCT CustomerID) FROM tx) AS customers_in_data,
       (SELECT COUNT(*) FROM rfm) AS customers_in_rfm""")

# ---- aggregations, rankings, limits -------------------------------------------

_MONTHLY = """, monthly AS (
  SELECT CAST(date_trunc('month', InvoiceDate) AS DATE) AS m, SUM(TotalPrice) AS revenue FROM tx GROUP BY 1)"""
COUNTERPARTS["revenue_monthly"] = _tx(
    "SELECT strftime(m, '%Y-%m-%d') AS Month, CAST(revenue AS DOUBLE) AS revenue FROM monthly", _MONTHLY)
COUNTERPARTS["revenue_peak_month"] = _tx("""
SELECT strftime(m, '%Y-%m-%d') AS Month, CAST(revenue AS DOUBLE) AS revenue
FROM monthly ORDER BY monthly.revenue DESC, m LIMIT 1""", _MONTHLY)
COUNTERPARTS["orders_by_hour"] = _bought(
    'SELECT hour(InvoiceDate) AS "Hour", COUNT(DISTINCT Invoice) AS orders FROM purchases GROUP BY 1')
for _name, _measure, _alias in [
    ("orders_by_weekday", "COUNT(DISTINCT Invoice)", "orders"),
    ("revenue_by_weekday", "CAST(SUM(TotalPrice) AS DOUBLE)", "revenue"),
]:
    COUNTERPARTS[_name] = _tx(f"""
SELECT "DayOfWeek", day_number, {_alias}
FROM (VALUES {_WEEKDAY_LIST}) AS d(day_number, "DayOfWeek")
LEFT JOIN (SELECT dayname(InvoiceDate) AS "DayOfWeek", {_measure} AS {_alias} FROM tx GROUP BY 1) USING ("DayOfWeek")""")
COUNTERPARTS["revenue_by_hour"] = _bought("""
SELECT h AS "Hour", CAST(r AS DOUBLE) AS revenue, ROW_NUMBER() OVER (ORDER BY r DESC, h) <= 3 AS is_peak
FROM (SELECT hour(InvoiceDate) AS h, SUM(TotalPrice) AS r FROM purchases GROUP BY 1)""")


def _top_products(n: int) -> str:
    return _tx(f"""
SELECT Description, CAST(r AS DOUBLE) AS revenue
FROM (SELECT Description, SUM(TotalPrice) AS r FROM tx WHERE {_PRODUCTS} GROUP BY 1)
ORDER BY r DESC, Description LIMIT {n}""")


COUNTERPARTS["products_top"] = _top_products(10)
COUNTERPARTS["revenue_headline_figures"] = _tx("""
SELECT COUNT(DISTINCT CustomerID) AS customers, CAST(SUM(TotalPrice) AS DOUBLE) AS total_revenue,
       COUNT(DISTINCT Invoice) AS total_orders, COUNT(DISTINCT Country) AS countries FROM tx""")
COUNTERPARTS["customers_at_risk_share"] = _rfm(f"""
SELECT {_half_up("100.0 * COUNT(*) FILTER (Segment IN ('At Risk', 'Lost')) / COUNT(*)", 1)} AS at_risk_or_lost_pct FROM rfm""")
COUNTERPARTS["customers_by_segment"] = _rfm("SELECT Segment, COUNT(*) AS customers FROM rfm GROUP BY 1")
COUNTERPARTS["customers_by_cluster"] = _rfm("SELECT Cluster_Name, COUNT(*) AS customers FROM rfm GROUP BY 1")
COUNTERPARTS["revenue_by_country"] = _tx("""
SELECT Country, CAST(r AS DOUBLE) AS revenue
FROM (SELECT Country, SUM(TotalPrice) AS r FROM tx WHERE Country <> 'Unspecified' GROUP BY 1)
ORDER BY r DESC, Country LIMIT 10""")
COUNTERPARTS["revenue_home_and_international"] = _tx(f"""
SELECT market, CAST(r AS DOUBLE) AS revenue, {_half_up('100.0 * CAST(r AS DOUBLE) / CAST(SUM(r) OVER () AS DOUBLE)', 1)} AS share_pct
FROM (SELECT CASE WHEN Country = 'United Kingdom' THEN 'home' ELSE 'international' END AS market,
             SUM(TotalPrice) AS r
      FROM tx WHERE Country <> 'Unspecified' GROUP BY 1)""")

# ---- SQL reports --------------------------------------------------------------

_SUM = "CAST(SUM(TotalPrice) AS DOUBLE)"
COUNTERPARTS["report_monthly_revenue"] = _tx(f"""
SELECT strftime(InvoiceDate, '%Y-%m') AS month, {_SUM} AS revenue,
       COUNT(DISTINCT Invoice) AS num_orders, COUNT(DISTINCT CustomerID) AS active_customers
FROM tx GROUP BY 1""")
COUNTERPARTS["report_top_customers"] = _rfm(f"""
SELECT CustomerID, Segment, Cluster_Name AS cluster, {_SUM} AS total_spend, COUNT(DISTINCT Invoice) AS num_orders,
       {_half_up(f'{_SUM} / COUNT(DISTINCT Invoice)')} AS avg_order_value
FROM tx JOIN rfm USING (CustomerID) GROUP BY 1, 2, 3 ORDER BY SUM(TotalPrice) DESC, CustomerID LIMIT 10""")
COUNTERPARTS["report_segments"] = _rfm(f"""
SELECT Segment, COUNT(DISTINCT CustomerID) AS customers, {_SUM} AS total_revenue,
       COUNT(DISTINCT Invoice) AS total_orders,
       {_half_up(f'{_SUM} / COUNT(DISTINCT CustomerID)')} AS revenue_per_customer
FROM tx JOIN rfm USING (CustomerID) GROUP BY 1""")
COUNTERPARTS["report_clusters"] = _rfm(f"""
SELECT Cluster_Name AS cluster, COUNT(DISTINCT CustomerID) AS customers, COUNT(DISTINCT Invoice) AS orders,
       {_SUM} AS total_revenue, {_half_up(f'{_SUM} / COUNT(*)')} AS avg_line_value,
       {_half_up(f'{_SUM} / COUNT(DISTINCT Invoice)')} AS avg_order_value
FROM tx JOIN rfm USING (CustomerID) GROUP BY 1""")
COUNTERPARTS["report_top_products"] = _tx(f"""
SELECT Description AS product, {_SUM} AS total_revenue, CAST(SUM(Quantity) AS BIGINT) AS units_sold,
       COUNT(DISTINCT Invoice) AS num_orders,
       {_half_up('CAST(SUM(Price) AS DOUBLE) / COUNT(*)')} AS avg_unit_price
FROM tx WHERE {_PRODUCTS_EXACT} GROUP BY 1 ORDER BY SUM(TotalPrice) DESC, Description LIMIT 15""")
COUNTERPARTS["report_retention"] = _tx(f"""
SELECT n AS total_customers, returning_customers, {_half_up('100.0 * returning_customers / n', 1)} AS retention_pct,
       one_time_buyers, {_half_up('100.0 * one_time_buyers / n', 1)} AS one_time_pct
FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (frequency >= 2) AS returning_customers,
             COUNT(*) FILTER (frequency = 1) AS one_time_buyers FROM history)""", _HISTORY)
COUNTERPARTS["report_countries"] = _tx(f"""
SELECT Country, customers, orders, CAST(spend AS DOUBLE) AS revenue,
       {_half_up('100.0 * CAST(spend AS DOUBLE) / CAST(whole AS DOUBLE)', 1)} AS revenue_share_pct
FROM (SELECT Country, COUNT(DISTINCT CustomerID) AS customers, COUNT(DISTINCT Invoice) AS orders,
             SUM(TotalPrice) AS spend, SUM(SUM(TotalPrice)) OVER () AS whole
      FROM tx WHERE Country <> 'Unspecified' GROUP BY 1)
ORDER BY spend DESC, Country LIMIT 10""")

# ---- RFM ----------------------------------------------------------------------

COUNTERPARTS["rfm_base"] = _tx(
    "SELECT CustomerID, recency, frequency, CAST(monetary AS DOUBLE) AS monetary FROM rfm_base", _HISTORY)
for _name, _value in [
    ("recency_score", 'r_score AS "R-Score"'), ("frequency_score", 'f_score AS "F-Score"'),
    ("monetary_score", 'm_score AS "M-Score"'), ("total_score", 'total AS "RFM_Score"'), ("segment", "Segment"),
]:
    COUNTERPARTS[f"rfm_{_name}"] = _rfm(f"SELECT CustomerID, {_value} FROM rfm")
COUNTERPARTS["rfm_scores"] = _rfm(f"SELECT {_CUSTOMER_COLUMNS} FROM rfm")

# ---- clusters -----------------------------------------------------------------

_CAPPED = """, caps AS (
  SELECT quantile_cont(CAST(frequency AS DOUBLE), 0.99) AS top_f, quantile_cont(CAST(monetary AS DOUBLE), 0.99) AS top_m
  FROM rfm),
capped AS (
  SELECT CustomerID, recency, least(CAST(frequency AS DOUBLE), top_f) AS frequency,
         least(CAST(monetary AS DOUBLE), top_m) AS monetary FROM rfm CROSS JOIN caps)"""
COUNTERPARTS["cluster_clip_outliers"] = _rfm("""
SELECT CustomerID, recency, ROUND(frequency, 4) AS frequency, ROUND(monetary, 4) AS monetary FROM capped""", _CAPPED)
COUNTERPARTS["cluster_standardise"] = _rfm("SELECT CustomerID, " + ", ".join(
    f"ROUND((x.{m} - (SELECT AVG({m}) FROM capped)) / (SELECT stddev_pop({m}) FROM capped), 6) AS {m}_scaled"
    for m in _METRICS) + " FROM capped AS x", _CAPPED)
_SCALED = _CAPPED + ", z AS (SELECT CustomerID, Cluster, " + ", ".join(
    f"(x.{m} - (SELECT AVG({m}) FROM capped)) / (SELECT stddev_pop({m}) FROM capped) AS {m[0]}"
    for m in _METRICS) + " FROM capped AS x JOIN rfm USING (CustomerID))"
COUNTERPARTS["cluster_silhouette_stand_in"] = _rfm("""
SELECT (SELECT COUNT(*) FROM centres) AS k, COUNT(*) AS customers,
       ROUND(AVG(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sides""", _SCALED + """,
centres AS (
  SELECT Cluster AS c, COUNT(*) AS n, AVG(r) AS cr, AVG(f) AS cf, AVG(m) AS cm, AVG(r * r + f * f + m * m) AS norm
  FROM z GROUP BY 1),
away AS (
  SELECT CustomerID, c = Cluster AS own, n, r * r + f * f + m * m + norm - 2 * (r * cr + f * cf + m * cm) AS far
  FROM z CROSS JOIN centres),
sides AS (
  SELECT CustomerID, MAX(n) FILTER (own) AS n, MAX(far * n / (n - 1)) FILTER (own) AS a, MIN(far) FILTER (NOT own) AS b
  FROM away GROUP BY 1)""")
# Eigenvalues of a symmetric matrix with ones on the diagonal, by the cubic's cosine form.
COUNTERPARTS["cluster_pca_shares"] = _rfm("""
SELECT ROUND((1 + 2 * p * cos(phi)) / 3, 6) AS explained_pc1,
       ROUND((1 - 2 * p * cos(phi) - 2 * p * cos(phi + 2 * pi() / 3)) / 3, 6) AS explained_pc2
FROM (SELECT p, acos(ab * ac * bc / pow(p, 3)) / 3 AS phi
      FROM (SELECT *, sqrt((ab * ab + ac * ac + bc * bc) / 3) AS p
            FROM (SELECT corr(r, f) AS ab, corr(r, m) AS ac, corr(f, m) AS bc FROM z)))""", _SCALED)
COUNTERPARTS["cluster_inertia"] = _rfm("""
SELECT COUNT(DISTINCT c) AS k, ROUND(SUM(pow(r - mr, 2) + pow(f - mf, 2) + pow(m - mm, 2)), 4) AS inertia
FROM (SELECT part, c, r, f, m, AVG(r) OVER own AS mr, AVG(f) OVER own AS mf, AVG(m) OVER own AS mm
      FROM (SELECT 1 AS part, 0 AS c, * FROM z UNION ALL SELECT 2, Cluster, * FROM z)
      WINDOW own AS (PARTITION BY part, c))
GROUP BY part""", _SCALED)
# An eigenvector is the cross product of two rows of the matrix less its eigenvalue; the longest of three is taken.
_AXES = _SCALED + """,
corrs AS (SELECT corr(r, f) AS ab, corr(r, m) AS ac, corr(f, m) AS bc FROM z),
roots AS (
  SELECT *, 1 + 2 * p * cos(phi) AS l1, 1 - 2 * p * cos(phi) - 2 * p * cos(phi + 2 * pi() / 3) AS l2
  FROM (SELECT *, acos(ab * ac * bc / pow(sqrt((ab * ab + ac * ac + bc * bc) / 3), 3)) / 3 AS phi,
               sqrt((ab * ab + ac * ac + bc * bc) / 3) AS p FROM corrs)),
lists AS (SELECT 1 AS j, l1 AS l, 1 - l1 AS d, ab, ac, bc FROM roots UNION ALL SELECT 2, l2, 1 - l2, ab, ac, bc FROM roots),
crossed AS (
  SELECT j, l, unnest([[ab * bc - ac * d, ac * ab - d * bc, d * d - ab * ab], [ab * d - ac * bc, ac * ac - d * d, d * bc - ab * ac],
                       [d * d - bc * bc, bc * ac - ab * d, ab * bc - d * ac]]) AS v FROM lists),
longest AS (
  SELECT j, l, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM crossed
  QUALIFY ROW_NUMBER() OVER (PARTITION BY j ORDER BY list_sum(list_transform(v, lambda y: y * y)) DESC) = 1),
axes AS (
  SELECT j, l, list_transform(v, lambda x: x * sign(v[list_position(
    list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))])) AS v FROM longest)"""
COUNTERPARTS["cluster_pca"] = _rfm("""
SELECT CustomerID, ROUND(r * a.v[1] + f * a.v[2] + m * a.v[3], 4) AS pc1, ROUND(r * b.v[1] + f * b.v[2] + m * b.v[3], 4) AS pc2,
       ROUND(a.l / 3, 4) AS explained_pc1, ROUND(b.l / 3, 4) AS explained_pc2
FROM z CROSS JOIN (SELECT * FROM axes WHERE j = 1) a CROSS JOIN (SELECT * FROM axes WHERE j = 2) b""", _AXES)
COUNTERPARTS["cluster_means"] = _rfm("SELECT Cluster, " + ", ".join(
    f"ROUND(AVG(CAST({m} AS DOUBLE)), 2) AS {m}" for m in _METRICS) + " FROM rfm GROUP BY 1")
COUNTERPARTS["cluster_names"] = _rfm("""
SELECT CustomerID, Cluster,
       CASE WHEN Cluster = stalest THEN 'Churned' WHEN Cluster = richest THEN 'High Value'
            WHEN Cluster = (SELECT MIN(Cluster) FROM means WHERE Cluster NOT IN (richest, stalest)) THEN 'Active Regular'
       END AS Cluster_Name
FROM rfm CROSS JOIN (
  SELECT (SELECT Cluster FROM means ORDER BY m DESC, Cluster LIMIT 1) AS richest,
         (SELECT Cluster FROM means ORDER BY r DESC, Cluster LIMIT 1) AS stalest)""",
    ", means AS (SELECT Cluster, AVG(recency) AS r, AVG(CAST(monetary AS DOUBLE)) AS m FROM rfm GROUP BY 1)")
COUNTERPARTS["cluster_churn_risk"] = _rfm(f'SELECT CustomerID, ROUND({_RISK}, 6) AS "Churn_Risk" FROM rfm')
COUNTERPARTS["cluster_mean_risk"] = _rfm(
    f"SELECT Cluster_Name, ROUND(AVG({_RISK}), 2) AS mean_churn_risk FROM rfm GROUP BY 1")

# ---- cohorts ------------------------------------------------------------------

_COHORTS = """, active AS (
  SELECT DISTINCT CustomerID, CAST(date_trunc('month', InvoiceDate) AS DATE) AS t FROM tx),
members AS (SELECT *, MIN(t) OVER (PARTITION BY CustomerID) AS c FROM active),
counts AS (
  SELECT c, (t - c) // 30 AS p, COUNT(DISTINCT CustomerID) AS customers FROM members GROUP BY 1, 2),
retained AS (
  SELECT counts.*, s.customers AS cohort_size, counts.customers * CAST(100 AS DOUBLE) / s.customers AS pct
  FROM counts LEFT JOIN (SELECT c, customers FROM counts WHERE p = 0) s USING (c))"""
_COHORT = "strftime(c, '%Y-%m-%d') AS CohortMonth"
_ACTIVE = "CustomerID, strftime(t, '%Y-%m-%d') AS TransactionMonth, " + _COHORT
COUNTERPARTS["cohort_month"] = _tx(f"SELECT {_ACTIVE} FROM members", _COHORTS)
COUNTERPARTS["cohort_period"] = _tx(f"SELECT {_ACTIVE}, (t - c) // 30 AS CohortPeriod FROM members", _COHORTS)
COUNTERPARTS["cohort_period_calendar"] = _tx(
    f"SELECT {_ACTIVE}, date_diff('month', c, t) AS CohortPeriod FROM members", _COHORTS)
COUNTERPARTS["cohort_counts"] = _tx(f"SELECT {_COHORT}, p AS CohortPeriod, customers FROM counts", _COHORTS)
# The dates of the test tables span 80 periods at every scale.
COUNTERPARTS["cohort_matrix"] = _tx("SELECT " + _COHORT + ", " + ", ".join(
    f"CAST(MAX(customers) FILTER (p = {i}) AS DOUBLE) AS period_{i}" for i in range(81)) + " FROM counts GROUP BY c", _COHORTS)
COUNTERPARTS["cohort_retention_matrix"] = _tx("SELECT " + _COHORT + ", " + ", ".join(
    f"ROUND(MAX(pct) FILTER (p = {i}), 6) AS period_{i}" for i in range(81)) + " FROM retained GROUP BY c", _COHORTS)
COUNTERPARTS["cohort_sizes"] = _tx(f"SELECT {_COHORT}, customers AS cohort_size FROM counts WHERE p = 0", _COHORTS)
_RETAINED = f"SELECT {_COHORT}, p AS CohortPeriod, customers, cohort_size, ROUND(pct, 6) AS retention_pct FROM retained"
COUNTERPARTS["cohort_retention"] = _tx(_RETAINED, _COHORTS)
COUNTERPARTS["cohort_first_periods"] = _tx(
    _RETAINED + " WHERE p IN (SELECT DISTINCT p FROM counts ORDER BY p LIMIT 12)", _COHORTS)
COUNTERPARTS["cohort_average_retention"] = _tx("SELECT " + ", ".join(
    f"ROUND(coalesce(AVG(pct) FILTER (p = {i}), 0), 6) AS avg_period_{i}_pct" for i in (1, 3, 6))
    + " FROM retained", _COHORTS)

# ---- segment transitions ------------------------------------------------------

_MONTHS = """, months AS (
  SELECT DISTINCT CAST(date_trunc('month', InvoiceDate) AS DATE) AS m FROM tx),
standing AS (
  SELECT m, CustomerID, MAX(InvoiceDate) AS last_purchase, COUNT(DISTINCT Invoice) AS frequency,
         SUM(TotalPrice) AS monetary
  FROM tx JOIN months ON InvoiceDate < m + INTERVAL 1 MONTH GROUP BY 1, 2),
monthly_base AS (
  SELECT m, CustomerID, date_diff('microsecond', last_purchase, m + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND)
         // 86400000000 AS recency, frequency, monetary
  FROM standing),""" + _quintiles("monthly_base", "m") + """,
followed AS (
  SELECT CustomerID, m, Segment, LEAD(Segment) OVER w AS next_segment, LEAD(m) OVER w AS next_month
  FROM totalled WINDOW w AS (PARTITION BY CustomerID ORDER BY m)),
pairs AS (SELECT * FROM followed WHERE next_month = m + INTERVAL 1 MONTH),
moves AS (
  SELECT a.s AS s_from, a.i AS i_from, b.s AS s_to, b.i AS i_to, COUNT(pairs.CustomerID) AS n
  FROM (VALUES """ + _SEGMENT_LIST + """) AS a(i, s) CROSS JOIN (VALUES """ + _SEGMENT_LIST + """) AS b(i, s)
  LEFT JOIN pairs ON pairs.Segment = a.s AND pairs.next_segment = b.s GROUP BY ALL)"""
_MONTH = "strftime(m, '%Y-%m-%d') AS \"Month\""
COUNTERPARTS["transition_monthly_segments"] = _tx(f"SELECT CustomerID, {_MONTH}, Segment FROM totalled", _MONTHS)
COUNTERPARTS["transition_pairs"] = _tx(f"""
SELECT CustomerID, {_MONTH}, Segment, next_segment AS "Next_Segment",
       strftime(next_month, '%Y-%m-%d') AS "Next_Month" FROM pairs""", _MONTHS)
COUNTERPARTS["transition_counts"] = _tx('SELECT s_from AS Segment, ' + ", ".join(
    f"CAST(SUM(n) FILTER (s_to = '{s}') AS BIGINT) AS \"{s}\"" for s in SEGMENTS) + " FROM moves GROUP BY 1", _MONTHS)
COUNTERPARTS["transition_matrix"] = _tx('SELECT s_from AS Segment, ' + ", ".join(
    f"ROUND(SUM(n) FILTER (s_to = '{s}') * 100.0 / NULLIF(SUM(n), 0), 6) AS \"{s}\"" for s in SEGMENTS)
    + " FROM moves GROUP BY 1", _MONTHS)

_RANGE = range(4)
_STEP = ", ".join(
    "(" + " + ".join(f"p{a} * c{a}{b}" for a in _RANGE) + f") AS q{b}" for b in _RANGE)
_SETTLED = " AND ".join(f"abs(p{b} - q{b}) <= 1e-8 + 1e-5 * abs(q{b})" for b in _RANGE)
COUNTERPARTS["transition_steady_state"] = _tx(f"""
SELECT s AS Segment, ROUND(100 * CASE i WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END, 6) AS steady_pct
FROM (SELECT * FROM walk ORDER BY step DESC LIMIT 1) CROSS JOIN (VALUES {_SEGMENT_LIST}) AS names(i, s)""",
    _MONTHS + f""",
cells AS (SELECT {", ".join(
        f"SUM(n) FILTER (i_from = {a} AND i_to = {b}) * CAST(1 AS DOUBLE) / SUM(n) FILTER (i_from = {a}) AS c{a}{b}"
        for a in _RANGE for b in _RANGE)} FROM moves),
walk AS (
  SELECT 0 AS step, CAST(0.25 AS DOUBLE) AS p0, CAST(0.25 AS DOUBLE) AS p1,
         CAST(0.25 AS DOUBLE) AS p2, CAST(0.25 AS DOUBLE) AS p3
  UNION ALL
  SELECT step + 1, q0, q1, q2, q3
  FROM (SELECT walk.*, {_STEP} FROM walk CROSS JOIN cells)
  WHERE step < 1000 AND NOT ({_SETTLED}))""", recursive=True)

# ---- churn --------------------------------------------------------------------

COUNTERPARTS["churn_label"] = _rfm("SELECT CustomerID, recency, Churned FROM rfm")
COUNTERPARTS["churn_label_balance"] = _rfm(f"""
SELECT CAST(SUM(Churned) AS BIGINT) AS churned, {_half_up('100.0 * SUM(Churned) / COUNT(*)', 1)} AS churned_pct,
       CAST(COUNT(*) - SUM(Churned) AS BIGINT) AS not_churned,
       {_half_up('100.0 * (COUNT(*) - SUM(Churned)) / COUNT(*)', 1)} AS not_churned_pct
FROM rfm""")
_SPLIT = """, sizes AS (
  SELECT Churned, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS rows_all FROM rfm GROUP BY 1),
shares AS (
  SELECT *, (20 * rows_all + 99) // 100 AS wanted FROM sizes),
quotas AS (
  SELECT Churned, wanted, (n * wanted) // rows_all AS whole,
         ROW_NUMBER() OVER (ORDER BY (n * wanted) % rows_all DESC, Churned) AS nth FROM shares),
tested AS (
  SELECT Churned, whole + CASE WHEN nth <= wanted - (SELECT SUM(whole) FROM quotas) THEN 1 ELSE 0 END AS n_test FROM quotas),
split AS (
  SELECT CustomerID, Churned, ROW_NUMBER() OVER (
           PARTITION BY Churned ORDER BY substr(md5(CAST(CustomerID AS VARCHAR) || '|42'), 1, 15), CustomerID) <= n_test AS is_test
  FROM rfm JOIN tested USING (Churned))"""
COUNTERPARTS["churn_split"] = _rfm("SELECT CustomerID, Churned, is_test FROM split", _SPLIT)
COUNTERPARTS["churn_class_weight"] = _rfm("""
SELECT ROUND(coalesce((COUNT(*) - SUM(Churned)) / CAST(NULLIF(SUM(Churned), 0) AS DOUBLE), 1), 6) AS churned_weight
FROM split WHERE NOT is_test""", _SPLIT)
_CONFUSION = """, c AS (
  SELECT COUNT(*) FILTER (Churned = 0 AND churn_prob <= 0.5) AS tn, COUNT(*) FILTER (Churned = 0 AND churn_prob > 0.5) AS fp,
         COUNT(*) FILTER (Churned = 1 AND churn_prob <= 0.5) AS fn, COUNT(*) FILTER (Churned = 1 AND churn_prob > 0.5) AS tp
  FROM rfm),
m AS (
  SELECT *, tn + fp AS s0, tp + fn AS s1, tn / CAST(tn + fn AS DOUBLE) AS p0, tn / CAST(tn + fp AS DOUBLE) AS r0,
         tp / CAST(tp + fp AS DOUBLE) AS p1, tp / CAST(tp + fn AS DOUBLE) AS r1,
         2 * tn / CAST(2 * tn + fn + fp AS DOUBLE) AS f0, 2 * tp / CAST(2 * tp + fn + fp AS DOUBLE) AS f1 FROM c)"""


def _report_line(name: str, p: str, r: str, f: str, support: str) -> str:
    return (f"SELECT '{name}' AS class, ROUND(CAST({p} AS DOUBLE), 6) AS precision, ROUND(CAST({r} AS DOUBLE), 6) AS recall, "
            f"ROUND(CAST({f} AS DOUBLE), 6) AS f1_score, {support} AS support FROM m")


COUNTERPARTS["churn_classification_report"] = _rfm("\nUNION ALL\n".join([
    _report_line("Not Churned", "p0", "r0", "f0", "s0"),
    _report_line("Churned", "p1", "r1", "f1", "s1"),
    _report_line("accuracy", "NULL", "NULL", "(tn + tp) / CAST(s0 + s1 AS DOUBLE)", "s0 + s1"),
    _report_line("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "s0 + s1"),
    _report_line("weighted avg", *[f"({q}0 * s0 + {q}1 * s1) / (s0 + s1)" for q in "prf"], "s0 + s1"),
]), _CONFUSION)
COUNTERPARTS["churn_confusion_matrix"] = _rfm("""
SELECT 'Not Churned' AS actual, tn AS predicted_not_churned, fp AS predicted_churned FROM c
UNION ALL SELECT 'Churned', fn, tp FROM c""", _CONFUSION)
_PER_SCORE = """, per_score AS (
  SELECT churn_prob, SUM(Churned) AS pos, SUM(1 - Churned) AS neg FROM rfm GROUP BY 1)"""
COUNTERPARTS["churn_roc_auc"] = _rfm("""
SELECT ROUND(SUM(a.pos * b.neg * CASE WHEN a.churn_prob > b.churn_prob THEN 1.0 WHEN a.churn_prob = b.churn_prob THEN 0.5 ELSE 0 END)
       / CAST(SUM(a.pos * b.neg) AS DOUBLE), 6) AS roc_auc
FROM per_score a CROSS JOIN per_score b""", _PER_SCORE)
COUNTERPARTS["churn_roc_curve"] = _rfm("""
SELECT ROUND(churn_prob, 6) AS threshold,
       ROUND(SUM(neg) OVER (ORDER BY churn_prob DESC) / CAST(SUM(neg) OVER () AS DOUBLE), 6) AS fpr,
       ROUND(SUM(pos) OVER (ORDER BY churn_prob DESC) / CAST(SUM(pos) OVER () AS DOUBLE), 6) AS tpr
FROM per_score""", _PER_SCORE)
_LEVEL = "CASE WHEN churn_prob >= 0.7 THEN 'High' WHEN churn_prob >= 0.4 THEN 'Medium' ELSE 'Low' END"
COUNTERPARTS["churn_risk_bands"] = _rfm(f"""
SELECT CustomerID, churn_prob, {_LEVEL} AS risk_level,
       CASE {_LEVEL} WHEN 'High' THEN '{RISK_ACTIONS["High"]}' WHEN 'Medium' THEN '{RISK_ACTIONS["Medium"]}'
       ELSE '{RISK_ACTIONS["Low"]}' END AS action
FROM rfm""")

_ACTION = (f"CASE {_LEVEL} WHEN 'High' THEN '{RISK_ACTIONS['High']}' WHEN 'Medium' THEN '{RISK_ACTIONS['Medium']}' "
           f"ELSE '{RISK_ACTIONS['Low']}' END")
COUNTERPARTS["churn_stand_in_grid"] = _rfm(f"""
SELECT DISTINCT f_score, m_score, churn_prob AS churn_probability, {_LEVEL} AS risk_level, {_ACTION} AS action FROM rfm""")
_SHAP = _SPLIT + """, pairs AS (
  SELECT f, m, (11 - f - m) / 10.0::DOUBLE AS p FROM (SELECT unnest(range(1, 6)) AS f) CROSS JOIN (SELECT unnest(range(1, 6)) AS m)),
grid AS (SELECT f, m, ln(p / (1 - p)) AS log_odds FROM pairs),
train AS (SELECT f_score, m_score FROM rfm JOIN split USING (CustomerID) WHERE NOT is_test),
overall AS (SELECT AVG(log_odds) AS base_value FROM train JOIN grid ON f_score = f AND m_score = m),
f_known AS (SELECT f, AVG(log_odds) AS v_f FROM grid JOIN train ON m_score = m GROUP BY 1),
m_known AS (SELECT m, AVG(log_odds) AS v_m FROM grid JOIN train ON f_score = f GROUP BY 1),
shap AS (
  SELECT f AS f_score, m AS m_score, log_odds, base_value, (v_f - base_value + log_odds - v_m) / 2 AS shap_f,
         (v_m - base_value + log_odds - v_f) / 2 AS shap_m
  FROM grid JOIN f_known USING (f) JOIN m_known USING (m) CROSS JOIN overall)"""
COUNTERPARTS["churn_stand_in_shap_values"] = _rfm("SELECT CustomerID, " + ", ".join(
    f"ROUND({c}, 6) AS {c}" for c in ["base_value", "shap_f", "shap_m", "log_odds"])
    + " FROM rfm JOIN shap USING (f_score, m_score)", _SHAP)
COUNTERPARTS["churn_stand_in_mean_shap"] = _rfm("\nUNION ALL\n".join(
    f"""SELECT '{c}-Score' AS feature, ROUND(AVG(abs(shap_{c.lower()})), 6) AS mean_abs_shap
FROM rfm JOIN shap USING (f_score, m_score) JOIN split USING (CustomerID) WHERE is_test""" for c in "FM"), _SHAP)
COUNTERPARTS["churn_stand_in_explanations"] = _rfm("""
SELECT CustomerID, ROUND(1 / (1 + exp(-base_value)), 6) AS base_prob, ROUND(1 / (1 + exp(-log_odds)), 6) AS final_prob,
       CASE WHEN log_odds > base_value THEN 'above' ELSE 'below' END AS direction
FROM rfm JOIN shap USING (f_score, m_score)""", _SHAP)

# ---- lifetime value -----------------------------------------------------------

_LIFE = "least(1 / (1 - pow(1 - least(greatest(churn_prob, 0.01), 0.99), CAST(1 AS DOUBLE) / 12)), 60)"
_CLV = f""", spent AS (
  SELECT *, greatest(date_sub('day', first_purchase, last_purchase) / 30.44::DOUBLE, 1) AS months_active FROM history),
clv AS (
  SELECT CustomerID, CAST(spent.monetary AS DOUBLE) AS total_spend, months_active,
         CAST(spent.monetary AS DOUBLE) / months_active AS avg_monthly_spend, churn_prob AS churn_prob_annual,
         {_LIFE} AS expected_months, CAST(spent.monetary AS DOUBLE) / months_active * {_LIFE} AS predicted_clv,
         Segment, Cluster_Name
  FROM spent JOIN rfm USING (CustomerID))"""
_HISTORY_COLUMNS = """CustomerID, CAST(monetary AS DOUBLE) AS total_spend,
       strftime(first_purchase, '%Y-%m-%d %H:%M:%S') AS first_purchase,
       strftime(last_purchase, '%Y-%m-%d %H:%M:%S') AS last_purchase, frequency AS num_orders"""
_CLV_COLUMNS = """CustomerID, total_spend, ROUND(months_active, 4) AS months_active,
       ROUND(avg_monthly_spend, 4) AS avg_monthly_spend, ROUND(churn_prob_annual, 4) AS churn_prob_annual,
       ROUND(expected_months, 4) AS expected_months, ROUND(predicted_clv, 2) AS predicted_clv, Segment, Cluster_Name"""
COUNTERPARTS["clv_history"] = _tx(f"SELECT {_HISTORY_COLUMNS} FROM history", _HISTORY)
COUNTERPARTS["clv_months_active"] = _rfm("SELECT CustomerID, ROUND(months_active, 6) AS months_active FROM spent", _CLV)
COUNTERPARTS["clv_monthly_spend"] = _rfm(
    "SELECT CustomerID, ROUND(CAST(monetary AS DOUBLE) / months_active, 4) AS avg_monthly_spend FROM spent", _CLV)
COUNTERPARTS["clv_scored_customers_only"] = _rfm(
    f"SELECT {_HISTORY_COLUMNS} FROM history WHERE CustomerID IN (SELECT CustomerID FROM split WHERE NOT is_test)", _SPLIT)
COUNTERPARTS["clv_expected_months"] = _rfm(
    f"SELECT CustomerID, churn_prob, ROUND({_LIFE}, 6) AS expected_months FROM rfm")
COUNTERPARTS["clv_table"] = _rfm(f"SELECT {_CLV_COLUMNS} FROM clv", _CLV)
COUNTERPARTS["clv_mean_by_segment"] = _rfm(
    "SELECT Segment, ROUND(AVG(predicted_clv), 2) AS mean_clv FROM clv GROUP BY 1", _CLV)
COUNTERPARTS["clv_box_by_segment"] = _rfm("""
SELECT Segment, ROUND(q1, 2) AS q1, ROUND(q2, 2) AS median, ROUND(q3, 2) AS q3,
       ROUND(MIN(predicted_clv) FILTER (inside), 2) AS whisker_low,
       ROUND(MAX(predicted_clv) FILTER (inside), 2) AS whisker_high, COUNT(*) FILTER (NOT inside) AS outliers
FROM (SELECT *, predicted_clv BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM clv JOIN (SELECT Segment, quantile_cont(predicted_clv, 0.25) AS q1, quantile_cont(predicted_clv, 0.5) AS q2,
                            quantile_cont(predicted_clv, 0.75) AS q3 FROM clv GROUP BY 1) USING (Segment))
GROUP BY Segment, q1, q2, q3""", _CLV)
COUNTERPARTS["clv_summary"] = _rfm("""
SELECT ROUND(AVG(predicted_clv), 2) AS mean_clv, ROUND(quantile_cont(predicted_clv, 0.5), 2) AS median_clv,
       ROUND(quantile_cont(predicted_clv, 0.9), 2) AS p90_clv, ROUND(SUM(predicted_clv), 2) AS total_clv FROM clv""", _CLV)
COUNTERPARTS["clv_quadrants"] = _rfm("""
SELECT CustomerID,
       CASE WHEN churn_prob_annual > (SELECT quantile_cont(churn_prob_annual, 0.5) FROM clv) THEN 'High risk' ELSE 'Low risk' END
       || ' / ' ||
       CASE WHEN predicted_clv > (SELECT quantile_cont(predicted_clv, 0.5) FROM clv) THEN 'High value' ELSE 'Low value' END AS quadrant
FROM clv""", _CLV)
COUNTERPARTS["clv_top_customers"] = _rfm(
    f"SELECT {_CLV_COLUMNS} FROM clv ORDER BY clv.predicted_clv DESC, CustomerID LIMIT 20", _CLV)

# ---- forecast -----------------------------------------------------------------

_MODEL = _MONTHLY + """,
series AS (
  SELECT m, CAST(revenue AS DOUBLE) AS y, ROW_NUMBER() OVER (ORDER BY m) - 1 AS t FROM monthly),
line AS (
  SELECT COUNT(*) AS n, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, MAX(m) AS last_month FROM series),
trended AS (SELECT series.*, n, slope, intercept, intercept + slope * t AS trend FROM series CROSS JOIN line),
season AS (SELECT month(m) AS calendar_month, AVG(y - trend) AS seasonal FROM trended GROUP BY 1),
fitted AS (SELECT trended.*, trend + seasonal AS fit FROM trended JOIN season ON month(m) = calendar_month),
spread AS (SELECT stddev_pop(y - fit) AS residual_std FROM fitted),
ahead AS (
  SELECT CAST(last_month + to_months(CAST(s AS INTEGER)) AS DATE) AS m,
         intercept + slope * (n + s - 1) + coalesce(seasonal, 0) AS value, slope, residual_std, s
  FROM (SELECT *, unnest(range(1, 7)) AS s FROM line CROSS JOIN spread)
  LEFT JOIN season ON calendar_month = month(last_month + to_months(CAST(s AS INTEGER))))"""
COUNTERPARTS["forecast_trend"] = _tx(f"""
SELECT {_MONTH}, y AS revenue, t, ROUND(slope, 2) AS slope, ROUND(intercept, 2) AS intercept,
       ROUND(trend, 2) AS trend FROM trended""", _MODEL)
COUNTERPARTS["forecast_seasonal_index"] = _tx("""
SELECT k AS calendar_month, ROUND(coalesce(seasonal, 0), 2) AS seasonal
FROM (SELECT unnest(range(1, 13)) AS k) LEFT JOIN season ON calendar_month = k""", _MODEL)
COUNTERPARTS["forecast_fitted"] = _tx(f"SELECT {_MONTH}, ROUND(fit, 2) AS fitted FROM fitted", _MODEL)
COUNTERPARTS["forecast_residual_std"] = _tx("SELECT ROUND(residual_std, 2) AS residual_std FROM spread", _MODEL)
COUNTERPARTS["forecast_six_months"] = _tx(f"""
SELECT {_MONTH}, ROUND(value, 2) AS forecast, ROUND(value - 1.96 * residual_std, 2) AS lower,
       ROUND(value + 1.96 * residual_std, 2) AS upper FROM ahead""", _MODEL)
COUNTERPARTS["forecast_trend_figures"] = _tx("""
SELECT ROUND(slope, 2) AS monthly_trend, ROUND(value, 2) AS next_month_forecast, ROUND(residual_std, 2) AS residual_std
FROM ahead WHERE s = 1""", _MODEL)

# ---- recommendations and profiles ---------------------------------------------

_LISTS = f""", sold AS (
  SELECT Cluster_Name, Description, SUM(TotalPrice) AS r, COUNT(*) AS lines
  FROM tx JOIN rfm USING (CustomerID) WHERE {_PRODUCTS} GROUP BY 1, 2),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Cluster_Name ORDER BY r DESC, Description) AS rank FROM sold)"""
COUNTERPARTS["recommend_popular"] = _top_products(5)
COUNTERPARTS["recommend_cluster_top"] = _rfm(
    "SELECT Cluster_Name, Description, CAST(r AS DOUBLE) AS revenue, rank FROM ranked WHERE rank <= 5", _LISTS)
COUNTERPARTS["recommend_all"] = _rfm("""
SELECT CustomerID, Cluster_Name, coalesce(recommendations, '') AS recommendations
FROM rfm LEFT JOIN (SELECT Cluster_Name, string_agg(Description, ' | ' ORDER BY rank) AS recommendations
                    FROM ranked WHERE rank <= 5 GROUP BY 1) USING (Cluster_Name)""", _LISTS)
COUNTERPARTS["recommend_sample_customers"] = _rfm("""
SELECT Cluster_Name, CustomerID, rank, Description, CAST(r AS DOUBLE) AS revenue
FROM ranked JOIN (SELECT Cluster_Name, MIN(CustomerID) AS CustomerID FROM rfm GROUP BY 1) USING (Cluster_Name)
WHERE rank <= 5""", _LISTS)
_LAST = """, last_times AS (
  SELECT CustomerID, MAX(InvoiceDate) AS last_time FROM tx GROUP BY 1 HAVING COUNT(DISTINCT InvoiceDate) >= 2)"""
COUNTERPARTS["recommend_held_out_lines"] = _tx(f"""
SELECT {_TX_COLUMNS.replace('CustomerID', 'tx.CustomerID')} FROM tx JOIN last_times
ON tx.CustomerID = last_times.CustomerID AND tx.InvoiceDate = last_time""", _LAST)
COUNTERPARTS["recommend_training_lines"] = _tx(f"""
SELECT {_TX_COLUMNS} FROM tx WHERE NOT EXISTS (
  SELECT 1 FROM last_times WHERE last_times.CustomerID = tx.CustomerID AND last_time = tx.InvoiceDate)""", _LAST)
_EVALUATED = _LISTS + _LAST + f""",
held AS (
  SELECT tx.CustomerID, Cluster_Name, Description, SUM(TotalPrice) AS own_r, COUNT(*) AS own_lines
  FROM tx JOIN last_times ON tx.CustomerID = last_times.CustomerID AND tx.InvoiceDate = last_time
  JOIN rfm ON rfm.CustomerID = tx.CustomerID WHERE {_PRODUCTS} GROUP BY 1, 2, 3),
anew AS (
  SELECT c.CustomerID, s.Description, s.r - coalesce(h.own_r, 0) AS r, h.own_r IS NOT NULL AS is_held
  FROM (SELECT DISTINCT CustomerID, Cluster_Name FROM held) c JOIN sold s USING (Cluster_Name)
  LEFT JOIN held h ON h.CustomerID = c.CustomerID AND h.Description = s.Description
  WHERE s.lines > coalesce(h.own_lines, 0)),
listed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY CustomerID ORDER BY r DESC, Description) AS place FROM anew),
hits AS (
  SELECT CustomerID, COUNT(*) FILTER (place <= 10 AND is_held) AS hits FROM listed GROUP BY 1),
per_customer AS (
  SELECT CustomerID, held_out, hits FROM hits
  JOIN (SELECT CustomerID, COUNT(*) AS held_out FROM held GROUP BY 1) USING (CustomerID))"""
COUNTERPARTS["recommend_holdout_hits"] = _rfm("SELECT CustomerID, held_out, hits FROM per_customer", _EVALUATED)
COUNTERPARTS["recommend_evaluation"] = _rfm("""
SELECT ROUND(AVG(hits / CAST(10 AS DOUBLE)), 4) AS precision_at_10, ROUND(AVG(hits / CAST(held_out AS DOUBLE)), 4) AS recall_at_10,
       COUNT(*) AS n_evaluated FROM per_customer""", _EVALUATED)
COUNTERPARTS["customer_profiles"] = _rfm(f"""
SELECT CustomerID AS customer_id, CAST(recency AS DOUBLE) AS recency_days, frequency, CAST(monetary AS DOUBLE) AS monetary,
       r_score, f_score, m_score, Segment AS segment, Cluster_Name AS cluster_name,
       ROUND(churn_prob, 4) AS churn_probability, {_LEVEL} AS risk_level
FROM rfm""")
