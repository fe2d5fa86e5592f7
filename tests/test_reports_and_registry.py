import glob
import os

import duckdb
import pytest

import __spark_entry__ as registry
from tillroll.plans.reports import REPORTS, run_report
from tillroll.sources import views
from verify import _rows

# Cheap queries whose results stand for the others; verify.py compares all of them.
COMPARED = [
    "cleaning_all_steps", "profile_missing_values", "revenue_home_and_international", "orders_by_weekday",
    "report_countries", "rfm_scores", "cohort_matrix", "transition_matrix", "forecast_six_months",
    "recommend_evaluation", "churn_classification_report", "clv_box_by_segment",
]


def test_country_shares_precede_the_limit(spark, make_transactions):
    rows = [(i, str(i), "2010-01-01", 10 + i, "lamp", f"land {i:02d}") for i in range(11)]
    views.register_views(make_transactions(rows), spark.range(0))
    shown = run_report(spark, "Revenue by Country (Top 10)").collect()
    assert len(shown) == 10 and sum(r["revenue_share_pct"] for r in shown) < 100


def test_reports_have_sql_and_insight():
    assert len(REPORTS) == 7 and all(r.sql.strip() and r.insight for r in REPORTS.values())


def test_retention_report(spark, make_transactions):
    tx = make_transactions([(1, "a", "2010-01-01", 1), (1, "b", "2010-01-02", 1), (2, "c", "2010-01-02", 1)])
    views.register_views(tx, spark.range(0))
    row = run_report(spark, "Customer Retention Rate").first()
    assert (row["total_customers"], row["returning_customers"], row["retention_pct"], row["one_time_pct"]) == (2, 1, 50.0, 50.0)


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0


def test_counterparts_belong_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.fixture(scope="module")
def database(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, database, folder, name):
    frame = registry.queries()[name](spark, folder)
    cursor = database.execute(registry.oracle_sql()[name])
    expected = _rows([d[0] for d in cursor.description], cursor.fetchall())
    assert _rows(frame.columns, [tuple(r) for r in frame.collect()]) == expected
