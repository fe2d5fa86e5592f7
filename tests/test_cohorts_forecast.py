from datetime import date
from decimal import Decimal

import numpy as np
import pytest

from tillroll.operators import cohorts, forecast


def periods(make_transactions, *days):
    tx = make_transactions([(1, str(i), d, 1) for i, d in enumerate(days)])
    rows = cohorts.with_cohort_period(cohorts.customer_months(tx)).orderBy("TransactionMonth").collect()
    return [r["CohortPeriod"] for r in rows]


def test_thirty_day_periods(make_transactions):
    assert periods(make_transactions, "2010-02-10", "2010-03-10", "2010-04-10") == [0, 0, 1]
    assert periods(make_transactions, "2010-01-10", "2010-02-10", "2010-03-10") == [0, 1, 1]


def test_merged_months_count_a_customer_once(make_transactions):
    tx = make_transactions([(1, "a", "2010-02-10", 1), (1, "b", "2010-03-10", 1), (2, "c", "2010-02-11", 1)])
    rows = cohorts.cohort_counts(tx).collect()
    assert [(r["CohortPeriod"], r["customers"]) for r in rows] == [(0, 2)]


def test_retention_starts_at_hundred(make_transactions):
    tx = make_transactions([
        (1, "a", "2010-01-10", 1), (2, "b", "2010-01-10", 1), (1, "c", "2010-02-10", 1), (3, "d", "2010-05-10", 1)])
    long = cohorts.retention(cohorts.cohort_counts(tx))
    assert {r["retention_pct"] for r in long.filter("CohortPeriod = 0").collect()} == {100.0}
    summary = cohorts.average_retention(long).first()
    assert (summary["avg_period_1_pct"], summary["avg_period_3_pct"]) == (50.0, 0.0)
    wide = cohorts.cohort_matrix(long, "retention_pct", [0, 1]).collect()
    assert [(r["period_0"], r["period_1"]) for r in wide] == [(100.0, 50.0), (100.0, None)]


def test_first_periods_are_those_present(spark):
    long = spark.createDataFrame([(p,) for p in (0, 2, 5, 9)], "CohortPeriod int")
    assert {r[0] for r in cohorts.first_periods(long, 3).collect()} == {0, 2, 5}
    with pytest.raises(ValueError):
        cohorts.first_periods(long, 13)


def monthly(spark, *points):
    return spark.createDataFrame([(date.fromisoformat(m), Decimal(str(v))) for m, v in points],
                                 "Month date, revenue decimal(38,2)")


def test_straight_line_is_continued(spark):
    table = monthly(spark, ("2010-01-01", 10), ("2010-02-01", 20), ("2010-03-01", 30))
    first = forecast.forecast(table, 2).first()
    assert first["Month"] == date(2010, 4, 1)
    assert first["forecast"] == pytest.approx(40) and first["lower"] == pytest.approx(40)
    assert forecast.residual_std(forecast.with_fitted(forecast.with_trend(table))).first()[0] == pytest.approx(0)


def test_positions_ignore_missing_months(spark):
    table = monthly(spark, ("2010-01-01", 10), ("2010-03-01", 20))
    assert [r["t"] for r in forecast.with_trend(table).orderBy("Month").collect()] == [0, 1]


def test_forecast_equals_numpy(spark):
    rng = np.random.default_rng(4)
    months = [f"20{10 + i // 12}-{i % 12 + 1:02d}-01" for i in range(31)]
    values = [round(float(v), 2) for v in 1000 + 30 * np.arange(31) + rng.normal(0, 200, 31)]
    slope, intercept = np.polyfit(np.arange(31.0), values, 1)
    rest = np.array(values) - (intercept + slope * np.arange(31))
    season = {m: rest[[i for i in range(31) if i % 12 + 1 == m]].mean() for m in range(1, 13)}
    spread = np.std(rest - [season[i % 12 + 1] for i in range(31)])
    table = monthly(spark, *zip(months, values))
    for step, row in enumerate(forecast.forecast(table, 6).collect()):
        expected = intercept + slope * (31 + step) + season[(31 + step) % 12 + 1]
        assert row["forecast"] == pytest.approx(expected)
        assert row["upper"] - row["forecast"] == pytest.approx(1.96 * spread)
    figures = forecast.trend_figures(table).first()
    assert figures["monthly_trend"] == pytest.approx(slope) and figures["residual_std"] == pytest.approx(spread)


def test_unseen_calendar_month_has_no_season(spark):
    trended = forecast.with_trend(monthly(spark, ("2010-01-01", 10), ("2010-02-01", 30), ("2010-03-01", 20)))
    index = {r["calendar_month"]: r["seasonal"] for r in forecast.seasonal_index(trended).collect()}
    assert len(index) == 12 and index[7] == 0.0 and index[2] != 0.0
