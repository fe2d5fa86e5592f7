"""Properties of the physical plans that keep the work spread over the cluster."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import churn, cohorts, profiling, recommend, rfm, transitions
from tillroll.operators.running import running_totals
from tillroll.plans import inputs
from tillroll.sources.staging import stage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, folder):
    tx = inputs.staged_transactions(spark, folder)
    return tx, inputs.customers(tx)


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(recommend.recommend_popular(inputs.transactions(spark, folder)))
    assert "l_shipdate" not in text and "o_totalprice" not in text


def test_scoring_neither_sorts_nor_moves_customers(tables):
    text = plan(rfm.compute_rfm(tables[0]))
    main = re.split(r"Subquery subquery", text)[0]
    assert "Sort [" not in main and "Exchange" not in main and "NestedLoop" not in main


def test_months_are_unfolded_without_moving_them(tables):
    text = plan(transitions.next_segments(transitions.monthly_segments(tables[0])))
    above, below = text.split("Generate explode", 1)
    long_side = [line for line in above.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert not [line for line in long_side if "CustomerID" in line]
    assert "REPARTITION_BY_COL" in below


def test_monthly_cut_offs_come_from_changes(tables):
    changes = stage(transitions.standing_changes(tables[0]), "test-changes")
    text = plan(transitions.monthly_cuts(changes))
    assert "sequence(" not in text and "CustomerID" not in "".join(l for l in text.splitlines() if "Exchange" in l)


def test_scores_rank_without_moving_rows(tables):
    text = plan(rfm.compute_rfm(tables[0]))
    assert "piece" not in text and "row_number" not in text


def test_summary_multiplies_no_line(spark, folder):
    assert "Expand" not in plan(profiling.dataset_summary(inputs.transactions(spark, folder)))


def test_cohorts_move_customers_once(tables):
    text = plan(cohorts.cohort_counts(tables[0]))
    by_customer = [line for line in text.splitlines() if "Exchange hashpartitioning(CustomerID" in line]
    assert len(by_customer) == 2 and "SinglePartition" not in text


def test_products_are_summed_before_the_join(tables):
    text = plan(recommend.cluster_product_revenue(*tables))
    join = text.index("Join")
    assert "HashAggregate(keys=[CustomerID" in text[join:]


@pytest.mark.parametrize("build", [
    lambda tx, c: rfm.customer_history(tx),
    lambda tx, c: recommend.recommend_for_all(tx, c),
    lambda tx, c: recommend.held_out_lines(tx),
    lambda tx, c: transitions.standing_changes(tx),
])
def test_no_single_partition_and_no_python(tables, build):
    text = plan(build(*tables))
    assert "SinglePartition" not in text
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_scores_are_summed_up_by_ranges(spark, make_customers):
    """No unpartitioned window, and exact with very many distinct scores."""
    n = 1_000_000
    scored = spark.range(n).selectExpr("id / 1000000D AS churn_prob", "CAST(pmod(xxhash64(id), 3) = 0 AS INT) AS Churned")
    points = churn.score_counts(scored)
    text = plan(points)
    assert "SinglePartition" not in text and "Window" in plan(running_totals(
        spark.range(9).withColumn("x", F.lit(1)), [], [F.asc("id")], {"s": "x"}, "test"))
    row = points.agg(F.count(F.lit(1)), F.max("pos_through"), F.max("pos_all"), F.max("neg_through"), F.max("neg_all")).first()
    assert row[0] == n and row[1] == row[2] and row[3] == row[4] and row[2] + row[4] == n
    labels = np.array([r[0] for r in scored.orderBy("churn_prob").select("Churned").collect()])
    wins = np.cumsum(1 - labels)[labels == 1].sum() / (labels.sum() * (n - labels.sum()))
    assert churn.roc_auc(scored).first()[0] == pytest.approx(wins, abs=1e-12)
