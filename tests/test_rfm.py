import random

import pytest

from tillroll.operators import rfm
from tillroll.sources.staging import stage


def scores(customers, name, **options):
    rows = rfm.with_scores(customers, **options).collect()
    return [r[name] for r in sorted(rows, key=lambda r: r["CustomerID"])]


def test_rank_quintiles_are_not_ntile(make_customers):
    customers = make_customers([(i, i, i, i) for i in range(1, 8)])
    assert scores(customers, "F-Score") == [1, 1, 2, 3, 4, 5, 5]
    assert scores(customers, "M-Score") == [1, 1, 2, 3, 4, 5, 5]


def test_equal_frequencies_rank_by_customer(make_customers):
    customers = make_customers([(i, i, 1, i) for i in range(1, 6)])
    assert scores(customers, "F-Score") == [1, 2, 3, 4, 5]


def test_equal_recencies_share_a_score(make_customers):
    customers = make_customers([(i, r, 1, 1) for i, r in enumerate([1, 1, 1, 1, 2, 3])])
    assert scores(customers, "R-Score") == [5, 5, 5, 5, 2, 1]


def test_single_customer(make_customers):
    row = rfm.with_scores(make_customers([(9, 3, 2, 5)])).first()
    assert (row["R-Score"], row["F-Score"], row["M-Score"]) == (5, 1, 1)


def fifths_of(values):
    """1 to 5 for each place, by the interpolated edges between the sorted values."""
    ordered, last = sorted(values), len(values) - 1
    edges = []
    for k in range(1, 5):
        below, rest = divmod(last * k, 5)
        edges.append(5 * ordered[below] + rest * (ordered[min(below + 1, last)] - ordered[below]))
    return [1 + sum(5 * v > e for e in edges) for v in values]


@pytest.mark.parametrize("n", [53, 211])
def test_scores_equal_quantile_cuts(spark, make_customers, n):
    rng = random.Random(n)
    rows = [(i, rng.randint(0, 4000), rng.choice([1, 1, 1, 2, 3, rng.randint(1, 99)]), rng.randint(1, 10**6) / 100)
            for i in range(n)]

    def places(column):
        order = sorted(range(n), key=lambda i: (rows[i][column], i))
        return [order.index(i) for i in range(n)]

    customers = stage(make_customers(rows), "test-customers")
    assert scores(customers, "R-Score") == [6 - s for s in fifths_of([r[1] for r in rows])]
    assert scores(customers, "F-Score") == fifths_of(places(2))
    assert scores(customers, "M-Score") == fifths_of(places(3))


def test_recency_counts_whole_days(make_transactions):
    tx = make_transactions([
        (1, "a", "2011-12-09 12:50:00", 5), (2, "b", "2011-12-10 12:49:00", 5), (2, "b", "2011-12-01 00:00:00", 2)])
    found = {r["CustomerID"]: r for r in rfm.rfm_base(tx).collect()}
    assert (found[1]["recency"], found[2]["recency"]) == (1, 1)
    assert (found[2]["frequency"], float(found[2]["monetary"])) == (1, 7.0)


def test_segment_bounds(spark):
    df = spark.createDataFrame([(5, 5, 2), (5, 4, 2), (3, 3, 3), (4, 2, 2), (2, 2, 2), (1, 2, 2)],
                               "`R-Score` int, `F-Score` int, `M-Score` int")
    named = [r["Segment"] for r in rfm.with_total_and_segment(df).collect()]
    assert named == ["Champions", "Loyal", "Loyal", "At Risk", "At Risk", "Lost"]
