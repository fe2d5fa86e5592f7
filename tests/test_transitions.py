import random
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.functions.scoring import SEGMENTS
from tillroll.operators import month_ranks, transitions


def test_customers_stay_in_every_later_month(make_transactions):
    tx = make_transactions([
        (1, "a", "2010-01-10", 1), (2, "b", "2010-01-11", 2), (2, "c", "2010-02-11", 2), (2, "d", "2010-03-11", 2)])
    rows = transitions.monthly_segments(tx).filter("CustomerID = 1").orderBy("Month").collect()
    assert [r["Month"] for r in rows] == [date(2010, m, 1) for m in (1, 2, 3)]


def test_gap_months_give_no_pair(make_transactions):
    tx = make_transactions([(1, str(m), f"2010-0{m}-10", 1) for m in (1, 2, 4)])
    pairs = transitions.next_segments(transitions.monthly_segments(tx)).collect()
    assert [(r["Month"].month, r["Next_Month"].month) for r in pairs] == [(1, 2)]


def segment(total):
    return "Champions" if total >= 12 else "Loyal" if total >= 9 else "At Risk" if total >= 6 else "Lost"


def month_by_month(rows):
    frame = pd.DataFrame([r[:4] for r in rows], columns=["id", "invoice", "day", "amount"])
    frame["day"] = pd.to_datetime(frame.day)
    frame["month"] = frame.day.dt.to_period("M")
    found = set()
    for month in sorted(frame.month.unique()):
        seen = frame[frame.month <= month]
        end = month.to_timestamp(how="end")
        table = seen.groupby("id").agg(last=("day", "max"), f=("invoice", "nunique"), m=("amount", "sum"))
        recency = (end - table["last"]).dt.days
        edges = [recency.quantile(k / 5) for k in range(1, 5)]
        r = recency.map(lambda x: 5 - sum(x > e + 1e-9 for e in edges))
        n = len(table)
        fifth = lambda s: s.rank(method="first").map(
            lambda p: 1 if n == 1 else max(1, -(-int(5 * (p - 1)) // (n - 1))))
        total = r + fifth(table.f) + fifth(table.m)
        found |= {(i, month.to_timestamp().date(), segment(t)) for i, t in total.items()}
    return found


@pytest.mark.parametrize("cells", [16])
def test_equals_month_by_month_scoring(make_transactions, monkeypatch, cells):
    rng = random.Random(8)
    rows = [(rng.randint(1, 40), f"i{rng.randint(1, 150)}",
             f"20{rng.choice([10, 11])}-{rng.choice([1, 2, 3, 5, 8, 11]):02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:15:00",
             rng.randint(1, 900)) for _ in range(300)]
    tx = make_transactions(rows)
    count = transitions.rows_at_monthly_ranks
    monkeypatch.setattr(transitions, "rows_at_monthly_ranks", lambda *args: count(*args, cells=cells))
    found = {tuple(r) for r in transitions.monthly_segments(tx).collect()}
    assert found == month_by_month(rows)


@pytest.mark.parametrize("same_amount", [False, True])
def test_one_invoice_each_equals_month_by_month_scoring(make_transactions, same_amount):
    rng = random.Random(9)
    rows = [(c, f"i{c}", f"2010-{rng.choice([1, 2, 4]):02d}-{rng.randint(1, 28):02d} 10:15:00", 5 if same_amount else rng.randint(1, 900))
            for c in range(1, 701)]
    found = {tuple(r) for r in transitions.monthly_segments(make_transactions(rows)).collect()}
    assert found == month_by_month(rows)


def test_lost_ranks_raise(spark, monkeypatch):
    rows = [("f", 1, c, date(2010, 1, 1), None) for c in range(600)]
    standings = spark.createDataFrame(rows, "metric string, amount long, id long, from_month date, until_month date")
    monkeypatch.setattr(month_ranks, "standing_in", lambda month: F.lit(0))
    with pytest.raises(ValueError):
        month_ranks.rows_at_monthly_ranks(standings, "metric", "amount", "id", lambda n: [n // 2])


def standings_of(spark):
    rng = random.Random(10)
    rows = [(rng.choice("fm"), rng.randint(1, 40), c, date(2010, rng.randint(1, 3), 1), None) for c in range(1, 900)]
    return spark.createDataFrame(rows, "metric string, amount long, id long, from_month date, until_month date")


def test_cells_keep_the_order_of_value_and_tie(spark):
    placed, _ = month_ranks.with_cells(standings_of(spark), "metric", "amount", "id", 16)
    for metric in "fm":
        rows = placed.filter(F.col("metric") == metric).orderBy("amount", "id").collect()
        cells = [r["cell"] for r in rows]
        assert cells == sorted(cells) and set(cells) == set(range(16))


def test_cells_are_found_in_compiled_code(spark):
    placed, _ = month_ranks.with_cells(standings_of(spark), "metric", "amount", "id", 16)
    assert "lambda" not in placed._jdf.queryExecution().executedPlan().toString()


def matrix(spark, rows):
    return spark.createDataFrame([(s, *map(float, r)) for s, r in zip(SEGMENTS, rows)],
                                 "Segment string, " + ", ".join(f"`{s}` double" for s in SEGMENTS))


def test_steady_state_of_identity(spark):
    found = transitions.steady_state(matrix(spark, [[100 * (i == j) for j in range(4)] for i in range(4)]))
    assert [r["steady_pct"] for r in found.collect()] == [25.0] * 4


def test_unused_segment_gives_nulls(spark):
    pairs = spark.createDataFrame([("Loyal", "Loyal"), ("Loyal", "Lost")], "Segment string, Next_Segment string")
    table = transitions.transition_matrix(transitions.transition_counts(pairs))
    rows = {r["Segment"]: r for r in table.collect()}
    assert (rows["Loyal"]["Loyal"], rows["Loyal"]["Lost"], rows["Loyal"]["Champions"]) == (50.0, 50.0, 0.0)
    assert rows["Champions"]["Loyal"] is None
    assert [r["steady_pct"] for r in transitions.steady_state(table).collect()] == [None] * 4
