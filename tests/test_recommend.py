import random
import re
from collections import defaultdict

import pytest

from tillroll.operators import recommend

CHARGES = {"POSTAGE", "MANUAL", "DOTCOM POSTAGE", "CRUK COMMISSION"}


@pytest.fixture(scope="session")
def clusters(spark):
    def build(names):
        return spark.createDataFrame(list(names.items()), "CustomerID bigint, Cluster_Name string")

    return build


def test_only_the_last_time_is_held_out(make_transactions):
    tx = make_transactions([
        (1, "a", "2010-01-01 09:00:00", 1), (1, "b", "2010-01-01 17:00:00", 2), (2, "c", "2010-01-01 09:00:00", 3)])
    assert [r["Invoice"] for r in recommend.held_out_lines(tx).collect()] == ["b"]
    assert {r["Invoice"] for r in recommend.training_lines(tx).collect()} == {"a", "c"}


def test_precision_divides_by_k(make_transactions, clusters):
    tx = make_transactions([
        (1, "a", "2010-01-01", 5, "lamp"), (1, "b", "2010-02-01", 5, "lamp"), (2, "c", "2010-01-01", 1, "vase")])
    row = recommend.evaluate_recommendations(tx, clusters({1: "x", 2: "x"}), k=10).first()
    assert (row["precision_at_10"], row["recall_at_10"], row["n_evaluated"]) == (0.1, 1.0, 1)


def brute_force(rows, names, k):
    found = {}
    for customer in {r[0] for r in rows}:
        times = {r[2] for r in rows if r[0] == customer}
        if len(times) < 2 or names.get(customer) is None:
            continue
        last = max(times)
        held = {r[4] for r in rows if r[0] == customer and r[2] == last and r[4].upper() not in CHARGES}
        left = defaultdict(int)
        for r in rows:
            if names.get(r[0]) == names[customer] and r[4].upper() not in CHARGES and not (
                    r[0] == customer and r[2] == last):
                left[r[4]] += r[3]
        if held and left:
            best = sorted(left, key=lambda d: (-left[d], d))[:k]
            found[customer] = (len(held), len(held & set(best)))
    return found


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 5), (3, 1), (4, 8)])
def test_evaluation_equals_brute_force(make_transactions, clusters, seed, k):
    rng = random.Random(seed)
    goods = [f"p{i}" for i in range(14)] + ["Postage", "MANUAL"]
    rows = [(rng.randint(1, 15), f"i{n}", f"2010-01-{rng.randint(1, 6):02d} 10:00:00", rng.choice([1, 2, 2, 50]),
             rng.choice(goods)) for n in range(160)]
    rows += [(99, "solo1", "2010-01-01 10:00:00", 4, "only"), (99, "solo2", "2010-01-02 10:00:00", 4, "only2")]
    names = {c: rng.choice(["x", "y", None]) for c in range(1, 16)} | {99: "z"}
    found = recommend.holdout_hits(make_transactions(rows), clusters(names), k)
    assert {r["CustomerID"]: (r["held_out"], r["hits"]) for r in found.collect()} == brute_force(rows, names, k)


def test_a_hold_out_of_many_products(make_transactions, clusters):
    """More than a thousand products held out at once, next to customers who share one product."""
    rng = random.Random(9)
    rows = [(1, "old", "2010-01-01 10:00:00", rng.randint(1, 90), f"p{i}") for i in range(0, 1500, 2)]
    rows += [(1, "new", "2010-01-02 10:00:00", rng.randint(1, 90), f"p{i}") for i in range(1300)]
    for c in range(2, 60):
        rows += [(c, f"a{c}", "2010-01-01 10:00:00", rng.randint(1, 9), f"p{rng.randint(0, 1600)}"),
                 (c, f"b{c}", "2010-01-03 10:00:00", rng.randint(1, 9), rng.choice(["p3", "p5", f"p{rng.randint(0, 1600)}"]))]
    names = dict.fromkeys(range(1, 60), "x")
    for k in (10, 400):
        found = recommend.holdout_hits(make_transactions(rows), clusters(names), k)
        assert {r["CustomerID"]: (r["held_out"], r["hits"]) for r in found.collect()} == brute_force(rows, names, k)


def test_no_task_holds_a_cluster(spark, make_transactions, clusters):
    """Without automatic broadcasts no join is keyed by the cluster (or cluster and rank) alone, no window by it."""
    rows = [(c, f"{c}-{d}", f"2010-01-{d:02d}", 3, f"p{(c + d) % 5}") for c in range(1, 9) for d in (1, 2)]
    tx, table = make_transactions(rows), clusters({c: "x" for c in range(1, 9)})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = recommend.holdout_hits(tx, table, 3)
        text = hits._jdf.queryExecution().executedPlan().toString()
        assert hits.count() == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    windows = [line for line in text.splitlines() if "Window [" in line]
    joins = [line for line in text.splitlines() if "Join [" in line]
    assert windows and not [w for w in windows if re.search(r", \[Cluster_Name#\d+\], \[", w)]
    assert joins and not [j for j in joins if re.search(r"Join \[Cluster_Name#\d+(, rank#\d+)?\]", j)]


def test_customer_whose_list_is_empty_is_skipped(make_transactions, clusters):
    tx = make_transactions([(1, "a", "2010-01-01", 5, "Postage"), (1, "b", "2010-02-01", 5, "lamp")])
    assert recommend.holdout_hits(tx, clusters({1: "x"}), 3).count() == 0


def test_lists_per_customer(make_transactions, clusters):
    tx = make_transactions([(1, "a", "2010-01-01", 5, "lamp"), (2, "b", "2010-01-01", 9, "vase"),
                            (2, "b", "2010-01-01", 5, "bowl"), (3, "c", "2010-01-01", 7, "rug")])
    table = clusters({1: "x", 2: "x", 3: "y", 4: None})
    found = {r["CustomerID"]: r["recommendations"] for r in recommend.recommend_for_all(tx, table, 2).collect()}
    assert found == {1: ["vase", "bowl"], 2: ["vase", "bowl"], 3: ["rug"], 4: []}
    with pytest.raises(ValueError):
        recommend.recommend_for_all(tx, table, 21)


def test_sampled_evaluation_is_repeatable(make_transactions, clusters):
    rows = [(c, f"{c}-{d}", f"2010-01-{d:02d}", 3, f"p{(c + d) % 5}") for c in range(1, 9) for d in (1, 2)]
    tx, table = make_transactions(rows), clusters({c: "x" for c in range(1, 9)})
    first = recommend.evaluate_recommendations(tx, table, 2, sample_size=3).first()
    assert first["n_evaluated"] == 3
    assert first == recommend.evaluate_recommendations(tx, table, 2, sample_size=3).first()
