import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators.ranking import exact_quantiles, rows_at_ranks


def wanted(n):
    return F.array(F.lit(1).cast("bigint"), F.floor((n + 1) / 2).cast("bigint"), n)


def brute_force(rows):
    groups = {}
    for g, v, t in rows:
        groups.setdefault(g, []).append((v, t))
    found = set()
    for g, pairs in groups.items():
        pairs.sort()
        n = len(pairs)
        for k, rank in enumerate([1, (n + 1) // 2, n]):
            found.add((g, k, rank, n, *pairs[rank - 1]))
    return found


def sample(kind, n=600, seed=3):
    rng = random.Random(seed)
    make = {
        "ties": lambda: rng.choice([1, 1, 1, 2, 5]),
        "long_tail": lambda: int(rng.lognormvariate(6, 3)),
        "negative": lambda: rng.randint(-10**9, 10**9),
    }[kind]
    return [(rng.choice("ab"), make(), 10**15 + 7 * i) for i in range(n)]


@pytest.mark.parametrize("kind", ["ties", "long_tail", "negative"])
@pytest.mark.parametrize("cells", [8])
def test_rows_at_ranks_equals_sorting(spark, kind, cells):
    rows = sample(kind)
    df = spark.createDataFrame(rows, "g string, v bigint, t bigint")
    found = rows_at_ranks(df, ["g"], "v", "t", wanted, cells=cells)
    assert {tuple(r) for r in found.collect()} == brute_force(rows)


def test_one_group_and_decimals(spark):
    rng = random.Random(1)
    rows = [(Decimal(rng.randint(0, 500)) / 100, i) for i in range(300)]
    df = spark.createDataFrame(rows, "v decimal(28,2), t bigint")
    found = rows_at_ranks(df, [], "v", "t", wanted, cells=4).collect()
    ordered = sorted(rows)
    assert {(r["rank"], r["v"], r["t"]) for r in found} == {(k, *ordered[k - 1]) for k in (1, 150, 300)}


def test_exact_quantiles_equal_numpy(spark):
    rng = random.Random(5)
    values = [rng.choice([0.5, 0.5, rng.random() * 1e6, rng.random()]) for _ in range(257)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, t bigint")
    found = exact_quantiles(df, [], "v", "t", [0, 25, 50, 90, 99, 100])
    for row in found.collect():
        assert row["quantile"] == pytest.approx(np.quantile(values, row["percent"] / 100), rel=1e-12)


def test_single_row_and_empty(spark):
    one = spark.createDataFrame([(4.0, 1)], "v double, t bigint")
    assert [r["quantile"] for r in exact_quantiles(one, [], "v", "t", [25, 99]).collect()] == [4.0, 4.0]
    assert exact_quantiles(one.filter("t < 0"), [], "v", "t", [50]).collect() == []


@pytest.mark.parametrize("kind", ["ties", "one_value", "long_tail", "negative", "wide_ids"])
@pytest.mark.parametrize("ties_matter", [True, False])
def test_two_passes_whatever_the_distribution(spark, kind, ties_matter):
    """Each row is read twice, counted by an accumulator in its source."""
    rng = random.Random(4)
    make = {"one_value": lambda: 7, "wide_ids": lambda: rng.choice([1, 2])}
    rows = [(g, make[kind]() if kind in make else v, t) for g, v, t in sample(
        kind if kind not in make else "ties", n=20_000)]
    if kind == "wide_ids":
        rows = [(g, v, rng.choice([-1, 1]) * (t - 10**15) ** 3 + i) for i, (g, v, t) in enumerate(rows)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = spark.createDataFrame(rows, "g string, v bigint, t bigint")
    df = source.mapInArrow(count, source.schema)
    found = rows_at_ranks(df, ["g"], "v", "t", wanted, ties_matter=ties_matter).collect()
    assert read.value <= 2 * len(rows)
    brute = brute_force(rows)
    if ties_matter:
        assert {tuple(r) for r in found} == brute
    else:
        assert {tuple(r)[:5] for r in found} == {b[:5] for b in brute}


def test_infinite_values_and_nan_have_their_ranks(spark):
    values = [float("-inf"), 1.0, 2.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, t bigint")
    found = rows_at_ranks(df, [], "v", "t", lambda n: F.sequence(F.lit(1).cast("bigint"), n))
    assert [r["t"] for r in found.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
