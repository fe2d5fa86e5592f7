import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import clusters, profiling, rfm
from tillroll.sources.staging import stage


@pytest.fixture(scope="module")
def three_groups(spark, make_customers):
    rng = random.Random(11)
    centres = [(10, 40, 9000), (60, 10, 900), (400, 2, 100)]
    rows = [(i, max(0, int(rng.gauss(r, 4))), max(1, int(rng.gauss(f, 1))), max(1, rng.gauss(m, m / 20)))
            for i in range(90) for r, f, m in [centres[i % 3]]]
    return rows, stage(make_customers(rows), "test-groups")


def test_kmeans_finds_and_names_the_groups(three_groups):
    rows, customers = three_groups
    named = {r["CustomerID"]: r["Cluster_Name"] for r in clusters.fit_clusters(customers).collect()}
    expected = ["High Value", "Active Regular", "Churned"]
    assert named == {row[0]: expected[row[0] % 3] for row in rows}


def test_elbow_and_silhouette(three_groups):
    _, customers = three_groups
    points = {r["k"]: r for r in clusters.elbow(customers, range(1, 4)).collect()}
    assert points[1]["inertia"] == pytest.approx(270) and points[1]["silhouette"] is None
    assert points[3]["inertia"] < points[2]["inertia"] < points[1]["inertia"]
    assert points[3]["silhouette"] > 0.8


def test_scaled_metrics_and_projection(three_groups):
    rows, customers = three_groups
    scaled = clusters.standardise(customers, clip=False).orderBy("CustomerID").collect()
    data = np.array([[r[1], r[2], float(round(r[3], 2))] for r in rows])
    expected = (data - data.mean(axis=0)) / data.std(axis=0)
    found = np.array([[r["recency_scaled"], r["frequency_scaled"], r["monetary_scaled"]] for r in scaled])
    assert found == pytest.approx(expected, abs=1e-4)
    projected = clusters.pca_projection(clusters.with_features(customers, clip=False)).orderBy("CustomerID").collect()
    _, spread, axes = np.linalg.svd(found, full_matrices=False)
    assert abs(np.array([r["pc1"] for r in projected])) == pytest.approx(abs(found @ axes[0]), abs=1e-6)
    assert projected[0]["explained_pc1"] == pytest.approx(spread[0] ** 2 / (spread ** 2).sum())


def test_clip_uses_the_exact_percentile(spark, make_customers):
    customers = stage(make_customers([(i, 5, i, i * 2) for i in range(1, 102)]), "test-clip")
    top = clusters.clip_outliers(customers).agg(F.max("frequency"), F.max("monetary"), F.max("recency")).first()
    assert tuple(map(float, top)) == (100.0, 200.0, 5.0)


def test_one_cluster_with_both_extremes_is_churned(spark):
    means = spark.createDataFrame([(0, 1.0, 1.0, 5.0), (1, 9.0, 1.0, 99.0), (2, 2.0, 1.0, 7.0)],
                                  "Cluster int, recency double, frequency double, monetary double")
    named = {r["Cluster"]: r["Cluster_Name"] for r in clusters.cluster_names(means).collect()}
    assert named == {0: "Active Regular", 1: "Churned", 2: None}


def test_churn_risk_scale(make_customers):
    risks = clusters.churn_risk(make_customers([(1, 10, 1, 1), (2, 30, 1, 1), (3, 20, 1, 1)])).orderBy("CustomerID").collect()
    assert [r["Churn_Risk"] for r in risks] == [0.0, 1.0, 0.5]
    assert clusters.churn_risk(make_customers([(1, 10, 1, 1)])).first()["Churn_Risk"] is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 1.0, 9.99, 10.0)] + [("b", 3.0)], "g string, v double")
    rows = profiling.histogram(df, ["g"], "v", 10).orderBy("g", "bin").collect()
    assert [r["customers"] for r in rows if r["g"] == "a"] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2]
    flat = [r for r in rows if r["g"] == "b"]
    assert (flat[0]["bin_from"], flat[-1]["bin_to"], flat[5]["customers"]) == (2.5, 3.5, 1)


def test_describe_equals_numpy(three_groups):
    rows, customers = three_groups
    found = {r["statistic"]: r["recency"] for r in profiling.describe_rfm(customers).collect()}
    recencies = [r[1] for r in rows]
    assert found["std"] == pytest.approx(np.std(recencies, ddof=1), abs=0.01)
    assert found["25%"] == pytest.approx(np.quantile(recencies, 0.25), abs=0.01)


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, "x"), (None, None)], "`Customer ID` double, name string")
    found = {r["column"]: (r["missing"], r["missing_pct"]) for r in profiling.missing_values(df).collect()}
    assert found == {"Customer ID": (1, 33.33), "name": (2, 66.67)}


def test_every_customer_is_at_its_nearest_centre(three_groups):
    _, customers = three_groups
    found = clusters.assign_clusters(customers, 4).select("Cluster", *clusters.SCALED).collect()
    points = np.array([r[1:] for r in found])
    labels = np.array([r[0] for r in found])
    centres = np.array([points[labels == j].mean(axis=0) for j in range(4)])
    away = ((points[:, None] - centres) ** 2).sum(axis=2)
    assert (away[np.arange(len(points)), labels] <= away.min(axis=1) + 1e-3).all()


def test_passes_do_not_grow_with_the_number_of_k(three_groups, monkeypatch):
    _, customers = three_groups
    passes = []
    sums = clusters._cluster_sums
    monkeypatch.setattr(clusters, "_cluster_sums", lambda points, centres: passes.append(sorted(centres)) or sums(points, centres))
    points = {r["k"]: r for r in clusters.elbow(customers, range(1, 9)).collect()}
    assert len(points) == 8 and passes[0] == list(range(1, 9)) == passes[-1]
    assert len(passes) <= clusters.MOST_STEPS + 1
    assert all(points[k + 1]["inertia"] <= points[k]["inertia"] + 1e-6 for k in range(1, 8))


def test_shared_silhouettes_equal_the_evaluator(three_groups):
    _, customers = three_groups
    points = {r["k"]: r for r in clusters.elbow(customers, range(2, 5)).collect()}
    vectors = clusters.with_features(customers, clip=False)
    for k, centres in clusters.fit_centres(vectors, [2, 3, 4]).items():
        assigned = vectors.withColumn("Cluster", clusters.with_nearest(centres))
        assert points[k]["silhouette"] == pytest.approx(clusters.silhouette(assigned), abs=1e-9)
        row = clusters.inertia(assigned).first()
        assert row["k"] == k and row["inertia"] == pytest.approx(points[k]["inertia"], abs=1e-3)


def test_signs_of_axes_are_fixed(three_groups):
    _, customers = three_groups
    _, axes, shares = clusters.principal_axes(clusters.with_features(customers, clip=False), 3)
    assert all(max(axis, key=abs) > 0 for axis in axes) and sum(shares) == pytest.approx(1)


def test_no_customers_at_all(spark, make_customers):
    none = make_customers([])
    assert clusters.elbow(none).count() == 0 and clusters.fit_clusters(none).count() == 0
    assert clusters.pca_projection(clusters.with_features(none, clip=False)).count() == 0
