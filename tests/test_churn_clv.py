import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tillroll.functions.scoring import risk_level
from tillroll.operators import churn, clv
from tillroll.plans import inputs
from tillroll.sources.staging import stage


def scored(spark, rows):
    """Rows of (label, probability)."""
    return spark.createDataFrame([(i, c, float(p)) for i, (c, p) in enumerate(rows)],
                                 "CustomerID bigint, Churned int, churn_prob double")


def test_label_starts_after_180_days(make_customers):
    rows = churn.churn_label(make_customers([(1, 180, 1, 1), (2, 181, 1, 1)])).orderBy("CustomerID").collect()
    assert [r["Churned"] for r in rows] == [0, 1]


@pytest.mark.parametrize("sizes", [(37, 61), (5, 0), (1, 2)])
def test_split_is_stratified_and_repeatable(spark, make_customers, sizes):
    rows = [(i, 0 if i < sizes[0] else 999, 1, 1) for i in range(sum(sizes))]
    labelled = stage(churn.churn_label(make_customers(rows)), "test-labelled")
    first = {tuple(r) for r in churn.stratified_split(labelled).select(
        "CustomerID", "Churned", "is_test").collect()}
    assert first == {tuple(r) for r in churn.stratified_split(labelled).select(
        "CustomerID", "Churned", "is_test").collect()}
    total = sum(sizes)
    assert len(first) == total and sum(t for _, _, t in first) == -(-total // 5)
    for label, size in enumerate(sizes):
        assert abs(sum(t for _, c, t in first if c == label) - size / 5) < 1


def test_class_weight(spark):
    train = scored(spark, [(1, 0), (0, 0), (0, 0), (0, 0)])
    assert churn.class_weight(train).first()[0] == 3.0
    assert churn.class_weight(train.filter("Churned = 0")).first()[0] == 1.0


def test_auc_with_ties(spark):
    assert churn.roc_auc(scored(spark, [(0, 0.4), (1, 0.4), (1, 0.4)])).first()[0] == 0.5
    assert churn.roc_auc(scored(spark, [(0, 0.1), (1, 0.9)])).first()[0] == 1.0


def test_auc_equals_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.3, 0.3, 0.8])) for _ in range(90)]
    pos, neg = [p for c, p in rows if c], [p for c, p in rows if not c]
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert churn.roc_auc(scored(spark, rows)).first()[0] == pytest.approx(wins)
    curve = churn.roc_curve(scored(spark, rows)).collect()
    assert [r["threshold"] for r in curve] == [0.8, 0.3, 0.1]
    assert (curve[-1]["fpr"], curve[-1]["tpr"]) == (1.0, 1.0)


def test_report_and_confusion(spark):
    table = scored(spark, [(0, 0.5), (0, 0.6), (1, 0.9), (1, 0.9), (1, 0.2)])
    cells = {r["actual"]: (r["predicted_not_churned"], r["predicted_churned"]) for r in churn.confusion_matrix(table).collect()}
    assert cells == {"Not Churned": (1, 1), "Churned": (1, 2)}
    report = {r["class"]: r for r in churn.classification_report(table).collect()}
    assert report["Churned"]["precision"] == pytest.approx(2 / 3) and report["Churned"]["support"] == 3
    assert report["accuracy"]["f1_score"] == pytest.approx(0.6)
    assert report["weighted avg"]["recall"] == pytest.approx(0.6)


def test_confusion_lists_an_absent_class(spark):
    assert churn.confusion_matrix(scored(spark, [(0, 0.1)])).count() == 2


def test_risk_bands(spark):
    rows = scored(spark, [(0, 0.70), (0, 0.40), (0, 0.3999)]).orderBy("CustomerID")
    assert [r[0] for r in rows.select(risk_level(F.col("churn_prob"))).collect()] == ["High", "Medium", "Low"]


@pytest.fixture(scope="module")
def fitted(spark):
    """A small model on rows whose churn falls with both scores."""
    rng = random.Random(6)
    rows = [(i, f, m, int(rng.random() < 0.9 - 0.1 * f - 0.05 * m))
            for i in range(400) for f, m in [(rng.randint(1, 5), rng.randint(1, 5))]]
    train = spark.createDataFrame(rows, "CustomerID bigint, `F-Score` int, `M-Score` int, Churned int").cache()
    patch = pytest.MonkeyPatch()
    patch.setattr(churn, "TREES", 5)
    model = churn.train_churn_model(train)
    patch.undo()
    return train, model


def test_cells_give_the_same_model_as_rows(spark, fitted):
    train, model = fitted
    positive = train.filter("Churned = 1").count()
    weight = F.when(F.col("Churned") == 1, (400 - positive) / positive).otherwise(1.0)
    rows = churn._vectors(train.withColumn("weight", weight)).coalesce(1)
    full = GBTClassifier(labelCol="Churned", weightCol="weight", maxIter=5, maxDepth=4, stepSize=0.1, seed=42).fit(rows)
    by_row = full.transform(rows).select(
        F.col("`F-Score`"), F.col("`M-Score`"), vector_to_array("probability")[1].alias("p")).distinct().collect()
    by_cell = {(r["F-Score"], r["M-Score"]): r["churn_prob"] for r in churn.score_grid(spark, model).collect()}
    assert len(by_cell) == 25
    for row in by_row:
        assert by_cell[(row["F-Score"], row["M-Score"])] == pytest.approx(row["p"], abs=1e-9)


def test_scores_cover_every_customer(fitted):
    train, model = fitted
    probabilities = [r["churn_prob"] for r in churn.score_customers(train, model).collect()]
    assert len(probabilities) == 400 and all(0 < p < 1 for p in probabilities)
    auc = churn.roc_auc(churn.score_customers(train, model)).first()[0]
    rates = train.groupBy("F-Score", "M-Score").agg(F.avg("Churned").alias("churn_prob"))
    best = churn.roc_auc(train.join(rates, ["F-Score", "M-Score"])).first()[0]
    assert 0.5 < auc <= best + 1e-9 and best - auc < 0.05


def test_fitted_model_is_evaluated_on_the_test_part(spark, folder):
    split, model = inputs.churn_training(spark, folder)
    test = churn.score_customers(split.filter("is_test"), model)
    rows, churned = test.count(), test.filter("Churned = 1").count()
    report = {r["class"]: r["support"] for r in churn.classification_report(test).collect()}
    assert (report["accuracy"], report["Churned"]) == (rows, churned)
    cells = churn.confusion_matrix(test).collect()
    assert sum(r["predicted_churned"] + r["predicted_not_churned"] for r in cells) == rows
    # The second call loads what the first one saved.
    again = inputs.churn_training(spark, folder)[1]
    assert again.uid == model.uid


def test_contributions_add_up(spark, fitted):
    train, model = fitted
    explained = churn.shap_values(train, churn.shapley_grid(train, churn.score_grid(spark, model))).cache()
    for row in explained.collect():
        assert row["base_value"] + row["shap_f"] + row["shap_m"] == pytest.approx(row["log_odds"])
    averages = explained.agg(F.avg("shap_f"), F.avg("log_odds") - F.first("base_value")).first()
    assert averages[1] == pytest.approx(0, abs=1e-9)
    for row in churn.explain_customers(explained).collect():
        assert (row["final_prob"] >= 0.5) == (row["outlook"] == "churn")
    importance = churn.mean_absolute_shap(explained).collect()
    assert {r["feature"] for r in importance} == {"F-Score", "M-Score"}


def test_expected_months_are_bounded(spark):
    probabilities = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "p double")
    months = [r[0] for r in probabilities.select(clv.expected_months(F.col("p"))).collect()]
    assert months[0] == 60.0
    assert months[1] == pytest.approx(1 / (1 - 0.01 ** (1 / 12)))
    assert months[2] == pytest.approx(1 / (1 - 0.5 ** (1 / 12)))


def test_clv_of_one_day_customer(spark, make_transactions):
    tx = make_transactions([(1, "a", "2010-01-01", 30), (2, "b", "2010-01-01", 9)])
    labels = spark.createDataFrame([(1, 0.0, "Lost", "x")], "CustomerID bigint, churn_prob double, Segment string, Cluster_Name string")
    row, = clv.compute_clv(tx, labels).collect()
    assert (row["months_active"], row["predicted_clv"]) == (1.0, 1800.0)


def test_box_and_quadrants(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    table = spark.createDataFrame(
        [(i, "Lost", v, v / 200) for i, v in enumerate(values)],
        "CustomerID bigint, Segment string, predicted_clv double, churn_prob_annual double")
    box = clv.clv_box_by_segment(table).first()
    assert (box["q1"], box["median"], box["q3"], box["whisker_high"], box["outliers"]) == (2.0, 3.0, 4.0, 4.0, 1)
    quadrants = [r["quadrant"] for r in clv.churn_value_quadrants(table).orderBy("CustomerID").collect()]
    assert quadrants == ["Low risk / Low value"] * 3 + ["High risk / High value"] * 2
    summary = clv.clv_summary(table).first()
    assert (summary["median_clv"], summary["total_clv"]) == (3.0, 110.0)
    assert [r["CustomerID"] for r in clv.top_by_clv(table, 2).collect()] == [4, 3]
