"""Churn label, boosted-tree model, its evaluation and explanation.

The model sees only the frequency and monetary scores, each 1..5. All customers
therefore collapse to at most 50 weighted (F, M, label) cells: one distributed
count is the full-scale work, and fitting the cells with their counts as weights
gives the same trees as fitting every row.
"""

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions.ratios import percent, ratio
from tillroll.functions.scoring import risk_action, risk_level
from tillroll.operators.ranking import rows_at_ranks
from tillroll.operators.running import running_totals
from tillroll.sources.staging import stage

# Days without purchase that count as churn, share of the test set,
# seed, model inputs, and the boosted trees' size.
CHURN_AFTER_DAYS = 180
TEST_PERCENT = 20
SEED = 42
FEATURES = ["F-Score", "M-Score"]
TREES, DEPTH, LEARNING_RATE = 100, 4, 0.1
CLASS_NAMES = {0: "Not Churned", 1: "Churned"}


def churn_label(rfm: DataFrame, threshold: int = CHURN_AFTER_DAYS) -> DataFrame:
    return rfm.withColumn("Churned", F.when(F.col("recency") > threshold, 1).otherwise(0))


def label_balance(labelled: DataFrame) -> DataFrame:
    rows, churned = F.count(F.lit(1)), F.sum("Churned")
    return labelled.agg(
        churned.alias("churned"),
        percent(churned, rows, 1).alias("churned_pct"),
        (rows - churned).alias("not_churned"),
        percent(rows - churned, rows, 1).alias("not_churned_pct"),
    )


def _draw(seed: int) -> Column:
    """A fixed number per customer that orders customers as if shuffled."""
    digest = F.md5(F.concat_ws("|", F.col("CustomerID").cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _test_sizes(labelled: DataFrame) -> dict[int, int]:
    """Test rows per label: proportional, rounded so that they add up to a fifth
    (rounded up) of all rows."""
    sizes = {r["Churned"]: r["n"] for r in labelled.groupBy("Churned").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(sizes.values())
    wanted = -(-rows * TEST_PERCENT // 100)
    parts = {label: divmod(n * wanted, rows) for label, n in sizes.items()}
    taken = {label: whole for label, (whole, _) in parts.items()}
    by_remainder = sorted(parts, key=lambda label: (-parts[label][1], label))
    for label in by_remainder[: wanted - sum(taken.values())]:
        taken[label] += 1
    return taken


def stratified_split(labelled: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds `is_test`: within each label the first customers in a fixed shuffled
    order. Only the last test customer of each label is looked up; everyone else is
    compared with it, so nothing is sorted or moved."""
    drawn = labelled.withColumn("draw", _draw(seed))
    sizes = _test_sizes(labelled)
    wanted = F.lit(0)
    for label, size in sizes.items():
        wanted = F.when(F.col("Churned") == label, size).otherwise(wanted)
    last = rows_at_ranks(
        drawn, ["Churned"], "draw", "CustomerID",
        lambda n: F.when(wanted > 0, F.array(wanted.cast("bigint"))),
    ).select("Churned", F.struct("draw", "CustomerID").alias("last_test"))
    own = F.struct("draw", "CustomerID")
    return (
        drawn.join(F.broadcast(last), "Churned", "left")
        .withColumn("is_test", F.coalesce(own <= F.col("last_test"), F.lit(False)))
        .drop("draw", "last_test")
    )


def class_weight(train: DataFrame) -> DataFrame:
    """Weight of a churned row: rows not churned per churned row, 1 without any."""
    positive = F.sum("Churned")
    negative = F.count(F.lit(1)) - positive
    return train.agg(F.coalesce(ratio(negative, positive), F.lit(1.0)).alias("churned_weight"))


def score_cells(train: DataFrame) -> DataFrame:
    """At most 50 rows: customers per (F, M, label)."""
    return train.groupBy(*[F.col(f"`{f}`") for f in FEATURES], "Churned").agg(F.count(F.lit(1)).alias("customers"))


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def train_churn_model(train: DataFrame, seed: int = SEED) -> GBTClassificationModel:
    spark = train.sparkSession
    cells = [r.asDict() for r in score_cells(train).collect()]
    positive = sum(c["customers"] for c in cells if c["Churned"] == 1)
    negative = sum(c["customers"] for c in cells if c["Churned"] == 0)
    heavier = negative / positive if positive else 1.0
    rows = sorted(
        (c["F-Score"], c["M-Score"], c["Churned"], c["customers"] * (heavier if c["Churned"] == 1 else 1.0))
        for c in cells
    )
    weighted = spark.createDataFrame(rows, "`F-Score` int, `M-Score` int, Churned int, weight double").coalesce(1)
    booster = GBTClassifier(
        labelCol="Churned", featuresCol="features", weightCol="weight",
        maxIter=TREES, maxDepth=DEPTH, stepSize=LEARNING_RATE, seed=seed,
        minInstancesPerNode=1, subsamplingRate=1.0,
    )
    vectors = _vectors(weighted).cache()
    model = booster.fit(vectors)
    vectors.unpersist()
    return model


def score_grid(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    """Churn probability and log-odds of the 25 score pairs."""
    pairs = [(f, m) for f in range(1, 6) for m in range(1, 6)]
    grid = spark.createDataFrame(pairs, "`F-Score` int, `M-Score` int").coalesce(1)
    scored = model.transform(_vectors(grid))
    return scored.select(
        *[F.col(f"`{f}`") for f in FEATURES],
        vector_to_array("probability")[1].alias("churn_prob"),
        (vector_to_array("rawPrediction")[1] * 2.0).alias("log_odds"),
    )


def score_customers(rfm: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """Adds churn_prob to every customer through the 25-row grid."""
    grid = score_grid(rfm.sparkSession, model).drop("log_odds")
    return rfm.join(F.broadcast(grid), FEATURES)


def prediction_grid(grid: DataFrame) -> DataFrame:
    """Rounded probability, risk and action of each score pair of a `score_grid`."""
    p = F.col("churn_prob")
    return grid.select(
        F.col("`F-Score`").alias("f_score"), F.col("`M-Score`").alias("m_score"),
        F.round(p, 4).alias("churn_probability"),
        risk_level(p).alias("risk_level"), risk_action(p).alias("action"),
    )


def with_risk(scored: DataFrame) -> DataFrame:
    p = F.col("churn_prob")
    return scored.withColumn("risk_level", risk_level(p)).withColumn("action", risk_action(p))


def _predicted(p: Column) -> Column:
    return F.when(p > 0.5, 1).otherwise(0)


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Two rows (actual label) by two predicted columns."""
    guess = _predicted(F.col("churn_prob"))
    names = scored.sparkSession.createDataFrame(list(CLASS_NAMES.items()), "Churned int, actual string")
    counted = scored.groupBy("Churned").agg(
        F.count_if(guess == 0).alias("predicted_not_churned"), F.count_if(guess == 1).alias("predicted_churned"))
    return (
        names.join(F.broadcast(counted), "Churned", "left")
        .fillna(0, subset=["predicted_not_churned", "predicted_churned"])
        .orderBy("Churned").select("actual", "predicted_not_churned", "predicted_churned")
    )


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, and both averages."""
    guess = _predicted(F.col("churn_prob"))
    label = F.col("Churned")
    cells = scored.agg(
        F.count_if((label == 0) & (guess == 0)).alias("tn"), F.count_if((label == 0) & (guess == 1)).alias("fp"),
        F.count_if((label == 1) & (guess == 0)).alias("fn"), F.count_if((label == 1) & (guess == 1)).alias("tp"),
    )

    def quotas(hit: str, wrongly_in: str, wrongly_out: str, suffix: str) -> dict[str, Column]:
        hits = F.col(hit)
        precision = F.coalesce(ratio(hits, hits + F.col(wrongly_in)), F.lit(0.0))
        recall = F.coalesce(ratio(hits, hits + F.col(wrongly_out)), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2.0 * hits, 2.0 * hits + F.col(wrongly_in) + F.col(wrongly_out)), F.lit(0.0))
        return {f"p{suffix}": precision, f"r{suffix}": recall, f"f{suffix}": f1, f"s{suffix}": hits + F.col(wrongly_out)}

    figures = cells.withColumns({**quotas("tn", "fn", "fp", "0"), **quotas("tp", "fp", "fn", "1")})
    total = F.col("s0") + F.col("s1")
    macro = lambda q: (F.col(f"{q}0") + F.col(f"{q}1")) / 2.0
    weighted = lambda q: ratio(F.col(f"{q}0") * F.col("s0") + F.col(f"{q}1") * F.col("s1"), total)
    accuracy = ratio(F.col("tn") + F.col("tp"), total)

    def line(place: int, name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(
            F.lit(place).alias("place"), F.lit(name).alias("class"), p.cast("double").alias("precision"),
            r.cast("double").alias("recall"), f.cast("double").alias("f1_score"), support.alias("support"))

    none = F.lit(None)
    lines = F.array(
        *[line(i, CLASS_NAMES[i], *[F.col(f"{q}{i}") for q in "prfs"]) for i in (0, 1)],
        line(2, "accuracy", none, none, accuracy, total),
        line(3, "macro avg", *[macro(q) for q in "prf"], total),
        line(4, "weighted avg", *[weighted(q) for q in "prf"], total),
    )
    return figures.select(F.inline(lines)).orderBy("place").drop("place")


def score_counts(scored: DataFrame) -> DataFrame:
    """Labels per distinct score, with the counts at this and all higher scores.

    Scores are sorted by ranges, so any number of distinct ones is summed up over all tasks.
    """
    per_score = scored.groupBy("churn_prob").agg(
        F.sum("Churned").alias("pos"), F.sum(1 - F.col("Churned")).alias("neg"))
    above = stage(running_totals(
        per_score, [], [F.desc("churn_prob")], {"pos_above": "pos", "neg_above": "neg"}, "scores-in-order"), "score-counts")
    whole = above.agg(F.sum("pos"), F.sum("neg")).first()
    return above.select(
        "churn_prob", "pos", "neg",
        (F.col("pos_above") + F.col("pos")).alias("pos_through"), (F.col("neg_above") + F.col("neg")).alias("neg_through"),
        F.lit(whole[0]).cast("bigint").alias("pos_all"), F.lit(whole[1]).cast("bigint").alias("neg_all"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Chance that a churned customer scores above one who is not, ties counting half."""
    wins = F.col("neg") * (F.col("pos_through") - F.col("pos") + 0.5 * F.col("pos"))
    return score_counts(scored).agg(
        F.try_divide(F.sum(wins), F.max(F.col("pos_all").cast("double") * F.col("neg_all"))).alias("roc_auc"))


def roc_curve(scored: DataFrame) -> DataFrame:
    """One point per distinct score, highest threshold first."""
    return score_counts(scored).select(
        F.col("churn_prob").alias("threshold"),
        ratio(F.col("neg_through"), F.col("neg_all")).alias("fpr"),
        ratio(F.col("pos_through"), F.col("pos_all")).alias("tpr"),
    ).orderBy(F.desc("threshold"))


def feature_importance(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    weights = [float(model.featureImportances[i]) for i in range(len(FEATURES))]
    return spark.createDataFrame(list(zip(FEATURES, weights)), "feature string, importance double")


def shapley_grid(train: DataFrame, grid: DataFrame) -> DataFrame:
    """Exact Shapley values of the log-odds for the 25 score pairs of a `score_grid`.

    With two inputs there are four coalitions. A missing input is averaged over the
    training customers: v(F) over their M-Scores, v(M) over their F-Scores, and the
    base value over their pairs.
    """
    spark = train.sparkSession
    f, m = [F.col(f"`{c}`") for c in FEATURES]
    cells = train.groupBy(f, m).agg(F.count(F.lit(1)).alias("customers"))
    rows = F.sum("customers").over(Window.partitionBy())
    shares = spark.createDataFrame(cells.withColumn("share", F.col("customers") / rows).collect(),
                                   "`F-Score` int, `M-Score` int, customers bigint, share double").coalesce(1)

    def expected(given: str, averaged: str, name: str) -> DataFrame:
        weights = shares.groupBy(F.col(f"`{averaged}`")).agg(F.sum("share").alias("share"))
        return grid.join(weights, averaged).groupBy(F.col(f"`{given}`")).agg(
            F.sum(F.col("share") * F.col("log_odds")).alias(name))

    base = shares.join(grid, FEATURES).agg(F.sum(F.col("share") * F.col("log_odds"))).scalar()
    both = (
        grid.join(F.broadcast(expected("F-Score", "M-Score", "v_f")), "F-Score")
        .join(F.broadcast(expected("M-Score", "F-Score", "v_m")), "M-Score")
        .withColumn("base_value", base)
    )
    half = lambda alone, other: 0.5 * (
        F.col(alone) - F.col("base_value") + F.col("log_odds") - F.col(other))
    return both.select(
        f, m, "base_value", "log_odds", half("v_f", "v_m").alias("shap_f"), half("v_m", "v_f").alias("shap_m"))


def shap_values(customers: DataFrame, grid: DataFrame) -> DataFrame:
    """Contributions for every customer; `grid` has 25 rows."""
    return customers.join(F.broadcast(grid), FEATURES)


def mean_absolute_shap(explained: DataFrame) -> DataFrame:
    averages = explained.agg(F.avg(F.abs("shap_f")).alias("f"), F.avg(F.abs("shap_m")).alias("m"))
    return averages.select(F.expr("stack(2, 'F-Score', f, 'M-Score', m)").alias("feature", "mean_abs_shap"))


def _probability(log_odds: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-log_odds))


def explain_customers(explained: DataFrame) -> DataFrame:
    """Base and final probability, and the direction, for every customer."""
    final = _probability(F.col("base_value") + F.col("shap_f") + F.col("shap_m"))
    return explained.select(
        "CustomerID", *[F.col(f"`{c}`") for c in FEATURES],
        _probability(F.col("base_value")).alias("base_prob"), "shap_f", "shap_m", final.alias("final_prob"),
    ).withColumn("direction", F.when(F.col("final_prob") > F.col("base_prob"), "above").otherwise("below")).withColumn(
        "outlook", F.when(F.col("final_prob") >= 0.5, "churn").otherwise("stay"))
