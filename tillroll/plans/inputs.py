"""Inputs of the registered queries, read from a data folder.

`stand_in_labels` gives model-dependent operators a cluster and a churn
probability that SQL can state too; the fitted models have queries of their own.
"""

import hashlib

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import churn, clusters, rfm
from tillroll.sources import fixtures
from tillroll.sources.staging import application_folder, exists, stage

raw_transactions = fixtures.raw_transactions
transactions = fixtures.transactions
timed_purchases = fixtures.timed_purchases


#: What customers are scored from, and who bought what on which invoice.
BASE_COLUMNS = ["CustomerID", "Invoice", "InvoiceDate", "TotalPrice"]


def staged_transactions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """For queries that read the transactions more than once: the given columns, or all."""
    tx = transactions(spark, folder)
    return stage(tx.select(*columns) if columns else tx, "transactions")


def stand_in_labels(scored: DataFrame) -> DataFrame:
    segment = F.col("Segment")
    return scored.withColumns({
        "Cluster": F.when(segment == "Champions", 0).when(segment == "Lost", 2).otherwise(1),
        "Cluster_Name": F.when(segment == "Champions", "High Value").when(segment == "Lost", "Churned")
        .otherwise("Active Regular"),
        "churn_prob": (11 - F.col("`F-Score`") - F.col("`M-Score`")) / 10.0,
    })


def customers(tx: DataFrame) -> DataFrame:
    """Scored customers with stand-in labels."""
    return stand_in_labels(rfm.compute_rfm(tx))


def clustered_customers(tx: DataFrame) -> DataFrame:
    """Scored customers with K-Means clusters."""
    return clusters.fit_clusters(rfm.compute_rfm(tx))


def churn_training(spark: SparkSession, folder: str):
    """Labelled customers with the split flag, staged, and the model fitted on the
    training part. The model is saved under a digest of the weighted cells it was fitted
    on, at most 50 rows, and loaded where the cells of the given data are the same."""
    labelled = churn.churn_label(rfm.compute_rfm(transactions(spark, folder)))
    split = stage(churn.stratified_split(labelled), "split")
    train = split.filter(~F.col("is_test"))
    cells = sorted(tuple(r) for r in churn.score_cells(train).collect())
    path = f"{application_folder(spark)}/churn-model-{hashlib.sha256(repr(cells).encode()).hexdigest()}"
    if exists(spark, path):
        return split, GBTClassificationModel.load(path)
    model = churn.train_churn_model(train)
    model.save(path)
    return split, model


def stand_in_grid(spark: SparkSession) -> DataFrame:
    """The stand-in probability and its log-odds of the 25 score pairs."""
    pairs = [(f, m, (11 - f - m) / 10.0) for f in range(1, 6) for m in range(1, 6)]
    grid = spark.createDataFrame(pairs, "`F-Score` int, `M-Score` int, churn_prob double")
    return grid.withColumn("log_odds", F.log(F.col("churn_prob") / (1 - F.col("churn_prob"))))


def plain(df: DataFrame) -> DataFrame:
    """Output types every SQL engine has: DOUBLE, BIGINT and text for dates."""
    def column(field):
        c = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(field.name)

    return df.select([column(f) for f in df.schema.fields])


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`").cast("double"), digits) for n in names})


def rounded_half_up(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """For values that often end in an exact half: rounded as decimals."""
    return df.withColumns({
        n: F.round(F.col(f"`{n}`").cast("decimal(38,6)"), digits).cast("double") for n in names})
