"""Grouping customers by recency, frequency and monetary value."""

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.operators.profiling import RFM_METRICS, capped, percentile_caps
from tillroll.sources.staging import stage

# Cluster names, metrics capped before clustering, random seed.
HIGH_VALUE, CHURNED, ACTIVE_REGULAR = "High Value", "Churned", "Active Regular"
CAPPED_METRICS = ["frequency", "monetary"]
SEED = 42
SCALED = [f"{m}_scaled" for m in RFM_METRICS]
#: Rows the first centres are drawn from, draws and steps among them, passes over all rows, and the move
#: of all centres of a k together (root of squared distances) below which it rests.
SAMPLE, DRAWS, MOST_STEPS, TOLERANCE = 10_000, 10, 40, 1e-2


def clip_outliers(rfm: DataFrame) -> DataFrame:
    """Frequency and monetary cut off at their exact 99th percentile."""
    caps = percentile_caps(rfm, CAPPED_METRICS)
    return rfm.withColumns({m: capped(m, caps) for m in CAPPED_METRICS})


def standardise(rfm: DataFrame, clip: bool) -> DataFrame:
    """Adds (x - mean) / population deviation of each metric, 0 where all are equal;
    `clip` cuts off outliers first. The metrics themselves are left as they are."""
    caps = percentile_caps(rfm, CAPPED_METRICS) if clip else {}
    moments = rfm.agg(*[
        f(capped(m, caps)).alias(f"{m}_{n}") for m in RFM_METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop))
    ]).first()

    def scaled(metric: str):
        centred = capped(metric, caps) - F.lit(moments[f"{metric}_mean"]).cast("double")
        return centred / F.lit(moments[f"{metric}_std"] or 1.0)

    return rfm.withColumns({s: scaled(m) for m, s in zip(RFM_METRICS, SCALED)})


def with_features(rfm: DataFrame, clip: bool) -> DataFrame:
    """Customers with a vector of the three standardised metrics, staged because the
    fits read it many times."""
    staged = stage(standardise(rfm, clip), "cluster-features")
    return VectorAssembler(inputCols=SCALED, outputCol="features").transform(staged)


def _tables(rows_of: dict[int, list[list[float]]]) -> Column:
    """An array literal of (k, rows), one row of numbers per cluster. As data, not as code, it leaves the
    plan the same from pass to pass, so Spark compiles it once."""
    numbers = lambda row: "array(" + ", ".join(f"{float(x)!r}D" for x in row) + ")"
    return F.expr("array(" + ", ".join(
        f"named_struct('k', {k}, 'rows', array({', '.join(map(numbers, rows))}))" for k, rows in rows_of.items()) + ")")


def _nearest(rows: Column) -> Column:
    """(distance, cluster) of the nearest of the centres that `rows` begin with, the first of equally near ones."""
    def distance(row: Column) -> Column:
        apart = [F.col(x) - row[i] for i, x in enumerate(SCALED)]
        return sum((d * d for d in apart[1:]), apart[0] * apart[0])

    return F.array_min(F.transform(rows, lambda row, j: F.struct(distance(row).alias("distance"), j.alias("cluster"))))


def with_nearest(centres: list[list[float]]) -> Column:
    """Cluster of the nearest centre."""
    return _nearest(_tables({len(centres): centres})[0]["rows"])["cluster"]


def _starts(sample: np.ndarray, k: int, seed: int) -> list[list[float]]:
    """Centres for k clusters of a sample: the best of several draws, each far from those before."""
    draw = np.random.RandomState(seed)
    best = (np.inf, sample[:1].repeat(k, axis=0))
    for _ in range(DRAWS):
        centres = sample[draw.randint(len(sample))][None]
        while len(centres) < k:
            far = ((sample[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
            chosen = draw.choice(len(sample), p=far / far.sum()) if far.sum() else draw.randint(len(sample))
            centres = np.vstack((centres, sample[chosen]))
        for _ in range(DRAWS):
            near = ((sample[:, None] - centres) ** 2).sum(axis=2)
            labels = near.argmin(axis=1)
            centres = np.array([sample[labels == j].mean(axis=0) if (labels == j).any() else centres[j] for j in range(k)])
        spread = ((sample[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()
        if spread < best[0]:
            best = (spread, centres)
    return best[1].tolist()


def _each_k(points: DataFrame, rows_of: dict[int, list[list[float]]]) -> DataFrame:
    """(metrics, k, rows, near) for every point and k."""
    beside = points.select(*SCALED, F.inline(_tables(rows_of)))
    return beside.withColumn("near", _nearest(F.col("rows")))


def _norm() -> Column:
    return sum((F.col(x) * F.col(x) for x in SCALED[1:]), F.col(SCALED[0]) * F.col(SCALED[0]))


def _cluster_sums(points: DataFrame, centres: dict[int, list[list[float]]]) -> dict[tuple[int, int], Row]:
    """Per k and cluster: rows, sums of the metrics and of their squares, and of the distances; one pass for all k."""
    found = _each_k(points, centres).groupBy("k", "near.cluster").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(x).alias(x) for x in SCALED],
        F.sum(_norm()).alias("squares"), F.sum("near.distance").alias("distance"))
    return {(r["k"], r["cluster"]): r for r in found.collect()}


def fit_centres(points: DataFrame, ks: list[int], seed: int = SEED) -> dict[int, list[list[float]]]:
    """Centres of K-Means for every k of ks, all moved in the same passes over `points`.

    The first centres come from a sample of SAMPLE rows at most, drawn by a hash of the customer.
    Passes end when the centres of every k have moved by less than TOLERANCE, or after MOST_STEPS.
    """
    drawn = points.orderBy(F.xxhash64("CustomerID", F.lit(seed)), "CustomerID").limit(SAMPLE)
    sample = np.array([tuple(r) for r in drawn.select(*SCALED).collect()], float).reshape(-1, len(SCALED))
    if not len(sample):
        return {}
    centres = {k: _starts(sample, k, seed) for k in ks}
    moving = list(ks)
    for _ in range(MOST_STEPS):
        if not moving:
            break
        sums = _cluster_sums(points, {k: centres[k] for k in moving})
        still = []
        for k in moving:
            old = centres[k]
            centres[k] = [
                [sums[k, j][x] / sums[k, j]["rows"] for x in SCALED] if (k, j) in sums else c for j, c in enumerate(old)]
            if sum((a - b) ** 2 for pair in zip(old, centres[k]) for a, b in zip(*pair)) > TOLERANCE**2:
                still.append(k)
        moving = still
    return centres


def silhouette(assigned: DataFrame) -> float:
    """Mean silhouette with squared Euclidean distance, which needs only one pass
    over per-cluster sums instead of all pairs of customers."""
    return ClusteringEvaluator(featuresCol="features", predictionCol="Cluster").evaluate(assigned)


def assign_clusters(rfm: DataFrame, k: int = 3, seed: int = SEED) -> DataFrame:
    """`rfm` with the vector and a Cluster column: the nearest of k centres."""
    vectors = with_features(rfm, clip=True)
    centres = fit_centres(vectors, [k], seed).get(k)
    if not centres:
        return vectors.withColumn("Cluster", F.lit(None).cast("int"))
    return vectors.withColumn("Cluster", with_nearest(centres))


def fit_clusters(rfm: DataFrame, k: int = 3, seed: int = SEED) -> DataFrame:
    """`rfm` with Cluster and Cluster_Name."""
    return name_clusters(assign_clusters(rfm, k, seed).drop(*SCALED, "features"))


def cluster_means(rfm: DataFrame) -> DataFrame:
    """Means of the uncapped metrics per cluster."""
    return rfm.groupBy("Cluster").agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in RFM_METRICS])


def cluster_names(means: DataFrame) -> DataFrame:
    """Name of each cluster: most spend, longest absence, then the first other one.
    A cluster that is both is Churned; further clusters stay unnamed. The window
    sees one row per cluster."""
    every = Window.partitionBy()
    first = lambda metric: F.max_by("Cluster", F.struct(F.col(metric), -F.col("Cluster"))).over(every)
    tops = means.withColumn("richest", first("monetary")).withColumn("stalest", first("recency"))
    is_other = (F.col("Cluster") != F.col("richest")) & (F.col("Cluster") != F.col("stalest"))
    regular = F.min(F.when(is_other, F.col("Cluster"))).over(every)
    return tops.withColumn("regular", regular).select(
        "Cluster",
        F.when(F.col("Cluster") == F.col("stalest"), CHURNED)
        .when(F.col("Cluster") == F.col("richest"), HIGH_VALUE)
        .when(F.col("Cluster") == F.col("regular"), ACTIVE_REGULAR)
        .alias("Cluster_Name"),
    )


def name_clusters(clustered: DataFrame) -> DataFrame:
    return clustered.join(F.broadcast(cluster_names(cluster_means(clustered))), "Cluster", "left")


def inertia(assigned: DataFrame) -> DataFrame:
    """(k, inertia): clusters, and squared distances of their rows to the means, for given labels."""
    parts = [F.sum(F.col(x) ** 2) - F.sum(x) ** 2 / F.count(F.lit(1)) for x in SCALED]
    each = assigned.groupBy("Cluster").agg(sum(parts[1:], parts[0]).alias("about_mean"))
    return each.agg(F.count(F.lit(1)).alias("k"), F.sum("about_mean").alias("inertia"))


def _silhouettes(points: DataFrame, centres: dict[int, list[list[float]]], sums: dict[tuple[int, int], Row]) -> dict[int, float]:
    """Mean silhouette with squared distances for every k, from the sums of its clusters; one pass for all k.

    The mean squared distance of a point to a cluster is its norm, plus the mean norm of the cluster,
    less twice the product with the cluster's mean.
    """
    rows_of = {
        k: [[*c, *(own[x] / own["rows"] for x in SCALED), own["squares"] / own["rows"], own["rows"]]
            for j, c in enumerate(of_k) if (own := sums.get((k, j)))]
        for k, of_k in centres.items()}
    rows_of = {k: rows for k, rows in rows_of.items() if len(rows) > 1}
    if not rows_of:
        return {}
    mean_at, square_at, size_at = len(SCALED), 2 * len(SCALED), 2 * len(SCALED) + 1

    def far(row: Column) -> Column:
        product = [F.col(x) * row[mean_at + i] for i, x in enumerate(SCALED)]
        return F.col("norm") + row[square_at] - 2 * sum(product[1:], product[0])

    sides = _each_k(points, rows_of).withColumn("norm", _norm()).withColumn("own", F.col("rows")[F.col("near.cluster")])
    size = F.col("own")[size_at]
    a = far(F.col("own")) * size / F.greatest(size - 1, F.lit(1.0))
    b = F.array_min(F.transform(F.filter("rows", lambda _, j: j != F.col("near.cluster")), far))
    score = F.when(F.col("n") > 1, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    found = sides.select("k", size.alias("n"), a.alias("a"), b.alias("b")).groupBy("k").agg(F.avg(score).alias("mean"))
    return {r["k"]: r["mean"] for r in found.collect()}


def elbow(rfm: DataFrame, ks: range = range(1, 11), seed: int = SEED) -> DataFrame:
    """Inertia and silhouette for each k, on metrics that are not capped. A k of 1 has no silhouette.

    All k share their passes: one per step of the slowest, one for the sums and one for the silhouettes.
    """
    points = with_features(rfm, clip=False)
    centres = fit_centres(points, list(ks), seed)
    sums = _cluster_sums(points, centres) if centres else {}
    sides = _silhouettes(points, {k: c for k, c in centres.items() if k > 1}, sums)
    inertias = {k: sum(r["distance"] for (of, _), r in sums.items() if of == k) for k in centres}
    rows = [(k, inertias[k], sides.get(k)) for k in centres]
    return rfm.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def principal_axes(vectors: DataFrame, count: int = 2) -> tuple[list[float], list[list[float]], list[float]]:
    """(means, axes, shares) of the metrics: unit eigenvectors of their 3 x 3 covariance matrix, by falling
    share of variance. The largest loading of an axis is positive, so its sign is the same everywhere."""
    pairs = [(a, b) for a in range(len(SCALED)) for b in range(a, len(SCALED))]
    row = vectors.agg(
        *[F.avg(x) for x in SCALED], *[F.covar_pop(F.col(SCALED[a]), F.col(SCALED[b])) for a, b in pairs]).first()
    means, matrix = list(row[: len(SCALED)]), np.zeros((len(SCALED), len(SCALED)))
    if means[0] is None:
        return [0.0] * len(SCALED), [[0.0] * len(SCALED)] * count, [0.0] * count
    for (a, b), value in zip(pairs, row[len(SCALED):]):
        matrix[a, b] = matrix[b, a] = value
    sizes, axes = np.linalg.eigh(matrix)
    order = np.argsort(-sizes)[:count]
    chosen = [axes[:, j] * (1 if axes[np.abs(axes[:, j]).argmax(), j] > 0 else -1) for j in order]
    whole = sizes.sum() or 1.0
    return means, [c.tolist() for c in chosen], [float(sizes[j] / whole) for j in order]


def pca_projection(vectors: DataFrame) -> DataFrame:
    """First two principal components of the (centred) metrics and the share of variance each explains."""
    means, axes, shares = principal_axes(vectors)

    def along(axis: list[float]) -> Column:
        return sum(((F.col(x) - F.lit(m)) * F.lit(w) for x, m, w in zip(SCALED, means, axis)), F.lit(0.0))

    return vectors.select(
        "CustomerID", along(axes[0]).alias("pc1"), along(axes[1]).alias("pc2"),
        F.lit(shares[0]).alias("explained_pc1"), F.lit(shares[1]).alias("explained_pc2"),
    )


def churn_risk(rfm: DataFrame) -> DataFrame:
    """Recency scaled to 0..1; NULL when all recencies are equal."""
    low = rfm.agg(F.min("recency")).scalar()
    high = rfm.agg(F.max("recency")).scalar()
    past = (F.col("recency") - low).cast("double")
    return rfm.withColumn("Churn_Risk", F.try_divide(past, (high - low).cast("double")))


def mean_risk_by_cluster(rfm: DataFrame) -> DataFrame:
    return (
        rfm.dropna(subset=["Cluster_Name"]).groupBy("Cluster_Name")
        .agg(F.round(F.avg("Churn_Risk"), 2).alias("mean_churn_risk"))
        .orderBy("Cluster_Name")
    )
