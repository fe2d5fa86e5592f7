"""Every operator as a query over a data folder: name -> (spark, folder) -> DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import dates
from tillroll.operators import (
    churn, cleaning, clusters, clv, cohorts, forecast, profiling, recommend, revenue, rfm, transitions,
)
from tillroll.plans import inputs
from tillroll.plans.inputs import plain, rounded, rounded_half_up
from tillroll.plans.reports import REPORTS, run_report
from tillroll.sources import files, views
from tillroll.sources.staging import stage, staging_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _register(name: str, build: Query) -> None:
    QUERIES[name] = lambda spark, folder: plain(build(spark, folder))


def _on_raw(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    _register(name, lambda spark, folder: operator(inputs.raw_transactions(spark, folder)))


def _on_transactions(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    _register(name, lambda spark, folder: operator(inputs.transactions(spark, folder)))


def _on_purchases(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    _register(name, lambda spark, folder: operator(inputs.timed_purchases(spark, folder)))


def _on_customers(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    """Operators over scored customers (a scan of the staged customer history)."""
    _on_transactions(name, lambda tx: operator(inputs.customers(tx)))


def _on_base(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    """Operators that need recency, frequency and monetary only."""
    _on_transactions(name, lambda tx: operator(rfm.rfm_base(tx)))


def _on_both(name: str, operator: Callable[[DataFrame, DataFrame], DataFrame], *more: str) -> None:
    """Operators over transactions (the base columns and those named) and scored customers."""
    def build(spark, folder):
        tx = inputs.staged_transactions(spark, folder, *inputs.BASE_COLUMNS, *more)
        return operator(tx, inputs.customers(tx))

    _register(name, build)


# ---- sources and sinks --------------------------------------------------------

def _load_parts(spark, folder):
    raw = inputs.raw_transactions(spark, folder)
    # Lines without a date belong to a part too.
    late = F.coalesce(F.col("InvoiceDate") >= F.lit("1998-01-01").cast("timestamp_ntz"), F.lit(True))
    paths = [staging_path(spark, "raw-part") for _ in range(2)]
    for path, part in zip(paths, (raw.filter(~late), raw.filter(late))):
        part.write.options(header=True, quote='"', escape='"').csv(path)
    return files.load_raw(spark, paths, "csv")


def _read_transactions(spark, folder):
    path = staging_path(spark, "transactions-csv")
    files.write_transactions(inputs.transactions(spark, folder), path, "csv")
    return files.read_transactions(spark, path, "csv")


def _write_transactions(spark, folder):
    path = staging_path(spark, "transactions-by-month")
    files.write_transactions(inputs.transactions(spark, folder), path)
    return files.read_transactions(spark, path)


def _customer_file(fmt):
    def build(spark, folder):
        path = staging_path(spark, f"customers-{fmt}")
        scored = clusters.churn_risk(inputs.customers(inputs.transactions(spark, folder)))
        files.write_customers(scored, path, fmt)
        return rounded(files.read_customers(spark, path, fmt), 6, "Churn_Risk")

    return build


def _tables(spark, folder, *more):
    tx = inputs.staged_transactions(spark, folder, *inputs.BASE_COLUMNS, *more)
    return {"transactions": tx, "rfm": inputs.customers(tx)}


def _ad_hoc_sql(spark, folder):
    return views.run_query(spark, """
        SELECT r.Segment, t.Country, SUM(t.units) AS units, CAST(SUM(t.spend) AS DOUBLE) AS spend
        FROM (SELECT CustomerID, Country, SUM(Quantity) AS units, SUM(TotalPrice) AS spend
              FROM transactions GROUP BY CustomerID, Country) t
        JOIN rfm r ON t.CustomerID = r.CustomerID
        GROUP BY r.Segment, t.Country""", **_tables(spark, folder, "Country", "Quantity"))


def _view_counts(spark, folder):
    return views.run_query(spark, """
        SELECT 'transactions' AS view_name, COUNT(*) AS row_count FROM transactions
        UNION ALL SELECT 'rfm', COUNT(*) FROM rfm""", **_tables(spark, folder))


_register("source_load_parts", _load_parts)
_register("source_read_transactions", _read_transactions)
_register("source_read_customers", _customer_file("csv"))
_register("sink_write_transactions", _write_transactions)
_register("sink_write_customers", _customer_file("parquet"))
_register("sql_views", _view_counts)
_register("sql_run_query", _ad_hoc_sql)

# ---- cleaning -----------------------------------------------------------------

_on_raw("cleaning_drop_duplicates", cleaning.drop_duplicate_lines)
_on_raw("cleaning_rename_customer", cleaning.rename_customer_key)
_on_raw("cleaning_drop_missing_keys", lambda raw: cleaning.drop_missing_keys(cleaning.rename_customer_key(raw)))
_on_raw("cleaning_cast_customer", lambda raw: cleaning.cast_customer_key(cleaning.rename_customer_key(raw)))
_on_raw("cleaning_positive_quantity", cleaning.keep_positive_quantity)
_on_raw("cleaning_positive_price", cleaning.keep_positive_price)
_on_raw("cleaning_quantity_cap", cleaning.keep_plausible_quantity)
_on_raw("cleaning_parse_date", lambda raw: cleaning.parse_invoice_date(
    raw.withColumn("InvoiceDate", F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss"))))
_on_raw("cleaning_line_total", cleaning.add_line_total)
_on_raw("cleaning_drop_cancellations", cleaning.drop_cancellations)
_on_raw("cleaning_all_steps", cleaning.clean_transactions)
_on_transactions("cleaning_products_only", cleaning.products_only)
_on_transactions("cleaning_products_exact_case", cleaning.products_only_exact_case)
_on_transactions("cleaning_known_country", cleaning.known_country)

# ---- dates --------------------------------------------------------------------


def _with_date(name, expression, register=_on_transactions, keys=("Invoice", "StockCode", "CustomerID")):
    register(f"date_{name}", lambda df: df.select(*keys, expression(F.col("InvoiceDate")).alias(name)))


_with_date("month_start", dates.month_start)
_with_date("month_label", dates.month_label)
_with_date("hour_of_day", dates.hour_of_day, _on_purchases, ("Invoice", "CustomerID"))
_with_date("weekday_name", dates.weekday_name)

# ---- profiling ----------------------------------------------------------------


def _cleaning_report(spark, folder):
    raw = inputs.raw_transactions(spark, folder)
    return profiling.cleaning_report(raw, cleaning.clean_transactions(raw))


_on_raw("profile_missing_values", profiling.missing_values)
_on_raw("profile_cancellation_rate", profiling.cancellation_rate)
_register("profile_cleaning_report", _cleaning_report)
_on_transactions("profile_dataset_summary", profiling.dataset_summary)
_on_base("profile_describe_rfm", profiling.describe_rfm)
_on_base("profile_rfm_histograms",
              lambda c: rounded_half_up(profiling.rfm_histograms(c), 4, "bin_from", "bin_to"))
_on_customers("profile_churn_risk_histograms", lambda c: rounded_half_up(
    profiling.churn_risk_histograms(stage(clusters.churn_risk(c), "customer-risk")), 6, "bin_from", "bin_to"))
_on_both("profile_coverage_check", profiling.coverage_check)

# ---- aggregations, rankings, limits -------------------------------------------

_on_transactions("revenue_monthly", revenue.monthly_revenue)
_on_transactions("revenue_peak_month", revenue.peak_month)
_on_purchases("orders_by_hour", revenue.orders_by_hour)
_on_transactions("orders_by_weekday", revenue.orders_by_weekday)
_on_transactions("revenue_by_weekday", revenue.revenue_by_weekday)
_on_purchases("revenue_by_hour", revenue.revenue_by_hour)
_on_transactions("products_top", revenue.top_products)
_on_transactions("revenue_headline_figures", revenue.headline_figures)
_on_customers("customers_at_risk_share", revenue.at_risk_share)
_on_customers("customers_by_segment", revenue.segment_distribution)
_on_customers("customers_by_cluster", revenue.cluster_distribution)
_on_transactions("revenue_by_country", revenue.revenue_by_country)
_on_transactions("revenue_home_and_international", revenue.home_and_international)

# ---- SQL reports --------------------------------------------------------------

def _report(title):
    def build(spark, folder):
        if "JOIN rfm" in REPORTS[title].sql:
            return run_report(spark, title, **_tables(spark, folder))
        return run_report(spark, title, transactions=inputs.transactions(spark, folder))

    return build


for _title, _named in REPORTS.items():
    _register(_named.query, _report(_title))

# ---- RFM ----------------------------------------------------------------------

_SCORES = ["R-Score", "F-Score", "M-Score"]


def _scores(tx: DataFrame, *names: str) -> DataFrame:
    return rfm.compute_rfm(tx).select("CustomerID", *[F.col(f"`{n}`") for n in names])


_on_transactions("rfm_base", rfm.rfm_base)
_on_transactions("rfm_recency_score", lambda tx: _scores(tx, "R-Score"))
_on_transactions("rfm_frequency_score", lambda tx: _scores(tx, "F-Score"))
_on_transactions("rfm_monetary_score", lambda tx: _scores(tx, "M-Score"))
_on_transactions("rfm_total_score", lambda tx: _scores(tx, "RFM_Score"))
_on_transactions("rfm_segment", lambda tx: _scores(tx, "Segment"))
_on_transactions("rfm_scores", rfm.compute_rfm)

# ---- clusters -----------------------------------------------------------------


_SHARES = ["explained_pc1", "explained_pc2"]


def _clustered_vectors(spark, folder):
    base = rfm.rfm_base(inputs.transactions(spark, folder))
    return clusters.assign_clusters(base)


def _silhouette(spark, folder):
    return _silhouette_of(_clustered_vectors(spark, folder))


def _silhouette_of(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy().agg(
        F.countDistinct("Cluster").alias("k"), F.count(F.lit(1)).alias("customers"),
        F.lit(clusters.silhouette(assigned)).alias("silhouette"))


def _inertias(labelled: DataFrame) -> DataFrame:
    """Of one cluster, and of the stand-in labels."""
    return clusters.inertia(labelled.withColumn("Cluster", F.lit(0))).unionByName(clusters.inertia(labelled))


_on_base("cluster_clip_outliers", lambda c: rounded(
    clusters.clip_outliers(c).select("CustomerID", "recency", "frequency", "monetary"), 4, "frequency", "monetary"))
_on_base("cluster_standardise", lambda c: rounded(
    clusters.standardise(c, clip=True).select("CustomerID", *clusters.SCALED), 6, *clusters.SCALED))
_on_base("cluster_kmeans", lambda c: clusters.fit_clusters(c).select("CustomerID", "Cluster", "Cluster_Name"))
_register("cluster_silhouette", _silhouette)
_on_customers("cluster_silhouette_stand_in", lambda c: rounded(_silhouette_of(
    clusters.with_features(c, clip=True)), 6, "silhouette"))
_register("cluster_pca_shares", lambda spark, folder: rounded(clusters.pca_projection(
    _clustered_vectors(spark, folder)).agg(*[F.max(s).alias(s) for s in _SHARES]), 6, *_SHARES))
_on_customers("cluster_means", lambda c: rounded(clusters.cluster_means(c), 2, "recency", "frequency", "monetary"))
_on_customers("cluster_names", lambda c: clusters.name_clusters(c.drop("Cluster_Name")).select(
    "CustomerID", "Cluster", "Cluster_Name"))
_on_base("cluster_elbow", clusters.elbow)
_on_base("cluster_pca", lambda c: rounded(clusters.pca_projection(clusters.with_features(c, clip=True)), 4, "pc1", "pc2", *_SHARES))
_on_customers("cluster_inertia", lambda c: rounded(_inertias(clusters.with_features(c, clip=True)), 4, "inertia"))
_on_base("cluster_churn_risk", lambda c: rounded(
    clusters.churn_risk(c).select("CustomerID", "Churn_Risk"), 6, "Churn_Risk"))
_on_customers("cluster_mean_risk", lambda c: clusters.mean_risk_by_cluster(clusters.churn_risk(c)))

# ---- cohorts ------------------------------------------------------------------


def _retention(tx: DataFrame) -> DataFrame:
    return cohorts.retention(cohorts.cohort_counts(tx))


#: Periods the registered matrices show at least, so that their layout is the same for every table.
_SHOWN_PERIODS = 81


def _cohort_pivot(tx: DataFrame, value: str, kind: str, periods: int) -> DataFrame:
    long = stage(_retention(tx), "cohort-retention").withColumn(value, F.col(value).cast(kind))
    last = long.agg(F.max("CohortPeriod")).first()[0]
    return cohorts.cohort_matrix(long, value, list(range(max(periods, (last or 0) + 1))))


_on_transactions("cohort_month", cohorts.customer_months)
_on_transactions("cohort_period", lambda tx: cohorts.with_cohort_period(cohorts.customer_months(tx)))
_on_transactions("cohort_period_calendar", lambda tx: cohorts.with_cohort_period(
    cohorts.customer_months(tx), calendar=True))
_on_transactions("cohort_counts", cohorts.cohort_counts)
_on_transactions("cohort_matrix", lambda tx: _cohort_pivot(tx, "customers", "double", _SHOWN_PERIODS))
_on_transactions("cohort_retention_matrix", lambda tx: rounded(
    (wide := _cohort_pivot(tx, "retention_pct", "double", _SHOWN_PERIODS)), 6, *wide.columns[1:]))
_on_transactions("cohort_sizes", lambda tx: cohorts.cohort_sizes(cohorts.cohort_counts(tx)))
_on_transactions("cohort_retention", lambda tx: rounded(_retention(tx), 6, "retention_pct"))
_on_transactions("cohort_first_periods", lambda tx: rounded(
    cohorts.first_periods(stage(_retention(tx), "cohort-retention"), 12), 6, "retention_pct"))
_on_transactions("cohort_average_retention", lambda tx: rounded(
    cohorts.average_retention(_retention(tx)), 6, *[f"avg_period_{p}_pct" for p in (1, 3, 6)]))

# ---- segment transitions ------------------------------------------------------


def _matrix(tx: DataFrame) -> DataFrame:
    pairs = transitions.next_segments(transitions.monthly_segments(tx))
    return transitions.transition_matrix(transitions.transition_counts(pairs))


_on_transactions("transition_monthly_segments", transitions.monthly_segments)
_on_transactions("transition_pairs", lambda tx: transitions.next_segments(transitions.monthly_segments(tx)))
_on_transactions("transition_counts", lambda tx: transitions.transition_counts(
    transitions.next_segments(transitions.monthly_segments(tx))))
_on_transactions("transition_matrix", lambda tx: rounded(_matrix(tx), 6, *transitions.SEGMENTS))
_on_transactions("transition_steady_state", lambda tx: rounded(
    transitions.steady_state(_matrix(tx)), 6, "steady_pct"))

# ---- churn --------------------------------------------------------------------


def _labelled(c: DataFrame) -> DataFrame:
    return churn.churn_label(c)


def _with_model(use):
    """Queries that need the fitted churn model."""
    def build(spark, folder):
        return use(spark, *inputs.churn_training(spark, folder))

    return build


def _explained(spark, split, model):
    grid = churn.shapley_grid(split.filter(~F.col("is_test")), churn.score_grid(spark, model))
    return churn.shap_values(split, stage(grid, "shapley-grid"))


def _scored_test(split, model):
    return churn.score_customers(split.filter("is_test"), model)


def _model_evaluation(spark, split, model):
    test = stage(_scored_test(split, model), "scored-test")
    return churn.roc_auc(test).withColumn("customers", F.lit(test.count()))


def _explained_stand_in(scored: DataFrame) -> DataFrame:
    """Customers with contributions to the stand-in score, averaged over the training part."""
    split = stage(churn.stratified_split(_labelled(scored)), "split")
    grid = churn.shapley_grid(split.filter(~F.col("is_test")), inputs.stand_in_grid(scored.sparkSession))
    return churn.shap_values(split, stage(grid, "shapley-grid"))


_SHAP = ["base_value", "shap_f", "shap_m"]


_on_base("churn_label", lambda c: _labelled(c).select("CustomerID", "recency", "Churned"))
_on_base("churn_label_balance", lambda c: churn.label_balance(_labelled(c)))
_on_base("churn_split", lambda c: churn.stratified_split(_labelled(c)).select(
    "CustomerID", "Churned", "is_test"))
_on_base("churn_class_weight", lambda c: rounded(churn.class_weight(
    churn.stratified_split(_labelled(c)).filter(~F.col("is_test"))), 6, "churned_weight"))
_register("churn_model_evaluation", _with_model(_model_evaluation))
_register("churn_model_scores", _with_model(lambda spark, split, model: churn.with_risk(
    churn.score_customers(split, model)).select("CustomerID", "F-Score", "M-Score", "churn_prob", "risk_level", "action")))
_register("churn_score_grid", _with_model(lambda spark, split, model: churn.prediction_grid(churn.score_grid(spark, model))))
_on_customers("churn_classification_report", lambda c: rounded(
    churn.classification_report(_labelled(c)), 6, "precision", "recall", "f1_score"))
_on_customers("churn_confusion_matrix", lambda c: churn.confusion_matrix(_labelled(c)))
_on_customers("churn_roc_auc", lambda c: rounded(churn.roc_auc(_labelled(c)), 6, "roc_auc"))
_on_customers("churn_roc_curve", lambda c: rounded(churn.roc_curve(_labelled(c)), 6, "threshold", "fpr", "tpr"))
_register("churn_feature_importance", _with_model(
    lambda spark, split, model: churn.feature_importance(spark, model)))
_register("churn_model_report", _with_model(
    lambda spark, split, model: churn.classification_report(_scored_test(split, model))))
_register("churn_model_confusion", _with_model(
    lambda spark, split, model: churn.confusion_matrix(_scored_test(split, model))))
_register("churn_model_roc_curve", _with_model(
    lambda spark, split, model: churn.roc_curve(_scored_test(split, model))))
_on_customers("churn_stand_in_grid", lambda c: c.select("F-Score", "M-Score").distinct().join(
    churn.prediction_grid(inputs.stand_in_grid(c.sparkSession)),
    (F.col("F-Score") == F.col("f_score")) & (F.col("M-Score") == F.col("m_score"))).drop("F-Score", "M-Score"))
_on_customers("churn_stand_in_shap_values", lambda c: rounded(_explained_stand_in(c).select(
    "CustomerID", *_SHAP, "log_odds"), 6, *_SHAP, "log_odds"))
_on_customers("churn_stand_in_mean_shap", lambda c: rounded(churn.mean_absolute_shap(
    _explained_stand_in(c).filter("is_test")), 6, "mean_abs_shap"))
_on_customers("churn_stand_in_explanations", lambda c: rounded(churn.explain_customers(
    _explained_stand_in(c)).select("CustomerID", "base_prob", "final_prob", "direction"), 6, "base_prob", "final_prob"))
_register("churn_shap_values", _with_model(lambda spark, split, model: _explained(spark, split, model).select(
    "CustomerID", "base_value", "shap_f", "shap_m", "log_odds")))
_register("churn_mean_absolute_shap", _with_model(
    lambda spark, split, model: churn.mean_absolute_shap(_explained(spark, split, model).filter("is_test"))))
_register("churn_explanations", _with_model(
    lambda spark, split, model: churn.explain_customers(_explained(spark, split, model))))
_on_customers("churn_risk_bands", lambda c: churn.with_risk(c).select(
    "CustomerID", "churn_prob", "risk_level", "action"))

# ---- lifetime value -----------------------------------------------------------


def _clv(tx: DataFrame, c: DataFrame) -> DataFrame:
    return clv.compute_clv(tx, c)


def _staged_clv(operator):
    return lambda tx, c: operator(stage(_clv(tx, c), "clv"))


def _model_clv(spark, folder):
    split, model = inputs.churn_training(spark, folder)
    scored = churn.score_customers(clusters.fit_clusters(split), model)
    return clv.compute_clv(inputs.transactions(spark, folder), scored)


_CLV_FIGURES = ["months_active", "avg_monthly_spend", "churn_prob_annual", "expected_months"]
_on_transactions("clv_history", clv.spend_history)
_on_transactions("clv_months_active", lambda tx: rounded(
    clv.with_months_active(clv.spend_history(tx)).select("CustomerID", "months_active"), 6, "months_active"))
_on_transactions("clv_monthly_spend", lambda tx: rounded(
    clv.with_monthly_spend(clv.with_months_active(clv.spend_history(tx))).select("CustomerID", "avg_monthly_spend"),
    4, "avg_monthly_spend"))
_on_both("clv_scored_customers_only", lambda tx, c: clv.scored_customers_only(
    clv.spend_history(tx), churn.stratified_split(_labelled(c)).filter(~F.col("is_test"))))
_on_customers("clv_expected_months", lambda c: rounded(c.select(
    "CustomerID", "churn_prob", clv.expected_months(F.col("churn_prob")).alias("expected_months")), 6, "expected_months"))
_on_both("clv_table", lambda tx, c: rounded(rounded(_clv(tx, c), 4, *_CLV_FIGURES), 2, "predicted_clv"))
_on_both("clv_mean_by_segment", lambda tx, c: rounded(clv.mean_clv_by_segment(_clv(tx, c)), 2, "mean_clv"))
_on_both("clv_box_by_segment", _staged_clv(lambda t: rounded(
    clv.clv_box_by_segment(t), 2, "q1", "median", "q3", "whisker_low", "whisker_high")))
_on_both("clv_summary", _staged_clv(lambda t: rounded(
    clv.clv_summary(t), 2, "mean_clv", "median_clv", "p90_clv", "total_clv")))
_on_both("clv_quadrants", _staged_clv(lambda t: clv.churn_value_quadrants(t).select("CustomerID", "quadrant")))
_on_both("clv_top_customers", lambda tx, c: rounded(
    rounded(clv.top_by_clv(_clv(tx, c)), 4, *_CLV_FIGURES), 2, "predicted_clv"))
_register("clv_with_model", _model_clv)

# ---- forecast -----------------------------------------------------------------


def _trended(tx: DataFrame) -> DataFrame:
    return forecast.with_trend(revenue.monthly_revenue(tx))


_on_transactions("forecast_trend", lambda tx: rounded(
    _trended(tx).select("Month", "revenue", "t", "slope", "intercept", "trend"), 2, "slope", "intercept", "trend"))
_on_transactions("forecast_seasonal_index", lambda tx: rounded(
    forecast.seasonal_index(_trended(tx)), 2, "seasonal"))
_on_transactions("forecast_fitted", lambda tx: rounded(
    forecast.with_fitted(_trended(tx)).select("Month", "fitted"), 2, "fitted"))
_on_transactions("forecast_residual_std", lambda tx: rounded(
    forecast.residual_std(forecast.with_fitted(_trended(tx))), 2, "residual_std"))
_on_transactions("forecast_six_months", lambda tx: rounded(
    forecast.forecast(revenue.monthly_revenue(tx)), 2, "forecast", "lower", "upper"))
_on_transactions("forecast_trend_figures", lambda tx: rounded(
    forecast.trend_figures(revenue.monthly_revenue(tx)), 2, "monthly_trend", "next_month_forecast", "residual_std"))

# ---- recommendations and profiles ---------------------------------------------


def _joined_list(df: DataFrame) -> DataFrame:
    return df.withColumn("recommendations", F.array_join("recommendations", " | "))


def _model_recommendations(spark, folder):
    tx = inputs.staged_transactions(spark, folder, *inputs.BASE_COLUMNS, "Description")
    return _joined_list(recommend.recommend_for_all(tx, inputs.clustered_customers(tx)))


def _model_profiles(spark, folder):
    split, model = inputs.churn_training(spark, folder)
    return recommend.customer_profiles(churn.score_customers(clusters.fit_clusters(split), model))


_on_transactions("recommend_popular", recommend.recommend_popular)
_on_both("recommend_cluster_top", recommend.cluster_top_products, "Description")
_on_both("recommend_all", lambda tx, c: _joined_list(recommend.recommend_for_all(tx, c)), "Description")
_on_both("recommend_sample_customers", recommend.sample_per_cluster, "Description")
_register("recommend_held_out_lines", lambda spark, folder: recommend.held_out_lines(
    inputs.staged_transactions(spark, folder)))
_register("recommend_training_lines", lambda spark, folder: recommend.training_lines(
    inputs.staged_transactions(spark, folder)))
_on_both("recommend_holdout_hits", recommend.holdout_hits, "Description")
_on_both("recommend_evaluation", recommend.evaluate_recommendations, "Description")
_on_customers("customer_profiles", recommend.customer_profiles)
_register("recommend_with_model", _model_recommendations)
_register("customer_profiles_with_model", _model_profiles)
