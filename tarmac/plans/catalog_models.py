"""Catalog entries for the model plans (rows-only checks: model output has
no SQL oracle). The dataset loaders (``baseline_rows``, ``route_model_rows``)
do have one.

The library defaults are the reference's model sizes (200 trees, 300 boosting
rounds, 10 k-means restarts, 3-fold grids). Boosting takes a pass over the rows
for each level of each tree, so the catalog entries, which the driver runs as
smoke checks, use the smaller sizes below (the README has their measured times),
but for ``regression_models``, the forest and clustering; every entry reads all rows of its tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators.features import stratified_split, with_row_key
from tarmac.plans import modeling as MP
from tarmac.plans.catalog import Query
from tarmac.schema import BASELINE_CATEGORICAL, BASELINE_NUMERIC, ROUTE_CATEGORICAL, ROUTE_NUMERIC
from tarmac.sources.testview import flights_view, schedule_view

SMOKE = {
    "rf_trees": 20,
    "gbt_iter": 60,
    "gb_iter": 20,
    "boost_iter": 60,
    "curve_iter": 30,
}


def _data(sp, d):
    return MP.classification_data(flights_view(sp, d))


def _classification(sp, d, models=("logreg", "random_forest", "gbt")):
    return MP.run_classification(_data(sp, d), rf_trees=SMOKE["rf_trees"], gbt_iter=SMOKE["gbt_iter"], models=models)


def _regression(sp, d, **sizes):
    # Regression uses its own split, not stratified on the delay label.
    return MP.run_regression(MP.classification_data(flights_view(sp, d), stratify=False), **sizes)


def _clustering(sp, d):
    return MP.run_clustering(_data(sp, d))


def _route_scored(sp, d):
    rows = MP.route_model_rows(flights_view(sp, d), schedule_view(sp, d))
    _, scored, _ = MP.train_and_evaluate(rows, ROUTE_NUMERIC, ROUTE_CATEGORICAL, model_type="logreg", lr_iter=300)
    return scored


def _baseline(sp, d):
    rows = MP.baseline_rows(flights_view(sp, d))
    _, _, tables = MP.train_and_evaluate(rows, BASELINE_NUMERIC, BASELINE_CATEGORICAL, model_type="logreg")
    return tables["metrics"]


def _baseline_forest(sp, d):
    rows = MP.baseline_rows(flights_view(sp, d))
    _, _, tables = MP.train_and_evaluate(rows, BASELINE_NUMERIC, BASELINE_CATEGORICAL, model_type="rf")
    return tables["classification_report"]


def _onehot(rows, categorical):
    keyed = with_row_key(rows.withColumn("label", F.col("is_delayed").cast("int")))
    split = MP.materialize(stratified_split(keyed, "label", 0.2, 42, key_cols=["_row_key"]))
    return MP.onehot_slots(split.where(~F.col("is_test")), categorical, split.where(F.col("is_test")))


def model_queries() -> dict[str, Query]:
    return {
        "baseline_rows": lambda sp, d: MP.baseline_rows(flights_view(sp, d)),
        "route_model_rows": lambda sp, d: MP.route_model_rows(flights_view(sp, d), schedule_view(sp, d)),
        "baseline_model_metrics": _baseline,
        "baseline_forest_report": _baseline_forest,
        "onehot_slots": lambda sp, d: _onehot(MP.baseline_rows(flights_view(sp, d)), BASELINE_CATEGORICAL),
        "onehot_event_slots": lambda sp, d: _onehot(
            MP.route_model_rows(flights_view(sp, d), schedule_view(sp, d)), ROUTE_CATEGORICAL),
        "classifier_metrics": lambda sp, d: _classification(sp, d)["classifier_metrics"],
        "feature_importance": lambda sp, d: _classification(sp, d, ("gbt",))["feature_importance"],
        "model_threshold_sweep": lambda sp, d: _classification(sp, d, ("gbt",))["threshold_sweep"],
        "route_risk": lambda sp, d: MP.route_risk(_route_scored(sp, d), 10, 50),
        "event_risk": lambda sp, d: MP.event_risk(_route_scored(sp, d), 20),
        "regression_models": lambda sp, d: _regression(sp, d)["regression_models"],  # full sizes
        "cluster_profile": lambda sp, d: _clustering(sp, d)["cluster_profile"],
        "kmeans_elbow": lambda sp, d: MP.run_clustering(_data(sp, d), elbow_ks=list(range(2, 11)))["kmeans_elbow"],
        "gbt_tuning": lambda sp, d: MP.gbt_tuning(_data(sp, d), max_iter=SMOKE["curve_iter"]),
        "learning_curve": lambda sp, d: MP.learning_curve(_data(sp, d), max_iter=SMOKE["curve_iter"]),
        "complexity_curve": lambda sp, d: MP.complexity_curve(_data(sp, d), max_iter=SMOKE["curve_iter"]),
        "regression_scatter": lambda sp, d: _regression(sp, d, gb_iter=SMOKE["gb_iter"], boost_iter=SMOKE["boost_iter"])["regression_scatter"],
        "cluster_scatter": lambda sp, d: _clustering(sp, d)["cluster_scatter"],
    }
