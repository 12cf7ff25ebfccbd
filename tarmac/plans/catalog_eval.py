"""Catalog entries for the evaluation tables on the deterministic scored rows."""

from __future__ import annotations

from tarmac.operators import evaluate as E
from tarmac.operators.features import class_weights
from tarmac.plans.catalog import Query, load_clean
from tarmac.sources.testview import scored_view


def load_scored(spark, sf_dir):
    return scored_view(load_clean(spark, sf_dir))


def eval_queries() -> dict[str, Query]:
    s = load_scored
    return {
        "confusion_matrix": lambda sp, d: E.confusion_counts(s(sp, d)),
        "binary_metrics": lambda sp, d: E.binary_metrics(s(sp, d)),
        "classification_report": lambda sp, d: E.classification_report(s(sp, d)),
        "expected_value": lambda sp, d: E.expected_value(s(sp, d)),
        "threshold_sweep": lambda sp, d: E.threshold_sweep(s(sp, d)),
        "profit_curve": lambda sp, d: E.profit_curve(s(sp, d)),
        "best_threshold": lambda sp, d: E.best_threshold(E.profit_curve(s(sp, d))),
        "roc_points": lambda sp, d: E.roc_points(s(sp, d)),
        "roc_auc": lambda sp, d: E.roc_auc(s(sp, d)),
        "regression_metrics": lambda sp, d: E.regression_metrics(s(sp, d)),
        "mean_baseline": lambda sp, d: E.mean_baseline(
            s(sp, d).where("prediction = 0"), s(sp, d).where("prediction = 1")),
        "residual_histogram": lambda sp, d: E.residual_histogram(s(sp, d)),
        "class_weights": lambda sp, d: class_weights(s(sp, d), "label"),
    }


def feature_queries() -> dict[str, Query]:
    from tarmac.operators import features as FE
    from tarmac.schema import MODEL_NUMERIC
    from tarmac.sources.testview import flights_view

    def frame(sp, d):
        return FE.model_features(flights_view(sp, d))

    def scaled(sp, d):
        f = frame(sp, d)
        return FE.standardize(f, FE.fit_standardizer(f, MODEL_NUMERIC)).select(*MODEL_NUMERIC)

    def split_counts(sp, d):
        from pyspark.sql import functions as F

        c = load_clean(sp, d)
        split = FE.stratified_split(FE.with_row_key(c), "is_delayed", 0.2, 42, key_cols=["_row_key"])
        return split.groupBy("is_delayed", "is_test").agg(F.count(F.lit(1)).alias("rows"))

    def fold_counts(sp, d):
        from pyspark.sql import functions as F

        folds = FE.stratified_folds(FE.with_row_key(load_clean(sp, d)), "is_delayed", 3, 42, ["_row_key"])
        return folds.groupBy("is_delayed", "fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("arr_delay").alias("minutes"))

    return {
        "feature_frame": frame,
        "scaled_features": scaled,
        "stratified_split": split_counts,
        "stratified_folds": fold_counts,
        "subsample": lambda sp, d: FE.subsample(FE.with_row_key(load_clean(sp, d)), 1000, 42, ["_row_key"]).drop("_row_key"),
    }
