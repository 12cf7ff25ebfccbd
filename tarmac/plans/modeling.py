"""Model plans: classification, regression, clustering, and the baseline and
route/event risk classifiers.

Each plan fits ``pyspark.ml`` models on executors and returns small result
tables as DataFrames. Prepared training data and scored test rows are
checkpointed to the shared checkpoint folder: iterative learners and the
several metric tables then read a materialised copy, and a lost executor
recomputes from that copy instead of from the raw scan.
"""

from __future__ import annotations

import itertools

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import ROUND_DIGITS, route_key
from tarmac.operators import boosting as B
from tarmac.operators import evaluate as E
from tarmac.operators import minibatch
from tarmac.operators import models as M
from tarmac.operators.clean import clean_flights
from tarmac.operators.events import enrich_events, event_dimension, with_event_flag
from tarmac.operators.features import (
    class_weight_column,
    engineered_columns,
    filled_features,
    hash_unit,
    stratified_folds,
    stratified_split,
    subsample,
    with_row_key,
)
from tarmac.operators.forest import Forest, fit_forest
from tarmac.operators.joins import stored
from tarmac.operators.onehot import fit_one_hot
from tarmac.schema import (
    BASELINE_CATEGORICAL,
    BASELINE_NUMERIC,
    CLUSTER_FEATURES,
    DELAY_THRESHOLD,
    MODEL_CATEGORICAL,
    MODEL_NUMERIC,
    ROUTE_CATEGORICAL,
    ROUTE_NUMERIC,
)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there:
    as columns, so that each later pass reads only those it needs."""
    return stored(df, "rows")[0]


def _r(c):
    return F.round(c, ROUND_DIGITS)


def _metrics_row(name: str, scored: DataFrame, with_auc: bool = True) -> DataFrame:
    m = E.binary_metrics(scored).select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1",
                                        "tn", "fp", "fn", "tp")
    if with_auc and "p" in scored.columns:
        auc = E.roc_auc(scored).select("auc").first()["auc"]
        m = m.withColumn("auc", F.lit(auc).cast("double"))
    else:
        m = m.withColumn("auc", F.lit(None).cast("double"))
    return m


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------------------
# Data preparation
# ---------------------------------------------------------------------------

def feature_rows(flights: DataFrame, threshold: float = DELAY_THRESHOLD) -> DataFrame:
    """Feature frame with ``label`` and ``_row_key``, materialised. The flights
    are read once: medians and rows come from the materialised columns."""
    feats = filled_features(materialize(engineered_columns(flights)))
    return with_row_key(feats.withColumn("label", (F.col("arr_delay") >= threshold).cast("int")))


def split_rows(feats: DataFrame, test_fraction: float = 0.2, seed: int = 42, stratify: bool = True) -> DataFrame:
    """``feats`` (with ``label`` and ``_row_key``) with ``is_test`` and balanced
    ``weight``: class weights of the training rows, 1 for test rows. Both are
    column expressions over the rows given."""
    split = stratified_split(feats, "label", test_fraction, seed, key_cols=["_row_key"], stratify=stratify)
    weight = class_weight_column(split.where(~F.col("is_test")), "label")
    return split.withColumn("weight", F.when(F.col("is_test"), F.lit(1.0)).otherwise(weight))


def classification_data(flights: DataFrame, threshold: float = DELAY_THRESHOLD, test_fraction: float = 0.2,
                        seed: int = 42, stratify: bool = True) -> DataFrame:
    """Feature frame with ``label``, ``is_test`` and balanced ``weight``
    (class weights from the training rows only) over materialised rows."""
    return split_rows(feature_rows(flights, threshold), test_fraction, seed, stratify)


def baseline_rows(flights: DataFrame, threshold: float = DELAY_THRESHOLD) -> DataFrame:
    """Rows of the simple delay classifier: clean flights, unknown hour -1,
    rows with a missing feature dropped."""
    clean = clean_flights(flights, threshold, null_hour=-1, with_reason=False)
    cols = BASELINE_NUMERIC + BASELINE_CATEGORICAL
    return clean.select(*cols, "is_delayed").dropna(subset=cols + ["is_delayed"])


def route_model_rows(flights: DataFrame, schedule: DataFrame | None, threshold: float = DELAY_THRESHOLD) -> DataFrame:
    """Rows of the route/event classifier: as :func:`baseline_rows` plus the
    event name (origin first, then destination) and the event flag."""
    clean = clean_flights(flights, threshold, null_hour=-1, with_reason=False)
    if schedule is not None:
        clean = enrich_events(clean, event_dimension(schedule))
    else:
        clean = clean.withColumn("event_name", F.lit("none"))
    clean = with_event_flag(clean)
    cols = ROUTE_NUMERIC + ROUTE_CATEGORICAL
    return clean.select(*cols, "is_delayed").dropna(subset=cols + ["is_delayed"])


# ---------------------------------------------------------------------------
# Classification (numeric features; three models)
# ---------------------------------------------------------------------------

def run_classification(
    data: DataFrame,
    *,
    costs: dict | None = None,
    lr_iter: int = 200,
    rf_trees: int = 200,
    rf_depth: int = 10,
    gbt_iter: int = 300,
    gbt_params: dict | None = None,
    models: tuple = ("logreg", "random_forest", "gbt"),
    max_bins: int = 64,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Logistic regression (scaled numerics), random forest (numerics) and
    leaf-wise boosted trees (numerics + categoricals) on the training rows;
    metrics, threshold sweep, profit curve and importances (how often a feature
    is split on, and the gain) on the test rows. ``models`` may leave out the
    first two; sweep, curve and importances need the last."""
    train = data.where(~F.col("is_test"))
    test = data.where(F.col("is_test"))
    sum_w = train.agg(F.sum("weight")).first()[0] or 1.0

    fitted = {}
    if "logreg" in models:
        fitted["logreg"] = M.fit(M.scaled_numeric(MODEL_NUMERIC, "features") +
                                 [M.logistic(lr_iter, M.l2_for_sklearn_c(sum_w))], train)
    if "random_forest" in models:
        setting = Forest(trees=rf_trees, max_depth=rf_depth, weights="rows", seed=seed)
        forest = fit_forest(train, MODEL_NUMERIC, [], "label", "_row_key", setting, max_bins)
    params = {"max_depth": 8, **(gbt_params or {})}
    gbt_model = boosted_model(train, B.Boost(rounds=gbt_iter, seed=seed, **params), max_bins)
    scored = {name: materialize(M.score(m, test)) for name, m in fitted.items()}
    if "random_forest" in models:
        scored["random_forest"] = materialize(forest.score(test, ["label"]))
    gbt_scored = scored["gbt"] = materialize(gbt_model.score(test, ["label"]).select("label", "prediction", "p"))
    spark: SparkSession = data.sparkSession
    imp = spark.createDataFrame(
        [(name, int(n), float(g)) for name, (n, g) in gbt_model.importances().items()],
        "feature string, splits int, gain double",
    ).select("feature", "splits", _r(F.col("gain")).alias("gain")).orderBy(F.desc("splits"), "feature").limit(20)
    return {
        "class_balance": data.agg(
            F.count(F.lit(1)).alias("rows"), _r(F.avg("label")).alias("positive_rate"),
            _r(1 - F.avg("label")).alias("always_on_time_accuracy")),
        "classifier_metrics": _union([_metrics_row(n, s) for n, s in scored.items()]),
        "threshold_sweep": E.threshold_sweep(gbt_scored, costs=costs),
        "profit_curve": E.profit_curve(gbt_scored, costs=costs),
        "roc_points": _union([E.roc_points(s).withColumn("model", F.lit(n)) for n, s in scored.items()]),
        "confusion_matrices": _union([E.confusion_counts(s).withColumn("model", F.lit(n))
                                      for n, s in scored.items()]),
        "feature_importance": imp,
    }


# ---------------------------------------------------------------------------
# Diagnostics: tuning, learning and complexity curves (F1)
# ---------------------------------------------------------------------------

def boosted_model(train: DataFrame, setting: B.Boost, max_bins: int = 64, label: str = "label",
                  weight: str | None = "weight") -> B.Booster:
    """One boosted model (numerics + categoricals) on all rows of ``train``."""
    binner = B.fit_bins(train, MODEL_NUMERIC, MODEL_CATEGORICAL, max_bins)
    w = F.col(weight) if weight else F.lit(1.0)
    table = B.binned_table(train, binner, F.col(label), w, _key(train), [F.lit(True)])
    return B.fit_many(table, binner, [setting])[0][0]


def _key(df: DataFrame):
    return F.col("_row_key") if "_row_key" in df.columns else F.xxhash64(*df.columns)


def _boosted_f1(df: DataFrame, settings: list[B.Boost], trained_on: list, masks: list, keep: list[str],
                max_bins: int = 64) -> list[list[tuple[float, int]]]:
    """Train model ``i`` on the rows ``trained_on[i]``, all in the same passes;
    for every list of masks, each model's F1 and number of rows under its mask."""
    binner = B.fit_bins(df, MODEL_NUMERIC, MODEL_CATEGORICAL, max_bins)
    table = B.binned_table(df, binner, F.col("label"), F.col("weight"), _key(df), trained_on, keep)
    scored = B.fit_many(table, binner, settings)[1]
    return [B.f1_by(scored, some) for some in masks]


def gbt_tuning(data: DataFrame, max_rows: int = 250_000, folds: int = 3, max_iter: int = 200,
               grid: dict | None = None, seed: int = 2025) -> DataFrame:
    """Grid search by mean F1 over stratified folds on at most ``max_rows``
    training rows: depth x leaves x minimum rows of a leaf x row and column
    sampling. The models of all settings and folds are trained in the same
    passes over the binned rows."""
    grid = {"max_depth": [5, 8], "num_leaves": [31, 63], "min_rows": [20, 50], "row_rate": [0.8], "col_rate": [0.8], **(grid or {})}
    train = subsample(data.where(~F.col("is_test")), max_rows, seed)
    train = materialize(stratified_folds(train, "label", folds, seed, _key_names(train)))
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    settings = [B.Boost(rounds=max_iter, **point) for point in points for _ in range(folds)]
    fold = [F.col("fold") == f for _ in points for f in range(folds)]
    scores = _boosted_f1(train, settings, [~f for f in fold], [fold], ["fold"])[0]
    rows = [(*point.values(), sum(s for s, _ in scores[i * folds:(i + 1) * folds]) / folds) for i, point in enumerate(points)]
    return data.sparkSession.createDataFrame(
        rows, "max_depth int, num_leaves int, min_rows int, row_rate double, col_rate double, mean_f1 double").select(
        *grid, _r(F.col("mean_f1")).alias("mean_f1"))


def _key_names(df: DataFrame) -> list[str]:
    return ["_row_key"] if "_row_key" in df.columns else df.columns


def learning_curve(data: DataFrame, max_rows: int = 200_000, folds: int = 3, sizes=(0.1, 0.325, 0.55, 0.775, 1.0),
                   max_iter: int = 200, max_depth: int = 8, seed: int = 42) -> DataFrame:
    """Mean train and validation F1 over stratified folds for growing training
    sizes (hash-ordered prefixes of each fold's training part); the models of
    all sizes and folds are trained in the same passes."""
    base = subsample(data.where(~F.col("is_test")), max_rows, seed)
    keys = _key_names(base)
    base = materialize(stratified_folds(base, "label", folds, seed, keys).withColumn("_v", hash_unit(base, keys, seed + 1)))
    points = [(s, f) for s in sizes for f in range(folds)]
    used = [(F.col("fold") != f) & (F.col("_v") < s) for s, f in points]
    held = [F.col("fold") == f for _, f in points]
    settings = [B.Boost(rounds=max_iter, max_depth=max_depth, seed=seed)] * len(points)
    train, val = _boosted_f1(base, settings, used, [used, held], ["fold", "_v"])
    rows = []
    for i, s in enumerate(sizes):
        t, v = train[i * folds:(i + 1) * folds], val[i * folds:(i + 1) * folds]
        rows.append((float(s), sum(n for _, n in t) // folds, sum(f for f, _ in t) / folds, sum(f for f, _ in v) / folds))
    return data.sparkSession.createDataFrame(rows, "train_fraction double, train_rows long, f1_train double, f1_val double")


def complexity_curve(data: DataFrame, depths=(3, 5, 7, 9, 11), max_rows: int = 300_000, max_iter: int = 200,
                     seed: int = 123) -> DataFrame:
    """Train and validation F1 per tree depth on a stratified 80/20 split of at
    most ``max_rows`` training rows; all depths are trained in the same passes."""
    base = subsample(data.where(~F.col("is_test")), max_rows, seed).drop("is_test")
    split = materialize(stratified_split(base, "label", 0.2, seed, key_cols=_key_names(base)))
    held = F.col("is_test")
    settings = [B.Boost(rounds=max_iter, max_depth=d) for d in depths]
    train, val = _boosted_f1(split, settings, [~held] * len(depths), [[~held] * len(depths), [held] * len(depths)], ["is_test"])
    rows = [(int(d), t, v) for d, (t, _), (v, _) in zip(depths, train, val)]
    return data.sparkSession.createDataFrame(rows, "max_depth int, f1_train double, f1_val double")


# ---------------------------------------------------------------------------
# Regression
# ---------------------------------------------------------------------------

def run_regression(data: DataFrame, *, gb_iter: int = 200, boost_iter: int = 300, seed: int = 42,
                   residual_bins: int = 60) -> dict[str, DataFrame]:
    """Mean baseline, linear regression (scaled numerics), boosted trees on
    numerics (depth 5) and leaf-wise ones on numerics + categoricals (depth 7), all scored on
    the test rows; residual histogram, scatter (all test rows) and its axis
    range for the last."""
    reg = data.withColumn("label", F.col("arr_delay"))
    train, test = reg.where(~F.col("is_test")), reg.where(F.col("is_test"))
    lin = M.fit(M.scaled_numeric(MODEL_NUMERIC, "features") + [M.linear_regression()], train)
    gb = M.fit([M.assembler(MODEL_NUMERIC), M.boosted_regressor(gb_iter, 0.05, 5, seed)], train)
    boost = boosted_model(train, B.Boost(rounds=boost_iter, max_depth=7, objective="squared", seed=seed), weight=None)

    def pred(model):
        return model.transform(test).select(F.col("label").alias("y"), F.col("prediction").alias("yhat"))

    boost_pred = materialize(boost.score(test, ["label"]).select(F.col("label").alias("y"), F.col("prediction").alias("yhat")))
    table = _union([
        E.mean_baseline(train.select(F.col("label").alias("y")), test.select(F.col("label").alias("y")))
        .select(F.lit("mean_baseline").alias("model"), "n", "rmse", "mae"),
        E.regression_metrics(pred(lin)).select(F.lit("linear").alias("model"), "n", "rmse", "mae"),
        E.regression_metrics(pred(gb)).select(F.lit("gradient_boosting").alias("model"), "n", "rmse", "mae"),
        E.regression_metrics(boost_pred).select(F.lit("boosted_categorical").alias("model"), "n", "rmse", "mae"),
    ])
    return {
        "regression_models": table,
        "residual_histogram": E.residual_histogram(boost_pred, residual_bins),
        "regression_scatter": boost_pred,
        "regression_axis": boost_pred.agg(F.least(F.min("y"), F.min("yhat")).alias("lo"),
                                          F.greatest(F.max("y"), F.max("yhat")).alias("hi")),
    }


# ---------------------------------------------------------------------------
# Clustering
# ---------------------------------------------------------------------------

def run_clustering(data: DataFrame, *, k: int = 5, restarts: int = 10, elbow_ks=None,
                   elbow_restarts: int = 10) -> dict[str, DataFrame]:
    """Mini-batch k-means on scaled distance/elapsed/departure features (best of
    ``restarts`` starts); cluster sizes, feature means, delay rate and mean
    delay per cluster, by falling delay rate; the scatter holds all rows;
    optional elbow/silhouette table over ``elbow_ks``."""
    feats = [c for c in CLUSTER_FEATURES if c in data.columns]
    spark = data.sparkSession
    if len(feats) < 3:
        return {}
    rows = data.select(*feats, "arr_delay", _key(data).alias("_row_key")).dropna(subset=feats)
    rows = materialize(rows)
    prep = M.fit(M.scaled_numeric(feats, "features"), rows)
    scaled_cols = [f"_x{i}" for i in range(len(feats))]
    vector = vector_to_array("features")
    scaled = materialize(prep.transform(rows).select(*feats, "arr_delay", "_row_key", "features",
                                                     *[vector[i].alias(c) for i, c in enumerate(scaled_cols)]))

    model = minibatch.fit(scaled, scaled_cols, "_row_key", k, seed=42, starts=restarts)
    clustered = model.assign(scaled)
    profile = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        *[_r(F.avg(c)).alias(f"mean_{c}") for c in feats],
        _r(F.avg((F.col("arr_delay") >= DELAY_THRESHOLD).cast("double"))).alias("delay_rate_ge_15min"),
        _r(F.avg("arr_delay")).alias("avg_arr_delay_min"),
    ).orderBy(F.desc("delay_rate_ge_15min"), "cluster")
    out = {
        "cluster_profile": profile,
        "cluster_scatter": clustered.select("distance", "dep_hour", "cluster"),
    }
    if elbow_ks:
        models = minibatch.fit_many(scaled, scaled_cols, "_row_key", list(elbow_ks), seed=42, starts=elbow_restarts)
        pts = [(int(kk), *found) for kk, found in zip(elbow_ks, minibatch.quality(scaled, models))]
        out["kmeans_elbow"] = spark.createDataFrame(pts, "k int, inertia double, silhouette double")
    return out


# ---------------------------------------------------------------------------
# Baseline and route/event classifiers (scaled numerics + one-hot)
# ---------------------------------------------------------------------------

def _logistic_scores(numeric, categorical, train: DataFrame, test: DataFrame, keep: list[str], lr_iter: int):
    # The encoder knows the training rows' categories; the vectors are written once for the iterative fits.
    encoder = fit_one_hot(train, categorical)
    train, test = materialize(encoder.transform(train)), encoder.transform(test)
    penalty = M.l2_for_sklearn_c(train.agg(F.sum("weight")).first()[0])  # C = 1
    model = M.fit(M.linear_features(numeric, categorical) + [M.logistic(lr_iter, penalty)], train)
    return model, M.score(model, test, keep)


def _forest_scores(numeric, categorical, train: DataFrame, test: DataFrame, keep: list[str], seed: int, rf_trees: int,
                   rf_depth: int):
    model = fit_forest(train, numeric, categorical, "label", "_row_key", Forest(trees=rf_trees, max_depth=rf_depth, seed=seed))
    return model, model.score(test, [*keep, "label"])


def train_and_evaluate(rows: DataFrame, numeric, categorical, *, model_type: str = "logreg",
                       test_fraction: float = 0.2, seed: int = 42, lr_iter: int = 200, rf_trees: int = 200,
                       rf_depth: int = 0):
    """Stratified split, balanced weights, fit, and the metric tables on
    the test rows. ``model_type`` is ``logreg`` (class weights of the training
    rows) or ``rf`` (class weights of each tree's bag; ``rf_depth`` 0: trees
    without a depth limit). Returns (model, scored test rows, tables)."""
    data = with_row_key(rows.withColumn("label", F.col("is_delayed").cast("int")))
    split = split_rows(data, test_fraction, seed)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    keep = [c for c in ("origin", "dest", "event_name") if c in test.columns]
    if model_type == "rf":
        model, scored = _forest_scores(numeric, categorical, train, test, keep, seed, rf_trees, rf_depth)
    else:
        model, scored = _logistic_scores(numeric, categorical, train, test, keep, lr_iter)
    scored = materialize(scored)
    tables = {
        "metrics": E.binary_metrics(scored),
        "classification_report": E.classification_report(scored),
    }
    return model, scored, tables


def route_risk(scored: DataFrame, top_n: int = 10, min_flights: int = 50) -> DataFrame:
    """Routes on the scored test rows: flights, delayed, observed rate and
    mean predicted probability; busy routes only, riskiest first."""
    t = scored.withColumn("route", route_key()).where(F.col("route").isNotNull()).groupBy("route").agg(
        F.count(F.lit(1)).alias("flights"), F.sum("label").alias("delayed"), F.avg("p").alias("_p"))
    return (
        t.where(F.col("flights") >= min_flights)
        .select("route", "flights", "delayed", _r(F.col("delayed") / F.col("flights")).alias("delay_rate"),
                _r(F.col("_p")).alias("p_mean"))
        .orderBy(F.desc("p_mean"), "route").limit(top_n)
    )


def event_risk(scored: DataFrame, top_n: int = 20) -> DataFrame:
    t = scored.groupBy("event_name").agg(F.count(F.lit(1)).alias("flights"), F.sum("label").alias("delayed"),
                                         F.avg("p").alias("_p"))
    return t.select("event_name", "flights", "delayed", _r(F.col("delayed") / F.col("flights")).alias("delay_rate"),
                    _r(F.col("_p")).alias("p_mean")).orderBy(F.desc("p_mean"), "event_name").limit(top_n)


def onehot_slots(rows: DataFrame, categorical: list[str], probe: DataFrame) -> DataFrame:
    """Encode ``probe`` with an encoder fitted on ``rows``: the slot of each
    column's value and the number of active slots (none and 0 for an unseen one)."""
    encoder = fit_one_hot(rows, categorical)
    out = encoder.slots(probe)
    known = {c: F.col(f"{c}__idx") < encoder.sizes[c] for c in categorical}
    return out.select(*categorical, *[known[c].cast("int").alias(f"{c}_active") for c in categorical],
                      *[F.when(known[c], F.col(f"{c}__idx").cast("int")).alias(f"{c}_slot") for c in categorical])


__all__ = [
    "classification_data", "run_classification", "run_regression", "run_clustering", "gbt_tuning",
    "learning_curve", "complexity_curve", "baseline_rows", "route_model_rows", "train_and_evaluate",
    "route_risk", "event_risk", "onehot_slots", "modeling_report", "baseline_report", "route_event_report",
]


# ---------------------------------------------------------------------------
# Entry plans
# ---------------------------------------------------------------------------

def modeling_report(flights: DataFrame, *, diagnostics: bool = False, tune: bool = True, costs: dict | None = None,
                    clustering_elbow: bool = False, **sizes) -> dict[str, DataFrame]:
    """Classification, regression and clustering tables from one prepared
    (checkpointed) feature frame. ``tune`` runs the boosted-tree grid search
    first and trains the final boosted classifier with the best setting;
    ``diagnostics`` adds the learning and complexity curves."""
    feats = feature_rows(flights)
    data = split_rows(feats)
    out: dict[str, DataFrame] = {}
    gbt_params = None
    if tune:
        grid = gbt_tuning(data, max_iter=sizes.get("tune_iter", 200))
        best = grid.orderBy(F.desc("mean_f1"), "max_depth", "num_leaves", "min_rows").first()
        gbt_params = {k: best[k] for k in ("max_depth", "num_leaves", "min_rows", "row_rate", "col_rate")}
        out["gbt_tuning"] = grid
    cls = run_classification(data, costs=costs, gbt_params=gbt_params,
                             **{k: v for k, v in sizes.items() if k in ("lr_iter", "rf_trees", "rf_depth", "gbt_iter")})
    out.update(cls)
    # The regression split is not stratified (as in the reference).
    reg = run_regression(split_rows(feats, stratify=False),
                         **{k: v for k, v in sizes.items() if k in ("gb_iter", "boost_iter")})
    out.update(reg)
    clu = run_clustering(data, restarts=sizes.get("restarts", 10),
                         elbow_ks=list(range(2, 11)) if clustering_elbow else None)
    out.update(clu)
    if diagnostics:
        out["learning_curve"] = learning_curve(data, max_iter=sizes.get("curve_iter", 200))
        out["complexity_curve"] = complexity_curve(data, max_iter=sizes.get("curve_iter", 200))
    return out


def baseline_report(flights: DataFrame, model_type: str = "logreg", test_fraction: float = 0.2,
                    seed: int = 42, **kw) -> dict[str, DataFrame]:
    """Simple delay classifier: positive rate, metrics, confusion counts and
    the per-class report on the test rows."""
    rows = baseline_rows(flights)
    _, scored, tables = train_and_evaluate(rows, BASELINE_NUMERIC, BASELINE_CATEGORICAL, model_type=model_type,
                                           test_fraction=test_fraction, seed=seed, **kw)
    return {
        "class_balance": rows.agg(F.count(F.lit(1)).alias("rows"),
                                  _r(F.avg(F.col("is_delayed").cast("double"))).alias("positive_rate")),
        "metrics": tables["metrics"],
        "classification_report": tables["classification_report"],
    }


def route_event_report(flights: DataFrame, schedule: DataFrame | None, model_type: str = "logreg",
                       test_fraction: float = 0.2, seed: int = 42, top_routes: int = 10,
                       min_route_flights: int = 50, **kw) -> dict[str, DataFrame]:
    """Route/event classifier: row count and positive rate, metrics on the test rows, then the route and
    event risk tables from the predicted probabilities."""
    rows = route_model_rows(flights, schedule)
    kw.setdefault("lr_iter", 300)
    _, scored, tables = train_and_evaluate(rows, ROUTE_NUMERIC, ROUTE_CATEGORICAL, model_type=model_type,
                                           test_fraction=test_fraction, seed=seed, **kw)
    return {
        "class_balance": rows.agg(F.count(F.lit(1)).alias("rows"),
                                  _r(F.avg(F.col("is_delayed").cast("double"))).alias("positive_rate")),
        "metrics": tables["metrics"],
        "classification_report": tables["classification_report"],
        "route_risk": route_risk(scored, top_routes, min_route_flights),
        "event_risk": event_risk(scored),
    }
