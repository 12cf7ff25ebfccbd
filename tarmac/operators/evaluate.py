"""Evaluation tables over scored rows.

Input: a DataFrame with an integer ``label`` (0/1), a ``prediction`` (0/1)
and/or a probability ``p``. Every table is an aggregate: one pass that sums
a few indicator columns, then column arithmetic on a handful of rows.
Curves are built from a histogram of scores, never from per-threshold scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.functions import ROUND_DIGITS
from tarmac.operators.cumulative import running_totals
from tarmac.schema import DEFAULT_COSTS


def _r(c: Column) -> Column:
    return F.round(c, ROUND_DIGITS)


def _div0(num: Column, den: Column) -> Column:
    """Division with the zero-division result 0 (as the reference's metrics)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_counts(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, yhat = F.col(label) == 1, F.col(prediction) == 1
    return scored.agg(
        F.count_if(~y & ~yhat).alias("tn"),
        F.count_if(~y & yhat).alias("fp"),
        F.count_if(y & ~yhat).alias("fn"),
        F.count_if(y & yhat).alias("tp"),
    )


def _metric_cols(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    n = tn + fp + fn + tp
    precision = _div0(tp, tp + fp)
    recall = _div0(tp, tp + fn)
    f1 = _div0(2 * tp, 2 * tp + fp + fn)
    return [
        _r(_div0(tp + tn, n)).alias("accuracy"),
        _r(precision).alias("precision"),
        _r(recall).alias("recall"),
        _r(f1).alias("f1"),
    ]


def binary_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; a metric
    whose denominator is 0 is 0."""
    cm = confusion_counts(scored, label, prediction)
    return cm.select("tn", "fp", "fn", "tp", *_metric_cols(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and
    weighted averages: five rows, from the four confusion counts."""
    cm = confusion_counts(scored, label, prediction)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    p0, r0 = _div0(tn, tn + fn), _div0(tn, tn + fp)
    f1_1 = _div0(2 * tp, 2 * tp + fp + fn)
    f1_0 = _div0(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    wide = cm.select(
        p0.alias("p0"), r0.alias("r0"), f1_0.alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1_1.alias("f1"), s1.alias("s1"),
        _div0(tp + tn, n).alias("acc"), n.alias("n"),
    )
    long = wide.selectExpr(
        """stack(5,
            '0', p0, r0, f0, s0,
            '1', p1, r1, f1, s1,
            'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n,
            'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n,
            'weighted avg', try_divide(p0 * s0 + p1 * s1, n), try_divide(r0 * s0 + r1 * s1, n),
                            try_divide(f0 * s0 + f1 * s1, n), n
           ) AS (class, precision, recall, f1, support)"""
    )
    return long.select(
        "class",
        _r(F.col("precision")).alias("precision"),
        _r(F.col("recall")).alias("recall"),
        _r(F.col("f1")).alias("f1"),
        F.col("support").cast("long").alias("support"),
    )


def expected_value(scored: DataFrame, costs: dict | None = None, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """Mean value per flight of the outcomes under the TP/FP/FN/TN costs."""
    c = {**DEFAULT_COSTS, **(costs or {})}
    cm = confusion_counts(scored, label, prediction)
    total = (F.col("tp") * c["tp"] + F.col("fp") * c["fp"] + F.col("fn") * c["fn"] + F.col("tn") * c["tn"])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return cm.select("tn", "fp", "fn", "tp", _r(total).alias("total_value"),
                     _r(_div0(total, n)).alias("expected_value"))


# ---------------------------------------------------------------------------
# Threshold curves from a score histogram
# ---------------------------------------------------------------------------

def threshold_bucket(p: Column, steps: int = 100) -> Column:
    """Index of the largest threshold ``i / steps`` (0..steps) with
    ``p >= i / steps``; -1 below every threshold. The first guess
    ``floor(p * steps)`` is corrected by comparing with the exact threshold
    so that floating error in ``p * steps`` cannot move a row across one."""
    k = F.floor(p * steps).cast("int")
    k = F.when((k + 1) / F.lit(float(steps)) <= p, k + 1).when(k / F.lit(float(steps)) > p, k - 1).otherwise(k)
    return F.greatest(F.least(k, F.lit(steps)), F.lit(-1))


def profit_curve(scored: DataFrame, costs: dict | None = None, steps: int = 100, label: str = "label",
                 p: str = "p") -> DataFrame:
    """Confusion counts and expected value per flight at thresholds
    0, 1/steps, ..., 1 (predict positive when ``p >= threshold``).

    One pass builds a histogram of at most (steps + 2) x 2 cells; the counts at
    threshold i are suffix sums of that histogram, taken by a window over the
    ``steps + 1`` threshold rows (a table of fixed size)."""
    c = {**DEFAULT_COSTS, **(costs or {})}
    spark: SparkSession = scored.sparkSession
    hist = scored.groupBy(threshold_bucket(F.col(p), steps).alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    grid = spark.range(0, steps + 1).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("long").alias("pos"),
                                            F.lit(0).cast("long").alias("neg"))
    # Rows below threshold 0 (k = -1) only count toward the totals.
    cells = grid.unionByName(hist).groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    from_top = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    curve = cells.select(
        "k",
        F.sum("pos").over(from_top).alias("tp"),
        F.sum("neg").over(from_top).alias("fp"),
        F.sum("pos").over(everything).alias("_P"),
        F.sum("neg").over(everything).alias("_N"),
    ).where(F.col("k") >= 0)
    fn = F.col("_P") - F.col("tp")
    tn = F.col("_N") - F.col("fp")
    total = F.col("tp") * c["tp"] + F.col("fp") * c["fp"] + fn * c["fn"] + tn * c["tn"]
    return curve.select(
        F.round(F.col("k") / F.lit(float(steps)), 6).alias("threshold"),
        F.col("tp").cast("long").alias("tp"),
        F.col("fp").cast("long").alias("fp"),
        fn.cast("long").alias("fn"),
        tn.cast("long").alias("tn"),
        _r(total).alias("total_value"),
        _r(_div0(total, F.col("_P") + F.col("_N"))).alias("expected_value"),
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """The first (lowest) threshold with the highest expected value."""
    return curve.orderBy(F.desc("total_value"), F.asc("threshold")).limit(1)


def threshold_sweep(scored: DataFrame, thresholds=(0.3, 0.5, 0.7), costs: dict | None = None,
                    label: str = "label", p: str = "p") -> DataFrame:
    """Metrics and expected value at a few thresholds from one pass: four
    conditional counts per threshold in a single aggregate, then ``stack``."""
    c = {**DEFAULT_COSTS, **(costs or {})}
    y = F.col(label) == 1
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col(p) >= F.lit(float(t))
        aggs += [F.count_if(~y & ~hit).alias(f"tn{i}"), F.count_if(~y & hit).alias(f"fp{i}"),
                 F.count_if(y & ~hit).alias(f"fn{i}"), F.count_if(y & hit).alias(f"tp{i}")]
    wide = scored.agg(*aggs)
    body = ", ".join(f"CAST({float(t)} AS DOUBLE), tn{i}, fp{i}, fn{i}, tp{i}" for i, t in enumerate(thresholds))
    long = wide.selectExpr(f"stack({len(thresholds)}, {body}) AS (threshold, tn, fp, fn, tp)")
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    total = tp * c["tp"] + fp * c["fp"] + fn * c["fn"] + tn * c["tn"]
    return long.select("threshold", "tn", "fp", "fn", "tp", *_metric_cols(tn, fp, fn, tp),
                       _r(_div0(total, tn + fp + fn + tp)).alias("expected_value"))


# ---------------------------------------------------------------------------
# ROC
# ---------------------------------------------------------------------------

def score_histogram(scored: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Positives and negatives per distinct score (map-side combined)."""
    return scored.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def roc_points(scored: DataFrame, label: str = "label", p: str = "p", **kw) -> DataFrame:
    """One ROC point per distinct score s (predict positive when p >= s):
    true/false positives, their rates; and the starting point (0, 0), above
    every score, with a NULL threshold. Cumulative counts come from the
    bucketed running totals, so no task ever holds all distinct scores."""
    hist = score_histogram(scored, label, p)
    cum = running_totals(hist, "score", ["pos", "neg"], **kw)
    # P and N are two numbers from a one-row aggregate of the (checkpointed)
    # histogram; they enter the plan as literals.
    pn = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    big_p, big_n = int(pn["P"] or 0), int(pn["N"] or 0)
    tp = F.lit(big_p) - F.col("cum_pos") + F.col("pos")
    fp = F.lit(big_n) - F.col("cum_neg") + F.col("neg")
    start = cum.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return start.unionByName(cum.select(
        F.col("score").alias("threshold"),
        tp.cast("long").alias("tp"),
        fp.cast("long").alias("fp"),
        _r(_div0(tp, F.lit(big_p))).alias("tpr"),
        _r(_div0(fp, F.lit(big_n))).alias("fpr"),
    ))


def roc_auc(scored: DataFrame, label: str = "label", p: str = "p", **kw) -> DataFrame:
    """Area under the ROC curve in rank form (ties count one half):
    sum over scores of pos(s) * (negatives below s + neg(s) / 2) / (P * N)."""
    hist = score_histogram(scored, label, p)
    cum = running_totals(hist, "score", ["pos", "neg"], **kw)
    term = F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") / 2.0)
    agg = cum.agg(F.sum(term).alias("_num"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return agg.select(
        F.round(F.try_divide(F.col("_num"), F.col("positives").cast("double") * F.col("negatives")), 10).alias("auc"),
        F.col("positives").cast("long").alias("positives"),
        F.col("negatives").cast("long").alias("negatives"),
    )


# ---------------------------------------------------------------------------
# Regression
# ---------------------------------------------------------------------------

def regression_metrics(pred: DataFrame, label: str = "y", prediction: str = "yhat") -> DataFrame:
    err = F.col(label) - F.col(prediction)
    return pred.agg(
        F.count(F.lit(1)).alias("n"),
        _r(F.sqrt(F.avg(err * err))).alias("rmse"),
        _r(F.avg(F.abs(err))).alias("mae"),
    )


def mean_baseline(train: DataFrame, test: DataFrame, label: str = "y") -> DataFrame:
    """Predict the training mean for every test row; RMSE and MAE. The mean
    is one number, carried as a literal."""
    mean = train.agg(F.avg(label).alias("m")).first()["m"]
    pred = test.select(F.col(label).alias("y"), F.lit(float(mean) if mean is not None else 0.0).alias("yhat"))
    return regression_metrics(pred).withColumn("train_mean", _r(F.lit(mean if mean is not None else 0.0)))


def residual_histogram(pred: DataFrame, bins: int = 60, label: str = "y", prediction: str = "yhat") -> DataFrame:
    """Counts of ``label - prediction`` in ``bins`` equal-width bins from min
    to max, last bin closed on the right; empty bins are listed with 0."""
    spark: SparkSession = pred.sparkSession
    res = pred.select((F.col(label) - F.col(prediction)).alias("r")).where(F.col("r").isNotNull())
    stats = res.agg(F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    if stats["lo"] is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    lo, hi = float(stats["lo"]), float(stats["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    idx = F.least(F.floor((F.col("r") - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int") + 1, F.lit(bins))
    counts = res.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("count"))
    allbins = grid.unionByName(counts).groupBy("bin").agg(F.sum("count").cast("long").alias("count"))
    return allbins.select(
        "bin",
        _r(F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"),
        _r(F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_end"),
        "count",
    )
