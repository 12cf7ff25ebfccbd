"""Check figures of FIXTURES.md B4/B5 (sf0.01), computed by the Spark plans."""

from pyspark.sql import functions as F

from conftest import SF_MID
from tarmac.operators import evaluate as E
from tarmac.operators import reports as R
from tarmac.plans.catalog import load_clean, load_enriched, load_event_dim
from tarmac.sources.testview import flights_view, schedule_view, scored_view


def test_counts(spark):
    ov = R.overview(flights_view(spark, SF_MID)).first()
    assert (ov["total_rows"], ov["processed_rows"], ov["delayed_rows"]) == (60000, 57065, 15892)
    assert ov["max_arr_delay"] == 91


def test_reasons(spark):
    got = {r["reason"]: r["delayed"] for r in R.reason_summary(load_clean(spark, SF_MID)).collect()}
    assert got == {"carrier_delay": 4552, "weather_delay": 2268, "nas_delay": 2253, "security_delay": 2219,
                   "late_aircraft_delay": 2270, "unknown": 2330}


def test_planted_null_cases(spark):
    clean = load_clean(spark, SF_MID)
    hours = {r["dep_hour"]: r for r in R.hour_rate(clean).collect()}
    assert hours[24]["flights"] == 608 and hours[24]["delayed"] == 0 and hours[24]["delay_rate_pct"] is None
    pbi = R.airport_delay(clean, "origin").where("origin = 'PBI'").first()
    assert (pbi["flights"], pbi["delayed"]) == (1098, 0)
    assert R.route_delay(clean).count() == 625
    weather_punctual = clean.where(~F.col("is_delayed") & (F.col("weather_delay") > 0)).count()
    assert weather_punctual == 1030


def test_events(spark):
    assert schedule_view(spark, SF_MID).count() == 15000
    assert load_event_dim(spark, SF_MID).count() == 12956
    enriched = load_enriched(spark, SF_MID)
    assert enriched.where("event_name <> 'none'").count() == 20866


def test_scored_figures(spark):
    scored = scored_view(load_clean(spark, SF_MID))
    cm = E.confusion_counts(scored).first()
    assert (cm["tn"], cm["fp"], cm["fn"], cm["tp"]) == (26040, 15133, 4617, 11275)
    auc = E.roc_auc(scored).first()["auc"]
    assert abs(auc - 0.7583922713) < 1e-9
    best = E.best_threshold(E.profit_curve(scored)).first()
    assert best["threshold"] == 0.17 and best["total_value"] == 1243890


def test_auc_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    scored = scored_view(load_clean(spark, SF_MID))
    ours = E.roc_auc(scored).first()["auc"]
    raw = scored.select(F.col("label").cast("double").alias("label"),
                        array_to_vector(F.array(1 - F.col("p"), F.col("p"))).alias("rawPrediction"))
    theirs = BinaryClassificationEvaluator(numBins=0).evaluate(raw)
    assert abs(ours - theirs) < 1e-9


def test_profit_curve_matches_sweep(spark):
    scored = scored_view(load_clean(spark, SF_MID))
    curve = {r["threshold"]: r for r in E.profit_curve(scored).where("threshold IN (0.3, 0.5, 0.7)").collect()}
    sweep = {r["threshold"]: r for r in E.threshold_sweep(scored).collect()}
    for t in (0.3, 0.5, 0.7):
        assert (curve[t]["tp"], curve[t]["fp"]) == (sweep[t]["tp"], sweep[t]["fp"])
        assert curve[t]["expected_value"] == sweep[t]["expected_value"]
