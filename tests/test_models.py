"""Models: beat the trivial baseline on the planted hour signal; the same
seed gives the same metrics."""

import pytest

from conftest import SF_SMALL
from tarmac.operators.onehot import fit_one_hot
from tarmac.plans import modeling as MP
from tarmac.schema import BASELINE_CATEGORICAL, BASELINE_NUMERIC
from tarmac.sources.testview import flights_view, schedule_view


@pytest.fixture(scope="module")
def data(spark):
    return MP.classification_data(flights_view(spark, SF_SMALL))


def test_classifiers_beat_chance(data):
    out = MP.run_classification(data, lr_iter=50, rf_trees=10, rf_depth=5, gbt_iter=10)
    rows = {r["model"]: r for r in out["classifier_metrics"].collect()}
    assert set(rows) == {"logreg", "random_forest", "gbt"}
    for r in rows.values():
        assert r["auc"] > 0.55
    assert out["profit_curve"].count() == 101
    assert out["feature_importance"].count() > 0


def test_same_seed_same_metrics(spark):
    rows = MP.baseline_rows(flights_view(spark, SF_SMALL))
    a = MP.train_and_evaluate(rows, BASELINE_NUMERIC, BASELINE_CATEGORICAL, lr_iter=50)[2]["metrics"].first()
    b = MP.train_and_evaluate(rows, BASELINE_NUMERIC, BASELINE_CATEGORICAL, lr_iter=50)[2]["metrics"].first()
    assert a == b


def test_route_risk_tables(spark):
    rows = MP.route_model_rows(flights_view(spark, SF_SMALL), schedule_view(spark, SF_SMALL))
    _, scored, _ = MP.train_and_evaluate(rows, ["month", "day_of_week", "dep_hour", "distance", "event_flag"],
                                         ["origin", "dest", "op_unique_carrier", "event_name"], lr_iter=50)
    risk = MP.route_risk(scored, 10, 5).collect()
    assert 0 < len(risk) <= 10
    assert all(r["flights"] >= 5 for r in risk)
    assert [r["p_mean"] for r in risk] == sorted((r["p_mean"] for r in risk), reverse=True)
    assert MP.event_risk(scored).count() >= 1


def test_regression_and_clustering(data):
    reg = MP.run_regression(data, gb_iter=5, boost_iter=5)
    table = {r["model"]: r for r in reg["regression_models"].collect()}
    assert table["linear"]["rmse"] < table["mean_baseline"]["rmse"]
    assert reg["residual_histogram"].count() == 60
    cl = MP.run_clustering(data, restarts=2)
    prof = cl["cluster_profile"].collect()
    assert len(prof) == 5 and sum(r["size"] for r in prof) == data.count()


def test_unseen_category_is_zero_vector(spark):
    train = spark.createDataFrame([("AAA",), ("BBB",)], "origin string")
    probe = spark.createDataFrame([("AAA",), ("ZZZ",), (None,)], "origin string")
    got = {r["origin"]: r["origin_active"] for r in MP.onehot_slots(train, ["origin"], probe).collect()}
    assert got == {"AAA": 1, "ZZZ": 0, None: 0}


@pytest.mark.parametrize("most", [1 << 25, 0])  # broadcast, shuffle join
def test_one_hot_vectors(spark, most):
    rows = [(f"v{i % 90:02d}", None if i % 4 else "x", i) for i in range(900)]
    train = spark.createDataFrame(rows, "a string, b string, i int")
    encoder = fit_one_hot(train, ["a", "b"], most)
    assert encoder.sizes == {"a": 90, "b": 1} and all(small == bool(most) for _, small in encoder.tables.values())
    probe = spark.createDataFrame([("v07", "x", 1), ("v89", None, 2), ("new", "y", 3), (None, None, 4)], "a string, b string, i int")
    got = {r["i"]: (r["a__oh"], r["b__oh"]) for r in encoder.transform(probe).collect()}
    assert {i: (a.size, list(a.indices), list(b.indices)) for i, (a, b) in got.items()} == {
        1: (90, [7], [0]), 2: (90, [89], []), 3: (90, [], []), 4: (90, [], [])}
    none = fit_one_hot(train.limit(0), ["a"])
    assert [list(r["a__oh"].indices) for r in none.transform(probe).collect()] == [[]] * 4


def test_entry_plans_small(spark, tmp_dir):
    from tarmac.sources import write_tables

    flights = flights_view(spark, SF_SMALL)
    out = MP.modeling_report(flights, tune=True, diagnostics=False, tune_iter=3, lr_iter=20, rf_trees=5,
                             gbt_iter=5, gb_iter=3, boost_iter=3, restarts=1)
    assert {"gbt_tuning", "classifier_metrics", "regression_models", "cluster_profile"} <= set(out)
    paths = write_tables({k: out[k] for k in ("classifier_metrics", "regression_models")}, tmp_dir)
    assert spark.read.parquet(paths[0]).count() == 3
    base = MP.baseline_report(flights, lr_iter=20)
    assert base["classification_report"].count() == 5
    route = MP.route_event_report(flights, schedule_view(spark, SF_SMALL), lr_iter=20, min_route_flights=5)
    assert route["route_risk"].count() > 0


def test_regression_models_has_the_full_sizes(monkeypatch):
    import inspect

    from tarmac.plans.catalog_models import model_queries

    real, given = inspect.signature(MP.run_regression), {}
    monkeypatch.setattr(MP, "classification_data", lambda *a, **k: None)
    monkeypatch.setattr("tarmac.plans.catalog_models.flights_view", lambda sp, d: None)
    monkeypatch.setattr(MP, "run_regression", lambda data, **k: given.update(k) or {"regression_models": None})
    model_queries()["regression_models"](None, "")
    sizes = {n: given.get(n, p.default) for n, p in real.parameters.items() if n in ("gb_iter", "boost_iter")}
    assert sizes == {"gb_iter": 200, "boost_iter": 300}  # the reference's
