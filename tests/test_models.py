"""Properties that fitted models have, whatever fitted them."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from outrider.contract import Contract
from outrider.operators import models
from outrider.plans import catalog

FOLDER = "/root/testdata/sf0.001"
CONTRACT = Contract(["id"], ["x", "z", "kind"], ["x", "z"], ["kind"], "label")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x, z, kind = rng.normal(size=3000), rng.normal(size=3000) * 40 + 7, rng.integers(0, 3, 3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-(x * x - 1 + 0.5 * (kind == 1) + z / 80)))
    data = [(i, None if i % 50 == 0 else float(x[i]), float(z[i]), None if i % 41 == 0 else "abc"[kind[i]], int(y[i])) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, x double, z double, kind string, label int").repartition(4).persist()
    yield df
    df.unpersist()


def arrays(model, rows):
    """Features, labels and probabilities of all rows."""
    out = model.pipeline.transform(model.preparation.apply(rows)).select(vector_to_array("_features").alias("f"), "label", vector_to_array("probability")[1].alias("p"), "id").orderBy("id").collect()
    return np.array([r.f for r in out]), np.array([r.label for r in out], float), np.array([r.p for r in out])


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_has_no_slope_left(rows, balanced):
    """The penalised loss is flat at the coefficients; the intercept has no penalty."""
    held = models.balanced_weights(rows) if balanced else rows
    n = rows.count()
    model = models.Model.fit(held, CONTRACT, models.logistic(n, weight="_weight" if balanced else None))
    f, y, p = arrays(model, rows)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum()))) if balanced else np.ones(n)
    fitted = model.pipeline.stages[-1]
    slope = (w * (p - y)) @ f / w.sum() + fitted.coefficients.toArray() / n
    assert np.abs(slope).max() < 1e-4 and abs((w * (p - y)).sum() / w.sum()) < 1e-4


def test_tree_leaves_hold_their_rates(rows):
    model = models.Model.fit(rows, CONTRACT, models.tree())
    fitted = model.pipeline.stages[-1]
    assert fitted.depth <= 6 and fitted.numNodes > 1
    f, y, p = arrays(model, rows)
    leaf = np.array([fitted.predictLeaf(_vector(v)) for v in f])
    for k in np.unique(leaf):
        assert (leaf == k).sum() >= 200 and np.allclose(p[leaf == k], y[leaf == k].mean())


def test_forest_is_the_mean_of_its_trees(rows):
    model = models.Model.fit(rows, CONTRACT, models.forest(trees=7))
    fitted = model.pipeline.stages[-1]
    assert len(fitted.trees) == 7 and all(t.depth <= 30 for t in fitted.trees)
    f, _, p = arrays(model, rows)
    some = range(0, 3000, 101)
    for i in some:
        assert math.isclose(p[i], np.mean([t.predictProbability(_vector(f[i]))[1] for t in fitted.trees]), abs_tol=1e-9)


def test_boosting_adds_its_trees(rows):
    """The probability is that of twice the sum of the trees, and rounds lower the loss of the rows they were fitted on."""
    losses = []
    for rounds in (2, 12):
        model = models.Model.fit(rows, CONTRACT, models.boosting(rounds=rounds))
        fitted = model.pipeline.stages[-1]
        f, y, p = arrays(model, rows)
        assert len(fitted.trees) == rounds and fitted.treeWeights[1:] == [0.05] * (rounds - 1)
        for i in range(0, 3000, 301):
            margin = sum(w * t.predict(_vector(f[i])) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True))
            assert math.isclose(p[i], 1 / (1 + math.exp(-2 * margin)), abs_tol=1e-9)
        losses.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert losses[1] < losses[0]


def test_isotonic_steps_are_rates(spark):
    """The curve rises, and each step's value is its rows' rate."""
    rng = np.random.default_rng(8)
    data = [(float(q), int(rng.random() < q * q)) for q in rng.integers(0, 400, 2500) / 400]
    df = spark.createDataFrame(data, "p_raw double, label int")
    out = models.isotonic(df)(df).select("p_raw", "p_iso", "label").toPandas().sort_values("p_raw")
    assert (out.p_iso.diff().dropna() >= -1e-12).all()
    steps = out.assign(step=out.p_iso.round(9)).groupby("step").agg(rate=("label", "mean"), value=("p_iso", "mean"))
    assert len(steps) > 5 and np.allclose(steps.rate, steps.value)


def test_platt_keeps_the_rate(rows):
    model = models.Model.fit(rows, CONTRACT, models.logistic(rows.count()))
    scored = model.score(rows)
    curve = models.Platt.fit(scored)
    got = scored.agg(F.avg(curve.apply(F.col("p_raw"))).alias("p"), F.avg("label").alias("y")).first()
    assert abs(got.p - got.y) < 1e-4


def used_session(spark, by):
    """A session that can't be sent to tasks any more."""
    other = spark.newSession()
    if by == "tag":
        other.addTag("used")
    else:
        seen = Observation()
        other.range(3).observe(seen, F.count("*").alias("n")).collect()
        assert seen.get["n"] == 3
    return other


@pytest.mark.parametrize("by", ["observation", "tag"])
@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_models_score_in_a_used_session(spark, kind, by):
    """Tasks get the fitted model without the session, and the scores are those of an unused one."""
    scores = []
    for session in (used_session(spark, by), spark.newSession()):
        df = session.range(400).selectExpr("id", "sin(id) AS x", "id % 7D AS z", "substring('abc', 1 + id % 3, 1) AS kind", "int(id % 5 < 2) AS label")
        model = models.Model.fit(df, CONTRACT, models.logistic(400) if kind == "logistic" else models.forest(trees=3, leaf=5))
        scores.append([r.p_raw for r in model.score(df).orderBy("id").collect()])
    assert len(set(scores[0])) > 5 and np.allclose(scores[0], scores[1], rtol=0, atol=1e-9)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name, rows", [("ML_08_logistic_scores", 1500)])
def test_query_runs_in_a_used_session(spark, name, rows):
    out = catalog.QUERIES[name](used_session(spark, "observation"), FOLDER).collect()
    assert len(out) == len({r.encounter_id for r in out}) == rows and all(0 < r.p_raw < 1 for r in out)


def test_cross_fitting_in_a_used_session(spark):
    """Models of folds, the curve over their scores and the last model all work, with the values of an unused session."""
    got = []
    for session in (used_session(spark, "observation"), spark.newSession()):
        df = session.range(400).selectExpr("id", "sin(id) AS x", "id % 7D AS z", "substring('abc', 1 + id % 3, 1) AS kind", "int(id % 5 < 2) AS label", "int(id % 2) AS fold")
        model, curve = models.cross_fitted(df, CONTRACT, lambda seen: models.logistic(200), 2)
        out = model.score(df).select("id", "p_raw", curve.apply(F.col("p_raw")).alias("p_hat")).orderBy("id").collect()
        got.append([(r.p_raw, r.p_hat) for r in out])
    assert len(got[0]) == 400 and np.allclose(got[0], got[1], rtol=0, atol=1e-9)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
def test_fits_do_not_plan_the_split_again(spark):
    rows, _ = catalog._readmission_model(spark, FOLDER)
    assert "Join" not in rows._jdf.queryExecution().analyzed().toString() and rows.count() == 1500
    rows.unpersist()


def _vector(values):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense(values)
