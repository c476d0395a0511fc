"""Bundles, arms, scaling, stage comparison, reviews."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import features, models, serve


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, 1.0 + i % 4, "ab"[i % 2], 5 + 1.5 * (i % 4) + i % 2, "GUZZLER v8", None) for i in range(24)], "id int, x double, c string, y double, model_name string, engine_description string")


def test_bundle_round_trip(spark, rows, tmp_path):
    p = features.Preprocessor(["x"], ["c"]).fit(rows)
    m = models.Linear().fit(p.vector(rows, ["id", "y"]))
    serve.save_bundle(tmp_path, m, p, {"dataset": "d1"})
    bundle = serve.load_bundle(tmp_path, {"dataset": "d1"})
    some = rows.withColumn("error", F.when(F.col("id") == 3, "bad"))
    got = {r.id: r for r in serve.score(bundle, some, ["id"]).collect()}
    assert got[3].y_pred is None and got[3].error == "bad" and got[5].y_pred == pytest.approx(7.5) and got[5].error is None
    with pytest.raises(ValueError):
        serve.load_bundle(tmp_path, {"dataset": "d2"})
    (tmp_path / "model.json").write_text("{}")
    with pytest.raises(ValueError):
        serve.load_bundle(tmp_path)
    with pytest.raises(ValueError):
        serve.save_bundle(tmp_path, m, p, {})
    median = models.Median().fit(rows)
    serve.save_bundle(tmp_path / "m", median, p, {})
    assert serve.load_bundle(tmp_path / "m")[0].value == median.value


def test_arms_and_scaling(rows):
    out = serve.select_arm(rows, "structured_model", ["x", "c"], ["id"])
    assert out.columns == ["id", "x", "c", "model_name"] and out.first().model_name == "v8"
    assert serve.select_arm(rows, "structured_engine", ["x"]).first().engine_description == ""
    with pytest.raises(ValueError):
        serve.select_arm(rows, "all", ["x"])
    s = serve.TargetScaler().fit(rows, "y")
    z = s.transform(rows, "y")
    assert z.agg(F.stddev_pop("y")).first()[0] == pytest.approx(1)
    assert s.inverse(z, "y").agg(F.sum("y")).first()[0] == pytest.approx(rows.agg(F.sum("y")).first()[0])


def test_stage_and_review_checks(spark, rows):
    a = rows.select("id").limit(1)
    assert serve.compare_stages([("one", {"h": 1}, a), ("two", {"h": 1}, a)]).count() == 2
    with pytest.raises(ValueError):
        serve.compare_stages([("one", {"h": 1}, a), ("two", {"h": 2}, a)])
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    d = spark.createDataFrame([("a", "accept", ""), ("b", "pending", None), ("z", "maybe", "x"), ("z", "reject", "x")], "k string, decision string, reason string")
    assert {r.check: r.n for r in serve.check_reviews(c, d, "k", True).collect()} == {"undecided": 1, "unknown_candidate": 2, "repeated": 1, "unknown_decision": 1, "unjustified": 1, "pending": 1}
    m = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    assert serve.check_segments(m, m, "id").count() == 0 and serve.check_segments(m.where("id = 1"), m, "id").count() == 1


@pytest.mark.parametrize("kind", ["tree", "random_forest", "extra_trees", "mlp"])
def test_numpy_models_are_served_as_fitted(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 20 + 3 * x[:, 0] + np.sign(x[:, 1])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    p = features.Preprocessor(["a", "b"], []).fit(df)
    z = np.array([r.x for r in p.vector(df, ["id"]).orderBy("id").collect()])
    m = models.FITS[kind](z, y, 3)
    serve.save_bundle(tmp_path, m, p, {"dataset": "d"})
    bundle = serve.load_bundle(tmp_path, {"dataset": "d"})
    got = [r.y_pred for r in serve.score(bundle, df, ["id"]).orderBy("id").collect()]
    assert np.allclose(got, m(z)) and np.abs(np.array(got) - y).mean() < 2
    (tmp_path / "model.json").write_text((tmp_path / "model.json").read_text().replace("0", "1", 1))
    with pytest.raises(ValueError):
        serve.load_bundle(tmp_path)
