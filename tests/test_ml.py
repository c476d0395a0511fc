"""The pyspark.ml stages, alone and in a Pipeline."""

import math
from collections import Counter

import pytest
from pyspark.ml import Pipeline

from ledgerloom.operators import ml


def test_stages_in_a_pipeline(spark, tmp_path):
    train = spark.createDataFrame([(1, "a", 1.0, "Alpha Turbo GUZZLER 27 MPG"), (2, "b", None, "Beta alpha EcoBoost"), (3, "a", 3.0, None)], "id int, c string, v double, text string")
    stages = [ml.LeakSanitizer(inputCol="text", outputCol="clean"), ml.FeatureEncoder(numeric=["v"], categorical=["c"], outputCol="x"), ml.SafeTfidf(inputCol="clean", outputCol="w")]
    fitted = Pipeline(stages=stages).fit(train)
    got = {r.id: r for r in fitted.transform(train).collect()}
    assert got[1].clean == "Alpha Turbo" and got[3].clean == "" and len(got[1].x) == 4
    terms = [t for t, _ in fitted.stages[2].terms]
    assert terms == sorted(terms) == ["alpha", "alpha ecoboost", "alpha turbo", "beta", "beta alpha", "ecoboost", "turbo"]
    df = Counter({"alpha": 2, "turbo": 1, "alpha turbo": 1})
    raw = [(math.log(4 / (1 + df[t])) + 1) if t in ("alpha", "turbo", "alpha turbo") else 0.0 for t in terms]
    norm = math.sqrt(sum(v * v for v in raw))
    assert got[1].w == pytest.approx([v / norm for v in raw]) and got[3].w == [0.0] * 7
    new = fitted.transform(spark.createDataFrame([(9, "z", 2.0, "validationonly 88 MPG beta")], train.schema)).first()
    assert sum(new.w) == pytest.approx(1.0) and new.w[terms.index("beta")] == pytest.approx(1.0)
    stages[0].write().overwrite().save(f"{tmp_path}/s")
    assert ml.LeakSanitizer.load(f"{tmp_path}/s").getOutputCol() == "clean"


def test_an_empty_vocabulary_gives_one_zero_column(spark):
    df = spark.createDataFrame([(None,), ("GUZZLER 27 MPG",)], "text string")
    model = ml.SafeTfidf(inputCol="text", outputCol="w").fit(df)
    assert model.empty_vocabulary and [r.w for r in model.transform(df.union(spark.createDataFrame([("new engine",)], "text string"))).collect()] == [[0.0]] * 3
    with pytest.raises(ValueError):
        ml.SafeTfidf(inputCol="text", maxFeatures=0).fit(df)
