"""The commands from a dataset to evaluated runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.__main__ import main
from ledgerloom.plans import runs


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    r, rows = random.Random(3), []
    for i in range(260):
        size, cyl = r.choice([1.4, 2.0, 3.0, None]), r.choice([4, 6, 8])
        make, base = r.choice(["ford", "vw", "kia"]), f"m{r.randint(0, 24)}"
        text = r.choice(["turbo", "plain", "sport"])
        rows.append((f"{i:04d}", 2015 + i % 6, size, float(cyl), make, "auto", r.choice(["fwd", "awd", None]), r.choice(["Compact Cars", "SUV"]), f"{base} {text}", f"{text} v{cyl}" if r.random() < .8 else None, f"{make}::{base}",
                     4.0 + (size or 2.2) + 0.4 * cyl + (1.0 if text == "turbo" else 0.0) + r.gauss(0, 0.2)))
    folder = tmp_path_factory.mktemp("runs")
    spark.createDataFrame(rows, "vehicle_id string, model_year int, displacement_l double, cylinders double, manufacturer string, transmission string, drivetrain string, vehicle_class string, model_name string, engine_description string, model_group string, target_l100km double").repartition(3).write.parquet(f"{folder}/vehicles.parquet")
    assert main(["split", f"{folder}/vehicles.parquet", f"{folder}/split"]) == 0
    return folder


def test_train_final_and_evaluate(spark, dataset):
    data, manifest = f"{dataset}/vehicles.parquet", f"{dataset}/split/split_manifest.parquet"
    assert main(["train", data, manifest, f"{dataset}/mid"]) == 0 and main(["final", data, manifest, f"{dataset}/fin"]) == 0
    held = {r.vehicle_id: (r.split, r.cv_fold) for r in spark.read.parquet(manifest).collect()}
    for run, names in (("mid", runs.MIDTERM), ("fin", list(runs.serve.ARMS))):
        meta = json.loads((dataset / run / "run_metadata.json").read_text())
        choice = json.loads((dataset / run / "cv_selection.json").read_text())
        p = spark.read.parquet(f"{dataset}/{run}/predictions.parquet").collect()
        assert meta["selected_model"] == choice["selected_model"] in names and meta["n_train"] + meta["n_test"] == 260
        for m in names:
            mine = {r.vehicle_id: (r.split, r.fold) for r in p if r.model == m}
            assert mine == {i: ("test", None) if s == "test" else ("train_oof", f) for i, (s, f) in held.items()}
        mae = {m: sum(r.abs_error for r in p if r.model == m and r.split == "test") for m in names}
        if run == "mid":
            assert mae["linear"] < 0.8 * mae["dummy"] and meta["selected_model"] != "dummy" and set(meta["bundles"]) == {"dummy", "linear", "tree"}
        else:
            assert mae["structured_model_engine"] < mae["structured"] and meta["selected_model"] != "structured"
            deltas = {r.model: r for r in spark.read.parquet(f"{dataset}/fin/paired_comparison.parquet").collect()}
            assert deltas["structured_engine"].mean_delta == pytest.approx((mae["structured_engine"] - mae["structured"]) / meta["n_test"])
        errors = spark.read.parquet(f"{dataset}/{run}/subgroup_errors.parquet")
        assert errors.agg(F.sum("n")).first()[0] == len(p)
    assert main(["evaluate", f"{dataset}/mid"]) == 0 and runs.evaluate_run(spark, f"{dataset}/mid", data) == 260 * 4


def test_runs_refuse_what_is_not_theirs(spark, dataset, tmp_path):
    data, manifest = f"{dataset}/vehicles.parquet", f"{dataset}/split/split_manifest.parquet"
    (tmp_path / "taken").mkdir()
    with pytest.raises(ValueError):
        runs.train(spark, data, manifest, f"{tmp_path}/taken")
    spark.read.parquet(data).withColumn("target_l100km", F.lit(-1.0)).write.parquet(f"{tmp_path}/bad.parquet")
    with pytest.raises(Exception):
        runs.train(spark, f"{tmp_path}/bad.parquet", manifest, f"{tmp_path}/run")
    with pytest.raises(ValueError):
        runs.evaluate_run(spark, f"{dataset}/mid", f"{tmp_path}/bad.parquet")
    assert main(["nothing"]) == 2
