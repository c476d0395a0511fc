"""Cleaning rules, funnel, duplicates and serving checks on written records."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import vehicles as V

CLEAN = dict(id="1", year="2019", make="Acme", model="Roadster", baseModel="Roadster", displ="2.0", cylinders="4", trany="Auto", drive="FWD", VClass="Compact Cars", eng_dscr="", engId="7", atvType="",
             fuelType1="Regular Gasoline", fuelType2="", evMotor="", phevBlended="false", comb08="30", comb08U="0", startStop="Y")
GONE = object()


def raw(**changes):
    return json.dumps({k: v for k, v in {**CLEAN, **changes}.items() if v is not GONE})


CASES = {
    "clean": (raw(), []),
    "hybrid": (raw(atvType="Hybrid"), ["alternative_technology_present"]),
    "alias only": (raw(baseModel=GONE, basemodel="R"), []),
    "alias conflict": (raw(basemodel="X"), ["conflicting_alias:baseModel"]),
    "negative displacement": (raw(displ="-1"), ["nonpositive_engine_spec:displacement_l"]),
    "zero cylinders": (raw(cylinders="0"), ["nonpositive_engine_spec:cylinders"]),
    "bad displacement": (raw(displ="oops"), ["invalid_numeric:displ"]),
    "fractional cylinders": (raw(cylinders="3.5"), ["invalid_numeric:cylinders"]),
    "one spec blank": (raw(displ=""), []),
    "no specs": (raw(displ="", cylinders=None), ["insufficient_engine_specs"]),
    "name with hev inside": (raw(model="HEVenture"), []),
    "hev in the engine text": (raw(eng_dscr="x HEV y"), ["hybrid_text_signal"]),
    "not text": (raw(trany=5), ["invalid_type:trany"]),
    "bad id": (raw(id="01"), ["invalid_vehicle_id"]),
    "integer id": (raw(id=12), []),
    "no make, wrong year": (raw(make=" ", year="2014"), ["missing_required:manufacturer", "model_year_out_of_scope"]),
    "second fuel and motor": (raw(fuelType2="E85", evMotor="50 kW"), ["secondary_fuel_present", "electric_motor_present"]),
    "plug-in": (raw(phevBlended="Yes"), ["phev_blended"]),
    "unknown boolean": (raw(phevBlended="maybe"), ["unknown_phev_boolean"]),
    "volvo badge": (raw(make=" volvo ", model="XC60 B5 AWD", year=2023), ["reviewed_powertrain_hybrid:volvo_b_badge_mild_hybrid"]),
    "volvo other badge": (raw(make="Volvo", model="XC60 B50 T5", year=2023), []),
    "volvo early": (raw(make="Volvo", model="XC60 B5", year=2021), []),
    "audi without displacement": (raw(make="Audi", model="A4 quattro", year="2021", displ=""), ["reviewed_powertrain_uncertain:audi_2021_2022_a4_a5_q5_2l_mild_hybrid:missing_engine_condition"]),
    "audi eight": (raw(make="Audi", model="SQ8", year="2024", displ="4.0", cylinders="8"), ["reviewed_powertrain_uncertain:audi_sq7_sq8_4l_technology_uncertain"]),
    "van": (raw(VClass="Vans"), ["vehicle_class_out_of_scope"]),
    "list": ("[1]", ["invalid_record_object"]),
    "broken": ("{", ["invalid_record_object"]),
    **{f"comb08 {v!r}": (raw(comb08=v), ([] if v in (None, "", "0", "-1", "1e-310") else ["invalid_numeric:comb08"]) + ["invalid_target"]) for v in (None, "", "NaN", "inf", "-inf", "0", "-1", "1e-310", {}, True)},
    **{f"{k} gone": (raw(**{k: GONE}), [f"missing_powertrain_metadata:{k}"] + (["primary_fuel_out_of_scope"] if k == "fuelType1" else [])) for k in ("fuelType1", "fuelType2", "evMotor", "phevBlended", "atvType")},
    **{f"{k} null": (raw(**{k: None}), [f"null_powertrain_metadata:{k}"] + (["primary_fuel_out_of_scope"] if k == "fuelType1" else [])) for k in ("fuelType1", "fuelType2", "evMotor", "phevBlended", "atvType")},
}


def test_reasons(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "name string, raw string")
    got = {r.name: r for r in V.normalise(df).collect()}
    assert {k: r.reasons for k, r in got.items()} == {k: v[1] for k, v in CASES.items()}
    assert got["clean"].target_l100km == pytest.approx(7.84048611111111, abs=1e-12)
    assert got["comb08 '1e-310'"].target_l100km is None
    assert "compatibility_alias:basemodel->baseModel" in got["alias only"].audit_flags
    assert "missing_optional:displacement_l" in got["one spec blank"].audit_flags and "missing_optional:displacement_l" not in got["bad displacement"].audit_flags


def test_duplicates_and_funnel(spark):
    mail = lambda i: {"emissionsInfo": [{"id": i, "a": 2}]}
    rows = [raw(id="10", model="Dup"), raw(id="9", model="Dup", createdOn="x"), raw(id="12", model="Dup2"), raw(id="13", model="Dup2", startStop="N", comb08="31"),
            raw(id="14", model="E", emissionsList=mail("1")), raw(id="15", model="E", emissionsList=mail("2")), raw(id="16", model="O", emissionsList={"emissionsInfo": {"id": "1", "a": 1}}),
            raw(id="17", model="O", emissionsList={"emissionsInfo": {"id": "3", "a": 1}}), raw(id="18", VClass="Vans", year="2009")]
    out = V.build(V.normalise(spark.createDataFrame([(r,) for r in rows], "raw string")))
    assert sorted(r.vehicle_id for r in out["vehicles"].collect()) == sorted(["9", "12", "13", "14", "16"])
    flags = {r.vehicle_id: r.audit_flags for r in out["vehicles"].collect()}
    assert "duplicate_candidate_unresolved|duplicate_candidate_target_conflict" in flags["12"] and "unresolved" not in flags["9"]
    assert {r.vehicle_id: r.representative_id for r in out["resolution"].collect()} == {"10": "9", "9": "9", "12": "12", "13": "13", "14": "14", "15": "14", "16": "16", "17": "16"}
    steps = {r.stage: r for r in out["funnel"].collect()}
    assert len(steps) == 15 and steps["model_year"].removed == 1 and steps["vehicle_class"].removed == 0
    assert steps["confirmed_complete_source_duplicates"].before == 8 and steps["confirmed_complete_source_duplicates"].removed == 3
    assert {r.reason: r.n for r in out["reasons"].collect()} == {"model_year_out_of_scope": 1, "vehicle_class_out_of_scope": 1}


def test_stage_order():
    assert [s for _, _, s in V.STAGE_TABLE if s not in V.STAGES] == []


def test_integrity(spark):
    files = spark.createDataFrame([("1.json", raw(), "h1"), ("2.json", raw(id="3"), "h2"), ("4.json", "{", "h4"), ("5.json", raw(id="5"), "h5")], "file string, raw string, sha256 string")
    log = spark.createDataFrame([("vehicles/1.json", "h1", 200, True, "u", "t", "s"), ("vehicles/2.json", "zz", 500, False, "u", "t", "s"), ("vehicles/4.json", "h4", 200, True, None, "t", "s"), ("vehicles/5.json", "h5", 200, True, "u", "t", "s")],
                                "file string, sha256 string, status int, valid boolean, url string, received_at_utc string, snapshot_id string")
    good = [(2019, "Acme", "Roadster", "", "")]
    inv = spark.createDataFrame([("1", "fetched", None, good), ("2", "failed", None, good), ("5", "fetched", None, good + [(2020, "Acme", "Roadster", "", "")])],
                                "vehicle_id string, status string, error string, provenance array<struct<model_year int, manufacturer string, model_name string, option_text string, options_url string>>")
    got = {r.file: r.integrity for r in V.integrity_reasons(files, log, inv).collect()}
    assert got == {
        "1.json": [], "5.json": ["raw_conflicting_menu_provenance"],
        "2.json": ["raw_checksum_missing_or_mismatch", "raw_request_not_validated", "raw_inventory_id_mismatch", "raw_inventory_status:failed", "filename_vehicle_id_mismatch"],
        "4.json": ["missing_provenance", "raw_invalid_json", "raw_inventory_missing_identifier"]}


def test_record_identity(spark):
    rows = [("a", raw()), ("b", raw(year="1800")), ("c", raw(model="Other")), ("d", raw(id="2")), ("e", "[]")]
    df = spark.createDataFrame([(*r, "1", 2019, "Acme", "Roadster ") for r in rows], "n string, raw string, i string, y int, m string, o string")
    got = {r.n: r.identity_error for r in V.record_identity(df, "raw", vehicle_id="i", year="y", make="m", model="o").collect()}
    assert got == {"a": None, "b": "bad_year", "c": "model_differs", "d": "id_differs", "e": "no_object"}


def test_target_never_shapes_candidates(spark):
    rows = [raw(id=str(i), comb08=str(20 + i)) for i in range(1, 6)]
    a = V.build(V.normalise(spark.createDataFrame([(r,) for r in rows], "raw string")))["candidates"]
    b = V.build(V.normalise(spark.createDataFrame([(raw(id=str(i), comb08=str(90 - i)),) for i in range(1, 6)], "raw string")))["candidates"]
    key = lambda df: sorted(map(tuple, df.select("candidate_group", "vehicle_id", "candidate_size").collect()))
    assert key(a) == key(b) and a.where(F.col("target_conflict")).count() == 5
