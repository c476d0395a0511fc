"""The vehicle binding: raw JSON records to an audited modelling table, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import (alias_value, boolean_field, casefold, checked_number, compact, fingerprint, group_text, json_map, json_text, json_type, number_field, positive_ratio,
                                string_field, strip)
from ..operators.components import written
from ..operators.dedup import candidates, comparable_json, resolution
from ..operators.profile import category_inventory, raw_inventory
from ..operators.rules import check_rule_table, funnel, in_rule_range, match_rule_kinds, match_rules, prefix_stage, reason_counts

# Fixed values of the data contract.
LITRES_PER_100KM = 235.2145833333333
YEARS = (2015, 2025)
FUELS = ["Regular Gasoline", "Premium Gasoline", "Midgrade Gasoline"]
CLASSES = [
    "Two Seaters", "Minicompact Cars", "Subcompact Cars", "Compact Cars", "Midsize Cars", "Large Cars",
    "Small Station Wagons", "Midsize Station Wagons", "Large Station Wagons",
    "Small Sport Utility Vehicle 2WD", "Small Sport Utility Vehicle 4WD",
    "Standard Sport Utility Vehicle 2WD", "Standard Sport Utility Vehicle 4WD",
]
HYBRID_TEXT = r"(?iU)\b(hev|phev|mhev|hybrid|eassist)\b"
STAGES = [
    "raw_integrity", "required_identity", "model_year", "powertrain_metadata",
    "primary_fuel", "secondary_fuel", "alternative_technology", "electric_motor",
    "phev", "hybrid_text", "reviewed_powertrain", "vehicle_class", "target", "engine_specs",
]
#: Ordered: the first row that fits a reason gives its stage.
STAGE_TABLE = [
    ("prefix", "reviewed_powertrain_", "reviewed_powertrain"),
    ("prefix", "raw_", "raw_integrity"), ("prefix", "missing_provenance", "raw_integrity"), ("prefix", "invalid_record", "raw_integrity"), ("prefix", "filename_", "raw_integrity"),
    ("equals", "invalid_vehicle_id", "required_identity"), ("prefix", "missing_required", "required_identity"),
    ("contains", "year", "model_year"),
    ("contains", "powertrain_metadata", "powertrain_metadata"), ("contains", "conflicting_alias", "powertrain_metadata"), ("prefix", "invalid_type", "powertrain_metadata"),
    ("prefix", "primary_fuel", "primary_fuel"), ("prefix", "secondary_fuel", "secondary_fuel"), ("prefix", "alternative_technology", "alternative_technology"),
    ("prefix", "electric_motor", "electric_motor"), ("prefix", "phev", "phev"), ("prefix", "unknown_phev", "phev"), ("prefix", "hybrid_text", "hybrid_text"), ("prefix", "vehicle_class", "vehicle_class"),
    ("equals", "invalid_target", "target"), ("suffix", ":comb08", "target"),
]
#: Normalised column, raw key.
TEXT_FIELDS = [
    ("manufacturer", "make"), ("model_name", "model"), ("transmission", "trany"), ("drivetrain", "drive"), ("vehicle_class", "VClass"),
    ("engine_description", "eng_dscr"), ("engine_id", "engId"), ("fuel_type_primary", "fuelType1"), ("fuel_type_secondary", "fuelType2"), ("electric_motor", "evMotor"),
]
NUMBER_FIELDS = [("model_year", "year", True), ("displacement_l", "displ", False), ("cylinders", "cylinders", True), ("combined_mpg", "comb08", False), ("combined_mpg_unrounded", "comb08U", False)]
CANDIDATE_FIELDS = ["model_year", "manufacturer", "model_name", "displacement_l", "cylinders", "transmission", "drivetrain", "vehicle_class", "engine_description", "engine_id", "fuel_type_primary"]
RULE_COLUMNS = "rule_id string, make string, year_min int, year_max int, pattern string, displacement double, cylinders double, technology string"
#: The reviewed rules: mild hybrids, and cars whose technology labels are unclear.
RULES = [
    ("volvo_b_badge_mild_hybrid", "Volvo", 2022, 2025, r"(?i)\bB[456]\b", None, None, "mild_hybrid"),
    ("audi_2021_2022_a4_a5_q5_2l_mild_hybrid", "Audi", 2021, 2022, r"(?i)\b(A4|A5|Q5)\b", 2.0, 4.0, "mild_hybrid"),
    ("audi_sq7_sq8_4l_technology_uncertain", "Audi", 2020, 2025, r"(?i)\b(SQ7|SQ8)\b", 4.0, 8.0, "powertrain_uncertain"),
]
#: Family of a vehicle class, by the first text it contains.
FAMILIES = [("Sport Utility", "SUV"), ("Station Wagon", "Station wagons")]
OUTPUTS = ["vehicle_id", *(c for c, _ in TEXT_FIELDS), "base_model", "atv_type", "phev_blended", *(c for c, _, _ in NUMBER_FIELDS), "target_l100km"]


def stage_of(reason):
    return prefix_stage(reason, STAGE_TABLE, "engine_specs")


#: Where the reviewed rules come from.
RULE_SOURCE = "the reviewed rules of the data contract"


def rules_table(spark) -> DataFrame:
    names = [c.split()[0] for c in RULE_COLUMNS.split(", ")]
    check_rule_table([dict(zip(names, r)) | {"source": RULE_SOURCE} for r in RULES], ("mild_hybrid", "powertrain_uncertain"), YEARS)
    return spark.createDataFrame(RULES, RULE_COLUMNS)


def class_family(vehicle_class):
    """The family label of a class; classes of no listed family are cars. Null stays null."""
    out = F.when(vehicle_class.isNull(), None)
    for part, family in FAMILIES:
        out = out.when(vehicle_class.contains(part), family)
    return out.otherwise("Cars")


def raw_categories(raw: DataFrame) -> DataFrame:
    """field, value, n over all parseable records (raw, a JSON text), excluded ones too."""
    return raw_inventory(raw, "raw", ["VClass", "fuelType1", "fuelType2", "atvType", "evMotor", "make"], [("vehicle_class_atv_pair", [["VClass"], ["atvType", "atvtype"]], "::")])


def _around(before: str, after: str):
    return lambda text: F.concat(F.lit(before), text, F.lit(after))


def normalise(raw: DataFrame, integrity: str | None = None) -> DataFrame:
    """The 19 typed fields, target_l100km, model_group, reasons and audit_flags of each record.

    raw: raw (a JSON text), and optionally an array of integrity reasons, which come first. What
    isn't an object has the one reason invalid_record_object. All reasons are kept, in order.
    """
    m = F.col("__m")
    at = lambda k: F.element_at(m, F.lit(k))
    has = lambda k: F.coalesce(F.map_contains_key(m, F.lit(k)), F.lit(False))
    atv, atv_conflict, atv_flag = alias_value(m, "atvType", "atvtype")
    base, base_conflict, base_flag = alias_value(m, "baseModel", "basemodel")
    texts = [*TEXT_FIELDS, ("base_model", "baseModel"), ("atv_type", "atvType")]
    keys = ["id", *(k for _, k in texts), *(k for _, k, _ in NUMBER_FIELDS), "phevBlended"]
    value = {k: at(k) for k in keys} | {"baseModel": base, "atvType": atv}
    # Types and texts are columns of a projection of their own, so that they are parsed once.
    df = raw.withColumn("__m", json_map(F.col("raw")))
    df = df.withColumns({f"__t_{k}": json_type(v) for k, v in value.items()} | {f"__s_{k}": json_text(v) for k, v in value.items()}
                        | {"__a": atv_conflict, "__b": base_conflict, "__flags": F.array(atv_flag, base_flag)})
    t, s = lambda k: F.col(f"__t_{k}"), lambda k: F.col(f"__s_{k}")
    reasons, fields = [F.col("__a"), F.col("__b")], {}
    for name, key in texts:
        fields[name], reason = string_field(t(key), s(key), key)
        reasons.append(reason)
    ident = strip(s("id"))
    fields["vehicle_id"] = F.when(t("id").isin("string", "number") & ident.rlike(r"^[1-9][0-9]*$"), ident)
    for name, key, integer in NUMBER_FIELDS:
        number, reason = number_field(t(key), s(key), key, integer)
        fields[name] = number.cast("int") if integer else number
        reasons.append(reason)
    fields["phev_blended"], known = boolean_field(t("phevBlended"), s("phevBlended"))
    df = df.withColumns(fields | {"__known": known, "__typed": F.array(*reasons)})
    df = df.withColumn("target_l100km", positive_ratio(LITRES_PER_100KM, F.col("combined_mpg")))
    engine = [("displacement_l", "displacement"), ("cylinders", "cylinders")]
    rules = rules_table(df.sparkSession)
    cols = dict(make="manufacturer", name="model_name", year="model_year", engine=engine)
    of = lambda technology: lambda r: r["technology"] == technology
    df = match_rule_kinds(df, rules, {
        "__hybrid": ("full", of("mild_hybrid"), _around("reviewed_powertrain_hybrid:", "")),
        "__uncertain": ("full", of("powertrain_uncertain"), _around("reviewed_powertrain_uncertain:", "")),
        "__missing": ("missing", None, _around("reviewed_powertrain_uncertain:", ":missing_engine_condition"))}, **cols)
    c = F.col
    tests = [F.when(c("vehicle_id").isNull(), "invalid_vehicle_id")]
    later = [F.when(c(k).isNull(), f"missing_required:{k}") for k in ("manufacturer", "model_name", "vehicle_class")]
    later.append(F.when(~F.coalesce(c("model_year").between(*YEARS), F.lit(False)), "model_year_out_of_scope"))
    for key in ("fuelType1", "fuelType2", "evMotor", "phevBlended"):
        later.append(F.when(~has(key), f"missing_powertrain_metadata:{key}").when(t(key) == "null", f"null_powertrain_metadata:{key}"))
    later.append(F.when(~has("atvType") & ~has("atvtype"), "missing_powertrain_metadata:atvType").when(t("atvType") == "null", "null_powertrain_metadata:atvType"))
    later += [
        F.when(~F.coalesce(c("fuel_type_primary").isin(FUELS), F.lit(False)), "primary_fuel_out_of_scope"),
        F.when(c("fuel_type_secondary").isNotNull(), "secondary_fuel_present"),
        F.when(c("atv_type").isNotNull(), "alternative_technology_present"),
        F.when(c("electric_motor").isNotNull(), "electric_motor_present"),
        F.when(~c("__known"), "unknown_phev_boolean"),
        F.when(c("phev_blended"), "phev_blended"),
        F.when(F.concat_ws(" ", "model_name", "engine_description").rlike(HYBRID_TEXT), "hybrid_text_signal"),
    ]
    last = [
        F.when(~F.coalesce(c("vehicle_class").isin(CLASSES), F.lit(False)), "vehicle_class_out_of_scope"),
        F.when(c("target_l100km").isNull(), "invalid_target"),
        *[F.when(c(k) <= 0, f"nonpositive_engine_spec:{k}") for k in ("displacement_l", "cylinders")],
        F.when(c("displacement_l").isNull() & c("cylinders").isNull(), "insufficient_engine_specs"),
    ]
    numeric = len(NUMBER_FIELDS)
    typed = F.slice("__typed", 1, len(reasons) - numeric), F.slice("__typed", len(reasons) - numeric + 1, numeric)
    every = F.concat(typed[0], F.array(*tests), typed[1], F.array(*later), "__hybrid", "__uncertain", "__missing", F.array(*last))
    found = F.when(m.isNull(), F.array(F.lit("invalid_record_object"))).otherwise(F.array_distinct(F.array_compact(every)))
    if integrity:
        found = F.array_distinct(F.concat(F.coalesce(F.col(integrity), F.array().cast("array<string>")), found))
    spec = lambda k, key: F.when(c(k).isNull() & ~F.array_contains(F.array_compact("__typed"), f"invalid_numeric:{key}"), f"missing_optional:{k}")
    fallback = c("base_model").isNull() & c("manufacturer").isNotNull() & c("model_name").isNotNull()
    audit = F.concat("__flags", F.array(spec("displacement_l", "displ"), spec("cylinders", "cylinders"), *[F.when(c(k).isNull(), f"missing_optional:{k}") for k in ("transmission", "drivetrain", "engine_description", "base_model")],
                                        F.when(fallback, "model_group_fallback:model_name")))
    group = F.when(c("manufacturer").isNotNull() & F.coalesce("base_model", "model_name").isNotNull(), F.concat(group_text(c("manufacturer")), F.lit("::"), group_text(F.coalesce("base_model", "model_name"))))
    keep = [x for x in raw.columns if x not in OUTPUTS]
    return df.select(*keep, *OUTPUTS, group.alias("model_group"), found.alias("reasons"), F.when(m.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(audit))).alias("audit_flags"))


def integrity_reasons(files: DataFrame, log: DataFrame, records: DataFrame) -> DataFrame:
    """files (file, sha256, raw) with their log entry's provenance and the array `integrity`:
    checksum, request status, provenance, parse and inventory findings, in that order."""
    name = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    l = log.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("sha256").alias("log_sha256"), "status", "valid", F.col("url").alias("source_url"), F.col("received_at_utc").alias("fetched_at_utc"), "snapshot_id")  # noqa: E741
    inv = records.select(F.col("vehicle_id").alias("inv_id"), F.col("status").alias("inv_status"), "provenance")
    df = files.withColumn("stem", name).join(l, "file", "left").join(inv, F.col("stem") == F.col("inv_id"), "left")
    m = json_map(F.col("raw"))
    field = lambda k: strip(F.try_variant_get(F.element_at(m, F.lit(k)), "$", "string"))
    identity = lambda p: F.concat_ws("\x1f", p["model_year"].cast("string"), strip(p["manufacturer"]), strip(p["model_name"]))
    met = F.array_distinct(F.transform("provenance", identity))
    said = F.concat_ws("\x1f", field("year"), field("make"), field("model"))
    empty = F.exists("provenance", lambda p: p["model_year"].isNull() | F.coalesce(strip(p["manufacturer"]) == "", F.lit(True)) | F.coalesce(strip(p["model_name"]) == "", F.lit(True)))
    shape = F.col("provenance").isNull() | (F.size("provenance") == 0) | empty
    found = compact(
        F.when(F.col("log_sha256").isNull() | (F.col("log_sha256") != F.col("sha256")), "raw_checksum_missing_or_mismatch"),
        F.when(~F.coalesce((F.col("status") == 200) & F.coalesce("valid", F.lit(True)), F.lit(False)), "raw_request_not_validated"),
        F.when(F.col("source_url").isNull() | F.col("fetched_at_utc").isNull(), "missing_provenance"),
        F.when(F.try_parse_json("raw").isNull(), "raw_invalid_json"),
        F.when(F.col("inv_id").isNull(), "raw_inventory_missing_identifier"),
        F.when(F.col("inv_id").isNotNull() & (F.coalesce(field("id"), F.lit("")) != F.col("inv_id")), "raw_inventory_id_mismatch"),
        F.when(F.col("inv_id").isNotNull() & (F.coalesce("inv_status", F.lit("")) != "fetched"), F.concat(F.lit("raw_inventory_status:"), F.coalesce("inv_status", F.lit("")))),
        F.when(F.col("inv_id").isNotNull() & shape, "raw_inventory_missing_or_invalid_provenance"),
        F.when(~shape & (F.size(met) > 1), "raw_conflicting_menu_provenance"),
        F.when(~shape & (F.size(met) == 1) & (met[0] != said), "raw_menu_record_identity_mismatch"),
        F.when(field("id").isNotNull() & (field("id") != F.col("stem")), "filename_vehicle_id_mismatch"))
    return df.withColumn("integrity", found).select("file", "raw", F.col("sha256").alias("raw_sha256"), "source_url", "fetched_at_utc", "snapshot_id", "integrity")


def build(normalised: DataFrame) -> dict[str, DataFrame]:
    """vehicles, excluded, candidates, resolution, funnel, reasons and categories. All of them
    read one normalised parent, which is written to the shared folder first."""
    normalised = written(normalised, "normalised")
    ok = normalised.where(F.size("reasons") == 0)
    keyed = ok.withColumn("__whole", F.expr(comparable_json("raw")))
    found = candidates(keyed, "vehicle_id", CANDIDATE_FIELDS, ["__whole"], "combined_mpg")
    settled = resolution(keyed, "vehicle_id", CANDIDATE_FIELDS, ["__whole"], "combined_mpg")
    gone = settled.where("removed").select("vehicle_id")
    unsure = found.where("status = 'retained_differences_unresolved'").select("vehicle_id", F.when(
        F.col("target_conflict"), F.array(F.lit("duplicate_candidate_unresolved"), F.lit("duplicate_candidate_target_conflict"))).otherwise(F.array(F.lit("duplicate_candidate_unresolved"))).alias("__more"))
    kept = ok.join(gone, "vehicle_id", "left_anti").join(unsure, "vehicle_id", "left")
    kept = kept.withColumn("audit_flags", F.array_join(F.concat("audit_flags", F.coalesce("__more", F.array().cast("array<string>"))), "|")).drop("__more", "reasons", "raw", "integrity")
    steps = funnel(normalised, STAGES, stage_of)
    ends = ok.agg(F.count("*").alias("before")).crossJoin(F.broadcast(gone.agg(F.count("*").alias("removed"))))
    steps = steps.unionByName(ends.select(F.lit("confirmed_complete_source_duplicates").alias("stage"), "before", "removed", (F.col("before") - F.col("removed")).alias("after")))
    return {
        "vehicles": kept, "excluded": normalised.where(F.size("reasons") > 0).select("vehicle_id", F.array_join("reasons", "|").alias("reasons"), F.array_join("audit_flags", "|").alias("audit_flags")),
        "candidates": found, "resolution": settled, "funnel": steps, "reasons": reason_counts(normalised),
        "categories": category_inventory(normalised, ["manufacturer", "transmission", "drivetrain", "vehicle_class", "fuel_type_primary", "atv_type"]),
    }


OUTPUT_KEYS = r"(?i)^(city|highway|comb|ucity|uhighway|co2|fuelcost|barrels|range|phevcity|phevcomb|phevhwy)"
OTHER_OUTPUTS = ["feScore", "ghgScore", "ghgScoreA", "guzzler", "youSaveSpend", "emissionsList"]


def key_disposition(key):
    """Role of a raw key: predictor, text, target, leakage or audit."""
    return (F.when(key.isin("year", "make", "displ", "cylinders", "trany", "drive", "VClass"), "structured_predictor")
            .when(key.isin("model", "eng_dscr"), "preserve_original_text_for_final_sanitization")
            .when(key.isin("comb08", "comb08U"), "target_or_target_audit_only")
            .when(key.rlike(OUTPUT_KEYS) | key.isin(OTHER_OUTPUTS), "excluded_from_predictors_leakage_or_output")
            .otherwise("source_audit_only_excluded_from_predictors"))


def target_status(m, key: str = "comb08"):
    """key_absent, null, empty, invalid_type, non_numeric, nonfinite, nonpositive or valid."""
    v = F.element_at(m, F.lit(key))
    t, text = json_type(v), strip(F.try_variant_get(v, "$", "string"))
    value = checked_number(v, key)[0]
    return (F.when(~F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False)), "key_absent").when(t == "null", "null").when(~t.isin("string", "number"), "invalid_type")
            .when(text == "", "empty").when(casefold(text).rlike(r"^[+-]?(inf|infinity|nan)$"), "nonfinite").when(value.isNull(), "non_numeric").when(value <= 0, "nonpositive").otherwise("valid"))


def validate_inputs(df: DataFrame, confirmed: str = "gasoline_nonhybrid") -> DataFrame:
    """df with error: null for rows that may be scored, else the first violated rule."""
    rules = rules_table(df.sparkSession)
    cols = dict(make="manufacturer", name="model_name", year="model_year", engine=[("displacement_l", "displacement"), ("cylinders", "cylinders")])
    full = match_rules(df, rules, **cols).withColumnRenamed("rule_ids", "__full")
    both = match_rules(full, rules, mode="missing", **cols).withColumnRenamed("rule_ids", "__missing")
    both = in_rule_range(both, rules, make="manufacturer", year="model_year", column="__ranged")
    c = F.col
    bad = lambda k, whole: c(k).isNotNull() & ((c(k) <= 0) | F.isnan(c(k).cast("double")) | (F.floor(c(k)) != c(k) if whole else F.lit(False)))
    error = F.when(~F.coalesce(c(confirmed), F.lit(False)), "hybrid_or_unconfirmed").when(c("model_year").isNull() | bad("model_year", True), "invalid:model_year")
    for k, whole in (("displacement_l", False), ("cylinders", True)):
        error = error.when(bad(k, whole), f"invalid:{k}")
    error = error.when(~c("model_year").between(*YEARS), "model_year_out_of_scope").when(c("displacement_l").isNull() & c("cylinders").isNull(), "no_engine_specs")
    for k in ("manufacturer", "transmission", "drivetrain", "vehicle_class"):
        error = error.when(c(k).isNull() | (strip(c(k)) == "") | (F.length(k) > 150), f"invalid:{k}")
    error = error.when(~strip(c("vehicle_class")).isin(CLASSES), "vehicle_class_out_of_scope")
    for k in ("model_name", "engine_description"):
        error = error.when(F.length(k) > 1000, f"invalid:{k}")
    error = (error.when(F.concat_ws(" ", "model_name", "engine_description").rlike(HYBRID_TEXT), "hybrid_text_signal")
             .when(c("__ranged") & F.coalesce(strip(c("model_name")) == "", F.lit(True)), "model_name_needed")
             .when(F.size("__missing") > 0, "engine_specs_needed").when(F.size("__full") > 0, "reviewed_powertrain"))
    return both.withColumn("error", error).drop("__full", "__missing", "__ranged")


def record_identity(df: DataFrame, raw: str, *, vehicle_id: str, year: str, make: str, model: str) -> DataFrame:
    """df with identity_error: null if the record's id, year, make and model are well formed (year
    1900 to 2100) and equal to the expected columns."""
    m = json_map(F.col(raw))
    text = lambda k: F.when(json_type(F.element_at(m, F.lit(k))).isin("string", "number"), strip(F.try_variant_get(F.element_at(m, F.lit(k)), "$", "string")))
    y = checked_number(F.element_at(m, F.lit("year")), "year", True)[0]
    error = (F.when(m.isNull(), "no_object").when(~F.coalesce(text("id").rlike(r"^[1-9][0-9]*$"), F.lit(False)), "bad_id").when(~F.coalesce(y.between(1900, 2100), F.lit(False)), "bad_year")
             .when(F.coalesce(text("make"), F.lit("")) == "", "bad_make").when(F.coalesce(text("model"), F.lit("")) == "", "bad_model")
             .when(text("id") != F.col(vehicle_id), "id_differs").when(y != F.col(year), "year_differs").when(text("make") != strip(F.col(make)), "make_differs").when(text("model") != strip(F.col(model)), "model_differs"))
    return df.withColumn("identity_error", error)


def whole_record_hash(raw: str):
    return fingerprint(F.expr(comparable_json(raw)))
