"""Sources, sinks, text functions, models, search, splits and streams."""

import hashlib
import json

import numpy as np
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import values as V
from ledgerloom.operators import components, dedup, evaluate, families, features, joins, models, order, rules, search, serve, split
from ledgerloom.sources import files, http, sinks
from ledgerloom.streaming import logs

LEAKS = ["GUZZLER", "Gas Guzzler", "27 MPG", "MPG: 27", "29 MPGe", "9.2 L/100 km", "L/100km=9.2", "fuel economy: 27 MPG", "EPA combined: 29", "annual fuel cost: $2,500.00", "fuelCost08=2500", "CO2: 190 g/km",
         "198 g/mi", "emissions score: 8", "ghgScore=7", "feScore=9", "efficiency score: 7", "smartwayScore=9", "youSaveSpend=-1500"]


def cleaned(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r for r in df.select("i", "t", X.sanitize(F.col("t")).alias("a"), X.sanitize(X.sanitize(F.col("t"))).alias("b")).orderBy("i").collect()]


def test_published_leaks_go(spark):
    for r in cleaned(spark, LEAKS):
        assert r.a.strip(" :=-/") == "", r


@settings(max_examples=2, deadline=None, phases=[Phase.generate])
@given(st.data())
def test_any_amount_of_any_leak_goes_and_nothing_else(spark, data):
    """Leaks of every form, with drawn amounts and without the separator that a form may have,
    between words that must stay."""
    amounts = st.one_of(st.integers(1, 99999).map(str), st.floats(0.1, 999).map(lambda x: f"{x:.1f}"), st.integers(1000, 99999).map(lambda n: f"{n:,}"))
    named = ["co2TailpipeGpm", "co2A", "barrels08", "fuelCost08", "fuelCostA2", "youSaveSpend", "ghgScoreA", "feScore", "smartwayScore", "emissions", "emissions score", "CO2", "ghg score", "efficiency score", "fuel economy", "Fuel Consumption",
             "annual fuel cost", "fuel costs", "EPA combined", "city", "highway mpg", "MPG", "mpge", "miles per gallon", "L/100 km", "l / 100km"]
    measured = ["MPG", "mpge", "miles per gallon", "L/100 km", "liters/100km", "l per 100 km", "g/km", "g / mi", "kg/year", "kg CO2/year"]
    forms = [f"{n}{sep}{{}}" for n in named for sep in (" ", ": ", "=", " = ")] + [f"{{}} {u}" for u in measured] + ["${}", "€ {}", "${}/year", "£{} per year", "fuel cost: ${}", "youSaveSpend -{}", "CO2: {} g/km", "fuelCost08 {} USD"]
    keep = ["EcoBoost V8 S4", "2.0L Turbo", "AWD", "9-3 Aero"]  # a number before a unit would be its amount
    texts, want = [], []
    for f in forms:
        left, right = data.draw(st.sampled_from(keep)), data.draw(st.sampled_from(["Turbo AWD", "V6 coupe", "hatch"]))
        texts.append(f"{left}  {f.format(data.draw(amounts))} {right}")
        want.append(f"{left} {right}")
    for r, w in zip(cleaned(spark, texts), want):
        assert r.a == w and r.b == w, r


def test_sanitizer_edges(spark):
    got = cleaned(spark, [None, "", "  plain   words ", "DOHC fuelCostA=2,100 co2TailpipeGpmA=250 barrels08=10.5", "27 gas guzzler MPG wagon", "city car, Highwayman", "barrels08", "emission 7 emissions"])
    assert [r.a for r in got] == ["", "", "plain words", "DOHC", "wagon", "city car, Highwayman", "", ""]


def test_bins_golden(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.01, 3.0, 4.0, 5.0, None, 0.0, float("nan"))], "x double")
    assert [r[0] for r in df.select(V.right_closed_bins(F.col("x"), [0, 2, 3, 4])).collect()] == ["(0,2]", "(0,2]", "(2,3]", "(2,3]", "(3,4]", "(4,+inf)", "Missing", "Invalid", "Missing"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \t \xa0\n\x1fa\xdf1._-+eEdNainf", max_size=8), min_size=30, max_size=30))
def test_numbers_and_strip_as_python_reads_them(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", V.parse_number(F.col("t")).alias("n"), V.strip(F.col("t")).alias("s")).collect():
        try:
            want = float(r.t)
            want = want if abs(want) < float("inf") else None
        except ValueError:
            want = None
        assert (r.n, r.s) == (want, r.t.strip()), repr(r.t)


def test_components(spark):
    e = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("q", "q")], "a string, b string")
    assert {r.node: r.root for r in components.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_family_rules(spark):
    rows = [("1", "Alpha", "Sport GT", "C"), ("2", "Alpha", "Sport GT", "B"), ("3", "Alpha", "Coupe", "B"), ("4", "Alpha", "coupe ", "A"), ("5", "Beta", "Sport GT", "C"), ("6", "Alpha", "COUPE", None), ("7", "Alpha", "Coupe X", None)]
    df = spark.createDataFrame(rows, "id string, make string, name string, base string")
    got = families.alias_components(df, "make", "name", "base").collect()
    assert {(r.make, r.base, r.canonical) for r in got} == {("alpha", x, "a") for x in "abc"} and len({r.component_id for r in got}) == 1
    assert {(r.id, r.name, r.family) for r in families.alias_rows(df, "id", "make", "name", "base").collect()} == {("1", "sport gt", "a"), ("3", "coupe", "a")}
    with pytest.raises(ValueError):
        families.assign(df, "id", "make", "name", "base", spark.createDataFrame([("Alpha", "Coupe", "x"), ("alpha", "coupe", "y")], "make string, name string, family string"))
    with pytest.raises(ValueError):
        families.assign(spark.createDataFrame([("1", " ", "x", None)], df.schema), "id", "make", "name", "base")


def test_rule_table_checks():
    ok = {"rule_id": "a", "make": "m", "pattern": r"\bx\b", "year_min": 1, "year_max": 2, "source": "s", "technology": "t"}
    rules.check_rule_table([ok], ("t",), (1, 2))
    for bad in ([ok, ok], [{**ok, "year_min": 3}], [{**ok, "source": ""}], [{**ok, "cylinders": 0}], [{**ok, "make": " "}], [{**ok, "pattern": "("}], [{**ok, "pattern": None}], [{**ok, "technology": "u"}],
                [{**ok, "displacement": float("nan")}], [{**ok, "displacement": float("inf")}], [{**ok, "cylinders": True}], [{**ok, "year_max": 3}]):
        with pytest.raises(ValueError):
            rules.check_rule_table(bad, ("t",), (1, 2))


def test_sources(spark, tmp_path):
    (tmp_path / "vehicles").mkdir()
    with pytest.raises(ValueError):
        files.json_folder(spark, f"{tmp_path}/vehicles")
    (tmp_path / "vehicles" / "1.json").write_text('{"id": 1}')
    r = files.json_folder(spark, f"{tmp_path}/vehicles").first()
    assert (r.file, r.raw) == ("1.json", '{"id": 1}') and len(r.sha256) == 64
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in ({"file": "a\\1.json", "status": 500}, {"file": "a/1.json", "status": 200}, {"file": "b"})) + "\n\n")
    (tmp_path / "index.json").write_text(json.dumps({"entries": {"a/1.json": {"status": 1}, "z\\9": {"status": 7}}}))
    got = {r.file: r.status for r in files.request_log(spark, f"{tmp_path}/log.jsonl", f"{tmp_path}/index.json").collect()}
    assert got == {"a/1.json": 200, "b": None, "z/9": 7}
    (tmp_path / "inv.json").write_text(json.dumps({"records": {"5": {"status": "fetched", "provenance": [{"model_year": 2019}]}}}))
    r = files.inventory(spark, f"{tmp_path}/inv.json").first()
    assert r.vehicle_id == "5" and r.provenance[0].model_year == 2019
    spark.createDataFrame([(" b ", "TRUE"), ("a", "false")], "id string, ok string").write.parquet(f"{tmp_path}/d.parquet")
    assert [r.id for r in files.dataset(spark, f"{tmp_path}/d.parquet", "id").collect()] == ["a", "b"]
    assert [r.id for r in files.ids_only(spark, f"{tmp_path}/d.parquet", "id", "ok").collect()] == [" b "]
    with pytest.raises(ValueError):
        files.dataset(spark, f"{tmp_path}/d.txt", "id")
    for name, meta in (("x", {"stage": "midterm", "status": "completed", "completed_at": "9"}), ("y", {"stage": "final", "status": "completed", "completed_at": "1"}), ("z", {"stage": "final", "status": "interrupted"})):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "run_metadata.json").write_text(json.dumps(meta))
    assert files.best_run(f"{tmp_path}/runs").name == "y"
    assert files.menu_file("year", {}) == "menus/year.json" and files.menu_file("m", {"b": "1", "a": "2"}) == files.menu_file("m", {"a": "2", "b": "1"})


def test_html_items(spark):
    html = "<ul><li>comb08 - combined &amp; more <div>x</div> no</li><li>a <b>text</b><ul><LI class='x'>city08 -\n city</LI></ul> tail</li><!-- c --><li>comb08 - again</li><li></li><link rel='x'><li>open &lt;end&gt;</ul>"
    df = spark.createDataFrame([(1, html, 0), (2, None, 0), (3, "", 0)], "id long, html string, position int")
    assert [(r.key, r.meaning) for r in files.list_items(df, "id", "html").orderBy("position").collect()] == [("comb08", "combined & more"), ("city08", "city")]
    every = files.list_items(df, "id", "html", keyed=False).orderBy("position").collect()
    assert [r.meaning for r in every] == ["comb08 - combined & more", "a text", "city08 - city", "comb08 - again", "", "open <end>"] and [r.position for r in every] == list(range(6))


def test_log_lines_stand_by_file_and_line(spark, tmp_path):
    for k, name in enumerate(("b", "a")):  # a large first file would otherwise come first
        lines = [json.dumps({"file": f"f{i % 5}", "status": 100 * k + i}) for i in range(400 if name == "b" else 7)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n\n")
    got = {r.file: r.status for r in files.request_log(spark, str(tmp_path)).collect()}
    assert got == {f"f{i}": 395 + i for i in range(5)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "i int, l array<string>")
    h = sinks.write_table(df, f"{tmp_path}/t", csv=True)
    assert h == sinks.content_hash(df.repartition(2)) != sinks.content_hash(df.where("i = 1"))
    with pytest.raises(Exception):
        sinks.write_table(df, f"{tmp_path}/t")
    sinks.write_json(tmp_path / "j.json", {"a": 1})
    with pytest.raises(ValueError):
        sinks.write_json(tmp_path / "j.json", {"a": float("nan")})
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": 1} and len(list(tmp_path.glob(".j*"))) == 0
    sinks.write_once(tmp_path / "b", b"x")
    sinks.write_once(tmp_path / "b", b"x")
    with pytest.raises(ValueError):
        sinks.write_once(tmp_path / "b", b"y")
    sinks.seal(tmp_path / "seal.json", {"t": df}, {"k": 1})
    sinks.verify_seal(tmp_path / "seal.json", {"t": df.repartition(3)}, {"k": 1})
    for tables, config in (({"t": df.where("i = 1")}, {"k": 1}), ({"t": df}, {"k": 2})):
        with pytest.raises(ValueError):
            sinks.verify_seal(tmp_path / "seal.json", tables, config)
    assert sinks.markdown(spark.createDataFrame([(1.5, "a|b")], "x double, y string")) == "| x | y |\n| --- | --- |\n| 1.5000 | a\\|b |"


def test_http_schedule():
    assert http.retryable(None) and http.retryable(429) and http.retryable(503) and not http.retryable(404)
    assert http.wait(3, 0.5, None) == 4.5 and http.wait(1, 0.0, 30.0) == 30.0
    assert http.retry_after("inf", 0) is None and http.retry_after("nan", 0) is None and http.retry_after("-3", 0) == 0
    assert http.retry_after("Thu, 01 Jan 1970 00:00:10", 4) == 6 and http.header({"retry-after": "5"}, "Retry-After") == "5"
    assert http.retry_after("7", 0) == 7 and http.retry_after("Thu, 01 Jan 1970 00:00:10 GMT", 4) == 6 and http.retry_after("x", 0) is None
    slept, answers = [], [(503, {"Retry-After": "9"}, b"no"), (200, {}, b"yes")]
    got = http.fetch("u", transport=lambda u, t: answers.pop(0), sleep=slept.append, now=lambda: 0.0)
    assert got[1:3] == (200, b"yes") and got[4:] == (2, None, False) and slept == [9.0]
    assert http.fetch("u", transport=lambda u, t: (404, {}, b""), sleep=slept.append)[4] == 1


def frame(spark):
    """20 families of 6 variants."""
    rows = []
    for g in range(20):
        for v in range(6):
            d = 1.2 + 0.6 * (g % 5) + 0.05 * v
            rows.append((str(1000 + 6 * g + v), 2015 + v, f"Maker {g % 3}", f"Family {g}", d, 4 if d < 3 else 6, 5 + 1.4 * d + 0.01 * v))
    return spark.createDataFrame(rows, "id string, year int, make string, family string, displacement double, cylinders int, y double")


def test_splits(spark):
    df = frame(spark)
    m = split.build_manifest(df, "id", "family").cache()
    assert split.check_manifest(df, m, "id", "family").where("n > 0").count() == 0
    assert m.where("split = 'test'").select("family").distinct().count() == 4
    assert {r[0] for r in m.where("split = 'train'").groupBy("cv_fold").count().select("count").collect()} <= {18, 24}
    again = split.build_manifest(df.repartition(5), "id", "family")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, m.collect()))
    broken = m.withColumn("cv_fold", F.when(F.col("split") == "test", 1).otherwise(F.col("cv_fold")))
    assert {r.check for r in split.check_manifest(df, broken, "id", "family").where("n > 0").collect()} == {"test_rows_with_fold"}
    with pytest.raises(ValueError):
        split.group_folds(df.where("family = 'Family 1'"), "family")


def test_shuffle_split_is_the_seeded_permutation(spark):
    df = spark.createDataFrame([(f"g{i % 37:02d}",) for i in range(100)], "g string")
    got = {r.g for r in split.shuffle_split(df, "g").where("split = 'test'").collect()}
    places = np.random.RandomState(42).permutation(37)
    assert got == {f"g{i:02d}" for i in places[:8]}  # ceil(0.2 * 37)


def test_group_folds_against_a_plain_greedy(spark):
    df = spark.createDataFrame([(g,) for g in range(23) for _ in range(1 + g * 7 % 11)], "g int")
    size = {g: 1 + g * 7 % 11 for g in range(23)}
    load, want = [0] * 5, {}
    for g in sorted(size, key=lambda g: (size[g], g), reverse=True):
        f = load.index(min(load))
        want[g] = f
        load[f] += size[g]
    assert {r.g: r.cv_fold for r in split.group_folds(df, "g").collect()} == want


def test_protocol_is_locked():
    split.check_protocol(dict(split.PROTOCOL))
    for k in split.PROTOCOL:
        with pytest.raises(ValueError, match=k):
            split.check_protocol({**split.PROTOCOL, k: "other"})
        with pytest.raises(ValueError, match=k):
            split.check_protocol({a: b for a, b in split.PROTOCOL.items() if a != k})


def test_interface_schema_takes_training_rows_only(spark):
    df = spark.createDataFrame([("2", " b ", 1.0, "train"), ("10", "a", 3.0, "train"), ("x", "", None, "train")], "id string, c string, v double, split string")
    got = {r.field: r for r in serve.interface_schema(df, ["c"], ["v"], "id").collect()}
    assert got["c"].options == ["a", "b"] and got["v"].median == 2.0
    assert got["training_rows"].options == [hashlib.sha256(b'["10","2","x"]').hexdigest()] and got["training_rows"].median == 3
    for bad in (df.where("false"), df.withColumn("split", F.lit("test"))):
        with pytest.raises(ValueError):
            serve.interface_schema(bad, ["c"], ["v"], "id")


def test_ridge_grid_against_refitted_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=120) * 0.3
    fold = np.arange(120) % 4
    df = spark.createDataFrame([(v.tolist(), v[:2].tolist(), float(t), int(f)) for v, t, f in zip(x, y, fold)], "a array<double>, b array<double>, y double, fold int")
    got = search.ridge_grid(df, {"few": "b", "all": "a"}, [0.1, 10.0, 100.0], "y", "fold").collect()
    def mae(cols, alpha):
        out = []
        for f in range(4):
            t, h = fold != f, fold == f
            z, m = x[t][:, cols], x[t][:, cols].mean(0)
            w = np.linalg.solve((z - m).T @ (z - m) + alpha * np.eye(len(cols)), (z - m).T @ (y[t] - y[t].mean()))
            out.append(np.abs((x[h][:, cols] - m) @ w + y[t].mean() - y[h]).mean())
        return np.mean(out), np.std(out)
    for r in got:
        assert np.allclose((r.mae_mean, r.mae_std), mae([0, 1] if r.model == "few" else [0, 1, 2, 3], r.alpha))
    best = min(got, key=lambda r: (r.mae_mean, r.mae_std))
    assert [r for r in got if r.selected] == [best] and best.model == "all" and sum(r.arm_choice for r in got) == 2
    with pytest.raises(ValueError):
        search.ridge_grid(df, {"all": "a"}, [1.0, 1.0], "y", "fold")


def test_joins_raise(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, 5), (1, 6)], "k int, w int")
    with pytest.raises(ValueError):
        joins.one_to_one(a, b, ["k"])
    with pytest.raises(ValueError):
        joins.many_to_one(a, b.limit(1), ["k"])
    assert joins.many_to_one(a, b.limit(1), ["k"], require_match=False).count() == 2
    with pytest.raises(ValueError):
        dedup.require_unique(spark.createDataFrame([(None,)], "k int"), ["k"])
    assert order.latest(spark.createDataFrame([("f", 1, "a"), ("f", 2, "b")], "k string, n int, v string"), "k", "n").first().v == "b"


def test_preprocessor_is_fitted_on_training_rows_only(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True), (2, 3.0, "b", True), (3, None, None, True), (4, 9999.0, "new", False)], "id int, x double, c string, train boolean")
    p = features.Preprocessor(["x"], ["c"]).fit(df.where("train"))
    assert p.medians == {"x": 2.0} and p.names() == ["x", "x__missing", "c=Unknown", "c=a", "c=b"]
    got = {r.id: list(r)[1:] for r in p.transform(df, ["id"]).collect()}
    assert got[3] == [0.0, 1.0, 1.0, 0.0, 0.0] and got[4][1:] == [0.0, 0.0, 0.0, 0.0]
    assert got[1][0] == pytest.approx(-np.sqrt(1.5))
    with pytest.raises(ValueError):
        features.require_columns(df, ["x", "c"])
    with pytest.raises(Exception):
        features.select_predictors(spark.createDataFrame([(float("inf"),)], "x double"), ["x"], []).collect()


def test_linear_models_against_numpy(spark):
    df = frame(spark)
    p = features.Preprocessor(["displacement", "cylinders"], ["make"]).fit(df)
    data = p.vector(df, ["id", "y"]).toPandas()
    x, y = np.stack(data["x"]), data["y"].to_numpy()
    ols = models.Linear().fit(p.vector(df, ["id", "y"]))
    a = np.column_stack([x, np.ones(len(x))])
    assert np.allclose(x @ ols.coef + ols.intercept, a @ np.linalg.lstsq(a, y, rcond=None)[0], atol=1e-8)
    ridge = models.Linear(3.0).fit(p.vector(df, ["id", "y"]))
    xc = x - x.mean(0)
    assert np.allclose(ridge.coef, np.linalg.solve(xc.T @ xc + 3 * np.eye(x.shape[1]), xc.T @ (y - y.mean())), atol=1e-8)
    got = {r.id: r.y_pred for r in ridge.predict(p.vector(df, ["id"])).collect()}
    assert np.allclose([got[i] for i in data["id"]], x @ ridge.coef + ridge.intercept)


def test_trees_and_network_learn():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (400, 3))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + 0.5 * x[:, 1]
    for name in models.FITS:
        a, b = models.FITS[name](x[:300], y[:300], 1), models.FITS[name](x[:300], y[:300], 1)
        assert np.array_equal(a(x), b(x)) and np.abs(a(x[300:]) - y[300:]).mean() < 0.4 * np.abs(y[300:] - np.median(y[:300])).mean(), name


def test_target_does_not_leak_into_predictions(spark):
    df = frame(spark).withColumn("x", F.array("displacement", F.col("cylinders").cast("double"))).withColumn("cv_fold", (F.abs(F.hash("family")) % 5).cast("int"))
    other = df.withColumn("y", F.when(F.col("cv_fold") == 0, F.col("y") * 100).otherwise(F.col("y")))
    key = lambda d: {r.id: r.y_pred for r in models.cross_validate(d.select("id", "x", "y", "cv_fold"), "id", "tree").where("fold = 0").collect()}
    assert key(df) == key(other.repartition(3))


def test_nested_search_and_sealed_choice(spark):
    df = frame(spark).withColumn("x", F.array("displacement", F.col("cylinders").cast("double"))).withColumn("cv_fold", (F.substring("family", 8, 2).cast("int") % 5))
    out = search.nested_search(df.select("id", "x", "y", "cv_fold", "family"), [("tree", {"depth": 1}), ("tree", {"depth": 6, "leaf": 2})], "family").collect()
    assert len(out) == 12 and all(r.candidate == 1 for r in out if r.chosen)
    choice = search.Choice.of("tree", {"depth": 6})
    assert search.score_test(df.where("cv_fold <> 0"), df.where("cv_fold = 0"), choice, "id").count() == df.where("cv_fold = 0").count()
    with pytest.raises(ValueError):
        search.score_test(df, df, search.Choice("tree", "{}", choice.seal), "id")
    for bad in ([("tree", {})] * 2, [("unknown", {})], [("mlp", {"epochs": 5000})], []):
        with pytest.raises(ValueError):
            search.check_candidates(bad)


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 1.0, 1.0), ("c", 2.0, 2.0), ("c", 2.0, 2.0), ("d", 2.0, 1.0), ("d", 2.0, 2.0)], "m string, y_true double, y_pred double")
    got = {r.m: (r.n, r.mae, r.r2) for r in evaluate.metrics(df, ["m"]).collect()}
    assert got == {"a": (2, 0.5, 0.5), "b": (1, 0.0, None), "c": (2, 0.0, 1.0), "d": (2, 0.5, 0.0)}
    with pytest.raises(Exception):
        evaluate.paired(spark.createDataFrame([(1, "a", 0.5)], "id int, model string, abs_error double"), "id", ["a", "b"]).collect()
    tie = spark.createDataFrame([("x", 1.0, 0.5), ("y", 1.0, 0.5), ("z", 1.0, 0.6)], "model string, cv_mean double, cv_std double")
    assert evaluate.winner(tie, ["z", "y", "x"]).first()[0] == "y"


def test_segments(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) + 8 * (i % 3)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    x = np.array([r[1] for r in rows])
    mean, parts = models.pca(df, "x", 0.99)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(parts), np.abs(vt[:len(parts)]), atol=1e-8) and (s[:len(parts)] ** 2).sum() / (s**2).sum() >= 0.99 - 1e-9
    centres, cost = models.kmeans(df, "x", 3, seeds=3)
    got = {r.id: r.cluster for r in models.assign_clusters(df, "x", centres).collect()}
    assert all(len({got[i] for i in range(k, 90, 3)}) == 1 for k in range(3)) and len(set(got.values())) == 3
    assert models.silhouette(models.assign_clusters(df, "x", centres), "id", "x", "cluster").agg(F.avg("silhouette")).first()[0] > 0.6


def test_silhouette_scores_every_row(spark):
    rows = [(i, i % 2, [float(i % 2 * 9), float(i % 7)]) for i in range(5200)]
    df = spark.createDataFrame(rows, "id long, c int, x array<double>").repartition(8)
    got = {r.id: r.silhouette for r in models.silhouette(df, "id", "x", "c").collect()}
    assert len(got) == 5200
    x, c = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for i in (0, 1, 5199):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own, other = d[c == c[i]].sum() / ((c == c[i]).sum() - 1), d[c != c[i]].mean()
        assert abs(got[i] - (other - own) / max(own, other)) < 1e-9


def test_choice_of_k(spark):
    got = models.choose_k(spark.createDataFrame([(2, None), (3, 0.5), (4, 0.7), (5, 0.7), (6, float("nan"))], "k int, silhouette double")).collect()
    assert [r.k for r in got if r.chosen] == [4] and len(got) == 5


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(x) for x in (
        {"url": "u1", "status": 200, "valid": True, "received_at_utc": "2026-01-01T00:00:00Z"}, {"url": "u1", "status": 200, "valid": True, "received_at_utc": "2026-01-01T00:00:05Z"},
        {"url": "u2", "status": 500, "valid": False, "received_at_utc": "2026-01-01T00:00:01Z"})))
    q = logs.first_per_url(logs.log_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert [r.url for r in spark.sql("SELECT url FROM firsts").collect()] == ["u1"]
    finally:
        q.stop()
