"""Fits and statistics from sums in the cluster, against plain methods over whole arrays."""

import json
import math
import random
import tracemalloc
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ledgerloom.functions.text import sanitize, tokens
from ledgerloom.operators import families, local, ml, models, neighbours, networks, order, ranks, search, sparse, split, trees
from ledgerloom.plans import queries
from ledgerloom.sources import files, markup


# Order statistics.

def test_quantiles_of_hot_continuous_null_and_infinite_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    groups = {"hot": rng.normal(size=3000), "ties": rng.integers(0, 3, 200).astype(float), "one": np.array([7.5]), "huge": np.array([-1e308, 1e308, 0.0, 5e-324, 1e-300]), "inf": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf]),
              "steps": 2.0 ** -np.arange(24), None: rng.uniform(size=50)}
    rows = [(g, float(v), float(-v)) for g, vs in groups.items() for v in vs] + [("hot", None, float("nan")), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(7)
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    for bins in (4096, 64):  # one round, and many
        monkeypatch.setattr(ranks, "BINS", bins)
        got = {(r.g, r["column"], r.share): (r.n, r.value) for r in ranks.order_statistics(df, ["g"], ["a", "b"], shares).collect()}
        assert len(got) == len(groups) * 2 * len(shares)
        for g, vs in groups.items():
            for c, v in (("a", np.sort(vs)), ("b", np.sort(-vs))):
                for s in shares:
                    at = (len(v) - 1) * s
                    low, high = v[math.floor(at)], v[math.ceil(at)]
                    want = low if low == high or at == math.floor(at) else low * (1 - at % 1) + high * (at % 1)
                    n, value = got[g, c, s]
                    assert n == len(v) and (value == pytest.approx(want, rel=1e-12, abs=0) or value == want), (g, c, s)


def test_medians_by_shuffle_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_RANGES", 1)
    rows = [(i % 5, float((i * 37) % 101)) for i in range(400)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    got = {r.g: r.v for r in ranks.medians(df, ["g"], ["v"]).collect()}
    assert got == {g: float(np.median([v for h, v in rows if h == g and v is not None])) if g != 9 else None for g in (0, 1, 2, 3, 4, 9)}
    assert ranks.medians(df.where("false"), [], ["v"]).collect()[0].v is None and ranks.medians(df.where("false"), ["g"], ["v"]).count() == 0
    with pytest.raises(ValueError):
        ranks.order_statistics(df, [], ["v"], [1.5])


# Trees and networks.

def table(spark, n=400, seed=0, distinct=9):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, distinct, (n, 3)).astype(float)
    y = np.where(x[:, 0] > 4, 2.0, -1.0) + 0.3 * x[:, 1] + rng.normal(0, 0.2, n)
    fold = rng.integers(0, 5, n)
    rows = [(i, x[i].tolist(), float(y[i]), int(fold[i])) for i in range(n)]
    return x, y, fold, spark.createDataFrame(rows, "id long, x array<double>, y double, cv_fold int")


@pytest.mark.parametrize("parts", [1, 7])
def test_histogram_tree_splits_as_the_exact_tree(spark, parts):
    x, y, fold, df = table(spark)
    rows = models.model_rows(df.repartition(parts), "id", [F.col("cv_fold")])
    options = {**trees.DEFAULTS["tree"], "depth": 5, "leaf": 7}
    grown = trees.grow_on(rows, [trees.Fit(0, f, options) for f in (0, 1, -1)])
    for f, forest in zip((0, 1, -1), grown):
        exact = local.fit_trees(x[fold != f], y[fold != f], depth=5, leaf=7)

        def same(a, b):
            if isinstance(a, float) or isinstance(b, float):
                assert isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, abs=1e-9)
            else:
                assert a[:2] == b[:2]
                same(a[2], b[2])
                same(a[3], b[3])
        same(forest.trees[0], exact.trees[0])


def test_trees_take_quantile_bins_and_any_pass_size(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(900, 2))
    y = np.sin(6 * x[:, 0]) + x[:, 1]
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 5) for i in range(900)], "id long, x array<double>, y double, cv_fold int").repartition(4)
    rows = models.model_rows(df, "id", [F.col("cv_fold")])
    fits = [trees.Fit(0, 0, trees.DEFAULTS["tree"]), trees.Fit(0, 0, {**trees.DEFAULTS["random_forest"], "trees": 4}), trees.Fit(0, 0, {**trees.DEFAULTS["extra_trees"], "trees": 4})]
    one = trees.grow_on(rows, fits, max_bins=32)
    held = np.arange(900) % 5 == 0
    for m in one:
        assert np.abs(m(x[held]) - y[held]).mean() < 0.35 * np.abs(y[held] - np.median(y)).mean()
    monkeypatch.setattr(trees, "CELLS", 32 * 2 * 3)  # three nodes a pass
    again = trees.grow_on(rows.repartition(2), fits[:1], max_bins=32)
    assert again[0].to_json() == one[0].to_json()
    assert len({str(t) for t in one[1].trees}) == 4 and len({str(t) for t in one[2].trees}) == 4
    drawn = np.concatenate([trees.poisson(np.arange(100_000), t, 1) for t in range(3)])
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02
    with pytest.raises(ValueError):
        trees.grow_on(rows.where("false"), fits)


@pytest.mark.parametrize("model", ["random_forest", "extra_trees"])
def test_a_level_is_one_pass_and_rows_alike_are_added_up_once(spark, monkeypatch, model):
    """Twelve nodes' cells a turn, and more nodes a level: the trees are the same however rows are held."""
    df = spark.range(0, 4000, 1, 3).select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("x"), (F.col("id") % 7 * (F.col("id") % 5) + F.col("id") % 11 / 10).alias("y"), (F.col("id") % 3).cast("int").alias("cv_fold"))
    rows = models.model_rows(df, "id", [F.col("cv_fold")])
    options = {**trees.DEFAULTS[model], "trees": 3, "depth": 5, "features": 1.0}
    fits = [trees.Fit(0, f, options) for f in (0, 1)]
    merge, sizes, passes = trees.alike, [], []
    monkeypatch.setattr(trees, "CELLS", 12 * 2 * 7)
    table = trees.binned(rows, trees.bin_edges(rows, 2))

    def counted(*a):
        out = merge(*a)
        sizes.append(out.count())
        return out
    monkeypatch.setattr(trees, "alike", counted)
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda c, v: passes.append(1) or broadcast(c, v))
    edges = trees.bin_edges(rows, 2)
    one = trees.grow(table, edges, fits)
    assert 105 <= sizes[0] <= 105 + 8 and len(passes) <= 6
    monkeypatch.setattr(trees, "alike", lambda *a: None)
    monkeypatch.setattr(trees, "CHUNK_ROWS", 333)
    assert [m.to_json() for m in trees.grow(table, edges, fits)] == [m.to_json() for m in one]


def test_many_shares_compile_and_are_exact(spark):
    """The bins of a feature ask for 257 shares: the plan's code doesn't grow with them."""
    v = np.random.default_rng(5).normal(size=700)
    df = spark.createDataFrame([(float(a),) for a in v], "v double").repartition(3)
    shares = [i / 256 for i in range(257)]
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = {r.share: (r.n, r.value) for r in ranks.order_statistics(df, [], ["v"], shares).collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert len(got) == 257 and all(got[s] == (700, pytest.approx(np.quantile(v, s), abs=1e-12)) for s in shares)


def test_a_forest_scores_in_as_many_steps_as_it_is_deep(spark):
    """A batch's cost must not follow the number of nodes; predictions are those of the nested trees."""
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(3000, 3))
    forest = local.fit_trees(x, np.sin(9 * x[:, 0]) + x[:, 1], trees=3, depth=9, leaf=2, random_cuts=True)
    compared = []

    class Seen(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *args, **kwargs):
            compared.append(ufunc)
            return getattr(ufunc, method)(*[np.asarray(a) for a in args], **kwargs)

    def one(tree, row):
        while not isinstance(tree, float):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree
    some = np.vstack([x[:200], [[np.nan, 0.5, 0.5], [np.inf, -np.inf, np.nan]]])
    assert forest(some.view(Seen)).tolist() == np.mean([[one(t, row) for row in some] for t in forest.trees], axis=0).tolist()
    assert len(compared) <= 3 * 9
    again = local.Forest.from_json(json.loads(json.dumps(forest.to_json())))
    assert again(some).tolist() == forest(some).tolist() and local.Forest([1.5])(x[:2]).tolist() == [1.5, 1.5] and len(forest(x[:0])) == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_summed_gradients_reach_the_plain_fit(spark, parts):
    x, y, fold, df = table(spark, 200)
    rows = models.model_rows(df.repartition(parts), "id", [F.col("cv_fold")])
    options = {**networks.DEFAULTS, "epochs": 25, "hidden": 5}
    for f, net in zip((1, 3), networks.descend(rows, [networks.Fit(0, g, options) for g in (1, 3)], seed=7)):
        plain = local.fit_mlp(x[fold != f], y[fold != f], hidden=5, epochs=25, seed=7)
        assert all(np.allclose(a, b, atol=1e-8, rtol=0) for a, b in zip(net.weights, plain.weights)) and net.mean == pytest.approx(plain.mean, abs=1e-12)


def test_a_round_of_gradients_reads_rows_alike_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, fold = rng.integers(0, 3, (600, 2)).astype(float), np.arange(600) % 2
    y = 1e6 + x[:, 0] + rng.normal(size=600)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i])) for i in range(600)], "id long, x array<double>, y double, cv_fold int").repartition(3)
    sizes, write = [], networks.written
    monkeypatch.setattr(networks, "BLOCK", 5)

    def counted(table, name):
        out = write(table, name)
        if name == "blocks":
            sizes.append(sum(len(r.n) // 8 for r in out.collect()))
        return out
    monkeypatch.setattr(networks, "written", counted)
    net = networks.descend(models.model_rows(df, "id", [F.col("cv_fold")]), [networks.Fit(0, 1, {**networks.DEFAULTS, "epochs": 12})], seed=3)[0]
    plain = local.fit_mlp(x[fold != 1], y[fold != 1], epochs=12, seed=3)
    assert sizes == [18] and all(np.allclose(a, b, atol=1e-8, rtol=0) for a, b in zip(net.weights, plain.weights))


def test_cross_validation_and_nested_search_agree_with_single_fits(spark):
    x, y, fold, df = table(spark)
    got = {r.id: (r.fold, r.y_pred) for r in models.cross_validate(df, "id", "tree", depth=4).collect()}
    assert len(got) == len(y)
    for f in range(5):
        plain = local.fit_trees(x[fold != f], y[fold != f], depth=4)(x)
        assert all(got[i] == (f, pytest.approx(plain[i], abs=1e-9)) for i in np.flatnonzero(fold == f))
    grouped = df.withColumn("g", (F.col("id") % 23).cast("string")).withColumn("cv_fold", (F.col("id") % 23 % 5).cast("int"))
    out = search.nested_search(grouped, [("tree", {"depth": 1}), ("tree", {"depth": 5}), ("mlp", {"epochs": 3})], "g").collect()
    assert len(out) == 18 and all(r.candidate in (1, 2) for r in out if r.chosen)
    f = np.arange(len(y)) % 23 % 5
    for r in out:
        if r.outer_mae is not None and r.model == "tree":
            plain = local.fit_trees(x[f != r.context], y[f != r.context], depth=5)
            assert r.outer_mae == pytest.approx(np.abs(plain(x[f == r.context]) - y[f == r.context]).mean(), abs=1e-9)


# Sparse ridge.

MODELS = ["alpha turbo", "Beta GT 27 MPG", "gamma", "alpha GT turbo", "", None, "delta sport gamma"]
ENGINES = ["2.0 turbo inline", "V6 GUZZLER", "hybrid v6 turbo", None]


def cars(spark, n=240):
    r = random.Random(5)
    rows = []
    for i in range(n):
        name = r.choice(MODELS)
        name = f"{name} x{i % 40}" if name is not None and r.random() < 0.7 else name
        rows.append((i, r.choice([1.2, 2.0, 3.5, None, float("nan")]), float(r.randint(2000, 2020)), "rare" if i == 0 else r.choice(["ford", "vw", " ", None, "kia"]), name, r.choice(ENGINES), i % 5))
    rows = [(*row, 5.0 + (row[1] if row[1] is not None and row[1] == row[1] else 2.0) + 0.1 * (row[2] - 2010) + (1.5 if row[4] and "turbo" in row[4] else 0.0) + r.gauss(0, 0.3)) for row in rows]
    return rows, spark.createDataFrame(rows, "id long, size double, year double, make string, model_name string, engine_description string, cv_fold int, y double").repartition(4)


def dense_design(rows, words, train, texts, terms_most):
    """The same design over whole arrays; words: (row, text) to its uni- and bigrams."""
    def number(k):
        v = np.array([row[k] if row[k] is not None else np.nan for row in rows], float)
        gap = np.isnan(v)
        middle = np.median(v[train & ~gap])
        cols = [np.where(gap, middle, v)] + ([gap.astype(float)] if gap[train].any() else [])
        return [(c - c[train].mean()) / (c[train].std() or 1.0) for c in cols]
    cols = number(1) + number(2)
    make = np.array([(row[3] or "").strip() or "Unknown" for row in rows])
    cols += [(make == v).astype(float) for v in sorted(set(make[train]))]
    for t in texts:
        tf, df = Counter(), Counter()
        for i in np.flatnonzero(train):
            tf.update(words[i, t])
            df.update(set(words[i, t]))
        top = sorted(sorted(tf, key=lambda w: (-tf[w], w))[:terms_most])
        block = np.array([[(1 + math.log(c[w])) * (math.log((1 + train.sum()) / (1 + df[w])) + 1) if c[w] else 0.0 for w in top] for c in (Counter(words[i, t]) for i in range(len(rows)))])
        norm = np.sqrt((block**2).sum(axis=1))
        cols += list((block / np.where(norm > 0, norm, 1)[:, None]).T)
    return np.stack(cols, axis=1)


@pytest.mark.parametrize("most,heavy", [(5000, 256), (5000, 9), (12, 256)])
def test_text_ridge_equals_a_dense_solve(spark, monkeypatch, most, heavy):
    monkeypatch.setattr(sparse, "HEAVY", heavy)
    rows, df = cars(spark)
    words = {}
    for t in ("model_name", "engine_description"):
        for r in df.select("id", tokens(sanitize(F.col(t))).alias("w")).collect():
            words[r.id, t] = list(r.w) + [f"{a} {b}" for a, b in zip(r.w, r.w[1:])]
    design = sparse.Design(["size", "year"], ["make"], ["model_name", "engine_description"], max_features=most).fit(df, 5)
    held = design.rows(df, ["id"], "y")
    arms = {"structured": (), "structured_model": (0,), "structured_engine": (1,), "structured_model_engine": (0, 1)}
    systems = [sparse.System(s, t, a) for s in (0, 3, 5) for t in arms.values() for a in (0.1, 10.0)]
    fitted = sparse.solve(held, design, systems)
    y, fold = np.array([r[7] for r in rows]), np.array([r[6] for r in rows])
    for system, fit in zip(systems, fitted):
        train = fold != system.set
        x = dense_design(rows, words, train, [design.texts[t] for t in system.texts], most)
        centre = x[train].mean(0)
        xc = x[train] - centre
        w = np.linalg.solve(xc.T @ xc + system.alpha * np.eye(x.shape[1]), xc.T @ (y[train] - y[train].mean()))
        want = (x - centre) @ w + y[train].mean()
        got = {r.id: r.y_pred for r in sparse.predict(held, design, system, fit, ["id"]).collect()}
        assert np.allclose([got[i] for i in range(len(rows))], want, atol=1e-8, rtol=0), system
    grid = sparse.text_ridge_grid(df, sparse.Design(["size", "year"], ["make"], ["model_name", "engine_description"], max_features=most),
                                  {a: [design.texts[t] for t in k] for a, k in arms.items()}, [0.1, 10.0], "y").collect()
    assert len(grid) == 8 and sum(r.arm_choice for r in grid) == 4 and sum(r.selected for r in grid) == 1
    best = next(r for r in grid if r.model == "structured_model" and r.alpha == 10.0)
    maes = []
    for f in range(5):
        train = fold != f
        x = dense_design(rows, words, train, ["model_name"], most)
        xc = x[train] - x[train].mean(0)
        w = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(x.shape[1]), xc.T @ (y[train] - y[train].mean()))
        maes.append(np.abs((x[~train] - x[train].mean(0)) @ w + y[train].mean() - y[~train]).mean())
    assert best.mae_mean == pytest.approx(np.mean(maes), abs=1e-8) and best.mae_std == pytest.approx(np.std(maes), abs=1e-8)


def test_text_ridge_without_words_or_rows(spark):
    df = spark.createDataFrame([(i, float(i), "GUZZLER" if i % 2 else None, i % 2, float(i)) for i in range(20)], "id long, v double, t string, cv_fold int, y double")
    grid = sparse.text_ridge_grid(df, sparse.Design(["v"], [], ["t"]), {"plain": [], "text": ["t"]}, [1.0], "y", folds=2).collect()
    assert grid[0].mae_mean == pytest.approx(grid[1].mae_mean)
    with pytest.raises(ValueError):
        sparse.text_ridge_grid(df, sparse.Design(["v"], [], []), {"plain": []}, [0.0], "y")
    with pytest.raises(ValueError):
        sparse.text_ridge_grid(df, sparse.Design(["v"], [], []), {"plain": []}, [1.0], "y", folds=1)


# Neighbours.

@pytest.mark.parametrize("rows,parts,queries", [(4096, 256, 4096), (16, 8, 7)])
def test_nearest_equals_brute_force(spark, monkeypatch, rows, parts, queries):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", rows)
    monkeypatch.setattr(neighbours, "PIVOTS", parts)
    monkeypatch.setattr(neighbours, "PART_QUERIES", queries)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(700, 3)), np.zeros((300, 3)), np.round(rng.normal(size=(300, 3)))])  # a third at one point, and many ties
    y, q = rng.normal(size=len(x)), np.concatenate([rng.normal(size=(60, 3)), np.zeros((40, 3)), 9 + rng.normal(size=(5, 3))])
    train = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(9999, None, 1.0)], "id long, x array<double>, y double").repartition(5)
    asked = spark.createDataFrame([(i // 2, v.tolist()) for i, v in enumerate(q)] + [(7777, None)], "id long, x array<double>")
    got = sorted((r.id, r.y_pred) for r in neighbours.nearest(train, asked, "id", "x", "y", k=15).collect())
    want = []
    for i, p in enumerate(q):
        d = np.sqrt(((x - p) ** 2).sum(1))
        best = np.lexsort((np.arange(len(x)), d))[:15]
        zero = best[d[best] == 0]
        want.append((i // 2, y[zero].mean() if len(zero) else (y[best] / d[best]).sum() / (1 / d[best]).sum()))
    want.sort()
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
    assert neighbours.nearest(train.limit(4), asked, "id", "x", "y", k=15).count() == len(q) and neighbours.nearest(train.where("false"), asked, "id", "x", "y").count() == 0


def test_silhouette_over_many_tiles_nulls_and_single_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, ["a", "b", "c"][i % 3], (rng.normal(size=4) + i % 3).tolist()) for i in range(500)] + [(600, "single", [9.0] * 4), (601, None, [0.0] * 4), (602, "a", None)]
    df = spark.createDataFrame(rows, "id long, c string, x array<double>")
    x, c = np.array([r[2] for r in rows[:501]]), np.array([r[1] for r in rows[:501]])
    for size in (32 << 20, 4 * 8 * 60):
        monkeypatch.setattr(neighbours, "TILE_BYTES", size)
        got = {r.id: r.silhouette for r in models.silhouette(df, "id", "x", "c").collect()}
        assert len(got) == 503 and got[600] == got[601] == got[602] == 0.0
        for i in (0, 1, 2, 77, 499):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            own = d[c == c[i]].sum() / ((c == c[i]).sum() - 1)
            far = min(d[c == k].mean() for k in set(c) - {c[i]})
            assert got[i] == pytest.approx((far - own) / max(own, far), abs=1e-9)


def test_a_tile_pair_holds_few_distances_at_once():
    rng = np.random.default_rng(5)
    a, b = (pa.table({"id": np.arange(at, at + 20_000), "c": rng.integers(0, 5, 20_000), "p": pa.array(list(rng.normal(size=(20_000, 3))))}) for at in (0, 20_000))
    tracemalloc.start()
    neighbours.tile_sums(a, b, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # 512 rows against a tile are 82 MB, several times over


def test_silhouette_of_repeated_ids_and_many_clusters(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i // 2 if i < 40 else i, int(c), [float(v) for v in p]) for i, (c, p) in enumerate(zip(rng.integers(0, 150, 700), rng.normal(size=(700, 3))))]
    df = spark.createDataFrame(rows, "id long, c int, x array<float>").repartition(3)
    x, c, ids = np.array([r[2] for r in rows], np.float32).astype(float), np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    for cells in (1 << 21, 900):
        monkeypatch.setattr(neighbours, "TILE_SUMS", cells)
        got = {(r.id, r.c, r.other): (r.n, r.total) for r in neighbours.cluster_distances(df, "id", "x", "c").collect()}
        want = Counter(), Counter()
        for i in range(len(rows)):
            for j in np.flatnonzero(ids != ids[i]):
                want[0][ids[i], c[i], c[j]] += 1
                want[1][ids[i], c[i], c[j]] += np.sqrt(((x[i] - x[j]) ** 2).sum())
        assert {k: v[0] for k, v in got.items()} == dict(want[0]) and all(got[k][1] == pytest.approx(v, abs=1e-6) for k, v in want[1].items())


def test_kmeans_with_tasks_without_rows_and_odd_vectors(spark):
    x = F.array((F.col("id") % 2 * 10).cast("double"), F.col("id") / 100)
    df = spark.range(0, 40, 1, 3).select("id", x.alias("x")).unionByName(spark.range(0, 0, 1, 2).select("id", x.alias("x")))
    odd = spark.createDataFrame([(90, None), (91, [None, 1.0]), (92, [float("nan"), 1.0]), (93, [float("-inf"), 1.0])], "id long, x array<double>")
    found = models.kmeans_each(df.unionByName(odd), "x", [2, 3], seeds=3)
    centres, cost = found[2]
    assert sorted(np.round(c, 9).tolist() for c in centres) == [[0.0, 0.19], [10.0, 0.2]] and cost == pytest.approx(sum((i // 2 * 0.02 - 0.19) ** 2 for i in range(0, 40, 2)) * 2)
    single = models.kmeans(df.where("id < 40"), "x", 3, seeds=3)
    assert np.allclose(found[3][0], single[0]) and found[3][1] == pytest.approx(single[1]) and found[3][1] < cost
    with pytest.raises(ValueError):
        models.kmeans(odd, "x", 2)


def plain_silhouette(x, own):
    out = []
    for i in range(len(x)):
        d, n = np.sqrt(((x - x[i]) ** 2).sum(1)), np.bincount(own)
        mean = {c: d[own == c].sum() / (n[c] - (c == own[i])) for c in set(own.tolist()) if n[c] > (c == own[i])}
        near = mean.pop(own[i], None)
        far = min(mean.values())
        out.append(0.0 if near is None or max(near, far) == 0 else (far - near) / max(near, far))
    return np.mean(out)


def test_kmeans_select_scores_every_row(spark, tmp_path):
    rng = np.random.default_rng(7)
    own = np.arange(6_001) % 3
    x = (rng.normal(size=(6_001, 2)) * 2 + np.array([[0, 0], [40, 0], [0, 60]])[own]).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.k: r for r in queries.QUERIES["kmeans_select"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6] and [k for k in got if got[k].chosen] == [3]
    x = x.astype(float)
    assert got[3].cost == pytest.approx(sum(((x[own == c] - x[own == c].mean(0)) ** 2).sum() for c in range(3)), rel=1e-9)
    assert got[3].silhouette == pytest.approx(plain_silhouette(x, own), abs=1e-9)


def test_kmeans_starts_see_rows_beyond_any_sample(spark):
    near = spark.range(25_000).select(F.array((F.col("id") % 2 * 10 + F.col("id") / 25_000).cast("double"), F.lit(0.0)).alias("x"))
    late = spark.range(1_000).select(F.array(F.lit(400.0), F.col("id").cast("double")).alias("x")).orderBy(F.desc(F.xxhash64("x"))).limit(1).collect()[0].x
    df = near.unionByName(spark.createDataFrame([(late,)], "x array<double>"))
    centres, cost = models.kmeans(df, "x", 3, seeds=2)
    assert any(c.tolist() == late for c in centres) and cost < 25_000 / 11


@pytest.mark.parametrize("size", [32 << 20, 3 * 8 * 60])
def test_mean_silhouettes_of_copies_tiles_and_odd_clusters(spark, monkeypatch, size):
    monkeypatch.setattr(neighbours, "TILE_BYTES", size)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(300, 3)), np.full((50, 3), 0.5), [[90.0, 0.0, 0.0]]]) + 1e6  # copies, a cluster of one row, all far from zero
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), ([None, 1.0, 1.0],), ([float("nan")] * 3,)], "x array<double>").repartition(3)
    fits = {k: (np.concatenate([x[:k - 1], x[-1:]]), 0.5 * k) for k in (1, 2, 4)} | {3: (np.array([x[0], x[-1], [-9e9] * 3]), 1.5)}
    got = {r.k: r for r in models.mean_silhouettes(df, "x", fits).collect()}
    assert got[1].silhouette is None and {k: got[k].cost for k in got} == {1: 0.5, 2: 1.0, 3: 1.5, 4: 2.0}
    for k in (2, 3, 4):
        own = ((x[:, None] - fits[k][0][None]) ** 2).sum(-1).argmin(1)
        assert got[k].silhouette == pytest.approx(plain_silhouette(x, own), abs=1e-7)


def test_kmeans_of_few_or_uneven_points(spark):
    same = spark.createDataFrame([([1.0, 2.0],)] * 5, "x array<double>")
    fits = models.kmeans_each(same, "x", [2, 3], seeds=2)
    assert all(cost == 0 for _, cost in fits.values()) and all(r.silhouette is None for r in models.mean_silhouettes(same, "x", fits).collect())
    pair = spark.createDataFrame([([0.0],), ([1.0],)], "x array<double>")  # as many clusters as rows
    assert [r.silhouette for r in models.mean_silhouettes(pair, "x", models.kmeans_each(pair, "x", [2], seeds=2)).collect()] == [None]
    with pytest.raises(ValueError):
        models.kmeans(spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "x array<double>"), "x", 2)


# Folds, orders.

def plain_folds(sizes, k):
    weight, out = [0] * k, {}
    for name, n in sorted(sorted(sizes.items(), key=lambda s: s[0], reverse=True), key=lambda s: -s[1]):
        f = min(range(k), key=lambda j: (weight[j], j))
        out[name] = f
        weight[f] += n
    return out


def test_group_folds_equal_the_plain_greedy(spark):
    r = random.Random(6)
    for trial in range(4):
        sizes = {f"g{i:03d}": r.choice([1, 1, 1, 2, 3, r.randint(1, 60)]) for i in range(r.randint(5, 120))}
        if trial == 3:
            sizes["hot"] = 900
        df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string").repartition(3)
        assert {x.g: x.cv_fold for x in split.group_folds(df, "g", 5).collect()} == plain_folds(sizes, 5)
    with pytest.raises(ValueError):
        split.group_folds(df.where("g = 'hot'"), "g", 5)


def test_fold_runs_over_all_small_cases():
    r = random.Random(7)
    for _ in range(300):
        k = r.randint(1, 6)
        sizes = sorted(((s, r.randint(1, 9)) for s in r.sample(range(1, 12), r.randint(1, 5))), reverse=True)
        want = plain_folds({(s, i): s for s, n in sizes for i in range(n)}, k)
        runs = split.fold_runs(sizes, k)
        for s, n in sizes:
            mine = [(first, folds) for size, first, folds in runs if size == s]
            for place in range(n):
                first, folds = [m for m in mine if m[0] <= place][-1]
                assert folds[(place - first) % len(folds)] == want[s, n - 1 - place]


def test_shuffle_split_and_batches_equal_the_plain_ones(spark):
    groups = [f"g{i}" for i in range(57)]
    df = spark.createDataFrame([(g,) for g in groups for _ in range(2)], "g string").repartition(3)
    order_ = np.random.RandomState(42).permutation(57)[:12]
    got = {r.g: r.split for r in split.shuffle_split(df, "g").collect()}
    assert got == {g: "test" if i in order_ else "train" for i, g in enumerate(sorted(groups))}
    rows = [(q, i) for q in range(9) for i in range(1 if q else 40)]
    out = order.batches(spark.createDataFrame(rows, "q int, i int"), "q", "i", 4).collect()
    want = sorted(((i + 1, q) for q in range(9) for i in range(1 if q else 40)))
    assert [(r.turn, r.q) for r in sorted(out, key=lambda r: r.seq)] == want and [r.seq for r in sorted(out, key=lambda r: r.seq)] == list(range(1, 49))
    assert all(r.batch == (r.seq - 1) // 4 for r in out)


# Pages, names, stages.

class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag))

    def handle_endtag(self, tag):
        self.events.append(("close", tag))

    def handle_data(self, data):
        self.events.append(("text", data))


def joined(events):
    out = []
    for kind, value in events:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = (kind, out[-1][1] + value)
        elif value:
            out.append((kind, value))
    return out


def test_tag_events_equal_the_standard_parser():
    parts = ["<li>", "</li>", "<ul>", "</ul>", "<div>", "</div>", "<b>", "</b>", "<LI class=x>", "</Li >", '<div id="a>b">', "<a href='x>y' t>", "<br/>", "<li/>", "<img src=a/>", "text ", "a - b ", "comb08 - combined &amp; more", "&lt;", "&#39;",
             "&nbsp;", "&copy", "&unknown;", "&#x41;", "<!-- c <li> -->", "<!DOCTYPE html>", "<?php x ?>", '<script>var a="<li>";</script>', "<style>li{}</style>", "1 < 2 ", "a<b ", "</ >", "\n", "  ", "<p/ x>", "é", "<SCRIPT>x</script >", "&amp", "<li\n>", '<li foo="1" bar>', "</>", "< li>", "<li a=b/c>"]
    r = random.Random(8)
    for _ in range(6000):
        html = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        plain = Plain()
        plain.feed(html)
        plain.close()
        assert joined(markup.events(html)) == joined(plain.events), html


def test_list_descriptions_of_nested_pages(spark):
    html = "<ul><li>comb08 - combined &amp; <b>more</b><ul><li>city08 - city</li></ul> late</li><!-- <li>no - no</li> --><li>x1 - a<div>hidden</div>b</li><li>comb08 - again</li></ul>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<li>never closed"), (4, "<li>A_1  -\n&eacute;t&eacute;</li></li>")], "id int, html string")
    keyed = [(r.id, r.key, r.meaning) for r in markup.list_descriptions(df, "id", "html").orderBy("id", "position").collect()]
    assert keyed == [(1, "city08", "city"), (1, "comb08", "combined & more"), (1, "x1", "a"), (4, "A_1", "été")]
    every = [(r.position, r.meaning) for r in markup.list_descriptions(df, "id", "html", keyed=False).where("id = 1").orderBy("position").collect()]
    assert [p for p, _ in every] == list(range(len(every))) and "no - no" not in {m for _, m in every}
    begun = "<li>" * 50_000 + "<a " * 50_000 + "<li x='" * 50_000 + "=" * 100_000
    assert markup.closed_items(begun) == []


def test_menu_files_and_component_ids_follow_their_json(spark):
    import hashlib
    import json
    assert files.menu_file("model", {"year": "2019", "make": "Citroën"}) == "menus/model_f2d8856e4191c046.json"
    assert files.menu_file("year") == "menus/year.json" and files.menu_file("make", {"year": 2015}) != files.menu_file("make", {"year": "2015"})
    df = spark.createDataFrame([("Citroën", "C4", "c4|x"), ("Citroën", "C4", "c4"), ("Citroën", "C4 Cactus", "c4")], "make string, name string, base string")
    got = families.alias_components(df, "make", "name", "base").collect()
    assert {r.component_id for r in got} == {hashlib.sha256(json.dumps(["citroën", ["c4", "c4|x"]], separators=(",", ":")).encode()).hexdigest()[:20]}


def test_a_fitted_pipeline_is_saved_and_loaded(spark, tmp_path):
    train = spark.createDataFrame([(1, "a", 1.0, "Alpha Turbo GUZZLER 27 MPG"), (2, "b", None, "Beta alpha EcoBoost"), (3, "a", 3.0, None)], "id int, c string, v double, text string")
    stages = [ml.LeakSanitizer(inputCol="text", outputCol="clean"), ml.FeatureEncoder(numeric=["v"], categorical=["c"], outputCol="x"), ml.SafeTfidf(inputCol="clean", outputCol="w", sparse=True)]
    fitted = Pipeline(stages=stages).fit(train)
    fitted.write().overwrite().save(f"{tmp_path}/p")
    loaded = PipelineModel.load(f"{tmp_path}/p")
    new = spark.createDataFrame([(9, "z", None, "validationonly beta 88 MPG")], train.schema).unionByName(train)
    assert loaded.transform(new).collect() == fitted.transform(new).collect()
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
    row = loaded.transform(new).where("id = 9").first()
    assert row.w.size == 7 and len(row.w.indices) == 1 and row.w["values"] == [1.0]
    dense = ml.SafeTfidf(inputCol="text", outputCol="w").fit(train)
    dense.save(f"{tmp_path}/d")
    assert ml.SafeTfidfModel.load(f"{tmp_path}/d").transform(new).collect() == dense.transform(new).collect()
    with pytest.raises(Exception):
        fitted.save(f"{tmp_path}/p")
