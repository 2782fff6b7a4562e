"""Rank selection, boosting, Shapley values, bootstrap and block selection against plain versions."""

import inspect
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshquill.operators import boosting, forest, models, ranks, ratings, shap
from meshquill.plans import queries


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    n = 3001
    frame = pd.DataFrame({
        "normal": rng.normal(size=n), "skewed": np.exp(8 * rng.normal(size=n)), "whole": rng.integers(0, 5, n).astype(float), "one": np.ones(n), "outlier": np.r_[rng.normal(size=n - 2), 1e300, -1e300],
        "narrow": 1e9 + rng.normal(scale=1e-6, size=n), "gaps": np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)), "empty": np.full(n, np.nan), "pair": np.r_[1.0, 2.0, np.full(n - 2, np.nan)],
    })
    df = spark.createDataFrame(frame).select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame.columns))
    for share in (0.5, 0.0, 1.0, 0.9, 0.123):
        got = ranks.quantiles(df, list(frame.columns), share)
        for c in frame.columns:
            v = frame[c].dropna()
            assert got[c] == pytest.approx(np.quantile(v, share), rel=1e-12) if len(v) else got[c] is None
    wide = spark.createDataFrame(pd.DataFrame(rng.normal(size=(500, 70)), columns=[f"f{i}" for i in range(70)]))
    assert np.allclose(list(ranks.quantiles(wide, wide.columns).values()), np.median(wide.toPandas(), axis=0))
    assert ranks.quantiles(df.where("false"), ["one"]) == {"one": None} and ranks.quantiles(df, []) == {}


def test_global_rank_is_one_order(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    assert all(r["rank"] == r["v"] for r in ranks.global_rank(df, F.col("v")).collect())


def exact_boosting(x, y, rounds, depth, rate, l2):
    """Every value is a cut; the first feature and the smallest cut on ties."""
    base = y.mean()
    p = np.full(len(y), base)
    for _ in range(rounds):
        g = p - y
        nodes = {0: np.arange(len(y))}
        for level in range(depth):
            for i in [k for k in nodes if (1 << level) - 1 <= k < (1 << level + 1) - 1]:
                rows, best = nodes[i], (1e-9, None)
                score = lambda r: g[r].sum() ** 2 / (len(r) + l2)  # noqa: B023, E731
                for f in range(x.shape[1]):
                    for t in np.unique(x[:, f])[:-1]:
                        a, b = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                        if len(a) and len(b) and (gain := score(a) + score(b) - score(rows)) > best[0] + 1e-12:
                            best = (gain, (a, b))
                if best[1]:
                    nodes[2 * i + 1], nodes[2 * i + 2] = best[1]
        for i, rows in nodes.items():
            if 2 * i + 1 not in nodes:
                p[rows] -= rate * g[rows].sum() / (len(rows) + l2)
    return p


def test_boosting_equals_exact_search(spark, monkeypatch):
    monkeypatch.setattr(boosting, "SPAN", 3)  # predictions are brought up to date in between
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(60, 3)), 2)
    y = 2 * x[:, 0] - (x[:, 1] > 0) + 0.1 * rng.normal(size=60)
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=["a", "b", "c", "mean_rating"]))
    model = boosting.fit_boosted(df, ["a", "b", "c"], "mean_rating", rounds=8, rate=0.3, rows=1.1, columns=1.0)
    got = model.transform(df).select("a", "b", "c", "predicted").toPandas()
    want = exact_boosting(x, y, 8, 3, 0.3, 2.0)
    joined = got.merge(pd.DataFrame(np.c_[x, want], columns=["a", "b", "c", "want"]), on=["a", "b", "c"])
    assert len(joined) == 60 and np.allclose(joined.predicted, joined.want)
    assert model.gains().sum() == pytest.approx(1) and model.gains()[2] < 0.2


def test_boosting_takes_all_rounds_from_cells(spark, monkeypatch):
    """The query fits the library's 600 rounds; rows alike in all bins are one cell, and a span of trees takes one pass over rows."""
    asked = []

    def fit(train, features, name, **options):
        asked.append({**options, "name": name})
        raise StopIteration

    monkeypatch.setattr(models, "fit", fit)
    with pytest.raises(StopIteration):
        queries.QUERIES["gbt"](spark, "/root/testdata/sf0.001")
    assert asked == [{"name": "gbt", "weight": "n_ratings"}] and inspect.signature(boosting.fit_boosted).parameters["rounds"].default == 600
    monkeypatch.undo()
    rng = np.random.default_rng(6)
    x = np.repeat(rng.integers(0, 4, size=(20, 2)), 30, axis=0).astype(float)
    y = x[:, 0] + 2 * (x[:, 1] > 1) + rng.normal(size=600)
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=["a", "b", "mean_rating"]))
    table, cells, n = boosting.clustered(df, ["a", "b"], "mean_rating", None, boosting.cut_points(df, ["a", "b"]))
    assert n == 600 and cells == len(np.unique(x, axis=0)) * max(1, cells // len(np.unique(x, axis=0))) and table.count() == 600
    monkeypatch.setattr(boosting, "STEP", 3)
    model = boosting.fit_boosted(df, ["a", "b"], "mean_rating", rounds=8, rate=0.3, rows=1.1, columns=1.0)
    got = model.transform(df).groupBy("a", "b").agg(F.first("predicted").alias("predicted")).toPandas()
    want = pd.DataFrame(np.c_[x, exact_boosting(x, y, 8, 3, 0.3, 2.0)], columns=["a", "b", "want"]).drop_duplicates(["a", "b"])
    joined = got.merge(want, on=["a", "b"])
    assert len(joined) == len(want) and np.allclose(joined.predicted, joined.want)


def exact_tree(x, y, count, depth):
    """Predictions of one tree on one feature, by trying each cut of each node over rows that count so many times."""
    p, nodes = np.zeros(len(x)), [(np.arange(len(x)), 0)]
    score = lambda r: (count[r] * y[r]).sum() ** 2 / count[r].sum()
    while nodes:
        rows, level = nodes.pop()
        p[rows] = (count[rows] * y[rows]).sum() / count[rows].sum()
        best = (1e-9, None)
        for t in np.unique(x[rows])[:-1] if level < depth else []:
            a, b = rows[x[rows] <= t], rows[x[rows] > t]
            if min(count[a].sum(), count[b].sum()) >= 2 and (gain := score(a) + score(b) - score(rows)) > best[0] + 1e-12:
                best = (gain, (a, b))
        nodes += [(r, level + 1) for r in best[1] or ()]
    return p


def test_forest_takes_all_trees_and_equals_exact_search(spark, monkeypatch):
    """The query fits the library's 500 trees; with one feature each tree is that of exact search over the rows that it drew."""
    asked = []

    def fit(train, features, name, **options):
        asked.append({**options, "name": name})
        raise StopIteration

    monkeypatch.setattr(models, "fit", fit)
    with pytest.raises(StopIteration):
        queries.QUERIES["random_forest"](spark, "/root/testdata/sf0.001")
    assert asked == [{"name": "random_forest", "weight": "n_ratings"}] and inspect.signature(forest.fit_forest).parameters["trees"].default == 500
    monkeypatch.undo()
    rng = np.random.default_rng(7)
    x = rng.integers(0, 20, 300).astype(float)
    y = np.sin(x) + rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"a": x, "mean_rating": y}))
    df = df.unionByName(df.where("a < 3"))  # equal rows are drawn by their number
    model = forest.fit_forest(df, ["a"], "mean_rating", trees=4)
    rows = df.groupBy("a", "mean_rating", F.xxhash64("a", "mean_rating").alias("key")).count().toPandas()
    count = forest.poisson_draws(rows["key"].to_numpy().view(np.uint64) + np.uint64(42 * 1_000_003), rows["count"].to_numpy(), 4)
    want = np.mean([exact_tree(rows["a"].to_numpy(), rows["mean_rating"].to_numpy(), count[:, t], 5) for t in range(4)], axis=0)
    got = model.transform(rows_df := spark.createDataFrame(rows[["a", "mean_rating"]])).toPandas()["predicted"].to_numpy()
    assert rows_df.count() == len(rows) and np.allclose(got, want)
    full = models.fit(df.withColumns({"b": F.rand(1), "n": F.lit(2.0)}), ["a", "b"], "random_forest", weight="n").model.trees
    assert len(full) == 500 and abs(np.mean([t[0]["cover"] for t in full]) / (2 * df.count()) - 1) < 0.02 and len({str(t) for t in full}) == 500


def test_boosting_samples_rows_and_columns_and_is_saved(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, x[:, 0] + x[:, 1] * x[:, 2]], columns=["a", "b", "c", "d", "mean_rating"])).withColumn("w", F.lit(2.0))
    fitted = models.fit(df, ["a", "b", "c", "d"], "gbt", weight="w", rounds=30)
    assert len(fitted.model.trees) == 30 and all(n["cover"] < 2 * 400 * 0.95 for t in fitted.model.trees for n in t.values())
    assert any({n["feature"] for n in t.values() if "feature" in n} <= {0, 1, 2} for t in fitted.model.trees)
    first = models.predictions(fitted, df).agg(F.avg(F.abs("error"))).first()[0]
    assert first < df.agg(F.avg(F.abs("mean_rating"))).first()[0]
    fitted.save(f"{tmp_path}/m", spark)
    again = models.Fitted.load(f"{tmp_path}/m", spark)
    assert models.predictions(again, df).agg(F.avg(F.abs("error"))).first()[0] == pytest.approx(first)
    values = shap.shap_values(fitted, df.withColumn("k", F.monotonically_increasing_id()), str(tmp_path), ["k"])
    sums = values.groupBy("k").agg(F.sum("shap").alias("s")).toPandas().sort_values("k")["s"].to_numpy()
    predicted = fitted.transform(df.withColumn("k", F.monotonically_increasing_id())).select("k", "predicted").toPandas().sort_values("k")["predicted"].to_numpy()
    assert np.ptp(predicted - sums) < 1e-9  # they differ by the expected prediction alone


def enumerated(predict, row, background):
    """Shapley values by all sets of features."""
    d = len(row)
    value = lambda s: np.mean([predict(np.where(np.isin(np.arange(d), s), row, b)) for b in background])
    return [sum(factorial(k) * factorial(d - 1 - k) / factorial(d) * (value([*s, i]) - value(list(s))) for k in range(d) for s in combinations([j for j in range(d) if j != i], k)) for i in range(d)]


@pytest.mark.parametrize("name", ["ridge", "linear"])
def test_shapley_values_of_linear_models(spark, name):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame(pd.DataFrame(np.c_[np.arange(40), x, x @ [1, -2, 0.5] + rng.normal(size=40)], columns=["k", "a", "b", "c", "mean_rating"]))
    fitted = models.fit(df, ["a", "b", "c"], name)
    got = shap.shap_values(fitted, df, "", ["k"]).toPandas().pivot(index="k", columns="feature", values="shap").to_numpy()
    p = fitted.transform(df).orderBy("k").toPandas()["predicted"].to_numpy()
    slope = np.linalg.lstsq(np.c_[x, np.ones(40)], p, rcond=None)[0]
    assert np.allclose(got[:3], [enumerated(lambda v: v @ slope[:3] + slope[3], x[i], x) for i in range(3)]) and np.allclose(got.sum(axis=1), p - p.mean())
    assert shap.shap_importance(shap.shap_values(fitted, df, "", ["k"])).first()["feature"] == "b"


def test_sampled_shapley_values_of_any_model(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3))
    df = spark.createDataFrame(pd.DataFrame(np.c_[np.arange(30), x], columns=["k", "a", "b", "c"]))

    class Product:
        name, features, values = "product", ["a", "b", "c"], {"a": 0.0, "b": 0.0, "c": 0.0}

        def transform(self, frame):
            return frame.withColumn("predicted", F.col("a") * F.col("b") + F.col("c"))

    one = spark.createDataFrame([(0.5, -1.0, 2.0)], "a double, b double, c double")
    got = shap.sampled_shap(Product(), df, one, ["k"], pairs=24).toPandas().pivot(index="k", columns="feature", values="shap").to_numpy()
    want = np.array([enumerated(lambda v: v[0] * v[1] + v[2], row, [np.array([0.5, -1.0, 2.0])]) for row in x])
    assert np.allclose(got, want)  # pairs of a permutation and its reverse are exact where features meet in twos
    many = shap.sampled_shap(Product(), df, df, ["k"], pairs=30, most=30).toPandas().groupby("k")["shap"].sum().to_numpy()
    p = x[:, 0] * x[:, 1] + x[:, 2]
    assert np.allclose(many, p - p.mean())


def test_bootstrap_adds_up_in_parts(spark):
    rng = np.random.default_rng(5)
    rows = [("small", f"r{i}", float(v)) for i, v in enumerate(rng.integers(1, 10, 40))] + [("large", f"r{i}", float(v)) for i, v in enumerate(rng.normal(5, 2, 2000))] + [("one", "r", 3.0), (None, "r", 1.0), (None, "s", 2.0)]
    df = spark.createDataFrame(rows, "participant_id string, rater_id string, rating double")
    whole = {r["participant_id"]: r for r in ratings.bootstrap(df, resamples=2000).collect()}
    parts = {r["participant_id"]: r for r in ratings.bootstrap(df, resamples=2000, chunk=100).collect()}
    assert set(whole) == {"small", "large", "one", None} and whole["one"]["boot_low"] is None and whole["one"]["n_ratings"] == 1
    for p in ("small", "large"):
        v = np.array([r[2] for r in rows if r[0] == p])
        means = rng.choice(v, (4000, len(v))).mean(axis=1)
        error = 0.25 * v.std() / np.sqrt(len(v))  # a quarter of the standard error: noise of 2,000 resamples at the tails, and the larger spread of Poisson weights
        for name, share in (("boot_low", 0.025), ("boot_high", 0.975)):
            assert whole[p][name] == pytest.approx(parts[p][name], rel=1e-9) and abs(whole[p][name] - np.quantile(means, share)) < error


def plain_block(cells):
    raters = sorted({r for _, r in cells})
    whole = True
    while len(raters) >= 2:
        part = {(p, r) for p, r in cells if r in raters}
        full = {p for p, _ in part if sum((p, r) in part for r in raters) == len(raters)}
        if len(full) >= 2:
            return {(p, r) for p, r in part if p in full}, whole
        raters.remove(min(raters, key=lambda r: (sum(x == r for _, x in part), raters.index(r))))
        whole = False
    return set(), False


@pytest.mark.parametrize("seed", range(6))
def test_block_equals_dropping_raters_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    cells = {(p, r) for p in range(8) for r in range(6) if rng.random() < [0.3, 0.5, 0.7, 0.9, 0.97, 0.1][seed]}
    df = spark.createDataFrame([(p, r, 1.0) for p, r in cells] or [(0, 0, None)], "participant_id long, rater_id long, rating double")
    block, whole = ratings.complete_block(df)
    assert ({(r["participant_id"], r["rater_id"]) for r in block.collect()}, whole) == plain_block(cells)


def test_block_of_ten_thousand_raters(spark):
    rows = spark.range(10_000).select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("participant_id"), F.col("id").alias("rater_id"), F.lit(1.0).alias("rating"))
    rows = rows.where("NOT (participant_id = 3 AND rater_id % 10 = 0) AND NOT (participant_id > 0 AND rater_id = 77)")
    block, whole = ratings.complete_block(rows)
    assert not whole and block.count() == 3 * 9_999
