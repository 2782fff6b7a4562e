"""Corrected frames, floors and statistics; stores, models and commands, each written and read back; models against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquill import cli
from meshquill.functions.special import t_quantile
from meshquill.operators import features, hull, metrics, models, normalise, ratings, shap, splits, symmetry
from meshquill.sources import captures as c
from meshquill.sources import stores

P, T = [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [0.3, 0.2, 0.9]], [0, 1, 2, 0, 2, 3, 1, 2, 4]


def grid(n=9):
    x, y = np.meshgrid(np.linspace(-1, 1, n), np.linspace(-1.2, 1.2, n))
    points = np.c_[x.ravel(), y.ravel(), 0.5 - 0.2 * x.ravel() ** 2 - 0.1 * y.ravel() ** 2]
    quads = [(r * n + k, r * n + k + 1, (r + 1) * n + k, (r + 1) * n + k + 1) for r in range(n - 1) for k in range(n - 1)]
    return points, np.array([t for a, b, d, e in quads for t in ((a, b, d), (b, e, d))])


def test_floor_is_conservative_on_real_asymmetry():
    points, triangles = grid()
    points[points[:, 0] > 0, 2] -= 0.1
    near, exact = symmetry.measure(points, triangles, surface=False), symmetry.measure(points, triangles)
    assert not near["exceeds_floor"] and near["effective_floor"] == pytest.approx(near["discretization_floor"] * (1 - near["pairing"]))
    assert exact["exceeds_floor"] and exact["effective_floor"] == 0.0


def test_moving_queries_find_the_nearest():
    rng = np.random.default_rng(9)
    points = rng.normal(size=(300, 3))
    queries, moving = rng.normal(size=(200, 3)), symmetry.NearestOfMoving(points, 8)
    for scale in (0.0, 0.001, 0.05, 0.5, 3.0, 0.001):
        queries = queries + rng.normal(scale=scale, size=queries.shape)
        assert np.array_equal(moving(queries), symmetry.nearest(queries, points)[0][:, 0])


def test_world_space_needs_its_transform(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = q * 1.5, [3, -2, 5]
    local = rng.normal(size=(6, 3))
    world = local @ m[:3, :3].T + m[:3, 3]
    shape = lambda v: [tuple(map(float, p)) for p in v]
    rows = [("a", shape(world), m.reshape(-1).tolist(), "world"), ("b", shape(local), None, "face_local"), ("c", shape(world), None, "world"), ("d", shape(world), [1.0] * 16, "world")]
    df = spark.createDataFrame(rows, "capture_key string, points array<struct<x:double,y:double,z:double>>, transform array<double>, coordinate_space string").withColumn("participant_id", F.lit("p"))
    got = {r["capture_key"]: r for r in normalise.normalise(df, normalise.AxisConvention((0, 1), (1, 1), (2, 1), {"left_right_sign": "unresolved"})).collect()}
    assert np.allclose(got["a"]["points"], got["b"]["points"]) and got["c"]["points"] is None and "without" in got["c"]["error"] and "affine" in got["d"]["error"]
    assert not got["a"]["side_resolved"] and len(got["a"]["notes"]) == 2
    table, problems = features.build_feature_table(df.withColumn("triangles", F.expr("array(named_struct('i', 0, 'j', 1, 'k', 2))")), normalise.AxisConvention((0, 1), (1, 1), (2, 1)))
    assert problems.count() == 2 and table.count() == 2


def test_bundle_and_schema_map(spark, tmp_path):
    blob = {"pid": 1, "vertices": P, "faces": T, "session": "s1", "camera": {"intrinsics": [[1, 0, 0]], "transform": [1, 2]}, "device": "x", "trackingState": "normal", "version": 3}
    row = c.parse_capture("a.json", json.dumps(blob))
    assert (row["session_id"], row["device_model"], row["tracking_state"], row["schema_version"]) == ("s1", "x", "normal", "3") and json.loads(row["camera_intrinsics"]) == [[1, 0, 0]]
    assert json.loads(row["camera_transform"]) == [1, 2] and len(c.ALIASES) == 22
    stores.write_document(spark, {"fields": {"vertices": ["wolke"], "participant_id": ["wer"]}, "required": ["vertices"]}, f"{tmp_path}/map.json")
    aliases, required = c.load_aliases(spark, f"{tmp_path}/map.json")
    row = c.parse_capture("a.json", json.dumps({"wolke": P, "wer": "k", "triangle_indices": T}), aliases=aliases)
    assert row["participant_id"] == "k" and row["error"] is None and required == ("vertices",)


def test_t_of_large_groups(spark):
    n = [1001, 1002, 1500, 40_000]
    rows = spark.createDataFrame([(k, k) for k in n], "n int, k int").select("n", ratings.t_expanded(F.col("n") - 1, 0.95).alias("t")).collect()
    assert all(r["t"] == pytest.approx(t_quantile(0.975, r["n"] - 1), abs=1e-9) for r in rows)
    many = spark.range(2500).select(F.lit("p").alias("participant_id"), F.col("id").alias("rater_id"), (F.col("id") % 7).cast("double").alias("rating"))
    r = ratings.consensus(many).first()
    assert r["ci_width"] == pytest.approx(2 * t_quantile(0.975, 2499) * r["sem_rating"], rel=1e-9)


def test_hull_against_all_planes(spark):
    """Volume and area of the hull from every triple of points that leaves all others on one side."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(14, 3))
    inside, volume, area = points.mean(axis=0), 0.0, 0.0
    for i in range(14):
        for j in range(i):
            for k in range(j):
                n = np.cross(points[j] - points[i], points[k] - points[i])
                side = (points - points[i]) @ n
                if (side < 1e-9).all() or (side > -1e-9).all():
                    area += np.linalg.norm(n) / 2
                    volume += abs((inside - points[i]) @ n) / 6
    df = spark.createDataFrame([(1, [tuple(map(float, p)) for p in points])], "capture_key int, points array<struct<x:double,y:double,z:double>>")
    r = hull.convex_hulls(df).first()
    assert r["hull_volume"] == pytest.approx(volume, rel=1e-9) and r["hull_area"] == pytest.approx(area, rel=1e-9)


def test_procrustes_undoes_rotations(spark):
    rng = np.random.default_rng(6)
    shape = rng.normal(size=(8, 3))
    shape -= shape.mean(axis=0)
    rows = []
    for k in range(6):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        rows.append((k, [tuple(map(float, p)) for p in shape @ (q * np.sign(np.linalg.det(q)))]))
    df = spark.createDataFrame(rows, "capture_key int, points array<struct<x:double,y:double,z:double>>")
    aligned, mean = normalise.generalised_procrustes(df)
    found = [np.array(r["points"]) for r in aligned.collect()]
    assert all(np.allclose(f, mean, atol=1e-7) for f in found) and np.allclose(np.linalg.norm(mean, axis=1), np.linalg.norm(shape, axis=1))


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(scale=0.3, size=60)
    rows = [(i % 20, i, *map(float, v), float(t), float(1 + i % 3)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "participant_id int, capture_id int, a double, b double, c double, mean_rating double, n_ratings double").cache()


def test_least_squares_and_ridge_equal_brute_force(training):
    x, y, df = training
    w = np.array([1 + i % 3 for i in range(60)], float)
    design = np.c_[np.ones(60), x]
    beta = np.linalg.solve(design.T @ (w[:, None] * design), design.T @ (w * y))
    fitted = models.fit(df, ["a", "b", "c"], "linear", weight="n_ratings")
    got = {r["capture_id"]: r["predicted"] for r in fitted.transform(df).collect()}
    assert np.allclose([got[i] for i in range(60)], design @ beta, atol=1e-6)
    z = np.c_[np.ones(60), (x - x.mean(axis=0)) / x.std(axis=0)]
    loss = []
    for alpha in models.ALPHAS:
        errors = 0.0
        for i in range(60):  # leave one out, one fit each
            k = np.arange(60) != i
            b = np.linalg.solve(z[k].T @ (w[k, None] * z[k]) + alpha * np.diag([0, 1, 1, 1]), z[k].T @ (w[k] * y[k]))
            errors += w[i] * (y[i] - z[i] @ b) ** 2
        loss.append(errors)
    ridge = models.fit(df, ["a", "b", "c"], "ridge", weight="n_ratings").model
    best = models.ALPHAS[int(np.argmin(loss))]
    b = np.linalg.solve(z.T @ (w[:, None] * z) + best * np.diag([0, 1, 1, 1]), z.T @ (w * y))
    assert ridge.alpha == best and np.allclose(ridge.coefficients, b[1:], atol=1e-8)


def test_cross_validation_equals_fold_by_fold(training):
    x, y, df = training
    data = models.TrainingData(df, ["a", "b", "c"])
    held = {r["capture_id"]: r["predicted"] for r in models.cross_validate(data, "linear", 4, weight=None).collect()}
    fold = {r["capture_id"]: r["fold"] for r in splits.participant_folds(df, 4).collect()}
    design = np.c_[np.ones(60), x]
    for k in range(4):
        out = np.array([fold[i] == k for i in range(60)])
        beta = np.linalg.lstsq(design[~out], y[~out], rcond=None)[0]
        assert np.allclose([held[i] for i in np.flatnonzero(out)], design[out] @ beta, atol=1e-6)


def test_permutation_importance_ranks_columns(training):
    _, _, df = training
    fitted = models.fit(df, ["a", "b", "c"], "linear")
    rows = models.permutation_importance(fitted, df, repeats=3).collect()
    assert [r["feature"] for r in rows] == ["b", "a", "c"] and rows[0]["increase"] > rows[2]["increase"] > 0


def test_shapley_values_equal_sums_over_all_sets(spark, training, tmp_path):
    """Every value from its definition, over all sets of known features; values add up to the prediction."""
    x, _, df = training
    for name, options in (("random_forest", {"trees": 3}), ("gbt", {"rounds": 3})):
        fitted = models.fit(df, ["a", "b", "c"], name, **options)
        trees = shap.tree_nodes(fitted, f"{tmp_path}/{name}", spark)

        def mean(nodes, row, known, at=0):
            n = nodes[at]
            if n["leftChild"] < 0:
                return n["prediction"]
            left, right = n["leftChild"], n["rightChild"]
            if n["feature"] in known:
                return mean(nodes, row, known, left if row[n["feature"]] <= n["threshold"] else right)
            return sum(mean(nodes, row, known, k) * nodes[k]["cover"] for k in (left, right)) / n["cover"]

        value = lambda row, known: sum(w * mean(t, row, known) for w, t in trees)  # noqa: E731, B023
        got = {(r["capture_id"], r["feature"]): r["shap"] for r in shap.shap_values(fitted, df, f"{tmp_path}/{name}", ["capture_id"]).collect()}
        predicted = {r["capture_id"]: r["predicted"] for r in fitted.transform(df).collect()}
        base = shap.expected(shap.leaves(trees))
        for i in range(60):
            assert base + sum(got[i, f] for f in "abc") == pytest.approx(predicted[i], abs=1e-9)
        for i in range(8):
            for f in range(3):
                others = [k for k in range(3) if k != f]
                sets = [[], [others[0]], [others[1]], others]
                want = sum((1 / 3 if len(s) in (0, 2) else 1 / 6) * (value(x[i], [*s, f]) - value(x[i], s)) for s in sets)
                assert got[i, "abc"[f]] == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        shap.tree_nodes(models.fit(df, ["a"], "ridge"), str(tmp_path), spark)


def test_models_are_saved_and_read_back(spark, training, tmp_path):
    _, _, df = training
    data = models.TrainingData(df, ["a", "b", "c"])
    for name, options in (("ridge", {}), ("linear", {}), ("random_forest", {"trees": 3})):
        fitted, train, test, held = models.train_final(data, name, **options)
        assert train["r2"] > 0.3 and test["n"] == held.count()
        again = models.Fitted.load(fitted.save(f"{tmp_path}/{name}", spark, {"k": 1}), spark)
        key = lambda f: {r["capture_id"]: round(r["predicted"], 9) for r in f.transform(df).collect()}  # noqa: E731, B023
        assert key(again) == key(fitted) and len(again.importance(2)) == 2
    best, results, warnings = models.compare(data, ("linear", "ridge"), 4)
    about = models.report(data, best, results, warnings)
    assert set(results[best]) == {"cv", "train", "test"} and any("20 participants" in w for w in warnings) and about["note"] == models.NOTE


def test_tables_and_documents_round_trip(spark, training, tmp_path):
    _, _, df = training
    for name in ("t.csv", "t.parquet"):
        path = stores.write_table(df, f"{tmp_path}/{name}", ("capture_id",))
        assert stores.read_table(spark, path).count() == 60 and stores.read_features(spark, path, ["a"]).columns == ["a"]
    scan = stores.read_table(spark, f"{tmp_path}/t.parquet", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:double>" in scan
    with pytest.raises(FileNotFoundError):
        stores.read_targets(spark, f"{tmp_path}/none.parquet")
    with pytest.raises(ValueError):
        stores.read_table(spark, f"{tmp_path}/t.parquet", ["z"])
    with pytest.raises(FileNotFoundError):
        stores.read_document(spark, f"{tmp_path}/none.json")
    assert ratings.load_ratings(spark, stores.ratings_template(spark, f"{tmp_path}/r.csv")).count() == 0
    stores.write_table(df.select("participant_id", "mean_rating", F.col("mean_rating").alias("predicted")), f"{tmp_path}/p.parquet")
    stores.write_table(df.select("participant_id", (F.col("participant_id") % 2).alias("side")).distinct().where("participant_id > 0"), f"{tmp_path}/d.csv")
    grouped = metrics.with_demographics(stores.read_predictions(spark, f"{tmp_path}/p.parquet"), stores.read_demographics(spark, f"{tmp_path}/d.csv", "side"), "side")
    assert {r["grp"]: r["n"] for r in metrics.group_metrics(grouped).collect()} == {0: 27, 1: 30} and grouped.count() == 60


def test_feature_table_equals_its_parts(spark):
    """The kernel against the operators that SQL confirms, on the test captures and on clouds with full midlines."""
    from meshquill.plans import queries

    dense = queries._dense(spark, queries_sf).withColumns({"participant_id": F.lit("p"), "triangles": F.expr("array(named_struct('i', 0, 'j', 1, 'k', 2))")})
    for caps in (queries.tables.captures(spark, queries_sf), dense):
        n = caps.select("capture_key", "participant_id", "points", "triangles")
        table = features.extract(n, queries.MARKS, fit_plane=False)
        got = {r["capture_key"]: r for r in table.collect()}
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and (caps is dense or "Exchange" not in plan)
        bands = queries.mesh.bands(n).collect()
        assert all(near_or_none(got[r["capture_key"]][f"{c}_band_{r['band']}"], r[c]) for r in bands for c in ("width", "depth"))
        names = {"lower_upper": "width_lower_upper_ratio", "mid_upper": "width_mid_upper_ratio", "width_max": "width_profile_max", "width_at": "width_profile_argmax_frac", "depth_max": "depth_profile_max", "depth_at": "depth_profile_argmax_frac"}
        parts = [(queries.mesh.profile_summary(n), names), (queries.midline.midline_features(n), {f: f for f in features.MIDLINE}), (queries.landmarks.landmark_features(n, queries.MARKS), {f: f for f in features.LANDMARKS})]
        parts += [(queries.mesh.shape_pca(n), {"elongation": "pca_elongation", "flatness": "pca_flatness"}), (queries.mesh.extents(n), {"width": "face_width", "depth_height_ratio": "depth_height_ratio"})]
        for part, to in parts:
            for r in part.collect():
                assert all(near_or_none(got[r["capture_key"]][b], r[a]) for a, b in to.items()), (r, got[r["capture_key"]])
    assert any(r["middle_third_height"] is not None for r in got.values())


queries_sf = "/root/testdata/sf0.001"


def near_or_none(a, b):
    return (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-7, abs=1e-9))


def test_commands(spark, tmp_path, capsys):
    """A project from captures to an audit: every command, what it writes, and its exit code."""
    points, triangles = grid(7)
    rng = np.random.default_rng(8)
    run = lambda *a: cli.main(["--root", str(tmp_path), *a], spark)
    assert run("features") == 1 and "axis_convention" in capsys.readouterr().out
    raw = tmp_path / "data" / "raw"
    eye = lambda x: [1, 0, 0, x, 0, 1, 0, 0.3, 0, 0, 1, 0.5, 0, 0, 0, 1]
    scores = ["participant_id,rater_id,rating"]
    for i in range(24):
        v = points * [0.08 + 0.001 * i, 0.1, 0.1] + rng.normal(scale=1e-4, size=points.shape)
        (raw / f"P{i:02d}").mkdir(parents=True)
        blob = {"participantId": f"P{i:02d}", "captureId": f"c{i}", "vertices": v.tolist(), "triangleIndices": triangles.ravel().tolist(), "leftEyeTransform": eye(0.03), "rightEyeTransform": eye(-0.03)}
        (raw / f"P{i:02d}" / "c.json").write_text(json.dumps(blob))
        scores += [f"P{i:02d},r{k},{3 + i / 6 + 0.1 * k + 0.2 * rng.normal():.3f}" for k in range(4)]
    (tmp_path / "data" / "labels" / "ratings.csv").write_text("\n".join(scores) + "\n")
    assert run("inspect") == 0 and run("validate") == 0 and run("axes", "detect") == 0 and run("axes", "show") == 0
    assert run("features") == 0 and run("ratings", "template") == 0 and run("ratings", "aggregate") == 0
    assert run("train", "--models", "ridge", "linear", "--folds", "3", "--save") == 0
    about = stores.read_document(spark, f"{tmp_path}/outputs/training_report.json")
    assert about["n_participants"] == 24 and about["best_model"] in ("ridge", "linear") and any("24 participants" in w for w in about["warnings"])
    (tmp_path / "groups.csv").write_text("participant_id,side\n" + "\n".join(f"P{i:02d},{i % 2}" for i in range(24)))
    capsys.readouterr()
    assert run("evaluate", "--model", f"{tmp_path}/models/{about['best_model']}", "--predictions", f"{tmp_path}/outputs/predictions_ridge.parquet", "--demographics", f"{tmp_path}/groups.csv", "--group-column", "side") == 0
    assert models.NOTE in capsys.readouterr().out and run("evaluate") == 1
    (raw / "P00" / "bad.json").write_text("{")
    assert run("validate") == 1
