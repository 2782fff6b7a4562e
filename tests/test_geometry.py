"""Kernels and operators on small meshes with known answers."""

import numpy as np
import pytest

from meshquill.functions.special import correlation_p, t_quantile
from meshquill.operators import features, hull, mesh, midline, normalise, symmetry, validation

SCHEMA = "capture_key long, participant_id string, points array<struct<x:double,y:double,z:double>>, triangles array<struct<i:int,j:int,k:int>>"


def grid(n=13, dent=0.0, shift=0.0):
    xs, ys = np.linspace(-1, 1, n), np.linspace(-1.3, 1.3, n)
    p = np.array([(x, y, -(0.5 * x * x + 0.3 * y * y) - (dent if x > 0 else 0.0)) for y in ys for x in xs])
    p[:, 0] += shift
    t = [tri for r in range(n - 1) for c in range(n - 1) for a in [r * n + c] for tri in ((a, a + 1, a + n), (a + 1, a + n + 1, a + n))]
    return p, np.array(t)


def frame(spark, *meshes):
    rows = [(i, f"p{i}", [tuple(map(float, q)) for q in p], [tuple(map(int, q)) for q in t]) for i, (p, t) in enumerate(meshes)]
    return spark.createDataFrame(rows, SCHEMA)


def test_t_quantiles():
    assert t_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-4)
    assert t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-4)
    assert t_quantile(0.975, 300) == pytest.approx(1.96790, abs=1e-5)
    assert correlation_p(0.0, 10) == pytest.approx(1.0)


def test_symmetric_grid_has_no_error():
    m = symmetry.measure(*grid(), fit=False)
    assert m["symmetry_rms"] < 1e-9 and m["pairing"] == 1.0


def test_dent_exceeds_floor():
    m = symmetry.measure(*grid(dent=0.1), fit=False)
    assert m["symmetry_rms"] > 0.01 and m["exceeds_floor"]


def test_midplane_is_found():
    p, t = grid(9, shift=0.37)
    m = symmetry.measure(p, t, normal=(1.0, 0.02, 0.0), surface=False)
    assert abs(m["offset"] / m["normal"][0] - 0.37) < 1e-2


def test_scale_invariance():
    p, t = grid(dent=0.1)
    assert symmetry.measure(p * 7, t, fit=False)["symmetry_rms"] == pytest.approx(symmetry.measure(p, t, fit=False)["symmetry_rms"], rel=1e-9)


def test_reflection_is_an_involution():
    p = np.random.default_rng(1).normal(size=(40, 3))
    n = np.array([0.3, -0.5, 0.8])
    assert np.allclose(symmetry.mirrored(symmetry.mirrored(p, n, 0.2), n, 0.2), p)


def test_minimise_rosenbrock():
    x, ok = symmetry.minimise(lambda v: (1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2, np.array([-1.2, 1.0]))
    assert ok and np.allclose(x, 1, atol=1e-4)


def test_triangle_distance_regions():
    a, b, c = (np.array([v], float) for v in ((0, 0, 0), (1, 0, 0), (0, 1, 0)))
    for q, d in (((0.2, 0.2, 3), 3), ((-3, 0, 0), 3), ((0.5, -2, 0), 2), ((1, 1, 0), np.sqrt(0.5))):
        assert symmetry.triangle_distance(np.array([q], float), a, b, c)[0] == pytest.approx(d)


def test_hull_of_cube_and_sphere():
    cube = np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
    inside = np.random.default_rng(0).uniform(0.1, 0.9, (50, 3))
    assert hull.convex_hull(np.r_[cube, inside]) == pytest.approx((1.0, 6.0))
    s = np.random.default_rng(0).normal(size=(800, 3))
    volume, area = hull.convex_hull(s / np.linalg.norm(s, axis=1)[:, None])
    assert 4.0 < volume < 4.19 and 12.2 < area < 12.57
    assert hull.convex_hull(np.c_[cube[:, :2], np.zeros(8)]) is None


def test_procrustes_undoes_a_turn_and_never_mirrors():
    p = np.random.default_rng(2).normal(size=(60, 3))
    p -= p.mean(axis=0)
    c, s = np.cos(0.4), np.sin(0.4)
    turned = p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])
    assert np.allclose(turned @ normalise.rotation(turned, p), p, atol=1e-9)
    assert np.linalg.det(normalise.rotation(p * [-1, 1, 1], p)) == pytest.approx(1.0)


def test_unit_square_area(spark):
    square = (np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]), np.array([(0, 1, 2), (0, 2, 3)]))
    assert mesh.surface_area(frame(spark, square)).first()["surface_area"] == pytest.approx(1.0)


def test_axes_and_features(spark):
    lean = lambda m: (m[0] + np.c_[np.zeros((len(m[0]), 2)), 0.3 * m[0][:, 1] ** 3 + 0.2 * m[0][:, 1]], m[1])  # noqa: E731  alike left and right only
    df = frame(spark, lean(grid()), lean(grid(dent=0.05)))
    found = normalise.detect_axes(df)
    assert found.left[0] == 0 and found.right_handed()
    assert normalise.AxisConvention.loads(found.dumps()).matrix().tolist() == found.matrix().tolist()
    wide, problems = features.build_feature_table(df, normalise.AxisConvention((0, 1), (1, 1), (2, 1)), fit_plane=False)
    assert len(features.FEATURES) == 70 and problems.count() == 0
    rows = {r["capture_key"]: r for r in wide.collect()}
    assert rows[0]["symmetry_rms"] < 1e-9 < rows[1]["symmetry_rms"] and rows[0]["interocular_distance"] is None
    long = features.long_form(wide).where("value IS NULL")
    assert long.where("reason IS NULL").count() == 0


def test_scale_without_eyes_is_a_problem_row(spark):
    wide, problems = features.build_feature_table(frame(spark, grid(5)), normalise.AxisConvention((0, 1), (1, 1), (2, 1)), scale="interocular", fit_plane=False)
    assert wide.count() == 0 and problems.first()["error"]


def test_midline_of_one_bump_has_no_nasion(spark):
    y = np.linspace(-1, 1, 120)
    bump = np.exp(-((y / 0.3) ** 2))
    two = bump + 0.5 * np.exp(-(((y - 0.7) / 0.1) ** 2)) + 0.4 * np.exp(-(((y + 0.7) / 0.1) ** 2))
    cloud = lambda z: (np.array([(x, a, b) for a, b in zip(y, z, strict=True) for x in (-1.0, -0.01, 0.0, 0.01, 1.0)]), np.zeros((0, 3)))
    found = {r["capture_key"]: r for r in midline.landmarks(frame(spark, cloud(bump), cloud(two))).collect()}
    assert found[0]["nasion_y"] is None and abs(found[0]["nose_tip_y"]) < 0.05
    assert 0.3 < found[1]["nasion_y"] < 0.65 and found[1]["pogonion_y"] < found[1]["subnasale_y"]


def test_validation_codes(spark):
    p, t = grid(5)
    nan, flat = p.copy(), np.zeros_like(p)
    nan[5, 1] = np.nan
    df = frame(spark, (p, t), (nan, t), (flat, t), (p * 1.1, np.r_[t, [(5, 5, 6)]]), (p, t))
    codes = {}
    for r in validation.issues(df).collect():
        codes.setdefault(r["capture_key"], set()).add(r["code"])
    assert "nan_vertices" in codes[1] and "collapsed_mesh" in codes[2] and "degenerate_triangles" in codes[3]
    assert "duplicate_geometry" in codes[0] and "duplicate_geometry" in codes[4] and "topology_mismatch_triangles" in codes[3]
    status = {r["capture_key"]: r["status"] for r in validation.status(df).collect()}
    assert status[1] == status[2] == "FAIL" and status[3] == "WARN"
