"""World-space captures, eyes that turn with their face, the k-d tree, and the commands of a project with landmarks."""

import json

import numpy as np
import pandas as pd
import pytest

from meshquill import cli
from meshquill.operators import features, landmarks, metrics, normalise, symmetry
from meshquill.sources import stores

SCHEMA = "capture_key string, participant_id string, capture_id string, points array<struct<x:double,y:double,z:double>>, triangles array<struct<i:int,j:int,k:int>>, left_eye struct<x:double,y:double,z:double>, right_eye struct<x:double,y:double,z:double>, coordinate_space string, transform array<double>"


def face(rng, n=60):
    """A mirror-symmetric cloud, long-nosed (+z) and broader above."""
    half = rng.uniform([0.05, -1, 0], [1, 1, 0.3], (n, 3))
    half[:, 0] *= 0.7 + 0.3 * half[:, 1]
    half[:3, 2] = [2.0, 1.5, 1.8]
    return np.r_[half, half * [-1, 1, 1]] * 0.08


def capture(key, points, eyes, space="face_local", transform=None, triangles=None):
    xyz = lambda p: dict(zip("xyz", map(float, p), strict=True))
    tri = [dict(zip("ijk", map(int, t), strict=True)) for t in (triangles if triangles is not None else [(i, i + 1, i + 2) for i in range(len(points) - 2)])]
    return (key, f"P{key}", key, [xyz(p) for p in points], tri, xyz(eyes[0]), xyz(eyes[1]), space, None if transform is None else [float(x) for x in np.ravel(transform)])


def turned(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q * np.sign(np.linalg.det(q))


def test_world_export_gives_the_convention_of_its_local_twin(spark):
    rng = np.random.default_rng(3)
    order = np.array([[0, 0, -1], [1, 0, 0], [0, 1, 0]], float)  # raw axes that are not the canonical ones
    local, world = [], []
    for i in range(6):
        p = face(rng) @ order.T
        eyes = np.array([[0.03, 0.04, 0.02], [-0.03, 0.04, 0.02]]) @ order.T
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = turned(rng), rng.normal(size=3)
        local.append(capture(str(i), p, eyes))
        world.append(capture(str(i), p @ m[:3, :3].T + m[:3, 3], eyes, "world", m))
    broken = capture("x", face(rng) * 5, np.zeros((2, 3)), "world", None)
    a = normalise.detect_axes(spark.createDataFrame(local, SCHEMA))
    b = normalise.detect_axes(spark.createDataFrame([*world, broken], SCHEMA))
    assert (a.left, a.superior, a.anterior) == (b.left, b.superior, b.anterior)
    assert b.evidence["captures_without_frame"] == 1 and np.allclose(a.evidence["mirror_error"], b.evidence["mirror_error"])
    with pytest.raises(ValueError):
        normalise.detect_axes(spark.createDataFrame([broken], SCHEMA))


def test_eye_features_are_the_same_after_a_turn_before_procrustes(spark):
    rng = np.random.default_rng(4)
    base = face(rng)
    first, second = [], []
    for i in range(4):
        p = base + rng.normal(scale=1e-4, size=base.shape)
        eyes = np.array([[0.03, 0.04, 0.02], [-0.03, 0.041, 0.02]])
        turn = turned(rng) if i else np.eye(3)
        first.append(capture(str(i), p, eyes))
        second.append(capture(str(i), p @ turn.T, eyes @ turn.T))
    convention = normalise.AxisConvention((0, 1), (1, 1), (2, 1))
    tables = []
    for rows in (first, second):
        n = normalise.normalise(spark.createDataFrame(rows, SCHEMA), convention)
        aligned, _ = normalise.generalised_procrustes(n)
        assert aligned.columns == n.columns
        tables.append(features.extract(aligned, fit_plane=False).select("capture_key", *features.EYES).orderBy("capture_key").toPandas())
    assert np.allclose(tables[0][features.EYES], tables[1][features.EYES], atol=1e-6) and tables[0][features.EYES].notna().all().all()


def test_procrustes_that_fails_is_a_note(spark):
    rng = np.random.default_rng(5)
    rows = [capture("a", face(rng, 30), np.eye(3)[:2] * 0.03), capture("b", face(rng, 31), np.eye(3)[:2] * 0.03)]
    table, problems = features.build_feature_table(spark.createDataFrame(rows, SCHEMA), normalise.AxisConvention((0, 1), (1, 1), (2, 1)), procrustes=True, fit_plane=False)
    assert table.count() == 2
    assert [(r["capture_key"], r["error"]) for r in problems.collect()] == [(None, "not aligned: captures have different vertex counts")]


@pytest.mark.parametrize("kind", ["surface", "ball", "line", "clumps", "lattice"])
def test_tree_finds_the_nearest(kind):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(20_000 if kind == "surface" else 3000, 3))
    if kind == "surface":
        p[:, 2] = np.cos(p[:, 0]) + 0.01 * rng.normal(size=len(p))
    elif kind == "line":
        p[:, 1:] = 0
    elif kind == "clumps":
        p[::2] *= 1e-4
    elif kind == "lattice":
        p = np.round(2 * p)
    queries = (p * [-1, 1, 1] + 0.003)[:2500]
    queries[:3] *= 100
    for k in (1, 2, 12):
        dist, ids = symmetry.Nearest(p)(queries, k)
        assert np.allclose(dist, symmetry.nearest(queries, p, k)[0], rtol=1e-12, atol=1e-12)
        assert np.allclose(np.linalg.norm(queries[:, None] - p[ids], axis=2), dist) and all(len(set(r)) == k for r in ids[:200].tolist())


def test_a_participant_with_several_demographic_rows_is_counted_once(spark):
    p = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 2.0), ("c", 3.0, 1.0), ("d", 3.0, 1.0)], "participant_id string, truth double, predicted double")
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "y")], "participant_id string, side string")
    got = {r["participant_id"]: r["grp"] for r in metrics.with_demographics(p, d, "side").collect()}
    assert got == {"a": "x", "b": None, "c": "y", "d": None}


def test_project_with_landmarks(spark, tmp_path, capsys):
    rng = np.random.default_rng(7)
    run = lambda *a: cli.main(["--root", str(tmp_path), *a], spark)
    raw = tmp_path / "data" / "raw"
    base = face(rng)
    eye = lambda x: [1, 0, 0, x, 0, 1, 0, 0.03, 0, 0, 1, 0.02, 0, 0, 0, 1]
    for i in range(12):
        (raw / f"P{i // 2}").mkdir(parents=True, exist_ok=True)
        blob = {"participantId": f"P{i // 2}", "captureId": f"c{i}", "vertices": (base * (1 + 0.01 * i)).tolist(), "triangleIndices": [[k, k + 1, k + 2] for k in range(len(base) - 2)], "leftEyeTransform": eye(0.03), "rightEyeTransform": eye(-0.03)}
        (raw / f"P{i // 2}" / f"{i}.json").write_text(json.dumps(blob))
    assert run("axes", "detect", "--dry-run") == 0 and run("axes", "show") == 1
    assert run("axes", "detect", "--confirm") == 0
    assert stores.read_document(spark, f"{tmp_path}/config/axis_convention.json")["confirmed_by_user"] is True
    assert run("landmarks", "verify") == 1 and run("landmarks", "check") == 0
    assert run("landmarks", "assign", "nasion=100000") == 1
    assert run("landmarks", "assign", *(f"{n}={i}" for i, n in enumerate(landmarks.NAMES))) == 0
    assert run("landmarks", "show") == 0 and run("landmarks", "verify", "--capture", "c3") == 0 and run("landmarks", "check") == 0
    assert run("features") == 0
    table = pd.read_parquet(tmp_path / "data" / "processed" / "features.parquet")
    assert len(table) == 12 and table[features.LANDMARKS].notna().all().all() and len(features.LANDMARKS) == 15
    capsys.readouterr()
    assert run("symmetry", "--capture", "c0", "--no-fit") == 0 and "symmetry_rms" in capsys.readouterr().out
    assert run("symmetry", "--capture", "nobody") == 1
    assert run("describe") == 0 and run("splits", "--folds", "3") == 0 and "would leak" in capsys.readouterr().out
    small = {"participantId": "P9", "captureId": "c9", "vertices": base[:50].tolist(), "triangleIndices": [[0, 1, 2]]}
    (raw / "P9").mkdir()
    (raw / "P9" / "s.json").write_text(json.dumps(small))
    assert run("landmarks", "check") == 1
    assert run("validate") == 1
    report = spark.read.text(f"{tmp_path}/outputs/validation_report.txt").toPandas()["value"].tolist()
    assert sum("participant with several captures" in line for line in report) == 6 and any("topology_mismatch" in line for line in report)
