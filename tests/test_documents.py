"""Key trees by variants against the same in Python; the streamed feature table against the batch; the table function."""

import json

import numpy as np
import pytest

from meshquill.operators import features, mesh, normalise
from meshquill.sources import captures
from meshquill.streaming import ingest

KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}


def random_value(rng, depth):
    kind = rng.integers(0, 9 if depth else 6)
    if kind >= 7:
        return {str(rng.choice(["a", "b", "Key", "x y", "z.w", ""])) + str(i): random_value(rng, depth - 1) for i in range(int(rng.integers(0, 4)))}
    if kind == 6:
        return [random_value(rng, depth - 1) for _ in range(int(rng.integers(0, 8)))]
    return [None, True, int(rng.integers(-5, 10**9)), round(float(rng.normal()), 3), float(rng.integers(0, 9)), "text with \"quotes\" \n and / " * int(rng.integers(0, 4))][kind]


def test_key_trees_equal_python(spark):
    rng = np.random.default_rng(0)
    texts = [json.dumps({"top": random_value(rng, 4), "n": i}) for i in range(150)]
    texts += ['{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e5, "b": -0.0, "c": 0.00001}', '{"é": "ü", "l": ["ö"]}', '{"d": 12345678901234567890}', "[1]", "3", "{", "", "{}", '{"a": {}}', '{"a": [[1, 2], {"b": 1}]}', '{"a": [1, {"b": [2]}]}', None, '{"s": "' + "x" * 90 + '"}']
    got = sorted(map(repr, (tuple(r) for r in captures.key_tree(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "path long, content string"), depth=3).collect())))
    want = []
    for i, text in enumerate(texts):
        try:
            blob = json.loads(text)
        except (ValueError, TypeError):
            continue
        want += [repr((i, p, level, KINDS.get(type(v), "number"), captures.describe(v))) for p, level, v in captures.tree_rows(blob, 3)]
    assert got == sorted(want)


def write(folder, name, points, eyes=True):
    folder.mkdir(parents=True, exist_ok=True)
    eye = lambda x: [1, 0, 0, x, 0, 1, 0, 0.03, 0, 0, 1, 0.02, 0, 0, 0, 1]
    blob = {"participantId": "P", "captureId": name, "vertices": points.tolist(), "triangleIndices": [[k, k + 1, k + 2] for k in range(len(points) - 2)]}
    (folder / f"{name}.json").write_text(json.dumps(blob | ({"leftEyeTransform": eye(0.03), "rightEyeTransform": eye(-0.03)} if eyes else {})))


def test_streamed_features_equal_the_batch_also_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    clouds = [rng.normal(scale=0.05, size=(30, 3)) for _ in range(5)]
    convention = normalise.AxisConvention((0, 1), (1, 1), (2, 1))
    raw, out, check = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        query = ingest.start_features(ingest.stream_new_captures(spark, str(raw)), convention, out, check, fit_plane=False)
        query.awaitTermination(120)

    for i in range(3):
        write(raw, f"c{i}", clouds[i])
    run()
    write(raw, "c3", clouds[3])
    write(raw, "again", clouds[0])  # the geometry of c0
    write(raw, "c4", clouds[4], eyes=False)
    (raw / "broken.json").write_text("{")
    run()
    run()
    got = spark.read.parquet(f"{out}/table").drop("batch").toPandas().sort_values("capture_id", ignore_index=True)
    batch = captures.loaded(captures.load_captures(spark, str(raw))).where("capture_id <> 'again'")
    want = features.build_feature_table(batch, convention, fit_plane=False)[0].toPandas().sort_values("capture_id", ignore_index=True)
    assert got["capture_id"].tolist() == ["c0", "c1", "c2", "c3", "c4"] and got[want.columns].equals(want)
    assert got["interocular_distance"].isna().tolist() == [False] * 4 + [True]


def test_table_function(spark):
    mesh.register_functions(spark)
    spark.sql("SELECT 1 AS k, array(named_struct('x', 1D, 'y', 2D, 'z', 3D)) AS points, array(named_struct('i', 0, 'j', 0, 'k', 5)) AS triangles UNION ALL SELECT 2, NULL, NULL").createOrReplaceTempView("__meshes")
    rows = spark.sql("SELECT k, m.* FROM __meshes, LATERAL explode_mesh(points, triangles) m ORDER BY corner").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 0, 1.0, 2.0, 3.0), (1, 0, 1, 0, 1.0, 2.0, 3.0), (1, 0, 2, 5, None, None, None)]
    with pytest.raises(Exception, match="LATERAL|lateral|explode_mesh|PARSE"):
        spark.sql("SELECT * FROM explode_mesh(").collect()
