import json

import pytest

from meshquill.operators import ratings, splits
from meshquill.sources import captures as c
from meshquill.streaming import ingest

P, T = [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], [0, 1, 2, 0, 2, 3]
FLAT = [v for p in P for v in p]


def parse(**fields):
    return c.parse_capture("raw/P7/a.json", json.dumps({"participantId": "P1", "vertices": P, "triangleIndices": T, **fields}))


@pytest.mark.parametrize("raw", [P, FLAT, [dict(zip("xyz", p, strict=True)) for p in P], {a: [p[i] for p in P] for i, a in enumerate("XYZ")}, [[*p, 9] for p in P]])
def test_shapes_give_the_same_points(raw):
    row = parse(vertices=raw)
    assert row["error"] is None and [[p[a] for a in "xyz"] for p in row["points"]] == P


@pytest.mark.parametrize("field,value", [("vertices", []), ("vertices", FLAT[:-1]), ("vertices", "x"), ("triangleIndices", [0, 1, 99]), ("triangleIndices", [0, 1, -1]), ("triangleIndices", [0, 1, 1.5]), ("triangleIndices", []), ("vertices", [[0, None, 1]])])
def test_bad_arrays_have_a_reason(field, value):
    row = parse(**{field: value})
    assert row["error"] and row["points"] is None


def test_matrix_layouts():
    notes = []
    row = [1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1]
    column = [row[4 * (i % 4) + i // 4] for i in range(16)]
    assert c.coerce_matrix(row, notes, "m") == row and not notes
    assert c.coerce_matrix(column, notes, "m") == row and "transposed" in notes[0]
    assert c.coerce_matrix([1, 2, 3], notes, "m") is None


def test_fallback_does_not_take_the_anchor_for_an_eye():
    m = [1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1]
    assert parse(transform=m)["left_eye"] is None
    text = json.dumps({"participantId": "P1", "vertices": P, "triangleIndices": T, "transform": m})
    assert c.parse_capture("a.json", text, strict=False)["left_eye"] == {"x": 5.0, "y": 6.0, "z": 7.0}


def test_nested_and_odd_keys():
    row = c.parse_capture("raw/P7/a.json", json.dumps({"payload": {"nested": {"blendShapes": {"jaw": 0.5, "bad": True}}}, "faceGeometry": {"vertices": P, "triangle_indices": T}}))
    assert row["blend_shapes"] == {"jaw": 0.5} and row["participant_id"] == "P7" and row["capture_id"] == "a"
    assert c.parse_capture("a.json", b"{")["error"].startswith("not JSON") and c.parse_capture("a.json", b"\xff")["error"].startswith("not UTF-8")


def test_batch_and_stream(spark, tmp_path):
    root = tmp_path / "raw" / "P1"
    root.mkdir(parents=True)
    (root / "a.json").write_text(json.dumps({"vertices": P, "triangleIndices": T, "units": "mm"}))
    (root / "b.json").write_text("[1]")
    rows = {r["capture_id"]: r for r in c.load_captures(spark, str(tmp_path / "raw")).collect()}
    assert rows["a"]["points"][1]["x"] == pytest.approx(0.001) and rows[None]["error"]
    q = ingest.start(ingest.stream_captures(spark, str(tmp_path / "raw")), str(tmp_path / "c"), str(tmp_path / "i"), str(tmp_path / "k"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    assert "load_failed" in {r["code"] for r in spark.read.parquet(str(tmp_path / "i")).collect()}


def test_ratings_and_splits(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# note\nparticipant_id,rater_id,rating\np1,a,3\np1,b,x\np2,a,5\np2,b,7\n")
    r = ratings.load_ratings(spark, str(tmp_path / "r.csv"))
    by = {x["participant_id"]: x for x in ratings.consensus(r).collect()}
    assert by["p1"]["n_ratings"] == 1 and by["p1"]["ci_low"] is None and by["p2"]["mean_rating"] == 6
    assert ratings.consensus(r.where("false")).count() == 0
    agree = spark.createDataFrame([(i, j, float(i) + 0.01 * j) for i in range(20) for j in range(4)], "participant_id int, rater_id int, rating double")
    assert ratings.icc(ratings.complete_block(agree)[0]).first()["icc_average"] > 0.9
    table = spark.createDataFrame([(i % 10, i) for i in range(57)], "participant_id int, v int")
    sides = splits.participant_split(table)
    splits.assert_no_leakage(sides.where("side = 'train'"), sides.where("side = 'test'"))
    with pytest.raises(splits.LeakageError):
        splits.assert_no_leakage(table, table)
    folds = splits.participant_folds(table, 5)
    assert folds.count() == 57 and folds.select("participant_id", "fold").distinct().count() == 10
    with pytest.raises(ValueError):
        splits.participant_split(table.where("participant_id = 1"))
