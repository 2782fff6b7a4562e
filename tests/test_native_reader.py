"""Documents read in the JVM give the rows of the Python reader, and those in doubt go through Python."""

import json

import pytest

from meshquill.sources import captures as c
from meshquill.sources import native

P, T = [[0.1, 0, 0], [1, 0, 2.5], [0, 1, 1e-7], [0, 0, -1]], [0, 1, 2, 0, 2, 3]
FLAT = [v for p in P for v in p]
M = [1, 0, 0, 5.25, 0, 1, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1]
TURNED = [M[4 * (i % 4) + i // 4] for i in range(16)]


def doc(**fields):
    return {"participantId": "P1", "vertices": P, "triangleIndices": T, **fields}


WELL_FORMED = {
    "nested": doc(), "flat": doc(vertices=FLAT), "padded": doc(vertices=[[*p, 1] for p in P]), "records": doc(vertices=[dict(zip("xyz", p, strict=True)) for p in P]),
    "parts": doc(vertices={a: [p[i] for p in P] for i, a in enumerate("xyz")}), "triples": doc(triangleIndices=[T[:3], T[3:]]), "corner_records": doc(triangleIndices=[{"b": 1, "a": 0, "c": 2}]),
    "below": {"Subject ID": 7, "faceGeometry": {"vertices": P, "triangle_indices": T}}, "anywhere": {"a": {"b": {"verts": P, "FACES": T, "pid": "q"}}, "captureId": "c9"},
    "matrices": doc(transform=M, leftEyeTransform=TURNED, rightEyeTransform=[M[i : i + 4] for i in range(0, 16, 4)]), "no_move": doc(transform=[1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], units=" MM "),
    "not_affine": doc(transform=[2] * 16), "look": doc(lookAtPoint=[1, 2, 3.5, 4], units="cm"), "short_look": doc(gaze=[1, 2]),
    "uv": doc(uv=[[0, 0.5], [1, 1]]), "flat_uv": doc(textureCoords=[0, 0.5, 1, 1]), "shapes": doc(blendShapes={"jaw": 0.5, "bad": True, "none": None, "word": "x", "one": 1}),
    "epoch": doc(timestamp=1_700_000_061), "small_number": doc(time=12), "iso": doc(timestamp="2024-02-29T23:59:58.250+05:30"), "iso_utc": doc(date="1969-12-31T23:59:59Z"), "iso_naive": doc(timestamp="2024-03-01T00:00:00"),
    "world": doc(coordinateSpace="World", units="furlong"), "odd_space": doc(space="moon"), "counts": doc(vertexCount=4, triangleCount=2),
    "camera": doc(camera={"b": [1, 2.5], "a": "x/y", "c": None, "d": 2.0}, cameraIntrinsics=[[1450.5, 0.0, 2], [0, 0.25, 1]], schemaVersion=3, deviceModel="phone", trackingState=True),
    "whole_floats": doc(triangleIndices=[0.0, 1.0, 2.0]), "null_field": doc(session=None, capture_id=None, id="later"), "extra": doc(note={"deep": {"deeper": [1, {"vertices": 3}]}}, list=[]),
}
IN_DOUBT = {
    "eyes": doc(leftEye={"transform": M}, rightEye={"transform": M}), "text_count": doc(vertexCount="4"),
    "empty": doc(vertices=[]), "odd_flat": doc(vertices=FLAT[:-1]), "text": doc(vertices="x"), "null_number": doc(vertices=[[0, None, 1]]), "mixed": doc(vertices=[[0, "1", 2]]), "ragged": doc(vertices=[[0, 1, 2], [1, 2]]),
    "upper_parts": doc(vertices={a: [p[i] for p in P] for i, a in enumerate("XYZ")}), "uneven_parts": doc(vertices={"x": [1], "y": [1], "z": []}), "range": doc(triangleIndices=[0, 1, 99]), "negative": doc(triangleIndices=[0, 1, -1]),
    "half": doc(triangleIndices=[0, 1, 1.5]), "two_keys": doc(Participant_ID="P2"), "two_places": {"a": {"verts": P}, "b": {"verts": P}, "faces": T}, "dotted": doc(**{"a.b": 1}),
    "accent": doc(participantId="Zoë"), "float_id": doc(participantId=1.5), "true_id": doc(participantId=True), "float_time": doc(timestamp=1_700_000_000.5), "word_time": doc(timestamp="soon"), "day": doc(timestamp="2024-02-30T00:00:00"),
    "short_matrix": doc(transform=[1, 2, 3]), "text_matrix": doc(transform="x"), "shape_records": doc(blendShapes=[{"name": "jaw", "value": 0.5}]), "float_count": doc(vertexCount=4.0), "empty_uv": doc(uv=[]), "tiny": doc(camera={"f": 1e-7}),
}
RAW = {"list": "[1]", "cut": '{"vertices": [', "nothing": "", "nan": '{"pid": "a", "vertices": [[NaN, 0, 0]], "faces": [0, 0, 0]}', "twice": '{"pid": "a", "pid": "b", "vertices": [[0, 0, 0]], "faces": [0, 0, 0]}'}


def plain(value):
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    return [plain(v) for v in value] if isinstance(value, list | tuple) else {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else value


@pytest.mark.parametrize("strict", [True, False])
def test_rows_equal_the_python_reader(spark, strict):
    texts = {f"raw/P7/{k}.v1.json": json.dumps(v) for k, v in {**WELL_FORMED, **IN_DOUBT}.items()} | {f"{k}.json": v for k, v in RAW.items()}
    texts["plain"] = json.dumps(doc())
    frame = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()] + [("bytes.json", bytearray(b"\xff"))], "path string, content binary")
    got = {r["path"]: plain(r) for r in c.parse_captures(frame, strict, jvm=True).collect()}
    assert len(got) == len(texts) + 1
    for path, text in {**texts, "bytes.json": b"\xff"}.items():
        expected = plain(c.parse_capture(path, text, strict))
        differ = {k: (got[path][k], v) for k, v in expected.items() if got[path][k] != v and not (k == "points" and path == "nan.json")}
        assert not differ, (path, differ)


def test_well_formed_documents_need_no_python(spark):
    rows = [(k, json.dumps(v)) for k, v in {**WELL_FORMED, **IN_DOUBT}.items()] + list(RAW.items())
    docs = native.read(spark.createDataFrame(rows, "path string, text string"), "text", c.ALIASES, c.BUNDLE, c.UNITS, c.SPACES, c.norm, True, c.MAX_DEPTH)
    assert {r["path"] for r in docs.where("__good").select("path").collect()} == set(WELL_FORMED)


def test_a_field_map_of_ones_own(spark):
    blob = {"who": {"name": "P3"}, "shape": {"pts": FLAT}, "shape_faces": T}
    own = {"participant_id": ["who.name"], "vertices": ["shape.pts"], "triangle_indices": ["shapeFaces"]}
    frame = spark.createDataFrame([("a/b.json", bytearray(json.dumps(blob).encode()))], "path string, content binary")
    assert plain(c.parse_captures(frame, aliases=own, jvm=True).first()) == plain(c.parse_capture("a/b.json", json.dumps(blob), aliases=own))
