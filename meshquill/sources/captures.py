"""Tolerant ingest of capture JSON: alias-driven fields, shape coercion, and a record of every inference.

One row for each file, whatever is in it: a file that can't be read or used has its reason in `error`.
Files are read by Spark (`binaryFile`), so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import native

# Canonical fields and the key paths under which exporters put them, in order of preference.
ALIASES: dict[str, list[str]] = {
    "capture_id": ["capture_id", "captureId", "capture", "id", "frame_id", "frameId", "metadata.capture_id"],
    "participant_id": ["participant_id", "participantId", "subject_id", "subjectId", "participant", "subject", "pid", "metadata.participant_id"],
    "session_id": ["session_id", "sessionId", "session"],
    "timestamp": ["timestamp", "time", "captured_at", "capturedAt", "date", "metadata.timestamp"],
    "vertices": ["vertices", "verts", "vertexList", "geometry.vertices", "faceGeometry.vertices", "mesh.vertices", "points"],
    "triangle_indices": ["triangleIndices", "triangle_indices", "indices", "faces", "triangles", "geometry.triangleIndices", "faceGeometry.triangleIndices", "mesh.indices"],
    "texture_coordinates": ["textureCoordinates", "texture_coordinates", "textureCoords", "uv", "uvs", "geometry.textureCoordinates"],
    "vertex_count": ["vertexCount", "vertex_count", "geometry.vertexCount"],
    "triangle_count": ["triangleCount", "triangle_count", "geometry.triangleCount"],
    "blend_shapes": ["blendShapes", "blend_shapes", "blendShapeCoefficients", "blendshapes", "expressions"],
    "transform": ["transform", "faceTransform", "anchorTransform", "modelMatrix", "worldTransform", "matrix"],
    "left_eye_transform": ["leftEyeTransform", "left_eye_transform", "leftEye.transform", "eyes.left"],
    "right_eye_transform": ["rightEyeTransform", "right_eye_transform", "rightEye.transform", "eyes.right"],
    "look_at_point": ["lookAtPoint", "look_at_point", "gaze"],
    "camera": ["camera", "cameraMetadata", "camera_metadata", "cameraInfo", "metadata.camera"],
    "camera_transform": ["cameraTransform", "camera_transform", "camera.transform", "viewMatrix"],
    "camera_intrinsics": ["cameraIntrinsics", "camera_intrinsics", "camera.intrinsics", "intrinsics"],
    "device_model": ["deviceModel", "device_model", "device", "metadata.device"],
    "tracking_state": ["trackingState", "tracking_state", "trackingQuality"],
    "coordinate_space": ["coordinateSpace", "coordinate_space", "space", "vertexSpace", "frame_of_reference"],
    "units": ["units", "unit", "lengthUnits"],
    "schema_version": ["schemaVersion", "schema_version", "version", "formatVersion"],
}
REQUIRED = ("participant_id", "vertices", "triangle_indices")
# Metres in a unit, and names of the two coordinate spaces.
UNITS = {
    "m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0,
    "cm": 0.01, "centimeter": 0.01, "centimeters": 0.01,
    "mm": 0.001, "millimeter": 0.001, "millimeters": 0.001,
}
SPACES = {
    "face": "face_local", "facelocal": "face_local", "anchor": "face_local", "local": "face_local", "model": "face_local",
    "world": "world", "global": "world", "scene": "world",
}
MAX_DEPTH = 4
_POINT = "struct<x:double,y:double,z:double>"
SCHEMA = (
    f"path string, capture_key string, participant_id string, capture_id string, timestamp string, timestamp_epoch double, units string, coordinate_space string, "
    f"points array<{_POINT}>, triangles array<struct<i:int,j:int,k:int>>, uv array<struct<u:double,v:double>>, transform array<double>, left_eye {_POINT}, right_eye {_POINT}, look_at {_POINT}, "
    "blend_shapes map<string,double>, camera string, session_id string, camera_transform string, camera_intrinsics string, device_model string, tracking_state string, schema_version string, declared_vertices int, declared_triangles int, "
    "resolved map<string,string>, missing array<string>, assumptions array<string>, error string"
)
#: Fields that are kept as they are: texts, and JSON of anything else.
BUNDLE = ("session_id", "camera_transform", "camera_intrinsics", "device_model", "tracking_state", "schema_version")
FIELDS = ["path", "capture_key", "participant_id", "capture_id", "timestamp", "timestamp_epoch", "units", "coordinate_space", "points", "triangles", "uv", "transform", "left_eye", "right_eye", "look_at", "blend_shapes", "camera", *BUNDLE, "declared_vertices", "declared_triangles", "resolved", "missing", "assumptions", "error"]


def load_aliases(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], tuple[str, ...]]:
    """(aliases, required fields) of a JSON file {"fields": {name: [key paths]}, "required": [names]}, in any store that Spark reads."""
    found = spark.read.text(path, wholetext=True).first()
    blob = json.loads(found["value"]) if found else {}
    if not isinstance(blob, dict) or not isinstance(blob.get("fields"), dict):
        raise ValueError(f"{path} holds no field map")
    return {k: list(v) for k, v in blob["fields"].items()}, tuple(blob.get("required", REQUIRED))


class Unusable(ValueError):
    """The capture has no usable mesh; its text goes to the error column."""


def norm(key: str) -> str:
    return key.lower().translate({ord(c): None for c in "_ -"})


def child(node: Any, name: str) -> Any:
    """The value under a key, the exact key before one that differs in case, underscores, spaces or hyphens."""
    if not isinstance(node, dict):
        return None
    return node[name] if name in node else next((v for k, v in node.items() if norm(k) == norm(name)), None)


def keys_below(node: Any, depth: int = MAX_DEPTH) -> Iterator[tuple[str, str, Any]]:
    """(path, key, value) of all keys of nested objects, level by level."""
    level = [("", node)]
    for _ in range(depth + 1):
        below = []
        for prefix, obj in level:
            for key, value in obj.items() if isinstance(obj, dict) else ():
                path = f"{prefix}.{key}" if prefix else key
                yield path, key, value
                if isinstance(value, dict):
                    below.append((path, value))
        level = below


def resolve(blob: dict, paths: list[str], strict: bool = True) -> tuple[Any, str | None]:
    """(value, path) of the first path that leads to a value, else of the first key anywhere with the last
    name of one. Strict: only names without a dot are searched for everywhere, so that
    `leftEye.transform` can't be taken from a `transform` of something else."""
    for path in paths:
        value: Any = blob
        for name in path.split("."):
            value = child(value, name)
        if value is not None:
            return value, path
    for path in paths:
        if strict and "." in path:
            continue
        leaf = norm(path.rsplit(".", 1)[-1])
        hit = next(((p, v) for p, k, v in keys_below(blob) if norm(k) == leaf), None)
        if hit and hit[1] is not None:
            return hit[1], hit[0]
    return None, None


def numbers(values: Any) -> list[float]:
    out = []
    for v in values:
        if isinstance(v, bool) or not isinstance(v, int | float):
            raise Unusable(f"expected a number, found {type(v).__name__}")
        out.append(float(v))
    return out


def coerce_points(raw: Any, notes: list[str]) -> list[tuple[float, float, float]]:
    """Points from nested triples or quadruples, a flat list, records, or three component lists."""
    if raw is None:
        raise Unusable("no vertex data")
    if isinstance(raw, dict):
        parts = [child(raw, a) for a in "xyz"]
        if not all(isinstance(p, list) for p in parts):
            raise Unusable("vertex components are incomplete")
        if len({len(p) for p in parts}) > 1:
            raise Unusable("vertex components differ in length")
        notes.append("vertices_from_component_arrays")
        return list(zip(*map(numbers, parts), strict=True))
    if not isinstance(raw, list):
        raise Unusable(f"vertices are of type {type(raw).__name__}")
    if not raw:
        raise Unusable("the vertex array is empty")
    if isinstance(raw[0], dict):
        notes.append("vertices_from_dict_records")
        return [tuple(numbers(child(r, a) for a in "xyz")) for r in raw]
    if not isinstance(raw[0], list):
        flat = numbers(raw)
        if len(flat) % 3:
            raise Unusable(f"{len(flat)} flat vertex numbers are not divisible by 3")
        notes.append("vertices_reshaped_from_flat_xyz")
        return [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
    widths = {len(r) if isinstance(r, list) else -1 for r in raw}
    if widths == {4}:
        notes.append("vertices_had_4_components_dropped_4th_simd_padding")
    elif widths != {3}:
        raise Unusable(f"vertex rows have lengths {sorted(widths)}")
    return [tuple(numbers(r[:3])) for r in raw]


def coerce_triangles(raw: Any, n_points: int, notes: list[str]) -> list[tuple[int, int, int]]:
    """Triangles from nested triples, a flat list, or records whose values are taken in key order."""
    if not isinstance(raw, list) or not raw:
        raise Unusable("no triangle indices")
    if isinstance(raw[0], dict):
        rows = [[v for _, v in sorted(r.items())] for r in raw]
        notes.append("triangles_from_dict_records_sorted_by_key")
    elif isinstance(raw[0], list):
        rows = raw
    else:
        if len(raw) % 3:
            raise Unusable(f"{len(raw)} flat indices are not divisible by 3")
        rows = [raw[i : i + 3] for i in range(0, len(raw), 3)]
        notes.append("triangles_reshaped_from_flat_ijk")
    if any(len(r) != 3 for r in rows):
        raise Unusable("a triangle has not three indices")
    flat = numbers(v for r in rows for v in r)
    for bad, text in ((lambda v: not v.is_integer(), "non-integer"), (lambda v: v < 0, "negative"), (lambda v: v >= n_points, "out of range")):
        if (hit := next((v for v in flat if bad(v)), None)) is not None:
            raise Unusable(f"triangle index {hit:g} is {text} for {n_points} vertices")
    return [tuple(int(v) for v in flat[i : i + 3]) for i in range(0, len(flat), 3)]


def coerce_matrix(raw: Any, notes: list[str], label: str) -> list[float] | None:
    """16 numbers, row by row, the translation in the last column; column-major dumps are turned."""
    if raw is None:
        return None
    flat = [v for r in raw for v in r] if isinstance(raw, list) and raw and all(isinstance(r, list) and len(r) == 4 for r in raw) and len(raw) == 4 else raw
    if not isinstance(flat, list) or len(flat) != 16 or any(isinstance(v, list) for v in flat):
        notes.append(f"{label}_ignored_unexpected_length_{len(flat)}" if isinstance(flat, list) else f"{label}_ignored_unexpected_shape")
        return None
    m = numbers(flat)
    affine = lambda four: all(abs(a - b) <= 1e-5 + 1e-5 * abs(b) for a, b in zip(four, (0, 0, 0, 1), strict=True))
    row, column = affine(m[12:]), affine(m[3::4])
    if column and not row:
        notes.append(f"{label}_transposed_from_column_major_simd_layout")
        return [m[4 * (i % 4) + i // 4] for i in range(16)]
    if not row:
        notes.append(f"{label}_not_affine_layout_left_as_given")
    elif column:
        notes.append(f"{label}_has_no_translation_layout_undetermined")
    return m


def coerce_blend_shapes(raw: Any, notes: list[str]) -> dict[str, float]:
    good = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)
    if isinstance(raw, dict):
        return {k: float(v) for k, v in raw.items() if good(v)}
    out = {}
    for item in raw if isinstance(raw, list) else ():
        if isinstance(item, dict):
            by = {norm(k): v for k, v in item.items()}
            name = next((by[k] for k in ("name", "location", "blendshape", "key", "id") if k in by), None)
            value = next((by[k] for k in ("value", "coefficient", "weight", "amount") if k in by), None)
            if name is not None and good(value):
                out[str(name)] = float(value)
    if out:
        notes.append("blend_shapes_from_name_value_records")
    return out


def parse_time(raw: Any) -> tuple[str | None, float | None]:
    """(text, epoch seconds): plausible epochs and ISO texts (UTC unless they say otherwise); others stay as text."""
    if raw is None or isinstance(raw, bool):
        return None, None
    if isinstance(raw, int | float):
        if 1e9 < raw < 4e9:
            return datetime.fromtimestamp(raw, UTC).isoformat(), float(raw)
        return str(raw), float(raw)
    try:
        at = datetime.fromisoformat(str(raw).strip())
    except ValueError:
        return str(raw), None
    return str(raw), (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces; whole numbers have no point."""

    def whole(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: whole(x) for k, x in v.items()}
        if isinstance(v, list):
            return [whole(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else v

    return json.dumps(whole(value), sort_keys=True, separators=(",", ":"))


def parse_capture(path: str, text: bytes | str, strict: bool = True, aliases: dict[str, list[str]] = ALIASES) -> dict:
    """One row of SCHEMA for one document; everything that goes wrong ends up in error."""
    row: dict[str, Any] = dict.fromkeys(FIELDS)
    notes: list[str] = []
    name = path.rstrip("/").split("/")
    row |= {"path": path, "capture_key": path, "assumptions": notes, "missing": [], "resolved": {}}
    try:
        blob = json.loads(text.decode() if isinstance(text, bytes | bytearray) else text)
        if not isinstance(blob, dict):
            raise Unusable("the top level is not an object")
        got = {}
        for field, paths in ({f: [f] for f in ALIASES} | aliases).items():  # a field that a map lacks goes by its own name
            got[field], at = resolve(blob, paths, strict)
            if at is None:
                row["missing"].append(field)
            else:
                row["resolved"][field] = at
        unit = str(got["units"] if got["units"] is not None else "m").strip().lower()
        if unit not in UNITS:
            notes.append(f"unknown_units_{unit}_taken_as_metres")
        scale = UNITS.get(unit, 1.0)
        points = coerce_points(got["vertices"], notes)
        row["triangles"] = [dict(zip("ijk", t, strict=True)) for t in coerce_triangles(got["triangle_indices"], len(points), notes)]
        row["points"] = [dict(zip("xyz", (c * scale for c in p), strict=True)) for p in points]
        row["units"] = unit
        if got["participant_id"] is None:
            notes.append("participant_id_from_parent_directory")
        if got["capture_id"] is None:
            notes.append("capture_id_from_filename")
        row["participant_id"] = str(got["participant_id"]) if got["participant_id"] is not None else (name[-2] if len(name) > 1 else "")
        row["capture_id"] = str(got["capture_id"]) if got["capture_id"] is not None else name[-1].rsplit(".", 1)[0]
        row["timestamp"], row["timestamp_epoch"] = parse_time(got["timestamp"])
        space = SPACES.get(norm(str(got["coordinate_space"]))) if got["coordinate_space"] is not None else None
        if space is None:
            notes.append("coordinate_space_defaulted")
        row["coordinate_space"] = space or "face_local"
        row["transform"] = coerce_matrix(got["transform"], notes, "transform")
        for side in ("left_eye", "right_eye"):
            m = coerce_matrix(got[f"{side}_transform"], notes, f"{side}_transform")
            row[side] = {"x": m[3], "y": m[7], "z": m[11]} if m else None
        if scale != 1.0 and (row["transform"] or row["left_eye"]):
            notes.append("transforms_not_rescaled_from_units")
        look = got["look_at_point"]
        row["look_at"] = dict(zip("xyz", (v * scale for v in numbers(look[:3])), strict=True)) if isinstance(look, list) and len(look) >= 3 else None
        uv = got["texture_coordinates"]
        if isinstance(uv, list) and uv and not isinstance(uv[0], list | dict):
            uv = [uv[i : i + 2] for i in range(0, len(uv), 2)] if len(uv) % 2 == 0 else None
        row["uv"] = [{"u": float(a), "v": float(b)} for a, b in uv] if isinstance(uv, list) and all(isinstance(p, list) and len(p) == 2 for p in uv) else None
        row["blend_shapes"] = coerce_blend_shapes(got["blend_shapes"], notes)
        row["camera"] = canonical(got["camera"]) if got["camera"] is not None else None
        row |= {f: v if isinstance(v, str) else canonical(v) for f in BUNDLE if (v := got.get(f)) is not None}
        row["declared_vertices"], row["declared_triangles"] = (int(v) if isinstance(v, int | float) and not isinstance(v, bool) else None for v in (got["vertex_count"], got["triangle_count"]))
    except UnicodeDecodeError as e:
        row["error"] = f"not UTF-8: byte {e.start}"
    except json.JSONDecodeError as e:
        row["error"] = f"not JSON: {e.msg} at line {e.lineno}, column {e.colno}"
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        row["error"] = str(e) or type(e).__name__
    if row["error"]:
        row["points"] = row["triangles"] = None
    return row


#: Documents whose rows leave a Python worker together; parsed, a document takes many times its bytes.
TOGETHER = 64


def parse_captures(files: DataFrame, strict: bool = True, aliases: dict[str, list[str]] = ALIASES, keep: tuple[str, ...] = (), jvm: bool = False) -> DataFrame:
    """SCHEMA rows from (path, content), with the columns to keep; works on batch and streaming inputs alike.

    jvm: well-formed documents are parsed and coerced in the JVM (`native`), without a Python worker; those
    with anything in doubt, or with an error, go through `parse_capture` in Python, with the same rows.
    Plans that use the points many times should write such rows first, as their expressions may be repeated.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (whole.iloc[at : at + TOGETHER] for whole in frames for at in range(0, len(whole), TOGETHER)):
            rows = pd.DataFrame([parse_capture(p, c, strict, aliases) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=FIELDS)
            yield pd.concat([rows, frame[list(keep)].reset_index(drop=True)], axis=1) if keep else rows

    kinds = dict(files.dtypes)
    files = files.select("path", "content", *keep)
    schema = ", ".join([SCHEMA, *(f"`{c}` {kinds[c]}" for c in keep)])
    every = {f: [f] for f in ALIASES} | aliases
    if not jvm or any(not paths or any(p.count(".") > MAX_DEPTH for p in paths) for paths in every.values()):  # beyond the levels that are searched
        return files.mapInPandas(run, schema)
    docs = native.read(files.withColumn("__text", F.col("content").cast("string")), "__text", every, BUNDLE, UNITS, SPACES, norm, strict, MAX_DEPTH)
    easy = docs.where("__good").select("path", *[F.col(f"__r_{f}").alias(f) for f in FIELDS[1:]], *keep)
    return easy.unionAll(docs.where("NOT __good").select("path", "content", *keep).mapInPandas(run, schema))


def load_captures(spark: SparkSession, root: str, strict: bool = True, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """All *.json files below a folder, in no order (`path` sorts them); like all of Spark's readers, without names that start with _ or a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    return parse_captures(files, strict, aliases)


def loaded(captures: DataFrame) -> DataFrame:
    return captures.where("error IS NULL")


#: Arrays of objects up to this length are looked into, by their first element; characters of a text that a preview shows.
MAX_ARRAY, MAX_TEXT = 6, 60


def describe(value: Any) -> str:
    """A line on a JSON value: its kind and size, and its first few items."""
    if isinstance(value, dict):
        return f"object of {len(value)} keys"
    if isinstance(value, list):
        if not value:
            return "empty array"
        head = value[0]
        if isinstance(head, dict):
            return f"array of {len(value)} objects with keys {', '.join(sorted(head)[:5])}"
        if isinstance(head, list):
            return f"array of {len(value)} arrays of {len(head)}"
        return f"array of {len(value)}: {', '.join(json.dumps(v) for v in value[:3])}"
    text = json.dumps(value, ensure_ascii=False)
    return text if len(text) <= MAX_TEXT else text[: MAX_TEXT - 3] + "..."


def tree_rows(node: Any, depth: int, level: int = 0, prefix: str = "") -> Iterator[tuple[str, int, Any]]:
    """(path, level, value) of all keys, in the order of their names; short arrays of objects go on with path[0]."""
    if not isinstance(node, dict) or level > depth:
        return
    for key in sorted(node):
        value, path = node[key], f"{prefix}.{key}" if prefix else key
        yield path, level, value
        if isinstance(value, dict):
            yield from tree_rows(value, depth, level + 1, path)
        elif isinstance(value, list) and value and isinstance(value[0], dict) and len(value) <= MAX_ARRAY:
            yield from tree_rows(value[0], depth, level + 1, f"{path}[0]")


#: Texts that the JVM's variant reads or writes otherwise than `describe`: exponents, digits beyond a double's, tiny or negative zeros, escapes, other than ASCII.
ODD_JSON = r"[0-9][eE]|[0-9]{16,}|-0|0\.0000|\\u|[^\x00-\x7F]"


def _variant_kind(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    word = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
    return word.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")


def _dumped(v: Column) -> Column:
    """A scalar's text; a whole number that was written with a point keeps it."""
    whole = F.schema_of_variant(v).rlike("^DECIMAL.*,0.$")
    return F.when(whole, F.concat(F.to_json(v), F.lit(".0"))).otherwise(F.to_json(v))


def _described(v: Column, kind: Column) -> Column:
    """`describe` of a variant."""
    items, fields = native.items(v), lambda x: F.map_keys(native.fields(x))
    head = F.get(items, F.lit(0))
    of = _variant_kind(head)
    n = F.size(items).cast("string")
    array = F.when(F.size(items) == 0, "empty array")
    array = array.when(of == "object", F.concat(F.lit("array of "), n, F.lit(" objects with keys "), F.array_join(F.slice(F.array_sort(fields(head)), 1, 5), ", ")))
    array = array.when(of == "array", F.concat(F.lit("array of "), n, F.lit(" arrays of "), F.size(native.items(head)).cast("string")))
    array = array.otherwise(F.concat(F.lit("array of "), n, F.lit(": "), F.array_join(F.transform(F.slice(items, 1, 3), _dumped), ", ")))
    scalar = native.let(_dumped(v), lambda t: F.when(F.length(t) <= MAX_TEXT, t).otherwise(F.concat(F.substring(t, 1, MAX_TEXT - 3), F.lit("..."))))
    return F.when(kind == "object", F.concat(F.lit("object of "), F.size(fields(v)).cast("string"), F.lit(" keys"))).when(kind == "array", array).otherwise(scalar)


def _plain_array(v: Column) -> Column:
    """Whether a variant array holds only scalars, objects first, or arrays first: what previews show without writing nested values."""
    items = native.items(v)
    first = _variant_kind(F.get(items, F.lit(0)))
    return first.isin("object", "array") | ~F.exists(F.slice(items, 1, 3), lambda x: _variant_kind(x).isin("object", "array"))


def _variant_tree(v: Column, depth: int) -> Column:
    """Array of (key_path, depth, value, kind) of all keys, level by level: a fold over the levels of one document."""
    row = "struct<key_path:string,depth:int,value:variant,kind:string>"

    def below(node: Column, level: Column) -> Column:
        path = lambda e: F.when(node["prefix"] == "", e["key"]).otherwise(F.concat(node["prefix"], F.lit("."), e["key"]))
        return F.transform(F.map_entries(native.fields(node["value"])), lambda e: F.struct(path(e).alias("key_path"), level.alias("depth"), e["value"].alias("value"), _variant_kind(e["value"]).alias("kind")))

    def onward(entries: Column) -> Column:
        objects = F.transform(F.filter(entries, lambda e: e["kind"] == "object"), lambda e: F.struct(e["key_path"].alias("prefix"), e["value"].alias("value")))
        items = lambda e: native.items(e["value"])
        short = F.filter(F.filter(entries, lambda e: e["kind"] == "array"), lambda e: (F.size(items(e)) > 0) & (F.size(items(e)) <= MAX_ARRAY) & (_variant_kind(F.get(items(e), F.lit(0))) == "object"))
        return F.concat(objects, F.transform(short, lambda e: F.struct(F.concat(e["key_path"], F.lit("[0]")).alias("prefix"), F.get(items(e), F.lit(0)).alias("value"))))

    def step(state: Column, level: Column) -> Column:
        entries = F.flatten(F.transform(state["nodes"], lambda n: below(n, level)))
        return native.let(entries, lambda e: F.struct(F.concat(state["rows"], e).alias("rows"), onward(e).alias("nodes")))

    start = F.struct(F.array().cast(f"array<{row}>").alias("rows"), F.array(F.struct(F.lit("").alias("prefix"), v.alias("value"))).alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, step, lambda s: s["rows"])


def key_tree(documents: DataFrame, column: str = "content", depth: int = MAX_DEPTH) -> DataFrame:
    """(path, key_path, depth, kind, preview) of every key of every document; a document that is no JSON object has none.

    Documents are parsed and searched as variants, in the JVM. Those that the variant refuses (or that
    hold what it writes differently, see ODD_JSON) go through Python, with the same rows.
    """
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["__text"], strict=True):
                try:
                    blob = json.loads(text)
                except (ValueError, TypeError):
                    continue
                out += [(path, p, level, kinds.get(type(v), "number"), describe(v)) for p, level, v in tree_rows(blob, depth)]
            yield pd.DataFrame(out, columns=["path", "key_path", "depth", "kind", "preview"])

    kind = documents.schema["path"].dataType.simpleString()
    docs = documents.select("path", F.col(column).cast("string").alias("__text")).where("__text IS NOT NULL")
    docs = docs.withColumn("__v", F.when(~F.col("__text").rlike(ODD_JSON), F.try_parse_json("__text")))
    trees = docs.where("__v IS NOT NULL").where(_variant_kind(F.col("__v")) == "object").select("path", "__text", _variant_tree(F.col("__v"), depth).alias("__rows"))
    nested = F.exists("__rows", lambda r: F.when(r["kind"] == "array", ~_plain_array(r["value"])).otherwise(F.lit(False)))
    trees = trees.withColumn("__hard", nested)
    easy = trees.where("NOT __hard").select("path", F.explode("__rows").alias("r"))
    easy = easy.select("path", "r.key_path", "r.depth", "r.kind", _described(F.col("r.value"), F.col("r.kind")).alias("preview"))
    hard = docs.where("__v IS NULL").select("path", "__text").unionAll(trees.where("__hard").select("path", "__text"))
    return easy.unionAll(hard.mapInPandas(run, f"path {kind}, key_path string, depth int, kind string, preview string"))


def summaries(captures: DataFrame) -> DataFrame:
    """A capture's facts in one row: sizes, declared frame, bounds and diagonal in metres, what is there and what is not."""
    side = lambda f, a: f(F.transform("points", lambda p: p[a]))
    bounds = {f"{name}_{a}": side(f, a) for a in "xyz" for name, f in (("min", F.array_min), ("max", F.array_max))}
    c = captures.where("error IS NULL").withColumns(bounds)
    diagonal = F.sqrt(sum((F.pow(F.col(f"max_{a}") - F.col(f"min_{a}"), 2) for a in "xyz"), F.lit(0.0)))
    return c.select(
        "capture_key", "participant_id", "capture_id", "timestamp", "coordinate_space", "units", F.size("points").alias("n_vertices"), F.size("triangles").alias("n_triangles"), *bounds,
        diagonal.alias("bbox_diagonal"), F.coalesce(F.size("blend_shapes"), F.lit(0)).alias("n_blend_shapes"), (F.col("left_eye").isNotNull() & F.col("right_eye").isNotNull()).alias("has_eyes"),
        F.array_join("missing", ", ").alias("unresolved"), F.array_join("assumptions", ", ").alias("assumed"),
    )


def inspect_schema(captures: DataFrame) -> DataFrame:
    """(field, required, n_found, n_missing, paths): where the cohort has each canonical field."""
    every = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(f in REQUIRED).alias("required")) for f in ALIASES])
    rows = captures.select("resolved", F.explode(every).alias("f")).select("f.*", F.try_element_at("resolved", F.col("f.field")).alias("at"))
    return rows.groupBy("field", "required").agg(F.count("at").alias("n_found"), F.count_if(F.col("at").isNull()).alias("n_missing"), F.array_sort(F.collect_set("at")).alias("paths"))
