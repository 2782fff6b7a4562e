"""Capture documents parsed, searched and coerced in the JVM, as variants and higher-order functions.

Only well-formed documents are taken: a row is good when nothing about it is in doubt. All others (and
whatever a variant would read or order differently) are left to the Python reader, which has the reasons.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of arrays and objects of numbers, by the characters of their JSON as a variant writes it; what these let through and has another form is NULL once typed.
SHAPES = {
    "FLAT": r"^\[[-+0-9.,E]+\]$", "NESTED": r"^\[\[[-+0-9.,E\[\]]+\]\]$", "XYZ": r'^\[\{[-+0-9.,E{}"xyz:]+\}\]$', "PARTS": r'^\{[-+0-9.,E\[\]"xyz:]+\}$',
    "RECORDS": r"^\[\{", "ARRAY": r"^\[", "OBJECT": r"^\{",
}
NUMBER = r"^(DOUBLE|DECIMAL\([0-9]+,[0-9]+\)|BIGINT)$"
#: Texts with anything but plain ASCII are left to Python, whose lower case and escapes differ.
ODD_TEXT = r"\\u|[^\x00-\x7F]"
#: ISO times whose epoch is told by arithmetic alone.
ISO = r"^(\d{4}-\d{2}-\d{2})T([01]\d|2[0-3]):([0-5]\d):([0-5]\d)(?:\.(\d{3}|\d{6}))?(Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def once(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """docs with a column that is computed once a row: neither filters nor later columns are merged with a generator's expression."""
    return docs.select("*", F.explode(F.array(value)).alias(name))


def _norm(key: Column) -> Column:
    return F.translate(F.lower(key), "_ -", "")


def _full(values: Column) -> Column:
    """Whether an array is there and has no null."""
    return F.coalesce(F.forall(values, lambda x: x.isNotNull()), F.lit(False))


def entries(v: Column, depth: int) -> Column:
    """Array of (at, norm, leaf, level, value) of all keys of nested objects, level by level."""
    row = "struct<at:string,norm:string,leaf:string,level:int,value:variant>"
    dotted = lambda prefix, name: F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit("."), name))

    def below(node: Column, level: Column) -> Column:
        leaf = lambda e: F.struct(
            dotted(node["at"], e["key"]).alias("at"), dotted(node["norm"], _norm(e["key"])).alias("norm"), _norm(e["key"]).alias("leaf"), level.alias("level"), e["value"].alias("value")
        )
        return F.coalesce(F.transform(F.map_entries(fields(node["value"])), leaf), F.array().cast(f"array<{row}>"))

    def step(state: Column, level: Column) -> Column:
        found = F.flatten(F.transform(state["nodes"], lambda n: below(n, level)))
        return let(found, lambda e: F.struct(F.concat(state["rows"], e).alias("rows"), F.filter(e, lambda x: fields(x["value"]).isNotNull()).alias("nodes")))

    root = F.struct(F.lit("").alias("at"), F.lit("").alias("norm"), F.lit("").alias("leaf"), F.lit(-1).alias("level"), v.alias("value"))
    start = F.struct(F.array().cast(f"array<{row}>").alias("rows"), F.array(root).cast(f"array<{row}>").alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, step, lambda s: s["rows"])


def resolved(keys: Column, aliases: dict[str, list[str]], norm: Callable[[str], str], strict: bool) -> Column:
    """Array of (field, at, value, unclear) in the order of the aliases; unclear: two keys of one level answer to a name that is searched for everywhere."""
    path = lambda p: {"at": p, "norm": ".".join(map(norm, p.split(".")))}
    names = lambda paths: [norm(p.rsplit(".", 1)[-1]) for p in paths if not (strict and "." in p)]
    there = lambda value: value.isNotNull() & ~F.is_variant_null(value)

    def search(s: Column) -> Column:
        exact = lambda p: F.get(F.filter(keys, lambda e: e["norm"] == p["norm"]), F.lit(0))["value"]
        first = F.get(F.filter(F.transform(s["paths"], lambda p: F.struct(p["at"].alias("at"), exact(p).alias("value"), F.lit(False).alias("unclear"))), lambda h: there(h["value"])), F.lit(0))
        one = lambda hits: F.struct(
            F.get(hits, F.lit(0))["at"].alias("at"), F.get(hits, F.lit(0))["value"].alias("value"), F.coalesce(F.get(hits, F.lit(0))["level"] == F.get(hits, F.lit(1))["level"], F.lit(False)).alias("unclear")
        )
        every = F.transform(s["names"], lambda n: let(F.filter(keys, lambda e: e["leaf"] == n), one))
        anywhere = let(every, lambda a: let(F.get(F.filter(a, lambda h: there(h["value"])), F.lit(0)), lambda h: F.struct(h["at"].alias("at"), h["value"].alias("value"), F.exists(a, lambda x: x["unclear"]).alias("unclear"))))
        return F.coalesce(first, anywhere)

    table = [{"field": f, "paths": list(map(path, paths)), "names": names(paths)} for f, paths in aliases.items()]
    specs = F.from_json(F.lit(json.dumps(table)), "array<struct<field:string,paths:array<struct<at:string,norm:string>>,names:array<string>>>")
    return F.transform(specs, lambda s: let(search(s), lambda h: F.struct(s["field"].alias("field"), h["at"].alias("at"), h["value"].alias("value"), h["unclear"].alias("unclear"))))


def _seen(v: Column) -> Column:
    """(kind, text) of a variant: one of SHAPES, or a scalar's type. The schema of a long array would cost more than all the rest."""

    def kind(t: Column) -> Column:
        shape = F.coalesce(*[F.when(t.rlike(p), name) for name, p in SHAPES.items()])
        return F.when(t.rlike(r"^[\[{]"), shape).when(t.isNotNull(), F.schema_of_variant(v))

    return let(F.to_json(v), lambda t: F.struct(kind(t).alias("kind"), t.alias("text")))


def _flat(text: Column, width: str = "double") -> Column:
    return F.from_json(text, f"array<{width}>")


def _chunks(values: Column, n: int, body: Callable[[Column], Column]) -> Column:
    """body(place of the first) for every n values in a row; their number is divisible by n."""
    return F.transform(F.sequence(F.lit(0), (F.size(values) / n).cast("int") - 1), lambda i: body(i * n))


def _sized(rows: Column, size: int) -> Column:
    """Whether nested rows all have one size and no null."""
    return F.coalesce(F.forall(rows, lambda x: (F.size(x) == size) & _full(x)), F.lit(False))


def _rows_of(text: Column, width: str, size: int) -> Column:
    """Nested rows that all have one size and no null, else NULL."""
    return let(F.from_json(text, f"array<array<{width}>>"), lambda r: F.when(_sized(r, size), r))


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def points(text: Column, kind: Column) -> Column:
    """(points, note) of nested triples or quadruples, a flat list, records or component lists without a null; else NULL."""
    made = lambda p, note=None: F.struct(p.alias("points"), F.lit(note).cast("string").alias("note"))
    nested = lambda r: F.transform(r, lambda p: _point(p[0], p[1], p[2]))
    padding = "vertices_had_4_components_dropped_4th_simd_padding"
    triples = let(F.from_json(text, "array<array<double>>"), lambda r: F.when(_sized(r, 3), made(nested(r))).when(_sized(r, 4), made(nested(r), padding)))
    flat = let(
        _flat(text),
        lambda r: F.when(_full(r) & (F.size(r) % 3 == 0), made(_chunks(r, 3, lambda i: _point(F.get(r, i), F.get(r, i + 1), F.get(r, i + 2))), "vertices_reshaped_from_flat_xyz")),
    )
    whole = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull()
    records = let(
        F.from_json(text, "array<struct<x:double,y:double,z:double>>"),
        lambda r: F.when(F.coalesce(F.forall(r, lambda p: p.isNotNull() & whole(p)), F.lit(False)), made(r, "vertices_from_dict_records")),
    )
    parts = let(
        F.from_json(text, "struct<x:array<double>,y:array<double>,z:array<double>>"),
        lambda r: F.when(
            _full(r["x"]) & _full(r["y"]) & _full(r["z"]) & (F.size(r["x"]) == F.size(r["y"])) & (F.size(r["x"]) == F.size(r["z"])),
            made(F.transform(r["x"], lambda x, i: _point(x, F.get(r["y"], i), F.get(r["z"], i))), "vertices_from_component_arrays"),
        ),
    )
    return F.when(kind == "NESTED", triples).when(kind == "FLAT", flat).when(kind == "XYZ", records).when(kind == "PARTS", parts)


def triangles(text: Column, kind: Column, n_points: Column) -> Column:
    """(triangles, note) of nested triples, a flat list, or records in key order, all indices whole and in range; else NULL."""
    corner = lambda c: c.cast("int")
    inside = lambda i: i.isNotNull() & (i >= 0) & (i < n_points)
    made = lambda rows, note=None: F.struct(rows.alias("triangles"), F.lit(note).cast("string").alias("note"))
    triple = lambda t: F.struct(corner(t[0]).alias("i"), corner(t[1]).alias("j"), corner(t[2]).alias("k"))
    ranged = lambda rows: F.coalesce(F.forall(rows, lambda t: F.forall(t, inside)), F.lit(False))
    nested = let(_rows_of(text, "bigint", 3), lambda r: F.when(ranged(r), made(F.transform(r, triple))))
    flat = let(
        _flat(text, "bigint"),
        lambda r: F.when(
            F.coalesce(F.forall(r, inside), F.lit(False)) & (F.size(r) % 3 == 0),
            made(_chunks(r, 3, lambda i: F.struct(corner(F.get(r, i)).alias("i"), corner(F.get(r, i + 1)).alias("j"), corner(F.get(r, i + 2)).alias("k"))), "triangles_reshaped_from_flat_ijk"),
        ),
    )
    ordered = F.transform(F.from_json(text, "array<map<string,bigint>>"), lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.try_element_at(m, k)))
    records = let(ordered, lambda r: F.when(F.coalesce(F.forall(r, lambda t: F.size(t) == 3), F.lit(False)) & ranged(r), made(F.transform(r, triple), "triangles_from_dict_records_sorted_by_key")))
    return F.when(kind == "NESTED", nested).when(kind == "FLAT", flat).when(kind.isin("RECORDS", "XYZ"), records)


def matrix(text: Column, kind: Column, label: str) -> Column:
    """(m, note) of 16 numbers or four rows of four, the translation in the last column; else NULL."""
    flat = F.when(kind == "FLAT", _flat(text)).when(kind == "NESTED", let(_rows_of(text, "double", 4), lambda r: F.when(F.size(r) == 4, F.flatten(r))))
    near = lambda x, to: F.abs(x - to) <= 1e-5 + 1e-5 * to
    affine = lambda m, places: near(m[places[0]], 0.0) & near(m[places[1]], 0.0) & near(m[places[2]], 0.0) & near(m[places[3]], 1.0)

    def made(m: Column) -> Column:
        row, column = affine(m, (12, 13, 14, 15)), affine(m, (3, 7, 11, 15))
        turned = F.array(*[m[4 * (i % 4) + i // 4] for i in range(16)])
        note = F.when(column & ~row, f"{label}_transposed_from_column_major_simd_layout").when(~row, f"{label}_not_affine_layout_left_as_given").when(column, f"{label}_has_no_translation_layout_undetermined")
        return F.struct(F.when(column & ~row, turned).otherwise(m).alias("m"), note.alias("note"))

    return let(flat, lambda m: F.when(_full(m) & (F.size(m) == 16), made(m)))


def pairs(text: Column, kind: Column) -> Column:
    """Texture coordinates of nested pairs or a flat list, without a null."""
    pair = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    nested = let(_rows_of(text, "double", 2), lambda r: F.transform(r, lambda p: pair(p[0], p[1])))
    flat = let(_flat(text), lambda r: F.when(_full(r) & (F.size(r) % 2 == 0), _chunks(r, 2, lambda i: pair(F.get(r, i), F.get(r, i + 1)))))
    return F.when(kind == "NESTED", nested).when(kind == "FLAT", flat)


def coefficients(v: Column) -> Column:
    """The finite numbers of an object by key."""
    number = lambda x: F.schema_of_variant(x).rlike(NUMBER)
    values = F.transform_values(F.map_filter(fields(v), lambda k, x: number(x)), lambda k, x: F.try_variant_get(x, "$", "double"))
    return F.map_filter(values, lambda k, x: (F.abs(x) < float("inf")) & ~F.isnan(x))


def time_of(v: Column, kind: Column) -> Column:
    """(text, epoch) of whole epoch seconds and of ISO texts, by arithmetic and so in any session's zone; else NULL."""
    whole = F.try_variant_get(v, "$", "bigint")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")

    def clock(t: Column) -> Column:
        day, rest = F.date_from_unix_date(F.floor(t / 86400).cast("int")), t % 86400
        return F.concat(day.cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("+00:00"))

    number = let(whole, lambda t: F.struct(F.when((t > 1_000_000_000) & (t < 4_000_000_000), clock(t)).otherwise(t.cast("string")).alias("text"), t.cast("double").alias("epoch")))

    def iso(s: Column) -> Column:
        group = lambda i: F.regexp_extract(s, ISO, i)
        n = lambda c: F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
        day, zone = F.unix_date(group(1).try_cast("date")).cast("long"), group(6)
        sign = F.when(zone.startswith("-"), -1).otherwise(1)
        away = sign * (n(F.substring(zone, 2, 2)) * 3600 + n(F.substring(zone, 5, 2)) * 60)
        seconds = day * 86400 + n(group(2)) * 3600 + n(group(3)) * 60 + n(group(4)) - away
        micros = n(F.rpad(group(5), 6, "0"))
        return F.when(s.rlike(ISO) & day.isNotNull() & ~s.startswith("0000"), F.struct(s.alias("text"), ((seconds * 1_000_000 + micros) / 1_000_000.0).alias("epoch")))

    return F.when(kind == "BIGINT", number).when(kind == "STRING", let(F.try_variant_get(v, "$", "string"), iso))


def text_of(v: Column, kind: Column) -> Column:
    """A string, or a whole number's digits; else NULL."""
    return F.when(kind.isin("STRING", "BIGINT"), F.try_variant_get(v, "$", "string"))


def dumped(v: Column, text: Column) -> Column:
    """JSON with sorted keys and no spaces; NULL for numbers that a variant writes otherwise than Python."""
    return F.when(~F.schema_of_variant(v).rlike("DOUBLE|VARIANT") & ~text.rlike(r"[0-9.]{16,}"), text)


def read(docs: DataFrame, text: str, aliases: dict[str, list[str]], bundle: tuple[str, ...], units: dict[str, float], spaces: dict[str, str], norm: Callable[[str], str], strict: bool, depth: int) -> DataFrame:
    """Documents with `__good` and, where that holds, one column for each part of a capture's row (`__r_...`)."""
    place = {f: i for i, f in enumerate(aliases)}
    got = lambda f: F.col("__got")[place[f]]["value"]
    kind = lambda f: F.col("__seen")[place[f]]["kind"]
    text_at = lambda f: F.col("__seen")[place[f]]["text"]
    words = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    blob = F.when(~F.col(text).rlike(ODD_TEXT), F.try_parse_json(F.col(text)))
    docs = once(docs, "__keys", let(blob, lambda v: F.when(fields(v).isNotNull(), entries(v, depth))))
    docs = once(docs, "__got", resolved(F.col("__keys"), aliases, norm, strict))
    docs = once(docs, "__seen", F.transform("__got", lambda g: _seen(g["value"])))
    parts = {
        "points": points(text_at("vertices"), kind("vertices")),
        "transform": matrix(text_at("transform"), kind("transform"), "transform"),
        "left": matrix(text_at("left_eye_transform"), kind("left_eye_transform"), "left_eye_transform"),
        "right": matrix(text_at("right_eye_transform"), kind("right_eye_transform"), "right_eye_transform"),
        "uv": pairs(text_at("texture_coordinates"), kind("texture_coordinates")),
        "look": F.when(kind("look_at_point") == "FLAT", let(_flat(text_at("look_at_point")), lambda r: F.when(_full(r), r))),
        "blend": F.when(kind("blend_shapes").isin("OBJECT", "PARTS"), coefficients(got("blend_shapes"))),
        "time": time_of(got("timestamp"), kind("timestamp")),
        "units": F.when(kind("units").isNull(), "m").when(kind("units") == "STRING", F.lower(F.trim(F.try_variant_get(got("units"), "$", "string")))),
        "space": F.when(kind("coordinate_space") == "STRING", _norm(F.try_variant_get(got("coordinate_space"), "$", "string"))),
        "participant_id": text_of(got("participant_id"), kind("participant_id")),
        "capture_id": text_of(got("capture_id"), kind("capture_id")),
        **{f"n_{f}": F.when(kind(f) == "BIGINT", F.try_variant_get(got(f), "$", "int")) for f in ("vertex_count", "triangle_count")},
        "camera": dumped(got("camera"), text_at("camera")),
        **{f: F.when(kind(f) == "STRING", F.try_variant_get(got(f), "$", "string")).otherwise(dumped(got(f), text_at(f))) for f in bundle},
    }
    docs = once(docs, "__part", F.struct(*[c.alias(f) for f, c in parts.items()]))
    part = lambda f: F.col("__triangles") if f == "triangles" else F.col("__part")[f]
    docs = once(docs, "__triangles", triangles(text_at("triangle_indices"), kind("triangle_indices"), F.size(part("points")["points"])))
    given = {
        "transform": "transform", "left": "left_eye_transform", "right": "right_eye_transform", "uv": "texture_coordinates", "look": "look_at_point", "blend": "blend_shapes", "time": "timestamp",
        "space": "coordinate_space", "participant_id": "participant_id", "capture_id": "capture_id", "n_vertex_count": "vertex_count", "n_triangle_count": "triangle_count", "camera": "camera", **{f: f for f in bundle},
    }
    keys = F.col("__keys")
    good = keys.isNotNull() & ~F.exists(keys, lambda e: F.contains(e["leaf"], F.lit("."))) & (F.size(F.array_distinct(F.transform(keys, lambda e: e["norm"]))) == F.size(keys))
    good = good & ~F.exists("__got", lambda g: g["unclear"]) & part("points").isNotNull() & part("triangles").isNotNull() & part("units").isNotNull() & ~part("units").rlike("[^ -~]")
    for p, f in given.items():
        good = good & (kind(f).isNull() | part(p).isNotNull())
    docs = docs.withColumn("__good", F.coalesce(good, F.lit(False)))

    scale = F.coalesce(F.try_element_at(words(units), part("units")), F.lit(1.0))
    space = F.try_element_at(words(spaces), part("space"))
    spot = lambda m: F.when(m.isNotNull(), _point(m[3], m[7], m[11]))
    steps = F.split(F.regexp_replace("path", r"/+\z", ""), "/")
    folder, file = F.coalesce(F.get(steps, F.size(steps) - 2), F.lit("")), F.regexp_replace(F.get(steps, F.size(steps) - 1), r"\.[^.]*\z", "")
    moved = part("transform").isNotNull() | part("left").isNotNull()
    notes = F.array_compact(F.array(
        F.when(~part("units").isin(*units), F.concat(F.lit("unknown_units_"), part("units"), F.lit("_taken_as_metres"))), part("points")["note"], part("triangles")["note"],
        F.when(kind("participant_id").isNull(), "participant_id_from_parent_directory"), F.when(kind("capture_id").isNull(), "capture_id_from_filename"), F.when(space.isNull(), "coordinate_space_defaulted"),
        part("transform")["note"], part("left")["note"], part("right")["note"], F.when((scale != 1.0) & moved, "transforms_not_rescaled_from_units"),
    ))
    look = part("look")
    rows = {
        "capture_key": F.col("path"), "participant_id": F.coalesce(part("participant_id"), folder), "capture_id": F.coalesce(part("capture_id"), file),
        "timestamp": part("time")["text"], "timestamp_epoch": part("time")["epoch"], "units": part("units"), "coordinate_space": F.coalesce(space, F.lit("face_local")),
        "points": F.transform(part("points")["points"], lambda p: _point(p["x"] * scale, p["y"] * scale, p["z"] * scale)), "triangles": part("triangles")["triangles"], "uv": part("uv"),
        "transform": part("transform")["m"], "left_eye": spot(part("left")["m"]), "right_eye": spot(part("right")["m"]),
        "look_at": F.when(F.size(look) >= 3, _point(F.get(look, F.lit(0)) * scale, F.get(look, F.lit(1)) * scale, F.get(look, F.lit(2)) * scale)),
        "blend_shapes": F.coalesce(part("blend"), F.create_map().cast("map<string,double>")), "camera": part("camera"), **{f: part(f) for f in bundle},
        "declared_vertices": part("n_vertex_count"), "declared_triangles": part("n_triangle_count"),
        "resolved": F.map_from_entries(F.transform(F.filter("__got", lambda g: g["at"].isNotNull()), lambda g: F.struct(g["field"], g["at"]))),
        "missing": F.transform(F.filter("__got", lambda g: g["at"].isNull()), lambda g: g["field"]), "assumptions": notes, "error": F.lit(None).cast("string"),
    }
    return docs.withColumns({f"__r_{f}": c for f, c in rows.items()})
