"""Named vertices: a landmark set is a small map from names to vertex indices on one topology."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Landmark names, and the pairs that must be set on both sides or neither.
NAMES = (
    "nasion", "nose_tip", "subnasale", "nose_left_ala", "nose_right_ala", "left_eye_inner", "left_eye_outer", "right_eye_inner", "right_eye_outer",
    "mouth_left_corner", "mouth_right_corner", "upper_lip_centre", "lower_lip_centre", "chin_tip", "menton", "left_gonion", "right_gonion",
    "left_zygion", "right_zygion", "trichion", "glabella",
)
PAIRS = (
    ("left_eye_inner", "right_eye_inner"), ("left_eye_outer", "right_eye_outer"), ("nose_left_ala", "nose_right_ala"),
    ("mouth_left_corner", "mouth_right_corner"), ("left_gonion", "right_gonion"), ("left_zygion", "right_zygion"),
)
# Measured distances and the landmarks they lie between.
DISTANCES = {
    "lm_eye_spacing_inner": ("left_eye_inner", "right_eye_inner"), "lm_eye_spacing_outer": ("left_eye_outer", "right_eye_outer"),
    "lm_left_eye_width": ("left_eye_inner", "left_eye_outer"), "lm_right_eye_width": ("right_eye_inner", "right_eye_outer"),
    "lm_nose_width": ("nose_left_ala", "nose_right_ala"), "lm_nose_height": ("nasion", "subnasale"),
    "lm_mouth_width": ("mouth_left_corner", "mouth_right_corner"), "lm_jaw_width": ("left_gonion", "right_gonion"),
    "lm_cheekbone_width": ("left_zygion", "right_zygion"), "lm_chin_height": ("subnasale", "menton"), "lm_upper_third": ("trichion", "glabella"),
    "lm_middle_third": ("glabella", "subnasale"), "lm_lower_third": ("subnasale", "menton"),
}


@dataclass
class LandmarkSet:
    indices: dict[str, int] = field(default_factory=dict)
    vertex_count: int | None = None

    @classmethod
    def loads(cls, text: str) -> LandmarkSet:
        d = json.loads(text)
        return cls({k: int(v) for k, v in d.get("landmarks", {}).items() if v is not None}, d.get("topology", {}).get("vertex_count"))

    def dumps(self) -> str:
        every = {n: self.indices.get(n) for n in (*NAMES, *(n for n in self.indices if n not in NAMES))}
        return json.dumps({"topology": {"vertex_count": self.vertex_count}, "landmarks": every}, indent=2)

    def set(self, name: str, vid: int) -> LandmarkSet:
        return LandmarkSet({**self.indices, name: vid}, self.vertex_count)

    def defined(self) -> list[str]:
        return sorted(self.indices)

    def has(self, *names: str) -> bool:
        return all(n in self.indices for n in names)

    def one_sided(self) -> list[tuple[str, str]]:
        return [(a, b) for a, b in PAIRS if (a in self.indices) != (b in self.indices)]

    def applies(self) -> Column:
        """Whether the set was made on a mesh with as many vertices."""
        return F.lit(True) if self.vertex_count is None else F.size("points") == self.vertex_count

    def point(self, name: str) -> Column:
        """The landmark's point in a capture row; NULL if it is not defined, out of range, or on another topology."""
        if name not in self.indices:
            return F.lit(None).cast("struct<x:double,y:double,z:double>")
        return F.when(self.applies(), F.get("points", F.lit(self.indices[name])))

    def distance(self, a: str, b: str) -> Column:
        p, q = self.point(a), self.point(b)
        return F.sqrt(sum((F.pow(p[c] - q[c], 2) for c in "xyz"), F.lit(0.0)))


#: Ratios of two distances.
RATIOS = {"lm_jaw_cheekbone_ratio": ("lm_jaw_width", "lm_cheekbone_width"), "lm_mouth_nose_ratio": ("lm_mouth_width", "lm_nose_width")}


def landmark_features(captures: DataFrame, marks: LandmarkSet) -> DataFrame:
    """The distances and two ratios; row expressions, NULL where a landmark is missing."""
    d = captures.select("capture_key", *(marks.distance(a, b).alias(n) for n, (a, b) in DISTANCES.items()))
    return d.withColumns({name: F.try_divide(a, b) for name, (a, b) in RATIOS.items()})


def missing(marks: LandmarkSet, feature: str) -> str:
    """Why a landmark feature has no value, as far as the set tells: nothing is defined, the landmarks that lack, or the mesh."""
    if not marks.indices:
        return "no landmark is defined"
    needed = {n for d in RATIOS.get(feature, (feature,)) for n in DISTANCES[d]}
    if lacking := sorted(needed - set(marks.indices)):
        return f"not defined: {', '.join(lacking)}"
    return "landmarks belong to another mesh topology"


def report(marks: LandmarkSet) -> str:
    """Each landmark with its vertex, the mesh that the set belongs to, and pairs that are set on one side only."""
    lines = [f"{n:<20}{marks.indices.get(n, '-')}" for n in (*NAMES, *(n for n in marks.indices if n not in NAMES))]
    head = f"{len(marks.indices)} landmarks of a mesh of {marks.vertex_count or '?'} vertices"
    return "\n".join([head, *lines, *(f"on one side only: {a}, {b}" for a, b in marks.one_sided())])


def mismatched(captures: DataFrame, marks: LandmarkSet) -> DataFrame:
    """(capture_key, n_vertices) of captures to which the set doesn't apply."""
    return captures.where(~marks.applies()).select("capture_key", F.size("points").alias("n_vertices"))


def check(captures: DataFrame, marks: LandmarkSet) -> DataFrame:
    """(n_vertices, n_captures, applies) of the cohort's topologies."""
    return captures.select(F.size("points").alias("n_vertices"), marks.applies().alias("applies")).groupBy("n_vertices", "applies").agg(F.count(F.lit(1)).alias("n_captures"))


def verify(captures: DataFrame, marks: LandmarkSet) -> DataFrame:
    """(capture_key, name, x, y, z) of all defined landmarks, for a look at where they sit."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), marks.point(n).alias("p")) for n in marks.defined()]) if marks.indices else F.array().cast("array<struct<name:string,p:struct<x:double,y:double,z:double>>>")
    return captures.select("capture_key", F.explode(rows).alias("m")).select("capture_key", "m.name", "m.p.x", "m.p.y", "m.p.z").where("x IS NOT NULL")
