"""Axis detection, canonical frames, scale, and Procrustes alignment."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import skewness
from ..functions.geometry import clouds, nested
from ..sources.tables import vertices
from .symmetry import Nearest, point_array

AXES = "xyz"
ORIGINS = ("centroid", "eye_midpoint", "nose_tip_extremum")
SCALES = ("centroid_size", "interocular", "none")


@dataclass
class AxisConvention:
    """For each canonical direction the raw axis (0..2) and sign."""

    left: tuple[int, int]
    superior: tuple[int, int]
    anterior: tuple[int, int]
    evidence: dict = field(default_factory=dict)
    confirmed_by_user: bool = False

    def matrix(self) -> np.ndarray:
        out = np.zeros((3, 3))
        for row, (axis, sign) in enumerate((self.left, self.superior, self.anterior)):
            out[row, axis] = sign
        return out

    def right_handed(self) -> bool:
        return bool(np.linalg.det(self.matrix()) > 0)

    def columns(self, p: Column | None = None) -> list[Column]:
        """The canonical x, y, z of a point as expressions."""
        at = lambda axis: F.col(AXES[axis]) if p is None else p[AXES[axis]]
        return [(at(axis) * float(sign)).alias(name) for name, (axis, sign) in zip(AXES, (self.left, self.superior, self.anterior), strict=True)]

    def dumps(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def loads(cls, text: str) -> AxisConvention:
        d = json.loads(text)
        return cls(tuple(d["left"]), tuple(d["superior"]), tuple(d["anterior"]), d.get("evidence", {}), d.get("confirmed_by_user", False))


def mirror_error(captures: DataFrame) -> DataFrame:
    """(capture_key, axis, error): rms distance of the mirror image across each axis to the nearest vertex, over the centroid size.

    A kernel on each capture; NULL for a mesh without size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for p in clouds(batch.column("points")):
                p = p - p.mean(axis=0) if len(p) else p
                size = float(np.sqrt((p * p).sum(axis=1).mean())) if len(p) else 0.0
                near = Nearest(p) if size > 0 else None
                for axis in range(3):
                    d = near(np.where(np.arange(3) == axis, -p, p))[0][:, 0] if near else None
                    errors.append(None if d is None else float(np.sqrt((d * d).mean())) / size)
            keys = batch.column("capture_key").take(pa.array(np.repeat(np.arange(len(batch)), 3)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(3, dtype=np.int32), len(batch))), pa.array(errors, pa.float64())], ["capture_key", "axis", "error"])

    kind = captures.schema["capture_key"].dataType.simpleString()
    return captures.select("capture_key", "points").mapInArrow(run, f"capture_key {kind}, axis int, error double")


def axis_skewness(captures: DataFrame) -> DataFrame:
    return vertices(captures).groupBy("capture_key").agg(*(skewness(c).alias(f"skew_{c}") for c in AXES))


def axis_taper(captures: DataFrame, superior: str = "y", lateral: str = "x") -> DataFrame:
    """Mean absolute lateral coordinate of the top quarter less that of the bottom quarter; points stay nested."""
    heights = F.array_sort(F.transform("points", lambda p: p[superior]))

    def quartile(y: Column, share: float) -> Column:
        at = (F.size(y) - 1) * share
        low, high = F.get(y, F.floor(at).cast("int")), F.get(y, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    def mean_side(inside) -> Column:
        sides = F.transform(F.filter("points", inside), lambda p: F.abs(p[lateral]))
        return F.try_divide(F.aggregate(sides, F.lit(0.0), lambda acc, x: acc + x), F.size(sides))

    rows = captures.select("capture_key", "points", heights.alias("__y"))
    rows = rows.select("capture_key", "points", quartile(F.col("__y"), 0.25).alias("q25"), quartile(F.col("__y"), 0.75).alias("q75"))
    return rows.select("capture_key", (mean_side(lambda p: p[superior] >= F.col("q75")) - mean_side(lambda p: p[superior] <= F.col("q25"))).alias("taper"))


def eye_votes(captures: DataFrame) -> DataFrame:
    """left_eye, right_eye (struct x, y, z) where a capture has both; captures without the columns have none."""
    if not {"left_eye", "right_eye"} <= set(captures.columns):
        return captures.select("capture_key", *(F.lit(None).cast("double").alias(f"{s}_{c}") for s in ("l", "r") for c in AXES)).where(F.lit(False))
    return captures.where("left_eye IS NOT NULL AND right_eye IS NOT NULL").select("capture_key", *(F.col(f"{e}.{c}").alias(f"{e[0]}_{c}") for e in ("left_eye", "right_eye") for c in AXES))


def detect_axes(captures: DataFrame) -> AxisConvention:
    """The cohort's convention: left-right by mirror symmetry, its sign by the eyes, front by skewness,
    up by the eyes or the taper; four one-row aggregates reach the driver.

    World-space captures are judged in the face's own frame, in which their eyes are given; those that can't
    be brought back have no vote, and evidence says how many.
    """
    captures = to_face_local(captures)
    left_out = captures.where("frame_error IS NOT NULL").count() if "transform" in captures.columns else 0
    captures = captures.where("frame_error IS NULL")
    errors = {r["axis"]: r["e"] for r in mirror_error(captures).groupBy("axis").agg(F.avg("error").alias("e")).collect()}
    if not errors or any(v is None for v in errors.values()):
        raise ValueError("no capture to detect the axes from")
    ranked = sorted(errors, key=lambda a: (errors[a], a))
    lr = ranked[0]
    margin = errors[ranked[1]] / errors[lr] if errors[lr] > 1e-12 else float("inf")
    evidence = {"mirror_error": [errors[a] for a in range(3)], "margin": margin if margin < 1e6 else "> 1e6"} | ({"captures_without_frame": left_out} if left_out else {})
    eyes = eye_votes(captures)
    diffs = eyes.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col(f"l_{c}") - F.col(f"r_{c}")).alias(c) for c in AXES)).first()
    lr_sign = 1
    if diffs["n"]:
        mean = diffs[AXES[lr]]
        lr_sign = 1 if mean > 0 else -1
        agree = F.avg((F.signum(F.col(f"l_{AXES[lr]}") - F.col(f"r_{AXES[lr]}")) == float(np.sign(mean))).cast("int"))
        evidence |= {"left_right_sign": "eyes", "agreement": eyes.agg(agree).first()[0]}
    else:
        evidence |= {"left_right_sign": "unresolved", "warning": "left and right can't be told apart without eye transforms"}
    skews = axis_skewness(captures).agg(*(F.avg(f"skew_{c}").alias(c) for c in AXES)).first()
    rest = [a for a in range(3) if a != lr]
    front = max(rest, key=lambda a: (abs(skews[AXES[a]]), -a))
    front_sign = 1 if skews[AXES[front]] > 0 else -1
    up = next(a for a in rest if a != front)
    if diffs["n"]:
        centre = vertices(captures).groupBy("capture_key").agg(F.avg(AXES[up]).alias("c"))
        vote = eyes.join(centre, "capture_key").agg(F.avg((F.col(f"l_{AXES[up]}") + F.col(f"r_{AXES[up]}")) / 2 - F.col("c"))).first()[0]
        evidence["superior_sign"] = "eyes"
    else:
        vote = axis_taper(captures, AXES[up], AXES[lr]).agg(F.avg("taper")).first()[0]
        evidence["superior_sign"] = "taper"
    found = AxisConvention((lr, lr_sign), (up, 1 if (vote or 0) > 0 else -1), (front, front_sign), evidence)
    if not found.right_handed():
        found.anterior = (front, -front_sign)
        found.evidence["anterior_flipped"] = True
    return found


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's argument is not inlined into its body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def to_face_local(captures: DataFrame) -> DataFrame:
    """Points of world-space captures brought back into the face's own frame by the inverse of their anchor transform.

    Adds frame_error: world-space captures without a transform, or with one that is not affine or has no
    inverse, keep their points and say so. Captures without the columns transform and coordinate_space, and
    all that are not world-space, are face-local already. Row expressions only.
    """
    if not {"transform", "coordinate_space"} <= set(captures.columns):
        return captures.withColumn("frame_error", F.lit(None).cast("string"))
    world = F.coalesce(F.col("coordinate_space") == "world", F.lit(False))

    def solved(t: Column) -> Column:
        """error, and the points moved where there is none; t: the transform, computed once."""
        m = lambda i, j: t[4 * i + j]
        minor = lambda i, j: (
            m((i + 1) % 3, (j + 1) % 3) * m((i + 2) % 3, (j + 2) % 3) - m((i + 1) % 3, (j + 2) % 3) * m((i + 2) % 3, (j + 1) % 3)
        )
        determinant = sum((m(0, j) * minor(0, j) for j in range(3)), F.lit(0.0))
        affine = (m(3, 0) == 0) & (m(3, 1) == 0) & (m(3, 2) == 0) & (m(3, 3) == 1)
        error = F.when(t.isNull(), "world-space vertices without an anchor transform")
        error = error.when(~affine, "world-space vertices with an anchor transform that is not affine")
        error = error.when((determinant == 0) | F.isnan(determinant), "world-space vertices with an anchor transform without inverse")
        inverse = F.array(*(F.try_divide(minor(j, i), determinant) for i in range(3) for j in range(3)))  # the adjugate over the determinant

        def back(inv: Column) -> Column:
            gap = lambda p: [p[a] - m(i, 3) for i, a in enumerate(AXES)]
            return F.transform("points", lambda p: F.struct(*(sum((inv[3 * i + j] * g for j, g in enumerate(gap(p))), F.lit(0.0)).alias(a) for i, a in enumerate(AXES))))

        return _let(error, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), _let(inverse, back)).otherwise(F.col("points")).alias("points")))

    here = F.struct(F.lit(None).cast("string").alias("error"), F.col("points").alias("points"))
    c = captures.withColumn("__local", F.when(world, _let(F.col("transform"), solved)).otherwise(here))
    return c.withColumns({"frame_error": F.col("__local.error"), "points": F.col("__local.points")}).drop("__local")


def normalise(captures: DataFrame, convention: AxisConvention, origin: str = "centroid", scale: str = "centroid_size") -> DataFrame:
    """Adds origin_x..z, scale_reference, side_resolved, notes and error, and puts points into the canonical frame.

    World-space captures are brought into the face's own frame first (`to_face_local`); eye transforms are
    relative to the face in any case.

    Row expressions only: the geometry of a capture is nested in its row, so nothing is shuffled.
    Captures that can't be normalised keep their row, with NULL points and the reason.
    """
    if origin not in ORIGINS or scale not in SCALES:
        raise ValueError(f"origin must be one of {ORIGINS} and scale one of {SCALES}")
    captures = to_face_local(captures)
    has_eyes = {"left_eye", "right_eye"} <= set(captures.columns)
    eye = lambda e, a: convention.columns(F.col(e))[AXES.index(a)] if has_eyes else F.lit(None).cast("double")
    total = lambda points, f: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + f(p))

    def framed(points: Column) -> Column:
        centre = F.struct(*((total(points, lambda p: p[a]) / F.size(points)).alias(a) for a in AXES))  # noqa: B023
        return _let(centre, lambda m: measured(points, m))

    def measured(points: Column, m: Column) -> Column:
        if origin == "centroid":
            at = m
        elif origin == "eye_midpoint":
            at = F.struct(*(((eye("left_eye", a) + eye("right_eye", a)) / 2).alias(a) for a in AXES))
        else:  # the most anterior point, the first on ties
            at = F.array_min(F.transform(points, lambda p, i: F.struct((-p["z"]).alias("k"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))))
        if scale == "centroid_size":
            reference = F.sqrt(total(points, lambda p: sum((F.pow(p[a] - m[a], 2) for a in AXES), F.lit(0.0))) / F.size(points))
        elif scale == "interocular":
            reference = F.sqrt(sum((F.pow(eye("left_eye", a) - eye("right_eye", a), 2) for a in AXES), F.lit(0.0)))
        else:
            reference = F.lit(1.0)
        return _let(F.struct(at.alias("o"), reference.alias("r")), lambda g: moved(points, g))

    def moved(points: Column, g: Column) -> Column:
        o, r = g["o"], g["r"]
        error = F.when(F.col("frame_error").isNotNull(), F.col("frame_error")).when(o["x"].isNull(), "no eyes for the origin").when(~(r > 0) | r.isNull(), "scale reference is not positive")
        move = lambda p: F.struct(*(((p[a] - o[a]) / r).alias(a) for a in AXES))
        out = [F.when(error.isNull(), F.transform(points, move)).alias("points"), *(o[a].alias(f"origin_{a}") for a in AXES), r.alias("scale_reference"), error.alias("error")]
        if has_eyes:
            turned = lambda e: F.struct(*convention.columns(F.col(e)))
            out += [F.when(error.isNull() & F.col(e).isNotNull(), move(turned(e))).alias(e) for e in ("left_eye", "right_eye")]
        return F.struct(*out)

    raw = F.transform("points", lambda p: F.struct(*convention.columns(p)))
    c = captures.withColumn("__n", _let(raw, framed))
    made = ["points", *(f"origin_{a}" for a in AXES), "scale_reference", "error", *(("left_eye", "right_eye") if has_eyes else ())]
    seen = F.col("left_eye").isNotNull() & F.col("right_eye").isNotNull() if has_eyes else F.lit(False)
    sided = seen | F.lit(convention.evidence.get("left_right_sign") != "unresolved")
    notes = F.array_compact(F.array(
        F.lit(None if convention.confirmed_by_user else "axis convention not confirmed by eye"), F.when(~sided, "left and right unresolved: features of one side say nothing"),
        F.lit("origin at the most anterior vertex, not at a picked landmark" if origin == "nose_tip_extremum" else None),
    ))
    kept = [x for x in captures.columns if x not in (*made, "frame_error", "side_resolved", "notes")]
    return c.select(*kept, *(F.col(f"__n.{x}").alias(x) for x in made), sided.alias("side_resolved"), notes.alias("notes"))


def in_metres(normalised: DataFrame) -> DataFrame:
    return normalised.withColumn("points", F.transform("points", lambda p: F.struct(*((p[a] * F.col("scale_reference")).alias(a) for a in AXES))))


def rotation(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The proper rotation that brings centred source points onto centred target points (Kabsch)."""
    u, _, vt = np.linalg.svd(source.T @ target)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    return u @ flip @ vt


def align(captures: DataFrame, shape: np.ndarray) -> DataFrame:
    """The captures with points centred and rotated onto a mean shape (n, 3), which every task gets; eyes turn with them.

    All other columns stay as they are. Row by row: nothing is shuffled.
    """
    target = shape - shape.mean(axis=0)
    eyes = [e for e in ("left_eye", "right_eye") if e in captures.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, turns = [], []
            for p in clouds(batch.column("points")):
                centre = p.mean(axis=0)
                turn = rotation(p - centre, target)
                points.append((p - centre) @ turn)
                turns.append((centre, turn))
            columns = {"points": nested(points, batch.column("points").type)}
            for e in eyes:
                moved = [None if q is None else (np.array([q[a] for a in AXES]) - c) @ r for q, (c, r) in zip(batch.column(e).to_pylist(), turns, strict=True)]
                columns[e] = pa.array([None if q is None else dict(zip(AXES, q.tolist(), strict=True)) for q in moved], batch.column(e).type)
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return captures.mapInArrow(run, captures.schema)


def mean_shape(captures: DataFrame) -> np.ndarray:
    """Means by vertex; as many rows as a mesh has vertices reach the driver."""
    rows = vertices(captures).groupBy("vid").agg(*(F.avg(a).alias(a) for a in AXES)).orderBy("vid").collect()
    return np.array([(r["x"], r["y"], r["z"]) for r in rows])


def generalised_procrustes(captures: DataFrame, rounds: int = 3, tolerance: float = 1e-7) -> tuple[DataFrame, np.ndarray]:
    """Rounds of aligning to the mean shape, until it moves less than the tolerance: the captures as the last round turned them, and their mean.

    All meshes must have the same vertices.
    """
    if captures.select(F.size("points").alias("n")).distinct().limit(2).count() > 1:
        raise ValueError("captures have different vertex counts")
    first = captures.orderBy("capture_key").select("points").first()
    if first is None:
        raise ValueError("no captures to align")
    mean = point_array(first["points"])
    mean = mean - mean.mean(axis=0)
    aligned = captures
    for _ in range(rounds):
        aligned = align(captures, mean)  # always from the given points: rotations to a shape don't pile up
        new = mean_shape(aligned)
        moved = float(np.linalg.norm(new - mean))
        mean = new
        if moved < tolerance:
            break
    return aligned, mean
