"""The feature table: 70 measures of each capture, wide, and long with source and reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import known, ratio
from ..functions.geometry import clouds, meshes
from . import hull, landmarks, mesh, midline, normalise, symmetry

# Feature names in their order, by source.
LANDMARK_FREE = [
    "scale_reference_m", "face_width", "face_height", "face_depth", "width_height_ratio", "depth_height_ratio", "depth_width_ratio",
    "surface_area", "convex_hull_volume", "convexity", "pca_elongation", "pca_flatness",
    *(f"width_band_{i}" for i in range(9)), *(f"depth_band_{i}" for i in range(9)),
    "width_lower_upper_ratio", "width_mid_upper_ratio", "width_profile_max", "width_profile_argmax_frac", "depth_profile_max", "depth_profile_argmax_frac",
    "symmetry_rms", "symmetry_p95", "symmetry_max", "symmetry_midplane_tilt_deg", "symmetry_discretization_floor",
]
MIDLINE = [
    "middle_third_height", "lower_third_height", "nasion_menton_height", "upper_region_height", "third_ratio_middle_lower",
    "nose_projection", "nose_height", "chin_projection", "chin_height", "nasion_depth",
]
EYES = ["interocular_distance", "interocular_face_width_ratio", "eye_height_frac", "eye_vertical_disparity"]
LANDMARKS = [*landmarks.DISTANCES, "lm_jaw_cheekbone_ratio", "lm_mouth_nose_ratio"]
FEATURES = [*LANDMARK_FREE, *MIDLINE, *EYES, *LANDMARKS]
IDS = ["participant_id", "capture_id"]


def source_of(name: str) -> str:
    if name in landmarks.DISTANCES:
        return "landmark:" + "+".join(landmarks.DISTANCES[name])
    return "landmark_free" if name in LANDMARK_FREE else "derived_midline" if name in MIDLINE else "eye_transform" if name in EYES else "landmark"


#: What the kernel gives of each capture, in order.
MEASURED = [f for f in FEATURES if f in LANDMARK_FREE or f in MIDLINE]
_OUTSIDE = ("scale_reference_m", "surface_area", "convexity")
KERNEL = [f for f in MEASURED if f not in _OUTSIDE]


def _quotient(a: float, b: float) -> float:
    return a / b if b else np.nan


def _profile(p: np.ndarray) -> dict[str, float]:
    """Bands as `mesh.bands` and `mesh.profile_summary` have them."""
    y, n = p[:, 1], mesh.BANDS
    lo, hi = y.min(), y.max()
    band = sum((y >= lo + i * (hi - lo) / n).astype(int) for i in range(1, n))
    width, depth = np.full(n, np.nan), np.full(n, np.nan)
    for i in np.unique(band):
        here = p[band == i]
        width[i], depth[i] = np.ptp(here[:, 0]), here[:, 2].max()
    out = {f"{c}_band_{i}": v[i] for c, v in (("width", width), ("depth", depth)) for i in range(n)}
    out |= {"width_lower_upper_ratio": _quotient(width[1], width[6]), "width_mid_upper_ratio": _quotient(width[4], width[6])}
    for c, v in (("width", width), ("depth", depth)):
        at = int(np.nanargmax(v))  # the first on ties
        out |= {f"{c}_profile_max": v[at], f"{c}_profile_argmax_frac": at / (n - 1)}
    return out


def _midline(p: np.ndarray) -> dict[str, float]:
    """Midline landmarks and measures as `midline.midline_features` has them."""
    x, w = np.abs(p[:, 0]), np.ptp(p[:, 0])
    half = midline.BAND * w if (x <= midline.BAND * w).sum() >= midline.BINS // 2 else 3 * midline.BAND * w
    strip = p[x <= half]
    if not len(strip) or not (step := (strip[:, 1].max() - strip[:, 1].min()) / midline.BINS) > 0:
        return {}
    y, lo = strip[:, 1], strip[:, 1].min()
    edges = lo + np.arange(midline.BINS + 1) * step
    place = np.clip(np.searchsorted(edges, y, side="right") - 1, 0, midline.BINS)
    below = (place < midline.BINS) & (y < y.max())
    z = np.full(midline.BINS, -np.inf)
    np.maximum.at(z, place[below], strip[below, 2])
    at = np.flatnonzero(z > -np.inf)
    n, z, y = len(at), z[at], 0.5 * (edges[at] + edges[at + 1])
    if n < midline.FEWEST:
        return {}
    total = z.copy()
    for k in range(1, midline.WINDOW // 2 + 1):
        total = total + np.r_[np.full(k, z[0]), z[:-k]] + np.r_[z[k:], np.full(k, z[-1])]
    s = total / midline.WINDOW
    inner = np.arange(max(midline.MARGIN, 1), n - max(midline.MARGIN, 1))
    low = inner[(s[inner] < s[inner - 1]) & (s[inner] < s[inner + 1])]
    high = inner[(s[inner] > s[inner - 1]) & (s[inner] > s[inner + 1])]
    tip, men = int(np.argmax(s)), 0
    nas, sub = min(low[low > tip], default=None), max(low[low < tip], default=None)
    pog = None if sub is None else max(high[high < sub], default=None)
    gap = lambda a, b: np.nan if a is None or b is None else abs(y[a] - y[b])
    reach = lambda a, b: np.nan if a is None or b is None else s[a] - s[b]
    return {
        "middle_third_height": gap(nas, sub), "lower_third_height": gap(sub, men), "nasion_menton_height": gap(nas, men), "upper_region_height": np.nan if nas is None else p[:, 1].max() - y[nas],
        "third_ratio_middle_lower": _quotient(gap(nas, sub), gap(sub, men)), "nose_projection": reach(tip, sub), "nose_height": gap(tip, sub),
        "chin_projection": reach(pog, sub), "chin_height": np.nan if sub is None else gap(pog, men), "nasion_depth": reach(tip, nas),
    }


def measure(p: np.ndarray, triangles: np.ndarray, surface: bool, fit_plane: bool, plane: tuple[np.ndarray, bool] | None = None) -> dict[str, float | None]:
    """KERNEL of one capture, with hull_area; NaN where there is no value."""
    if not len(p) or not np.isfinite(p).all():
        return {}
    w, h, d = np.ptp(p, axis=0)
    out = {"face_width": w, "face_height": h, "face_depth": d, "width_height_ratio": _quotient(w, h), "depth_height_ratio": _quotient(d, h), "depth_width_ratio": _quotient(d, w)}
    if len(p) > 1:
        l3, l2, l1 = np.linalg.eigvalsh(np.cov(p.T))
        out |= {"pca_elongation": _quotient(l2, l1), "pca_flatness": _quotient(l3, l1)}
    if found := hull.convex_hull(p):
        out |= {"convex_hull_volume": found[0], "hull_area": found[1]}
    sym = symmetry.measure(p, triangles, surface=surface, fit=fit_plane, plane=plane)
    if sym["error"] is None:
        out |= {f"symmetry_{k}": sym[f"symmetry_{k}"] for k in ("rms", "p95", "max")} | {"symmetry_midplane_tilt_deg": sym["tilt_deg"], "symmetry_discretization_floor": sym["effective_floor"]}
    return out | _profile(p) | _midline(p)


def extract(normalised: DataFrame, marks: landmarks.LandmarkSet | None = None, method: str = "point_to_surface", fit_plane: bool = True) -> DataFrame:
    """capture_key, ids and the 70 features of normalised captures; unavailable values are NULL.

    One pass over the captures: row expressions for what points, eyes and landmarks give by themselves, one
    kernel for hulls, symmetry, profiles and midlines. Nothing is joined or shuffled.
    """
    marks = marks or landmarks.LandmarkSet()
    n = normalised.where("error IS NULL") if "error" in normalised.columns else normalised
    for c, e in (("capture_id", F.col("capture_key").cast("string")), ("scale_reference", F.lit(1.0))):
        if c not in n.columns:
            n = n.withColumn(c, e)
    eyes = {"left_eye", "right_eye"} <= set(n.columns)
    eye = lambda e, a: F.col(e)[a] if eyes else F.lit(None).cast("double")
    lo = F.array_min(F.transform("points", lambda p: p["y"]))
    apart = F.sqrt(sum((F.pow(eye("left_eye", a) - eye("right_eye", a), 2) for a in "xyz"), F.lit(0.0)))
    given = {
        "scale_reference_m": F.col("scale_reference").cast("double"), "surface_area": mesh.area(), "interocular_distance": apart,
        "__eye_height": (eye("left_eye", "y") + eye("right_eye", "y")) / 2 - lo, "eye_vertical_disparity": F.abs(eye("left_eye", "y") - eye("right_eye", "y")),
        **{name: marks.distance(a, b) for name, (a, b) in landmarks.DISTANCES.items()},
    }
    rows = n.select("capture_key", *IDS, "points", "triangles", *(v.alias(k) for k, v in given.items()))
    keep = ["capture_key", *IDS, *given]
    made = [*KERNEL, "hull_area"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, symmetry.FITTED) for whole in batches for at in range(0, len(whole), symmetry.FITTED)):
            points = clouds(batch.column("points"))
            planes = symmetry.fit_planes(points) if fit_plane else [None] * len(points)
            found = [measure(p, t, method == "point_to_surface", fit_plane, plane) for p, t, plane in zip(points, meshes(batch.column("triangles")), planes, strict=True)]
            values = np.array([[f.get(c, np.nan) for c in made] for f in found], float).reshape(len(found), len(made))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(values[:, i]) for i in range(len(made)))], [*keep, *made])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` double" for c in made)])
    out = rows.mapInArrow(run, schema).withColumns({c: known(c) for c in [*given, *made]})
    out = out.withColumns({
        "convexity": ratio("hull_area", "surface_area"), "interocular_face_width_ratio": ratio("interocular_distance", "face_width"), "eye_height_frac": ratio("__eye_height", "face_height"),
        "lm_jaw_cheekbone_ratio": ratio("lm_jaw_width", "lm_cheekbone_width"), "lm_mouth_nose_ratio": ratio("lm_mouth_width", "lm_nose_width"),
    })
    return out.select("capture_key", *IDS, *(known(F.col(f).cast("double")).alias(f) for f in FEATURES))


def long_form(wide: DataFrame, marks: landmarks.LandmarkSet | None = None) -> DataFrame:
    """(ids, name, value, source, reason): a value, or the reason why there is none."""
    marks = marks or landmarks.LandmarkSet()
    reasons = {
        **dict.fromkeys(LANDMARK_FREE, "not measurable on this mesh"), **dict.fromkeys(MIDLINE, "midline extremum not present in the curve"), **dict.fromkeys(EYES, "no eye transforms in the capture"),
        **{f: landmarks.missing(marks, f) for f in LANDMARKS},
    }
    rows = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("value"), F.lit(source_of(f)).alias("source"), F.when(F.col(f).isNull(), reasons[f]).alias("reason")) for f in FEATURES])
    wide = wide.select("capture_key", *IDS, *FEATURES)
    return wide.select("capture_key", *IDS, F.explode(rows).alias("f")).select("capture_key", *IDS, "f.*")


def build_feature_table(captures: DataFrame, convention: normalise.AxisConvention, origin: str = "centroid", scale: str = "centroid_size", procrustes: bool = False, marks: landmarks.LandmarkSet | None = None, method: str = "point_to_surface", fit_plane: bool = True) -> tuple[DataFrame, DataFrame]:
    """(features, problems): a capture that can't be normalised is a problem row and stops nothing.

    A cohort that can't be aligned (meshes of several sizes) is measured as it is, and a problem row without a key says so.
    """
    n = normalise.normalise(captures, convention, origin, scale)
    problems = n.where("error IS NOT NULL").select("capture_key", "error")
    good = n.where("error IS NULL")
    if procrustes:
        try:
            good, _ = normalise.generalised_procrustes(good)
        except ValueError as e:
            none = F.lit(None).cast(problems.schema["capture_key"].dataType).alias("capture_key")
            problems = problems.unionByName(captures.sparkSession.range(1).select(none, F.lit(f"not aligned: {e}").alias("error")))
    return extract(good, marks, method, fit_plane), problems


def coverage(table: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n_rows, n_present, n_distinct, coverage, kind) of each column.

    Values are stacked as (column, value) and counted twice: by column and value, then by column. A row
    becomes one narrow row for each value it has, folded map-side, and not a wide one for each column.
    """
    numeric = {"tinyint", "smallint", "int", "float", "double", "boolean"}
    kind = "double" if {k for c, k in table.dtypes if c in columns} <= numeric else "string"
    values = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast(kind).alias("v")) for i, c in enumerate(columns)))
    counted = table.select(F.explode(values).alias("e")).select("e.c", "e.v").where("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    stats = counted.groupBy("c").agg(F.sum("n").alias("n_present"), F.count(F.lit(1)).alias("n_distinct"))
    names = F.array(*(F.struct(F.lit(i).alias("__c"), F.lit(c).alias("name")) for i, c in enumerate(columns)))
    every = table.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.inline(names))  # one row for each column
    rows = every.join(stats, F.col("__c") == F.col("c"), "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_present", "n_distinct")})
    label = F.when(F.col("n_present") == 0, "dead").when(F.col("n_distinct") == 1, "constant").when(F.col("n_present") < F.col("n_rows"), "partial").otherwise("full")
    return rows.select("name", "n_rows", "n_present", "n_distinct", F.try_divide("n_present", "n_rows").alias("coverage"), label.alias("kind"))


def feature_columns(table: DataFrame) -> list[str]:
    """The model's inputs: all numeric columns of a table that are no ids."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, kind in table.dtypes if c not in (*IDS, "capture_key") and (kind in numeric or kind.startswith("decimal"))]


def usable_columns(table: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least two different values."""
    row = table.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns)).first()
    return [c for c in columns if row[f"lo_{c}"] is not None and row[f"lo_{c}"] != row[f"hi_{c}"]]
