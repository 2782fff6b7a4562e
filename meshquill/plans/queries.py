"""Registered queries over the test tables, and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import t_quantile
from ..operators import features, hull, landmarks, mesh, metrics, midline, models, normalise, ratings, splits, symmetry, validation
from ..sources import captures as json_captures
from ..sources import tables

CONVENTION = normalise.AxisConvention((0, 1), (1, 1), (2, 1))
TURNED = normalise.AxisConvention((1, -1), (2, 1), (0, -1))
MARKS = landmarks.LandmarkSet({"nasion": 3, "subnasale": 7, "menton": 20, "left_gonion": 1, "right_gonion": 12, "left_zygion": 5, "right_zygion": 16}, tables.N_POINTS)
SCALE = ratings.RatingScale(1.0, 45.0)
#: Captures in a cloud of `_dense`.
CLOUD = 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, and never a negative zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


# --- common table expressions of the SQL side --------------------------------------------------
_N = tables.N_POINTS
PTS = f"""pts AS (
  SELECT e.vec_id AS capture_key, e.label AS participant_id, CAST(r.i AS INTEGER) AS vid,
         CAST(e.embedding[3 * r.i + 1] AS DOUBLE) AS x, CAST(e.embedding[3 * r.i + 2] AS DOUBLE) AS y, CAST(e.embedding[3 * r.i + 3] AS DOUBLE) AS z
  FROM embeddings e, (SELECT unnest(range({_N})) AS i) r)"""
TRI = f"tri AS (SELECT unnest(range({_N - 2})) AS i)"
SIZE = "size AS (SELECT capture_key, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS size FROM pts GROUP BY capture_key)"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


# --- mesh measures ------------------------------------------------------------------------------
@query(f"""WITH {PTS}, a AS (SELECT capture_key, count(*) AS n, max(x) - min(x) AS w, max(y) - min(y) AS h, max(z) - min(z) AS d,
  avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS s FROM pts GROUP BY capture_key)
SELECT capture_key, n AS n_vertices, {r6('w', 'width')}, {r6('h', 'height')}, {r6('d', 'depth')}, {r6('sqrt(w * w + h * h + d * d)', 'bbox_diagonal')},
  {r6('cx', 'centroid_x')}, {r6('cy', 'centroid_y')}, {r6('cz', 'centroid_z')}, {r6('s', 'centroid_size')},
  {r6('w / nullif(h, 0)', 'width_height_ratio')}, {r6('d / nullif(h, 0)', 'depth_height_ratio')}, {r6('d / nullif(w, 0)', 'depth_width_ratio')} FROM a""")
def mesh_extents(spark, sf):
    return rounded(mesh.extents(tables.captures(spark, sf)))


_CROSS = """0.5 * sqrt(pow((q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y), 2) + pow((q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z), 2)
  + pow((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x), 2))"""


@query(f"""WITH {PTS}, {TRI} SELECT p.capture_key, count(*) AS n_triangles, {r6(f'sum({_CROSS})', 'surface_area')}
FROM pts p JOIN tri t ON p.vid = t.i JOIN pts q ON q.capture_key = p.capture_key AND q.vid = t.i + 1 JOIN pts r ON r.capture_key = p.capture_key AND r.vid = t.i + 2 GROUP BY p.capture_key""")
def mesh_surface_area(spark, sf):
    return rounded(mesh.surface_area(tables.captures(spark, sf)))


@query(f"""WITH {PTS}, c AS (SELECT capture_key, var_samp(x) AS xx, var_samp(y) AS yy, var_samp(z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz FROM pts GROUP BY capture_key),
 q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), p AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
 f AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE acos(greatest(-1.0, least(1.0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * pow(p, 3))))) / 3 END AS phi FROM p),
 l AS (SELECT capture_key, q, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM f)
SELECT capture_key, {r6('l1', 'l1')}, {r6('3 * q - l1 - l3', 'l2')}, {r6('l3', 'l3')}, {r6('(3 * q - l1 - l3) / nullif(l1, 0)', 'elongation')}, {r6('l3 / nullif(l1, 0)', 'flatness')} FROM l""")
def mesh_pca(spark, sf):
    return rounded(mesh.shape_pca(tables.captures(spark, sf)))


_BANDS = f"""{PTS}, lim AS (SELECT capture_key, min(y) AS lo, max(y) AS hi FROM pts GROUP BY capture_key),
 edges AS (SELECT capture_key, unnest(range({mesh.BANDS})) AS b, lo, hi FROM lim),
 bands AS (SELECT e.capture_key, CAST(e.b AS INTEGER) AS band, max(p.x) - min(p.x) AS width, max(p.z) AS depth FROM edges e LEFT JOIN pts p ON p.capture_key = e.capture_key
   AND (e.b = 0 OR p.y >= e.lo + e.b * (e.hi - e.lo) / {mesh.BANDS}) AND (e.b = {mesh.BANDS - 1} OR p.y < e.lo + (e.b + 1) * (e.hi - e.lo) / {mesh.BANDS}) GROUP BY e.capture_key, e.b)"""


@query(f"WITH {_BANDS} SELECT capture_key, band, {r6('width', 'width')}, {r6('depth', 'depth')} FROM bands")
def mesh_bands(spark, sf):
    return rounded(mesh.bands(tables.captures(spark, sf)))


@query(f"""WITH {_BANDS}, m AS (SELECT capture_key, max(CASE WHEN band = 1 THEN width END) AS w1, max(CASE WHEN band = 4 THEN width END) AS w4, max(CASE WHEN band = 6 THEN width END) AS w6, max(width) AS wm, max(depth) AS dm FROM bands GROUP BY capture_key),
 wa AS (SELECT b.capture_key, min(b.band) AS band FROM bands b JOIN m ON m.capture_key = b.capture_key AND b.width = m.wm GROUP BY b.capture_key),
 da AS (SELECT b.capture_key, min(b.band) AS band FROM bands b JOIN m ON m.capture_key = b.capture_key AND b.depth = m.dm GROUP BY b.capture_key)
SELECT m.capture_key, {r6('w1 / nullif(w6, 0)', 'lower_upper')}, {r6('w4 / nullif(w6, 0)', 'mid_upper')}, {r6('wm', 'width_max')}, {r6('wa.band / 8.0', 'width_at')}, {r6('dm', 'depth_max')}, {r6('da.band / 8.0', 'depth_at')}
FROM m JOIN wa ON wa.capture_key = m.capture_key JOIN da ON da.capture_key = m.capture_key""")
def profile_summary(spark, sf):
    return rounded(mesh.profile_summary(tables.captures(spark, sf)))


_CURVE = f"""{PTS}, wid AS (SELECT capture_key, max(x) - min(x) AS w FROM pts GROUP BY capture_key),
 thin AS (SELECT p.capture_key, w.w, sum(CASE WHEN abs(p.x) <= {midline.BAND} * w.w THEN 1 ELSE 0 END) AS n FROM pts p JOIN wid w ON w.capture_key = p.capture_key GROUP BY p.capture_key, w.w),
 strip AS (SELECT p.* FROM pts p JOIN thin t ON t.capture_key = p.capture_key WHERE abs(p.x) <= CASE WHEN t.n < {midline.BINS // 2} THEN {3 * midline.BAND} ELSE {midline.BAND} END * t.w),
 lim AS (SELECT capture_key, min(y) AS lo, max(y) AS hi FROM strip GROUP BY capture_key),
 edges AS (SELECT capture_key, unnest(range({midline.BINS})) AS b, lo, hi, (hi - lo) / {midline.BINS} AS h FROM lim),
 curve AS (SELECT e.capture_key, CAST(e.b AS INTEGER) AS bin, 0.5 * (e.lo + e.b * e.h + e.lo + (e.b + 1) * e.h) AS y, max(s.z) AS z FROM edges e JOIN strip s ON s.capture_key = e.capture_key
   AND s.y >= e.lo + e.b * e.h AND s.y < e.lo + (e.b + 1) * e.h AND s.y < e.hi GROUP BY e.capture_key, e.b, e.lo, e.h)"""


@query(f"WITH {_CURVE} SELECT capture_key, bin, {r6('y', 'y')}, {r6('z', 'z')} FROM curve")
def midline_curve(spark, sf):
    return rounded(midline.curve(tables.captures(spark, sf)))


@query()
def midline_landmarks(spark, sf):
    return rounded(midline.midline_features(_dense(spark, sf)))


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    """Larger meshes: each CLOUD captures with keys in a row as one cloud of points, so that midline curves are filled.

    Clouds keep their size and grow in number with the input.
    """
    v = tables.vertices(tables.captures(spark, sf), "participant_id")
    point = F.struct("x", "y", "z")
    return v.groupBy(F.floor(F.col("capture_key") / CLOUD).alias("capture_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("participant_id").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"), "vid", point.alias("p")))), lambda s: s["p"]).alias("points"))


# --- normalisation -------------------------------------------------------------------------------
_TURN = {"x": "-1.0 * y", "y": "1.0 * z", "z": "-1.0 * x"}


@query(f"WITH {PTS} SELECT capture_key, vid, {r6(_TURN['x'], 'x')}, {r6(_TURN['y'], 'y')}, {r6(_TURN['z'], 'z')} FROM pts")
def canonical_axes(spark, sf):
    return rounded(tables.vertices(normalise.normalise(tables.captures(spark, sf), TURNED, "nose_tip_extremum", "none").withColumn("points", F.transform("points", lambda p: F.struct(*((p[a] + F.col(f"origin_{a}")).alias(a) for a in "xyz"))))))


@query(f"""WITH {PTS}, {SIZE} SELECT p.capture_key, p.vid, {r6('(p.x - cx) / size', 'x')}, {r6('(p.y - cy) / size', 'y')}, {r6('(p.z - cz) / size', 'z')} FROM pts p JOIN size s ON s.capture_key = p.capture_key""")
def normalize_centroid(spark, sf):
    return rounded(tables.vertices(normalise.normalise(tables.captures(spark, sf), CONVENTION)))


@query(f"""WITH {PTS}, {SIZE}, top AS (SELECT capture_key, max(z) AS mz FROM pts GROUP BY capture_key), tip AS (SELECT p.capture_key, min(p.vid) AS vid FROM pts p JOIN top t ON t.capture_key = p.capture_key AND p.z = t.mz GROUP BY p.capture_key),
 o AS (SELECT p.capture_key, p.x AS ox, p.y AS oy, p.z AS oz FROM pts p JOIN tip t ON t.capture_key = p.capture_key AND t.vid = p.vid)
SELECT p.capture_key, p.vid, {r6('(p.x - ox) / size', 'x')}, {r6('(p.y - oy) / size', 'y')}, {r6('(p.z - oz) / size', 'z')} FROM pts p JOIN size s ON s.capture_key = p.capture_key JOIN o ON o.capture_key = p.capture_key""")
def normalize_extremum(spark, sf):
    return rounded(tables.vertices(normalise.normalise(tables.captures(spark, sf), CONVENTION, "nose_tip_extremum")))


@query(f"""WITH {PTS}, {SIZE} SELECT p.capture_key, p.vid, {r6('p.x - cx', 'x')}, {r6('p.y - cy', 'y')}, {r6('p.z - cz', 'z')} FROM pts p JOIN size s ON s.capture_key = p.capture_key""")
def to_metres(spark, sf):
    return rounded(tables.vertices(normalise.in_metres(normalise.normalise(tables.captures(spark, sf), CONVENTION))))


def _mirror_sql(axis: int, c: str) -> str:
    gap = " + ".join(f"pow(a.{x} - b.{x}, 2)" if x != c else f"pow(2 * s.c{x} - a.{x} - b.{x}, 2)" for x in "xyz")
    return f"SELECT m.capture_key, {axis} AS axis, {r6('sqrt(avg(m.d)) / max(m.size)', 'error')} FROM (SELECT a.capture_key, a.vid, s.size, min({gap}) AS d FROM pts a JOIN pts b ON b.capture_key = a.capture_key JOIN size s ON s.capture_key = a.capture_key GROUP BY a.capture_key, a.vid, s.size) m GROUP BY m.capture_key"


@query(f"WITH {PTS}, {SIZE} " + " UNION ALL ".join(_mirror_sql(i, c) for i, c in enumerate("xyz")))
def axis_mirror_error(spark, sf):
    return rounded(normalise.mirror_error(tables.captures(spark, sf)))


def _skew(c: str) -> str:
    return f"coalesce((avg(pow({c}, 3)) - 3 * avg({c}) * avg(pow({c}, 2)) + 2 * pow(avg({c}), 3)) / nullif(pow(stddev_pop({c}), 3), 0), 0)"


@query(f"WITH {PTS} SELECT capture_key, {', '.join(r6(_skew(c), f'skew_{c}') for c in 'xyz')} FROM pts GROUP BY capture_key")
def axis_skewness(spark, sf):
    return rounded(normalise.axis_skewness(tables.captures(spark, sf)))


@query(f"""WITH {PTS}, q AS (SELECT capture_key, quantile_cont(y, 0.25) AS q25, quantile_cont(y, 0.75) AS q75 FROM pts GROUP BY capture_key)
SELECT p.capture_key, {r6('avg(CASE WHEN p.y >= q75 THEN abs(p.x) END) - avg(CASE WHEN p.y <= q25 THEN abs(p.x) END)', 'taper')} FROM pts p JOIN q ON q.capture_key = p.capture_key GROUP BY p.capture_key""")
def axis_taper(spark, sf):
    return rounded(normalise.axis_taper(tables.captures(spark, sf)))


@query()
def axis_detection(spark, sf):
    c = normalise.detect_axes(tables.captures(spark, sf))
    return spark.createDataFrame([(*c.left, *c.superior, *c.anterior, c.right_handed())], "left_axis int, left_sign int, superior_axis int, superior_sign int, anterior_axis int, anterior_sign int, right_handed boolean")


@query()
def gpa_mean_shape(spark, sf):
    _, mean = normalise.generalised_procrustes(normalise.normalise(tables.captures(spark, sf), CONVENTION).select("capture_key", "points"))
    return rounded(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(mean)], "vid int, x double, y double, z double"))


@query()
def procrustes(spark, sf):
    c = normalise.normalise(tables.captures(spark, sf), CONVENTION).select("capture_key", "points")
    return rounded(tables.vertices(normalise.align(c, normalise.mean_shape(c))))


# --- symmetry ------------------------------------------------------------------------------------
@query(f"WITH {PTS} SELECT capture_key, vid, {r6('x - 2 * (0.6 * x + 0.8 * y - 0.1) * 0.6', 'x')}, {r6('y - 2 * (0.6 * x + 0.8 * y - 0.1) * 0.8', 'y')}, {r6('z', 'z')} FROM pts")
def reflect_fixed_plane(spark, sf):
    return rounded(symmetry.reflect(tables.vertices(tables.captures(spark, sf)), (0.6, 0.8, 0.0), "0.1D").select("capture_key", "vid", "x", "y", "z"))


_NN = f"""{PTS}, {SIZE}, nn AS (SELECT a.capture_key, a.vid, s.size, sqrt(min(CASE WHEN a.vid <> b.vid THEN pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) END)) AS spacing,
  sqrt(min(pow(2 * s.cx - a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS mirror FROM pts a JOIN pts b ON b.capture_key = a.capture_key JOIN size s ON s.capture_key = a.capture_key GROUP BY a.capture_key, a.vid, s.size)"""


@query(f"WITH {_NN} SELECT capture_key, vid, {r6('spacing', 'spacing')}, {r6('mirror', 'mirror')} FROM nn")
def nearest_neighbours(spark, sf):
    return rounded(symmetry.nearest_vertices(tables.captures(spark, sf)))


@query(f"""WITH {_NN}, md AS (SELECT capture_key, median(spacing) AS m FROM nn GROUP BY capture_key)
SELECT n.capture_key, {r6('sqrt(avg(pow(mirror / size, 2)))', 'rms')}, {r6('avg(mirror / size)', 'mean')}, {r6('max(mirror / size)', 'max')}, {r6('quantile_cont(mirror / size, 0.95)', 'p95')},
 {r6('max(m) / max(size)', 'discretization_floor')}, {r6('avg(CASE WHEN mirror < 0.1 * m THEN 1.0 ELSE 0.0 END)', 'pairing')} FROM nn n JOIN md ON md.capture_key = n.capture_key GROUP BY n.capture_key""")
def symmetry_nearest_vertex_nofit(spark, sf):
    return rounded(symmetry.symmetry_fixed(tables.captures(spark, sf)))


@query()
def symmetry_surface_nofit(spark, sf):
    return rounded(symmetry.measure_symmetry(tables.captures(spark, sf), fit_plane=False).drop("normal", "notes", "per_vertex"))


def _spread(captures: DataFrame) -> DataFrame:
    """Dealt to a given number of tasks: captures are few bytes and much work, and adaptive execution would join them to one task."""
    return captures.repartition(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), "capture_key")


@query()
def symmetry_fitted(spark, sf):
    c = tables.captures(spark, sf)
    return rounded(symmetry.verdict(symmetry.measure_symmetry(_spread(c))).drop("normal", "notes", "per_vertex"), 4)


@query()
def convex_hull(spark, sf):
    return rounded(hull.convex_hulls(tables.captures(spark, sf)))


# --- landmarks -----------------------------------------------------------------------------------
def _gap(a: str, b: str, name: str) -> str:
    i, j = MARKS.indices[a], MARKS.indices[b]
    at = lambda v, c: f"max(CASE WHEN vid = {v} THEN {c} END)"
    return r6("sqrt(" + " + ".join(f"pow({at(i, c)} - {at(j, c)}, 2)" for c in "xyz") + ")", name)


@query(f"WITH {PTS} SELECT capture_key, {_gap('nasion', 'subnasale', 'lm_nose_height')}, {_gap('left_gonion', 'right_gonion', 'lm_jaw_width')}, {_gap('left_zygion', 'right_zygion', 'lm_cheekbone_width')}, {_gap('subnasale', 'menton', 'lm_chin_height')}, CAST(NULL AS DOUBLE) AS lm_mouth_width FROM pts GROUP BY capture_key")
def landmark_distance(spark, sf):
    return rounded(landmarks.landmark_features(tables.captures(spark, sf), MARKS).select("capture_key", "lm_nose_height", "lm_jaw_width", "lm_cheekbone_width", "lm_chin_height", "lm_mouth_width"))


@query(f"WITH {PTS}, n AS (SELECT capture_key, CASE WHEN capture_key % 7 = 0 THEN 20 ELSE 21 END AS n_vertices FROM pts GROUP BY capture_key) SELECT CAST(n_vertices AS INTEGER) AS n_vertices, n_vertices = 21 AS applies, count(*) AS n_captures FROM n GROUP BY n_vertices")
def landmark_topology_guard(spark, sf):
    return landmarks.check(_uneven(spark, sf), MARKS)


def _uneven(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh capture lacks its last point and triangle; every eleventh repeats a vertex in a triangle."""
    c = tables.captures(spark, sf)
    short = F.col("capture_key") % 7 == 0
    broken = F.transform("triangles", lambda t: F.struct(t["i"].alias("i"), F.when(F.col("capture_key") % 11 == 0, t["i"]).otherwise(t["j"]).alias("j"), t["k"].alias("k")))
    c = c.withColumn("triangles", broken)
    return c.withColumns({"points": F.when(short, F.slice("points", 1, _N - 1)).otherwise(F.col("points")), "triangles": F.when(short, F.slice("triangles", 1, _N - 4)).otherwise(F.col("triangles"))})


# --- validation ----------------------------------------------------------------------------------
_UNEVEN = f"""{PTS}, c AS (SELECT capture_key, any_value(participant_id) AS participant_id, CASE WHEN capture_key % 7 = 0 THEN {_N - 1} ELSE {_N} END AS nv, CASE WHEN capture_key % 7 = 0 THEN {_N - 4} ELSE {_N - 2} END AS nt FROM pts GROUP BY capture_key),
 ext AS (SELECT c.capture_key, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS diagonal FROM pts p JOIN c ON c.capture_key = p.capture_key AND p.vid < c.nv GROUP BY c.capture_key)"""
_ISSUES = f"""{_UNEVEN}, iss AS (
  SELECT capture_key, 'WARNING' AS severity, 'missing_capture_id' AS code FROM c
  UNION ALL SELECT capture_key, 'WARNING', 'degenerate_triangles' FROM c WHERE capture_key % 11 = 0
  UNION ALL SELECT capture_key, 'WARNING', 'unreferenced_vertices' FROM c WHERE capture_key % 7 = 0 OR capture_key % 11 = 0
  UNION ALL SELECT capture_key, 'WARNING', 'implausible_scale' FROM ext WHERE diagonal NOT BETWEEN 0.05 AND 0.40
  UNION ALL SELECT capture_key, 'WARNING', 'no_eye_transforms' FROM c
  UNION ALL SELECT capture_key, 'INFO', 'no_blend_shapes' FROM c
  UNION ALL SELECT capture_key, 'INFO', 'no_transform' FROM c)"""


@query(f"WITH {_ISSUES} SELECT capture_key, severity, code FROM iss WHERE code <> 'unreferenced_vertices'")
def capture_issues(spark, sf):
    return validation.capture_issues(_uneven(spark, sf)).where("code <> 'unreferenced_vertices'").select("capture_key", "severity", "code")


@query(f"WITH {PTS}, t AS (SELECT unnest(range({_N - 2})) AS i), used AS (SELECT i AS vid FROM t WHERE i % 2 = 0) SELECT p.capture_key, p.vid FROM pts p LEFT JOIN (SELECT vid FROM used UNION SELECT vid + 1 FROM used) u ON u.vid = p.vid WHERE u.vid IS NULL")
def orphan_vertices(spark, sf):
    every_other = F.transform(F.filter("triangles", lambda t: t["i"] % 2 == 0), lambda t: F.struct(t["i"].alias("i"), t["j"].alias("j"), t["j"].alias("k")))
    return validation.orphan_vertices(tables.captures(spark, sf).withColumn("triangles", every_other))


@query(f"WITH {_UNEVEN} SELECT (SELECT CAST(nv AS INTEGER) FROM c GROUP BY nv ORDER BY count(*) DESC LIMIT 1) AS mode_nv, (SELECT count(DISTINCT nv) FROM c) AS distinct_nv, (SELECT CAST(nt AS INTEGER) FROM c GROUP BY nt ORDER BY count(*) DESC LIMIT 1) AS mode_nt, (SELECT count(DISTINCT nt) FROM c) AS distinct_nt")
def cohort_topology_mode(spark, sf):
    return validation.topology_mode(_uneven(spark, sf))


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS duplicated FROM documents")
def duplicate_payload(spark, sf):
    return validation.duplicate_flags(tables.table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "duplicated")


@query(f"""WITH {PTS}, g AS (SELECT capture_key, string_agg(CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ',' || CAST(z AS VARCHAR), ';' ORDER BY vid) AS h FROM pts GROUP BY capture_key)
SELECT capture_key, 'duplicate_geometry' AS code FROM (SELECT capture_key, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1""")
def duplicate_geometry(spark, sf):
    return validation.cohort_issues(tables.captures(spark, sf)).where("code = 'duplicate_geometry'").select("capture_key", "code")


@query(f"""WITH {_UNEVEN} SELECT capture_key, participant_id, CASE WHEN capture_key % 7 = 0 THEN 'FAIL' ELSE 'WARN' END AS status FROM c""")
def cohort_status(spark, sf):
    c = _uneven(spark, sf)
    return validation.status(c, validation.issues(c).where("code <> 'duplicate_geometry'")).select("capture_key", "participant_id", "status")


@query(f"""WITH {_UNEVEN} SELECT participant_id, count(*) AS n_captures, sum(CASE WHEN capture_key % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_fail, bool_and(capture_key % 7 = 0) AS dead FROM c GROUP BY participant_id""")
def dead_groups(spark, sf):
    c = _uneven(spark, sf)
    return validation.participants(validation.status(c, validation.issues(c).where("code <> 'duplicate_geometry'"))).select("participant_id", "n_captures", "n_fail", "dead")


# --- JSON ----------------------------------------------------------------------------------------
@query("SELECT event_id AS path, 'k' AS key_path, 0 AS depth, 'number' AS kind FROM events")
def json_key_tree(spark, sf):
    return json_captures.key_tree(tables.table(spark, sf, "events").select(F.col("event_id").alias("path"), F.col("props").alias("content"))).drop("preview")


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Captures as JSON documents in five shapes, by capture_key modulo 5; the last has one number too many."""
    c = tables.captures(spark, sf)
    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"], p["z"])))
    part = lambda a: F.transform("points", lambda p: p[a])
    tri = F.flatten(F.transform("triangles", lambda t: F.array(t["i"], t["j"], t["k"])))
    shapes = [
        F.to_json(F.transform("points", lambda p: F.array(p["x"], p["y"], p["z"]))), F.to_json(flat), F.to_json("points"),
        F.to_json(F.struct(*(part(a).alias(a) for a in "xyz"))), F.to_json(F.concat(flat, F.array(F.lit(0.5)))),
    ]
    raw = F.coalesce(*[F.when(F.col("capture_key") % 5 == i, s) for i, s in enumerate(shapes)])
    text = F.concat(F.lit('{"Participant-ID": "P'), F.col("participant_id"), F.lit('", "faceGeometry": {"vertices": '), raw, F.lit(', "triangle_indices": '), F.to_json(tri), F.lit("}}"))
    return c.select(F.format_string("raw/P%d/%d.json", "participant_id", "capture_key").alias("path"), F.encode(text, "UTF-8").alias("content"))


@query(f"""SELECT 'raw/P' || CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.json' AS path, 'P' || CAST(label AS VARCHAR) AS participant_id, CAST(vec_id AS VARCHAR) AS capture_id,
 CASE WHEN vec_id % 5 < 4 THEN {_N} END AS n_points, CASE WHEN vec_id % 5 < 4 THEN 'ok' ELSE 'error' END AS outcome,
 CASE vec_id % 5 WHEN 1 THEN 'vertices_reshaped_from_flat_xyz' WHEN 2 THEN 'vertices_from_dict_records' WHEN 3 THEN 'vertices_from_component_arrays' ELSE '' END AS shape FROM embeddings""")
def coerce_shapes(spark, sf):
    p = json_captures.parse_captures(_encoded(spark, sf), jvm=True)
    key = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    shape = F.coalesce(F.array_join(F.filter("assumptions", lambda a: a.startswith("vertices_")), ","), F.lit(""))
    pid = F.coalesce("participant_id", F.regexp_extract("path", r"raw/([^/]+)/", 1))
    return p.select("path", pid.alias("participant_id"), key.alias("capture_id"), F.size("points").alias("n_points"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("outcome"), shape.alias("shape")).withColumn("n_points", F.when(F.col("outcome") == "ok", F.col("n_points")))


@query()
def resolve_alias(spark, sf):
    return json_captures.inspect_schema(json_captures.parse_captures(_encoded(spark, sf))).withColumn("paths", F.array_join("paths", ","))


# --- ratings -------------------------------------------------------------------------------------
RAT = "rat AS (SELECT l_partkey AS participant_id, l_suppkey AS rater_id, CAST(l_quantity AS DOUBLE) AS rating FROM lineitem)"


@query(f"""WITH {RAT}, t(n_key, t) AS (VALUES {', '.join(f'({df + 1}, {t_quantile(0.975, df)!r})' for df in range(1, 121))}),
 g AS (SELECT participant_id, avg(rating) AS m, median(rating) AS md, stddev_samp(rating) AS sd, count(*) AS n, min(rating) AS lo, max(rating) AS hi FROM rat GROUP BY participant_id)
SELECT participant_id, {r6('m', 'mean_rating')}, {r6('md', 'median_rating')}, {r6('sd', 'std_rating')}, {r6('sd / sqrt(n)', 'sem_rating')}, n AS n_ratings, {r6('m - t * sd / sqrt(n)', 'ci_low')}, {r6('m + t * sd / sqrt(n)', 'ci_high')},
 {r6('2 * t * sd / sqrt(n)', 'ci_width')}, {r6('lo', 'min_rating')}, {r6('hi', 'max_rating')} FROM g LEFT JOIN t ON t.n_key = g.n""")
def rating_consensus(spark, sf):
    return rounded(ratings.consensus(tables.ratings(spark, sf)))


@query(f"WITH {RAT} SELECT participant_id, rater_id, count(*) AS n FROM rat GROUP BY participant_id, rater_id HAVING count(*) > 1")
def rating_duplicates(spark, sf):
    return ratings.duplicates(tables.ratings(spark, sf))


@query(f"WITH {RAT} SELECT participant_id, rater_id, rating FROM rat WHERE rating < 1 OR rating > 45")
def rating_out_of_range(spark, sf):
    return ratings.out_of_range(tables.ratings(spark, sf), SCALE)


@query(f"WITH {RAT} SELECT participant_id, count(rating) AS n FROM rat GROUP BY participant_id HAVING count(rating) < 20")
def rating_thin(spark, sf):
    return ratings.thin(tables.ratings(spark, sf), 20)


@query("SELECT l_orderkey AS rater_id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2 AND min(l_linestatus) = max(l_linestatus)")
def rating_flat_raters(spark, sf):
    r = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rater_id"), F.ascii("l_linestatus").cast("double").alias("rating"))
    return ratings.flat_raters(r, 2)


@query("SELECT DISTINCT o_custkey AS participant_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)")
def rating_unknown_subjects(spark, sf):
    c = tables.table(spark, sf, "customer").where("c_nationkey <> 7").select(F.col("c_custkey").alias("participant_id"))
    return ratings.unknown_subjects(tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("participant_id")), c)


@query(f"""WITH {RAT} SELECT * FROM (SELECT 'rating outside the scale' AS problem, count(*) AS n FROM rat WHERE rating < 1 OR rating > 45 UNION ALL
 SELECT 'more than one rating by a rater', count(*) FROM (SELECT 1 FROM rat GROUP BY participant_id, rater_id HAVING count(*) > 1) UNION ALL SELECT 'missing rating', count(*) FROM rat WHERE rating IS NULL UNION ALL
 SELECT 'participant with few ratings', count(*) FROM (SELECT 1 FROM rat GROUP BY participant_id HAVING count(rating) < 3) UNION ALL SELECT 'rater who never varies', count(*) FROM (SELECT 1 FROM rat GROUP BY rater_id HAVING count(rating) >= 5 AND min(rating) = max(rating))) WHERE n > 0""")
def rating_problems(spark, sf):
    return ratings.problems(tables.ratings(spark, sf), SCALE)


@query()
def rating_bootstrap(spark, sf):
    return rounded(ratings.bootstrap(tables.ratings(spark, sf)), 4)


def _icc_sql(where: str) -> str:
    return f"""WITH cells AS (SELECT user_id AS p, event_type AS r, avg(value) AS v FROM events {where} GROUP BY user_id, event_type),
 full_ AS (SELECT p FROM cells GROUP BY p HAVING count(*) = (SELECT count(DISTINCT r) FROM cells)), b AS (SELECT c.* FROM cells c JOIN full_ f ON f.p = c.p),
 t AS (SELECT avg(v) AS g, count(DISTINCT p) AS n, count(DISTINCT r) AS k FROM b), m AS (SELECT v, avg(v) OVER (PARTITION BY p) AS pm, avg(v) OVER (PARTITION BY r) AS rm FROM b),
 s AS (SELECT max(n) AS n, max(k) AS k, sum(pow(pm - g, 2)) / max(n - 1) AS mr, sum(pow(rm - g, 2)) / max(k - 1) AS mc, sum(pow(v - pm - rm + g, 2)) / max((n - 1) * (k - 1)) AS me FROM m, t)
SELECT n AS n_participants, k AS n_raters, {r6('(mr - me) / (mr + (k - 1) * me + k * (mc - me) / n)', 'icc_single')}, {r6('(mr - me) / (mr + (mc - me) / n)', 'icc_average')} FROM s"""


@query(_icc_sql(""))
def icc_complete(spark, sf):
    return rounded(ratings.icc(ratings.complete_block(tables.event_ratings(spark, sf))[0]))


@query(_icc_sql("WHERE NOT (user_id % 5 = 0 AND event_type = 'click')"))
def icc_incomplete(spark, sf):
    return rounded(ratings.icc(ratings.complete_block(tables.event_ratings(spark, sf, complete=False))[0]))


# --- metrics -------------------------------------------------------------------------------------
PRED = "u AS (SELECT sum(l_extendedprice) / sum(l_quantity) AS unit FROM lineitem), pred AS (SELECT l_returnflag AS grp, CAST(l_extendedprice AS DOUBLE) AS t, l_quantity * unit AS p, l_quantity * unit - l_extendedprice AS e FROM lineitem, u)"
_R2, _R = "1 - sum(e * e) / (count(*) * var_pop(t))", "covar_pop(t, p) / sqrt(var_pop(t) * var_pop(p))"


@query(f"""WITH {PRED}, m AS (SELECT avg(t) AS m FROM pred), b AS (SELECT avg(abs(t - m)) AS b, sqrt(avg(pow(t - m, 2))) AS c FROM pred, m),
 a AS (SELECT count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, {_R2} AS r2, {_R} AS r FROM pred)
SELECT n, round(mae, 4) + 0.0 AS mae, round(rmse, 4) + 0.0 AS rmse, round(r2, 4) + 0.0 AS r2, round(r, 4) + 0.0 AS pearson_r, round(b, 4) + 0.0 AS baseline_mae, round(c, 4) + 0.0 AS baseline_rmse FROM a, b""")
def regression_metrics(spark, sf):
    return rounded(metrics.regression_metrics(tables.predictions(spark, sf)), 4)


_GROUPS = f"{PRED}, gm AS (SELECT grp, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, {_R2} AS r2, avg(t) AS mt, avg(p) AS mp, avg(e) AS mb FROM pred GROUP BY grp)"


@query(f"WITH {_GROUPS} SELECT grp, n, round(mae, 4) + 0.0 AS mae, round(rmse, 4) + 0.0 AS rmse, round(r2, 4) + 0.0 AS r2, round(mt, 4) + 0.0 AS mean_true, round(mp, 4) + 0.0 AS mean_predicted, round(mb, 4) + 0.0 AS mean_bias, n < 10 AS underpowered FROM gm")
def group_metrics(spark, sf):
    return rounded(metrics.group_metrics(tables.predictions(spark, sf)), 4)


@query(f"WITH {_GROUPS} SELECT count(*) AS n_groups, round(max(mae) - min(mae), 4) + 0.0 AS mae_spread, (SELECT grp FROM gm ORDER BY mae DESC, grp LIMIT 1) AS worst, (SELECT grp FROM gm ORDER BY mae, grp LIMIT 1) AS best FROM gm")
def fairness_spread(spark, sf):
    return rounded(metrics.fairness(metrics.group_metrics(tables.predictions(spark, sf))), 4)


@query(f"""WITH {PRED}, k AS (SELECT rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM pred)
SELECT count(*) AS n, {r6('covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b))', 'spearman_rho')} FROM k""")
def spearman(spark, sf):
    return rounded(metrics.spearman(tables.predictions(spark, sf)))


_CF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})), 5) + 0.0 AS r FROM lineitem" for i, a in enumerate(_CF) for b in _CF[i + 1 :]))
def feature_correlation(spark, sf):
    return rounded(metrics.correlations(tables.table(spark, sf, "lineitem"), _CF), 5)


# --- splits and training tables ------------------------------------------------------------------
@query("""WITH g AS (SELECT DISTINCT o_custkey AS p FROM orders), k AS (SELECT p, row_number() OVER (ORDER BY md5('42:' || CAST(p AS VARCHAR)), p) AS r FROM g), n AS (SELECT ceil(0.2 * count(*)) AS n FROM g)
SELECT o.o_orderkey, o.o_custkey AS participant_id, CASE WHEN k.r <= n.n THEN 'test' ELSE 'train' END AS side FROM orders o JOIN k ON k.p = o.o_custkey, n""")
def group_split(spark, sf):
    o = tables.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("participant_id"))
    return splits.participant_split(o).select("o_orderkey", "participant_id", "side")


@query()
def group_folds(spark, sf):
    o = tables.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("participant_id"))
    return splits.participant_folds(o).select("o_orderkey", "participant_id", "fold")


@query("SELECT o_custkey AS participant_id FROM orders WHERE o_orderkey % 97 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 97 <> 0")
def leakage_check(spark, sf):
    """All orders: a small held-out side against the others."""
    o = tables.table(spark, sf, "orders").withColumnRenamed("o_custkey", "participant_id")
    return splits.leaked(o.where("o_orderkey % 97 = 0"), o.where("o_orderkey % 97 <> 0"))


@query("SELECT o_custkey AS participant_id FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 <> 0 OR o_orderkey IS NULL")
def leakage_check_all(spark, sf):
    """All orders: two sides of about one size."""
    o = tables.table(spark, sf, "orders").withColumnRenamed("o_custkey", "participant_id")
    even = F.coalesce(F.col("o_orderkey") % 2 == 0, F.lit(False))
    return splits.leaked(o.where(even), o.where(~even))


@query("SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, min(n) AS min_n, median(n) AS median_n, max(n) AS max_n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def captures_per_group(spark, sf):
    return splits.captures_per_group(tables.table(spark, sf, "orders"), "o_custkey")


@query("SELECT l_suppkey AS participant_id, round(stddev_samp(l_discount), 6) + 0.0 AS l_discount, round(stddev_samp(l_tax), 6) + 0.0 AS l_tax FROM lineitem GROUP BY l_suppkey")
def within_group_spread(spark, sf):
    return rounded(splits.within_group_spread(tables.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "participant_id"), ["l_discount", "l_tax"]))


WIDE = "wide AS (SELECT l_suppkey AS participant_id, avg(l_quantity) AS f_quantity, avg(l_discount) AS f_discount, avg(l_extendedprice) AS f_price, avg(CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN l_tax END) AS f_rare, 1.0 AS f_constant, CAST(NULL AS DOUBLE) AS f_empty FROM lineitem GROUP BY l_suppkey)"
_WF = ["f_quantity", "f_discount", "f_price", "f_rare", "f_constant", "f_empty"]


@query(f"WITH {WIDE}, c AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS name, count(*) AS n_rows, count({c}) AS n_present, count(DISTINCT round({c}, 9)) AS n_distinct FROM wide' for c in _WF)}) SELECT name, n_rows, n_present, n_distinct, round(n_present / CAST(n_rows AS DOUBLE), 6) + 0.0 AS coverage, CASE WHEN n_present = 0 THEN 'dead' WHEN n_distinct = 1 THEN 'constant' WHEN n_present < n_rows THEN 'partial' ELSE 'full' END AS kind FROM c")
def coverage(spark, sf):
    w = tables.supplier_features(spark, sf)
    return rounded(features.coverage(w.select("participant_id", *(F.round(c, 9).alias(c) for c in _WF)), _WF))


TARGETS = "tgt AS (SELECT l_suppkey AS participant_id, avg(l_tax) AS mean_rating, count(*) AS n_ratings FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey HAVING count(*) >= 140)"


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.consensus(tables.table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("participant_id"), F.col("l_partkey").alias("rater_id"), F.col("l_tax").cast("double").alias("rating")))


@query(f"WITH {WIDE}, {TARGETS} SELECT w.participant_id, t.n_ratings, {r6('t.mean_rating', 'mean_rating')}, {r6('f_quantity', 'f_quantity')}, {r6('f_discount', 'f_discount')}, {r6('f_price', 'f_price')}, {r6('f_rare', 'f_rare')} FROM wide w JOIN tgt t ON t.participant_id = w.participant_id")
def assemble_join(spark, sf):
    return rounded(models.assemble(tables.supplier_features(spark, sf), _targets(spark, sf), _WF, 140).table.select("participant_id", "n_ratings", "mean_rating", "f_quantity", "f_discount", "f_price", "f_rare"))


@query()
def drop_constant_columns(spark, sf):
    d = models.assemble(tables.supplier_features(spark, sf), _targets(spark, sf), _WF)
    return spark.createDataFrame([(c, c in d.features) for c in _WF], "name string, kept boolean")


# --- features and models -------------------------------------------------------------------------
@query()
def feature_table(spark, sf):
    wide, _ = features.build_feature_table(tables.captures(spark, sf), CONVENTION, marks=MARKS, fit_plane=False)
    return rounded(wide, 5)


@query()
def feature_table_fitted(spark, sf):
    """With the library's default, a midplane fitted to each capture."""
    wide, _ = features.build_feature_table(_spread(tables.captures(spark, sf)), CONVENTION, marks=MARKS)
    return rounded(wide, 4)


@query()
def feature_table_long(spark, sf):
    wide, _ = features.build_feature_table(tables.captures(spark, sf), CONVENTION, marks=MARKS, fit_plane=False)
    return rounded(features.long_form(wide, MARKS), 5)


_TRAIN = ["l_quantity", "l_discount", "l_tax", "f_line"]


def _training(spark: SparkSession, sf: str) -> DataFrame:
    i = tables.table(spark, sf, "lineitem")
    return i.select(F.col("l_suppkey").alias("participant_id"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("f_line"), (F.col("l_extendedprice") / 1000).alias("mean_rating"), F.lit(1.0).alias("n_ratings"))


def _model(name: str, **options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = splits.participant_split(_training(spark, sf))
        fitted = models.fit(t.where("side = 'train'"), _TRAIN, name, weight="n_ratings", **options)
        held = models.predictions(fitted, t.where("side = 'test'")).select("truth", "predicted").persist(StorageLevel.DISK_ONLY)  # predicted once
        try:
            found = rounded(metrics.regression_metrics(held).withColumn("model", F.lit(name)), 4)
            return spark.createDataFrame(found.collect(), found.schema)
        finally:
            held.unpersist()

    return run


for _name, _key, _options in (("linear", "ols_fit", {}), ("ridge", "ridge_loo", {}), ("random_forest", "random_forest", {}), ("gbt", "gbt", {})):
    query(name=_key)(_model(_name, **_options))


@query()
def cross_validation(spark, sf):
    d = models.TrainingData(_training(spark, sf), _TRAIN)
    return rounded(metrics.regression_metrics(models.cross_validate(d, "ridge")), 4)


@query()
def permutation_importance(spark, sf):
    t = splits.participant_split(_training(spark, sf))
    fitted = models.fit(t.where("side = 'train'"), _TRAIN, "ridge")
    return rounded(models.permutation_importance(fitted, t.where("side = 'test'")), 3)


@query()
def model_importance(spark, sf):
    fitted = models.fit(_training(spark, sf), _TRAIN, "ridge")
    frame = fitted.importance()
    return rounded(spark.createDataFrame([(r.feature, float(np.round(r.importance, 6))) for r in frame.itertuples()], "feature string, importance double"))


from . import frames  # noqa: E402, F401 - further queries, registered on import
