"""Further registered queries: frames, units, artefact floors, cohort notes, documents, folds, audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import t_quantile
from ..operators import mesh, metrics, midline, models, normalise, ranks, ratings, shap, splits, symmetry, validation
from ..sources import captures as json_captures
from ..sources import tables
from .queries import _CURVE, _GROUPS, _ISSUES, _NN, _TRAIN, _UNEVEN, CONVENTION, ORACLES, PRED, PTS, RAT, TARGETS, WIDE, _encoded, _mirror_sql, _skew, _training, _uneven, CLOUD, SIZE, query, r6, rounded


# --- world-space captures ------------------------------------------------------------------------
def _spaces(spark: SparkSession, sf: str) -> DataFrame:
    """By capture_key modulo 4: face-local; world-space with a turning, scaling and moving transform; without one; with one that has no inverse."""
    c = tables.captures(spark, sf)
    k, p = F.col("capture_key") % 4, F.col("points")[0]
    zero, one = F.lit(0.0), F.lit(1.0)
    turn = F.array(zero, F.lit(-1.0), zero, p["x"], one, zero, zero, p["y"], zero, zero, F.lit(2.0), p["z"], zero, zero, zero, one)
    flat = F.array(one, zero, zero, zero, one, zero, zero, zero, zero, zero, one, zero, zero, zero, zero, one)
    return c.withColumns({"coordinate_space": F.when(k == 0, "face_local").otherwise("world"), "transform": F.when(k <= 1, turn).when(k == 3, flat)})


@query(f"""WITH {PTS}, o AS (SELECT capture_key, x AS tx, y AS ty, z AS tz FROM pts WHERE vid = 0)
SELECT p.capture_key, p.vid, {r6('CASE WHEN p.capture_key % 4 = 1 THEN y - ty ELSE x END', 'x')}, {r6('CASE WHEN p.capture_key % 4 = 1 THEN tx - x ELSE y END', 'y')}, {r6('CASE WHEN p.capture_key % 4 = 1 THEN (z - tz) / 2 ELSE z END', 'z')},
 p.capture_key % 4 >= 2 AS unusable FROM pts p JOIN o ON o.capture_key = p.capture_key""")
def to_face_local(spark, sf):
    local = normalise.to_face_local(_spaces(spark, sf))
    return rounded(tables.vertices(local.withColumn("unusable", F.col("frame_error").isNotNull()), "unusable").select("capture_key", "vid", "x", "y", "z", "unusable"))


@query(f"""WITH {PTS} SELECT capture_key, CASE capture_key % 4 WHEN 2 THEN 'world-space vertices without an anchor transform' ELSE 'world-space vertices with an anchor transform without inverse' END AS error
FROM pts WHERE vid = 0 AND capture_key % 4 >= 2""")
def frame_problems(spark, sf):
    return normalise.normalise(_spaces(spark, sf), CONVENTION).where("error IS NOT NULL").select("capture_key", "error")


def _faces(spark: SparkSession, sf: str) -> DataFrame:
    """`_spaces` with eyes, in the face's own frame as all eyes are: the second and third points before any transform."""
    eyes = {e: F.col("points")[i] for i, e in ((1, "left_eye"), (2, "right_eye"))}
    return _spaces(spark, sf).withColumns(eyes)


_LOCAL = f"""{PTS}, o AS (SELECT capture_key, x AS tx, y AS ty, z AS tz FROM pts WHERE vid = 0),
 loc AS (SELECT p.capture_key, p.vid, CASE WHEN p.capture_key % 4 = 1 THEN y - ty ELSE x END AS x, CASE WHEN p.capture_key % 4 = 1 THEN tx - x ELSE y END AS y,
  CASE WHEN p.capture_key % 4 = 1 THEN (z - tz) / 2 ELSE z END AS z FROM pts p JOIN o ON o.capture_key = p.capture_key WHERE p.capture_key % 4 < 2),
 sz AS (SELECT capture_key, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS size FROM loc GROUP BY capture_key)"""


def _local_mirror(axis: int, c: str) -> str:
    gap = " + ".join(f"pow(a.{k} - b.{k}, 2)" if k != c else f"pow(2 * s.c{k} - a.{k} - b.{k}, 2)" for k in "xyz")
    return f"""SELECT {axis} AS axis, avg(e) AS e FROM (SELECT capture_key, sqrt(avg(d)) / max(size) AS e FROM (SELECT a.capture_key, a.vid, s.size, min({gap}) AS d
 FROM loc a JOIN loc b ON b.capture_key = a.capture_key JOIN sz s ON s.capture_key = a.capture_key GROUP BY a.capture_key, a.vid, s.size) GROUP BY capture_key)"""


def _local_skew(axis: int, c: str) -> str:
    third = f"coalesce((avg(pow({c}, 3)) - 3 * avg({c}) * avg(pow({c}, 2)) + 2 * pow(avg({c}), 3)) / nullif(pow(stddev_pop({c}), 3), 0), 0)"
    eyes = f"SELECT l.capture_key, l.{c} - r.{c} AS apart, (l.{c} + r.{c}) / 2 - s.c{c} AS above FROM pts l JOIN pts r ON r.capture_key = l.capture_key AND r.vid = 2 JOIN sz s ON s.capture_key = l.capture_key WHERE l.vid = 1"
    return f"SELECT {axis} AS axis, (SELECT avg(k) FROM (SELECT {third} AS k FROM loc GROUP BY capture_key)) AS skew, avg(apart) AS apart, avg(above) AS above FROM ({eyes})"


@query(f"""WITH {_LOCAL}, m AS ({' UNION ALL '.join(_local_mirror(i, c) for i, c in enumerate('xyz'))}), v AS ({' UNION ALL '.join(_local_skew(i, c) for i, c in enumerate('xyz'))}),
 lr AS (SELECT axis FROM m ORDER BY e, axis LIMIT 1), ant AS (SELECT axis FROM v WHERE axis <> (SELECT axis FROM lr) ORDER BY abs(skew) DESC, axis LIMIT 1),
 f AS (SELECT (SELECT axis FROM lr) AS l, (SELECT axis FROM ant) AS a, 3 - (SELECT axis FROM lr) - (SELECT axis FROM ant) AS s),
 g AS (SELECT l, a, s, CASE WHEN vl.apart > 0 THEN 1 ELSE -1 END AS ls, CASE WHEN va.skew > 0 THEN 1 ELSE -1 END AS sa, CASE WHEN vs.above > 0 THEN 1 ELSE -1 END AS ss
  FROM f JOIN v vl ON vl.axis = l JOIN v va ON va.axis = a JOIN v vs ON vs.axis = s)
SELECT l AS left_axis, ls AS left_sign, s AS superior_axis, ss AS superior_sign, a AS anterior_axis,
 CASE WHEN (l + 1) % 3 = s THEN ls * ss ELSE -ls * ss END AS anterior_sign, CAST((SELECT count(DISTINCT capture_key) FROM pts WHERE capture_key % 4 >= 2) AS BIGINT) AS left_out FROM g""")
def axis_detection_world(spark, sf):
    """The convention of face-local and world-space captures together: each votes in its own frame, and some have none."""
    c = normalise.detect_axes(_faces(spark, sf))
    row = (*c.left, *c.superior, *c.anterior, c.evidence["captures_without_frame"])
    return spark.createDataFrame([row], "left_axis int, left_sign int, superior_axis int, superior_sign int, anterior_axis int, anterior_sign int, left_out long")


# Names of units with the metres in them, and of spaces, as documents may give them.
_UNIT_NAMES = ["m", "meter", "Meters", "metre", "metres", "cm", "centimeter", "centimeters", "mm", "millimeter", "Millimeters"]
_METRES = [1, 1, 1, 1, 1, 0.01, 0.01, 0.01, 0.001, 0.001, 0.001]
_SPACE_NAMES = ["face", "face_local", "faceLocal", "anchor", "local", "Model", "world", "global", "scene"]


@query(f"""WITH c AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(vec_id % {len(_UNIT_NAMES)} AS INTEGER) AS u, CAST(vec_id % {len(_SPACE_NAMES)} AS INTEGER) AS s FROM embeddings)
SELECT vec_id AS capture_key, round(x * (CASE u {' '.join(f'WHEN {i} THEN {m}' for i, m in enumerate(_METRES))} END), 9) + 0.0 AS x, CASE WHEN s >= 6 THEN 'world' ELSE 'face_local' END AS coordinate_space FROM c""")
def units_and_spaces(spark, sf):
    c = tables.captures(spark, sf)
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("capture_key") % len(names) + 1).cast("int"))
    points = F.transform("points", lambda p: F.array(p["x"], p["y"], p["z"]))
    blob = F.to_json(F.struct(F.lit("p").alias("pid"), points.alias("vertices"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("faces"), name(_UNIT_NAMES).alias("lengthUnits"), name(_SPACE_NAMES).alias("vertexSpace")))
    parsed = json_captures.parse_captures(c.select(F.col("capture_key").cast("string").alias("path"), F.encode(blob, "UTF-8").alias("content")))
    return rounded(parsed.select(F.col("path").cast("long").alias("capture_key"), F.col("points")[0]["x"].alias("x"), "coordinate_space"), 9)


# --- artefact floors -----------------------------------------------------------------------------
@query(f"""WITH {_NN}, md AS (SELECT capture_key, median(spacing) AS m FROM nn GROUP BY capture_key),
 s AS (SELECT n.capture_key, sqrt(avg(pow(mirror / size, 2))) AS rms, max(m) / max(size) * (1 - avg(CASE WHEN mirror < 0.1 * m THEN 1.0 ELSE 0.0 END)) AS floor_ FROM nn n JOIN md ON md.capture_key = n.capture_key GROUP BY n.capture_key)
SELECT capture_key, {r6('floor_', 'effective_floor')}, rms > 2 * floor_ AS exceeds_floor, CASE WHEN floor_ < 1e-9 THEN 'unbiased: the mesh is mirror-paired' WHEN rms > 2 * floor_ THEN 'above the floor of nearest vertices'
 ELSE 'ambiguous: within the floor of nearest vertices, to be measured to the surface' END AS verdict FROM s""")
def symmetry_floor(spark, sf):
    return rounded(symmetry.effective_floor(symmetry.symmetry_fixed(tables.captures(spark, sf))).select("capture_key", "effective_floor", "exceeds_floor", "verdict"))


# --- validation over all codes -------------------------------------------------------------------
_ALL_ISSUES = _ISSUES.replace("WHERE capture_key % 7 = 0 OR capture_key % 11 = 0", "WHERE capture_key % 7 = 0")
_TWINS = """same AS (SELECT p.capture_key, string_agg(CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ',' || CAST(z AS VARCHAR), ';' ORDER BY vid) AS h FROM pts p JOIN c ON c.capture_key = p.capture_key AND p.vid < c.nv GROUP BY p.capture_key),
 twins AS (SELECT capture_key FROM (SELECT capture_key, count(*) OVER (PARTITION BY h) AS n FROM same) WHERE n > 1)"""


@query(f"WITH {_ALL_ISSUES} SELECT capture_key, severity, code FROM iss")
def capture_issues_all(spark, sf):
    return validation.capture_issues(_uneven(spark, sf)).select("capture_key", "severity", "code")


@query(f"WITH {_UNEVEN}, {_TWINS} SELECT capture_key, participant_id, CASE WHEN capture_key % 7 = 0 OR capture_key IN (FROM twins) THEN 'FAIL' ELSE 'WARN' END AS status FROM c")
def cohort_status_all(spark, sf):
    return validation.status(_uneven(spark, sf)).select("capture_key", "participant_id", "status")


@query(f"""WITH {_UNEVEN}, {_TWINS}, f AS (SELECT participant_id, capture_key % 7 = 0 OR capture_key IN (FROM twins) AS bad FROM c)
SELECT participant_id, count(*) AS n_captures, sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS n_fail, bool_and(bad) AS dead FROM f GROUP BY participant_id""")
def dead_groups_all(spark, sf):
    return validation.participants(validation.status(_uneven(spark, sf))).select("participant_id", "n_captures", "n_fail", "dead")


def _with_copies(spark: SparkSession, sf: str) -> DataFrame:
    """All captures, and every fifth once more under a negative key."""
    c = tables.captures(spark, sf)
    return c.unionByName(c.where("capture_key % 5 = 0").withColumn("capture_key", -F.col("capture_key") - 1))


@query(f"""WITH {PTS}, g AS (SELECT capture_key, string_agg(CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ',' || CAST(z AS VARCHAR), ';' ORDER BY vid) AS h FROM pts GROUP BY capture_key),
 a AS (SELECT capture_key, h FROM g UNION ALL SELECT -capture_key - 1, h FROM g WHERE capture_key % 5 = 0)
SELECT capture_key, 'duplicate_geometry' AS code FROM (SELECT capture_key, count(*) OVER (PARTITION BY h) AS n FROM a) WHERE n > 1""")
def duplicate_geometry_copies(spark, sf):
    return validation.cohort_issues(_with_copies(spark, sf)).where("code = 'duplicate_geometry'").select("capture_key", "code")


@query(f"""WITH {_UNEVEN} SELECT 'vertex counts differ' AS note, CAST(nv AS VARCHAR) AS detail, count(*) AS n FROM c WHERE (SELECT count(DISTINCT nv) FROM c) > 1 GROUP BY nv
UNION ALL SELECT 'triangle counts differ', CAST(nt AS VARCHAR), count(*) FROM c WHERE (SELECT count(DISTINCT nt) FROM c) > 1 GROUP BY nt""")
def cohort_notes(spark, sf):
    return validation.cohort_notes(_uneven(spark, sf)).where("note <> 'captures share one geometry'")


@query(f"""WITH {_UNEVEN}, a AS (SELECT capture_key, nv, nt FROM c UNION ALL SELECT -capture_key - 1, nv, nt FROM c WHERE capture_key % 5 = 0),
 shapes AS (SELECT p.capture_key, string_agg(CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ',' || CAST(z AS VARCHAR), ';' ORDER BY vid) AS h FROM pts p JOIN c ON c.capture_key = p.capture_key AND p.vid < c.nv GROUP BY p.capture_key),
 g AS (SELECT a.capture_key, s.h FROM a JOIN shapes s ON s.capture_key = CASE WHEN a.capture_key < 0 THEN -a.capture_key - 1 ELSE a.capture_key END)
SELECT 'vertex counts differ' AS note, CAST(nv AS VARCHAR) AS detail, count(*) AS n FROM a WHERE (SELECT count(DISTINCT nv) FROM a) > 1 GROUP BY nv
UNION ALL SELECT 'triangle counts differ', CAST(nt AS VARCHAR), count(*) FROM a WHERE (SELECT count(DISTINCT nt) FROM a) > 1 GROUP BY nt
UNION ALL SELECT 'captures share one geometry', 'first: ' || CAST(min(capture_key) AS VARCHAR), count(*) FROM g GROUP BY h HAVING count(*) > 1""")
def cohort_notes_all(spark, sf):
    """All notes, those on shared geometry too; the hash in their detail is this library's own and left out."""
    c = _uneven(spark, sf)
    notes = validation.cohort_notes(c.unionByName(c.where("capture_key % 5 = 0").withColumn("capture_key", -F.col("capture_key") - 1)))
    shared = F.col("note") == "captures share one geometry"
    return notes.withColumn("detail", F.when(shared, F.regexp_replace("detail", "^[0-9a-f]+ ", "")).otherwise(F.col("detail")))


# --- documents -----------------------------------------------------------------------------------
@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 3 AS INTEGER) AS n FROM orders),
 r AS (SELECT o_orderkey AS path, 'a' AS key_path, 0 AS depth, 'object' AS kind, 'object of 2 keys' AS preview FROM o
  UNION ALL SELECT o_orderkey, 'a.b', 1, 'string', '"' || o_orderstatus || '"' FROM o UNION ALL SELECT o_orderkey, 'a.c', 1, 'null', 'null' FROM o
  UNION ALL SELECT o_orderkey, 'list', 0, 'array', CASE n WHEN 0 THEN 'empty array' ELSE 'array of ' || n || ' objects with keys k' END FROM o
  UNION ALL SELECT o_orderkey, 'list[0].k', 1, 'number', CAST(o_orderkey AS VARCHAR) FROM o WHERE n > 0
  UNION ALL SELECT o_orderkey, 'rows', 0, 'array', 'array of 1 arrays of 3' FROM o UNION ALL SELECT o_orderkey, 'yes', 0, 'boolean', 'true' FROM o)
SELECT * FROM r""")
def json_tree_nested(spark, sf):
    o = tables.table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    entries = F.array_join(F.array_repeat(F.concat(F.lit('{"k": '), k, F.lit("}")), (F.col("o_orderkey") % 3).cast("int")), ", ")
    text = F.concat(F.lit('{"yes": true, "rows": [[1, 2, 3]], "list": ['), entries, F.lit('], "a": {"c": null, "b": "'), F.col("o_orderstatus"), F.lit('"}}'))
    return json_captures.key_tree(o.select(F.col("o_orderkey").alias("path"), text.alias("content")))


@query(f"""WITH {PTS}, b AS (SELECT capture_key, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts WHERE capture_key % 5 < 4 GROUP BY capture_key)
SELECT 'raw/P' || CAST(e.label AS VARCHAR) || '/' || CAST(e.vec_id AS VARCHAR) || '.json' AS capture_key, 'P' || CAST(e.label AS VARCHAR) AS participant_id, 21 AS n_vertices, 19 AS n_triangles, {', '.join(r6(f'{f}_{a}', f'{f}_{a}') for a in 'xyz' for f in ('min', 'max'))},
 {r6('sqrt(pow(max_x - min_x, 2) + pow(max_y - min_y, 2) + pow(max_z - min_z, 2))', 'bbox_diagonal')}, 0 AS n_blend_shapes, false AS has_eyes FROM embeddings e JOIN b ON b.capture_key = e.vec_id""")
def capture_summaries(spark, sf):
    s = json_captures.summaries(json_captures.parse_captures(_encoded(spark, sf)))
    bounds = [f"{f}_{a}" for a in "xyz" for f in ("min", "max")]
    return rounded(s.select("capture_key", "participant_id", "n_vertices", "n_triangles", *bounds, "bbox_diagonal", "n_blend_shapes", "has_eyes"))


_FOUND = {"participant_id": "participant_id", "vertices": "faceGeometry.vertices", "triangle_indices": "faceGeometry.triangleIndices"}
ORACLES["resolve_alias"] = f"""SELECT f.field, f.field IN ({', '.join(f"'{r}'" for r in json_captures.REQUIRED)}) AS required, CASE WHEN f.place <> '' THEN n ELSE 0 END AS n_found, CASE WHEN f.place <> '' THEN 0 ELSE n END AS n_missing, f.place AS paths
FROM (VALUES {', '.join(f"('{f}', '{_FOUND.get(f, '')}')" for f in json_captures.ALIASES)}) f(field, place), (SELECT count(*) AS n FROM embeddings)"""


# --- ratings, audits, folds ----------------------------------------------------------------------
@query(f"""WITH {RAT}, g AS (SELECT participant_id, avg(rating) AS m, stddev_samp(rating) AS sd, count(*) AS n FROM rat GROUP BY participant_id)
SELECT count(*) AS n_participants, CAST(median(n) AS DOUBLE) AS median_ratings, min(n) AS min_ratings, max(n) AS max_ratings, {r6('avg(m)', 'mean_rating')}, {r6('stddev_samp(m)', 'sd_between')}, {r6('median(sd)', 'median_sd_within')} FROM g""")
def target_summary(spark, sf):
    return rounded(ratings.target_summary(ratings.targets(tables.ratings(spark, sf))).drop("median_ci_width"))


_T_VALUES = ", ".join(f"({df + 1}, {t_quantile(0.975, df)!r})" for df in range(1, 121))


@query(f"""WITH {RAT}, t(n_key, t) AS (VALUES {_T_VALUES}), g AS (SELECT participant_id, avg(rating) AS m, stddev_samp(rating) AS sd, count(*) AS n FROM rat GROUP BY participant_id)
SELECT count(*) AS n_participants, CAST(median(n) AS DOUBLE) AS median_ratings, min(n) AS min_ratings, max(n) AS max_ratings, {r6('avg(m)', 'mean_rating')}, {r6('stddev_samp(m)', 'sd_between')}, {r6('median(sd)', 'median_sd_within')},
 {r6('median(2 * t * sd / sqrt(n))', 'median_ci_width')} FROM g LEFT JOIN t ON t.n_key = g.n""")
def target_summary_all(spark, sf):
    """With the median width of the intervals; groups of up to 121 ratings, as the SQL's table of t has them."""
    return rounded(ratings.target_summary(ratings.targets(tables.ratings(spark, sf))))


@query("""SELECT event_id AS path, 'k' AS key_path, 0 AS depth, 'number' AS kind, CAST(CAST(props ->> '$.k' AS BIGINT) AS VARCHAR) AS preview FROM events""")
def json_key_tree_previews(spark, sf):
    return json_captures.key_tree(tables.table(spark, sf, "events").select(F.col("event_id").alias("path"), F.col("props").alias("content")))


@query(f"""WITH {PRED.replace('l_returnflag AS grp', 's_nationkey AS grp').replace('FROM lineitem, u)', 'FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) s ON s_suppkey = l_suppkey, u)')},
 {_GROUPS[len(PRED) + 2:]} SELECT grp, n, round(mae, 4) + 0.0 AS mae, round(mb, 4) + 0.0 AS mean_bias, n < 10 AS underpowered FROM gm WHERE grp IS NOT NULL""")
def demographic_audit(spark, sf):
    """Predictions audited by the nation of their supplier; every tenth supplier is unknown."""
    i = tables.table(spark, sf, "lineitem")
    unit = i.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("unit"))
    p = i.crossJoin(F.broadcast(unit)).select(F.col("l_suppkey").alias("participant_id"), F.col("l_extendedprice").cast("double").alias("truth"), (F.col("l_quantity") * F.col("unit")).alias("predicted"))
    nations = tables.table(spark, sf, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("participant_id"), "s_nationkey")
    groups = metrics.group_metrics(metrics.with_demographics(p, nations, "s_nationkey"))
    return rounded(groups.select("grp", "n", "mae", "mean_bias", "underpowered"), 4)


_LEAST = "least(l0, l1, l2, l3, l4)"
_FOLD = f"CASE {_LEAST} WHEN l0 THEN 0 WHEN l1 THEN 1 WHEN l2 THEN 2 WHEN l3 THEN 3 ELSE 4 END"
ORACLES["group_folds"] = f"""WITH RECURSIVE g AS (SELECT o_custkey AS p, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS i FROM orders GROUP BY o_custkey),
 r AS (SELECT CAST(0 AS BIGINT) AS i, -1 AS fold, CAST(0 AS BIGINT) AS l0, CAST(0 AS BIGINT) AS l1, CAST(0 AS BIGINT) AS l2, CAST(0 AS BIGINT) AS l3, CAST(0 AS BIGINT) AS l4
  UNION ALL SELECT g.i, {_FOLD}, {', '.join(f'l{k} + CASE WHEN {_FOLD} = {k} THEN g.n ELSE 0 END' for k in range(5))} FROM r JOIN g ON g.i = r.i + 1)
SELECT o.o_orderkey, o.o_custkey AS participant_id, r.fold FROM orders o JOIN g ON g.p = o.o_custkey JOIN r ON r.i = g.i"""

_WIDE_COLUMNS = ["f_quantity", "f_discount", "f_price", "f_rare", "f_constant", "f_empty"]
ORACLES["drop_constant_columns"] = f"WITH {WIDE}, {TARGETS.replace(' HAVING count(*) >= 140', '')}, j AS (SELECT w.* FROM wide w JOIN tgt t ON t.participant_id = w.participant_id) " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, coalesce(min({c}) <> max({c}), false) AS kept FROM j" for c in _WIDE_COLUMNS
)


@query(f"""WITH {PTS}, t AS (SELECT unnest(range({tables.N_POINTS - 2})) AS i), c AS (SELECT unnest(range(3)) AS k)
SELECT p.capture_key, CAST(t.i AS INTEGER) AS triangle, CAST(c.k AS INTEGER) AS corner, p.vid, {r6('p.x', 'x')}, {r6('p.y', 'y')}, {r6('p.z', 'z')} FROM t, c, pts p WHERE p.vid = t.i + c.k""")
def explode_mesh(spark, sf):
    """The table function in SQL, by a lateral join."""
    mesh.register_functions(spark)
    tables.captures(spark, sf).createOrReplaceTempView("__captures")
    return rounded(spark.sql("SELECT c.capture_key, m.* FROM __captures c, LATERAL explode_mesh(c.points, c.triangles) m"))


# Faults by capture_key modulo 16, and the codes that they must give besides those that all captures have.
_FAULTS = ["nan_vertices", "inf_vertices", "no_vertices", "no_topology", "missing_participant_id", "vertex_count_mismatch", "triangle_count_mismatch", "collapsed_mesh", "duplicate_vertex_positions", "load_failed", "assumption", "missing_capture_id"]


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Captures that have all that they can have, each with the fault that stands at its key modulo 16, or none."""
    c = tables.captures(spark, sf)
    k = F.col("capture_key") % 16
    spoilt = lambda v: F.transform("points", lambda p, i: F.struct(F.when(i == 2, F.lit(v)).otherwise(p["x"]).alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    scaled = F.transform("points", lambda p: F.struct(*((p[a] * 0.1).alias(a) for a in "xyz")))
    c = c.withColumn("points", scaled)
    same = F.transform("points", lambda p: F.struct(*(F.lit(0.5).alias(a) for a in "xyz")))
    twice = F.transform("points", lambda p, i: F.when(i == 1, F.col("points")[0]).otherwise(p))
    none = lambda kind: F.array().cast(kind)
    points = F.when(k == 0, spoilt(float("nan"))).when(k == 1, spoilt(float("inf"))).when(k == 2, none("array<struct<x:double,y:double,z:double>>")).when(k == 7, same).when(k == 8, twice).otherwise(F.col("points"))
    eye = F.struct(*(F.lit(0.0).alias(a) for a in "xyz"))
    return c.select(
        "capture_key", F.when(k != 4, F.col("participant_id").cast("string")).alias("participant_id"), F.when(k != 11, F.col("capture_key").cast("string")).alias("capture_id"), points.alias("points"),
        F.when(F.col("capture_key") % 16 == 3, none("array<struct<i:int,j:int,k:int>>")).otherwise(F.col("triangles")).alias("triangles"), F.when(k == 5, 20).otherwise(F.when(k == 2, 0).otherwise(21)).alias("declared_vertices"),
        F.when(k == 6, 18).otherwise(F.when(k == 3, 0).otherwise(19)).alias("declared_triangles"), eye.alias("left_eye"), eye.alias("right_eye"), F.create_map(F.lit("jawOpen"), F.lit(0.5)).alias("blend_shapes"),
        F.array_repeat(F.lit(1.0), 16).alias("transform"), F.when(k == 10, F.array(F.lit("units_assumed"))).alias("assumptions"), F.when(k == 9, "not JSON").alias("error"),
    )


@query(f"""WITH {PTS}, k AS (SELECT DISTINCT capture_key, CAST(capture_key % 16 AS INTEGER) AS k FROM pts), f(k, code, severity) AS (VALUES {', '.join(f"({i}, '{c}', '{'WARNING' if c == 'missing_capture_id' else 'INFO' if c in ('assumption', 'duplicate_vertex_positions') else 'ERROR'}')" for i, c in enumerate(_FAULTS))}),
 ext AS (SELECT p.capture_key, p.capture_key % 16 AS k, 0.1 * sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS d, 0.1 * sqrt(pow(max(x) FILTER (WHERE vid <> 1) - min(x) FILTER (WHERE vid <> 1), 2)
   + pow(max(y) FILTER (WHERE vid <> 1) - min(y) FILTER (WHERE vid <> 1), 2) + pow(max(z) FILTER (WHERE vid <> 1) - min(z) FILTER (WHERE vid <> 1), 2)) AS d1 FROM pts p GROUP BY p.capture_key)
SELECT k.capture_key, f.severity, f.code FROM k JOIN f ON f.k = k.k
UNION ALL SELECT capture_key, 'INFO', 'duplicate_vertex_positions' FROM k WHERE k = 7
UNION ALL SELECT capture_key, 'WARNING', 'implausible_scale' FROM ext WHERE k NOT IN (0, 1, 2, 7, 9) AND CASE WHEN k = 8 THEN d1 ELSE d END NOT BETWEEN 0.05 AND 0.40""")
def planted_faults(spark, sf):
    """Every code of a single capture, where it was planted and nowhere else."""
    return validation.capture_issues(_faulty(spark, sf)).select("capture_key", "severity", "code")


@query(f"""WITH {PTS}, k AS (SELECT DISTINCT capture_key, participant_id, CAST(capture_key % 16 AS INTEGER) AS k FROM pts), s AS (SELECT *, k < 8 OR k = 9 AS bad FROM k)
SELECT count(*) AS n_captures, count(*) FILTER (WHERE bad) AS n_fail, count(DISTINCT CASE WHEN k <> 4 THEN participant_id END) AS n_participants FROM s""")
def fault_summary(spark, sf):
    c = _faulty(spark, sf)
    return validation.summary(validation.status(c, validation.capture_issues(c))).select("n_captures", "n_fail", "n_participants")


@query(f"SELECT CAST(label AS VARCHAR) AS participant_id, count(*) AS n_captures FROM embeddings GROUP BY label HAVING count(*) > 1")
def repeated_participants(spark, sf):
    c = tables.captures(spark, sf).withColumn("participant_id", F.col("participant_id").cast("string"))
    return validation.repeated_participants(c)


def _full_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Captures as JSON with every field, in the shapes that exports give them: padded points, nested triangles, column-major and nested matrices, named and listed blend shapes."""
    c = tables.captures(spark, sf)
    k, x = F.col("capture_key"), F.col("points")[0]["x"]
    padded = F.transform("points", lambda p: F.array(p["x"], p["y"], p["z"], F.lit(1.0)))
    tri = F.transform("triangles", lambda t: F.array(t["i"], t["j"], t["k"]))
    one, zero = F.lit(1.0), F.lit(0.0)
    columns = F.array(one, zero, zero, zero, zero, one, zero, zero, zero, zero, one, zero, x, F.lit(2.0), F.lit(3.0), one)  # one column after the other
    rows = F.array(F.array(one, zero, zero, x), F.array(zero, one, zero, F.lit(2.0)), F.array(zero, zero, one, F.lit(3.0)), F.array(zero, zero, zero, one))
    shapes = F.when(k % 2 == 0, F.to_json(F.create_map(F.lit("jawOpen"), x))).otherwise(F.to_json(F.array(F.struct(F.lit("jawOpen").alias("name"), x.alias("value")))))
    stamp = F.when(k % 3 == 0, F.to_json(F.array(F.lit("2024-05-06T07:08:09+02:00")))).when(k % 3 == 1, F.to_json(F.array(F.lit(1.7e9) + k))).otherwise(F.lit('["soon"]'))
    fields = {
        "participantId": F.to_json(F.array(F.concat(F.lit("P"), F.col("participant_id")))), "captureId": F.to_json(F.array(F.concat(F.lit("c"), k))), "vertices": F.to_json(F.array(padded)), "triangleIndices": F.to_json(F.array(tri)),
        "leftEyeTransform": F.to_json(F.array(rows)), "rightEyeTransform": F.to_json(F.array(columns)), "timestamp": stamp, "lookAtPoint": F.to_json(F.array(F.array(x, zero, one))),
        "textureCoordinates": F.to_json(F.array(F.array(F.array(x, one)))), "vertexCount": F.to_json(F.array(F.size("points"))), "triangleCount": F.to_json(F.array(F.size("triangles"))), "coordinateSpace": F.lit('["face"]'), "units": F.lit('["m"]'),
    }
    inner = lambda v: F.substring(v, 2, F.length(v) - 2)  # noqa: E731 - of an array of one
    text = F.concat(F.lit('{"blendShapes": '), shapes, *(F.concat(F.lit(f', "{n}": '), inner(v)) for n, v in fields.items()), F.lit("}"))
    return c.select(k.cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"))


@query(f"""WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)
SELECT vec_id AS capture_key, 'P' || label AS participant_id, 'c' || vec_id AS capture_id, 21 AS n_points, 19 AS n_triangles, {r6('x', 'left_eye_x')}, 2.0 AS left_eye_y, {r6('x', 'right_eye_x')}, 3.0 AS right_eye_z, {r6('x', 'jaw_open')}, {r6('x', 'look_x')}, {r6('x', 'u')},
 CAST(CASE vec_id % 3 WHEN 0 THEN 1714972089 WHEN 1 THEN 1700000000 + vec_id END AS DOUBLE) AS timestamp_epoch, 21 AS declared_vertices, 19 AS declared_triangles, 'face_local' AS coordinate_space, CAST(NULL AS VARCHAR) AS error FROM e""")
def capture_fields(spark, sf):
    """What parsing finds in full documents: ids, padded points, both orders of matrices, blend shapes, times, counts."""
    p = json_captures.parse_captures(_full_documents(spark, sf))
    return rounded(p.select(
        F.col("path").cast("long").alias("capture_key"), "participant_id", "capture_id", F.size("points").alias("n_points"), F.size("triangles").alias("n_triangles"), F.col("left_eye.x").alias("left_eye_x"), F.col("left_eye.y").alias("left_eye_y"),
        F.col("right_eye.x").alias("right_eye_x"), F.col("right_eye.z").alias("right_eye_z"), F.col("blend_shapes")["jawOpen"].alias("jaw_open"), F.col("look_at.x").alias("look_x"), F.col("uv")[0]["u"].alias("u"), "timestamp_epoch",
        "declared_vertices", "declared_triangles", "coordinate_space", "error",
    ))


def _linear_sql(alphas: list[float], final: str, held: str = "k.r <= cut.c") -> str:
    """A ridge (or, with alpha 0, plain least squares) of four columns by normal equations; of several alphas the one with the least leave-one-out error.

    final: the SELECT over z (standardised rows), best (coefficients) and f (held-out truths and predictions).
    """
    k = range(4)
    cells = [(i, j) for i in k for j in k]
    steps = [f"m0 AS (SELECT alpha, n, my, {', '.join(f'g{min(i, j)}{max(i, j)}' + (' + alpha' if i == j else '') + f' AS m{i}{j}' for i, j in cells)}, {', '.join(f'{float(i == j)} AS e{i}{j}' for i, j in cells)}, {', '.join(f'r{i}' for i in k)} FROM gram, al)"]
    for p in k:  # Gauss and Jordan
        cell = lambda c, i, j: f"{c}{i}{j} / m{p}{p} AS {c}{i}{j}" if i == p else f"{c}{i}{j} - m{i}{p} * {c}{p}{j} / m{p}{p} AS {c}{i}{j}"  # noqa: B023, E731
        steps.append(f"m{p + 1} AS (SELECT alpha, n, my, {', '.join(cell(c, i, j) for c in 'me' for i, j in cells)}, {', '.join(f'r{i}' for i in k)} FROM m{p})")
    beta = ", ".join(f"{' + '.join(f'e{i}{j} * r{j}' for j in k)} AS b{i}" for i in k)
    fitted = " + ".join(f"z{i} * b{i}" for i in k)
    leverage = " + ".join(f"z{i} * z{j} * e{i}{j}" for i, j in cells)
    return f"""WITH tr AS (SELECT l_suppkey AS p, CAST(l_quantity AS DOUBLE) AS c0, CAST(l_discount AS DOUBLE) AS c1, CAST(l_tax AS DOUBLE) AS c2, CAST(l_linenumber AS DOUBLE) AS c3, l_extendedprice / 1000 AS y FROM lineitem),
 ids AS (SELECT DISTINCT p FROM tr), k AS (SELECT p, row_number() OVER (ORDER BY md5('42:' || CAST(p AS VARCHAR)), p) AS r FROM ids), cut AS (SELECT ceil(0.2 * count(*)) AS c FROM ids),
 s AS (SELECT tr.*, {held} AS test FROM tr JOIN k ON k.p = tr.p, cut), st AS (SELECT avg(y) AS my, {', '.join(f'avg(c{i}) AS a{i}, stddev_pop(c{i}) AS s{i}' for i in k)} FROM s WHERE NOT test),
 z AS (SELECT y, test, {', '.join(f'(c{i} - a{i}) / s{i} AS z{i}' for i in k)} FROM s, st), al AS (SELECT unnest([{', '.join(map(repr, alphas))}]) AS alpha),
 gram AS (SELECT count(*) AS n, max(my) AS my, {', '.join(f'sum(z{i} * z{j}) AS g{i}{j}' for i in k for j in k if i <= j)}, {', '.join(f'sum(z{i} * (y - my)) AS r{i}' for i in k)} FROM z, st WHERE NOT test),
 {', '.join(steps)}, b AS (SELECT *, {beta} FROM m4),
 loo AS (SELECT alpha, sum(pow((y - my - ({fitted})) / greatest(1 - 1.0 / n - ({leverage}), 1e-12), 2)) AS e FROM z, b WHERE NOT test GROUP BY alpha),
 best AS (SELECT b.* FROM b WHERE alpha = (SELECT alpha FROM loo ORDER BY e, alpha LIMIT 1)),
 f AS (SELECT y AS t, my + {fitted} AS p FROM z, best WHERE test), a AS (SELECT avg(t) AS m FROM f)
{final}"""


def _scores(name: str) -> str:
    columns = (("avg(abs(p - t))", "mae"), ("sqrt(avg(pow(p - t, 2)))", "rmse"), ("1 - sum(pow(p - t, 2)) / (count(*) * var_pop(t))", "r2"), ("covar_pop(t, p) / sqrt(var_pop(t) * var_pop(p))", "pearson_r"), ("avg(abs(t - m))", "baseline_mae"), ("sqrt(avg(pow(t - m, 2)))", "baseline_rmse"))
    return f"SELECT count(*) AS n, {', '.join(f'round({x}, 4) + 0.0 AS {c}' for x, c in columns)}, '{name}' AS model FROM f, a"


_EACH = lambda expression, over, c: " UNION ALL ".join(f"SELECT '{n}' AS feature, {expression.format(i=i)} AS {c} FROM {over}" for i, n in enumerate(_TRAIN))
ORACLES["ols_fit"] = _linear_sql([0.0], _scores("linear"))
ORACLES["ridge_loo"] = _linear_sql(list(models.ALPHAS), _scores("ridge"))
ORACLES["model_importance"] = _linear_sql(list(models.ALPHAS), _EACH("round(abs(b{i}), 6) + 0.0", "best", "importance"), held="false")
ORACLES["shap_linear"] = _linear_sql(list(models.ALPHAS), _EACH("round(avg(abs(z{i} * b{i})), 4) + 0.0", "z, best WHERE test", "mean_abs_shap"))


def _taper_sql(up: int, side: int) -> str:
    """Mean taper of the cohort with one axis taken as up and one as lateral."""
    y, x = "xyz"[up], "xyz"[side]
    inner = f"SELECT avg(CASE WHEN {y} >= q75 THEN abs({x}) END) - avg(CASE WHEN {y} <= q25 THEN abs({x}) END) AS t FROM (SELECT *, quantile_cont({y}, 0.25) OVER w AS q25, quantile_cont({y}, 0.75) OVER w AS q75 FROM pts WINDOW w AS (PARTITION BY capture_key)) GROUP BY capture_key"
    return f"SELECT {up} AS up, {side} AS side, (SELECT avg(t) FROM ({inner})) AS t"


ORACLES["axis_detection"] = f"""WITH {PTS}, {SIZE}, m AS (SELECT axis, avg(error) AS e FROM ({' UNION ALL '.join(_mirror_sql(i, c) for i, c in enumerate('xyz'))}) GROUP BY axis),
 sk AS ({' UNION ALL '.join(f"SELECT {i} AS axis, (SELECT avg(k) FROM (SELECT {_skew(c)} AS k FROM pts GROUP BY capture_key)) AS skew" for i, c in enumerate('xyz'))}),
 tp AS ({' UNION ALL '.join(_taper_sql(u, v) for u in range(3) for v in range(3) if u != v)}),
 lr AS (SELECT axis FROM m ORDER BY e, axis LIMIT 1), ant AS (SELECT axis FROM sk WHERE axis <> (SELECT axis FROM lr) ORDER BY abs(skew) DESC, axis LIMIT 1),
 f AS (SELECT (SELECT axis FROM lr) AS l, (SELECT axis FROM ant) AS a, 3 - (SELECT axis FROM lr) - (SELECT axis FROM ant) AS s),
 g AS (SELECT l, a, s, CASE WHEN tp.t > 0 THEN 1 ELSE -1 END AS ss FROM f JOIN tp ON tp.up = s AND tp.side = l)
SELECT l AS left_axis, 1 AS left_sign, s AS superior_axis, ss AS superior_sign, a AS anterior_axis, CASE WHEN (l + 1) % 3 = s THEN ss ELSE -ss END AS anterior_sign, true AS right_handed FROM g"""

_DENSE = _CURVE.replace(PTS, f"cl AS (SELECT capture_key AS c, x, y, z FROM ({PTS.removeprefix('pts AS (').removesuffix(')')})), pts AS (SELECT CAST(floor(c / {CLOUD}) AS BIGINT) AS capture_key, x, y, z FROM cl)")
_AT = lambda name, c: f"max(CASE WHEN idx = {name} THEN {c} END)"
ORACLES["midline_landmarks"] = f"""WITH {_DENSE}, o AS (SELECT capture_key, y, z, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY capture_key) AS n, first_value(z) OVER w AS z0, last_value(z) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS zn,
  lag(z, 1) OVER w AS a1, lag(z, 2) OVER w AS a2, lead(z, 1) OVER w AS b1, lead(z, 2) OVER w AS b2 FROM curve WINDOW w AS (PARTITION BY capture_key ORDER BY bin)),
 s AS (SELECT capture_key, y, idx, n, (z + coalesce(a1, z0) + coalesce(b1, zn) + coalesce(a2, z0) + coalesce(b2, zn)) / 5 AS zs FROM o WHERE n >= {midline.FEWEST}),
 e AS (SELECT *, idx >= {midline.MARGIN} AND idx < n - {midline.MARGIN} AND zs < lag(zs) OVER w AND zs < lead(zs) OVER w AS low, idx >= {midline.MARGIN} AND idx < n - {midline.MARGIN} AND zs > lag(zs) OVER w AND zs > lead(zs) OVER w AS high FROM s WINDOW w AS (PARTITION BY capture_key ORDER BY idx)),
 t AS (SELECT capture_key, arg_min(idx, (-zs, idx)) AS tip FROM e GROUP BY capture_key),
 u AS (SELECT e.capture_key, any_value(tip) AS tip, min(idx) FILTER (WHERE low AND idx > tip) AS nas, max(idx) FILTER (WHERE low AND idx < tip) AS sub FROM e JOIN t ON t.capture_key = e.capture_key GROUP BY e.capture_key),
 v AS (SELECT u.*, (SELECT max(idx) FROM e WHERE e.capture_key = u.capture_key AND high AND idx < u.sub) AS pog FROM u),
 m AS (SELECT e.capture_key, {', '.join(f"{_AT(k, c)} AS {k}_{c}" for k in ('tip', 'nas', 'sub', 'pog') for c in ('y', 'zs'))}, {_AT('0', 'y')} AS men_y FROM e JOIN v ON v.capture_key = e.capture_key GROUP BY e.capture_key),
 top AS (SELECT capture_key, max(y) AS top FROM pts GROUP BY capture_key)
SELECT top.capture_key, {r6('abs(nas_y - sub_y)', 'middle_third_height')}, {r6('abs(sub_y - men_y)', 'lower_third_height')}, {r6('abs(nas_y - men_y)', 'nasion_menton_height')}, {r6('top - nas_y', 'upper_region_height')},
 {r6('abs(nas_y - sub_y) / nullif(abs(sub_y - men_y), 0)', 'third_ratio_middle_lower')}, {r6('tip_zs - sub_zs', 'nose_projection')}, {r6('abs(tip_y - sub_y)', 'nose_height')}, {r6('pog_zs - sub_zs', 'chin_projection')},
 {r6('abs(pog_y - men_y)', 'chin_height')}, {r6('tip_zs - nas_zs', 'nasion_depth')} FROM top LEFT JOIN m ON m.capture_key = top.capture_key"""

_COORDINATES = 64


@query(f"SELECT CAST(i AS INTEGER) AS coordinate, {r6('median(CAST(embedding[i + 1] AS DOUBLE))', 'median')} FROM embeddings, range({_COORDINATES}) r(i) GROUP BY i UNION ALL SELECT {_COORDINATES} + k, {r6('median(v)', 'median')} FROM (SELECT 0 AS k, CAST(vec_id AS DOUBLE) AS v FROM embeddings UNION ALL SELECT 1, CAST(label AS DOUBLE) FROM embeddings) GROUP BY k")
def column_medians(spark, sf):
    """Exact medians of 66 columns over all rows."""
    e = tables.table(spark, sf, "embeddings")
    wide = e.select(*(F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(_COORDINATES)), F.col("vec_id").alias(f"c{_COORDINATES}"), F.col("label").alias(f"c{_COORDINATES + 1}"))
    found = ranks.quantiles(wide, wide.columns)
    return rounded(spark.createDataFrame([(int(c[1:]), v) for c, v in found.items()], "coordinate int, median double"))


@query("SELECT quantile_cont(l_extendedprice, 0.9) AS price, quantile_cont(l_quantity, 0.9) AS quantity, quantile_cont(l_discount, 0.9) AS discount FROM lineitem")
def exact_quantiles(spark, sf):
    found = ranks.quantiles(tables.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"], 0.9)
    return spark.createDataFrame([tuple(found.values())], "price double, quantity double, discount double")


@query(f"""WITH {RAT}, cells AS (SELECT participant_id % 40 AS p, rater_id AS r, avg(rating) AS v FROM rat GROUP BY ALL), n AS (SELECT r, row_number() OVER (ORDER BY count(*) DESC, r DESC) - 1 AS k FROM cells GROUP BY r),
 runs AS (SELECT p, count(*) FILTER (WHERE i = k) AS run FROM (SELECT c.p, n.k, row_number() OVER (PARTITION BY c.p ORDER BY n.k) - 1 AS i FROM cells c JOIN n ON n.r = c.r) GROUP BY p),
 m AS (SELECT run AS m FROM runs ORDER BY run DESC LIMIT 1 OFFSET 1)
SELECT c.p AS participant_id, c.r AS rater_id, {r6('c.v', 'v')} FROM cells c JOIN n ON n.r = c.r JOIN runs ON runs.p = c.p, m WHERE m.m >= 2 AND n.k < m.m AND runs.run >= m.m""")
def rating_block(spark, sf):
    """The complete block of forty groups of parts rated by many suppliers, most of them with gaps."""
    r = tables.ratings(spark, sf).withColumn("participant_id", F.col("participant_id") % 40)
    return rounded(ratings.complete_block(r)[0])


@query()
def shap_linear(spark, sf):
    """Mean absolute Shapley values of a ridge over its held-out rows, in closed form."""
    t = splits.participant_split(_training(spark, sf))
    fitted = models.fit(t.where("side = 'train'"), _TRAIN, "ridge")
    return rounded(shap.shap_importance(shap.shap_values(fitted, t.where("side = 'test'"), "", ["l_orderkey", "l_linenumber"])), 4)


@query()
def shap_importance(spark, sf):
    """Mean absolute Shapley values of a forest of 5 trees over its held-out rows."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    t = splits.participant_split(_training(spark, sf))
    fitted = models.fit(t.where("side = 'train'"), _TRAIN, "random_forest", trees=5)
    values = shap.shap_values(fitted, t.where("side = 'test'"), f"{folder.rstrip('/')}/meshquill/shap-{uuid.uuid4().hex}", ["l_orderkey", "l_linenumber"])
    return rounded(shap.shap_importance(values), 4)
