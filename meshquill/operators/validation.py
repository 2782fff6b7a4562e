"""Data quality of captures: issue rows for each capture and for the cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DIAGONAL, MAX_DIAGONAL = 0.05, 0.40
MESSAGES = 5


def with_defaults(captures: DataFrame) -> DataFrame:
    """Optional columns that a capture table lacks, as NULL."""
    kinds = {
        "capture_id": "string", "error": "string", "declared_vertices": "int", "declared_triangles": "int", "path": "string",
        "left_eye": "struct<x:double,y:double,z:double>", "right_eye": "struct<x:double,y:double,z:double>",
        "blend_shapes": "map<string,double>", "transform": "array<double>", "assumptions": "array<string>",
    }
    return captures.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in captures.columns})


def _count(where) -> Column:
    return F.size(F.filter("points", where))


def capture_issues(captures: DataFrame, bounds: tuple[float, float] = (MIN_DIAGONAL, MAX_DIAGONAL)) -> DataFrame:
    """(capture_key, severity, code, message): all rules as expressions on the nested row, then one explode."""
    c = with_defaults(captures)
    inf = float("inf")
    bad = lambda f: F.aggregate("points", F.lit(0), lambda acc, p: acc + sum((f(p[a]).cast("int") for a in "xyz"), F.lit(0)))
    nan_coords, inf_coords = bad(F.isnan), bad(lambda x: F.abs(x) == inf)
    extent = lambda a: F.array_max(F.transform("points", lambda p: p[a])) - F.array_min(F.transform("points", lambda p: p[a]))
    diagonal = F.sqrt(extent("x") * extent("x") + extent("y") * extent("y") + extent("z") * extent("z"))
    c = c.withColumns({
        "nv": F.coalesce(F.size("points"), F.lit(0)), "nt": F.coalesce(F.size("triangles"), F.lit(0)), "nan": F.coalesce(nan_coords, F.lit(0)), "inf": F.coalesce(inf_coords, F.lit(0)),
        "diagonal": diagonal,
        "degenerate": F.size(F.filter("triangles", lambda t: (t["i"] == t["j"]) | (t["j"] == t["k"]) | (t["i"] == t["k"]))),
        "referenced": F.size(F.array_distinct(F.flatten(F.transform("triangles", lambda t: F.array(t["i"], t["j"], t["k"]))))),
        "positions": F.size(F.array_distinct("points")),
    })
    loaded, finite = F.col("error").isNull(), (F.col("nan") + F.col("inf")) == 0
    absent = lambda x: F.coalesce(F.trim(F.col(x).cast("string")).isin("", "None", "null"), F.lit(True))
    say = F.format_string
    rules = [
        (~loaded, "ERROR", "load_failed", F.col("error")),
        (loaded & (F.col("nan") > 0), "ERROR", "nan_vertices", say("%d NaN coordinates", "nan")),
        (loaded & (F.col("inf") > 0), "ERROR", "inf_vertices", say("%d infinite coordinates", "inf")),
        (loaded & (F.col("nv") == 0), "ERROR", "no_vertices", F.lit("no vertices")),
        (loaded & (F.col("nt") == 0), "ERROR", "no_topology", F.lit("no triangles")),
        (loaded & absent("participant_id"), "ERROR", "missing_participant_id", F.lit("no participant id")),
        (loaded & absent("capture_id"), "WARNING", "missing_capture_id", F.lit("no capture id")),
        (loaded & (F.col("declared_vertices") != F.col("nv")), "ERROR", "vertex_count_mismatch", say("declared %d, found %d", "declared_vertices", "nv")),
        (loaded & (F.col("declared_triangles") != F.col("nt")), "ERROR", "triangle_count_mismatch", say("declared %d, found %d", "declared_triangles", "nt")),
        (loaded & (F.col("degenerate") > 0), "WARNING", "degenerate_triangles", say("%d triangles repeat a vertex", "degenerate")),
        (loaded & (F.col("nt") > 0) & (F.col("nv") > F.col("referenced")), "WARNING", "unreferenced_vertices", F.format_string("%d vertices in no triangle", F.col("nv") - F.col("referenced"))),
        (loaded & finite & (F.col("nv") > 0) & (F.col("diagonal") == 0), "ERROR", "collapsed_mesh", F.lit("all vertices coincide")),
        (loaded & finite & (F.col("diagonal") > 0) & ~F.col("diagonal").between(*bounds), "WARNING", "implausible_scale", F.format_string("diagonal %.3f", "diagonal")),
        (loaded & (F.col("nv") > F.col("positions")), "INFO", "duplicate_vertex_positions", F.format_string("%d repeated positions", F.col("nv") - F.col("positions"))),
        (loaded & (F.col("left_eye").isNull() | F.col("right_eye").isNull()), "WARNING", "no_eye_transforms", F.lit("no eye transforms")),
        (loaded & (F.coalesce(F.size("blend_shapes"), F.lit(0)) <= 0), "INFO", "no_blend_shapes", F.lit("no blend shapes")),
        (loaded & F.col("transform").isNull(), "INFO", "no_transform", F.lit("no anchor transform")),
    ]
    fixed = F.array(*[F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"), text.cast("string").alias("message"))) for cond, s, code, text in rules])
    noted = F.transform(F.coalesce("assumptions", F.array().cast("array<string>")), lambda a: F.struct(F.lit("INFO").alias("severity"), F.lit("assumption").alias("code"), a.alias("message")))
    return c.select("capture_key", F.explode(F.concat(F.array_compact(fixed), noted)).alias("issue")).select("capture_key", "issue.*")


def geometry_hash() -> Column:
    """Equal geometry, equal hash: a digest of the shortest exact decimal forms, 16 hex digits of it."""
    return F.substring(F.sha2(F.concat_ws(";", F.transform("points", lambda p: F.concat_ws(",", *(p[a].cast("string") for a in "xyz")))), 256), 1, 16)


def counts(captures: DataFrame) -> DataFrame:
    """Keys with vertex and triangle counts and the geometry hash; what the cohort rules need."""
    c = with_defaults(captures)
    keep = ("capture_key", "participant_id", "capture_id", "path")
    return c.where("error IS NULL").select(*keep, F.size("points").alias("nv"), F.size("triangles").alias("nt"), geometry_hash().alias("geometry_hash"))


def topology_mode(captures: DataFrame) -> DataFrame:
    """One row: the most frequent vertex and triangle counts, on ties that of the first capture in path (or key) order."""
    c = counts(captures).withColumn("at", F.coalesce("path", F.format_string("%020d", F.col("capture_key").cast("long")), F.col("capture_key").cast("string")))

    def most(column: str) -> DataFrame:
        by = c.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
        return by.agg(F.min_by(column, F.struct(-F.col("n"), "first")).alias(f"mode_{column}"), F.count(F.lit(1)).alias(f"distinct_{column}"))

    return most("nv").crossJoin(most("nt"))


def cohort_issues(captures: DataFrame) -> DataFrame:
    """Captures whose topology differs from the cohort's, and captures with the same geometry."""
    c, m = counts(captures), F.broadcast(topology_mode(captures))
    odd = c.crossJoin(m)
    vertex = odd.where("nv <> mode_nv").select("capture_key", F.lit("ERROR").alias("severity"), F.lit("topology_mismatch").alias("code"), F.format_string("%d vertices, cohort has %d", "nv", "mode_nv").alias("message"))
    triangle = odd.where("nt <> mode_nt").select("capture_key", F.lit("WARNING").alias("severity"), F.lit("topology_mismatch_triangles").alias("code"), F.format_string("%d triangles, cohort has %d", "nt", "mode_nt").alias("message"))
    groups = c.groupBy("geometry_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twins = c.join(groups, "geometry_hash").select("capture_key", F.lit("ERROR").alias("severity"), F.lit("duplicate_geometry").alias("code"), F.format_string("%d captures share this geometry", "n").alias("message"))
    return vertex.unionByName(triangle).unionByName(twins)


def cohort_notes(captures: DataFrame) -> DataFrame:
    """(note, detail, n) on the cohort as a whole: each count of vertices or triangles where there are several, and each group with one geometry.

    A group is known by its hash and its first member; members are counted, not listed, so a group of any size is one row.
    """
    c = counts(captures)
    out = None
    for column, note in (("nv", "vertex counts differ"), ("nt", "triangle counts differ")):
        by = c.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        several = by.agg(F.count(F.lit(1)).alias("__kinds")).where("__kinds > 1")
        rows = by.join(F.broadcast(several)).select(F.lit(note).alias("note"), F.col(column).cast("string").alias("detail"), "n")  # one row decides on all
        out = rows if out is None else out.unionByName(rows)
    groups = c.groupBy("geometry_hash").agg(F.count(F.lit(1)).alias("n"), F.min("capture_key").alias("first")).where("n > 1")
    return out.unionByName(groups.select(F.lit("captures share one geometry").alias("note"), F.concat_ws(" ", F.col("geometry_hash"), F.lit("first:"), F.col("first").cast("string")).alias("detail"), "n"))


def exit_code(statuses: DataFrame) -> int:
    """1 if any capture fails, as the validate command returns it."""
    return int(statuses.where("status = 'FAIL'").limit(1).count())


def issues(captures: DataFrame, **options) -> DataFrame:
    return capture_issues(captures, **options).unionByName(cohort_issues(captures))


def status(captures: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """PASS, WARN or FAIL for each capture."""
    found = issues(captures) if found is None else found
    worst = found.groupBy("capture_key").agg(F.max(F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARNING", 1).otherwise(0)).alias("worst"), F.count(F.lit(1)).alias("n_issues"))
    joined = captures.select("capture_key", "participant_id").join(worst, "capture_key", "left")
    name = F.when(F.col("worst") == 2, "FAIL").when(F.col("worst") == 1, "WARN").otherwise("PASS")
    return joined.select("capture_key", "participant_id", name.alias("status"), F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"))


def usable(captures: DataFrame, found: DataFrame | None = None) -> DataFrame:
    return captures.join(status(captures, found).where("status = 'FAIL'").select("capture_key"), "capture_key", "left_anti")


def participants(statuses: DataFrame) -> DataFrame:
    """Captures by status for each participant; dead: none is usable."""
    n = lambda s: F.count_if(F.col("status") == s)
    return statuses.groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("n_captures"), n("PASS").alias("n_pass"), n("WARN").alias("n_warn"), n("FAIL").alias("n_fail"), F.bool_and(F.col("status") == "FAIL").alias("dead")
    )


def repeated_participants(statuses: DataFrame) -> DataFrame:
    """(participant_id, n_captures) of those with more than one capture: splits must keep them together."""
    return statuses.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n_captures")).where("n_captures > 1")


def summary(statuses: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return statuses.agg(F.count(F.lit(1)).alias("n_captures"), n("PASS").alias("n_pass"), n("WARN").alias("n_warn"), n("FAIL").alias("n_fail"), F.countDistinct("participant_id").alias("n_participants"))


def render(found: DataFrame, statuses: DataFrame) -> str:
    """A text report of bounded length: counts, and the most frequent codes."""
    s = summary(statuses).first()
    codes = found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("example")).orderBy(F.desc("n"), "code").limit(40).collect()
    head = f"{s['n_captures']} captures of {s['n_participants']} participants: {s['n_pass']} pass, {s['n_warn']} warn, {s['n_fail']} fail"
    return "\n".join([head, *(f"  {r['severity']:<8}{r['code']:<30}{r['n']:>8}  e.g. {r['example']}" for r in codes)])


def duplicate_flags(df: DataFrame, *keys: str) -> DataFrame:
    """Adds duplicated: the row's key occurs more than once.

    Keys are counted map-side on digests of texts, and only the repeated ones are joined back; the rows of
    a large group are a skewed streamed side, which AQE splits across tasks.
    """
    kind = dict(df.dtypes)
    sides = {f"__key{i}": F.sha2(F.col(k).cast("binary"), 256) if kind[k] in ("string", "binary") else F.col(k) for i, k in enumerate(keys)}
    marked = df.withColumns(sides)
    repeated = marked.groupBy(*(F.col(k).alias(f"{k}r") for k in sides)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    same = [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in sides]
    return marked.join(repeated, same, "left").select(*df.columns, F.col("__n").isNotNull().alias("duplicated"))


def orphan_vertices(captures: DataFrame) -> DataFrame:
    """(capture_key, vid) of vertices that no triangle refers to; arrays of the row are compared, nothing is shuffled."""
    used = F.flatten(F.transform("triangles", lambda t: F.array(t["i"], t["j"], t["k"])))
    every = F.when(F.size("points") > 0, F.sequence(F.lit(0), F.size("points") - 1)).otherwise(F.array().cast("array<int>"))
    return captures.select("capture_key", F.explode(F.array_except(every, F.coalesce(used.cast("array<int>"), F.array().cast("array<int>")))).alias("vid"))
