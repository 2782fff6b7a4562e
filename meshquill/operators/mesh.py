"""Per-capture measures as aggregates and row expressions.

Captures are rows (capture_key, points array<struct<x,y,z>>, triangles array<struct<i,j,k>>).
Aggregates explode the points and group by capture_key; expressions that need both points and
triangles of a capture work on the nested arrays and never shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.tables import vertices

BANDS = 9


def extents(captures: DataFrame) -> DataFrame:
    """Counts, bounding box, centroid, centroid size and extent ratios."""
    a = vertices(captures).groupBy("capture_key").agg(
        F.count(F.lit(1)).alias("n_vertices"),
        *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("var", F.var_pop))),
    )
    w, h, d = (F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz")
    return a.select(
        "capture_key", "n_vertices", w.alias("width"), h.alias("height"), d.alias("depth"),
        F.sqrt(w * w + h * h + d * d).alias("bbox_diagonal"),
        F.col("mean_x").alias("centroid_x"), F.col("mean_y").alias("centroid_y"), F.col("mean_z").alias("centroid_z"),
        F.sqrt(F.col("var_x") + F.col("var_y") + F.col("var_z")).alias("centroid_size"),
        ratio(w, h).alias("width_height_ratio"), ratio(d, h).alias("depth_height_ratio"), ratio(d, w).alias("depth_width_ratio"),
    )


def _cross_norm(p: Column, q: Column, r: Column) -> Column:
    """Length of (q - p) x (r - p)."""
    ux, uy, uz = q["x"] - p["x"], q["y"] - p["y"], q["z"] - p["z"]
    vx, vy, vz = r["x"] - p["x"], r["y"] - p["y"], r["z"] - p["z"]
    return F.sqrt(F.pow(uy * vz - uz * vy, 2) + F.pow(uz * vx - ux * vz, 2) + F.pow(ux * vy - uy * vx, 2))


def area() -> Column:
    """Half the sum of the cross products' lengths; triangles reach into their own row's points."""
    at = lambda i: F.get("points", i)
    return F.aggregate("triangles", F.lit(0.0), lambda acc, t: acc + 0.5 * _cross_norm(at(t["i"]), at(t["j"]), at(t["k"])))


def surface_area(captures: DataFrame) -> DataFrame:
    return captures.select("capture_key", F.size("triangles").cast("long").alias("n_triangles"), area().alias("surface_area"))


def shape_pca(captures: DataFrame) -> DataFrame:
    """Eigenvalues of the sample covariance, largest first, in closed form, and two ratios."""
    a = vertices(captures).groupBy("capture_key").agg(
        F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.var_samp("z").alias("zz"),
        F.covar_samp("x", "y").alias("xy"), F.covar_samp("x", "z").alias("xz"), F.covar_samp("y", "z").alias("yz"),
    )
    q = "(xx + yy + zz) / 3"
    a = a.withColumn("q", F.expr(q)).withColumn("p", F.expr("sqrt((power(xx - q, 2) + power(yy - q, 2) + power(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)"))
    det = "((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz))"
    a = a.withColumn("phi", F.expr(f"CASE WHEN p = 0 THEN 0.0D ELSE acos(greatest(-1.0D, least(1.0D, {det} / (2 * power(p, 3))))) / 3 END"))
    a = a.withColumn("l1", F.expr("q + 2 * p * cos(phi)")).withColumn("l3", F.expr(f"q + 2 * p * cos(phi + {2 * math.pi / 3!r}D)"))
    a = a.withColumn("l2", F.expr("3 * q - l1 - l3"))
    return a.select("capture_key", "l1", "l2", "l3", ratio("l2", "l1").alias("elongation"), ratio("l3", "l1").alias("flatness"))


def bands(captures: DataFrame, n: int = BANDS) -> DataFrame:
    """Width (extent of x) and depth (largest z) in n equal slabs of y; the last slab is closed, empty ones are NULL.

    A point's slab is found by comparing with the edges themselves, not by dividing, so that no point
    on an edge changes sides by rounding. Points stay nested: each row is cut into its slabs without a shuffle.
    """
    side = lambda points, a, f: f(F.transform(points, lambda p: p[a]))
    rows = captures.select("capture_key", "points", side("points", "y", F.array_min).alias("lo"), side("points", "y", F.array_max).alias("hi"))
    rows = rows.select("capture_key", "points", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("band"))
    edge = lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / n
    inside = lambda p: ((F.col("band") == 0) | (p["y"] >= edge(F.col("band")))) & ((F.col("band") == n - 1) | (p["y"] < edge(F.col("band") + 1)))
    cut = rows.select("capture_key", "band", F.filter("points", inside).alias("points"))
    return cut.select("capture_key", "band", (side("points", "x", F.array_max) - side("points", "x", F.array_min)).alias("width"), side("points", "z", F.array_max).alias("depth"))


def profile_summary(captures: DataFrame) -> DataFrame:
    """Ratios between bands, and the largest width and depth with their relative heights (first on ties)."""
    b = bands(captures)
    top = lambda c: F.min_by("band", F.when(F.col(c).isNotNull(), F.struct(-F.col(c), "band")))
    at = lambda i: F.max(F.when(F.col("band") == i, F.col("width")))
    a = b.groupBy("capture_key").agg(
        at(1).alias("w1"), at(4).alias("w4"), at(6).alias("w6"), F.max("width").alias("width_max"), F.max("depth").alias("depth_max"),
        top("width").alias("wb"), top("depth").alias("db"),
    )
    return a.select(
        "capture_key", ratio("w1", "w6").alias("lower_upper"), ratio("w4", "w6").alias("mid_upper"), "width_max",
        (F.col("wb") / (BANDS - 1)).alias("width_at"), "depth_max", (F.col("db") / (BANDS - 1)).alias("depth_at"),
    )


class ExplodeMesh:
    """Table function: the corners of a capture's triangles, one row for each (triangle, corner, vid, x, y, z)."""

    def eval(self, points: list, triangles: list):
        for number, t in enumerate(triangles or ()):
            for corner, vid in enumerate((t["i"], t["j"], t["k"])):
                p = points[vid] if points and 0 <= vid < len(points) else None
                yield number, corner, vid, p and p["x"], p and p["y"], p and p["z"]


def register_functions(spark: SparkSession) -> None:
    """Makes explode_mesh(points, triangles) known to SQL, for lateral joins: FROM captures, LATERAL explode_mesh(points, triangles)."""
    spark.udtf.register("explode_mesh", F.udtf(ExplodeMesh, returnType="triangle int, corner int, vid int, x double, y double, z double"))
