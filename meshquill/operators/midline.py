"""The midline curve of a capture and the landmarks along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import vertices

BAND, BINS, WINDOW, MARGIN, FEWEST = 0.04, 60, 5, 2, 10


def curve(captures: DataFrame, band: float = BAND, bins: int = BINS) -> DataFrame:
    """(capture_key, bin, y, z): the largest z in each half-open bin of y along the strip around x = 0.

    The strip is widened three times where it holds fewer than bins / 2 points. The top point of the
    strip belongs to no bin.
    """
    all_of = Window.partitionBy("capture_key")
    v = vertices(captures).withColumn("w", F.max("x").over(all_of) - F.min("x").over(all_of))
    v = v.withColumn("thin", F.sum((F.abs("x") <= band * F.col("w")).cast("int")).over(all_of))
    half = F.when(F.col("thin") < bins // 2, 3 * band).otherwise(band) * F.col("w")
    strip = v.where(F.abs("x") <= half).withColumns({"lo": F.min("y").over(all_of), "hi": F.max("y").over(all_of)})
    step = (F.col("hi") - F.col("lo")) / bins
    edge = lambda i: F.col("lo") + i * step
    guess = F.when(step > 0, F.floor((F.col("y") - F.col("lo")) / step)).otherwise(F.lit(bins))
    # The quotient may be one off at an edge; the comparison with the edges decides.
    fixed = F.when(F.col("y") < edge(F.col("guess")), F.col("guess") - 1).when(F.col("y") >= edge(F.col("guess") + 1), F.col("guess") + 1).otherwise(F.col("guess"))
    placed = strip.withColumn("guess", guess).withColumn("bin", fixed.cast("int")).where((F.col("bin") < bins) & (F.col("y") < F.col("hi")))
    return placed.groupBy("capture_key", "bin").agg(F.max("z").alias("z"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).select(
        "capture_key", "bin", (0.5 * (edge(F.col("bin")) + edge(F.col("bin") + 1))).alias("y"), "z"
    )


def smoothed(points: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds idx, n and zs: a moving average with the end values repeated beyond both ends."""
    ordered = Window.partitionBy("capture_key").orderBy("bin")
    whole = Window.partitionBy("capture_key")
    p = points.withColumns({"idx": F.row_number().over(ordered) - 1, "n": F.count(F.lit(1)).over(whole)})
    first, last = F.first("z").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("z").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    total = F.col("z")
    for k in range(1, window // 2 + 1):
        total = total + F.coalesce(F.lag("z", k).over(ordered), first) + F.coalesce(F.lead("z", k).over(ordered), last)
    return p.withColumn("zs", F.when(F.col("n") < window, F.col("z")).otherwise(total / window))


def landmarks(captures: DataFrame) -> DataFrame:
    """Nose tip, nasion, subnasale, pogonion and menton of each curve with enough points; NULL where there is none."""
    ordered = Window.partitionBy("capture_key").orderBy("idx")
    whole = Window.partitionBy("capture_key")
    s = smoothed(curve(captures)).where(F.col("n") >= FEWEST)
    prev, after = F.lag("zs").over(ordered), F.lead("zs").over(ordered)
    inside = (F.col("idx") >= MARGIN) & (F.col("idx") < F.col("n") - MARGIN)
    s = s.withColumns({"low": inside & (F.col("zs") < prev) & (F.col("zs") < after), "high": inside & (F.col("zs") > prev) & (F.col("zs") > after)})
    s = s.withColumn("tip", F.min_by("idx", F.struct(-F.col("zs"), "idx")).over(whole))
    s = s.withColumns({"nas": F.min(F.when(F.col("low") & (F.col("idx") > F.col("tip")), F.col("idx"))).over(whole), "sub": F.max(F.when(F.col("low") & (F.col("idx") < F.col("tip")), F.col("idx"))).over(whole)})
    s = s.withColumn("pog", F.max(F.when(F.col("high") & (F.col("idx") < F.col("sub")), F.col("idx"))).over(whole)).withColumn("men", F.lit(0))
    at = lambda name, c: F.max(F.when(F.col("idx") == F.col(name), F.col(c)))
    names = {"tip": "nose_tip", "nas": "nasion", "sub": "subnasale", "pog": "pogonion", "men": "menton"}
    return s.groupBy("capture_key").agg(*(at(k, c).alias(f"{v}_{'y' if c == 'y' else 'z'}") for k, v in names.items() for c in ("y", "zs")))


def midline_features(captures: DataFrame) -> DataFrame:
    """Heights and projections between the midline landmarks; NULL where a landmark is missing."""
    top = vertices(captures).groupBy("capture_key").agg(F.max("y").alias("top"))
    m = captures.select("capture_key").join(landmarks(captures), "capture_key", "left").join(top, "capture_key")
    gap = lambda a, b: F.abs(F.col(f"{a}_y") - F.col(f"{b}_y"))
    reach = lambda a, b: F.col(f"{a}_z") - F.col(f"{b}_z")
    return m.select(
        "capture_key",
        gap("nasion", "subnasale").alias("middle_third_height"),
        gap("subnasale", "menton").alias("lower_third_height"),
        gap("nasion", "menton").alias("nasion_menton_height"),
        (F.col("top") - F.col("nasion_y")).alias("upper_region_height"),
        F.try_divide(gap("nasion", "subnasale"), gap("subnasale", "menton")).alias("third_ratio_middle_lower"),
        reach("nose_tip", "subnasale").alias("nose_projection"),
        gap("nose_tip", "subnasale").alias("nose_height"),
        reach("pogonion", "subnasale").alias("chin_projection"),
        F.when(F.col("subnasale_y").isNotNull(), gap("pogonion", "menton")).alias("chin_height"),
        reach("nose_tip", "nasion").alias("nasion_depth"),
    )
