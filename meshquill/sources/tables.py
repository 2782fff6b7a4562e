"""Engine inputs derived from the star-schema test tables, and the plain table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_POINTS = 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each embedding: its first 63 numbers as 21 points, and a strip of 19 triangles.

    Geometry stays nested, one row for each capture, so that per-capture operators need no shuffle.
    """
    number = lambda at: f"CAST(embedding[{at}] AS DOUBLE)"
    points = f"transform(sequence(0, {N_POINTS - 1}), i -> named_struct('x', {number('3 * i')}, 'y', {number('3 * i + 1')}, 'z', {number('3 * i + 2')}))"
    triangles = f"transform(sequence(0, {N_POINTS - 3}), i -> named_struct('i', i, 'j', i + 1, 'k', i + 2))"
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("capture_key"), F.col("label").alias("participant_id"), F.expr(points).alias("points"), F.expr(triangles).alias("triangles")
    )


def vertices(captures: DataFrame, *keep: str) -> DataFrame:
    """(capture_key, ..., vid, x, y, z), one row for each point."""
    return captures.select("capture_key", *keep, F.posexplode("points").alias("vid", "p")).select("capture_key", *keep, "vid", "p.x", "p.y", "p.z")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant = part, rater = supplier, rating = quantity."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("participant_id"), F.col("l_suppkey").alias("rater_id"), F.col("l_quantity").cast("double").alias("rating")
    )


def event_ratings(spark: SparkSession, sf_dir: str, complete: bool = True) -> DataFrame:
    """participant = user, rater = event type; incomplete: one rater has not seen every fifth user."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("participant_id"), F.col("event_type").alias("rater_id"), F.col("value").cast("double").alias("rating"))
    return rows if complete else rows.where("NOT (participant_id % 5 = 0 AND rater_id = 'click')")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """truth = extended price, predicted = quantity times the mean unit price, group = return flag."""
    items = table(spark, sf_dir, "lineitem")
    unit = items.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("unit"))
    return items.crossJoin(F.broadcast(unit)).select(
        F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").cast("double").alias("truth"), (F.col("l_quantity") * F.col("unit")).alias("predicted")
    )


def supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of measures for each supplier: some nullable, one constant."""
    by = lambda cond, c: F.avg(F.when(F.expr(cond), F.col(c)))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("participant_id"))
        .agg(
            F.avg("l_quantity").alias("f_quantity"),
            F.avg("l_discount").alias("f_discount"),
            F.avg("l_extendedprice").alias("f_price"),
            by("l_returnflag = 'R' AND l_quantity >= 49", "l_tax").alias("f_rare"),
            F.max(F.lit(1.0)).alias("f_constant"),
            F.max(F.lit(None).cast("double")).alias("f_empty"),
        )
    )
