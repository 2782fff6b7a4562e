"""Streaming ingest: new capture files become rows as they arrive, issues are found batch by batch, and the feature table grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import features, landmarks, normalise
from ..operators.validation import capture_issues, geometry_hash
from ..sources.captures import parse_captures


def stream_captures(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    )
    return parse_captures(files, strict)


def stream_new_captures(spark: SparkSession, root: str, delay: str = "7 days", strict: bool = True) -> DataFrame:
    """Captures as they arrive, without those whose geometry has come within `delay` before; file_time is their files' time.

    The state holds one hash for each geometry of that time.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    )
    rows = parse_captures(files.withColumn("file_time", F.col("modificationTime")), strict, keep=("file_time",)).where("error IS NULL")
    return rows.withColumn("geometry_hash", geometry_hash()).withWatermark("file_time", delay).dropDuplicatesWithinWatermark(["geometry_hash"])


def start_features(captures: DataFrame, convention: normalise.AxisConvention, features_path: str, checkpoint: str, marks: landmarks.LandmarkSet | None = None, fit_plane: bool = True, **trigger) -> StreamingQuery:
    """The feature table of new captures in a saved convention, one folder for each batch: a batch that is run again after a restart replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        table, problems = features.build_feature_table(batch, convention, marks=marks, fit_plane=fit_plane)
        table.write.mode("overwrite").parquet(f"{features_path}/table/batch={number}")
        problems.write.mode("overwrite").parquet(f"{features_path}/problems/batch={number}")

    return captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start(captures: DataFrame, captures_path: str, issues_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Captures and their issues as Parquet, one folder for each batch: a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        path = f"{captures_path}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        again = batch.sparkSession.read.schema(batch.schema).parquet(path)
        capture_issues(again).write.mode("overwrite").parquet(f"{issues_path}/batch={number}")

    return captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
