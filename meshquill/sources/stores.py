"""Tables, reports and models in folders of a store: what commands write, and what they read again.

Tables are Parquet or CSV by the name of their path; documents (reports, conventions, landmark sets, models'
descriptions) are JSON texts. All goes through Spark, so any store that it reaches will do.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a ratings file.
RATING_COLUMNS = ("participant_id", "rater_id", "rating")
TEMPLATE = [
    ",".join(RATING_COLUMNS),
    "# One line for each participant and rater; lines like this one are comments.",
    "# rating: a number on one scale for all. Nothing about the raters themselves belongs here.",
]


@dataclass(frozen=True)
class Layout:
    """The folders of a project below its root."""

    root: str

    def __getattr__(self, name: str) -> str:
        parts = {"raw": "data/raw", "processed": "data/processed", "labels": "data/labels", "config": "config", "models": "models", "outputs": "outputs"}
        if name not in parts:
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{parts[name]}"

    def ensure(self, spark: SparkSession) -> None:
        """Make all folders, in whatever file system the root names."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in ("raw", "processed", "labels", "config", "models", "outputs"):
            at = hadoop(getattr(self, name))
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def _is_csv(path: str) -> bool:
    return path.rstrip("/").endswith(".csv")


def write_table(df: DataFrame, path: str, sort: Sequence[str] = ()) -> str:
    """CSV (with a header) or Parquet; replaces what is there. Sorted tables are in one order over all their files."""
    df = df.orderBy(*sort) if sort else df
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if _is_csv(path) else writer.parquet(path)
    return path


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, what: str = "table") -> DataFrame:
    """The table, or only the named columns of it; Parquet reads no others."""
    try:
        table = spark.read.option("header", True).option("inferSchema", True).csv(path) if _is_csv(path) else spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no {what} at {path}") from e
    missing = [c for c in columns or () if c not in table.columns]
    if missing:
        raise ValueError(f"{what} at {path} lacks {missing}")
    return table.select(*columns) if columns else table


def read_features(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return read_table(spark, path, columns, "feature table")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, None, "target table")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Saved predictions, the mean rating as truth."""
    table = read_table(spark, path, None, "predictions")
    return table if "truth" in table.columns else table.withColumn("truth", F.col("mean_rating").cast("double"))


def read_demographics(spark: SparkSession, path: str, column: str) -> DataFrame:
    return read_table(spark, path, ["participant_id", column], "demographics")


def write_lines(spark: SparkSession, lines: list[str], path: str) -> str:
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def write_document(spark: SparkSession, value: dict | str, path: str) -> str:
    """A JSON document; texts are taken to be JSON already."""
    return write_lines(spark, [value if isinstance(value, str) else json.dumps(value, indent=2)], path)


def read_document(spark: SparkSession, path: str) -> dict:
    try:
        rows = spark.read.text(path, wholetext=True).where("value <> ''").limit(1).collect()
    except AnalysisException as e:
        raise FileNotFoundError(f"no document at {path}") from e
    if not rows:
        raise FileNotFoundError(f"no document at {path}")
    return json.loads(rows[0]["value"])


def ratings_template(spark: SparkSession, path: str) -> str:
    """A ratings file without ratings, to be filled in."""
    return write_lines(spark, TEMPLATE, path)
