"""A training corpus in five stages: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents; copies that mixing makes keep their doc_id.

Defined cases: rows are judged one by one, not by doc_id. Repeated or null doc_ids with different texts
each stay if their own text does; rows that are equal in all columns share a verdict. Exact dedup keeps
one row of each text, that of the largest doc_id (of rows without ids one, which one is not defined).
Near-dedup keeps one row of each component, that of the smallest doc_id, and rows without an id only
where no row of their component has one. Null texts are rejected by the quality rules. Mixing draws the
same count for all rows of a doc_id, null being one of them. An empty table stays empty. Further columns
of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.llm import exact_dedup, mixing, near_dedup, packing, quality
from meshquill.llm.shared import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust distance reject go."""
    docs = docs.select(*COLUMNS)
    # A digest of what the verdict depends on stands for the row: equal digests have equal verdicts.
    parts = [F.coalesce(F.to_json(F.array(c)), F.lit("")) for c in ("lang", "source")]
    digest = F.md5(F.concat_ws(",", *parts, F.when(F.col("text").isNull(), "-").otherwise("+"), F.coalesce("text", F.lit(""))))
    keyed = docs.withColumn("__row", digest)
    verdicts = quality.quality_rules(keyed.select(F.col("__row").alias("doc_id"), "lang", "source", "text"))
    return keyed.join(verdicts.where("kept").select(F.col("doc_id").alias("__row")), "__row", "left_semi").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each distinct text."""
    return exact_dedup.distinct_texts(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; rows are known by doc_id and a hash of the text."""
    kept = near_dedup.near_rows(docs, join_ids=False).where("kept").select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64("text") == kept["__raw"]), "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their Poisson count, in a global order by hash."""
    return mixing.shuffled(mixing.replicate(docs)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.packed_digest(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near-dedup", near), ("mixing", mix), ("packing", pack)]
#: The robust estimate is iterative, and tokens have no SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
