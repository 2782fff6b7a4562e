"""Exact dedup over a persistent digest index, bucketed and sorted by digest.

DataFrame operations only. Texts are equal when identical after lower-casing A-Z; null counts as
empty. Of equal texts the row with the largest doc_id stays.

Defined cases: a null text equals an empty one; rows with a null doc_id take part in group sizes but
never stay unless the whole group has no id (then keep_id is null and kept is false); repeated rows
(same doc_id and text) each get a result row, and all rows that carry the id that stays are kept;
where whole rows are returned (`distinct_texts`), one row of each text stays, also of a text whose rows
have no id; an empty input gives an empty result and leaves the index as it was. Further columns are
ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

#: Parts in which a whole table is fed to an index.
BATCHES = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_text(text: str | Column = "text") -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(column, F.lit("")), _UPPER, _LOWER)


def digest(text: str | Column = "text") -> Column:
    return F.unhex(F.sha2(normal_text(text).cast("binary"), 256))


class DigestIndex:
    """A table (digest, keep_id, group_size, batch) in the warehouse, bucketed and sorted by digest.

    Each batch leaves one entry for each of its digests; `read` adds the batches of a digest up. The
    bucketing keeps lookups free of a shuffle on the index side: a batch is shuffled to the index's
    buckets, joined by sort-merge, and appended with the same layout.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        """buckets: as many as shuffles have partitions, unless given; an index that exists keeps its own."""
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if self.exists():
            facts = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(facts["data_type"]) if facts else self.buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def read(self) -> DataFrame:
        """One row for each digest, over all batches."""
        return self.entries().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def _append(self, rows: DataFrame) -> None:
        # One shuffle to the index's own buckets, so that each task writes one file for each of its buckets.
        writer = rows.repartition(self.buckets, "digest").write.format("parquet")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Append the batch, and return its digests that the index did not hold yet.

        A batch whose name the index has is one delivered again and adds nothing; without a name, the
        name is a fingerprint of the batch's rows. What the batch adds is written to the shared folder
        first: it must not be computed again once the index holds it.

        Copies within the batch are folded map-side first, so a group that holds a third of all rows
        reaches its reducer as one row from each task.
        """
        rows = docs.select("doc_id", digest("text").alias("digest"))
        if batch is None:
            mark = F.xxhash64("doc_id", "digest")
            batch = ":".join(str(x) for x in rows.agg(F.count(F.lit(1)), F.sum(mark.cast("decimal(38,0)")), F.bit_xor(mark)).first())
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.withColumn("batch", F.lit(batch))
        if not self.exists():
            self._append(self.spark.createDataFrame([], groups.schema))
        elif self.entries().where(F.col("batch") == batch).limit(1).count():
            return self.spark.createDataFrame([], groups.schema).drop("batch")
        groups = materialise(groups, "digests")
        held = self.entries().select("digest").hint("merge")
        fresh = materialise(groups.join(held, "digest", "left_anti"), "digests-new")
        self._append(fresh.unionByName(materialise(groups.join(held, "digest", "left_semi"), "digests-held")))
        return fresh.drop("batch")

    def annotate(self, docs: DataFrame) -> DataFrame:
        """Each row with the index entry of its digest; only ids and digests are shuffled.

        The index side has one row for each digest, so a hot digest is a skewed streamed side, which
        AQE splits across tasks.
        """
        rows = docs.select("doc_id", digest("text").alias("digest"))
        return rows.join(self.read(), "digest", "left").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def _staying(docs: DataFrame, groups: DataFrame) -> DataFrame:
    keyed = lambda df, key: df.withColumns({"__id": F.coalesce(F.col(key), F.lit(0).cast("long")), "__none": F.col(key).isNull()})
    ids = keyed(groups, "keep_id").select("__id", "__none", F.col("digest").alias("__digest"))
    marked = keyed(docs, "doc_id").withColumn("__digest", digest("text"))
    # Joined on id and digest: a text of any group size meets exactly one row. Repeated rows fold into one, by the same partitioning.
    keys = ["__id", "__none", "__digest"]
    return marked.join(ids, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Rows of the batch whose text is new to the index, one for each text; the index then holds them."""
    return _staying(docs, index.add(docs))


def feed(docs: DataFrame, index: DigestIndex, batches: int = BATCHES) -> DigestIndex:
    """All of docs into the index, in batches by a hash of the id."""
    for i in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i), f"{i} of {batches}")
    return index


def distinct_texts(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row for each text, the one with the largest id over all batches; without an index, through one that is dropped again."""
    mine = index or new_index(docs.sparkSession)
    try:
        groups = feed(docs, mine).read().select("digest", "keep_id")
        if index is None:
            groups = materialise(groups, "digests-kept")
    finally:
        if index is None:
            mine.drop()
    return _staying(docs, groups)


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = new_index(spark)
    try:
        return materialise(feed(docs, index).annotate(docs), "digests-of-rows")
    finally:
        index.drop()  # the query's index is its own; one that lasts is made by name


ORACLE_SQL = """
WITH rows_ AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), groups_ AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM rows_ GROUP BY text_sha256
)
SELECT r.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       coalesce(r.doc_id = g.keep_id, false) AS kept, r.text_sha256
FROM rows_ r JOIN groups_ g ON r.text_sha256 = g.text_sha256
"""
