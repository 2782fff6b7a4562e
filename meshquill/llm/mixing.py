"""Mixing sources to target weights by Poisson replication.

Each source has a target share; the mean repetition rate of its documents is that share of the corpus
divided by what the source has. A document's number of copies is a Poisson draw, inverted from a
uniform number that a seeded hash of the id gives: the same document gets the same count on every
cluster, and a lost executor changes nothing. Copies are then dealt out by a hash over the whole corpus.

Defined cases: a null source is a source of its own; null and empty texts weigh 0 bytes and keep the
rate of their source; rows with a null id draw as id "null"; repeated rows draw alike and each is
replicated; an empty input gives an empty result. A source without any bytes gets rate 1. Further
columns pass through; the added columns are named copy, copies, rate and shuffle_key, and an input
column of such a name is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small

SEED = 20
#: Target share of a source is in proportion to its bytes to this power: below 1, small sources are raised.
TEMPER = 0.5
#: Sources that may be broadcast with their tables of thresholds.
MAX_SOURCES = 10_000
#: Largest rate whose table starts from exp(-rate); the draw is the same inversion above it.
DIRECT = 700.0


def rates(docs: DataFrame, weights: DataFrame | None = None, temper: float = TEMPER, epochs: float = 1.0) -> DataFrame:
    """source, rate: epochs * share * all bytes / bytes of the source.

    `weights` (source, weight) fixes the shares; sources that it lacks get rate 0. Otherwise shares are
    tempered. The bytes are counted over all documents.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    if weights is None:
        shares = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(temper)))
    else:
        given = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double").alias("weight"))
        shares = sizes.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        shares = shares.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    # One row of two sums, joined to one row for each source.
    totals = shares.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * F.col("all_bytes") / F.col("bytes") * epochs
    return shares.crossJoin(F.broadcast(totals)).select(
        "source", F.when(F.col("bytes") > 0, rate).otherwise(F.lit(1.0)).alias("rate")
    )


def lowest(rate) -> F.Column:
    """The first k of a rate's table: below it lies less mass than the draw resolves; 0 up to DIRECT."""
    return F.when(rate > DIRECT, F.floor(rate - 12 * F.sqrt(rate) - 20)).otherwise(F.lit(0)).cast("long")


def cumulated(rate: float, low: int) -> np.ndarray:
    """P(X <= k) for k = low, low + 1, ... up to where the tail is below the resolution of the draw.

    The mass at k follows from that at k - 1. Up to DIRECT it starts from exp(-rate), which is positive
    there; above, masses are taken relative to that at the mode and divided by their sum. The table
    grows with the root of the rate.
    """
    last = math.ceil(rate + 12 * math.sqrt(rate) + 20)
    if rate <= DIRECT:
        mass = total = math.exp(-rate)
        cdf = [total]
        for k in range(1, last + 1):
            mass = mass * rate / k
            total += mass
            cdf.append(total)
        return np.array(cdf)
    mode = math.floor(rate)
    up = np.cumprod(rate / np.arange(mode + 1, last + 1))
    down = np.cumprod(np.arange(mode, low, -1) / rate)
    mass = np.concatenate([down[::-1], [1.0], up])
    return np.cumsum(mass) / mass.sum()


def _with_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `cumulated` to each source; one row for each, never one for each document."""
    for batch in batches:
        pairs = zip(batch.column("rate").to_pylist(), batch.column("__low").to_pylist(), strict=True)
        tables = pa.array([None if rate is None else cumulated(rate, low) for rate, low in pairs], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, tables], [*batch.schema.names, "__cdf"])


def uniform(seed: int, *parts: F.Column) -> F.Column:
    """In (0, 1), from the first 52 bits of an md5 over the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def replicate(docs: DataFrame, weights: DataFrame | None = None, temper: float = TEMPER, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """Documents times their Poisson count, with copy, copies, rate and shuffle_key; order: `shuffled`."""
    own = [c for c in docs.columns if c not in ("copy", "copies", "rate", "shuffle_key")]
    docs = docs.select(*own)
    table = rates(docs, weights, temper, epochs).select(F.col("source").alias("__source"), "rate", lowest(F.col("rate")).alias("__low"))
    kind = table.schema["__source"].dataType.simpleString()
    table = table.mapInArrow(_with_thresholds, f"__source {kind}, rate double, __low long, __cdf array<double>")
    joined = docs.join(small(table, MAX_SOURCES, F.size("__cdf")), F.col("source").eqNullSafe(F.col("__source")), "inner")
    draw = uniform(seed, F.col("doc_id"))
    counted = joined.withColumn("__u", draw).withColumn("copies", F.col("__low") + F.size(F.filter("__cdf", lambda c: c < F.col("__u"))))
    counted = counted.where("copies > 0")
    copies = counted.select(*own, "copies", "rate", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return copies.withColumn("shuffle_key", uniform(seed + 1, F.col("doc_id"), F.col("copy")))


def shuffled(copies: DataFrame) -> DataFrame:
    """Global order by the hash: partition i holds the i-th slice of the order.

    The key is uniform by construction, so equal slices are known without sampling, and the copies are
    made once, not a second time for a sample.
    """
    parts = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionById(parts, F.floor(F.col("shuffle_key") * parts).cast("int")).sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = shuffled(replicate(docs))
    return copies.select("doc_id", "source", "copy", "copies", F.round("rate", 6).alias("rate"), "shuffle_key")


ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0)) AS bytes FROM documents GROUP BY source
), totals AS (
  SELECT sum(bytes) AS all_bytes, sum(pow(CAST(bytes AS DOUBLE), {TEMPER})) AS all_weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN bytes > 0 THEN pow(CAST(bytes AS DOUBLE), {TEMPER}) / all_weight * all_bytes / bytes ELSE 1.0 END AS rate
  FROM sizes, totals
), masses AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS mass, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, mass * rate / (k + 1), cdf + mass * rate / (k + 1) FROM masses WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
), draws AS (
  SELECT doc_id, source, (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, d.source, m.rate, CAST(count(*) AS BIGINT) AS copies
  FROM draws d JOIN masses m ON d.source IS NOT DISTINCT FROM m.source AND m.cdf < d.u GROUP BY d.doc_id, d.source, m.rate
), numbers AS (
  SELECT DISTINCT CAST(k + 1 AS BIGINT) AS copy FROM masses
)
SELECT c.doc_id, c.source, n.copy, c.copies, round(c.rate, 6) AS rate,
       (CAST(CAST('0x' || substr(md5('{SEED + 1}:' || coalesce(CAST(c.doc_id AS VARCHAR), 'null') || ':' || CAST(n.copy AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS shuffle_key
FROM counted c JOIN numbers n ON n.copy <= c.copies
"""
