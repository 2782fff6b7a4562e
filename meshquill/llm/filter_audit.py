"""How filters interact: what each removes at each step of every order in which they can be applied.

The orders form a trie; nodes that have applied the same filters, in whatever order, share one state:
the DataFrame of the rows that survived them. The walk is depth-first. A state is a filter on its
parent's persisted rows, is persisted while its children are visited, and its one aggregation counts,
for each part of the corpus, the survivors and the rows that each edge out of it removes. States that
were visited are not visited again, so n filters cost 2^n states and n * 2^(n-1) edges instead of n!
orders. At most n + 1 states are held at a time.

Whether a row fails a filter is decided once, in one pass over the texts, and written to the shared folder
as one narrow row for each document (part, the filters it fails as bits, its labels); a lost executor's
persisted rows are derived from there again. Counts are folded map-side, so a part with any share of the
rows reaches its reducer as one row from each task.

Defined cases: null texts are empty; an empty text has no words (it fails A, and E if a smaller doc_id
has none either); a null lang is the empty part; a null doc_id is smaller than none and has no labels, and
nothing is a copy of it; rows that repeat are counted each, and rows with equal doc_ids aren't copies of
each other by their own texts; of several labels of a doc_id the largest counts; labels without a document
count nowhere; an empty table has no part and gives no row. Further columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, scratch

MIN_WORDS = 200
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = r"[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of one text, by name; copies (E) depend on other rows and come from `flags`."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * upper > 3 * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def bits(failed: dict[str, Column]) -> Column:
    """The names whose condition holds, as bits in the order given."""
    out = F.lit(0)
    for k, condition in enumerate(failed.values()):
        out = out.bitwiseOR(F.when(condition, 1 << k).otherwise(0))
    return out


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of A to E), good and toxic (0 or 1) for each row of docs (doc_id, text, lang)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), bits(text_filters(text)).alias("own"))
    rows = materialise(rows, "audit-own")
    # The first row of each text is found by text and id together, so that no text, however common, is one join key.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("__id")).where("__id is not null").select(F.col("digest").alias("__digest"), "__id")
    marked = rows.join(first, (F.col("digest") == F.col("__digest")) & (F.col("doc_id") == F.col("__id")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("__id").isNull()
    marked = marked.select("doc_id", "part", F.col("own").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("failed"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = marked.join(known, F.col("doc_id") == F.col("__id"), "left")
    return joined.select("part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def state_counts(rows: DataFrame, names: str) -> DataFrame:
    """part, state (bits of the filters applied), survivors, and lost, good_lost, toxic_lost: arrays with what each filter removes next.

    rows: part, failed, good, toxic. All states of the trie, by the walk described above.
    """
    path = scratch(rows.sparkSession, "audit-states")
    fails = [F.col("failed").bitwiseAND(1 << k) != 0 for k in range(len(names))]
    seen: set[int] = set()

    def visit(survivors: DataFrame, state: int) -> None:
        seen.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        # Rows of a state pass all filters applied, so that these remove nothing more.
        counts = survivors.groupBy("part").agg(
            F.lit(state).alias("state"), F.count(F.lit(1)).alias("survivors"),
            F.array(*(F.count_if(f) for f in fails)).alias("lost"),
            F.array(*(F.count_if(f & (F.col("good") == 1)) for f in fails)).alias("good_lost"),
            F.array(*(F.count_if(f & (F.col("toxic") == 1)) for f in fails)).alias("toxic_lost"),
        )
        counts.write.mode("append").parquet(path)
        for k in range(len(names)):
            child = state | 1 << k
            if child not in seen:
                visit(survivors.where(~fails[k]), child)
        survivors.unpersist()

    visit(rows, 0)
    return rows.sparkSession.read.schema("part string, state int, survivors long, lost array<long>, good_lost array<long>, toxic_lost array<long>").parquet(path)


def interactions(rows: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters and step in it. rows: part, failed, good, toxic."""
    rows = materialise(rows, "audit-flags")
    counts = state_counts(rows, names)
    every = (1 << len(names)) - 1
    # The orders depend on the filters alone: names! * names rows, whatever the corpus holds.
    steps = [{"filter_order": "".join(order), "step": s + 1, "k": names.index(f), "state": sum(1 << names.index(x) for x in order[:s])} for order in permutations(names) for s, f in enumerate(order)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, k: int, state: int>>")

    parts = counts.where("state = 0").select("part", F.col("lost").alias("failing"))
    edges = parts.select("part", "failing", F.inline(steps))
    of = counts.select(F.col("part").alias("__part"), F.col("state").alias("__state"), "survivors", "lost", "good_lost", "toxic_lost")
    alone = counts.select(F.col("part").alias("__last"), F.col("state").alias("__but"), F.col("lost").alias("alone"))
    edges = edges.join(of, (F.col("part") == F.col("__part")) & (F.col("state") == F.col("__state")), "left")
    edges = edges.withColumn("but", F.expr(f"{every} - shiftleft(1, k)"))
    edges = edges.join(alone, (F.col("part") == F.col("__last")) & (F.col("but") == F.col("__but")), "left")
    at = lambda column: F.coalesce(F.get(F.col(column), F.col("k")), F.lit(0)).cast("long")
    out = edges.select(
        "part", "filter_order", "step", "k", (F.coalesce("survivors", F.lit(0)) - at("lost")).cast("long").alias("kept"), at("lost").alias("removed"),
        (at("failing") - at("lost")).alias("redundant"), at("alone").alias("unique_fails"), at("good_lost").alias("good_lost"), at("toxic_lost").alias("toxic_lost"),
    )
    shapley = out.groupBy(F.col("part").alias("__part"), F.col("k").alias("__k")).agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, (F.col("part") == F.col("__part")) & (F.col("k") == F.col("__k"))).drop("__part", "__k", "k")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Interactions of the five text filters on docs (doc_id, text, lang) with labels (doc_id, quality, toxic)."""
    return interactions(flags(docs, labels), "ABCDE")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return filter_audit(docs, labels)


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), known AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT t.part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic,
    [len(words) < 200,
     100 * len(list_distinct(words)) < 50 * len(words),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'),
     coalesce(t.doc_id > first_id, false)] AS f
  FROM texts t LEFT JOIN known k ON t.doc_id = k.doc_id
), grouped AS (
  SELECT part, f, good, toxic, count(*) AS n FROM fails GROUP BY ALL
), letters AS (
  SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS l(x)
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON a.x <> b.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(filter_order[step]) - 64 AS k,
         list_transform(string_split(filter_order[1:step - 1], ''), lambda y: ascii(y) - 64) AS earlier
  FROM orders, range(1, 6) AS r(step)
), counted AS (
  SELECT part, filter_order, step, k,
    sum(n) FILTER (WHERE NOT f[k] AND NOT before) AS kept,
    sum(n) FILTER (WHERE f[k] AND NOT before) AS removed,
    sum(n) FILTER (WHERE f[k] AND before) AS redundant,
    sum(n) FILTER (WHERE f[k] AND len(list_filter(f, lambda y: y)) = 1) AS unique_fails,
    sum(n) FILTER (WHERE f[k] AND NOT before AND good) AS good_lost,
    sum(n) FILTER (WHERE f[k] AND NOT before AND toxic) AS toxic_lost
  FROM (SELECT g.*, s.*, len(list_filter(earlier, lambda y: y > 0 AND f[y])) > 0 AS before FROM grouped g, steps s)
  GROUP BY part, filter_order, step, k
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, k), 0) AS BIGINT) AS shapley
FROM counted
"""
