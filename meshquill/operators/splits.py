"""Splits by participant: no participant is on both sides."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMN = "participant_id"
#: Hexadecimal digits by which ids are counted to find a cut: 65,536 counts.
DIGITS = 4


class LeakageError(AssertionError):
    """A participant is on both sides of a split."""


def _order(column: str, seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")))


def _ids(table: DataFrame, column: str) -> DataFrame:
    if column not in table.columns:
        raise ValueError(f"no column {column}")
    return table.select(column).distinct()


def _enough(n: int, least: int) -> int:
    if n < least:
        raise ValueError(f"{n} participants, {least} are needed")
    return n


def participant_split(table: DataFrame, test_size: float = 0.2, seed: int = 42, column: str = COLUMN) -> DataFrame:
    """Adds side: `test` for ceil(test_size * groups) participants, the first by a seeded hash, `train` for the others.

    Ids are counted by the first digits of their hash (16^DIGITS counts at most reach the driver); only those of the
    one prefix in which the cut falls are sorted. The last id of the test side then tells every row's side, so that
    the table itself is neither joined nor shuffled, however often its sides are read. A row without an id is of `train`.
    The table is read once to find its ids, which are kept on disk meanwhile; to tell a side takes one hash of the id.
    """
    ids = _ids(table, column).withColumn("__order", _order(column, seed)).withColumn("__prefix", F.substring("__order", 1, DIGITS)).persist(StorageLevel.DISK_ONLY)
    try:
        counts = ids.groupBy("__prefix").agg(F.count(F.lit(1)).alias("n")).orderBy("__prefix").collect()
        left, edge = math.ceil(test_size * _enough(sum(row["n"] for row in counts), 2)), ""
        for row in counts:
            edge = row["__prefix"]
            if row["n"] >= left:
                break
            left -= row["n"]
        rest = ids.where(F.col("__prefix") == edge).orderBy("__order", column).limit(left)
        last = rest.agg(F.max(F.struct("__order", F.col(column).alias("id"))).alias("last")).first()["last"]
    finally:
        ids.unpersist()
    order = _order(column, seed)
    if last is not None:
        at = F.lit(last["id"]).cast(table.schema[column].dataType)
        test = F.struct(order.alias("o"), F.col(column).alias("i")) <= F.struct(F.lit(last["__order"]).alias("o"), at.alias("i"))
    else:
        test = F.substring(order, 1, DIGITS) < edge
    ordered = table.select(column, *(c for c in table.columns if c != column))
    return ordered.withColumn("side", F.when(F.col(column).isNotNull() & test, "test").otherwise("train"))


def _runs(loads: list[int], n: int, k: int) -> list[tuple[int, list[int]]]:
    """(first rank, folds in turn) by which k groups of n rows each go to the lightest fold so far; adds them to loads.

    A fold takes its j-th group at load + j * n, so folds are taken in turn, ordered by load modulo n,
    from the level load div n on; a further fold joins at each level that one starts from.
    """
    levels = sorted({load // n for load in loads})
    before, runs, rank = list(loads), [], 0
    for level, until in zip(levels, [*levels[1:], None], strict=True):
        turn = sorted((i for i, load in enumerate(before) if load // n <= level), key=lambda i: (before[i] % n, i))
        runs.append((rank, turn))
        here = k - rank if until is None else min(k - rank, (until - level) * len(turn))
        for at, i in enumerate(turn):
            loads[i] += n * (here // len(turn) + (at < here % len(turn)))
        rank += here
        if rank == k:
            break
    return runs


def participant_folds(table: DataFrame, n_splits: int = 5, column: str = COLUMN) -> DataFrame:
    """Adds fold 0..n_splits-1: the largest groups first, each to the lightest fold so far; of equal sizes the smallest id first.

    One rule at every size. The driver gets one row for each distinct size (at most the root of twice the
    rows) and works out the turns that folds take; groups are ranked among those of their size within
    ranges of (size, id), with offsets added over the ranges.
    """
    _enough(_ids(table, column).count(), n_splits)
    sizes = table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    loads, turns = [0] * n_splits, []
    for row in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect():
        runs = _runs(loads, row["n"], row["k"])
        turns.append((row["n"], [r for r, _ in runs], [t for _, t in runs]))
    turns = table.sparkSession.createDataFrame(turns, "n long, firsts array<long>, turns array<array<int>>")
    # A given number of ranges: adaptive execution leaves them as they are, so both uses see the same ones.
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sizes.repartitionByRange(parts, "n", column).withColumn("part", F.spark_partition_id())
    before = ranged.groupBy("n", "part").agg(F.count(F.lit(1)).alias("size"))  # one row for each size and range that has it
    before = before.select("n", "part", (F.sum("size").over(Window.partitionBy("n").orderBy("part")) - F.col("size")).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("n", "part").orderBy(column)) - 1
    ranked = ranged.withColumn("inside", inside).join(F.broadcast(before), ["n", "part"]).join(F.broadcast(turns), "n").withColumn("rank", F.col("offset") + F.col("inside"))
    ranked = ranked.withColumn("run", F.size(F.filter("firsts", lambda first: first <= F.col("rank"))))
    turn = F.element_at("turns", F.col("run"))
    place = (F.col("rank") - F.element_at("firsts", F.col("run"))) % F.size(turn) + 1
    return table.join(ranked.select(column, F.element_at(turn, place.cast("int")).alias("fold")), column)


def leaked(train: DataFrame, test: DataFrame, column: str = COLUMN) -> DataFrame:
    return train.select(column).intersect(test.select(column))


def assert_no_leakage(train: DataFrame, test: DataFrame, column: str = COLUMN) -> None:
    both = leaked(train, test, column).orderBy(column).limit(10).collect()
    if both:
        raise LeakageError(f"participants on both sides: {[r[0] for r in both]}")


def captures_per_group(table: DataFrame, column: str = COLUMN) -> DataFrame:
    """One row: groups, rows, and the least, median and largest group."""
    g = table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"), F.min("n").alias("min_n"), F.median("n").alias("median_n"), F.max("n").alias("max_n"))


def within_group_spread(table: DataFrame, features: list[str], column: str = COLUMN) -> DataFrame:
    return table.groupBy(column).agg(*(F.stddev_samp(f).alias(f) for f in features))




def split_report(table: DataFrame, column: str = COLUMN) -> str:
    """Captures, participants, and whether a split by rows would put one participant on both sides."""
    g = captures_per_group(table, column).first()
    several = table.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
    note = f"{several} participants have several captures: a split by rows would leak" if several else "every participant has one capture"
    return f"{g['n_rows']} captures of {g['n_groups']} participants, {g['min_n']} to {g['max_n']} each (median {g['median_n']:g})\n{note}"
