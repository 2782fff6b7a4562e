"""Comparing the rows of large groups without all their pairs: hubs with their partners, and blocks with blocks.

Both deal rows to tasks so that a group of any size is cut into parts of bounded size, sorted, and read as a
stream that holds one hub, or one pair of blocks, at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and partners that a hub's row is sent along with.
BLOCK = 512


def _compare_hubs(batches: Iterator[pa.RecordBatch], test: Callable[[bytes, bytes], bool]) -> Iterator[pa.RecordBatch]:
    """Pairs (hub, partner) that pass the test; rows are sorted by (a, part, member), so a hub's own row comes first."""
    hub, payload = None, None
    for batch in batches:
        a, b = [], []
        for key, part, member, rep, data in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "member", "rep", "data")), strict=True):
            if not member:
                hub, payload = (key, part), data
            elif hub == (key, part) and test(payload, data):
                a.append(key)
                b.append(rep)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def compare_hubs(pairs: DataFrame, payloads: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """Those of the pairs (a, b) whose payloads (rep, data: binary) pass the test.

    A hub's payload is sent once for each part of at most about BLOCK partners, not with every pair.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__parts"))
    dealt = pairs.join(parts.withColumnRenamed("a", "__a"), F.col("a") == F.col("__a"))
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.col("__parts")).cast("int").alias("part"))
    hubs = dealt.select("a", "part").distinct().join(payloads, F.col("a") == F.col("rep")).select("a", "part", F.lit(False).alias("member"), "rep", "data")
    partners = dealt.join(payloads, F.col("b") == F.col("rep")).select("a", "part", F.lit(True).alias("member"), "rep", "data")
    stream = hubs.unionAll(partners).repartition("a", "part").sortWithinPartitions("a", "part", "member")
    return stream.mapInArrow(lambda it: _compare_hubs(it, test), "a long, b long")


def deal_blocks(rows: DataFrame) -> DataFrame:
    """Deal the rows (band, rep, component, signature, shingles) of unresolved buckets to pairs of blocks of at most BLOCK rows.

    Rows of the bucket's largest component fill blocks of their own, which meet every block of the
    others; blocks of the others meet each other and themselves.
    """
    sizes = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    most = most.select("band", F.col("top.component").alias("top"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("inner"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("outer"))
    placed = rows.join(most, "band")
    spread = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    is_top = F.col("component") == F.col("top")
    mine = F.when(is_top, F.pmod(spread, F.col("inner"))).otherwise(F.col("inner") + F.pmod(spread, F.col("outer"))).cast("int")
    placed = placed.withColumn("mine", mine)
    others = F.sequence(F.col("inner"), F.col("inner") + F.col("outer") - 1)
    tops = F.sequence(F.lit(0), F.col("inner") - 1)
    partner = F.when(is_top, others).otherwise(F.concat(tops, others))
    return placed.withColumn("other", F.explode(partner)).select(
        "band", "rep", "component", "signature", "shingles",
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("mine") == F.col("other")).alias("same"),
    )


def compare_blocks(rows: DataFrame, compare: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """Pairs (a, b) of components that `compare` finds in the pairs of blocks of rows."""
    dealt = deal_blocks(rows).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(lambda it: _compare_blocks(it, compare), "a long, b long")


def _compare_blocks(batches: Iterator[pa.RecordBatch], compare: Callable[[pa.Table], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """All pairs of blocks of a partition, whose rows arrive sorted by (band, i, j); a pair of blocks is held at a time."""
    pair = lambda found: pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        keys = np.stack([table.column(c).to_numpy() for c in ("band", "i", "j")])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        found = [f for low, high in zip(starts, starts[1:]) for f in compare(table.slice(low, high - low))]  # noqa: B905
        held = table.slice(starts[-1])  # the next batch may go on with it
        yield pair(found)
    if held is not None:
        yield pair(compare(held))


def sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two blocks of a pair, and whether they are one."""
    side, inside = rows.column("side").to_numpy(), rows.column("same")[0].as_py()
    first = np.flatnonzero(side == 0)
    return first, first if inside else np.flatnonzero(side == 1), inside


class Joined:
    """Components joined so far within a block, so that no further link between the same two is looked for."""

    def __init__(self):
        self.label: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def find(self, c: int) -> int:
        while (up := self.label.get(c, c)) != c:
            c = up
        return c

    def apart(self, x: int, y: int) -> bool:
        return self.find(x) != self.find(y)

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        self.label[max(a, b)] = min(a, b)
        self.found.append((x, y))


def labels_after(component: DataFrame, merged: DataFrame) -> DataFrame:
    """node, label of all nodes with a link: `component` after `merged` has joined its components."""
    own = [df.select(F.col(c).alias("node"), F.col(c).alias("label")) for df, c in ((component, "component"), (merged, "node"), (merged, "component"))]
    first = component.select("node", F.col("component").alias("label"))
    # A node that leads elsewhere has one entry besides its own, the smaller one.
    first = first.unionAll(own[0]).unionAll(own[1]).unionAll(own[2]).groupBy("node").agg(F.min("label").alias("label"))
    onward = merged.select(F.col("node").alias("__node"), F.col("component").alias("__to"))
    return first.join(onward, first["label"] == onward["__node"], "left").select("node", F.coalesce("__to", "label").alias("label"))
