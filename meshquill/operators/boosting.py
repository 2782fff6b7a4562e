"""Gradient boosting of regression trees with second-order gains and an L2 term.

Features are binned once, and rows that are alike in all bins, a cell, come together. All rows of a cell have one
prediction, so what a tree needs to know of them is the weight that it draws there and the sum of weighted labels.
One pass over the rows draws for a span of trees; their levels are then found from cells alone, as many as there
are, without the rows. For each level of a tree one Spark job adds up gradients and curvatures by node, feature
and bin, inside its tasks first; the driver sees these sums (at most nodes x features x bins of them for each
task, or of them all where tasks are many), picks the splits, and sends the small tree back. Where cells are
nearly as many as rows, spans are short, so that cells take little more room than rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, DEPTH, RATE, L2, ROWS, COLUMNS = 64, 3, 0.03, 2.0, 0.8, 0.8
#: Most trees drawn for in one pass; least where cells are many; trees after which cells' predictions are brought up to date.
SPAN, SHORT, STEP = 100, 8, 10
#: Cells of a task; tasks whose sums the driver adds up itself; cells times trees that a span may have in any case.
CELLS, FEW, SMALL = 8192, 8, 1 << 20
#: Curvature that a child must have: the weight of one row.
LEAST = 1.0


@dataclass
class Boosted:
    """base plus the leaves' values of all trees. Of a tree's nodes, 2 i + 1 is left of i (x <= threshold) and 2 i + 2 right."""

    features: list[str]
    base: float
    trees: list[dict[int, dict]]

    def transform(self, df: DataFrame) -> DataFrame:
        names, base, trees = self.features, self.base, self.trees

        @F.pandas_udf("double")
        def predicted(x: pd.DataFrame) -> pd.Series:
            values = np.asfortranarray(x[names].to_numpy(float))
            return pd.Series(base + sum((leaf_values(t, lambda i, n: values[:, n["feature"]] <= n["threshold"], len(values)) for t in trees), np.zeros(len(values))))

        return df.withColumn("predicted", predicted(F.struct(*(F.col(f).cast("double").alias(f) for f in names))))

    def gains(self) -> np.ndarray:
        out = np.zeros(len(self.features))
        for tree in self.trees:
            for node in tree.values():
                if "feature" in node:
                    out[node["feature"]] += node["gain"]
        return out / max(out.sum(), 1e-300)


def place(tree: dict[int, dict], goes_left, n: int) -> np.ndarray:
    """The node without children that each row ends in."""
    at = np.zeros(n, np.int64)
    for i in sorted(tree):
        if "feature" in tree[i]:
            here = at == i
            if here.any():
                at[here] = np.where(goes_left(i, tree[i])[here], 2 * i + 1, 2 * i + 2)
    return at


def leaf_values(tree: dict[int, dict], goes_left, n: int, i: int = 0) -> np.ndarray:
    """The value of the node without children that each row ends in, from the leaves up."""
    if "feature" not in tree[i]:
        return np.full(n, tree[i]["value"]) if i == 0 else tree[i]["value"]
    return np.where(goes_left(i, tree[i]), leaf_values(tree, goes_left, n, 2 * i + 1), leaf_values(tree, goes_left, n, 2 * i + 2))


def _mixed(key: np.ndarray, seed: int) -> np.ndarray:
    """Uniform in [0, 1) by row key and seed."""
    x = key.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def cut_points(train: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of each feature's bins but the last: its values if there are few, else quantiles of them."""
    shares = [i / bins for i in range(1, bins + 1)]
    row = train.agg(*(F.percentile_approx(f, shares, 100 * bins).alias(f"q{i}") for i, f in enumerate(features))).first()
    return [np.unique(np.array(row[f"q{i}"] or [0.0], float))[:-1] for i in range(len(features))]


def best_split(g: np.ndarray, h: np.ndarray, used: np.ndarray, l2: float, least: float) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the split with the greatest gain, the first on ties; g and h by (feature, bin)."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    total_g, total_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
    gain = np.where((left_h >= least) & (right_h >= least) & used[:, None], gain, -np.inf)
    if not gain.size or not gain.max() > 1e-9:
        return None
    feature, at = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[feature, at]), int(feature), int(at)


def code_bytes(codes: np.ndarray) -> pa.Array:
    """One value of a byte for each feature and row."""
    n, d = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])


def byte_codes(column: pa.Array, d: int) -> np.ndarray:
    start = np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * d, start).reshape(len(column), d) if len(column) else np.zeros((0, d), np.uint8)


def clustered(train: DataFrame, features: list[str], label: str, weight: str | None, cuts: list[np.ndarray], order: tuple[str, ...] = ("b",)) -> tuple[DataFrame, int, int]:
    """(rows by cell, cells, rows): bins b, label y, weight w and a hash of the values as key; rows of a cell are of one task, in one run.

    A cell with more rows than a task's share is dealt to several tasks by key.
    """
    d, parts = len(features), int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    used = train.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    used = used.withColumn("__key", F.xxhash64(*features, "__y"))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.stack([np.searchsorted(cuts[i], batch.column(i).to_numpy(zero_copy_only=False)) for i in range(d)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([code_bytes(codes), *batch.columns[d:]], ["b", "y", "w", "key"])

    coded = used.mapInArrow(binned, "b binary, y double, w double, key long")
    size = coded.groupBy("b").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    slices = max(1, -(-(size["most"] or 0) * parts // max(size["n"] or 0, 1)))
    return coded.repartition(parts, "b", F.pmod("key", F.lit(slices))).sortWithinPartitions(*order), size["cells"] * min(slices, parts), size["n"] or 0


def runs(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    return np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)]) if len(codes) else np.zeros(0, int)


def fit_boosted(
    train: DataFrame, features: list[str], label: str, weight: str | None = None, rounds: int = 600, depth: int = DEPTH, rate: float = RATE,
    l2: float = L2, rows: float = ROWS, columns: float = COLUMNS, bins: int = BINS, seed: int = 42,
) -> Boosted:
    """Squared error; train has no missing values. Rows are drawn for each tree by a hash of their values."""
    cuts, d = cut_points(train, features, bins), len(features)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = train.agg(F.sum(F.col(label).cast("double") * w) / F.sum(w)).first()[0]

    def after(codes: np.ndarray, p: np.ndarray, trees: list[dict[int, dict]]) -> np.ndarray:
        return p + sum((leaf_values(t, lambda i, n: codes[:, n["feature"]] <= n["bin"], len(p)) for t in trees), np.zeros(len(p)))

    def drawn(done: list[dict[int, dict]], numbers: range):
        """Cells of a batch with their prediction and, for each tree, weights drawn and sums of weighted labels, as bytes of one row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = byte_codes(batch.column("b"), d)
                at = runs(codes)
                if not len(at):
                    continue
                key, w = batch.column("key").to_numpy(), batch.column("w").to_numpy()
                y, sums = w * batch.column("y").to_numpy(), np.zeros((2 * len(numbers), len(at)))
                for k, number in enumerate(numbers):
                    take = _mixed(key, seed * 1_000_003 + number) < rows
                    sums[2 * k], sums[2 * k + 1] = (np.add.reduceat(np.where(take, v, 0.0), at) for v in (w, y))
                cell = np.ascontiguousarray(codes[at])
                p = after(cell, np.full(len(at), base), done)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (cell, p, sums)], ["b", "p", "sums"])

        return run, "b binary, p binary, sums binary"

    def step(fresh: list[dict[int, dict]], first: int):
        """Cells with what was drawn for the next trees of a span alone, and their prediction after those before."""

        def run(block: tuple[bytes, bytes, bytes]) -> tuple[bytes, bytes, bytes]:
            b, p, s = block
            p = after(np.frombuffer(b, np.uint8).reshape(-1, d), np.frombuffer(p), fresh)
            return b, p.tobytes(), s[first * len(p) * 16 : (first + STEP) * len(p) * 16]

        return run

    def sums(trees: list[dict[int, dict]], tree: dict[int, dict], level: int):
        size, k = (1 << level) * d * bins, len(trees)

        def run(blocks) -> Iterator[np.ndarray]:
            total = np.zeros((2, size))
            for b, p, s in blocks:
                codes, p = np.frombuffer(b, np.uint8).reshape(-1, d), np.frombuffer(p)
                w, y = np.frombuffer(s).reshape(-1, len(p))[2 * k : 2 * k + 2]
                node = place(tree, lambda i, n: codes[:, n["feature"]] <= n["bin"], len(p)) - ((1 << level) - 1)  # noqa: B023
                take = (node >= 0) & (w > 0)
                gradient = w * after(codes, p, trees) - y
                at = ((node[take, None] * d + np.arange(d)) * bins + codes[take]).reshape(-1)
                total += [np.bincount(at, np.repeat(v[take], d), size) for v in (gradient, w)]
            yield total

        return run

    def grow(blocks, fresh: list[dict[int, dict]]) -> dict[int, dict]:
        chosen = np.zeros(d, bool)
        chosen[rng.choice(d, max(1, round(columns * d)), replace=False)] = True
        tree: dict[int, dict] = {0: {"value": 0.0, "cover": 0.0}}
        for level in range(depth):
            parts = blocks.mapPartitions(sums(fresh, tree, level))
            g, h = (parts.treeReduce(np.add) if tasks > FEW else parts.reduce(np.add)).reshape(2, -1, d, bins)
            grown = False
            for k in range(1 << level):
                i = (1 << level) - 1 + k
                if i not in tree:
                    continue
                if level == 0:
                    tree[0] = {"value": -rate * g[0, 0].sum() / (h[0, 0].sum() + l2), "cover": h[0, 0].sum()}
                split = best_split(g[k], h[k], chosen, l2, LEAST)
                if split is None:
                    continue
                gain, feature, at = split
                tree[i] |= {"feature": feature, "bin": at, "threshold": float(cuts[feature][at]), "gain": gain}
                for child, part in ((2 * i + 1, slice(0, at + 1)), (2 * i + 2, slice(at + 1, bins))):
                    own_g, own_h = g[k, feature, part].sum(), h[k, feature, part].sum()
                    tree[child] = {"value": -rate * own_g / (own_h + l2), "cover": own_h}
                grown = True
            if not grown:
                break
        return tree

    table, cells, n = clustered(train, features, label, weight, cuts)
    table = table.persist(StorageLevel.DISK_ONLY)
    tasks = max(1, min(-(-cells // CELLS), int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    span = min(SPAN, max(SHORT, 8 * n // max(cells, 1), SMALL // max(cells, 1)))
    trees: list[dict[int, dict]] = []
    rng = np.random.default_rng(seed)
    try:
        for first in range(0, rounds, span):
            fresh: list[dict[int, dict]] = []
            # As an RDD: some hundred jobs on a few blocks of bytes, which a query plan for each would outlast.
            found = table.mapInArrow(*drawn(trees, range(first, min(first + span, rounds)))).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                found.count()
                for at in range(0, min(span, rounds - first), STEP):
                    blocks = found.map(step(list(fresh), at)).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
                    recent: list[dict[int, dict]] = []
                    for _ in range(min(STEP, span - at, rounds - first - at)):
                        recent.append(grow(blocks, recent))
                    blocks.unpersist()
                    fresh += recent
            finally:
                found.unpersist()
            trees += fresh
    finally:
        table.unpersist()
    return Boosted(list(features), float(base), trees)
