"""Random forests of regression trees, found from cells of rows that are alike in all bins (see `boosting`).

A tree draws each row Poisson(1) times. What it needs to know of a cell is how many rows it draws there, their
weight and their sum of weighted labels; one pass over the rows adds these up for a span of trees. For each
level of STEP trees one job adds up cells by tree, node, feature and bin; each node looks at features of its own.
A forest is kept as trees whose values add up: each leaf has its mean, divided by the number of trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BINS, CELLS, FEW, SHORT, SMALL, Boosted, byte_codes, clustered, code_bytes, cut_points, place, runs
from .ratings import poisson_draws

#: Depth as in Spark's forests; rows that a child must have; trees that levels are found for together; rows drawn together.
DEPTH, LEAST, STEP, BLOCK = 5, 2, 50, 256


def split(c: np.ndarray, h: np.ndarray, y: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, bin) that lessens the squared error most, the first on ties; rows, weights and sums of labels by (feature, bin)."""
    left = [np.cumsum(v, axis=1)[:, :-1] for v in (c, h, y)]
    right = [v.sum(axis=1, keepdims=True) - part for v, part in zip((c, h, y), left, strict=True)]
    valid = (left[0] >= LEAST) & (right[0] >= LEAST) & (left[1] > 0) & (right[1] > 0)
    if not valid.any():
        return None
    gain = sum(s**2 / np.where(valid, w, 1.0) for _, w, s in (left, right)) - y.sum(axis=1, keepdims=True) ** 2 / h.sum(axis=1, keepdims=True)
    gain = np.where(valid, gain, -np.inf)
    feature, at = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[feature, at]), int(feature), int(at)) if gain[feature, at] > 1e-9 else None


def fit_forest(train: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 500, depth: int = DEPTH, bins: int = BINS, seed: int = 42) -> Boosted:
    """All trees, each on rows of its own draw; train has no missing values. A node looks at the root of the number of features."""
    cuts, d = cut_points(train, features, bins), len(features)
    looks = math.ceil(math.sqrt(d))
    weighed = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = float(train.agg(F.sum(F.col(label).cast("double") * weighed) / F.sum(weighed)).first()[0])

    def drawn(numbers: range):
        salt = np.uint64(seed * 1_000_003 + numbers.start)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = byte_codes(batch.column("b"), d)
                at = runs(codes)
                if not len(at):
                    continue
                key, w = batch.column("key").to_numpy().view(np.uint64) + salt, batch.column("w").to_numpy()
                y, total = batch.column("y").to_numpy(), np.zeros((len(at), 3, len(numbers)))
                # Rows equal in all that a tree sees are drawn together, by the rate of their number.
                fresh = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (w[1:] != w[:-1])] | np.isin(np.arange(len(key)), at))
                copies = np.diff(np.r_[fresh, len(key)])
                cell = np.searchsorted(at, fresh, "right") - 1
                for first in range(0, len(fresh), BLOCK):
                    rows = fresh[first : first + BLOCK]
                    count = poisson_draws(key[rows], copies[first : first + BLOCK], len(numbers))
                    own = cell[first : first + BLOCK]
                    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    for k, factor in enumerate((1.0, w[rows, None], (w[rows] * y[rows])[:, None])):
                        total[own[starts], k] += np.add.reduceat(count * factor, starts, axis=0)
                sums = np.ascontiguousarray(total.transpose(2, 1, 0))  # by tree, kind and cell
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (np.ascontiguousarray(codes[at]), sums)], ["b", "sums"])

        return run, "b binary, sums binary"

    def step(first: int, last: int):
        return lambda block: (block[0], block[1][first * len(block[0]) // d * 24 : last * len(block[0]) // d * 24])

    def sums(grown: list[dict[int, dict]], chosen: np.ndarray, level: int):
        """Rows, weights and sums of labels by tree, node, feature that the node looks at, and bin."""
        size = (1 << level) * looks * bins

        def run(blocks) -> Iterator[np.ndarray]:
            total = np.zeros((len(grown), 3, size))
            for b, s in blocks:
                codes = np.frombuffer(b, np.uint8).reshape(-1, d)
                for t, values in enumerate(np.frombuffer(s).reshape(len(grown), 3, len(codes))):
                    node = place(grown[t], lambda i, n: codes[:, n["feature"]] <= n["bin"], len(codes)) - ((1 << level) - 1)  # noqa: B023
                    take = np.flatnonzero((node >= 0) & (values[0] > 0))
                    node = node[take]
                    at = ((node[:, None] * looks + np.arange(looks)) * bins + codes[take[:, None], chosen[t, node]]).reshape(-1)
                    total[t] += [np.bincount(at, np.repeat(v[take], looks), size) for v in values]
            yield total

        return run

    def grow(blocks, rng: np.random.Generator, n: int) -> list[dict[int, dict]]:
        grown: list[dict[int, dict]] = [{0: {"value": base / trees, "cover": 0.0}} for _ in range(n)]
        for level in range(depth):
            chosen = np.argsort(rng.random((n, 1 << level, d)), axis=2)[:, :, :looks]
            parts = blocks.mapPartitions(sums(grown, chosen, level))
            found = (parts.treeReduce(np.add) if tasks > FEW else parts.reduce(np.add)).reshape(n, 3, -1, looks, bins)
            for t, tree in enumerate(grown):
                for k in range(1 << level):
                    i = (1 << level) - 1 + k
                    c, h, y = found[t, :, k]
                    if i not in tree or not h[0].sum() > 0:
                        continue
                    if level == 0:
                        tree[0] = {"value": float(y[0].sum() / h[0].sum() / trees), "cover": float(h[0].sum())}
                    if (best := split(c, h, y)) is None:
                        continue
                    gain, j, at = best
                    feature = int(chosen[t, k, j])
                    tree[i] |= {"feature": feature, "bin": at, "threshold": float(cuts[feature][at]), "gain": gain}
                    for child, part in ((2 * i + 1, slice(0, at + 1)), (2 * i + 2, slice(at + 1, bins))):
                        tree[child] = {"value": float(y[j, part].sum() / h[j, part].sum() / trees), "cover": float(h[j, part].sum())}
        return grown

    table, cells, n = clustered(train, features, label, weight, cuts, ("b", "key", "w"))
    table = table.persist(StorageLevel.DISK_ONLY)
    tasks = max(1, min(-(-cells // CELLS), int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    span = min(trees, max(SHORT, 8 * n // max(cells, 1), SMALL // max(cells, 1)))
    rng, done = np.random.default_rng(seed), []
    try:
        for first in range(0, trees, span):
            numbers = range(first, min(first + span, trees))
            found = table.mapInArrow(*drawn(numbers)).rdd.map(tuple).persist(StorageLevel.DISK_ONLY)
            try:
                for at in range(0, len(numbers), STEP):
                    last = min(at + STEP, len(numbers))
                    if at == 0:
                        found.count()
                    blocks = found.map(step(at, last)).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
                    done += grow(blocks, rng, last - at)
                    blocks.unpersist()
            finally:
                found.unpersist()
    finally:
        table.unpersist()
    return Boosted(list(features), 0.0, done)
