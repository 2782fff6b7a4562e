"""Folds by one rule at every size."""

import numpy as np
import pytest

from meshquill.operators import splits


def greedy(sizes, n_splits):
    loads, fold_of = [0] * n_splits, {}
    for p, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fold_of[p] = min(range(n_splits), key=lambda i: (loads[i], i))
        loads[fold_of[p]] += n
    return fold_of


@pytest.mark.parametrize("n_splits", [2, 5])
def test_folds_are_greedy_without_a_switch(spark, monkeypatch, n_splits):
    monkeypatch.setattr(splits, "MAX_GREEDY", 0, raising=False)
    rng = np.random.default_rng(1)
    sizes = {p: int(n) for p, n in enumerate(rng.integers(1, 9, 300))} | {1000: 700, 1001: 90, 1002: 90}
    table = spark.createDataFrame([(p, i) for p, n in sizes.items() for i in range(n)], "participant_id long, i int").repartition(7)
    got = splits.participant_folds(table, n_splits).groupBy("participant_id", "fold").count().collect()
    assert {r["participant_id"]: r["fold"] for r in got} == greedy(sizes, n_splits)
    assert {r["participant_id"]: r["count"] for r in got} == sizes


def test_runs_equal_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(300):
        loads = [int(x) for x in rng.integers(0, 60, rng.integers(1, 7))]
        n, k = int(rng.integers(1, 12)), int(rng.integers(1, 80))
        want, kept = [], list(loads)
        for _ in range(k):
            want.append(min(range(len(kept)), key=lambda i: (kept[i], i)))
            kept[want[-1]] += n
        runs = splits._runs(loads, n, k)
        got = [next(t[(r - first) % len(t)] for first, t in reversed(runs) if first <= r) for r in range(k)]
        assert got == want and loads == kept
