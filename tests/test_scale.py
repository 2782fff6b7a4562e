"""What is shuffled, and held at once, does not grow beyond what the work needs."""

import contextlib
import hashlib
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meshquill.operators import metrics, models, ratings, splits, symmetry
from meshquill.sources import captures


@contextlib.contextmanager
def written(spark):
    """Bytes that the stages within write to shuffles, in a list that is filled at the end."""
    sizes = []

    def stages():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    yield sizes
    time.sleep(1)  # the listener is behind by a little
    sizes += [n for stage, n in stages().items() if stage not in before]


def test_bootstrap_keeps_no_resamples_of_whole_participants(spark):
    """What is shuffled for a participant of one part is its interval; for others, a few rows for each resample."""
    rows = [(p, "r", float(v)) for p in range(300) for v in range(3)] + [(1000, "r", float(v)) for v in range(300)]
    df = spark.createDataFrame(rows, "participant_id long, rater_id string, rating double")
    with written(spark) as sizes:
        got = {r["participant_id"]: r for r in ratings.bootstrap(df, chunk=100).collect()}
    assert len(got) == 301 and all(r["boot_low"] < r["boot_high"] for r in got.values())
    assert 0 < sum(sizes) < 1_000_000  # 300 participants of 2 x 2,000 doubles were several times that


def test_bootstrap_draws_are_poisson_and_made_together():
    """Counts have the shares of their rate, depend on key and resample alone, and take a small part of a generator's time for each value."""
    rng = np.random.default_rng(11)
    keys = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    for rate in (1, 2, ratings.TABLED, ratings.TABLED + 1):
        draws = ratings.poisson_draws(keys, np.full(600, rate), 1001)
        k = np.arange(120)
        want = np.exp(-rate) * np.cumprod(np.r_[1.0, rate / k[1:]]) * draws.size
        often = want > 20
        assert (((np.bincount(draws.astype(int).ravel(), minlength=120) - want) ** 2 / np.maximum(want, 1e-300))[often]).sum() < 3 * often.sum() + 15
        assert all(abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.01 for a, b in ((draws[:, 0:-1:2], draws[:, 1::2]), (draws[:, 1:-1:2], draws[:, 2::2]), (draws[:300], draws[300:])))
        assert np.array_equal(draws[5:9], ratings.poisson_draws(keys[5:9], np.full(4, rate), 1001))
    mixed = ratings.poisson_draws(keys[:4], np.array([1, 50, 2, 1]), 1001)
    assert np.array_equal(mixed[[0, 3]], ratings.poisson_draws(keys[[0, 3]], np.array([1, 1]), 1001)) and abs(mixed[1].mean() - 50) < 2
    value, ends = rng.normal(size=600), np.r_[np.arange(0, 600, 23), 600]
    sums = ratings.resample(lambda a, b: keys[a:b].tolist(), value, np.ones(600, int), ends, 100)
    draws = ratings.poisson_draws(keys, np.ones(600, int), 100)
    for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        assert np.array_equal(sums[p, 0], draws[a:b].sum(axis=0)) and np.allclose(sums[p, 1], value[a:b] @ draws[a:b])
    together, apart = [], []
    for _ in range(5):
        began = time.perf_counter()
        ratings.resample(lambda a, b: keys[a:b].tolist(), value, np.ones(600, int), ends, 2000)
        together.append(time.perf_counter() - began)
        began = time.perf_counter()
        for key in keys.tolist():
            np.random.default_rng(key).poisson(1, 2000)
        apart.append(time.perf_counter() - began)
    assert min(together) < min(apart) / 2


def test_small_planes_are_fitted_together_and_alike(spark):
    rng = np.random.default_rng(3)
    points = [*rng.normal(size=(30, 21, 3)), *rng.normal(size=(5, 8, 3)), np.zeros((0, 3)), np.full((4, 3), np.nan), np.ones((5, 3)), rng.normal(size=(40, 3))]
    triangles, together = np.array([[0, 1, 2], [1, 2, 3]]), symmetry.fit_planes(points)
    assert [i for i, found in enumerate(together) if found is None] == [35, 36, 38]
    for p, found in list(zip(points, together, strict=True))[:35]:
        assert symmetry.measure(p, triangles, plane=found) == symmetry.measure(p, triangles)
    began = time.perf_counter()
    symmetry.fit_planes(list(rng.normal(size=(300, 21, 3))))
    many = time.perf_counter() - began
    began = time.perf_counter()
    [symmetry.measure(p, triangles) for p in rng.normal(size=(20, 21, 3))]
    assert many / 300 < (time.perf_counter() - began) / 20 / 3


def test_sides_are_told_row_by_row(spark):
    """No row of a table is shuffled to find its side; sides are those of sorting all ids by their hash."""
    ids = spark.range(40_000).select((F.col("id") % 501).alias("participant_id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    table = ids.withColumn("participant_id", F.when(F.col("participant_id") != 500, F.col("participant_id")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more participants than can be broadcast
    try:
        split = splits.participant_split(table)
        with written(spark) as sizes:
            rows = split.select("participant_id", "side").distinct().collect()
            split.agg(F.avg("a"), F.avg("b"), F.count_if(F.col("side") == "test")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < sum(sizes) < 100_000  # 40,000 rows were about 700,000 bytes
    order = sorted((hashlib.md5((f"42:{p}" if p is not None else "42").encode()).hexdigest(), p) for p in [*range(500), None])
    first = {p for _, p in order[:101]} - {None}
    assert {r["participant_id"] for r in rows if r["side"] == "test"} == first and len(rows) == 501
    assert splits.participant_split(table, 0.0).where("side = 'test'").count() == 0
    named = splits.participant_split(table.withColumn("participant_id", F.concat(F.lit("P"), F.col("participant_id"))), seed=7).select("participant_id", "side").distinct().collect()
    order = sorted((hashlib.md5(p.encode()).hexdigest(), p) for p in ["7", *(f"7:P{i}" for i in range(500))])
    assert {f"7:{r['participant_id']}" for r in named if r["side"] == "test"} == {p for _, p in order[:101]} - {"7"}


def test_parsed_documents_leave_a_worker_in_small_frames():
    class Files:
        """Stands for a DataFrame; gives the function that would run on its batches."""

        dtypes = [("path", "string"), ("content", "binary"), ("tag", "int")]

        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            return run

    n = 300
    text = b'{"participantId": "P", "vertices": [[0, 0, 0], [1, 0, 0], [0, 1, 0]], "triangles": [[0, 1, 2]]}'
    frame = pd.DataFrame({"path": [f"{i}.json" for i in range(n)], "content": [text] * n, "tag": range(n)})
    frames = list(captures.parse_captures(Files(), keep=("tag",))(iter([frame])))
    assert max(map(len, frames)) <= 64
    whole = pd.concat(frames, ignore_index=True)
    assert whole["path"].tolist() == frame["path"].tolist() and whole["tag"].tolist() == list(range(n)) and whole["error"].isna().all()


def test_models_read_and_predict_rows_once(spark):
    """Fitting has the rows made once; scores take two passes over predictions; a row's side takes one hash of its id; nothing stays cached."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    n = 2_000
    rows = spark.range(n).select((F.col("id") % 101).alias("participant_id"), (F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    table = rows.select("participant_id", "a", counted("b").alias("b"), (F.col("a") + 3 * F.col("b")).alias("mean_rating"), F.lit(2.0).alias("n_ratings"))
    plain = rows.withColumns({"mean_rating": F.col("a") + 3 * F.col("b"), "n_ratings": F.lit(2.0)})
    for name, options in (("random_forest", {"trees": 3}), ("linear", {}), ("ridge", {}), ("gbt", {"rounds": 2})):
        before = made.value
        fitted = models.fit(table, ["a", "b"], name, weight="n_ratings", **options)
        assert made.value - before == n, name
        again = models.fit(plain, ["a", "b"], name, weight="n_ratings", keep=False, **options)
        assert fitted.importance().equals(again.importance()), name
    before = made.value
    scores = metrics.regression_metrics(rows.select(F.col("a").alias("truth"), counted("b").alias("predicted"))).first()
    assert made.value - before <= 3 * n  # a pass to tell which are finite and to add up, and one for the errors from the mean
    x = np.arange(n)
    assert scores["n"] == n and np.isclose(scores["mae"], np.abs(x % 37 - x % 11).mean()) and np.isclose(scores["baseline_mae"], np.abs(x % 37 - (x % 37).mean()).mean())
    none = metrics.regression_metrics(rows.select(F.col("a").alias("truth"), F.lit(None).cast("double").alias("predicted"))).first().asDict()
    assert none.pop("n") == 0 and set(none.values()) == {None}
    for side in ("train", "test"):
        plan = splits.participant_split(plain).where(F.col("side") == side).select("a")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("md5(") == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
