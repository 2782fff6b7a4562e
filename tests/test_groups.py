"""No group grows with the input: clouds are bounded, and no window is keyed by a few values or by whole texts."""

from pyspark.sql import functions as F

from meshquill.operators import ratings, validation
from meshquill.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clouds_are_bounded(spark):
    clouds = queries._dense(spark, SF).select("capture_key", F.size("points").alias("n")).collect()
    keys = {r[0] // 20 for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    assert {r["capture_key"] for r in clouds} == keys and max(r["n"] for r in clouds) <= 20 * queries.tables.N_POINTS
    assert sum(r["n"] for r in clouds) == queries.tables.N_POINTS * spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_duplicate_flags_without_a_window(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, None, 1), (4, None, 1), (5, "b", None), (6, "b", 2), (7, "", 1)], "i int, t string, k int")
    by = lambda *keys: {r["i"] for r in validation.duplicate_flags(df, *keys).collect() if r["duplicated"]}
    assert by("t") == {1, 2, 3, 4, 5, 6} and by("t", "k") == {1, 2, 3, 4}
    assert "Window" not in plan(validation.duplicate_flags(df, "t"))


def test_icc_has_no_window_over_raters(spark):
    block = spark.createDataFrame([(p, r, float(p * 3 + r * r % 5)) for p in range(9) for r in range(4)], "participant_id int, rater_id int, v double")
    assert "windowspecdefinition(rater_id" not in plan(ratings.icc(block)) and ratings.icc(block).first()["n_raters"] == 4
