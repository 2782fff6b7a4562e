"""Errors of predictions: overall, by group, and how groups differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import known
from ..functions.special import correlation_p

MIN_GROUP = 10


def finite(predictions: DataFrame, *group: str) -> DataFrame:
    """(group..., t, p, e) of the pairs in which both are finite."""
    t, p = known("truth"), known("predicted")
    return predictions.select(*group, t.alias("t"), p.alias("p")).dropna(subset=["t", "p"]).withColumn("e", F.col("p") - F.col("t"))


def _aggregates() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.sum(F.col("e") * F.col("e")).alias("sse"), F.var_pop("t").alias("vt"), F.var_pop("p").alias("vp"), F.covar_pop("t", "p").alias("tp")]


def _finish(df: DataFrame, *keep: str) -> DataFrame:
    enough = lambda c: F.when(F.col("n") >= 2, c)
    r2 = F.when(F.col("vt") > 0, 1 - F.col("sse") / (F.col("vt") * F.col("n")))
    r = F.when((F.col("vt") > 0) & (F.col("vp") > 0), F.col("tp") / F.sqrt(F.col("vt") * F.col("vp")))
    return df.select(*keep, "n", enough(F.col("mae")).alias("mae"), enough(F.col("rmse")).alias("rmse"), enough(r2).alias("r2"), enough(r).alias("pearson_r"))


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """One row: MAE, RMSE, R2, Pearson, and the errors of always predicting the mean.

    Two passes, as predictions are made anew in each: the second, for the errors from the mean, carries the sums of the first.
    """
    f = finite(predictions)
    sums = f.agg(*_aggregates(), F.avg("t").alias("m"))
    off = F.col("t") - F.col("m")
    both = f.select("t").crossJoin(F.broadcast(sums)).agg(F.avg(F.abs(off)).alias("b"), F.sqrt(F.avg(F.pow(off, 2))).alias("c"), *(F.first(c).alias(c) for c in sums.columns))
    out = _finish(both.withColumn("n", F.coalesce("n", F.lit(0))), "b", "c")
    return out.select("n", "mae", "rmse", "r2", "pearson_r", F.when(F.col("n") >= 2, F.col("b")).alias("baseline_mae"), F.when(F.col("n") >= 2, F.col("c")).alias("baseline_rmse"))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, rank): the average rank of each distinct value.

    Values are counted first, and the running count is taken within ranges of values and then added
    over the ranges, so no single task orders all rows.
    """
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    before = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    before = before.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("offset"))  # one row for each partition
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    return ranged.withColumn("upto", inside).join(F.broadcast(before), "part").select("value", (F.col("offset") + F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def spearman(predictions: DataFrame) -> DataFrame:
    """One row: n and rho, Pearson's correlation of average ranks."""
    f = finite(predictions).select("t", "p")
    pairs = f.groupBy("t", "p").agg(F.count(F.lit(1)).alias("w"))
    t, p = average_ranks(f, "t").select(F.col("value").alias("t"), F.col("rank").alias("rt")), average_ranks(f, "p").select(F.col("value").alias("p"), F.col("rank").alias("rp"))
    j = pairs.join(t, "t").join(p, "p")
    w = F.sum("w")
    mean = lambda c: F.sum(F.col("w") * c) / w
    a = j.agg(w.alias("n"), mean(F.col("rt")).alias("a"), mean(F.col("rp")).alias("b"), mean(F.col("rt") * F.col("rt")).alias("aa"), mean(F.col("rp") * F.col("rp")).alias("bb"), mean(F.col("rt") * F.col("rp")).alias("ab"))
    va, vb = F.col("aa") - F.col("a") * F.col("a"), F.col("bb") - F.col("b") * F.col("b")
    return a.select("n", F.when((va > 0) & (vb > 0), (F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(va * vb)).alias("spearman_rho"))


def evaluate(predictions: DataFrame) -> dict:
    """All metrics with p-values, as one small record."""
    m, s = regression_metrics(predictions).first().asDict(), spearman(predictions).first()
    m["spearman_rho"] = s["spearman_rho"]
    m["pearson_p"], m["spearman_p"] = correlation_p(m["pearson_r"], m["n"]), correlation_p(m["spearman_rho"], m["n"])
    m["beats_baseline"] = m["mae"] is not None and m["mae"] < m["baseline_mae"]
    return m


def with_demographics(predictions: DataFrame, demographics: DataFrame, column: str) -> DataFrame:
    """Predictions with the group of their participant (grp; NULL where none is known); further columns of the groups stay out.

    A participant with several rows has one group, or none where the rows disagree: predictions are never repeated.
    """
    value = F.col(column)
    groups = demographics.groupBy(F.col("participant_id").alias("__participant")).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias("grp"))
    return predictions.drop("grp").join(groups, F.col("participant_id") == F.col("__participant"), "left").drop("__participant")


def group_metrics(predictions: DataFrame, group: str = "grp", least: int = MIN_GROUP) -> DataFrame:
    """Errors by group; groups are for audit only and never an input of a model. Groups below `least` are flagged."""
    present = predictions.where(F.col(group).isNotNull())
    m = _finish(finite(present, group).groupBy(group).agg(*_aggregates()), group)
    t, p = known("truth"), known("predicted")
    means = present.groupBy(group).agg(F.avg(t).alias("mean_true"), F.avg(p).alias("mean_predicted"), F.avg(p - t).alias("mean_bias"))
    joined = means.join(m, group, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select(group, "n", "mae", "rmse", "r2", "mean_true", "mean_predicted", "mean_bias", (F.col("n") < least).alias("underpowered"))


def fairness(groups: DataFrame, group: str = "grp") -> DataFrame:
    """One row: spread of the error between groups of sufficient size, and the worst and best served; none below two groups."""
    g = groups.where(~F.col("underpowered") & F.col("mae").isNotNull())
    a = g.agg(F.count(F.lit(1)).alias("n_groups"), (F.max("mae") - F.min("mae")).alias("mae_spread"), F.min_by(group, F.struct(-F.col("mae"), group)).alias("worst"), F.min_by(group, F.struct("mae", group)).alias("best"))
    return a.where("n_groups >= 2")


def correlations(df: DataFrame, features: list[str], top: int | None = None) -> DataFrame:
    """(a, b, r) of all pairs of columns, complete rows of each pair, from one pass of partial sums."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]

    def stats(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("xy"))

    row = df.agg(F.array(*[stats(a, b) for a, b in pairs]).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    out = row.select("a", "b", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("xy") / F.sqrt(F.col("vx") * F.col("vy"))).alias("r"))
    return out.where("r IS NOT NULL").orderBy(F.abs("r").desc(), "a", "b").limit(top) if top else out
