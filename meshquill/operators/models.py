"""Regression baselines: assembling, fitting, cross-validation, importance."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import stores
from . import metrics, ranks, splits
from .boosting import Boosted, fit_boosted
from .features import usable_columns
from .forest import fit_forest

MODELS = ("linear", "ridge", "random_forest", "gbt")
ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 25))
NOTE = "Importances describe how a model uses correlated measures; they are no evidence of cause, nor of what raters respond to."


@dataclass
class TrainingData:
    table: DataFrame
    features: list[str]
    dropped: list[str] = field(default_factory=list)


def assemble(features: DataFrame, targets: DataFrame, columns: list[str], min_ratings: int = 1) -> TrainingData:
    """Captures with the consensus of their participant; columns that are empty or constant after the join go."""
    t = targets.where(F.col("n_ratings") >= min_ratings).select("participant_id", "mean_rating", "n_ratings")
    table = features.join(t, "participant_id")
    if table.limit(1).count() == 0:
        raise ValueError("no participant has both features and enough ratings")
    kept = usable_columns(table, columns)
    return TrainingData(table, kept, [c for c in columns if c not in kept])


def medians(train: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact medians of the training rows; 0 where a column is empty there."""
    return {f: 0.0 if v is None else v for f, v in ranks.quantiles(train, features).items()}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(v)) for f, v in values.items()})


@dataclass
class Ridge:
    """Standardised weighted ridge; alpha by leave-one-out error."""

    features: list[str]
    centre: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercept: float
    alpha: float

    def transform(self, df: DataFrame) -> DataFrame:
        terms = [(F.col(f) - float(c)) / float(s) * float(w) for f, c, s, w in zip(self.features, self.centre, self.scale, self.coefficients, strict=True)]
        return df.withColumn("predicted", sum(terms, F.lit(float(self.intercept))))


def fit_ridge(train: DataFrame, features: list[str], label: str, weight: str | None, alphas: tuple[float, ...] = ALPHAS) -> Ridge:
    """The Gram matrix is summed by task and added up; only matrices of features x features reach the
    driver. Leave-one-out residuals follow from leverages, in a second pass for all alphas at once."""
    row = train.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features))).first()
    d = len(features)
    centre, scale = np.array([row[f"m{i}"] for i in range(d)]), np.array([row[f"s{i}"] or 1.0 for i in range(d)])
    scale[scale == 0] = 1.0
    used = train.select(*features, F.col(label).alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))

    def design(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.c_[np.ones(len(frame)), (frame[features].to_numpy(float) - centre) / scale]
        return x, frame["__y"].to_numpy(float), frame["__w"].to_numpy(float)

    def gram(frames):
        total = np.zeros((d + 2, d + 2))
        for frame in frames:
            x, y, w = design(frame)
            z = np.c_[x, y]
            total += z.T @ (w[:, None] * z)
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.reshape(-1)})

    sums = used.mapInPandas(gram, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy().reshape(d + 2, d + 2)
    a, b = sums[: d + 1, : d + 1], sums[: d + 1, d + 1]
    penalty = np.diag(np.r_[0.0, np.ones(d)])
    inverses = [np.linalg.pinv(a + alpha * penalty) for alpha in alphas]
    betas = [inv @ b for inv in inverses]

    def errors(frames):
        total = np.zeros(len(alphas))
        for frame in frames:
            x, y, w = design(frame)
            for k, (inv, beta) in enumerate(zip(inverses, betas, strict=True)):
                h = w * np.einsum("ij,jk,ik->i", x, inv, x)
                total[k] += (w * ((y - x @ beta) / np.maximum(1.0 - h, 1e-12)) ** 2).sum()
        yield pd.DataFrame({"k": np.arange(len(alphas)), "v": total})

    loo = used.mapInPandas(errors, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()
    best = int(np.argmin(loo))
    return Ridge(list(features), centre, scale, betas[best][1:], float(betas[best][0]), alphas[best])


def build_model(name: str):
    """Spark's own estimator of a name; ridge, random_forest and gbt are fitted by this library."""
    if name == "linear":
        return LinearRegression(featuresCol="x", solver="normal")
    raise ValueError(f"unknown model {name!r}; one of {MODELS}")


@dataclass
class Fitted:
    """Imputation values with a fitted model; both are learned on the training rows alone."""

    name: str
    features: list[str]
    values: dict[str, float]
    model: PipelineModel | Ridge | Boosted

    def transform(self, df: DataFrame) -> DataFrame:
        ready = impute(df, self.values)
        if isinstance(self.model, Ridge | Boosted):
            return self.model.transform(ready)
        return self.model.transform(ready).drop("x", "__y").withColumnRenamed("prediction", "predicted")

    def save(self, path: str, spark: SparkSession, report: dict | None = None) -> str:
        """A description in JSON, with the weights of a ridge; pipelines by Spark's own writer beside it."""
        about = {"name": self.name, "features": self.features, "values": self.values, "report": report}
        if isinstance(self.model, Ridge):
            m = self.model
            about["ridge"] = {"centre": m.centre.tolist(), "scale": m.scale.tolist(), "coefficients": m.coefficients.tolist(), "intercept": m.intercept, "alpha": m.alpha}
        elif isinstance(self.model, Boosted):
            about["boosted"] = {"base": self.model.base, "trees": [[{"id": i, **n} for i, n in t.items()] for t in self.model.trees]}
        else:
            self.model.write().overwrite().save(f"{path}/pipeline")
        stores.write_document(spark, about, f"{path}/about.json")
        return path

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Fitted:
        about = stores.read_document(spark, f"{path}/about.json")
        if ridge := about.get("ridge"):
            model = Ridge(about["features"], np.array(ridge["centre"]), np.array(ridge["scale"]), np.array(ridge["coefficients"]), ridge["intercept"], ridge["alpha"])
        elif boosted := about.get("boosted"):
            model = Boosted(about["features"], boosted["base"], [{n["id"]: {k: v for k, v in n.items() if k != "id"} for n in t} for t in boosted["trees"]])
        else:
            model = PipelineModel.load(f"{path}/pipeline")
        return cls(about["name"], about["features"], about["values"], model)

    def importance(self, top: int | None = None) -> pd.DataFrame:
        """Tree importances or absolute coefficients, largest first; the first `top` of them if given."""
        last = self.model if isinstance(self.model, Ridge | Boosted) else self.model.stages[-1]
        values = last.gains() if isinstance(last, Boosted) else np.abs(last.coefficients.toArray() if hasattr(last.coefficients, "toArray") else last.coefficients) if hasattr(last, "coefficients") else last.featureImportances.toArray()
        return pd.DataFrame({"feature": self.features, "importance": values}).sort_values(["importance", "feature"], ascending=[False, True], ignore_index=True).head(top or len(values))


def fit(train: DataFrame, features: list[str], name: str, label: str = "mean_rating", weight: str | None = None, seed: int = 42, keep: bool = True, **sizes) -> Fitted:
    """Fitting passes over the rows several times: unless keep is false, the columns that it needs are kept on disk until it
    is done, so that rows are read and made (and the side of a split told) once."""
    if keep:
        kept = train.select(*dict.fromkeys([*features, label, *([weight] if weight else [])])).persist(StorageLevel.DISK_ONLY)
        try:
            return fit(kept, features, name, label, weight, seed, keep=False, **sizes)
        finally:
            kept.unpersist()
    values = medians(train, features)
    ready = impute(train, values)
    if name == "ridge":
        return Fitted(name, features, values, fit_ridge(ready, features, label, weight))
    if name == "gbt":
        return Fitted(name, features, values, fit_boosted(ready, features, label, weight, sizes.get("rounds", 600), seed=seed))
    if name == "random_forest":
        return Fitted(name, features, values, fit_forest(ready, features, label, weight, sizes.get("trees", 500), seed=seed))
    model = build_model(name).setLabelCol("__y")
    if weight:
        model = model.setWeightCol(weight)
    ready = ready.withColumn("__y", F.col(label).cast("double"))
    return Fitted(name, features, values, Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), model]).fit(ready))


def predictions(fitted: Fitted, df: DataFrame, label: str = "mean_rating") -> DataFrame:
    return fitted.transform(df).withColumns({"truth": F.col(label).cast("double"), "error": F.col("predicted") - F.col(label)})


def cross_validate(data: TrainingData, name: str, n_splits: int = 5, label: str = "mean_rating", weight: str | None = "n_ratings", **options) -> DataFrame:
    """Out-of-fold predictions; folds hold whole participants, are dealt once and kept for all fits and predictions."""
    folds = splits.participant_folds(data.table, n_splits).persist(StorageLevel.DISK_ONLY)
    out = None
    for k in range(n_splits):
        held = predictions(fit(folds.where(F.col("fold") != k), data.features, name, label, weight, keep=False, **options), folds.where(F.col("fold") == k), label)
        out = held if out is None else out.unionByName(held)
    return out


def train_final(data: TrainingData, name: str, test_size: float = 0.2, seed: int = 42, label: str = "mean_rating", weight: str | None = "n_ratings", **options) -> tuple[Fitted, dict, dict, DataFrame]:
    sides = splits.participant_split(data.table, test_size, seed)
    train, test = sides.where("side = 'train'"), sides.where("side = 'test'")
    splits.assert_no_leakage(train, test)
    fitted = fit(train, data.features, name, label, weight, seed, **options)
    held = predictions(fitted, test, label)
    return fitted, metrics.evaluate(predictions(fitted, train, label)), metrics.evaluate(held), held


#: Participants below which scores are unstable; growth of R2 from held-out to training rows that counts as overfitting.
SMALL_COHORT, OVERFIT = 30, 0.25


def compare(data: TrainingData, names: tuple[str, ...] = MODELS, n_splits: int = 5, test_size: float = 0.2, seed: int = 42, **options) -> tuple[str, dict[str, dict], list[str]]:
    """(best, out-of-fold, training and held-out metrics of each, warnings): the best has the largest out-of-fold R2."""
    n = data.table.select("participant_id").distinct().count()
    warnings = [f"only {n} participants: scores depend on who is held out"] if n < SMALL_COHORT else []
    results = {}
    for name in names:
        _, train, test, _ = train_final(data, name, test_size, seed, **options)
        results[name] = {"cv": metrics.evaluate(cross_validate(data, name, n_splits, **options)), "train": train, "test": test}
        if train["r2"] is not None and test["r2"] is not None and train["r2"] - test["r2"] > OVERFIT:
            warnings.append(f"{name}: training R2 exceeds held-out R2 by {train['r2'] - test['r2']:.2f}, overfitting")
    return max(results, key=lambda m: -np.inf if results[m]["cv"]["r2"] is None else results[m]["cv"]["r2"]), results, warnings


def report(data: TrainingData, best: str, results: dict[str, dict], warnings: list[str], weight: str | None = "n_ratings", seed: int = 42) -> dict:
    """What a training run says of itself, as one document."""
    return {
        "trained_at": datetime.now(UTC).isoformat(), "n_rows": data.table.count(), "n_participants": data.table.select("participant_id").distinct().count(), "features": data.features,
        "dropped_features": data.dropped, "sample_weighting": weight, "seed": seed, "results": results, "best_model": best, "warnings": warnings, "note": NOTE,
    }


def permutation_importance(fitted: Fitted, df: DataFrame, label: str = "mean_rating", repeats: int = 20, seed: int = 42) -> DataFrame:
    """(feature, increase, spread): growth of the mean absolute error when a column's values change rows.

    Rows are dealt to buckets by a hash and numbered within them; a repeat takes the value of the row
    that stands a random number of places further in the bucket. No task orders all rows.
    """
    ready = impute(df, fitted.values).select(*fitted.features, label)
    buckets = max(ready.count() // 10_000, 1)
    hashed = ready.withColumns({"__b": F.pmod(F.xxhash64(F.lit(seed), *fitted.features, label), F.lit(buckets)), "__h": F.xxhash64(F.lit(seed + 1), *fitted.features, label)})
    bucket = Window.partitionBy("__b")
    rows = hashed.withColumns({"__r": F.row_number().over(bucket.orderBy("__h", *fitted.features)), "__n": F.count(F.lit(1)).over(bucket)}).drop("__h")
    base = metrics.finite(predictions(fitted, rows, label)).agg(F.avg(F.abs("e"))).first()[0]
    rng = np.random.default_rng(seed)
    shifts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(int(s)).alias("s")) for k, s in enumerate(rng.integers(1, 1 << 30, repeats))))
    # One join for each repeat gives the moved values of all columns; a row then stands once for each column that moves.
    sought = rows.withColumn("__shift", F.explode(shifts)).withColumn("__at", (F.pmod(F.col("__r") + F.col("__shift.s"), F.col("__n")) + 1).cast("int"))
    moved = rows.select(F.col("__b").alias("__mb"), F.col("__r").alias("__mr"), *(F.col(f).alias(f"__m_{f}") for f in fitted.features))
    pairs = sought.join(moved, (F.col("__b") == F.col("__mb")) & (F.col("__at") == F.col("__mr")))
    pairs = pairs.withColumn("__feature", F.explode(F.array(*map(F.lit, fitted.features))))
    swapped = pairs.withColumns({f: F.when(F.col("__feature") == f, F.col(f"__m_{f}")).otherwise(F.col(f)) for f in fitted.features})
    keys = swapped.withColumn("__k", F.col("__shift.k")).select("__feature", "__k", label, *fitted.features)
    gains = metrics.finite(predictions(fitted, keys, label), "__feature", "__k").groupBy("__feature", "__k").agg((F.avg(F.abs("e")) - F.lit(base)).alias("gain"))
    found = gains.groupBy(F.col("__feature").alias("feature")).agg(F.avg("gain").alias("increase"), F.stddev_pop("gain").alias("spread"))
    return found.orderBy(F.desc("increase"), "feature")
