"""Shapley values: how much each feature moves a row's prediction from the mean. Of tree ensembles (path-dependent), of linear models, and by sampling of any.

A leaf gives its value where all conditions on the way to it hold. Over a set of known features, the
others' conditions count with the share of training rows that took the same turns. So a leaf is a product
of one factor for each of its features, and a feature's Shapley value in it is a sum over the sizes of sets,
whose terms are the coefficients of a polynomial with one linear factor for each of the leaf's other
features. All rows of a batch are treated together, leaf by leaf; the model is what tasks get.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boosting import Boosted
from .models import Fitted, Ridge, impute


@dataclass
class Leaf:
    """value where low < x <= high for all of its features; share: of the training rows, by feature."""

    value: float
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def tree_nodes(fitted: Fitted, folder: str, spark: SparkSession) -> list[tuple[float, dict[int, dict]]]:
    """(weight, nodes by id) of each tree, through the model's own files in `folder`. As large as the model, whatever the data."""
    if isinstance(fitted.model, Boosted):
        leaf = {"leftChild": -1, "rightChild": -1, "feature": None, "threshold": None}
        inner = lambda i: {"leftChild": 2 * i + 1, "rightChild": 2 * i + 2}
        base = (1.0, {0: {**leaf, "prediction": fitted.model.base, "cover": 1.0}})  # what the trees add to
        return [base, *((1.0, {i: {**leaf, **n, "prediction": n["value"], **(inner(i) if "feature" in n else {})} for i, n in t.items()}) for t in fitted.model.trees)]
    if isinstance(fitted.model, Ridge) or not hasattr(fitted.model.stages[-1], "treeWeights"):
        raise ValueError(f"{fitted.name} has no trees")
    model = fitted.model.stages[-1]
    path = f"{folder}/trees"
    model.write().overwrite().save(path)
    weights = list(model.treeWeights)
    mean = fitted.name == "random_forest"  # forests average, boosting adds up
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", F.col("nodeData.impurityStats")[0].alias("cover"), "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    trees: list[dict[int, dict]] = [{} for _ in weights]
    for r in nodes.collect():
        trees[r["treeID"]][r["id"]] = r.asDict()
    return [(w / (sum(weights) if mean else 1.0), t) for w, t in zip(weights, trees, strict=True)]


def leaves(trees: list[tuple[float, dict[int, dict]]]) -> list[Leaf]:
    out = []
    for weight, nodes in trees:
        stack = [(0, {})]
        while stack:
            at, way = stack.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                known = sorted(way)
                low, high, share = (np.array([way[f][k] for f in known]) for k in range(3))
                out.append(Leaf(weight * node["prediction"], known, low, high, share))
                continue
            f, t = node["feature"], node["threshold"]
            low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, t))), (node["rightChild"], (max(low, t), high))):
                stack.append((child, {**way, f: (*bounds, share * nodes[child]["cover"] / node["cover"])}))
    return out


def shapley(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Values of all rows and features."""
    phi = np.zeros(x.shape)
    for leaf in found:
        m = len(leaf.features)
        holds = ((x[:, leaf.features] > leaf.low) & (x[:, leaf.features] <= leaf.high)).astype(float)
        weights = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
        for i, f in enumerate(leaf.features):
            poly = [np.ones(len(x))]  # coefficients, by the number of known features
            for j in range(m):
                if j != i:
                    up, keep = holds[:, j], leaf.share[j]
                    poly = [keep * (poly[k] if k < len(poly) else 0.0) + (up * poly[k - 1] if k else 0.0) for k in range(len(poly) + 1)]
            phi[:, f] += leaf.value * (holds[:, i] - leaf.share[i]) * sum(w * p for w, p in zip(weights, poly, strict=True))
    return phi


def expected(found: list[Leaf]) -> float:
    """The prediction over no known feature: what all values of a row add up from."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in found))


def linear_terms(fitted: Fitted, background: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(weights, means of the background) of a linear model; None for others. One row reaches the driver."""
    m = fitted.model
    if isinstance(m, Ridge):
        return m.coefficients / m.scale, m.centre
    if isinstance(m, Boosted) or not hasattr(m.stages[-1], "coefficients"):
        return None
    row = impute(background, fitted.values).agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(fitted.features))).first()
    return m.stages[-1].coefficients.toArray(), np.array([row[f"m{i}"] or 0.0 for i in range(len(fitted.features))])


def _long(wide: DataFrame, keys: list[str], names: list[str], values: list) -> DataFrame:
    each = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"), v.alias("shap")) for n, v in zip(names, values, strict=True)))
    return wide.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")


def sampled_shap(fitted: Fitted, df: DataFrame, background: DataFrame, keys: list[str], pairs: int = 8, most: int = 100, seed: int = 42) -> DataFrame:
    """Shapley values of any model by permutations in antithetic pairs, against at most `most` rows of a background.

    Along a permutation features pass from a background row to the row's own, one after the other, and each
    gets the change of the prediction; a permutation and its reverse go together. Each row meets the same
    background rows, so its values add up to its prediction less the mean prediction of these. The mixed
    rows are made and predicted in Spark, (features + 1) * 2 * pairs for each row.
    """
    names, d = fitted.features, len(fitted.features)
    rows = impute(df, fitted.values).select(*keys, *names)
    order = F.xxhash64(F.lit(seed), *names)
    others = [[float(r[f]) for f in names] for r in impute(background, fitted.values).select(*names).orderBy(order, *names).limit(most).collect()]
    rng = np.random.default_rng(seed)
    paths = []
    for k in range(pairs):
        forward, other = rng.permutation(d), others[k % len(others)]
        for way in (forward, forward[::-1]):
            rank = np.argsort(way)
            paths += [{"path": len(paths) // (d + 1), "done": done, "own": (rank < done).tolist(), "other": other, "feature": int(way[done - 1]) if done else -1} for done in range(d + 1)]
    steps = F.from_json(F.lit(json.dumps(paths)), "array<struct<path: int, done: int, own: array<boolean>, other: array<double>, feature: int>>")
    keyed = rows.withColumn("__row", F.monotonically_increasing_id())
    mixed = keyed.select("*", F.inline(steps))
    mixed = mixed.select(*keys, "__row", "path", "done", "feature", *(F.col(f).alias(f"__own_{i}") for i, f in enumerate(names)), *(F.when(F.get("own", F.lit(i)), F.col(f)).otherwise(F.get("other", F.lit(i))).alias(f) for i, f in enumerate(names)))
    gains = fitted.transform(mixed)
    # A change belongs to the feature that has just passed over: +1 for the prediction with it, -1 for the one before.
    after = F.lead("feature").over(Window.partitionBy("__row", "path").orderBy("done"))
    signed = gains.withColumn("__next", after)
    terms = [F.sum(F.when(F.col("feature") == i, F.col("predicted")).otherwise(0.0) - F.when(F.col("__next") == i, F.col("predicted")).otherwise(0.0)) / (2 * pairs) for i in range(d)]
    firsts = [F.first(c).alias(c) for c in keys]
    wide = signed.groupBy("__row").agg(*firsts, *(F.first(f"__own_{i}").alias(f) for i, f in enumerate(names)), *(t.alias(f"__shap_{i}") for i, t in enumerate(terms)))
    return _long(wide, keys, names, [F.col(f"__shap_{i}") for i in range(d)])


def shap_values(fitted: Fitted, df: DataFrame, folder: str, keys: list[str], background: DataFrame | None = None) -> DataFrame:
    """(keys, feature, value, shap) for each row and feature; values are imputed as the model imputes them.

    Trees by their leaves; linear models in closed form, about the means they were fitted with (or those of
    the background, by default the rows themselves).
    """
    names = fitted.features
    if (linear := linear_terms(fitted, background if background is not None else df)) is not None:
        weights, means = linear
        rows = impute(df, fitted.values).select(*keys, *names)
        return _long(rows, keys, names, [(F.col(f) - float(m)) * float(w) for f, w, m in zip(names, weights, means, strict=True)])
    found = leaves(tree_nodes(fitted, folder, df.sparkSession))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            phi = shapley(found, frame[names].to_numpy(float))
            yield pd.concat([frame, pd.DataFrame({f"__shap_{i}": phi[:, i] for i in range(len(names))}, index=frame.index)], axis=1)

    rows = impute(df, fitted.values).select(*keys, *names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"__shap_{i} double" for i in range(len(names)))])
    wide = rows.mapInPandas(run, schema)
    return _long(wide, keys, names, [F.col(f"__shap_{i}") for i in range(len(names))])


def shap_importance(values: DataFrame, top: int | None = None) -> DataFrame:
    """(feature, mean_abs_shap), largest first."""
    out = values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), "feature")
    return out.limit(top) if top else out
